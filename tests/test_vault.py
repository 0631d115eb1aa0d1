import json

import pytest
from pyspark.sql import functions as F

from notewell.functions import format as fmt
from notewell.functions import markdown, payload, yaml12
from notewell.functions.stem import stem
from notewell.operators import distill, graph, lint, search, sections
from notewell.operators import notes as N
from notewell.plans import base as B
from notewell.sources import vault
from notewell.streaming import ingest

LOAF = """---
type: bake
description: {description}
kneaded: {kneaded}
flour_g: {flour}
loaves: {loaves}
oven: {oven}
{more}---

Crust and crumb of {description}.
"""
BAKES = """filters:
  and:
    - type == "bake"
    - file.inFolder("60 kitchen/bread")
formulas:
  per_loaf: if(loaves > 0, (flour_g / loaves).round(1), "none")
  hot: if(oven > 230, "hot", if(oven < 180, "mild", "middling"))
  paid: '(flour_g + 40) * 2 / 100'
  unread: if("dough" > "batter", oven, "")
properties:
  formula.per_loaf:
    displayName: Grams each
  note.oven:
    displayName: Degrees
views:
  - name: By heat
    order: [file.name, oven, formula.hot, formula.unread]
    sort:
      - property: oven
        direction: DESC
      - property: file.name
        direction: ASC
  - name: Resting
    filters:
      and: ['!kneaded.isTruthy()']
    order: [file.name, file.folder]
  - name: Flour
    order: [file.name, flour_g, formula.per_loaf, formula.paid]
    summaries:
      flour_g: Sum
      formula.per_loaf: Average
      file.name: Median
  - name: Seeded
    filters:
      or:
        - seeds.containsAny("poppy", "rye")
        - seeds.length > 2
    order: [file.name]
    groupBy:
      property: oven
      direction: ASC
  - name: Broken
    filters:
      and: [flour_g ~ 3]
    order: [file.name]
"""


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("vault")
    loaves = [
        ("Sourdough", "true", 900, 2, 240, "seeds: [rye, flax]\n"), ("Focaccia", "false", 500, 0, 220, "seeds:\n  - thyme\n  - salt\n  - olive\n"),
        ("Milk rolls", "true", 620, 8, 175, ""), ("Baguette", "", 250, 1, 240, "seeds: [poppy]\n"),
    ]
    files = {f"60 kitchen/bread/{name}.md": LOAF.format(description=name.lower(), kneaded=kneaded, flour=flour, loaves=n, oven=oven, more=more) for name, kneaded, flour, n, oven, more in loaves}
    files |= {
        "20 cards/Autolyse.md": "---\ntype: card\ndescription: rest of flour and water\ntags: [dough, dough]\nreference: \"[[Grain and water]]\"\n---\nFlour hydrates while it rests. Compare [[Grain and water|the manual]] and [[Nowhere to be seen#h]].\n",
        "20 cards/Stale advice.md": "---\ntype: card\nsuperseded: true\ntags: [dough]\n---\nhydrates hydrates hydrates hydrates\n",
        "20 cards/Torn.md": "---\ntype: [card\n---\nleft over\n",
        "30 references/Grain and water.md": "---\ntype: reference\ndescription: A manual of dough\ntags: [manual]\n---\n# Grain and water\n\n## Hydration\n\nparts\n\n> [!tip] warm hands\n> make sticky dough\n",
        "Shopping.md": "---\ndescription: what to buy\n---\nyeast_and/*.oil or in/*.paper but not*this*one [[AUTOLYSE]]\n",
        "templates/Card.md": "---\ntype: card\ntemplate: true\ndescription:\ntags: [a, b]\nreference:\nkind: [idea, fact]\n---\n",
        "60 kitchen/breadbin/Crumbs.md": "---\ntype: bake\noven: 300\n---\n",
        "cellar/old.md": "kept out",
        "draft.wip.md": "kept out",
        ".vaultignore": "# what isn't read\ncellar/\n*.wip.md\n",
        "loaf.JPG": "jpg",
    }
    for rel, content in files.items():
        (top / rel).parent.mkdir(parents=True, exist_ok=True)
        (top / rel).write_text(content)
    (top / "latin.md").write_bytes(b"cr\xe8me")
    return str(top)


@pytest.fixture(scope="module")
def notes(spark, root):
    return N.parse(vault.scan(spark, root), *lint.PARTS).cache()


def test_scan_ignores_and_skips_what_is_not_text(spark, root, capsys):
    found = {r.rel for r in vault.scan(spark, root).select("rel").collect()}
    assert not {"cellar/old.md", "draft.wip.md", "latin.md"} & found and "Shopping.md" in found and len(found) == 11
    assert [r.rel for r in vault.unreadable(spark, root).collect()] == ["latin.md"]
    assert [r.rel for r in vault.assets(spark, root).collect()] == ["loaf.JPG"]
    spark.dataSource.register(vault.VaultSource)
    assert {r.rel for r in spark.read.format("vault").load(root).select("rel").collect()} == found
    every = spark.read.format("vault").option("ignore", "false").load(root)
    assert {"cellar/old.md", "draft.wip.md"} < {r.rel for r in every.collect()}


def test_views(spark, notes):
    base = B.parse(BAKES)
    rows = B.run(base, "By heat", notes)
    assert [tuple(r)[:4] for r in B.ordered(rows).collect()] == [("Baguette", "240", "hot", "240"), ("Sourdough", "240", "hot", "240"), ("Focaccia", "220", "middling", "220"), ("Milk rolls", "175", "mild", "175")]
    assert {(r.c0, r.c1) for r in B.run(base, "Resting", notes).collect()} == {("Focaccia", "60 kitchen/bread"), ("Baguette", "60 kitchen/bread")}
    assert {(r.c0, r._group) for r in B.run(base, "Seeded", notes).collect()} == {("Sourdough", "240"), ("Focaccia", "220"), ("Baguette", "240")}
    flour = B.run(base, "Flour", notes)
    assert {tuple(r)[:4] for r in flour.collect()} == {("Sourdough", "900", "450", "18.8"), ("Focaccia", "500", "none", "10.8"), ("Milk rolls", "620", "77.5", "13.2"), ("Baguette", "250", "250", "5.8")}
    assert tuple(B.summaries(base, "Flour", flour).first()) == ("", "2270", "259.167", "")
    assert B.render_tsv(rows).splitlines()[:2] == ["name\tDegrees\thot\tunread", "Baguette\t240\thot\t240"] and len(json.loads(B.render_json(flour))) == 4
    table = B.render_table(B.run(base, "Seeded", notes)).splitlines()
    assert table[0] == "### 220" and table[2] == "| name |" and "### 240" in table
    with pytest.raises(B.BaseError):
        B.run(base, "Broken", notes)
    with pytest.raises(B.BaseError):
        base.view("Cakes")


def test_each_note_is_parsed_once(spark, root):
    fresh = N.parse(vault.scan(spark, root), "links")
    plans = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    count = lambda df: plans(df).count("ArrowEvalPython")
    base = B.parse(BAKES)
    # An order samples what it sorts: the notes are parsed below an exchange that stands between, whose output is kept.
    assert count(B.run(base, "By heat", fresh)) == 1 and "Sort" not in plans(B.run(base, "By heat", fresh))
    assert "RepartitionByExpression" in plans(B.ordered(B.run(base, "By heat", fresh)))
    # A filter on what was parsed doesn't parse again, and what isn't asked for isn't read.
    assert count(fresh.where("type = 'card' and tier <> 'superseded'").select("name")) == 1
    assert "ArrowEvalPython" not in plans(fresh.select("rel", "folder"))


def test_links_and_lint(spark, root, notes):
    assert {(r["name"], r.src_name) for r in graph.backlinks(notes).collect()} == {("Grain and water", "Autolyse"), ("Autolyse", "Shopping")}
    found = lint.findings(lint.Vault(notes, vault.assets(spark, root)))
    rules = {(r.rule, r.file) for r in found.collect()}
    assert {
        ("broken-wikilink", "20 cards/Autolyse.md"), ("invalid-frontmatter", "20 cards/Torn.md"), ("duplicate-h1", "30 references/Grain and water.md"),
        ("untyped-entry", "Shopping.md"), ("callout-missing-separator", "30 references/Grain and water.md"), ("unintended-emphasis", "Shopping.md"),
    } <= rules
    assert not any(rule == "orphan-card" and f.endswith("Autolyse.md") for rule, f in rules)
    assert lint.exit_code(found) == 1
    with pytest.raises(ValueError):
        lint.severities({"no-rule": "off"})


def test_search_and_consult(notes):
    hits = search.search(notes, "hydrates flour").collect()
    assert hits[0].title == "Autolyse" and hits[0].snippet.startswith("Flour hydrates")
    assert all(r.title != "Stale advice" for r in search.search(notes, "hydrates", drop_superseded=True).collect())
    out = search.consult(notes, "hydrates flour", scope=("card",))
    assert out.exit_code == 0 and [r.rel for r in out.docs.collect()] == ["20 cards/Autolyse.md"]
    assert search.consult(notes, "zebra").exit_code == 4 and search.consult(notes, "flour AND").exit_code == 4


def test_gate_priorities(spark):
    hits = spark.createDataFrame([(1, 9.0, 1.0), (2, 1.0, 0.0), (3, 1.0, 0.0)], "rank int, score double, coverage double")
    reason = lambda mode: search.gate(hits, mode).first().abstain_reason
    assert reason(search.Mode(0.5, 1.5)) is None
    assert reason(search.Mode(0.5, 1.5, threshold=10.0)) == "below threshold"
    assert reason(search.Mode(1.1, 1.5)) == "low coverage"
    assert reason(search.Mode(0.5, 10.0)) == "no score elbow"


def test_packing_passes_over_what_does_not_fit(spark):
    hits = spark.createDataFrame([(1, "a", 3.0, 50), (2, "b", 2.0, 60), (3, "c", 1.0, 40)], "rank int, rel string, score double, tokens int")
    assert {r.rel for r in search.pack(hits, search.Mode(0, 0, budget=100, cap=55)).collect()} == {"a", "c"}


def test_yaml_core_schema():
    got = yaml12.load("a: yes\nb: 012\nc: 2026-05-27\nd: 1e3\ne: ~\nf: [x, 'y, z', {k: 1}]\ng:\n- 1\n-\n  h: 2\n")
    assert got == {"a": "yes", "b": 12, "c": "2026-05-27", "d": 1000.0, "e": None, "f": ["x", "y, z", {"k": 1}], "g": [1, {"h": 2}]}
    assert yaml12.display([1.5, True, None, {"a": "b"}]) == "1.5, true, , a: b"
    for bad in ("a: [1", "a: b: c", "a: 1\na: 2", "- 1", 'a: "x'):
        with pytest.raises(ValueError):
            yaml12.load(bad)


def test_structure_positions_are_bytes():
    text = "---\na: 1\n---\nП\n\n# Ж [[x|y]]\n\n```\n[[no]]\n```\nT\n===\n`[[no]]` ![[e.png]]\n"
    note = markdown.structure(text)
    raw = text.encode()
    links = [x for x in note.inlines if x["type"] == "Wikilink"]
    assert [raw[x["span"]["start"] : x["span"]["end"]].decode() for x in links] == ["[[x|y]]", "![[e.png]]"]
    assert [(h["level"], h["address"], h["setext"]) for h in note.headings] == [(1, "1", False), (1, "2", True)]
    region = markdown.structure("<!-- a: i -->\n<!-- b -->\n<!-- /a -->\n`<!-- c -->`\n")
    assert [(r["label"], r["info"]) for r in region.regions] == [("a", "i")] and [d["label"] for d in region.dangling] == ["b"]


@pytest.mark.parametrize("text", ["# A\ntext\n\n\n\n* x\n* y\n", "a\r\nb\r\n", "| a | b |\n|---|:-:|\n| long cell | x |\n", "1) a\n2) b\n", "```\n* a\n```\n"])
def test_format_is_idempotent_and_guarded(text):
    once, _ = fmt.format_note(text)
    assert fmt.format_note(once)[0] == once and fmt.check(once) == []
    assert [h["text"] for h in markdown.structure(once).headings] == [h["text"] for h in markdown.structure(text).headings]


def test_payload_round_trip_and_lanes():
    text = "See [[a]] and `code` at https://x.y/z.\n\n$x+1$ and 12 %, [@key].\n\n> quote\n\n| h | i |\n| - | - |\n| 1 | 2 |\n"
    masked, kept = payload.mask(text)
    assert payload.unmask(masked, kept) == text and "[[a]]" not in masked
    lanes = {(lane, key) for lane, _, key in payload.harvest(text)}
    assert {("wikilink", "a"), ("quote", "quote"), ("row", "1|2"), ("math", "x+1"), ("citation", "@key"), ("number", "12%")} <= lanes


def test_stems():
    assert [stem(w) for w in ("running", "nationally", "hopping", "generously", "skies", "retries")] == ["run", "nation", "hop", "generous", "sky", "retri"]
    assert stem("книгами") == stem("книга") == "книг"


def test_near_names_agree_with_all_pairs(spark):
    words = ["alpha", "alphq", "lpha", "beta gamma", "betagamma", "gamma beta", "xalpha", "delta", "dleta", "delt"]
    names = spark.createDataFrame([(w,) for w in words], "name string")
    got = {(r.a, r.b, r.distance) for r in distill.near_pairs(names).collect()}
    both = names.alias("x").join(names.alias("y"), F.expr("x.name < y.name")).select(F.col("x.name").alias("a"), F.col("y.name").alias("b"), F.levenshtein("x.name", "y.name").alias("d"))
    want = {(r.a, r.b, r.d) for r in both.where("d <= least(3, greatest(length(a), length(b)) div 3)").collect()}
    assert got == want


def test_sections_and_owner(spark, notes):
    ranges = sections.ranges(notes.where("name = 'Grain and water'"))
    assert {(r.address, r.start, r.end) for r in ranges.collect()} == {("1", 6, 13), ("1.1", 8, 13)}
    rel = "30 references/Grain and water.md"
    lines = spark.createDataFrame([(rel, 7), (rel, 10)], "rel string, line int")
    assert {(r.line, r.address) for r in sections.owners(lines, ranges).collect()} == {(7, "1"), (10, "1.1")}


def test_stream_of_notes(spark, root, tmp_path):
    query = ingest.keep_parsed(ingest.stream_notes(spark, root), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(60)
    table = ingest.latest(spark.read.parquet(str(tmp_path / "out")))
    assert table.where("type = 'bake'").count() == 5


def test_blocks_partition_a_note_and_each_signature_sees_its_own():
    text = "---\na: 1\n---\n# H\n\nwords\nmore\n\nUnder\n===\n\n* x\n* y\n\n```py\n1\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n> q\n"
    assert fmt.check_partition(text) == []
    kinds = [k for k, _, _ in fmt.block_spans(text)]
    assert kinds == ["FrontMatter", "Heading", "Paragraph", "Heading", "List", "CodeBlock", "Table", "BlockQuote"]
    change = {"kinds": ("> q", "q"), "rich": ("# H", "## H"), "text": ("words", "wordy"), "tables": ("| 1 | 2 |", "| 1 | 3 |"), "markers": ("* x\n* y", "- x\n- y")}
    for name, (old, new) in change.items():
        assert name in fmt.differences(text, text.replace(old, new))
    assert fmt.differences(text, text.replace("* ", "- "), "markers") == [] and fmt.differences(text, text) == []
    assert fmt.differences(text, text.replace("py\n1", "py\n2")) == ["text"]
