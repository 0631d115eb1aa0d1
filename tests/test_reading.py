import datetime
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from notewell.functions import markdown, payload
from notewell.functions.stem import stem
from notewell.operators import decisions, lint, reading, review, search, sections, starter
from notewell.plans import base as B
from notewell.operators import notes as N

NOTE = """---
title: "A: b"
nested:
  inner:
    - leaf: 1
    - leaf: [x, y]
empty:
tags: [one, two]
---
lead

# Links

See [the site][home], [home] and [gone][nowhere].

[home]: https://example.org/a "Title"

## Text

- Some claim that spans
  two lines of text
- [[only a link]]
- short

```
- not an item
```

## Deep

### Deeper

words and words
"""


@pytest.fixture(scope="module")
def notes(spark):
    files = [("a/Note.md", NOTE), ("b/Plain.md", "nothing here\n"), ("c/Other.md", "# Title\n\n## Same\n\none\n\n## Same\n\ntwo\n")]
    return N.parse(spark.createDataFrame(files, "rel string, content string"), *lint.PARTS, "fm_json", "fields", "regions").cache()


@pytest.mark.parametrize(("path", "value", "error"), [
    ("nested.inner[0].leaf", "1", None), ("nested.inner[1].leaf[1]", '"y"', None), ("tags", '["one","two"]', None), ("empty", "null", None),
    ("nested.outer", None, "no key 'outer'"), ("nested.inner[5]", None, "index 5 is out of range: 2 items"), ("tags.x", None, "no key 'x': not a map"), ("title[0]", None, "no index 0: not a list"),
])
def test_paths_into_frontmatter(notes, path, value, error):
    got = notes.where("rel = 'a/Note.md'").select(reading.at_path(F.col("fm_json"), path).alias("x")).first().x
    assert (got.value, got.error) == (value, error)


@pytest.mark.parametrize("path", ["", "a..b", "a[", "a[x]", "a[1]b", "[0]"])
def test_paths_that_are_none(path):
    with pytest.raises(reading.PathError):
        reading.path_steps(path)


def test_fields_keep_their_order_and_text(notes):
    got = [(f.key, f.value, f.line) for f in notes.where("rel = 'a/Note.md'").first().fields]
    assert got == [("title", '"A: b"', 2), ("nested", "inner:\n  - leaf: 1\n  - leaf: [x, y]", 3), ("empty", "", 7), ("tags", "[one, two]", 8)]


def test_links_by_the_name_of_a_definition():
    note = markdown.structure(NOTE)
    assert [(x["url"], x["title"]) for x in note.inlines if x["type"] == "Link"] == [("https://example.org/a", "Title")] * 2
    assert [n["type"] for n in note.nodes].count("LinkReferenceDefinition") == 1


def test_addresses_and_shadows(spark, notes):
    ranges = sections.ranges(notes)
    asked = spark.createDataFrame([("a/Note.md", x) for x in ("1.1", "Deeper", "links", "3", "what")] + [("c/Other.md", "same"), ("b/Plain.md", "1")], "rel string, asked string")
    got = {(r.rel[0], r.asked): (r.outcome, r.found) for r in reading.addressed(asked, ranges).collect()}
    assert got == {
        ("a", "1.1"): ("found", ["1.1"]), ("a", "Deeper"): ("found", ["1.2.1"]), ("a", "links"): ("reserved", []), ("a", "3"): ("out of range", []),
        ("a", "what"): ("no match", []), ("c", "same"): ("ambiguous", ["1.1", "1.2"]), ("b", "1"): ("out of range", []),
    }
    assert {(r.address, r.reading) for r in reading.shadows(ranges).collect()} == {("1", "links"), ("1.1", "text")}
    assert [tuple(r) for r in reading.read_target(notes, "Other#Same").orderBy("address").collect()] == [("c/Other.md", "1.1"), ("c/Other.md", "1.2")]


def test_unfolding_stops_at_depth_and_size(notes):
    ranges = sections.ranges(notes)
    text = lambda **how: reading.unfold(notes.where("rel = 'a/Note.md'"), ranges, "1", **how).first().text
    assert text(threshold=0, full=True) == NOTE.split("lead\n\n")[1].rstrip("\n")
    size = len(NOTE.split("## Text")[1].split("## Deep")[0].rstrip("\n")) + len("## Text")
    assert text(threshold=0).splitlines()[-2:] == [f"1.1 Text ({(size + 1) // 4})", "1.2 Deep (9)"] and "claim" not in text(threshold=0)
    one = text(threshold=1000, depth=1)
    assert "claim" in one and "1.2.1 Deeper" in one and "words and words" not in one


def test_structure_is_checked(spark, notes):
    got = {(r.rel[0], r.check): (r.n, r.bad) for r in reading.check_structure(notes).collect()}
    assert all(bad == 0 for _, bad in got.values()) and got["a", "order"][0] > 5
    broken = notes.where("rel = 'a/Note.md'").withColumn("nodes", F.transform("nodes", lambda x: x.withField("span", F.struct((x["span"]["start"] - 30).alias("start"), x["span"]["end"].alias("end"))).withField("type", F.lit("Unknown"))))
    bad = {r.check: r.bad for r in reading.check_structure(broken).collect()}
    assert bad["order"] > 0 and bad["known"] > 0


def test_structure_as_lines(notes, tmp_path):
    reading.write_lines(notes, str(tmp_path / "out"), "headings", "inlines")
    rows = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    one = next(r for r in rows if r["rel"] == "a/Note.md")
    assert len(rows) == 3 and [h["text"] for h in one["headings"]] == ["Links", "Text", "Deep", "Deeper"]
    assert [x["span"]["start"] for x in one["inlines"]] == sorted(x["span"]["start"] for x in one["inlines"])


@pytest.mark.parametrize(("query", "found"), [
    ("apple pear", {"1", "2", "3"}), ("apple AND pear", {"1"}), ("apple NOT pear", {"2"}), ("apple OR fig", {"1", "2", "4"}), ("apple AND NOT pear OR fig", {"2", "4"}), ("pear AND apple AND fig", set()),
])
def test_boolean_queries(spark, query, found):
    files = [("1.md", "apple pear"), ("2.md", "apple"), ("3.md", "pear"), ("4.md", "fig")]
    notes = N.parse(spark.createDataFrame(files, "rel string, content string"))
    assert {r.title for r in search.search(notes, query, stem=False).collect()} == found


@pytest.mark.parametrize("query", ["AND", "apple AND", "OR pear", "apple AND OR pear", "NOT", "NOT apple", "apple NOT NOT pear"])
def test_queries_that_cannot_be_read(query):
    with pytest.raises(ValueError):
        search.parse_query(query)


def test_consult_output_and_log(spark, tmp_path):
    long = "---\ntype: card\n---\n# Start\n\nnothing\n\n## Yeast\n\nyeast and flour\n" + "filler " * 900
    files = [("Dough.md", "---\ntype: card\n---\nyeast flour yeast flour water\n"), ("Long.md", long), ("Far.md", "---\ntype: card\n---\nboats and yeast\n"), *[(f"f{i}.md", f"---\ntype: card\n---\nrope {i} sail\n") for i in range(6)]]
    notes = N.parse(spark.createDataFrame(files, "rel string, content string"), "headings").cache()
    mode = search.Mode(0.5, 0.1, budget=500, cap=400)
    out = search.consult(notes, "yeast flour", mode)
    assert {r.rel for r in out.docs.collect()} == {"Dough.md", "Far.md"}
    text = search.render_consult(out)
    assert text.startswith("<!-- consult: 2 documents") and "## Dough (Dough.md)" in text
    both = {r.rel: r.section for r in search.best_sections(notes, ["yeast", "flour"], stem=False).collect()}
    assert both == {"Long.md": "1.1"}
    none = search.consult(notes, "zebra")
    assert "nothing is sure enough (no hits)" in search.render_consult(none) and json.loads(search.render_consult(none, "json"))["status"] == "abstain"
    one = search.record(out, "deliberate", "markdown", 12, 1_700_000_000_000)
    assert len(one) == 21 and one["outcome"] == "selected" and one["selected_paths"] == ["Dough.md", "Far.md"] and one["query_error"] is None
    bad = search.record(search.consult(notes, "yeast AND"), "ambient", "json", 1, 2)
    assert bad["outcome"] == "abstain" and bad["query_error"] == bad["reason"] and set(bad) == set(one)
    path = str(tmp_path / "log")
    assert all(search.append_log(spark.createDataFrame([r], search.LOG_SCHEMA), path) for r in (one, bad))
    assert {r.outcome for r in spark.read.schema(search.LOG_SCHEMA).json(path).collect()} == {"selected", "abstain"}
    hits = search.search(notes, "yeast", stem=False)
    assert search.render_search(hits, "paths").splitlines()[0] in ("Dough.md", "Far.md") and len(json.loads(search.render_search(hits, "json"))) == 3


def test_stemmed_search_agrees_with_plain_scores(spark):
    words = ["running", "runs", "hopping", "skies", "sky", "nation", "nationally", "stone", "river"]
    draw = random.Random(6)
    files = [(f"n{i}.md", f"---\ndescription: {draw.choice(words)} {draw.choice(words)}\n---\n" + " ".join(draw.choice(words) for _ in range(draw.randrange(3, 40)))) for i in range(40)]
    query = "Runs nationally skies"
    terms = sorted({stem(w.lower()) for w in query.split()})
    cut = lambda t: [stem(w.lower()) for w in re.findall(r"[^\W_]+", t)]
    fields = [{"title": cut(rel[:-3]), "description": cut(c.split("description: ")[1].split("\n")[0]), "body": cut(c.split("---\n")[2])} for rel, c in files]
    want = {}
    for (rel, _), f in zip(files, fields, strict=True):
        for name, boost in search.BOOSTS.items():
            for t in terms:
                df = sum(t in x[name] for x in fields)
                norm = search.K1 * (1 - search.B + search.B * len(f[name]) / (sum(len(x[name]) for x in fields) / len(fields)))
                if tf := f[name].count(t):
                    want[rel] = want.get(rel, 0.0) + boost * math.log1p((len(fields) - df + 0.5) / (df + 0.5)) * tf * (search.K1 + 1) / (tf + norm)
    notes = N.parse(spark.createDataFrame(files, "rel string, content string"))
    got = [(r.rel, r.score) for r in search.search(notes, query, limit=100).collect()]
    assert {rel: pytest.approx(s) for rel, s in got} == want and [s for _, s in got] == sorted((s for _, s in got), reverse=True)


def test_lint_output(notes):
    found = lint.findings(lint.Vault(notes))
    lines = lint.render(found).splitlines()
    assert any("[untyped-entry]" in x for x in lines) and len(json.loads(lint.render(found, "json"))) == len(lines)
    assert lint.render(found, "markdown").startswith("### a/Note.md") and "untyped-entry" in lint.render(found, "summary")


def test_items_that_say_something():
    assert [(h, d, x) for h, d, x, _ in payload.list_items(NOTE)] == [("Text", 2, "Some claim that spans two lines of text")]


def test_units_and_items(spark, notes):
    got = [(r.unit, r.title, r.heading, r.depth) for r in review.units(notes.where("rel = 'c/Other.md'")).orderBy("unit").collect()]
    assert got == [(1, "# Title", "Same", 2), (2, "# Title", "Same", 2)]
    claims = spark.createDataFrame([("a/Note.md", "He said: some claim that spans two lines of text, twice")], "rel string, claim string")
    assert review.list_items(notes, "rel", "body").count() == 1 and review.list_items(notes, "rel", "body", claims).count() == 0


def test_edges_that_share_a_slug(spark):
    source = spark.createDataFrame([(1, "[[foo bar]] [[x/Foo-Bar]] [[Kept|k]] [[kept]] [[lost]] [[Lost|l]]")], "k int, t string")
    output = spark.createDataFrame([(1, "[[foo bar]] and [kept](kept.md)")], "k int, t string")
    got = {(r.markup, r.reason) for r in review.edge_residue(review.edges(source, "k", "t"), review.edges(output, "k", "t"), "k").collect()}
    assert got == {("[[foo bar]]", "collision"), ("[[x/Foo-Bar]]", "collision"), ("[[Lost|l]]", "dropped")}


def test_trust_and_fences(spark):
    rows = spark.createDataFrame([("---\na: 1\n...\nbody",), ("body",), ("---\nepistemic_status: certified\n---\n",), ("---\nunclosed",)], "c string")
    got = [r.x for r in rows.select(review.with_trust(F.col("c")).alias("x")).collect()]
    mark = "epistemic_status: provisional\n"
    assert got == [f"---\na: 1\n{mark}...\nbody", f"---\n{mark}---\nbody", "---\nepistemic_status: certified\n---\n", f"---\n{mark}---\n---\nunclosed"]


def test_edges_endpoints_and_quotes(spark):
    files = spark.createDataFrame([("1", "# Head\n\né *One* stands [here](u).\n\n> Two is quoted, and\n> One [[links|to it]].\n")], "rel string, content string")
    notes = N.parse(files, "nodes")
    quotes = spark.createDataFrame([("1", 0, "One thing", "ONE stands here"), ("1", 1, "Two", "as quoted two says"), ("1", 2, "Three", "absent"), ("1", 3, "one Thing", " -- "), ("1", 4, "Four", "One links|to it")], "rel string, id int, term string, quote string")
    found = spark.createDataFrame([("1", "one thing", "part-of", "Five", "absent"), ("1", "One thing", "refines", "two", "One stands"), ("1", "Two", "refines", "four", "absent")], "rel string, source string, kind string, to string, quote string")
    nodes, edges = review.located_graph(notes.withColumnRenamed("rel", "k"), quotes.withColumnRenamed("rel", "k"), found.select(F.col("rel").alias("k"), "source", F.col("kind").alias("rel"), "to", "quote"), "k")
    # Links and marks don't matter; a quote falls into the shortest block that holds it, of blocks as long into the first.
    assert {(r.id, tuple(r.span) if r.span else None, r.error) for r in nodes.collect()} == {(0, (8, 34), None), (1, (36, 79), None), (2, None, "no block shares a word"), (3, None, "no words"), (4, (36, 79), None)}
    assert {(r.from_id, r.rel, r.to_id, tuple(r.span) if r.span else None, r.error) for r in edges.collect()} == {(0, "refines", 1, (8, 34), None), (1, "refines", 4, None, "no block shares a word")}
    assert spark.range(1).select(review.same_items(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(1))).alias("x")).first().x
    edge = spark.createDataFrame([(" Part  Of ", "“B”", " "), (" ", "b", None), ("r", "", None)], "rel string, to string, predicate string")
    assert [tuple(r) for r in review.normal_edges(edge).collect()] == [("part-of", '"B"', None)]


def test_decisions_that_nest_or_repeat(spark):
    inner = "<!-- interact: pick-any id=a -->\n- [x] keep it\n<!-- interact: pick-any id=b -->\n- [x] drop it\n<!-- /interact -->\n<!-- /interact -->\n"
    files = [("nested.md", inner), ("bad.md", "<!-- interact: guess id=a -->\n<!-- /interact -->\n<!-- interact: pick-one -->\n<!-- /interact -->\n"), ("stray.md", "<!-- /interact -->\n"), ("plain.md", "<!-- interact: pick-any id=z -->\n- [ ] keep one\n- [x] keep two\n<!-- /interact -->\n")]
    notes = N.parse(spark.createDataFrame(files, "rel string, content string"), "regions", "dangling")
    got = {(r.rel, r.line, r.code) for r in decisions.errors(notes, ("keep", "drop")).collect()}
    assert got == {("nested.md", 3, "nested"), ("bad.md", 1, "bad anchor"), ("bad.md", 3, "bad anchor"), ("stray.md", 1, "never opened")}
    assert [tuple(r) for r in decisions.fired(notes, ("keep", "drop")).collect()] == [("plain.md", "z", "pick-any", "keep", "two")]


def test_decisions_are_read_in_their_own_row(spark):
    same = "<!-- interact: pick-any id=a --><!-- /interact --><!-- interact: pick-any id=a --><!-- /interact -->\n"
    one = "<!-- interact: pick-one id=b -->\n- [X] keep\n- [ ] drop x\n<!-- /interact -->\n"
    files = [("twice.md", same), ("one.md", one + "\n<!-- interact: confirm-all id=c -->\n<!-- /interact -->\n"), ("open.md", one.replace("[ ]", "[x]") + "<!-- interact: confirm-all id=c -->\n- [ ] eat\n"), ("none.md", "text\n")]
    notes = N.parse(spark.createDataFrame(files, "rel string, content string"), "regions", "dangling")
    wrong, right = decisions.errors(notes, ("keep", "drop")), decisions.fired(notes, ("keep", "drop"))
    assert sorted(tuple(r) for r in wrong.collect()) == [("open.md", 1, "not one"), ("open.md", 5, "never closed"), ("twice.md", 1, "repeated id")]
    assert [tuple(r) for r in right.collect()] == [("one.md", "b", "pick-one", "keep", "")]
    # Nothing is joined, shuffled or broadcast, and a note is parsed once.
    for found in (wrong, right):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Join", "Aggregate", "Repartition")) and plan.count("ArrowEvalPython") == 1


def test_starter_files(tmp_path):
    root = str(tmp_path)
    path = starter.init_views(root, "41 projects/own", "Tickets.base")
    base = B.parse(open(path).read())
    assert [v.name for v in base.views] == ["Open", "Backlog", "Done"] and base.view("Open").order[0] == "file.name"
    with pytest.raises(starter.StarterError):
        starter.init_views(root, "41 projects/own", "Tickets.base")
    today = datetime.date(2026, 1, 1)
    with pytest.raises(starter.StarterError):
        starter.week_log(root, "logs", today, today)
    (tmp_path / "templates").mkdir()
    (tmp_path / "templates/Weekly Log.md").write_text("---\ntype: weekly-log\nweek:\nstart:\nend: kept\n---\n## Tasks\n")
    made = starter.week_log(root, "logs", today, today)
    assert made.endswith("logs/2026-w01.md") and open(made).read() == "---\ntype: weekly-log\nweek: 2026-W01\nstart: 2025-12-29\nend: kept\n---\n## Tasks\n"
    assert starter.week_log(root, "logs", today, datetime.date(2027, 1, 1)) == made
    with pytest.raises(starter.StarterError):
        starter.week_log(root, "logs", datetime.date(2025, 1, 1), today)
    with pytest.raises(starter.StarterError):
        starter.context(root)
    (tmp_path / "Context.md").write_text("about")
    assert starter.context(root) == "about"


def test_a_year_of_points(spark):
    days = spark.createDataFrame([("2024-01-01", 0), ("2024-01-02", 20), ("2024-02-29", 4), ("2024-03-09", 99), ("2023-05-05", 7)], "day string, xp long")
    grid = starter.calendar_grid(days, 2024, 3, datetime.date(2024, 3, 1))
    lines = grid.splitlines()
    assert len(lines) == 10 and lines[-1] == "streak 3 · level 0 · 24 points" and lines[0].split()[:3] == ["Jan", "Feb", "Mar"]
    assert lines[1].startswith("Mon \x1b[48;5;236m  ") and lines[2].startswith("Tue \x1b[48;5;46m  ") and grid.count("()") == 1 and "()" in lines[5]
    assert starter.calendar_grid(days, 2024, 0, datetime.date(2024, 3, 1), dark=False).splitlines()[2].startswith("Tue \x1b[48;5;28m")


def test_notes_are_read_once_by_what_looks_at_their_sections(spark):
    from notewell.operators import notes as N

    files = spark.createDataFrame([("a.md", NOTE)], "rel string, content string")
    fresh = N.parse(files, "headings")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    # Reading notes twice and joining them with themselves grows with the notes; each of these is one pass.
    for df in (reading.overview(fresh), reading.unfold(fresh, None, "1", threshold=3), search.best_sections(fresh, ["claim"], stem=False), sections.owned(fresh)):
        assert plan(df).count("ArrowEvalPython") == 1 and "Join" not in plan(df)
    asked = fresh.select("rel", F.explode(F.array(F.lit("1.1"), F.lit("Deeper"))).alias("asked"))
    assert plan(reading.addressed(asked, sections.ranges(fresh))).count("ArrowEvalPython") == 1
    # The frontmatter isn't read where only headings are asked for.
    assert "fm" not in plan(sections.ranges(fresh)) and "AS fm" not in plan(reading.overview(fresh))


def test_one_pass_gives_what_joins_give(spark, notes):
    ranges = sections.ranges(notes)
    lines = notes.select("rel", F.posexplode(F.split("content", "\n")).alias("i", "t")).select("rel", (F.col("i") + 1).alias("line"))
    assert {tuple(r) for r in sections.owned(notes).collect()} == {tuple(r) for r in sections.owners(lines, ranges).collect()}
    prose = {(r.rel, r.address): (r.tokens, r.own_tokens) for r in sections.own_prose(notes, ranges).collect()}
    from notewell.functions import text

    weighed = notes.select("rel", "headings", text.lines(F.col("content")).alias("l")).select("rel", F.inline(sections.weighed(F.col("headings"), F.col("l"))))
    assert {(r.rel, r.address): (r.tokens, r.own_tokens) for r in weighed.collect()} == prose
    for how in ({"threshold": 3}, {"threshold": 10}, {"threshold": 1000, "depth": 1}, {"threshold": 0, "full": True}):
        assert sorted(map(tuple, reading.unfold(notes, None, "1", **how).collect())) == sorted(map(tuple, reading.unfold(notes, ranges, "1", **how).collect()))
