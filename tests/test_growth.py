"""Work that must not be done twice, or by one task."""

from notewell.functions import format as fmt
from notewell.functions import markdown, yaml12
from notewell.operators import canonical, notes
from notewell.sources import synth

SF = "/root/testdata/sf0.001"


def test_rules_of_format_share_one_reading(monkeypatch):
    read = []
    reader = markdown.Reader
    monkeypatch.setattr(markdown, "Reader", lambda *a: read.append(1) or reader(*a))
    text = "# One of its kind\n\ntext\n\n- item\n"
    assert fmt.format_note(text) == (text, []) and fmt.check(text) == [] and len(read) == 1


def test_rows_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(synth, "ROWS", 50)
    for rows, table in ((synth.tickets(spark, SF), "orders"), (synth.cards(spark, SF), "part")):
        assert rows.rdd.getNumPartitions() >= spark.read.parquet(f"{SF}/{table}.parquet").count() / 50


def test_canonical_notes_are_parsed_by_many_tasks(spark):
    docs = spark.createDataFrame([(i, f"# T\n\n## Concepts\n\n### A\n\nx {i}\n") for i in range(20)], "k int, text string").groupBy("k").agg({"text": "max"}).toDF("k", "text")
    written = {}
    keep = canonical.written

    def look(df, name):
        written[name] = df.rdd.getNumPartitions()
        return keep(df, name)

    canonical.written = look
    try:
        _, units, _ = canonical.read(docs, "k")
    finally:
        canonical.written = keep
    assert written["canonical-notes"] >= spark.sparkContext.defaultParallelism and units.count() == 20


def test_kept_values_are_told_apart():
    for text in ("a: 1\nb: true\nc: 1.0", "a: true\nb: 1\nc: -0.0", "a: [1, true]\nb: [true, 1]\nc: 0.0"):
        for _ in range(2):
            assert [(k, v) for k, v in notes.front_of(f"---\n{text}\n---\n", ())["fm"]] == [(k, notes.entry(v)) for k, v in sorted(yaml12.load(text).items())]
    # A setext underline below nothing but definitions leaves a paragraph without text.
    assert markdown.structure("[a]: /b\n===\n").headings == [] and markdown.structure("[a]: /b\n\n===\n").nodes


def test_keys_of_names_are_not_broadcast(spark):
    from notewell.operators import distill

    names = spark.createDataFrame([("ann",), ("bert of the long and winding road",)], "a string")
    plan = distill.candidates(names, names.withColumnRenamed("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") >= 2


def test_links_of_a_type_are_read_without_a_join(spark):
    from notewell.operators import lint

    fresh = notes.parse(spark.createDataFrame([("t.md", "---\ntype: ticket\n---\n[[a]] [[b]]\n")], "rel string, content string"), "links")
    found = lint.ticket_outward_only(lint.Vault(fresh))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() == 2


def test_fields_are_not_dealt_by_their_type(spark):
    from notewell.operators import lint

    fresh = notes.parse(spark.createDataFrame([("t.md", "---\ntype: card\ntemplate: true\nkind: [a]\n---\n"), ("c.md", "---\ntype: card\nodd: 1\nkind: b\n---\n")], "rel string, content string"))
    for rule, message in ((lint.unknown_field, "unknown field 'odd' for type 'card'"), (lint.invalid_enum_value, "'b' is no option of 'kind'")):
        found = rule(lint.Vault(fresh))
        assert "ResolvedHint" in found._jdf.queryExecution().analyzed().toString() and [tuple(r) for r in found.collect()] == [("c.md", message)]


def test_only_asked_keys_are_made():
    plain = '---\ntype: ticket\ntags: [a, "b c"]\ncost: 1.50\nstatus:\nrequires:\n  - "[[x]]"\n  - "[[y]]"\n---\nbody\n'
    odd = ("---\ntype: 'ticket'\ncost: 1\n---\n", "---\ncost: 1\ncost: 2\n---\n", "---\ncost: [a\n---\n", "---\ncost: 1\n", "no front", "---\ncost: 1\n\n---\n", "---\r\ncost: 1\r\n---\r\n", "---\ncost: a: b\n---\n", '---\ncost: "a" b\n---\n')
    asked = ("cost", "requires", "status", "tags")
    assert yaml12.picked(plain[4 : plain.index("\n---\n", 3)], asked) == {"cost": 1.5, "requires": ["[[x]]", "[[y]]"], "status": None, "tags": ["a", "b c"]}
    for content in (plain, *odd):
        some, whole = notes.front_of(content, (), asked), notes.front_of(content, ())
        assert sorted(some["fm"]) == [x for x in whole["fm"] if x[0] in asked] and some["fm_error"] == whole["fm_error"]


def test_a_view_names_the_keys_that_it_reads(spark):
    from notewell.plans import base

    files = spark.createDataFrame([("a.md", '---\ntype: t\ncost: 3\ndue-date: soon\nitems: [x]\nother: 1\n---\n')], "rel string, content string")
    source = base.parse("filters:\n  and: [items.length > 0]\nformulas:\n  late: due-date\n  twice: cost * 2\nviews:\n  - name: V\n    order: [formula.late, formula.twice]\n    sort:\n      - property: rank\n")
    assert {"cost", "due-date", "items", "rank"} <= set(base.keys(source, "V", notes.parse(files))) and "other" not in base.keys(source, "V", notes.parse(files))
    assert [tuple(r)[:2] for r in base.run_files(source, "V", files).collect()] == [tuple(r)[:2] for r in base.run(source, "V", notes.parse(files)).collect()] == [("soon", "6")]
    assert set(notes.parse(files, keys=("cost",)).first().fm) == {"cost", "type"}


def test_links_of_plain_notes_are_those_of_the_structure():
    import random

    draw = random.Random(3)
    pieces = ["", "", "word [[b|c]] d", "`[[no]]` [[yes]]", "`[[open", "end` [[z]]", "```", "````", "```a`b", "~~~", "## H [[h]] x", "# H #", "#tag [[q]]", "- item [[i]]", "- [ ] task [[j]]", "---", "| a | b |", "| --- | --- |", "| [[k]] | x |", "  in [[m]]", "> q [[o]]", "1. [[p]]", "a\\[[s]] ![[e|f]]", "t [a]([[v]]) u", "http://x/[[w]] <b [[c]]>", "[[ ]] [[[d]]]", "[[two", "é [[ü]]", "A | B", " ```"]
    taken = 0
    for _ in range(4000):
        content = draw.choice(["", "---\na: 1\n---\n"]) + "\n".join(draw.choice(pieces) for _ in range(draw.randint(1, 8)))
        found = markdown.plain_links(content)
        if found is not None:
            taken += 1
            whole = markdown.structure(content, emphasis=False, parts=("links",))
            assert found == [{"target": x["target"], "alias": x["alias"], "line": x["start_line"], "embed": x["embed"]} for x in whole.inlines if x["type"] == "Wikilink"], content
    assert taken > 400
    ticket = "---\ntype: ticket\n---\n# T\n\nSee [[a]] and [[b#N|c]].\n`[[no]]` stays.\n\n```\n[[nor]]\n```\n\n## Tasks\n\n- [ ] ship\n"
    assert [(x["target"], x["line"]) for x in markdown.plain_links(ticket)] == [("a", 6), ("b#N", 6)]


def test_notes_are_parsed_once_for_the_roster(spark):
    from notewell.operators import graph

    files = spark.createDataFrame([("t.md", '---\ntype: track\nslug: "a-1"\n---\n'), ("x.md", '---\ntype: ticket\ntrack: "[[track-a-2]]"\n---\n')], "rel string, content string")
    found = graph.roster_check(notes.parse(files))
    assert "ArrowEvalPython" not in found._jdf.queryExecution().optimizedPlan().toString() and [tuple(r) for r in found.collect()] == [("x.md", "a-2", ["a-1"])]


def test_narrow_parts_are_those_of_the_structure():
    import random

    draw = random.Random(11)
    pieces = ["", "", "", "word [[b|c]] d", "`[[no]]` x", "```", "````", "## H [[h]] x", "# T", "# H #", "#", "# ", "#tag", "### é x ", "###  two", "- item [[i]]", "- [ ] task [[j]]", "- [x] done", "- [ ]", "- [ ] # h", "- # h", "---", "===", "| a | b |", "| --- | --- |", "  in", "> q", "> [!N] q\n> r", "1. n", "a *b* c", "snake_case_x", "__x__", "<b>", "[d]: /e", "é ü", " # in"]
    taken, narrow = 0, ("links", "headings", "emphasis", "leads", "opens")
    for _ in range(6000):
        content = draw.choice(["", "---\na_b: 1\n---\n"]) + "\n".join(draw.choice(pieces) for _ in range(draw.randint(1, 7)))
        if (plain := markdown.plain_parts(content)) is not None:
            taken += 1
            read = markdown.structure(content, parts=("links", "headings", "nodes", "inlines"))
            links = [{"target": x["target"], "alias": x["alias"], "line": x["start_line"], "embed": x["embed"]} for x in read.inlines if x["type"] == "Wikilink"]
            opens = bool(read.headings) and all(n["span"]["start"] > read.headings[0]["span"]["start"] for n in read.nodes if n["depth"] == 0)
            assert (plain["links"], plain["headings"], plain["opens"]) == (links, read.headings, opens), content
            assert not [x for x in read.inlines if x["type"] in ("Emph", "Strong")] and not [n for n in read.nodes if n["type"] == "BlockQuote"], content
    assert taken > 500 and notes.structure_of("> [!N] q\n> r\n\n*e*\n", narrow)["leads"][0]["end_line"] == 2


def test_rendered_notes_are_plain_for_lint(spark):
    for kind in ("ticket", "track", "card", "reference"):
        assert all(markdown.plain_parts(r.content) is not None for r in synth.vault(spark, SF, kind).limit(200).collect())


def test_rules_find_the_same_in_narrow_parts(spark):
    from notewell.operators import lint

    bodies = ["# a\n\ntext\n", "x\n\n# a\n", "> [!N] q\n> r\n", "- > [!N] q\n  > r\n\nsee a/*.b and c/*.d, __x__ **y**\n", "# b\n- [ ] t [[a]]\n", "A | B\n===\n"]
    files = spark.createDataFrame([(f"{i}/a.md", f"---\ntype: note\n---\n{b}") for i, b in enumerate(bodies)], "rel string, content string")
    wide, narrow = (sorted(map(tuple, lint.findings(lint.Vault(notes.parse(files, *parts))).collect())) for parts in (lint.PARTS, lint.NARROW))
    assert wide == narrow and {"duplicate-h1", "callout-missing-separator", "unintended-emphasis"} <= {r[0] for r in narrow}


def test_all_keys_of_plain_frontmatter_are_made_alike():
    plain = '---\ntype: ticket\ntags: [a, "b c"]\ncost: 1.50\nstatus:\nproject: "[[p]]"\nrequires:\n  - "[[x]]"\n  - "[[y]]"\n---\nbody\n'
    odd = ("---\ncost: 1\ncost: 2\n---\n", "---\nrelated: [[card-1]]\n---\n", "---\ncost: [a\n---\n", "---\n'a b': 1\n---\n", "no front", "---\nb: {x: 1}\na: 'q'\n---\n", "---\n- a\n---\n", "---\na: b # c\n---\n", "---\na:\n  b: 1\n---\n")
    assert list(yaml12.picked(plain[4 : plain.index("\n---\n", 3)], None)) == ["cost", "project", "requires", "status", "tags", "type"]
    for content in (plain, *odd):
        # A part besides takes the long way.
        short, long = notes.front_of(content, ("unquoted",)), notes.front_of(content, ("unquoted", "fields"))
        assert short == {k: v for k, v in long.items() if k != "fields"}, content
