"""Guards, relations in both grammars, backstops, choices, prechecks and deltas on small rows."""

import pytest
from notewell.functions import payload
from notewell.operators import decisions, distill, lint, review
from notewell.operators import notes as N
from notewell.plans import base as B
from pyspark.sql import functions as F

CODE = "```\na = 1\n```\n"


@pytest.mark.parametrize(("before", "after", "fails"), [
    (CODE + "Text `x`.", CODE + "Text y.", set()), (CODE, CODE.replace("1", "2"), {"code"}), (CODE + CODE, CODE, {"code"}), ("~~~\n```\n~~~\n", "~~~\n```\n~~~\n\nmore", set()), ("```\nopen", "```\nopen", set()), ("```\nopen", "open", {"code"}),
    ("1. a\n2. b", "- a\n- b\n- c", {"lists"}), ("- a", "- a\n- b\n1. c", set()), ("- a\n- b", "- a", set()), ("- - -\n", "***\n", set()), ("```\n- in code\n```", "```\n- in code\n```", set()), ("⟦0⟧ and ⟦0⟧", "⟦0⟧", {"masks"}),
    ("anna came", "Then came Anna.", {"names"}), ("short", "word " * 25, {"words"}),
])
def test_guard_axes(spark, before, after, fails):
    row = review.guard(spark.createDataFrame([(1, before, after)], "k int, before string, after string"), "k").first().asDict()
    assert {axis for axis in ("masks", "code", "names", "words", "lists") if not row[axis]} == fails and row["ok"] == (not fails)


def test_forms_for_containment_agree(spark):
    texts = ["A **bold** [link](u) | #tag ~x~ - y!", "  a_b\n\n(c) > d", "“Curly” — é", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", review.containment("t").alias("n"))
    assert {r.t: r.n for r in rows.collect()} == {t: payload.for_containment(t) for t in texts}
    assert payload.for_containment(texts[0]) == "a bold link u tag x y"


def test_items_with_letters_and_headings():
    found = payload.list_items("# Title\n- not below a section\n## One\n- A bullet that says something\n  and goes on\nB2) another item that says so\nЖ. третий пункт говорит о том\ne.g. no item at all here\n### Two\n```\n- code is no item at all\n```\n1) numbered item that says it\n")
    assert [(h, d, i) for h, d, i, _ in found] == [("One", 2, "A bullet that says something and goes on"), ("One", 2, "another item that says so"), ("One", 2, "третий пункт говорит о том"), ("Two", 3, "numbered item that says it")]


def test_relations_in_both_grammars(spark):
    text = "## Relations\n\n- Old house part-of:: Town (of old) [3..9]\n- old house — rests on → [[Ground|the ground]] 4..8\n- a — b\n- → c\n* x refines:: \n1. y subsumes:: z\n\n## Other\n\n- p q:: r\n"
    rows = lint.relations(N.parse(spark.createDataFrame([("n.md", text)], "rel string, content string"), "headings"))
    assert sorted(map(tuple, rows.select("line", "from_label", "rel_token", "endpoint_kind", "endpoint", "predicate").collect())) == [
        (3, "Old house", "part-of", "local", "Town", "of old"), (4, "old house", "rests-on", "file", "Ground", None), (8, "y", "subsumes", "local", "z", None),
    ]


def test_backstop_sees_what_was_lost(spark):
    notes = spark.createDataFrame([("a", "See [[x]] and [[y|why]].\n\n> said\n\n12 %\n"), ("b", "[[z]]")], "rel string, body string")
    after = spark.createDataFrame([("a", "See [[y]]. 12% and 13\n\n> said")], "rel string, text string")
    assert sorted((r.rel, r.lane, r.item) for r in review.backstop(notes, after).collect()) == [("a", "wikilink", "x"), ("b", "wikilink", "z")]


def test_residue_becomes_choices(spark):
    rows = [("n.md", 1, "edge", "b\nc", "dropped", None), ("n.md", 0, "def", "t`x`", "gate-inconclusive", None), ("n.md", 2, "steps", "", "dropped", [0]), ("n.md", 3, "steps", "All", "dropped", [])]
    left = spark.createDataFrame(rows, "rel string, ord int, kind string, label string, reason string, steps array<int>")
    blocks = review.residue_blocks(left, "rel").withColumnRenamed("text", "content")
    notes = N.parse(blocks, "regions", "dangling")
    assert decisions.errors(notes, ("keep", "recover")).count() == 0 and decisions.fired(notes, ("keep", "recover")).count() == 0
    assert [(r.verb, r.target) for r in decisions.items(notes).orderBy("line").collect()] == [("keep", "`tx` — gate-inconclusive"), ("recover", "b c — dropped"), ("recover", "procedure:(no label):1 — dropped"), ("recover", "procedure:All — dropped")]


VIEW = """
filters:
  and:
    - type == "ticket"
    - status == "open"
views:
  - type: table
    name: Open
    order:
      - file.name
"""


def test_a_view_fails_if_an_argument_names_nothing(spark):
    files = [("t/1.md", "---\ntype: ticket\nstatus: done\ntrack: one\n---\n"), ("t/2.md", "---\ntype: ticket\nstatus: open\ntrack: two\n---\n")]
    notes = N.parse(spark.createDataFrame(files, "rel string, content string"))
    base, track = B.parse(VIEW), F.col("fm")["track"]["display"]
    ask = lambda name: B.render_checked(base, "Open", notes, {f"no track {name!r}": track == name}, track == name)
    # All of a track's tickets may be done, which is no error; a track that no ticket has is one.
    assert "| 2 |" in ask("two") and ask("one") == ""
    with pytest.raises(B.PrecheckError, match="no track 'three'"):
        ask("three")
    check = B.Precheck({"none": F.lit(False)})
    rows = B.run(base, "Open", check.over(notes))
    rows.collect()
    assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    with pytest.raises(B.PrecheckError):
        check.verify()


def test_deltas_of_two_configurations(spark):
    runs = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), ("b", 5.0, None), ("c", 100.0, 1.0)], "conf string, x double, y double")
    assert {tuple(r) for r in distill.run_deltas(runs, "conf", "a", "b", "x", "y").collect()} == {("x", 2.0, 5.0, 3.0), ("y", 2.0, None, None)}
