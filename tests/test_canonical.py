"""Canonical notes: what is written is read back, and what a hand has changed is read as far as it goes."""

from notewell.operators import canonical
from pyspark.sql import functions as F

NOTE = """---
type: distillation
source: { path: a/b.md, bytes: 7, sha256: abc }
schema: 1
---

# Title

## Abstract

About
it.

## Concepts

### Old house

A house [3..9]

- with walls 10..12
- and no place

### Empty

- only a bullet

### Next

said without a place

## Judgements

- (hypothesis) it may stand 1..2
- (perhaps) it falls
no item

## Procedures

### Build

1. dig 5..6
2. lay

### Nothing

no step

## Payload

### code

```
## Concepts
### fake
```

7..8

### said

> verbatim 9..10

## Notes

- not read

## Relations

- old house — part-of → next 11..12
- next — refines → lost
"""


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_notes_are_read_by_section(spark):
    heads, units, edges = canonical.read(spark.createDataFrame([(1, NOTE), (2, "# Only\n"), (3, "")], "k int, text string"), "k")
    assert sorted(rows(heads, "k", "path", "bytes", "sha256", "title", "abstract")) == [(1, "a/b.md", 7, "abc", "Title", "About\nit."), (2, None, None, None, "Only", None), (3, None, None, None, None, None)]
    span = lambda c: F.concat_ws("..", f"{c}.start", f"{c}.end")
    got = rows(units.orderBy("ord"), "id", "type", "statement", span("span"), "modality", F.transform("sub_spans", lambda s: s["start"]).alias("subs"))
    assert got == [
        ("Old house", "concept", "A house\nwith walls\nand no place", "3..9", None, [10, None]), ("Next", "concept", "said without a place", "", None, []),
        ("J1", "judgment", "it may stand", "1..2", "hypothesis", []), ("J2", "judgment", "(perhaps) it falls", "", None, []),
        ("Build", "procedure", "dig\nlay", "5..6", None, [None]), ("code", "payload", "## Concepts\n### fake", "7..8", None, []), ("said", "payload", "verbatim", "9..10", None, []),
    ]
    assert rows(edges.orderBy("ord"), "from_id", "rel", "to_id", span("span")) == [("Old house", "part-of", "Next", "11..12"), ("Next", "refines", None, "")]


def test_what_was_read_is_written_again(spark):
    docs = spark.createDataFrame([(1, NOTE)], "k int, text string")
    heads, units, edges = canonical.read(docs, "k")
    text = canonical.write(heads, units, edges, "k").first().text
    again = canonical.read(spark.createDataFrame([(1, text)], "k int, text string"), "k")
    assert rows(again[1].orderBy("ord"), *again[1].columns) == rows(units.orderBy("ord"), *units.columns)
    assert rows(again[2], "from_id", "rel", "to_id") == [("Old house", "part-of", "Next")]
    assert "## Abstract\n\nAbout\nit.\n\n## Concepts\n\n### Old house\n\nA house 3..9\n\n- with walls 10..12\n- and no place\n" in text
    assert text.endswith("## Relations\n\n- old house — part-of → next 11..12\n") and "## Relations" not in canonical.write(heads, units, edges, "k", relations=False).first().text
    assert rows(canonical.problems(units, edges, "k"), "ord", "error") == [(1, "to names no unit")]


def test_titles_come_from_paths(spark):
    notes = spark.createDataFrame([(1, "x/old-house_plan.md", 3, "s", None, " "), (2, "-", 0, "s", None, None)], "k int, path string, bytes long, sha256 string, title string, abstract string")
    units = spark.createDataFrame([], f"k int, ord int, id string, type string, statement string, span {canonical.SPAN}, modality string, sub_spans array<{canonical.SPAN}>")
    edges = spark.createDataFrame([], f"k int, ord int, from_id string, rel string, to_id string, span {canonical.SPAN}")
    got = {r.k: r.text.split("\n\n", 1)[1] for r in canonical.write(notes, units, edges, "k").collect()}
    assert got == {1: "# Old house plan\n", 2: "# -\n"}
