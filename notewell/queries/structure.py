"""Blocks within blocks, inlines within inlines, and checks that fail, over notes rendered from the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell.operators import notes as N
from notewell.operators import reading as R
from notewell.sources import synth


def _k():
    return F.col("p_partkey").cast("string")


def _notes(spark, sf_dir, content, *parts):
    rel = F.concat(F.lit("p/"), _k(), F.lit(".md"))
    return N.parse(synth.parts(spark, sf_dir).select(rel.alias("rel"), content.alias("content")), *parts)


def _is(n: int, then: str):
    return F.when(F.col("p_partkey") % n == 0, F.lit(then)).otherwise(F.lit(""))


def nested_blocks(spark, sf_dir):
    """Lists in quotes in lists in quotes, with lines that go on with them lazily, task items and code in an item."""
    lazy = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("lazy "), "p_name", F.lit("\n"))).otherwise(F.lit(""))
    content = F.concat(F.lit("# "), "p_name", F.lit("\n\n> - "), "p_name", F.lit("\n>   1. deep\n>      > inner "), _k(), F.lit("\n"), lazy, F.lit("\n- [x] done\n\n  ```py\n  code\n  ```\n"))
    nodes = N.part(_notes(spark, sf_dir, content, "nodes"), "nodes")
    return nodes.select("rel", "seq", "parent_seq", "depth", "type", F.col("span.start").alias("start"), F.col("span.end").alias("stop"), "start_line", "tight", "task", "info")


def nested_inlines(spark, sf_dir):
    """Emphasis in emphasis, within words and in links; links in images; what looks like a wikilink in code."""
    content = F.concat(F.lit("**bold *"), "p_name", F.lit("* [x *y*](u"), _k(), F.lit(")** a*b*c ![p [in](v)](w) _x_y_ `[[c]]` [[n#h|*a*]]\n"))
    inlines = N.part(_notes(spark, sf_dir, content, "inlines"), "inlines")
    return inlines.select("rel", "type", F.col("span.start").alias("start"), F.col("span.end").alias("stop"), "url", "target", "alias", "before", "after")


def structure_failures(spark, sf_dir):
    """Notes with a definition that no block claims, and notes whose text changed after they were read."""
    content = F.concat(F.lit("Intro [[card-"), _k(), F.lit("]] and **"), "p_name", F.lit("**.\n\n"), _is(4, "[label\nof two lines]: /u\n\n"), F.lit("[one]: /v\n\n```\ncode\n```\n"))
    notes = _notes(spark, sf_dir, content, "headings", "nodes", "inlines")
    stale = notes.withColumn("content", F.when(F.regexp_extract("rel", r"(\d+)", 1).cast("long") % 5 == 0, F.concat(F.lit("x"), "content")).otherwise(F.col("content")))
    return R.check_structure(stale).groupBy("check").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def table_cells(spark, sf_dir):
    """Rows and cells of tables, with bars that are escaped and cells that are missing or too many."""
    content = F.concat(F.lit("| a | b |\n|:--|--:|\n| "), "p_name", F.lit(r" | x\|"), _k(), F.lit(" |\n| one |\n| 1 | 2 | 3 |\n"), _is(3, "> quote\n"))
    notes = _notes(spark, sf_dir, content, "nodes")
    nodes = notes.select("rel", F.encode("content", "utf-8").alias("raw"), F.explode("nodes").alias("n")).where("n.type in ('TableCell', 'BlockQuote')").select("rel", "raw", "n.*")
    cut = F.decode(F.expr("substring(raw, int(span.start) + 1, int(span.end - span.start))"), "utf-8")
    return nodes.select("rel", "type", "start_line", cut.alias("cell"))


QUERIES = {f.__name__: f for f in (nested_blocks, nested_inlines, structure_failures, table_cells)}

#: l, n: bytes of the name and of the key.
P = "with p as (select 'p/' || p_partkey || '.md' as rel, p_partkey as k, p_name as name, strlen(p_name) as l, length(p_partkey::text) as n from part)"
SQL = {
    "nested_blocks": P + """, e as (select *, case when k % 2 = 0 then 3 * l + 42 + n else 2 * l + 36 + n end as stop, 2 * l + 9 as b, 2 * l + 21 as c from p),
      f as (select *, stop + 2 as d, (k % 2 = 0)::int as z from e),
      x as (select rel, unnest([
        {seq: 0, parent_seq: null, depth: 0, type: 'BlockQuote', start: l + 4, stop: stop, start_line: 3, tight: null, task: null, info: null}, {seq: 1, parent_seq: 0, depth: 1, type: 'List', start: l + 6, stop: stop, start_line: 3, tight: true, task: null, info: null},
        {seq: 2, parent_seq: 1, depth: 2, type: 'ListItem', start: l + 6, stop: stop, start_line: 3, tight: null, task: null, info: null}, {seq: 3, parent_seq: 2, depth: 3, type: 'Paragraph', start: l + 8, stop: 2 * l + 8, start_line: 3, tight: null, task: null, info: null},
        {seq: 4, parent_seq: 2, depth: 3, type: 'List', start: b + 4, stop: stop, start_line: 4, tight: true, task: null, info: null}, {seq: 5, parent_seq: 4, depth: 4, type: 'ListItem', start: b + 4, stop: stop, start_line: 4, tight: null, task: null, info: null},
        {seq: 6, parent_seq: 5, depth: 5, type: 'Paragraph', start: b + 7, stop: b + 11, start_line: 4, tight: null, task: null, info: null}, {seq: 7, parent_seq: 5, depth: 5, type: 'BlockQuote', start: c + 7, stop: stop, start_line: 5, tight: null, task: null, info: null},
        {seq: 8, parent_seq: 7, depth: 6, type: 'Paragraph', start: c + 9, stop: stop, start_line: 5, tight: null, task: null, info: null}, {seq: 9, parent_seq: null, depth: 0, type: 'List', start: d, stop: d + 32, start_line: z + 7, tight: false, task: null, info: null},
        {seq: 10, parent_seq: 9, depth: 1, type: 'ListItem', start: d, stop: d + 32, start_line: z + 7, tight: null, task: true, info: null}, {seq: 11, parent_seq: 10, depth: 2, type: 'Paragraph', start: d + 2, stop: d + 10, start_line: z + 7, tight: null, task: null, info: null},
        {seq: 12, parent_seq: 10, depth: 2, type: 'CodeBlock', start: d + 14, stop: d + 32, start_line: z + 9, tight: null, task: null, info: 'py'}]) as r from f)
      select rel, r.seq::int as seq, r.parent_seq::int as parent_seq, r.depth::int as depth, r.type, r.start::bigint as start, r.stop::bigint as stop, r.start_line::int as start_line, r.tight::boolean as tight, r.task::boolean as task, r.info::text as info from x""",
    "nested_inlines": P + """, m as (select *, l + n as m from p), x as (select rel, unnest([
        {type: 'Strong', start: 0, stop: m + 22, url: null, target: null, alias: null, before: null, after: ' '}, {type: 'Emph', start: 7, stop: l + 9, url: null, target: null, alias: null, before: ' ', after: ' '},
        {type: 'Link', start: l + 10, stop: m + 20, url: 'u' || k, target: null, alias: null, before: null, after: null}, {type: 'Emph', start: l + 13, stop: l + 16, url: null, target: null, alias: null, before: ' ', after: ']'},
        {type: 'Emph', start: m + 24, stop: m + 27, url: null, target: null, alias: null, before: 'a', after: 'c'}, {type: 'Image', start: m + 29, stop: m + 44, url: 'w', target: null, alias: null, before: null, after: null},
        {type: 'Link', start: m + 33, stop: m + 40, url: 'v', target: null, alias: null, before: null, after: null}, {type: 'Emph', start: m + 45, stop: m + 50, url: null, target: null, alias: null, before: ' ', after: ' '},
        {type: 'CodeSpan', start: m + 51, stop: m + 58, url: null, target: null, alias: null, before: null, after: null}, {type: 'Wikilink', start: m + 59, stop: m + 70, url: null, target: 'n#h', alias: '*a*', before: null, after: null}]) as r from m)
      select rel, r.type, r.start::bigint as start, r.stop::bigint as stop, r.url::text as url, r.target::text as target, r.alias::text as alias, r.before::text as before, r.after::text as after from x""",
    "structure_failures": """with p as (select p_partkey % 4 = 0 as gap, p_partkey % 5 = 0 as stale from part), s as (select 3 + gap::int as tops, 2 * stale::int as bad_inlines, case when stale then 3 + gap::int else 0 end as bad_gaps, gap::int as bad_known from p)
      select 'order' as "check", sum(tops - 1)::bigint as n, 0::bigint as bad from s union all select 'gap', sum(tops + 1)::bigint, sum(bad_gaps)::bigint from s union all select 'nesting', 0, 0 union all select 'known', sum(tops)::bigint, sum(bad_known)::bigint from s
      union all select 'body', count(*), 0 from s union all select 'inline', 2 * count(*), sum(bad_inlines)::bigint from s union all select 'inner', 0, 0""",
    "table_cells": P + r""", x as (select rel, k, unnest([{line: 1, cell: 'a'}, {line: 1, cell: 'b'}, {line: 3, cell: name}, {line: 3, cell: 'x\|' || k}, {line: 4, cell: 'one'}, {line: 5, cell: '1'}, {line: 5, cell: '2'}]) as r from p)
      select rel, 'TableCell' as type, r.line::int as start_line, r.cell::text as cell from x union all select rel, 'BlockQuote', 6, '> quote' from p where k % 3 = 0""",
}
