"""What texts carry, made of the parts: all lanes, both grammars of relations, what a rewrite loses, and its choices."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell.operators import decisions
from notewell.operators import distill as D
from notewell.operators import lint as L
from notewell.operators import notes as N
from notewell.operators import review as V


def _k():
    return F.col("p_partkey")


def _parts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet")


def _carrying():
    return F.concat(
        F.lit("See [site](https://x.y/"), _k(), F.lit(") and [page](some%20page.md#top) ![pic](img-"), _k(), F.lit(".png) $a + "), _k(), F.lit("$ [@ref"), _k(), F.lit("] 12 %, [[old card|it]].\n\n> quoted "), "p_name",
        F.lit("\n\n```py\ncode "), _k(), F.lit("\n```\n\n| a | x"), _k(), F.lit(" |\n|---|---|\n"),
    )


def lanes(spark, sf_dir):
    """A row for each thing that a text of each lane carries."""
    return D.harvest(_parts(spark, sf_dir).withColumn("t", _carrying()), "p_partkey", "t").select("p_partkey", "lane", "item")


def internal_edges(spark, sf_dir):
    """Links within the notes by the slug of what they name, an encoded path among them."""
    return V.edges(_parts(spark, sf_dir).withColumn("t", _carrying()), "p_partkey", "t").select("p_partkey", "slug", "target")


def backstop_residue(spark, sf_dir):
    """What notes lose that are put together again without a link, a quote or a number."""
    parts = _parts(spark, sf_dir).select(_k().cast("string").alias("rel"), _carrying().alias("body"), _k().alias("k"))
    k = F.col("k")
    text = F.when(k % 4 == 1, F.regexp_replace("body", r"\[\[old card\|it\]\]", "it")).when(k % 4 == 2, F.regexp_replace("body", "(?m)^> ", "")).when(k % 4 == 3, F.regexp_replace("body", "12 %", "some")).otherwise(F.col("body"))
    lost = V.backstop(parts, parts.where(k % 8 != 0).select("rel", text.alias("text")))
    return lost.groupBy("lane").agg(F.count("*").alias("n"))


def arrow_relations(spark, sf_dir):
    """Relations in both grammars, with places, predicates and files."""
    content = F.concat(F.lit("## Relations\n\n- old "), "p_name", F.lit(" — part of → New house (why) 3.."), _k(), F.lit("\n- A refines:: [[card-"), _k(), F.lit("|the card]]\n- no edge here\n"))
    notes = N.parse(_parts(spark, sf_dir).select(F.concat(_k(), F.lit(".md")).alias("rel"), content.alias("content")), "headings")
    return L.relations(notes)


def residue_items(spark, sf_dir):
    """The choices that a note's losses leave, read back from their block."""
    entries = [
        ("def", F.concat(F.lit("the `term` "), _k()), "dropped", []), ("steps", F.lit("Make it"), "gate-inconclusive", [1, 2]), ("thesis", F.lit("x"), "dropped", []),
        ("prose", F.concat(F.lit("a  long\n"), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(20))), "not anchored", []),
    ]
    made = [F.struct(F.lit(i).alias("ord"), F.lit(kind).alias("kind"), label.alias("label"), F.lit(reason).alias("reason"), F.array(*map(F.lit, steps)).cast("array<int>").alias("steps")) for i, (kind, label, reason, steps) in enumerate(entries)]
    rows = _parts(spark, sf_dir).select(_k().alias("k"), F.explode(F.array(*made)).alias("x")).select("k", "x.*")
    blocks = V.residue_blocks(rows, "k").select(F.concat("k", F.lit(".md")).alias("rel"), F.col("text").alias("content"))
    items = decisions.items(N.parse(blocks, "regions", "dangling"))
    return items.select("rel", "id", "line", "checked", "verb", F.substring_index("target", " — ", -1).alias("reason"), F.length("target").alias("size"))


def bench_deltas(spark, sf_dir):
    return D.run_deltas(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag", "A", "R", "l_quantity", "l_discount")


QUERIES = {f.__name__: f for f in (lanes, internal_edges, backstop_residue, arrow_relations, residue_items, bench_deltas)}
SQL = {
    "lanes": """select p_partkey, unnest(['external', 'internal', 'image', 'math', 'citation', 'wikilink', 'quote', 'fence', 'row', 'number']) as lane,
      unnest(['https://x.y/' || p_partkey, 'some page.md', 'img-' || p_partkey || '.png', 'a+' || p_partkey, '@ref' || p_partkey, 'old card', 'quoted ' || p_name, 'code ' || p_partkey, 'a|x' || p_partkey, '12%']) as item from part""",
    "internal_edges": "select p_partkey, unnest(['some-page', 'old-card']) as slug, unnest(['some page.md', 'old card']) as target from part",
    "backstop_residue": """with k as (select p_partkey as k from part), e as (select count(*) filter (where k % 8 = 0) as gone, count(*) filter (where k % 4 = 1) as a, count(*) filter (where k % 4 = 2) as b, count(*) filter (where k % 4 = 3) as c from k)
      select unnest(['external', 'internal', 'image', 'math', 'citation', 'wikilink', 'quote', 'fence', 'row', 'number']) as lane, unnest([gone, gone, gone, gone, gone, gone + a, gone + b, gone, gone, gone + c]) as n from e""",
    "arrow_relations": """select p_partkey || '.md' as rel, unnest([3, 4]) as line, unnest(['old ' || p_name, 'A']) as from_label, unnest(['part-of', 'refines']) as rel_token, unnest(['local', 'file']) as endpoint_kind, unnest(['New house', 'card-' || p_partkey]) as endpoint, unnest(['why', null]) as predicate from part""",
    "residue_items": """with l as (select p_partkey, 'a long ' || repeat(p_name || ' ', 20) as label from part), h as (select p_partkey, length(rtrim(label[1:80])) + 1 as h from l)
      select p_partkey || '.md' as rel, 'residue' as id, unnest([3, 4, 5, 6]) as line, false as checked, unnest(['recover', 'keep', 'recover', 'recover']) as verb, unnest(['dropped', 'gate-inconclusive', 'dropped', 'not anchored']) as reason,
        unnest([11 + length(p_partkey::text) + 10, 21 + 20, 6 + 10, h + 15])::int as size from h""",
    "bench_deltas": """with m as (select l_returnflag as f, unnest(['l_quantity', 'l_discount']) as measure, unnest([l_quantity, l_discount]) as x from lineitem), s as (select measure, round(avg(x) filter (where f = 'A'), 4) as base, round(avg(x) filter (where f = 'R'), 4) as other from m group by measure)
      select measure, base, other, round(other - base, 4) as delta from s""",
}
