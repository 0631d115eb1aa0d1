"""Canonical notes made of the parts, written and read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewell.operators import canonical as G
from notewell.operators import review as V


def _k():
    return F.col("p_partkey")


def _span(a: int, b):
    return F.struct(F.lit(a).cast("bigint").alias("start"), b.cast("bigint").alias("end"))


def graph(spark, sf_dir):
    """(notes, units, edges): a note a part with a unit of each kind; some lines have no place, some judgements no mark."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(_k().alias("k"), "p_name", "p_type")
    name, n = F.col("p_name"), F.length("p_name")
    none = F.lit(None).cast(G.SPAN)
    made = [
        ("concept", F.concat(F.lit("Alpha "), "k"), F.concat(name, F.lit(" is a part\nit has a name\nand a type")), _span(0, n), None, F.array(_span(3, n + 9), none)),
        ("concept", F.lit("Beta"), F.lit("what stands for itself"), F.when(F.col("k") % 2 == 0, _span(5, n)), None, F.array().cast(f"array<{G.SPAN}>")),
        ("judgment", F.lit("J1"), F.concat(name, F.lit(" sells 1..2 times")), _span(1, n), F.when(F.col("k") % 3 == 0, "hypothesis").when(F.col("k") % 3 == 1, "necessarily"), F.array().cast(f"array<{G.SPAN}>")),
        ("inference", F.lit("I1"), F.concat(F.lit("so "), name), _span(2, n), None, F.array().cast(f"array<{G.SPAN}>")),
        ("procedure", F.lit("Make it"), F.concat(F.lit("take "), "p_type", F.lit("\nname it\nsell it")), _span(4, n), None, F.array(none, _span(8, n))),
        ("payload", F.lit("code"), F.concat(F.lit("## not a section\n``` "), name, F.lit("\n### not one either")), _span(6, n), None, F.array().cast(f"array<{G.SPAN}>")),
        ("payload", F.lit("quote"), name, _span(7, n), None, F.array().cast(f"array<{G.SPAN}>")),
    ]
    units = [parts.select("k", F.lit(i).alias("ord"), id_.alias("id"), F.lit(kind).alias("type"), said.alias("statement"), span.alias("span"), (F.lit(None).cast("string") if mark is None else mark).alias("modality"), subs.alias("sub_spans")) for i, (kind, id_, said, span, mark, subs) in enumerate(made)]
    alpha = F.concat(F.lit("Alpha "), "k")
    edges = [parts.select("k", F.lit(i).alias("ord"), a.alias("from_id"), F.lit(rel).alias("rel"), b.alias("to_id"), _span(9, n).alias("span")) for i, (a, rel, b) in enumerate([(F.lit("Beta"), "part-of", alpha), (alpha, "refines", F.lit("Make it")), (alpha, "refines", F.lit("Nowhere"))])]
    notes = parts.select("k", F.concat(F.lit("in/"), "k", F.lit("-note.md")).alias("path"), n.cast("bigint").alias("bytes"), F.substring(F.sha2(name, 256), 1, 12).alias("sha256"), F.when(F.col("k") % 5 != 0, name).alias("title"), F.when(F.col("k") % 4 != 0, F.concat(F.lit("About "), name, F.lit(".\n\nAnd more."))).alias("abstract"))
    return notes, reduce(DataFrame.unionByName, units), reduce(DataFrame.unionByName, edges)


def canonical_units(spark, sf_dir):
    """The units that are read back from written notes."""
    _, units, _ = G.read(G.write(*graph(spark, sf_dir), "k"), "k")
    places = F.array_join(F.transform("sub_spans", lambda s: F.coalesce(V.span_text(s), F.lit("-"))), " ")
    return units.select("k", "ord", "id", "type", "statement", V.span_text(F.col("span")).alias("place"), "modality", places.alias("places"))


def canonical_heads(spark, sf_dir):
    """What is read back of the notes themselves, and how many edges."""
    heads, _, edges = G.read(G.write(*graph(spark, sf_dir), "k"), "k")
    said = edges.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "ord", "from_id", "rel", "to_id", V.span_text(F.col("span"))))), "; ").alias("edges"))
    return heads.join(said, "k", "left")


def canonical_problems(spark, sf_dir):
    _, units, edges = graph(spark, sf_dir)
    return G.problems(units, edges, "k").groupBy("ord", "error").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (canonical_units, canonical_heads, canonical_problems)}
SQL = {
    "canonical_units": """with p as (select p_partkey as k, p_name as name, p_type as type, length(p_name) as n, chr(10) as e from part), x as (select k, unnest([
        {ord: 0, id: 'Alpha ' || k, type: 'concept', statement: name || ' is a part' || e || 'it has a name' || e || 'and a type', place: '0..' || n, modality: null, places: '3..' || n + 9 || ' -'},
        {ord: 1, id: 'Beta', type: 'concept', statement: 'what stands for itself', place: case when k % 2 = 0 then '5..' || n end, modality: null, places: ''},
        {ord: 2, id: 'J1', type: 'judgment', statement: name || ' sells 1..2 times', place: '1..' || n, modality: case k % 3 when 0 then 'hypothesis' when 1 then 'necessarily' end, places: ''},
        {ord: 3, id: 'I1', type: 'inference', statement: 'so ' || name, place: '2..' || n, modality: null, places: ''},
        {ord: 4, id: 'Make it', type: 'procedure', statement: 'take ' || type || e || 'name it' || e || 'sell it', place: '4..' || n, modality: null, places: '- 8..' || n},
        {ord: 5, id: 'code', type: 'payload', statement: '## not a section' || e || '``` ' || name || e || '### not one either', place: '6..' || n, modality: null, places: ''},
        {ord: 6, id: 'quote', type: 'payload', statement: name, place: '7..' || n, modality: null, places: ''}]) as u from p)
      select k, u.ord::int as ord, u.id, u.type, u.statement, u.place::text as place, u.modality::text as modality, u.places from x""",
    "canonical_heads": """select p_partkey as k, 'in/' || p_partkey || '-note.md' as path, length(p_name)::bigint as bytes, sha256(p_name)[1:12] as sha256, case when p_partkey % 5 <> 0 then p_name else p_partkey || ' note' end as title,
        case when p_partkey % 4 <> 0 then 'About ' || p_name || '.' || chr(10) || chr(10) || 'And more.' end as abstract,
        '0 Beta part-of Alpha ' || p_partkey || ' 9..' || length(p_name) || '; 1 Alpha ' || p_partkey || ' refines Make it 9..' || length(p_name) as edges from part""",
    "canonical_problems": "select 2 as ord, 'to names no unit' as error, count(*) as n from part",
}
