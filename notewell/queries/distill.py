"""Comparisons of texts and names, and measures of runs, over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell.operators import distill as D


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def multiset_diff(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    return D.tally(lines.where("l_linestatus = 'O'").select("l_partkey"), lines.where("l_linestatus = 'F'").select("l_partkey"), ["l_partkey"])


def payload_residue(spark, sf_dir):
    lines = _table(spark, sf_dir, "lineitem")
    return D.residue(lines.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey"), lines.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey"), ["l_partkey", "l_suppkey"])


def lev_pairs(spark, sf_dir):
    names = _table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" "), F.regexp_replace("p_brand", "#", "")).alias("name")).distinct()
    return D.near_pairs(names)


def fuzzy_names(spark, sf_dir):
    customers = _table(spark, sf_dir, "customer").select(F.regexp_replace("c_name", "Customer#0000", "Cust0mer ").alias("name"))
    known = _table(spark, sf_dir, "supplier").select(F.regexp_replace("s_name", "Supplier#0000", "Customer ").alias("name"), F.col("s_suppkey").alias("ord"))
    return D.near_names(customers, known)


def snap_overlap(spark, sf_dir):
    """Quotes name a brand as a block does, with another word, or nothing that a block has; blocks are the brands."""
    parts, k = _table(spark, sf_dir, "part"), F.col("p_partkey")
    brand = F.regexp_replace("p_brand", "#", "")
    quote = F.when(k % 7 == 0, F.concat(F.lit("nowhere "), "p_partkey")).when(k % 11 == 0, F.lit(" -- ")).when(k % 2 == 0, F.concat(F.lit("of  [["), F.upper(brand), F.lit("]]"))).otherwise(F.concat(F.lit("missing here, "), brand))
    blocks = parts.groupBy("p_brand").agg(F.min("p_partkey").alias("n")).select("n", F.concat(F.lit("All of "), F.regexp_replace("p_brand", "#", ""), F.lit(" here")).alias("block"))
    return D.snap(parts.select(k.alias("quote_id"), quote.alias("quote")), blocks).select("quote_id", "n", "how", F.round("score", 6).alias("score"), "error")


def word_caps(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[^a-zA-Z. \n]", "").alias("t"))
    return D.word_caps(docs, "doc_id", "t").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("words").alias("longest"))


def bench_stats(spark, sf_dir):
    return D.run_stats(_table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_discount")


def trigger_rate(spark, sf_dir):
    return D.trigger_rate(_table(spark, sf_dir, "labels").withColumn("fired", F.col("quality") == 1).withColumn("g", F.col("doc_id") % 7), "g", "fired").select("g", F.round("rate", 9).alias("rate"), "passes")


def stratified_split(spark, sf_dir):
    return D.stratified_split(_table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 0.25, 42)


def block_counts(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("t"))
    return D.blocks(docs, "doc_id", "t").groupBy("doc_id").agg(F.count("*").alias("n"))


def located_spans(spark, sf_dir):
    parts = _table(spark, sf_dir, "part")
    text = F.concat(F.lit("é "), "p_name", F.lit(" stands once"))
    span = D.locate(text, F.col("p_name"))
    return parts.select("p_partkey", span["start"].alias("start"), span["end"].alias("end"), D.locate(F.lit("ab ab"), F.lit("ab"))["start"].alias("twice"))


QUERIES = {f.__name__: f for f in (multiset_diff, payload_residue, lev_pairs, fuzzy_names, snap_overlap, word_caps, bench_stats, trigger_rate, stratified_split, block_counts, located_spans)}
SQL = {
    "multiset_diff": """with a as (select l_partkey, count(*) filter (where l_linestatus = 'O') as x, count(*) filter (where l_linestatus = 'F') as y from lineitem group by l_partkey)
      select l_partkey, greatest(0, x - y) as dropped, greatest(0, y - x) as invented from a where x <> y""",
    "payload_residue": "select distinct l_partkey, l_suppkey from lineitem r where l_returnflag = 'R' and not exists (select 1 from lineitem a where a.l_returnflag = 'A' and a.l_partkey = r.l_partkey and a.l_suppkey = r.l_suppkey)",
    "lev_pairs": """with n as (select distinct p_name || ' ' || replace(p_brand, '#', '') as name from part), p as (select x.name as a, y.name as b, levenshtein(x.name, y.name) as distance from n x join n y on x.name < y.name)
      select a, b, distance from p where distance <= least(3, greatest(length(a), length(b)) // 3)""",
    "fuzzy_names": """with c as (select distinct replace(c_name, 'Customer#0000', 'Cust0mer ') as name from customer), s as (select replace(s_name, 'Supplier#0000', 'Customer ') as match, s_suppkey as ord from supplier),
      p as (select name, match, ord, levenshtein(name, match) as distance from c, s), q as (select *, row_number() over (partition by name order by distance, ord) as r from p where distance <= least(3, greatest(length(name), length(match)) // 3))
      select name, match, distance from q where r = 1""",
    "snap_overlap": """with x as (select p_partkey as k, n from part join (select p_brand, min(p_partkey) as n from part group by p_brand) b using (p_brand))
      select k as quote_id, case when k % 7 <> 0 and k % 11 <> 0 then n end as n, case when k % 7 <> 0 and k % 11 <> 0 then case when k % 2 = 0 then 'contains' else 'overlap' end end as how,
        case when k % 7 <> 0 and k % 11 <> 0 then case when k % 2 = 0 then 1.0 else round(2 / 3.0, 6) end end::double as score, case when k % 7 = 0 then 'no block shares a word' when k % 11 = 0 then 'no words' end as error from x""",
    "word_caps": """with t as (select doc_id, unnest(string_split(regexp_replace(regexp_replace(text, '[^a-zA-Z. \\n]', '', 'g'), '([.])\\s+', '\\1' || chr(1), 'g'), chr(1))) as s from documents),
      w as (select doc_id, len(regexp_extract_all(s, '\\S+')) as words from t) select doc_id, count(*) as n, max(words)::bigint as longest from w where words > 20 group by doc_id""",
    "bench_stats": """with m as (select l_returnflag, unnest(['l_quantity', 'l_discount']) as measure, unnest([l_quantity, l_discount]) as x from lineitem)
      select l_returnflag, measure, round(avg(x), 4) as mean, round(coalesce(stddev_samp(x), 0), 4) as stddev, round(min(x), 4) as min, round(max(x), 4) as max from m group by all""",
    "trigger_rate": "select doc_id % 7 as g, round(avg((quality = 1)::int), 9) as rate, avg((quality = 1)::int) >= 0.5 as passes from labels group by 1",
    "stratified_split": """with r as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by md5('42:' || c_custkey), c_custkey) as r, count(*) over (partition by c_mktsegment) as n from customer)
      select c_custkey, c_mktsegment, r <= greatest(1, floor(n * 0.25)) as held_out from r""",
    "block_counts": "select doc_id, count(*) as n from (select doc_id, unnest(string_split(text, chr(10))) as l from documents) where trim(l, ' ' || chr(9) || chr(13)) <> '' group by doc_id",
    "located_spans": "select p_partkey, 3 as start, 3 + length(p_name) as \"end\", null::int as twice from part",
}
