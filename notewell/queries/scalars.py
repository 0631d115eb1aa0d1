"""Scalar functions over documents and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from notewell.functions import text


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokens_estimate(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.tokens(F.col("text")).alias("tokens"))


def sha_bytes(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").alias("n_bytes"))


def endings_lf(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(text.endings_lf(F.regexp_replace("text", "\n", "\r\n"))).alias("digest"))


def lang_detect(spark, sf_dir):
    """Every third text with its small Latin letters as Cyrillic ones."""
    cyrillic = F.translate("text", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщ")
    return _docs(spark, sf_dir).select("doc_id", text.language(F.when(F.col("doc_id") % 3 == 0, cyrillic).otherwise(F.col("text"))).alias("lang"))


def word_counts(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text.word_count(F.col("text")).alias("words"))


def slugs(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    label = F.concat(F.lit("**"), "p_name", F.lit("** [[a/b/Q "), "p_partkey", F.lit(".md#x]] & `C` / "), "p_brand")
    return parts.select("p_partkey", text.slug_segment(label).alias("slug"), text.slug_path(F.concat(F.lit("41 Projects/"), "p_brand")).alias("path"))


def link_keys(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    target = F.concat(F.lit("Folder/“"), F.initcap("p_name"), F.lit("”.md#"), "p_brand")
    return parts.select("p_partkey", text.link_key(target).alias("link_key"), text.strip_links(F.concat(F.lit("x [["), target, F.lit("]] [[y|Z]]"))).alias("shown"))


def truthiness(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    value = F.when(F.col("l_linenumber") % 5 == 0, "").when(F.col("l_linenumber") % 5 == 1, " false ").when(F.col("l_linenumber") % 5 == 2, "0").when(F.col("l_linenumber") % 5 == 3, "0.0").otherwise(F.lit(None).cast("string"))
    return lines.groupBy(text.truthy(value).alias("truthy")).agg(F.count("*").alias("n"))


def numbers(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    value = F.when(k % 4 == 0, F.concat(F.lit(" "), k.cast("string"))).when(k % 4 == 1, F.concat(k.cast("string"), F.lit("d"))).when(k % 4 == 2, F.concat(k.cast("string"), F.lit(".50"))).otherwise(F.concat(F.lit("-"), k.cast("string"), F.lit("e2")))
    return orders.select("o_orderkey", text.format_number(text.number(value)).alias("shown"))


def byte_slices(spark, sf_dir):
    both = F.concat(F.lit("éa"), "lang")
    return _docs(spark, sf_dir).select("doc_id", text.byte_slice(both, F.lit(0), F.lit(3)).alias("head"), text.byte_slice(both, F.lit(3), F.lit(5)).alias("tail"))


QUERIES = {f.__name__: f for f in (tokens_estimate, sha_bytes, endings_lf, lang_detect, word_counts, slugs, link_keys, truthiness, numbers, byte_slices)}
SQL = {
    "tokens_estimate": "select doc_id, (length(text) // 4)::int as tokens from documents",
    "sha_bytes": "select doc_id, sha256(text) as sha, octet_length(encode(text))::int as n_bytes from documents",
    "endings_lf": "select doc_id, md5(text) as digest from documents",
    "lang_detect": r"select doc_id, case when doc_id % 3 = 0 and length(regexp_replace(text, '[^a-z]', '', 'g')) > 0.3 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) then 'ru' else 'en' end as lang from documents",
    "word_counts": "select doc_id, len(regexp_extract_all(text, '\\S+'))::bigint as words from documents",
    "slugs": "select p_partkey, replace(p_name, ' ', '-') || '-q-' || p_partkey || '-c-' || lower(replace(p_brand, '#', '-')) as slug, '41-projects/' || lower(replace(p_brand, '#', '-')) as path from part",
    "link_keys": "select p_partkey, '\"' || p_name || '\"' as link_key, 'x “' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || '” Z' as shown from part",
    "truthiness": "select l_linenumber % 5 = 3 as truthy, count(*) as n from lineitem group by 1",
    "numbers": "select o_orderkey, case o_orderkey % 4 when 2 then o_orderkey || '.5' when 3 then '-' || o_orderkey * 100 end as shown from orders",
    "byte_slices": "select doc_id, 'éa' as head, lang as tail from documents",
}
