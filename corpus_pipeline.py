"""A corpus pipeline over ``documents``: quality rules, line dedup, near-duplicate join, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result to the shared
folder and reads it again as the next one's input.  Every stage but the last returns the columns of documents, in their
order; other columns of its input are left out, so their names can't clash.  A stage on an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewell.llm import jaccard_join, line_templates, quality_rules, queries, source_mix
from notewell.llm.support import WORD, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the quality rules keep, each judged by itself.

    Null and empty texts fail; a null language has a reference of its own; a null doc_id doesn't matter; repeated rows
    are kept or not alike.
    """
    return quality_rules.kept_rows(docs.select(*COLUMNS))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across documents; those left without a word go.

    Lines of fewer than 8 characters stay, as do long lines that only two copies of each other share: the next stage
    finds such copies, and wouldn't find their fragments.  Null and empty texts go.  Rows that repeat a doc_id and a text lose the same lines; rows without doc_id are one
    document, the first.
    """
    rest = line_templates.dedup(docs.select(*COLUMNS), min_chars=8, keep_copies=True).where(F.col("text").rlike(WORD))
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest doc_id and, of its texts, text hash.

    A document is a doc_id with a text: rows that share only the doc_id are joined or not as others are.  Of rows
    that repeat both, the one with the smallest other columns stays.  Rows without doc_id stay, as do null and empty
    texts, one of each doc_id.
    """
    docs = docs.select(*COLUMNS)
    rows = jaccard_join.rows_of(docs).where("doc_id is not null")
    rows = rows.groupBy("root", F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.count("*").alias("_rows"))
    rows = written(rows, "document-components")
    first = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("_id", "_th", "_rows")).alias("x")).select("x.*")
    first = written(first.union(rows.where("root is null").select("_id", "_th", "_rows")), "kept-documents")
    kept = docs.join(first, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_th")))
    once = kept.where("_rows = 1").select(*COLUMNS)
    if first.where("_rows > 1").limit(1).count():
        # Where no row is repeated, texts needn't be shuffled for this.
        rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
        repeated = kept.where("_rows > 1").groupBy("_id", "_th").agg(F.min(F.struct(*rest, "text")).alias("x"))
        once = once.union(repeated.select(F.col("_id").alias("doc_id"), "x.*").select(*COLUMNS))
    return once.union(docs.where("doc_id is null").select(*COLUMNS))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    The mix counts words; at the ends of a run of blocks it takes part of a document, which is rounded here to the
    document or nothing.  A document without words that the mix can't count stays once.  Null sources are one source.
    Documents are told apart by doc_id, text and source, nulls among them; of rows that repeat all three, each is taken
    as often as the one that is taken most.
    """
    docs = docs.select(*COLUMNS)
    taken = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    mixed = source_mix.mix(docs).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_th"), F.col("source").alias("_source"), taken.alias("copies"))
    times = mixed.where("copies > 0").groupBy("_id", "_th", "_source").agg(F.max("copies").alias("copies"))
    same = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_th")) & docs["source"].eqNullSafe(F.col("_source"))
    return docs.join(times, same).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded bytes, a row for each copy of a document.

    Null texts are empty ones; null doc_ids stay.
    """
    return queries.encode_documents(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near duplicates", near_duplicates), ("source mix", mixture), ("token ids", token_ids)]

#: Token ids can't be expressed in SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
