"""The queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, embedding_dedup, jaccard_join, license_scan, line_templates, multi_index, quality_rules, ranked_search, source_mix, token_alignment, token_counts, token_files, warc

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("NOTEWELL_TOKENIZERS", os.path.dirname(public_tokenizers.path("x")))


def _vocabulary(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def encode_documents(docs: DataFrame) -> DataFrame:
    return byte_bpe.round_trip(docs, _vocabulary("byte_bpe_50k.tiktoken"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(_table(spark, sf_dir, "documents"))


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(_table(spark, sf_dir, "embeddings"), queries_divide=20)


def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.query(_table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.query(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"), limit=4096)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.through_files(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), end_id=2)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.through_archives(_table(spark, sf_dir, "pages"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.links(_table(spark, sf_dir, "embeddings"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.summaries(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"), _vocabulary("piece_bpe_32k.model"))


QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_multi_index": op3_multi_index,
    "op5_line_templates": op5_line_templates,
    "op4_source_mix": op4_source_mix,
    "op6_license_scan": op6_license_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_token_counts": op8_token_counts,
    "op9_token_files": op9_token_files,
    "op10_warc": op10_warc,
    "op11_ranked_search": op11_ranked_search,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_token_alignment": op13_token_alignment,
}

SQL: dict[str, str] = {"op1_jaccard_join": jaccard_join.SQL, "op5_line_templates": line_templates.SQL, "op10_warc": warc.SQL, "op11_ranked_search": ranked_search.SQL, "op12_embedding_dedup": embedding_dedup.SQL}
