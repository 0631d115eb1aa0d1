"""Notes that arrive: a folder as a stream, and windows over events.  Extensions: batch queries need none of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_notes(spark: SparkSession, root: str, files_a_batch: int = 1000) -> DataFrame:
    """(rel, content, modified) of files as they appear below ``root``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_a_batch).load(root)
    tail = root.split("://")[-1].rstrip("/")
    rel = F.substr(F.col("path"), F.instr("path", tail) + F.lit(len(tail) + 1))
    return rows.where(F.is_valid_utf8("content")).select(rel.alias("rel"), F.decode("content", "utf-8").alias("content"), F.col("modificationTime").alias("modified"))


def keep_parsed(notes: DataFrame, target: str, checkpoint: str, *parts: str) -> StreamingQuery:
    """Parses each batch of notes once and adds it to the table at ``target``; readers take the latest row of a path."""
    from notewell.operators.notes import parse

    def add(batch: DataFrame, number: int) -> None:
        parsed = parse(batch, *parts).drop("fm").withColumn("batch", F.lit(number))
        parsed.write.mode("append").partitionBy("batch").parquet(target)

    return notes.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame) -> DataFrame:
    """The row of each path's last batch."""
    last = table.groupBy("rel").agg(F.max("batch").alias("batch"))
    return table.join(last, ["rel", "batch"], "left_semi")


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of tumbling windows; rows later than the watermark are left out of closed windows."""
    grouped = events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
