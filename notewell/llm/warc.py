"""WARC archives: written with an index first, read back by sorted and coalesced byte ranges.

Payloads are compared by their SHA-256.  Of equal payloads of at least SHORTEST bytes the row with the smallest key
becomes a response record, the others revisit it; shorter payloads are always responses.  Each task writes one
archive of gzip members, one a record, and an index row for each: file, offset, length, URL and digest.  A reader
takes the index, not the archives: it selects records, sorts their ranges, joins neighbours into one read, and
parses only what it asked for.  Each attempt of a task writes archives of its own name, so that the index, which is
committed once a task, always speaks of the archives of the attempt that counts.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import Publisher, filesystem, fresh_path, written

#: Bytes from which equal payloads are stored once.
SHORTEST = 100
#: Two ranges no further apart are read as one, up to so many bytes.
GAP, LARGEST_READ = 64 << 10, 8 << 20
#: Bytes after which an archive ends.
LARGEST_ARCHIVE = 1 << 30
DATE = "2024-01-01T00:00:00Z"
LEVEL = 3

INDEX = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()),
    T.StructField("page_id", T.LongType()),
])


def classified(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes, refers_to) of each row.

    The first of each digest is found by a pre-aggregated minimum and joined back on the digest alone; adaptive
    execution splits a digest that a large part of the pages share.  A row without key is always a response.
    """
    data = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), data.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2("payload", 256))
    large = (F.col("payload_bytes") >= SHORTEST) & F.col("page_id").isNotNull()
    repeated = rows.where(large).select("page_id", "payload_digest").groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1")
    joined = rows.join(repeated.select("payload_digest", "first"), "payload_digest", "left")
    return joined.select("page_id", "url", "payload", "payload_digest", "payload_bytes", F.when(large & (F.col("page_id") != F.col("first")), F.col("first")).alias("refers_to"))


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(row: dict) -> bytes:
    revisit = row["refers_to"] is not None
    body = b"" if revisit else row["payload"]
    # A line break in a URL would end the header line; it is escaped as URLs are.
    url = row["url"].replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(row['page_id'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(row['refers_to'])}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the archives of classified rows below ``folder``; returns their index, a table in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt, n = TaskContext.get().partitionId(), uuid.uuid4().hex[:12], 0
        out = name = None
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                if out and out.size >= LARGEST_ARCHIVE:
                    out.close()
                    out = None
                if not out:
                    name, n = f"pages-{part:06d}-{n:06d}-{attempt}.warc.gz", n + 1
                    out = Publisher(folder, name)
                member = _member(_record(row))
                at = out.write(member)
                index.append({"file": name, "offset": at, "length": len(member), "url": row["url"], "payload_digest": row["payload_digest"], "record_type": "response" if row["refers_to"] is None else "revisit", "page_id": row["page_id"]})
            if index:
                yield pa.RecordBatch.from_pylist(index, pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64())]))
        if out:
            out.close()

    return written(rows.select("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to").mapInArrow(run, INDEX), "warc-index")


def ranges(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """Sorted (offset, length) spans as reads: begin, end, and the spans that each read covers."""
    begin = end = 0
    inside: list[int] = []
    for i, (offset, length) in enumerate(spans):
        if inside and (offset > end + GAP or offset + length - begin > LARGEST_READ):
            yield begin, end, inside
            inside = []
        if not inside:
            begin = end = offset
        inside.append(i)
        end = max(end, offset + length)
    if inside:
        yield begin, end, inside


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    record = zlib.decompress(member, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the selected index rows, from the archives.

    Rows are dealt by file and stretch of the file, and sorted by offset; the index says which bytes to read.  The
    digest of each response is computed anew from its payload and must be the one that its header names.
    """
    fields = [T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType())]
    schema = T.StructType(fields + [T.StructField("payload", T.BinaryType())] * with_payload)
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)

    def page(text: str | None) -> int | None:
        number = text[10:-1] if text else ""
        return int(number) if number else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        for batch in batches:
            rows = batch.to_pylist()
            for name in dict.fromkeys(r["file"] for r in rows):
                spans = sorted((r["offset"], r["length"]) for r in rows if r["file"] == name)
                with fs.open_input_file(f"{base}/{name}") as file:
                    for begin, end, inside in ranges(spans):
                        file.seek(begin)
                        data, out = file.read(end - begin), []
                        for i in inside:
                            offset, length = spans[i]
                            head, payload = parse(data[offset - begin : offset - begin + length])
                            kind, digest, size = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"])
                            if kind == "response":
                                size = len(payload)
                                if hashlib.sha256(payload).hexdigest() != digest:
                                    raise ValueError(f"{name} at {offset}: the payload isn't the one that was written")
                            out.append({"page_id": page(head["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page(head.get("WARC-Refers-To"))} | ({"payload": payload} if with_payload else {}))
                        yield pa.RecordBatch.from_pylist(out, arrow)

    stretch = F.floor(F.col("offset") / (4 * LARGEST_READ))
    dealt = index.select("file", "offset", "length").repartition(int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file", stretch)
    return dealt.sortWithinPartitions("file", "offset").mapInArrow(run, schema)


def through_archives(pages: DataFrame) -> DataFrame:
    """Writes all rows of ``pages`` to archives in the shared folder and reads every record back.

    Keys are read as long.  A null html is an empty payload; rows without page_id are responses; repeated rows give a record each (of equal
    payloads those with the smallest page_id are responses); an empty table gives an empty result; other columns
    are left out.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    return read(write(classified(pages), folder), folder)


SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as n, sha256(payload) as digest from p),
f as (select digest, min(page_id) as first from d where n >= 100 group by digest)
select d.page_id, d.n::bigint as payload_bytes, d.digest as payload_digest,
       case when n >= 100 and d.page_id <> f.first then 'revisit' else 'response' end as record_type,
       case when n >= 100 and d.page_id <> f.first then f.first end as refers_to
from d left join f on d.digest = f.digest
"""
