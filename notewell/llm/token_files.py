"""Token ids as binary shards: one id array a shard, and Elias-Fano encoded document boundaries.

A shard is two files.  ``<name>.ids`` holds the ids of its documents one after the other, little-endian, two bytes
each where the vocabulary has at most 65,536 ids, else four.  ``<name>.ef`` holds a JSON line (numbers of documents
and ids, bytes an id, sizes of what follows) and two Elias-Fano sequences: the ends of the documents and their
doc_ids.  A sequence of n values below u takes about n * (2 + log2(u / n)) bits and a directory with the place of every
512th one bit; ``select`` reads the directory's entry, a stretch of high bits and the low bits of the values that it
was asked for, and nothing else of the file, so there is no table of 64-bit offsets, neither stored nor made.

Texts are encoded where they are read; only ids are shuffled.  Documents are dealt by ranges of doc_id and of a hash of
their ids, so that rows with one doc_id may be split too, and sorted, so that shard after shard holds the documents in
ascending order.  A task begins a new shard after SHARD_DOCS documents or SHARD_IDS ids, so that its size has a bound
whatever the table's.  Each attempt of a task writes files of its own name, and the manifest, which is committed once
a task, names those of the attempt that counts.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .pieces import PieceEncoder, texts_of
from .support import Publisher, filesystem, fresh_path, give_back_memory, written
from .textcodes import slices

CACHE = 1_000_000
#: One entry of the select directory for so many values.
STEP = 512
NULL_ID = -(1 << 63)
#: Documents and ids after which a shard ends, and ids read at once.
SHARD_DOCS, SHARD_IDS, READ_IDS = 1 << 18, 1 << 26, 1 << 21
#: Bytes from which the high bits are scanned at once, at least, and values coded at once.
SCAN, CODED = 4096, 1 << 14


class FileBytes:
    """A part of an open file that is read slice by slice."""

    def __init__(self, file, begin: int, length: int):
        self.file, self.begin, self.length = file, begin, length

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, part: slice) -> bytes:
        first, last, _ = part.indices(self.length)
        self.file.seek(self.begin + first)
        return self.file.read(max(0, last - first))


class EliasFano:
    """An ascending sequence of non-negative integers: low bits packed, high parts in unary, and a directory.

    The parts are bytes, or parts of a file that is read where it is asked.
    """

    def __init__(self, n: int, low_bits: int, directory, low, high):
        self.n, self.low_bits, self.directory, self.low, self.high = n, low_bits, directory, low, high

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        values = values.astype(np.uint64)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(places[-1]) // 8 + 1, np.uint8)
        np.bitwise_or.at(high, places // 8, (1 << (places % 8)).astype(np.uint8))
        low = []
        for a in range(0, n if low_bits else 0, CODED):
            bits = (values[a : a + CODED, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low.append(np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes())
        return cls(n, low_bits, places[::STEP].astype("<u8").tobytes(), b"".join(low), high.tobytes())

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.int64)
        a, b = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(np.frombuffer(self.low[a // 8 : -(-b // 8)], np.uint8), bitorder="little")[a % 8 : a % 8 + b - a]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))

    def stretch(self, first: int, count: int) -> np.ndarray:
        """The values first .. first+count-1."""
        entry = first // STEP
        base = int(np.frombuffer(self.directory[8 * entry : 8 * entry + 8], "<u8")[0])
        skip, found = first % STEP, []
        need = skip + count
        while need > 0:
            # From the directory's bit on, a stretch of high bits with enough ones.
            window = np.unpackbits(np.frombuffer(self.high[base // 8 : base // 8 + SCAN + need // 4], np.uint8), bitorder="little")
            ones = np.flatnonzero(window[base % 8 :])[:need] + base
            found.append(ones)
            need -= len(ones)
            base += len(window) - base % 8
        ones = np.concatenate(found)[skip:]
        return (ones - np.arange(first, first + count)) << self.low_bits | self._low(first, count)

    def select(self, i: int) -> int:
        return int(self.stretch(i, 1)[0])

    def sizes(self) -> list[int]:
        return [self.n, self.low_bits, len(self.directory), len(self.low), len(self.high)]

    def dump(self) -> bytes:
        return self.directory + self.low + self.high

    @classmethod
    def load(cls, data: bytes, sizes: list[int]) -> EliasFano:
        n, low_bits, *lengths = sizes
        ends = np.cumsum([0, *lengths]).tolist()
        return cls(n, low_bits, *[data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])

    @classmethod
    def open(cls, file, begin: int, sizes: list[int]) -> EliasFano:
        """The sequence that begins at ``begin`` of an open file; nothing of it is read yet."""
        n, low_bits, *lengths = sizes
        starts = (begin + np.cumsum([0, *lengths])).tolist()
        return cls(n, low_bits, *[FileBytes(file, a, length) for a, length in zip(starts, lengths, strict=False)])


class LibraryPieces:
    """Pieces encoded by the tokenizers library; texts with a special token are left to it as a whole."""

    def __init__(self, spec: str):
        # One thread a task: more would take the other tasks' cores and memory of their own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        parts = json.loads(spec)
        if parts["normalizer"] is not None or parts["pre_tokenizer"]["type"] != "ByteLevel" or parts["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary without normalisation is needed")
        # Byte-level vocabularies write a byte that is no visible Latin-1 character as one of the code points from 256 on.
        visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.marks = {b: 256 + i for i, b in enumerate(sorted({*range(256)} - {*visible}))}
        self.special = [str(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = PieceEncoder(self.encode_pieces, self.dtype, CACHE)

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        # Straight to the library's model: a piece needs no splitting any more, and no large result object.
        tokenize = self.tokenizer.model.tokenize
        marked = [p.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.marks) for p in pieces]
        return [np.array([t.id for t in tokenize(p)], self.dtype).tobytes() for p in marked]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        left = list(texts)
        for i in whole:
            left[i] = ""
        ids, upto = self.pieces(left)
        out = np.split(ids, upto[1:-1])
        for i in whole:
            out[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, self.dtype)
        return out


_libraries: dict[str, LibraryPieces] = {}


def encoded(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key long, ids binary) of each row; the ids are packed as in the files.  Null texts are empty."""
    with open(tokenizer_path, encoding="utf-8") as file:
        shared, name = docs.sparkSession.sparkContext.broadcast(file.read()), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _libraries:
            _libraries.clear()
            _libraries[name] = LibraryPieces(shared.value)
        encode = _libraries[name]
        for batch in batches:
            for a, b in slices(batch.column(1)):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in encode(texts_of(part.column(1)))], pa.binary())], [key, "ids"])
        give_back_memory()

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, T.StructType([T.StructField(key, T.LongType()), T.StructField("ids", T.BinaryType())]))


class ShardWriter:
    """One shard: ids go to the file as they come, boundaries and doc_ids at the end."""

    def __init__(self, folder: str, name: str, dtype: str, end_id: int):
        self.folder, self.name, self.dtype = folder, name, np.dtype(dtype)
        self.end = np.array([end_id], dtype).tobytes()
        self.out = Publisher(folder, f"{name}.ids")
        self.keys: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.n_docs = self.n_ids = 0

    def add(self, keys: np.ndarray, ids: list[bytes]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize + 1
        self.out.write(b"".join(x for each in ids for x in (each, self.end)))
        self.keys.append(keys)
        self.lengths.append(lengths)
        self.n_docs += len(ids)
        self.n_ids += int(lengths.sum())

    def close(self) -> dict:
        self.out.close()
        keys, ends = np.concatenate(self.keys), np.cumsum(np.concatenate(self.lengths))
        nulls = int((keys == NULL_ID).sum())
        some = keys[nulls:]
        base = int(some[0]) if len(some) else 0
        boundaries = EliasFano.of(ends)
        names = EliasFano.of((some.astype(np.uint64) - np.uint64(base % (1 << 64))) if len(some) else some)
        head = {"n_docs": self.n_docs, "n_ids": self.n_ids, "id_bytes": self.dtype.itemsize, "nulls": nulls, "base": base, "ends": boundaries.sizes(), "names": names.sizes()}
        index = Publisher(self.folder, f"{self.name}.ef")
        index.write(json.dumps(head).encode() + b"\n")
        index.write(boundaries.dump() + names.dump())
        index.close()
        return {"shard": self.name, "n_docs": self.n_docs, "n_ids": self.n_ids, "low_id": int(keys[0])}


def ranges_of(keys: DataFrame, key: str, parts: int) -> tuple[list[int], int]:
    """Bounds of about ``parts`` ranges of the keys, as many as rows, and the ranges of rows without one.

    A key that stands for many rows is the bound of several ranges; these are told apart by a hash.
    """
    rows, some = keys.agg(F.count("*"), F.count(key)).first()
    share = max(1, round(parts * some / max(1, rows)))
    found = keys.agg(F.percentile_approx(key, [i / share for i in range(1, share)], 20 * parts)).first()[0] if share > 1 and some else None
    return list(found or []), -(-parts * (rows - some) // max(1, rows))


def write_shards(rows: DataFrame, ranges: tuple[list[int], int], folder: str, id_bytes: int, end_id: int, key: str = "doc_id") -> DataFrame:
    """Writes the shards of (key, ids) below ``folder``; returns the manifest (shard, n_docs, n_ids, low_id), a row a shard.

    Null doc_ids come first; rows with one doc_id stand side by side, in the order of a hash of their ids.  The names of
    shards ascend as their documents do.  The rows are computed once: the ranges come from the keys alone.
    """
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("low_id", T.LongType())])
    arrow = pa.schema([("shard", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("low_id", pa.int64())])
    most_docs, most_ids = SHARD_DOCS, SHARD_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt, shard, n = uuid.uuid4().hex[:12], None, 0
        for batch in batches:
            # A stretch of about a million ids at a time.
            sizes = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for part in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(np.cumsum(sizes) >> 21)) + 1):
                if not len(part):
                    continue
                if shard and (shard.n_docs >= most_docs or shard.n_ids >= most_ids):
                    yield pa.RecordBatch.from_pylist([shard.close()], arrow)
                    shard = None
                if shard is None:
                    shard = ShardWriter(folder, f"part-{TaskContext.get().partitionId():06d}-{n:06d}-{attempt}", f"<u{id_bytes}", end_id)
                    n += 1
                rows = batch.slice(int(part[0]), len(part))
                shard.add(rows.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False), rows.column(1).to_pylist())
        if shard:
            yield pa.RecordBatch.from_pylist([shard.close()], arrow)

    bounds, nulls = ranges
    bound = F.array(*[F.lit(x) for x in bounds]).cast("array<bigint>")
    below = F.size(F.filter(bound, lambda x: x < F.col(key)))
    equal = F.size(F.filter(bound, lambda x: x == F.col(key)))
    # The hash as a part of 1, ascending as the hash does.
    part = (F.shiftright(F.col("_h"), 11).cast("double") + float(1 << 52)) / float(1 << 53)
    place = F.when(F.col(key).isNull(), F.floor(part * nulls)).otherwise(nulls + below + F.floor(part * equal))
    order = [F.col(key).asc_nulls_first(), F.col("_h").asc()]
    dealt = rows.withColumn("_h", F.xxhash64("ids")).withColumn("_part", place.cast("int"))
    dealt = dealt.repartitionById(nulls + len(bounds) + 1, F.col("_part")).sortWithinPartitions(*order, "ids")
    return written(dealt.select(key, "ids").mapInArrow(run, schema), "token-manifest")


class Shard:
    """A shard opened for reading: of its index only the head is read at once."""

    def __init__(self, folder: str, name: str):
        self.fs, base = filesystem(folder)
        self.path = f"{base}/{name}"
        self.index = self.fs.open_input_file(f"{self.path}.ef")
        head, _, _ = self.index.read(4096).partition(b"\n")
        for k, v in json.loads(head).items():
            setattr(self, k, v)
        begin = len(head) + 1
        ends, names = self.ends, self.names
        self.ends = EliasFano.open(self.index, begin, ends)
        self.names = EliasFano.open(self.index, begin + sum(ends[2:]), names)

    def close(self) -> None:
        self.index.close()

    def documents(self, count: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """doc_ids (NULL_ID for null), starts within the shard, and lengths, for stretches of documents."""
        for first in range(0, self.n_docs, count):
            n = min(count, self.n_docs - first)
            ends = self.ends.stretch(first, n)
            before = self.ends.select(first - 1) if first else 0
            starts = np.concatenate([[before], ends[:-1]])
            nulls = max(0, min(n, self.nulls - first))
            keys = np.full(n, NULL_ID, np.int64)
            if n > nulls:
                keys[nulls:] = self.names.stretch(first + nulls - self.nulls, n - nulls) + self.base
            yield keys, starts, ends - starts

    def ids(self, file, start: int, n: int) -> np.ndarray:
        file.seek(start * self.id_bytes)
        return np.frombuffer(file.read(n * self.id_bytes), f"<u{self.id_bytes}")


def read_shards(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, all from the files; the manifest says where shards begin.

    The manifest, a row for each shard of up to SHARD_IDS ids, is read on the driver.
    """
    first, plan = 0, []
    for r in manifest.orderBy("shard").collect():
        plan.append((r.shard, first))
        first += r.n_ids
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(folder, row["shard"])
                with shard.fs.open_input_file(f"{shard.path}.ids") as file:
                    for keys, starts, lengths in shard.documents():
                        # Documents up to READ_IDS ids are read at once, a longer one alone.
                        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // READ_IDS)) + 1
                        for part in np.split(np.arange(len(keys)), cuts):
                            k, s, n = keys[part], starts[part], lengths[part]
                            flat = shard.ids(file, int(s[0]), int(n.sum())).astype("<u4")
                            raw, at = memoryview(flat.tobytes()), 4 * (s - s[0])
                            sums = [zlib.crc32(raw[a : a + 4 * m]) for a, m in zip(at.tolist(), n.tolist(), strict=True)]
                            yield pa.RecordBatch.from_arrays([pa.array(k, mask=k == NULL_ID), pa.array(s + row["first"]), pa.array(n), pa.array(sums, pa.int64())], schema.names)
                shard.close()

    table = spark.createDataFrame(plan, "shard string, first long") if plan else spark.createDataFrame([], "shard string, first long")
    return table.repartition(max(1, len(plan)), "shard").mapInArrow(run, schema)


def through_files(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes ``docs`` to shards in the shared folder and reads them back.

    Keys are read as long.  Null texts are empty documents; rows without doc_id come first; rows that repeat a doc_id
    are documents of their own; an empty table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "token-shards")
    rows = encoded(docs, tokenizer_path, key, text)
    with open(tokenizer_path, encoding="utf-8") as file:
        id_bytes = np.dtype(LibraryPieces(file.read()).dtype).itemsize
    ranges = ranges_of(docs.select(F.col(key).cast("long").alias(key)), key, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return read_shards(spark, write_shards(rows, ranges, folder, id_bytes, end_id, key), folder)
