"""A folder of notes as a Spark source: files, ignore rules, assets, view files and configuration."""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)

#: Extensions that count as assets.
ASSETS = ["png", "jpeg", "jpg", "gif", "svg", "pdf", "canvas", "base", "tldraw"]
#: Ignored whatever the vault says.
ALWAYS = [".git", ".vaultignore"]
#: What the names of folders begin with in which a writer keeps what isn't in its place yet.
STAGED = ".vault-staged-"


def parse_ignore(text: str) -> list[str]:
    """The patterns of an ignore file: a line each, comments and empty lines left out."""
    return [p for line in text.splitlines() if (p := line.strip()) and not p.startswith("#")]


def ignored(rel: Column, patterns: list[str]) -> Column:
    """Prefix patterns hold at the boundaries of a path; ``*.ext`` holds at any depth."""
    out = F.lit(False)
    for p in patterns:
        if p.startswith("*."):
            out = out | F.endswith(rel, F.lit(p[1:]))
        else:
            p = p.rstrip("/")
            out = out | (rel == p) | F.startswith(rel, F.lit(p + "/"))
    return out


def files(spark: SparkSession, root: str, pattern: str = "*", sub: str | None = None) -> DataFrame:
    """(rel, modified, length, bytes) of the files below ``root``, or below its folder ``sub``; bytes are read only if used."""
    base = root.rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(f"{base}/{sub}" if sub else base)
    # Paths come back with their scheme, so the vault's own path is cut off at its last place.
    tail = posixpath.normpath(base.split("://")[-1]).removeprefix("file:")
    rel = F.substr(F.col("path"), F.instr("path", tail) + F.lit(len(tail) + 1))
    return rows.select(rel.alias("rel"), F.col("modificationTime").alias("modified"), "length", F.col("content").alias("bytes"))


def read_patterns(spark: SparkSession, root: str, use_ignore: bool = True) -> list[str]:
    if not use_ignore:
        return list(ALWAYS)
    found = [r for r in _try_texts(spark, root, ".vaultignore") if r[0] == ".vaultignore"]
    return ALWAYS + (parse_ignore(found[0][1]) if found else [])


def _try_texts(spark: SparkSession, root: str, pattern: str) -> list[tuple[str, str]]:
    """Small files of the vault's top folder, such as its ignore file."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(f"{root.rstrip('/')}/{pattern}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    # Spark's readers pass over names that begin with a dot.
    stream = fs.open(path)
    try:
        return [(pattern, spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))]
    finally:
        stream.close()


def scan(spark: SparkSession, root: str, sub: str | None = None, use_ignore: bool = True) -> DataFrame:
    """(rel, content, ctime) of the notes: files that end in ``.md``; those that aren't UTF-8 are left out (see ``unreadable``).

    Path rules are filters on the path alone, so the bytes of files that they exclude aren't decoded.
    """
    rows = files(spark, root, "*.md", sub).where(~ignored(F.col("rel"), read_patterns(spark, root, use_ignore)))
    return rows.where(F.is_valid_utf8("bytes")).select("rel", F.decode("bytes", "utf-8").alias("content"), F.col("modified").alias("ctime"))


def unreadable(spark: SparkSession, root: str, sub: str | None = None, use_ignore: bool = True) -> DataFrame:
    """(rel) of the files that ``scan`` leaves out, for a message to the user."""
    rows = files(spark, root, "*.md", sub).where(~ignored(F.col("rel"), read_patterns(spark, root, use_ignore)))
    return rows.where(~F.is_valid_utf8("bytes")).select("rel")


def assets(spark: SparkSession, root: str, use_ignore: bool = True) -> DataFrame:
    """(rel, name, ext) of the assets; their bytes aren't read."""
    ext = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1))
    rows = files(spark, root).select("rel").where(ext.isin(ASSETS) & ~ignored(F.col("rel"), read_patterns(spark, root, use_ignore)))
    return rows.select("rel", F.element_at(F.split("rel", "/"), -1).alias("name"), ext.alias("ext"))


def with_templates(spark: SparkSession, root: str, notes: DataFrame) -> DataFrame:
    """The notes with those of ``templates``, which the ignore file doesn't hide; each path once."""
    templates = scan(spark, root, use_ignore=False).where(F.col("rel").rlike(r"^templates/[^/]+\.md$"))
    return notes.unionByName(templates.join(notes.select("rel"), "rel", "left_anti"))


def from_bytes(spark: SparkSession, data: bytes) -> DataFrame:
    """(rel, content) of a note that comes as bytes; an error if it isn't UTF-8."""
    return spark.createDataFrame([("-", data.decode("utf-8"))], "rel string, content string")


class ConfigError(ValueError):
    pass


@dataclass
class Config:
    vault_root: str
    projects_path: str = ""
    log_project_path: str | None = None
    lint: dict = field(default_factory=dict)
    consult: dict = field(default_factory=dict)


def resolve_config(*layers: dict | str | None) -> Config:
    """Later layers win key by key; ``lint`` and ``consult`` are merged one level down."""
    out: dict = {}
    for layer in layers:
        layer = json.loads(layer) if isinstance(layer, str) else layer or {}
        for k, v in layer.items():
            out[k] = {**out[k], **v} if k in ("lint", "consult") and k in out else v
    if "vault_root" not in out:
        raise ConfigError("vault_root is missing")
    if unknown := set(out) - set(Config.__dataclass_fields__):
        raise ConfigError(f"unknown keys: {', '.join(sorted(unknown))}")
    return Config(**out)


@dataclass
class FilePart(InputPartition):
    paths: list[tuple[str, str]]


class Folder:
    """A vault's folder as tasks and the driver see it: listed level by level, without what rules exclude."""

    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.use_ignore = options.get("ignore", "true").lower() != "false"

    def open(self):
        """The file system, and the folder's path in it."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root)

    def patterns(self, system, base: str) -> list[str]:
        if not self.use_ignore:
            return list(ALWAYS)
        try:
            with system.open_input_stream(posixpath.join(base, ".vaultignore")) as file:
                return ALWAYS + parse_ignore(file.read().decode("utf-8"))
        except FileNotFoundError:
            return list(ALWAYS)

    def notes(self, prefix: str = "", wanted=lambda rel: True) -> list[tuple[int, str, str]]:
        """(modified, path, rel) of the notes whose path begins with ``prefix``; folders that can't hold one aren't listed."""
        from pyarrow import fs

        system, base = self.open()
        patterns = self.patterns(system, base)
        hidden = lambda rel: any(rel.endswith(p[1:]) if p.startswith("*.") else rel == p.rstrip("/") or rel.startswith(p.rstrip("/") + "/") for p in patterns)
        first = posixpath.dirname(prefix)
        todo, found = [posixpath.join(base, first) if first else base], []
        while todo:
            for info in system.get_file_info(fs.FileSelector(todo.pop(), allow_not_found=True)):
                rel = posixpath.relpath(info.path, base)
                if hidden(rel) or posixpath.basename(rel).startswith(STAGED):
                    continue
                if info.type == fs.FileType.Directory:
                    if (rel + "/").startswith(prefix) or prefix.startswith(rel + "/"):
                        todo.append(info.path)
                elif rel.endswith(".md") and rel.startswith(prefix) and wanted(rel):
                    found.append((info.mtime_ns or 0, info.path, rel))
        return sorted(found, key=lambda x: x[2])

    def read(self, partition: FilePart) -> Iterator[tuple]:
        system, _ = self.open()
        for path, rel in partition.paths:
            try:
                with system.open_input_stream(path) as file:
                    yield rel, file.read().decode("utf-8")
            except (OSError, UnicodeDecodeError) as e:
                print(f"left out {rel}: {e}")


def _parts(found: list[tuple[int, str, str]], batch: int) -> list[InputPartition]:
    paths = [(path, rel) for _, path, rel in found]
    return [FilePart(paths[i : i + batch]) for i in range(0, len(paths), batch)] or [FilePart([])]


class VaultReader(DataSourceReader):
    """Lists the folder once on the driver; each task reads a batch of files."""

    BATCH = 256

    def __init__(self, folder: Folder):
        self.folder, self.prefix, self.tests = folder, "", []

    def partitions(self) -> list[InputPartition]:
        return _parts(self.folder.notes(self.prefix, lambda rel: all(test(rel) for test in self.tests)), self.BATCH)

    def read(self, partition: FilePart) -> Iterator[tuple]:
        return self.folder.read(partition)


class FilteredVaultReader(VaultReader):
    """A reader that takes conditions on ``rel`` alone over.

    What a path begins with decides which folders are listed at all, the rest which files are read.
    """

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if (test := self._test(f)) is None:
                yield f
            else:
                self.tests.append(test)
                start = f.value if isinstance(f, (EqualTo, StringStartsWith)) else posixpath.commonprefix(list(f.value)) if isinstance(f, In) else ""
                # Of two beginnings the longer one holds, or no path has both.
                self.prefix = max(self.prefix, start, key=len)

    def _test(self, f: Filter):
        """The condition on a path, or None if it isn't one that is taken over."""
        if isinstance(f, Not):
            inner = self._test(f.child)
            return None if inner is None else lambda rel: not inner(rel)
        if getattr(f, "attribute", None) != ("rel",):
            return None
        value = getattr(f, "value", None)
        if isinstance(f, EqualTo):
            return lambda rel: rel == value
        if isinstance(f, In):
            return set(value).__contains__
        if isinstance(f, StringStartsWith):
            return lambda rel: rel.startswith(value)
        if isinstance(f, StringEndsWith):
            return lambda rel: rel.endswith(value)
        if isinstance(f, StringContains):
            return lambda rel: value in rel
        return (lambda rel: True) if isinstance(f, IsNotNull) else None


class VaultStream(DataSourceStreamReader):
    """Notes as they come and change: an offset is the time of the last change taken, and the path that it was in.

    A file is taken once it has been left alone for ``settle`` milliseconds (1000), so that no other change with its
    time can come later; a note that changes again comes again.
    """

    def __init__(self, folder: Folder, settle: int):
        self.folder, self.settle = folder, settle

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0, "rel": ""}

    def _settled(self) -> list[tuple[int, str, str]]:
        latest = time.time_ns() - self.settle * 1_000_000
        return [x for x in self.folder.notes() if x[0] <= latest]

    def latestOffset(self) -> dict:  # noqa: N802
        at, rel = max(((m, rel) for m, _, rel in self._settled()), default=(0, ""))
        return {"at": at, "rel": rel}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        low, high = (start["at"], start["rel"]), (end["at"], end["rel"])
        return _parts([x for x in self._settled() if low < (x[0], x[2]) <= high], VaultReader.BATCH)

    def read(self, partition: FilePart) -> Iterator[tuple]:
        return self.folder.read(partition)

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Written(WriterCommitMessage):
    """The folder in which a task has put its notes aside, and how many they are."""

    folder: str
    notes: int


class VaultWriter(DataSourceWriter):
    """Writes notes (rel, content) below the folder.

    Tasks put their notes aside, each attempt in a folder of its own; when all are done, those of the attempts that
    count are moved to their places, and a job that fails before has changed nothing.  A note that is there already is
    an error, unless the mode is overwrite, which replaces the notes written and leaves others alone; a path that is
    written twice is an error in any mode.
    """

    def __init__(self, folder: Folder, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite
        self.aside = f"{STAGED}{uuid.uuid4().hex}"

    def _there(self, system, path: str) -> bool:
        from pyarrow import fs

        return system.get_file_info(path).type != fs.FileType.NotFound

    def write(self, iterator: Iterator) -> Written:
        system, base = self.folder.open()
        own = posixpath.join(base, self.aside, uuid.uuid4().hex)
        system.create_dir(own, recursive=True)
        notes = 0
        for row in iterator:
            rel = posixpath.normpath(row.rel or "")
            if rel.startswith(("../", "/")) or not rel.endswith(".md"):
                raise ValueError(f"{row.rel!r} is no path of a note in the vault")
            path = posixpath.join(own, rel)
            if self._there(system, path):
                raise ValueError(f"{rel!r} is written twice")
            if not self.overwrite and self._there(system, posixpath.join(base, rel)):
                raise ValueError(f"{rel!r} is there already")
            system.create_dir(posixpath.dirname(path), recursive=True)
            with system.open_output_stream(path) as file:
                file.write((row.content or "").encode("utf-8"))
            notes += 1
        return Written(own, notes)

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, base = self.folder.open()
        staged: dict[str, str] = {}
        for own in [m.folder for m in messages if m is not None]:
            for info in system.get_file_info(fs.FileSelector(own, recursive=True)):
                if info.type == fs.FileType.File:
                    rel = posixpath.relpath(info.path, own)
                    if rel in staged:
                        raise ValueError(f"{rel!r} is written twice")
                    staged[rel] = info.path
        for folder in {posixpath.dirname(rel) for rel in staged}:
            system.create_dir(posixpath.join(base, folder), recursive=True)
        for rel, path in staged.items():
            system.move(path, posixpath.join(base, rel))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        """Removes what stands aside; what a task of a failed job still puts there is no note of the vault."""
        system, base = self.folder.open()
        if self._there(system, posixpath.join(base, self.aside)):
            system.delete_dir(posixpath.join(base, self.aside))


class VaultSource(DataSource):
    """``spark.read.format("vault").load(folder)``: (rel, content) of the notes of a folder; ``ignore=false`` reads all of them.

    ``readStream`` gives notes as they change, ``write`` puts notes into the folder.  ``pushdown=true`` takes conditions on
    paths over; the session must allow it by ``spark.sql.python.filterPushdown.enabled``, and the folder must be loaded
    anew for each query, since Spark 4.1 keeps what the first query with a pushed filter has listed.
    """

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "rel string, content string"

    def reader(self, schema) -> VaultReader:
        pushed = self.options.get("pushdown", "false").lower() == "true"
        return (FilteredVaultReader if pushed else VaultReader)(Folder(dict(self.options)))

    def streamReader(self, schema) -> VaultStream:  # noqa: N802
        return VaultStream(Folder(dict(self.options)), int(self.options.get("settle", "1000")))

    def writer(self, schema, overwrite: bool) -> VaultWriter:
        return VaultWriter(Folder(dict(self.options)), overwrite)
