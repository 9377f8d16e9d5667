"""Source trees as tables: a scan of files, with languages, hashes and samples."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quern.functions import text as T
from quern.sources import globs
from quern.sources.sinks import materialize


def scan_tree(spark: SparkSession, root: str, include=(), exclude=(), profile: str | None = None) -> DataFrame:
    """``(path, size_bytes, mtime_ms, language, sha256, sample, text)`` of the text files under ``root``.

    Scope and ignore rules and the size bound apply to metadata, before contents are
    read. Binary files, those with a zero byte, are left out; bad UTF-8 is replaced.
    """
    base = root.rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", r"^file:/*", "/")
    rel = F.substr(path, F.lit(len(base.removeprefix("file://")) + 1), F.length(path))
    f = raw.where(F.col("length") <= T.MAX_FILE_BYTES).withColumn("rel", rel)
    f = f.where(~T.is_ignored(F.col("rel")) & globs.scope(F.col("rel"), include, exclude, profile))
    f = f.where(~T.has_nul(F.col("content")))
    text = F.decode(F.encode(F.make_valid_utf8(F.col("content").cast("string")), "utf-8"), "utf-8")
    out = f.select(
        F.col("rel").alias("path"),
        F.col("length").alias("size_bytes"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
        T.language_of(F.col("rel")).alias("language"),
        F.sha2("content", 256).alias("sha256"),
        text.alias("text"),
    )
    return out.withColumn("sample", F.substring("text", 1, T.SAMPLE_CHARS))


def oversize(spark: SparkSession, root: str) -> DataFrame:
    """Files over the bound: known by size alone, their contents never read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.where(F.col("length") > T.MAX_FILE_BYTES).select("path", F.col("length").alias("size_bytes"))


# --- a walk that goes on past what it cannot read ----------------------------------------
class TreePart(InputPartition):
    """Folders that one task walks; those marked flat give their own files alone."""

    def __init__(self, folders: list[tuple[str, bool]]):
        self.folders = folders


class TreeReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"].removeprefix("file://").rstrip("/") or "/"
        self.parts = int(options.get("parts", "32"))
        self.only = [d for d in options.get("folders", "").split(",") if d]

    def partitions(self) -> list[InputPartition]:
        """The root's own files, and its folders two levels down, dealt to ``parts`` tasks."""
        if self.only:
            found = [(d, False) for d in self.only]
        else:
            found = [("", True)]
            for top in self._folders(""):
                inner = self._folders(top)
                found += [(top, False)] if inner is None or not inner else [(top, True)] + [(d, False) for d in inner]
        return [TreePart(found[k :: self.parts]) for k in range(min(self.parts, len(found)))]

    def _folders(self, rel: str) -> list[str] | None:
        try:
            with os.scandir(os.path.join(self.root, rel)) as it:
                return sorted(os.path.join(rel, e.name) for e in it if e.is_dir(follow_symlinks=False) and not _skipped(os.path.join(rel, e.name) + "/"))
        except OSError:
            return [] if rel == "" else None

    def read(self, partition: TreePart) -> Iterator[tuple]:
        todo = list(partition.folders)
        while todo:
            rel, flat = todo.pop()
            try:
                with os.scandir(os.path.join(self.root, rel)) as it:
                    entries = sorted(it, key=lambda e: e.name)
            except OSError as e:
                yield rel, None, None, None, True, e.strerror or str(e)
                continue
            for e in entries:
                path = os.path.join(rel, e.name)
                try:
                    if e.is_dir(follow_symlinks=False):
                        if not flat and not _skipped(path + "/"):
                            todo.append((path, False))
                        continue
                    if _skipped(path):
                        continue
                    info = e.stat()
                    if not stat.S_ISREG(info.st_mode):
                        continue
                    content = None
                    if info.st_size <= T.MAX_FILE_BYTES:
                        with open(e.path, "rb") as f:
                            content = f.read()
                    yield path, info.st_size, int(info.st_mtime * 1000), content, False, None
                except OSError as x:
                    yield path, None, None, None, False, x.strerror or str(x)


class TreeSource(DataSource):
    """Files below a folder that all executors see, a row for each, and a row for what could not be read."""

    @classmethod
    def name(cls) -> str:
        return "quern_tree"

    def schema(self) -> str:
        return "path string, size_bytes long, mtime_ms long, content binary, is_dir boolean, error string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def _skipped(path: str) -> bool:
    return any(p in path for p in T.IGNORED_PARTS)


def walk_tree(spark: SparkSession, root: str, folders: list[str] | None = None, include=(), exclude=(), profile: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(files, errors)`` below ``root``, read once: a folder or file that cannot be read is an error, not the end.

    ``files`` has the columns of :func:`scan_tree` and ``oversize``: files over the bound come
    with a null hash and text, for what needs their size alone. ``errors``: ``(path,
    prefix, error)``, ``prefix`` being set for folders, below which nothing is known. The
    tree must be where all executors see it; ``folders`` restricts the walk to some.
    """
    spark.dataSource.register(TreeSource)
    raw = spark.read.format("quern_tree").option("folders", ",".join(folders or [])).load(root)
    raw = materialize(raw)  # one walk for both results
    path = F.col("path")
    errors = raw.where("error is not null").select("path", F.when(F.col("is_dir"), F.when(path == "", "").otherwise(F.concat(path, F.lit("/")))).alias("prefix"), "error")
    f = raw.where("error is null").where(~T.is_ignored(path) & globs.scope(path, include, exclude, profile))
    large = F.col("content").isNull()
    f = f.where(large | ~T.has_nul(F.coalesce("content", F.lit(b""))))
    text = F.decode(F.encode(F.make_valid_utf8(F.col("content").cast("string")), "utf-8"), "utf-8")
    out = f.select("path", "size_bytes", "mtime_ms", T.language_of(path).alias("language"), F.sha2("content", 256).alias("sha256"), text.alias("text"), large.alias("oversize"))
    return out.withColumn("sample", F.substring("text", 1, T.SAMPLE_CHARS)), errors
