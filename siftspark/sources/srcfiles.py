"""Python data source ``srcfiles``: files of a tree, with pruning during the walk.

Spark's binary source hides names that begin with an underscore and empty files, which
an index must see. The walk happens once, on the driver, over names and sizes only;
contents are read by the tasks, a batch of files each. The tree must be on storage that
all executors see.
"""

from __future__ import annotations

import fnmatch
import os
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from siftspark.config import IGNORED_DIRS, IGNORED_FILES, IGNORED_GLOBS, SPECIAL_NAMES, SUPPORTED_SUFFIXES
from siftspark.functions import text as T
from siftspark.models import advise

SCHEMA = "path string, rel_path string, size long, mtime double, content binary"
_DIRS, _FILES, _SUFFIXES = set(IGNORED_DIRS), set(IGNORED_FILES), set(SUPPORTED_SUFFIXES)


def wanted_name(name: str) -> bool:
    if name.startswith(".") or name in _FILES or any(fnmatch.fnmatchcase(name, g) for g in IGNORED_GLOBS):
        return False
    return PurePosixPath(name).suffix.lower() in _SUFFIXES or name.lower() in SPECIAL_NAMES


def walk(root: str, max_bytes: int) -> Iterator[tuple[str, int]]:
    """(path, size) of the files to index; unreadable ones and those above max_bytes are left out."""
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in _DIRS and not d.startswith(".")]
        for name in names:
            if not wanted_name(name):
                continue
            path = os.path.join(folder, name)
            try:
                size = os.stat(path).st_size
            except OSError:
                continue
            if size <= max_bytes:
                yield path, size


class _Batch(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = os.path.abspath(options["path"])
        self.max_bytes = int(options.get("maxFileBytes", 2_000_000))
        self.batch_bytes = int(options.get("batchBytes", 32 << 20))

    def partitions(self) -> list[_Batch]:
        out, held, size = [], [], 0
        for path, n in walk(self.root, self.max_bytes):
            held.append(path)
            size += n + 4096
            if size >= self.batch_bytes:
                out.append(_Batch(held))
                held, size = [], 0
        if held or not out:
            out.append(_Batch(held))
        return out

    def read(self, partition: _Batch) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                stat = os.stat(path)
                with open(path, "rb") as f:
                    content = f.read()
            except OSError:
                continue
            yield path, os.path.relpath(path, self.root).replace(os.sep, "/"), stat.st_size, stat.st_mtime, content


class SourceFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srcfiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ARG002 - name given by Spark
        return _Reader(self.options)


def scan(spark: SparkSession, root: str, max_file_bytes: int = 2_000_000) -> DataFrame:
    """Files with content, hash and language."""
    spark.dataSource.register(SourceFiles)
    raw = spark.read.format("srcfiles").option("maxFileBytes", max_file_bytes).load(root)
    return raw.withColumn("file_hash", F.sha1("content")).withColumn("language", T.language(F.col("rel_path")))


def absolute(root: str) -> str:
    return root.rstrip("/") if "://" in root else os.path.abspath(root)


def contents(files: DataFrame, root: str, per_task: int = 64 << 20) -> DataFrame:
    """Adds ``content`` to rows with ``rel_path`` and ``size``, read by tasks of about ``per_task`` bytes.

    Files that are gone or unreadable by now are left out; they are new again in the next scan.
    """
    total = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    names = files.columns

    def read(it):
        for batch in it:
            for i, rel in enumerate(batch.column("rel_path").to_pylist()):
                try:
                    with open(os.path.join(root, rel), "rb") as f:
                        row = batch.slice(i, 1)
                        yield pa.RecordBatch.from_arrays([*row.columns, pa.array([f.read()], pa.binary())], [*names, "content"])
                except OSError:
                    continue

    schema = T_.StructType([*files.schema.fields, T_.StructField("content", T_.BinaryType())])
    return files.repartition(max(1, -(-int(total) // per_task))).mapInArrow(read, schema)


def with_text(files: DataFrame) -> DataFrame:
    """Adds the decoded text of ``content``."""
    return files.withColumn("text", T.decode_text(F.col("content"), F.col("language")))


def project_stats(files: DataFrame) -> DataFrame:
    """One row: number of files, physical lines (counted in bytes) and the tier of model they call for."""
    text = F.decode("content", "ISO-8859-1")
    sums = files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum(T.line_count(text)), F.lit(0)).alias("total_loc"))
    return sums.withColumn("tier", advise(F.col("file_count"), F.col("total_loc")))
