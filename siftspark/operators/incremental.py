"""Incremental processing: listings, manifests, idempotent batches.

A *listing* is what one run saw: path, checksum, size. The *manifest* holds the files
that are processed, as the last run that succeeded saw them. What a run has to process is the
anti-join of its listing against the manifest on (path, checksum); times are no
proof of a change and are not used.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.session import checkpoint_dir, cut_lineage, delete_at_end
from siftspark.storage import CommitLog, Folder


def settled_listing(scans: DataFrame, keys: list[str], path: str = "rel_path", checksum: str = "file_hash", recorded: str = "recorded_at", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per key and path: the checksum recorded last.

    Rows with a null path or checksum count as not seen. Equal times are settled by
    the greater checksum; a null time is older than any other. Repeated rows and an
    empty table are fine.
    """
    latest = F.max(F.struct(F.col(recorded), F.col(checksum), *[F.col(c) for c in extra])).alias("_last")
    return (
        scans.where(F.col(checksum).isNotNull() & F.col(path).isNotNull())
        .groupBy(*keys, path)
        .agg(latest)
        .select(*keys, path, F.col(f"_last.{checksum}").alias(checksum), *[F.col(f"_last.{c}").alias(c) for c in extra])
    )


def unprocessed(listing: DataFrame, manifest: DataFrame, keys: list[str], checksum: str = "file_hash") -> DataFrame:
    """Rows of the listing whose (keys, checksum) the manifest does not hold."""
    return listing.join(manifest.select(*keys, checksum).distinct(), [*keys, checksum], "left_anti")


class Manifest:
    """Manifest of processed files in a folder that all executors share.

    Layout: ``data/batch=N`` holds a batch's output, ``files/batch=N`` the path, checksum
    and size of the files it settled, ``commits/N.json`` says that N succeeded. A batch is
    written by overwriting its own folders, so running it again after a failure repeats
    nothing; it counts from the moment its commit file is there. Whatever a run without
    a commit left behind is never read.

    A batch settles either a whole listing, which replaces the manifest, or a part
    (``whole=False``), which is laid over it. Every COMPACT parts the manifest is written
    whole, so what has to be read stays bounded.
    """

    COMPACT = 20

    def __init__(self, spark: SparkSession, root: str, path: str = "rel_path", checksum: str = "file_hash", size: str = "size") -> None:
        self.spark, self.root, self.path, self.checksum, self.size = spark, root.rstrip("/"), path, checksum, size
        self.folder = Folder(spark, self.root)
        self.log = CommitLog(self.folder)

    def batches(self) -> list[int]:
        return self.log.numbers()

    def _schema(self) -> T.StructType:
        return T.StructType().add(self.path, "string").add(self.checksum, "string").add(self.size, "long")

    def current(self) -> DataFrame | None:
        """``path, checksum, size`` of the files that are processed, or None before the first batch."""
        used = self._used()
        if not used:
            return None
        read = self.spark.read.schema(self._schema().add("batch", "long")).option("basePath", f"{self.root}/files").parquet(*[f"{self.root}/files/batch={n}" for n in used])
        if len(used) == 1:
            return read.drop("batch")
        last = F.max_by(F.struct(self.checksum, self.size), F.struct("batch", self.checksum))
        return read.groupBy(self.path).agg(last.alias("_l")).select(self.path, "_l.*")

    def _used(self) -> list[int]:
        """The batches whose files make up the manifest: the last whole one and the parts after it."""
        used: list[int] = []
        for n in reversed(self.log.numbers()):
            used.append(n)
            if self.log.read(n)["whole"]:
                break
        return used

    def _seen(self, listing: DataFrame) -> DataFrame:
        return listing.where(F.col(self.checksum).isNotNull() & F.col(self.path).isNotNull())

    def pending(self, listing: DataFrame) -> DataFrame:
        """Rows of the listing that are new or changed since the last commit."""
        now = self.current()
        return self._seen(listing) if now is None else unprocessed(self._seen(listing), now, [self.path], self.checksum)

    def removed(self, listing: DataFrame) -> DataFrame:
        """Paths of the manifest that the listing lacks."""
        now = self.current()
        gone = now if now is not None else listing.limit(0)
        return gone.select(self.path).distinct().join(listing.select(self.path).distinct(), self.path, "left_anti")

    def commit(self, batch: int, listing: DataFrame, output: DataFrame | None = None, whole: bool = True) -> None:
        """Write a batch's output and what it settled, then its commit file (the commit point)."""
        if batch in self.log.numbers():
            return  # this batch has been taken up: running it again changes nothing
        if output is not None:
            output.write.mode("overwrite").parquet(f"{self.root}/data/batch={batch}")
        size = F.col(self.size).cast("long") if self.size in listing.columns else F.lit(None).cast("long")
        settled = self._seen(listing).select(F.col(self.path).cast("string"), F.col(self.checksum).cast("string"), size.alias(self.size)).groupBy(self.path, self.checksum).agg(F.max(self.size).alias(self.size))
        if not whole and len(self._used()) >= self.COMPACT:
            settled, whole = settled.unionByName(self.current().join(settled.select(self.path), self.path, "left_anti")), True
        settled.write.mode("overwrite").parquet(f"{self.root}/files/batch={batch}")
        self.log.add(batch, {"whole": whole, "output": None if output is None else json.loads(output.schema.json())})

    def run(self, batch: int, listing: DataFrame, process: Callable[[DataFrame], DataFrame]) -> None:
        """Process what is pending of a whole listing and commit it."""
        if batch not in self.batches():
            self.commit(batch, listing, process(self.pending(listing)))

    def output(self) -> DataFrame | None:
        """Output of all committed batches with ``batch``, in one read; columns that a batch lacks are null."""
        said = {n: self.log.read(n)["output"] for n in self.log.numbers()}
        made = {n: T.StructType.fromJson(x) for n, x in said.items() if x}
        if not made:
            return None
        columns = {f.name: f.dataType for schema in made.values() for f in schema}
        schema = T.StructType([T.StructField(n, t) for n, t in columns.items()]).add("batch", "long")
        return self.spark.read.schema(schema).parquet(f"{self.root}/data").where(F.col("batch").isin(list(made)))


def changed_per_run(
    scans: DataFrame, runs: DataFrame, run: str = "run_id", path: str = "rel_path", checksum: str = "file_hash", recorded: str = "recorded_at", size: str = "size", ok: str = "ok", root: str | None = None
) -> DataFrame:
    """``run, path, checksum, size`` to process for each successful run of a history.

    The history is taken up as it happened: run by run, in order of their numbers, the
    run's settled listing is held against the manifest, what is pending is the run's
    output, and the commit makes the listing the new manifest. Failed and aborted runs
    never commit. Late rows belong to the run they name. ``root`` is the manifest's
    folder (default: a new one in the shared folder); with a kept one, runs already committed
    are not repeated, and their output is part of the result. Extra columns are not read.
    """
    spark = scans.sparkSession
    done = runs.where(F.col("status") == ok).select(F.col(run).cast("long").alias(run)).where(F.col(run).isNotNull()).distinct()
    numbers = sorted(r[0] for r in done.collect())  # one number per run of the history
    manifest = Manifest(spark, root or f"{checkpoint_dir(spark).rstrip('/')}/manifest-{uuid.uuid4().hex}", path, checksum, size)
    if root is None:
        delete_at_end(spark, manifest.root)
    wanted = scans.select(F.col(run).cast("long").alias(run), path, checksum, recorded, size).join(F.broadcast(done), run, "left_semi")  # a number per run
    listing = cut_lineage(settled_listing(wanted, [run], path, checksum, recorded, (size,)), run)
    for number in numbers:
        manifest.run(number, listing.where(F.col(run) == number).drop(run), lambda pending: pending)
    found = manifest.output()
    if found is None:
        return listing.limit(0).select(run, path, checksum, size)
    return found.select(F.col("batch").alias(run), path, checksum, size)
