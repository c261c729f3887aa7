"""Index maintenance as set operations: diff, purge, upsert, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def diff(known: DataFrame, current: DataFrame) -> DataFrame:
    """``rel_path, file_hash, old_hash, change`` with change new, changed, unchanged or removed.

    Only hashes decide; a null hash differs from any other.
    """
    old = known.select("rel_path", F.col("file_hash").alias("old_hash"), F.lit(True).alias("_o"))
    new = current.select("rel_path", "file_hash", F.lit(True).alias("_n"))
    change = (
        F.when(F.col("_n").isNull(), "removed").when(F.col("_o").isNull(), "new").when(F.col("file_hash") == F.col("old_hash"), "unchanged").otherwise("changed")
    )
    return new.join(old, "rel_path", "full_outer").select("rel_path", "file_hash", "old_hash", change.alias("change"))


def stats(changes: DataFrame, total_chunks: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """One row of the seven counters of a build."""
    count = lambda k: F.count_if(F.col("change") == k)
    by_change = changes.agg(
        F.count_if(F.col("change") != "removed").alias("scanned_files"), count("new").alias("new_files"), count("changed").alias("changed_files"), count("unchanged").alias("unchanged_files"), count("removed").alias("removed_files")
    )
    return by_change.crossJoin(total_chunks.agg(F.count("*").alias("total_chunks"))).crossJoin(new_chunks.agg(F.count("*").alias("embedded_chunks")))  # single rows


def to_purge(changes: DataFrame) -> DataFrame:
    """Paths whose old rows go: removed, new and changed ones."""
    return changes.where("change <> 'unchanged'").select("rel_path")


def purge(table: DataFrame, paths: DataFrame) -> DataFrame:
    return table.join(paths.select("rel_path").distinct(), "rel_path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: list[str], newest: str | None = None) -> DataFrame:
    """Rows of both with one row per key: those of ``new`` win, then the greatest ``newest``, then all columns."""
    both = old.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    rest = [F.desc(c) for c in ([newest] if newest else []) + [c for c in sorted(old.columns) if c not in key]]
    first = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("_from"), *rest))
    return both.withColumn("_rn", first).where("_rn = 1").drop("_rn", "_from")
