"""Reciprocal rank fusion and lookup of the fused ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftspark.session import cut_lineage


def fuse_ranks(bm25: DataFrame, vector: DataFrame, rrf_k: int = 60, top_n: int | None = None) -> DataFrame:
    """``query_id, chunk_id, score, bm25_rank, vector_rank, position`` of two rankings.

    Each has ``query_id, chunk_id, rank``. An id that a ranking lists twice counts with
    its best rank. Ties: ids of the keyword ranking first, by rank, then vector ranks.
    """
    both = bm25.select("query_id", "chunk_id", F.lit(0).alias("s"), "rank").unionByName(vector.select("query_id", "chunk_id", F.lit(1).alias("s"), "rank"))
    merged = both.groupBy("query_id", "chunk_id").agg(F.min(F.when(F.col("s") == 0, F.col("rank"))).alias("bm25_rank"), F.min(F.when(F.col("s") == 1, F.col("rank"))).alias("vector_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(rrf_k)) + F.col(c)), F.lit(0.0))
    scored = merged.withColumn("score", part("bm25_rank") + part("vector_rank"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("vector_rank"), "chunk_id")
    out = scored.withColumn("position", F.row_number().over(order))
    return out if top_n is None else out.where(F.col("position") <= top_n)


#: Ids of hits that are broadcast at most; more are joined by a shuffle of the chunks' ids.
BROADCAST_IDS = 500_000


def hydrate(fused: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the fields of their chunks; ids without a chunk are dropped after the cut.

    The chunks are first cut down to the ids of the hits, which are broadcast after they
    were counted; texts of other chunks are never moved.
    """
    fields = ["rel_path", "language", "start_line", "end_line", "text"]
    fused = cut_lineage(fused)  # k rows a query, read twice below
    ids = cut_lineage(fused.select("chunk_id").where("chunk_id is not null").distinct())
    few = ids.count() <= BROADCAST_IDS
    wanted = chunks.join(F.broadcast(ids) if few else ids, "chunk_id", "left_semi")
    one = wanted.groupBy("chunk_id").agg(F.max(F.struct(*fields)).alias("_c")).select("chunk_id", "_c.*")
    return fused.join(one, "chunk_id").select("query_id", "position", "chunk_id", *fields, "score", "bm25_rank", "vector_rank")
