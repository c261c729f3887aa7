"""One ranking from several differently scaled scores.

Each signal is standardised within its query by median and median absolute
deviation, squashed by a logistic into (0, 1), and the bounded values are combined
by a weighted geometric mean, so no signal's range or outliers dominate.

Medians, places and positions are exact at every size. They come from running counts over
a global sort, whose ranges are cut without regard to queries or ties: no task holds a
hot query or a large group of equal values. Medians and places are counted over distinct values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.common import running
from siftspark.session import cut_lineage

#: Scales a median absolute deviation to a standard deviation of normal data.
MAD_SCALE = 1.4826
DEFAULT = {"bm25": ("bm25_rank", -1.0), "vector": ("vector_rank", -1.0), "score": ("score", 1.0)}


def _middle(counted: DataFrame, group: list[str], value: str, name: str) -> DataFrame:
    """``group, name``: the median, from rows with ``_before`` and ``n`` (mean of the two middle values of an even number)."""
    total = counted.groupBy(*group).agg(F.sum("n").alias("_total"))
    at = lambda place: F.max(F.when((F.col("_before") < place) & (F.col("_before") + F.col("n") >= place), F.col(value)))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    return counted.join(total, group).groupBy(*group).agg(((at(low) + at(high)) / 2).alias(name))


def fuse_scores(
    df: DataFrame,
    query_col: str = "query_id",
    item_col: str = "chunk_id",
    signals: dict[str, tuple[str, float]] | None = None,
    missing: float = 0.05,
) -> DataFrame:
    """Distinct rows of ``df`` with, per signal s, ``z_s`` (standardised), ``u_s`` (in (0,1))
    and ``place_s``, then ``fused`` and ``position``.

    ``signals``: name -> (column, weight). A weight's sign gives the direction: negative
    where smaller is better (ranks). Defaults to bm25_rank, vector_rank (smaller is
    better) and score. A missing signal counts as ``missing``; if the median absolute
    deviation of a signal is 0 in a query, its scale is 1. ``place_s`` is 1 plus the
    number of rows of the query that are strictly better. ``position`` is a total order:
    fused (twelve digits), then item, then a hash of the whole row. Rows with a null query are left out;
    null items keep their place. Extra columns stay; one named like a result gets the
    suffix ``_given``. An empty table gives an empty result.
    """
    signals = signals or DEFAULT
    made = {"fused", "position", *(f"{p}_{s}" for p in ("z", "u", "place", "_v", "_m", "_d") for s in signals), "_id", "_hash", "_f", "_before"}
    used = {query_col, item_col, *(c for c, _ in signals.values())}
    df = df.withColumnsRenamed({c: f"{c}_given" for c in df.columns if c in made and c not in used})
    base = df.where(F.col(query_col).isNotNull()).distinct()
    for s, (c, w) in signals.items():
        v = F.col(c).cast("double") * (1.0 if w > 0 else -1.0)
        base = base.withColumn(f"_v_{s}", F.when(F.isnan(v), None).otherwise(v))
    base = cut_lineage(base.withColumns({"_id": F.monotonically_increasing_id(), "_hash": F.xxhash64(*df.columns)}))

    # Signals one below the other, without the other columns.
    long = base.select(F.col(query_col).alias("q"), "_id", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(f"_v_{s}").alias("v")) for s in signals])).alias("x")).select("q", "_id", "x.s", "x.v").where("v is not null")
    counted = cut_lineage(running(long.groupBy("q", "s", "v").agg(F.count("*").alias("n")), ["q", "s"], [F.desc("v")], "n"))
    middle = cut_lineage(_middle(counted, ["q", "s"], "v", "m"))
    away = counted.join(middle, ["q", "s"]).groupBy("q", "s", F.abs(F.col("v") - F.col("m")).alias("d")).agg(F.sum("n").alias("n"))
    spread = _middle(running(away, ["q", "s"], [F.col("d")], "n"), ["q", "s"], "d", "d")
    of = lambda c, s: F.max(F.when(F.col("s") == s, F.col(c)))
    facts = middle.join(spread, ["q", "s"]).groupBy("q").agg(*[of("m", s).alias(f"_m_{s}") for s in signals], *[of("d", s).alias(f"_d_{s}") for s in signals])
    places = long.join(counted.select("q", "s", "v", "_before"), ["q", "s", "v"]).groupBy("_id").agg(*[(of("_before", s) + 1).alias(f"place_{s}") for s in signals])

    rows = base.select("_id", "_hash", F.col(query_col).alias("q"), F.col(item_col).alias("item"), *[f"_v_{s}" for s in signals]).join(facts, "q", "left")
    total = sum(abs(w) for _, w in signals.values())
    parts = []
    for s, (_, w) in signals.items():
        d = F.col(f"_d_{s}") * MAD_SCALE
        rows = rows.withColumn(f"z_{s}", (F.col(f"_v_{s}") - F.col(f"_m_{s}")) / F.when(d > 0, d).otherwise(1.0))
        u = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col(f"z_{s}")))))
        rows = rows.withColumn(f"u_{s}", F.coalesce(u, F.lit(missing)))
        parts.append(F.lit(abs(w) / total) * F.log(F.col(f"u_{s}")))
    rows = rows.withColumn("fused", F.exp(reduce(lambda a, b: a + b, parts))).drop(*[f"_{p}_{s}" for p in "mdv" for s in signals])
    # the other columns are joined last, once
    ordered = running(rows.withColumn("_f", F.round("fused", 12)), ["q"], [F.desc("_f"), F.asc_nulls_last("item"), F.col("_hash")]).withColumn("position", F.col("_before") + 1)
    found = ordered.drop("q", "item", "_f", "_hash", "_before").join(places, "_id", "left")
    return base.drop("_hash", *[f"_v_{s}" for s in signals]).join(found, "_id").drop("_id")


def best_of_all(df: DataFrame, best: int = 5, query_col: str = "query_id", item_col: str = "chunk_id", signals: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Rows of ``fuse_scores`` that every signal places among the query's best ``best``.

    Signals that are ranks (negative weight) place a row by their own value, others by
    ``place_s``. Such a row's bounded values are each at least the worst among the signal's best, so
    its fused value is at least their geometric mean: rows below that bar are no candidates,
    and the places are checked for the rest. A row with a missing signal is never among them.
    """
    signals = signals or DEFAULT
    ranked = fuse_scores(df, query_col, item_col, signals)
    among = {s: F.coalesce(F.col(c if w < 0 else f"place_{s}") <= best, F.lit(False)) & F.col(c).isNotNull() for s, (c, w) in signals.items()}
    total = sum(abs(w) for _, w in signals.values())
    worst = reduce(lambda a, b: a + b, [F.lit(abs(w) / total) * F.log(F.min(F.when(among[s], F.col(f"u_{s}")))) for s, (_, w) in signals.items()])
    bar = ranked.groupBy(query_col).agg(F.exp(worst).alias("_bar_all"))
    near = ranked.join(bar, query_col).where(F.col("fused") >= F.col("_bar_all") * (1 - 1e-9)).drop("_bar_all")
    return near.where(reduce(lambda a, b: a & b, among.values()))
