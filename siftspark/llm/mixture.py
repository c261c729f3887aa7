"""A mixture of sources at target shares of tokens.

Tokens are counted per source; each source gets a repetition rate, at most its cap;
each document is emitted floor(rate) times, and once more if a hash of its id and
the seed falls below the rate's fraction.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siftspark.llm import common as C
from siftspark.session import cut_lineage

#: Where a vocabulary of a public tokenizer is expected unless another path is given; only the driver reads it.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pre-tokenisation pattern of byte-level BPE vocabularies (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

_ENCODERS: dict[int, object] = {}


def _encoder(raw: bytes):
    """The tokenizer of a vocabulary file's bytes, built once per worker."""
    key = hash(raw)
    if key not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def with_tokens(df: DataFrame, id_col: str, text_col: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """``<id>, *keep, tokens``: the number of tokens of each text (null: 0), texts left out.

    ``vocabulary`` is read on the driver and broadcast (under 1 MB).
    """
    kept = [F.col(c) for c in keep]
    base = df.select(F.col(id_col), *kept, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    out = base.drop("_text").schema.add("tokens", "long")
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def count(it):
        encode = _encoder(shared.value)
        for batch in it:
            n = [len(encode.encode_ordinary(t)) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in [id_col, *keep]), pa.array(n, pa.int64())], [id_col, *keep, "tokens"])

    return base.mapInArrow(count, out)


def mixture_rates(tokens: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``source, target_share, max_repeats, available_tokens, rate``, one row per target source.

    ``tokens`` has ``source, tokens`` (sources already in one spelling). Shares are taken
    over the sources that have tokens. Without ``total_tokens`` the mixture is the
    largest one in which each of them reaches its share within ``max_repeats``. With a
    larger total, sources at their cap give all they may, and the others make up for
    them in proportion to their shares, up to their own caps.
    """
    have = tokens.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    wanted = targets.select(C.normalise_key("source").alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("double").alias("max_repeats")).where(
        "source is not null and target_share > 0"
    ).groupBy("source").agg(F.sum("target_share").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1.0)).alias("max_repeats"))
    rows = wanted.join(have, "source", "left").withColumn("available_tokens", F.coalesce("available_tokens", F.lit(0)))
    live = F.col("available_tokens") > 0
    room = F.col("max_repeats") * F.col("available_tokens")
    full = F.when(live, room / F.col("target_share"))  # level at which a source is at its cap
    by_level = Window.orderBy(F.asc_nulls_last("_full"), "source")  # a row per target source
    rows = rows.withColumns({"_full": full, "_room": F.when(live, room), "_share": F.when(live, F.col("target_share"))})
    taken = F.coalesce(F.sum("_room").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_share").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    if total_tokens is None:
        level = rows.agg(F.min(F.when(F.col("max_repeats") > 0, F.col("_full"))).alias("_level"))
    else:
        # the level at which all sources together give the total: with those before a source at their caps, if it is not
        at = rows.withColumn("_at", (F.lit(float(total_tokens)) - taken) / rest)
        level = at.agg(F.min(F.when(F.col("_at") <= F.col("_full"), F.struct("_full", "_at"))).alias("_x"), F.max("_full").alias("_most")).select(F.coalesce("_x._at", "_most").alias("_level"))
    rate = F.least(F.col("max_repeats"), F.col("target_share") * F.col("_level") / F.col("available_tokens"))
    return rows.crossJoin(F.broadcast(level)).select(  # one row
        "source", "target_share", "max_repeats", "available_tokens", F.when(live, F.coalesce(rate, F.lit(0.0))).otherwise(0.0).alias("rate")
    )


def mix_sources(
    docs: DataFrame, targets: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total_tokens: int | None = None, seed: int = 17, vocabulary: str = VOCABULARY
) -> tuple[DataFrame, DataFrame]:
    """(selection, shares).

    selection: ``<id>, source, tokens, copies`` with copies >= 1.
    shares: ``source, target_share, max_repeats, available_tokens, rate, selected_docs,
    mixture_tokens, actual_share``, one row per target source (zeros where it has no
    documents).

    Source spellings are brought to lower case with single hyphens. Documents of null or
    unlisted sources, with a null id, or without tokens take no part; repeated rows of
    an id count once. Each document keeps its own id even where texts are equal.
    """
    base = docs.select(F.col(id_col), C.normalise_key(source_col).alias("source"), F.col(text_col))
    wanted = targets.select(C.normalise_key("source").alias("source")).where("source is not null").distinct()
    base = base.where(F.col(id_col).isNotNull()).join(wanted, "source", "left_semi")
    counted = cut_lineage(with_tokens(base, id_col, text_col, ["source"], vocabulary).where("tokens > 0").groupBy(id_col).agg(F.max(F.struct("source", "tokens")).alias("_r")).select(id_col, "_r.source", "_r.tokens"))
    rates = cut_lineage(mixture_rates(counted, targets, total_tokens))
    # 53 hash bits make a uniform number in [0, 1)
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) / F.lit(float(1 << 53))
    copies = (F.floor("rate") + F.when(u < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    selection = counted.join(rates.select("source", "rate"), "source").select(id_col, "source", "tokens", copies.alias("copies")).where("copies > 0")
    got = selection.groupBy("source").agg(F.count("*").alias("selected_docs"), F.sum(F.col("tokens") * F.col("copies")).alias("mixture_tokens"))
    whole = got.agg(F.sum("mixture_tokens").alias("_all"))
    shares = rates.join(got, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "available_tokens", "rate", F.coalesce("selected_docs", F.lit(0)).alias("selected_docs"), F.coalesce("mixture_tokens", F.lit(0)).alias("mixture_tokens"),
        F.coalesce(F.col("mixture_tokens") / F.col("_all"), F.lit(0.0)).alias("actual_share"),
    )
    return selection, shares
