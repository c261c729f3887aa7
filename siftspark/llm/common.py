"""Tokens, shingles and bounded sketches shared by the text operators."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftspark.session import cut_lineage

WORD = re.compile(r"\w+")
#: ASCII text: lower-cases what belongs to words and blanks the rest.
_ASCII_WORDS = {i: chr(i).lower() if chr(i).isalnum() or chr(i) == "_" else " " for i in range(128)}

#: Odd multipliers for combining word hashes; any odd 64-bit constants serve.
_MULTIPLIERS = (
    np.array([(0x9E3779B97F4A7C15 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(1, 33)], dtype=np.uint64)
)


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand and emptied when it grows too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


def words(text: str) -> list[str]:
    """Maximal runs of letters, digits and underscores, lower-cased."""
    if text.isascii():
        return text.translate(_ASCII_WORDS).split()
    if "İ" in text:  # its lower case is two characters, the second no letter
        return [w.lower() for w in WORD.findall(text)]
    return WORD.findall(text.lower())


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` successive items of ``h`` (order counts)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out += h[i : i + n] * _MULTIPLIERS[i]
    return mix64(out)


def shingle_set(text: str, width: int, cache: WordHashes, min_words: int = 1) -> np.ndarray | None:
    """Sorted distinct shingle hashes of a text, or None if it has too few words."""
    found = words(text)
    if len(found) < max(min_words, width):
        return None
    return np.unique(shingle_hashes(np.fromiter(map(cache.__getitem__, found), np.uint64, len(found)), width))


def batch_shingles(texts: list[str | None], width: int, cache: WordHashes, min_words: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Shingle hashes of many texts at once: (rows that have enough words, hashes end to end, their bounds).

    Hashes of row ``rows[i]`` are ``hashes[bounds[i]:bounds[i + 1]]``, in text order and with repeats.
    """
    rows, found = [], []
    for i, text in enumerate(texts):
        if text is not None:
            w = words(text)
            if len(w) >= max(min_words, width):
                rows.append(i)
                found.append(w)
    if not rows:
        return [], np.empty(0, np.uint64), np.zeros(1, np.int64)
    length = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter(map(cache.__getitem__, chain.from_iterable(found)), np.uint64, int(length.sum()))
    h = shingle_hashes(flat, width)
    ends = np.cumsum(length)
    keep = np.ones(len(h), bool)
    for back in range(1, width):  # those that run over the end of a text
        at = ends[:-1] - back
        keep[at[at < len(h)]] = False
    return rows, h[keep], np.r_[0, np.cumsum(length - width + 1)]


def frame_rows(it: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in it:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


# --------------------------------------------------------------------------
# Bounded counting sketch: one array of 32-bit counters, filled on the executors,
# summed in slices. Its size depends on ``bits`` alone.

SLICES = 64
MAX_BITS = 25
MOST = (1 << 32) - 1


def sketch_bits(n_rows: int, per_row: int) -> int:
    """log2 of the number of counters: follows the data up to MAX_BITS (32 MB as codes)."""
    return min(MAX_BITS, max(14, math.ceil(math.log2(max(2, n_rows * per_row)))))


def counting_sketch(df: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """Counts of all hashes of all rows, by their top ``bits`` bits.

    ``hashes`` turns the batches of a partition into uint64 arrays. Every row is
    counted. What reaches the driver is 2**bits counters, whatever the input.
    """
    size = 1 << bits
    slices = min(SLICES, size)
    width = size // slices

    def fill(it):
        counts = np.zeros(size, np.uint32)
        shift = np.uint64(64 - bits)
        pend, held = [], 0

        def flush():
            idx, c = np.unique(np.concatenate(pend), return_counts=True)
            counts[idx] = np.minimum(counts[idx].astype(np.int64) + c, MOST).astype(np.uint32)

        for h in hashes(it):
            pend.append((h >> shift).astype(np.uint32))
            held += len(h)
            if held > 2_000_000:
                flush()
                pend, held = [], 0
        if pend:
            flush()
        for s in range(slices):
            part = counts[s * width : (s + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.array([_pack(part)], pa.binary())], ["slice", "counts"]
                )

    def add(key, table):
        total = np.zeros(width, np.int64)
        for c in table.column("counts"):
            total += _unpack(c.as_py())
        out = _pack(np.minimum(total, MOST).astype(np.uint32))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([out], pa.binary())})

    schema = "slice int, counts binary"
    summed = df.mapInArrow(fill, schema).groupBy("slice").applyInArrow(add, schema)
    out = np.zeros(size, np.uint32)
    for row in summed.toLocalIterator():
        out[row["slice"] * width : (row["slice"] + 1) * width] = _unpack(row["counts"])
    return out


def _pack(counts: np.ndarray) -> bytes:
    """All lowest bytes, then the next (mostly zero), compressed."""
    return zlib.compress(counts.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpack(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


#: Counts that the codes of a compact sketch stand for: exact to 32, then 8 steps to a doubling, to 2**32.
CODES = np.r_[np.arange(33), np.minimum(np.ceil(32 * 2 ** (np.arange(1, 217) / 8)), MOST)].astype(np.int64)


def compact(sketch: np.ndarray) -> np.ndarray:
    """Codes of one byte, a quarter of the size to broadcast."""
    out = np.empty(len(sketch), np.uint8)
    for a in range(0, len(sketch), 1 << 20):
        out[a : a + (1 << 20)] = np.searchsorted(CODES, sketch[a : a + (1 << 20)], side="right") - 1
    return out


def code_of(codes: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Codes of hashes in a compact sketch; they rise with the counts."""
    return codes[(h >> np.uint64(64 - bits)).astype(np.int64)]


def lookup(codes: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """Counts of hashes in a compact sketch (from above 32, rounded down)."""
    return CODES[code_of(codes, bits, h)]


def sorted_distinct(a: np.ndarray) -> np.ndarray:
    """As np.unique, by sorting (its hash table is several times slower for these)."""
    a = np.sort(a)
    return a[np.r_[True, a[1:] != a[:-1]]] if len(a) else a


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def normalise_key(col):
    """Lower case, trimmed, with one hyphen between parts."""
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s_\-]+", "-")


def running(df: DataFrame, group: list[str], order: list, weight: str | None = None) -> DataFrame:
    """Adds ``_before``: the summed weight (default: number) of the rows of the group before this one in ``order``.

    The rows are sorted in ranges over group and order together. A row's sum is that of the rows of its group
    before it in its range, plus those of the ranges before.
    """
    w = F.col(weight) if weight else F.lit(1)
    keys = [F.col(c) for c in group]
    placed = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_at", F.monotonically_increasing_id())
    placed = cut_lineage(placed).withColumn("_range", F.shiftright("_at", 33))
    own = F.sum(w).over(W.partitionBy(*group, "_range").orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
    parts = placed.groupBy(*group, "_range").agg(F.sum(w).alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1))  # a row per range
    parts = parts.select(*group, "_range", F.coalesce(earlier, F.lit(0)).alias("_earlier"))
    return placed.withColumn("_own", F.coalesce(own, F.lit(0))).join(parts, [*group, "_range"]).withColumn("_before", F.col("_own") + F.col("_earlier")).drop("_at", "_range", "_own", "_earlier")
