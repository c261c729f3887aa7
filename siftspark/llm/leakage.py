"""Evaluation passages inside training documents.

Items and documents are cut into windows, one per word position, at two scales: of the
size of the item, for items taken over as a whole with edits, and of the passage length
(12 words), for parts of them. Sizes are rounded down to steps of STEP; an item is stood
for by its middle window of that size. A window's SimHash is the weighted vote of its five-word
shingles (weight: letters of the words). Fingerprints are indexed by four blocks of
16 bits: two fingerprints within ``radius`` bits differ in at most ``radius // 4`` bits of
at least one block, so a table per block of all values that near finds every item window
within the radius. Candidates are verified by the exact weighted shingle similarity.

The radius of item-sized windows follows from the similarity: vectors of weighted Jaccard
similarity s and equal weight have the angle acos(2s / (1 + s)), and each bit differs
with that share of pi; two standard deviations are added. At 0.8 that is 15 of 64 bits.
An edited word costs five shingles, so at 0.8 an item may have about one edit in 45 words.
Windows of 12 words have 8 shingles, of which none may differ (but one of small weight at an end):
they find equal stretches, and PASSAGE_RADIUS only leaves room for those. Successive
equal windows are joined to runs of common words, so edited passages are found by their unedited stretches.

The index of an item block has a checked size; more items are taken in several
blocks, each held against all documents. Documents are never moved.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import common as C

SHINGLE = 5
#: Most item words indexed (and broadcast) at once: about 100 MB with the block tables.
INDEX_WORDS = 400_000
#: Words fingerprinted at once.
STRIDE = 60_000
#: Ratio of one window size to the next.
STEP = 1.2
PASSAGE_RADIUS = 3
BLOCKS, BLOCK_BITS = 4, 16


def radius_for(similarity: float) -> int:
    """Bits of 64 by which fingerprints of windows of that similarity differ, with two standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(64 * share + 2 * math.sqrt(64 * share * (1 - share)))


def size_class(words: int, window: int) -> int:
    """Size of the windows that stand for an item: exact below the passage length, then in steps."""
    if words <= window:
        return words
    return math.floor(window * STEP ** math.floor(math.log(words / window, STEP) + 1e-9))


def _votes(h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(running sums of the votes, hash per shingle, weight per shingle) of one word sequence."""
    s = C.shingle_hashes(h, SHINGLE)
    sums = np.r_[0, np.cumsum(length)]
    w = (sums[SHINGLE:] - sums[:-SHINGLE]).astype(np.int32)
    bits = np.unpackbits(s.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.empty((len(s) + 1, 64), np.int32)
    votes[0] = 0
    np.cumsum(np.where(bits, w[:, None], -w[:, None]), axis=0, out=votes[1:])
    return votes, s, w


def _fingerprints(votes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of ``size`` words."""
    k = size - SHINGLE + 1
    return np.packbits(votes[k:] > votes[:-k], axis=1, bitorder="little").view(np.uint64).ravel() if len(votes) > k else np.empty(0, np.uint64)


def _near_values(values: np.ndarray, bits: int) -> np.ndarray:
    """(len(values), variants) all block values within that many bits."""
    masks = [sum(1 << i for i in c) for n in range(bits + 1) for c in itertools.combinations(range(BLOCK_BITS), n)]
    return values[:, None] ^ np.array(masks, np.uint16)


class Windows:
    """Distinct item windows of one size with their fingerprints by blocks."""

    def __init__(self, size: int, radius: int) -> None:
        self.size, self.radius, self.shingles_per = size, radius, size - SHINGLE + 1
        self.held: dict[bytes, list[tuple[int, int]]] = {}
        self.parts: list[tuple] = []

    def add(self, item: int, at: int, fp: int, s: np.ndarray, w: np.ndarray) -> None:
        """A window of an item; equal ones are kept once, with all their owners."""
        key = xxhash.xxh3_128_digest(s)
        if key not in self.held:
            self.held[key] = []
            self.parts.append((fp, s, w))
        self.held[key].append((item, at))

    def close(self) -> None:
        self.fp = np.array([p[0] for p in self.parts], np.uint64)
        self.shingles, self.weights = np.stack([p[1] for p in self.parts]), np.stack([p[2] for p in self.parts])
        owners = list(self.held.values())
        self.owners = np.array([o for x in owners for o in x], np.int64).reshape(-1, 2)
        self.owner_count = np.array([len(x) for x in owners])
        self.owner_start = np.cumsum(self.owner_count) - self.owner_count
        del self.held, self.parts
        self.tables = []
        for b in range(BLOCKS):
            near = _near_values(self.block(self.fp, b), self.radius // BLOCKS)
            order = np.argsort(near.ravel(), kind="stable")
            count = np.bincount(near.ravel(), minlength=1 << BLOCK_BITS)
            self.tables.append(((order // near.shape[1]).astype(np.int32), np.r_[0, np.cumsum(count)[:-1]].astype(np.int32), count.astype(np.int32)))

    @staticmethod
    def block(fp: np.ndarray, b: int) -> np.ndarray:
        return (fp >> np.uint64(BLOCK_BITS * b)).astype(np.uint16)

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (i, j): document window i and item window j within the radius."""
        out = []
        for b, (order, first, count) in enumerate(self.tables):
            v = self.block(fp, b)
            c = count[v]
            i = np.flatnonzero(c)
            for part in np.array_split(i, max(1, int(c.sum()) // 2_000_000)):
                n = c[part]
                rows = np.repeat(part, n)
                k = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
                j = order[np.repeat(first[v[part]], n) + k]
                close = np.bitwise_count(fp[rows] ^ self.fp[j]) <= self.radius
                out.append(rows[close] * len(self.fp) + j[close])
        both = np.unique(np.concatenate(out))
        return both // len(self.fp), both % len(self.fp)


class ItemIndex:
    """Windows of a block of items: of the passage length at every position, and one of each item's size."""

    def __init__(self, items: list[tuple[int, str]], window: int, similarity: float) -> None:
        self.window = window
        cache = C.WordHashes()
        self.passages = Windows(window, PASSAGE_RADIUS)
        whole: dict[int, Windows] = {}
        for item, text in items:
            found = C.words(text)
            if len(found) < SHINGLE:
                continue
            h = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
            votes, s, w = _votes(h, np.fromiter(map(len, found), np.int64, len(found)))
            size = size_class(len(found), window)
            of = whole.setdefault(size, Windows(size, radius_for(similarity)))
            middle = (len(found) - size) // 2
            for windows, places in ((self.passages, range(len(found) - window + 1)), (of, [middle])):
                fp, k = _fingerprints(votes, windows.size), windows.shingles_per
                for at in places:
                    windows.add(item, at, fp[at], s[at : at + k], w[at : at + k])
        self.whole = list(whole.values())
        for windows in [self.passages, *self.whole]:
            if windows.parts:
                windows.close()
        self.empty = not whole


def _shared_weight(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity of the shingle sets of paired windows (rows)."""
    same = (a[:, :, None] == b[:, None, :]).any(2)
    common = (wa * same).sum(1)
    return common / np.maximum(1, wa.sum(1) + wb.sum(1) - common)


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", *, window: int = 12, similarity: float = 0.8
) -> DataFrame:
    """``<doc>, <item>, n_windows, best_similarity, run_words, item_similarity`` of each affected document and item.

    ``n_windows`` passage windows of the document have one of the item within the radius
    and at weighted shingle similarity ``similarity`` or more, at best ``best_similarity``;
    ``run_words`` is the longest run of equal successive words (0 if below ``window``).
    ``item_similarity`` is the best similarity of a stretch of the document with the item
    as a whole, if it reaches ``similarity``, else null. Null, empty and texts
    of fewer than five words leak nothing; items shorter than ``window`` can leak as a whole only; repeated
    rows count once; columns other than the named ones are not read.
    """
    if window < SHINGLE:
        raise ValueError(f"window must be at least {SHINGLE} words")
    spark = docs.sparkSession
    known = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").distinct()
    size = known.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] / 4
    blocks = max(1, math.ceil(size / INDEX_WORDS))
    schema = "doc long, item long, n_windows long, best_similarity double, run_words long, item_similarity double"
    found = None
    for b in range(blocks):
        part = known.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "text").collect()  # bounded by INDEX_WORDS
        shared = spark.sparkContext.broadcast(ItemIndex([(r["item"], r["text"]) for r in part], window, similarity))
        hits = docs.select(F.col(doc_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null").mapInArrow(_matcher(shared, similarity), schema)
        found = hits if found is None else found.unionByName(hits)
    return found.groupBy(F.col("doc").alias(doc_col), F.col("item").alias(item_col)).agg(*[F.max(c).alias(c) for c in ("n_windows", "best_similarity", "run_words", "item_similarity")])


def _similar_windows(windows: Windows, fp: np.ndarray, inside: np.ndarray, s: np.ndarray, w: np.ndarray, similarity: float):
    """(document window, item window, similarity, equal) of the verified candidates of a stretch."""
    i, j = windows.near(fp[inside])
    i = inside[i]
    k = windows.shingles_per
    offsets = np.arange(k)
    out = []
    step = max(1, 8_000_000 // (k * k))
    for x in range(0, len(i), step):
        a, c = i[x : x + step], j[x : x + step]
        at = a[:, None] + offsets
        sa, sb = s[at], windows.shingles[c]
        sim = _shared_weight(sa, w[at], sb, windows.weights[c])
        ok = sim >= similarity
        out.append((a[ok], c[ok], sim[ok], (sa == sb).all(1)[ok]))
    return [np.concatenate(x) for x in zip(*out)] if any(len(x[0]) for x in out) else None


class _Found:
    """What documents share with items: (document, item) -> [windows, best, run, item similarity]."""

    def __init__(self, window: int) -> None:
        self.window, self.rows = window, {}

    def _row(self, d: int, item: int) -> list:
        return self.rows.setdefault((d, item), [0, None, 0, None])

    def passages(self, windows: Windows, d: np.ndarray, at: np.ndarray, j: np.ndarray, sim: np.ndarray, equal: np.ndarray) -> None:
        """Rows of one or more documents, whole; each window goes to all its owners."""
        n = windows.owner_count[j]
        rows = np.repeat(np.arange(len(j)), n)
        k = np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(windows.owner_start[j], n)
        item, place = windows.owners[k].T
        d, at, sim, equal = d[rows], at[rows], sim[rows], equal[rows]
        order = np.lexsort((at, at - place, item, d))
        d, item, at, place, sim, equal = (x[order] for x in (d, item, at, place, sim, equal))
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (item[1:] != item[:-1])])
        for a, b in zip(first.tolist(), np.r_[first[1:], len(d)].tolist()):
            row = self._row(int(d[a]), int(item[a]))
            row[0], row[1] = len(np.unique(at[a:b])), float(sim[a:b].max())
            same = np.flatnonzero(equal[a:b]) + a
            if len(same):  # equal windows at successive places on one diagonal form a run
                diagonal = at[same] - place[same]
                cut = np.flatnonzero(np.r_[True, (diagonal[1:] != diagonal[:-1]) | (at[same][1:] != at[same][:-1] + 1)])
                row[2] = int(np.diff(np.r_[cut, len(same)]).max()) + self.window - 1

    def whole(self, windows: Windows, d: np.ndarray, j: np.ndarray, sim: np.ndarray) -> None:
        order = np.lexsort((sim, j, d))
        d, j, sim = d[order], j[order], sim[order]
        for x in np.flatnonzero(np.r_[(d[1:] != d[:-1]) | (j[1:] != j[:-1]), True]).tolist():
            a = windows.owner_start[j[x]]
            for item in windows.owners[a : a + windows.owner_count[j[x]], 0].tolist():
                row = self._row(int(d[x]), item)
                row[3] = max(row[3] or 0.0, float(sim[x]))


def _matcher(shared, similarity: float):
    def match(it):
        index: ItemIndex = shared.value
        cache = C.WordHashes()

        def scan(docs: list[int], lengths: list[int], h: np.ndarray, size: np.ndarray):
            """Hits of a group of documents laid end to end."""
            which = np.repeat(np.arange(len(docs)), lengths)
            held: dict[int, list] = {}
            most = max(x.size for x in [index.passages, *index.whole])
            for lo in range(0, max(1, len(h) - SHINGLE + 1), STRIDE):
                hi = min(len(h), lo + STRIDE + most - 1)
                if hi - lo < SHINGLE:
                    continue
                votes, s, w = _votes(h[lo:hi], size[lo:hi])
                for n, windows in enumerate([index.passages, *index.whole]):
                    if not hasattr(windows, "fp"):
                        continue
                    fp = _fingerprints(votes, windows.size)[:STRIDE]
                    at = np.arange(lo, lo + len(fp))
                    inside = np.flatnonzero(which[at] == which[at + windows.size - 1])
                    if len(inside) and (got := _similar_windows(windows, fp, inside, s, w, similarity)):
                        held.setdefault(n, []).append((got[0] + lo, *got[1:]))
            out = _Found(index.window)
            for n, parts in held.items():
                at, j, sim, equal = (np.concatenate(x) for x in zip(*parts))
                d = which[at]
                if n:
                    out.whole(index.whole[n - 1], d, j, sim)
                    continue
                order = np.argsort(d, kind="stable")
                ends = np.r_[np.flatnonzero(np.diff(d[order])) + 1, len(d)]
                weight = np.cumsum(index.passages.owner_count[j[order]])
                a = 0
                while a < len(d):  # whole documents, about a million owners' windows at once
                    b = ends[np.searchsorted(ends, a, side="right") :]
                    b = int(b[max(0, int(np.searchsorted(weight[b - 1], weight[a] + 1_000_000, side="right")) - 1)])
                    x = order[a:b]
                    out.passages(index.passages, d[x], at[x], j[x], sim[x], equal[x])
                    a = b
            return [(docs[d], item, *row) for (d, item), row in out.rows.items()]

        def batch(rows):
            types = [pa.int64()] * 3 + [pa.float64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc", "item", "n_windows", "best_similarity", "run_words", "item_similarity"])

        docs, lengths, hs, sizes, held = [], [], [], [], 0
        for doc, text in C.frame_rows(it, "doc", "text"):
            found = C.words(text)
            if len(found) < SHINGLE or index.empty:
                continue
            docs.append(doc)
            lengths.append(len(found))
            hs.append(np.fromiter(map(cache.__getitem__, found), np.uint64, len(found)))
            sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            held += len(found)
            if held >= STRIDE:
                yield batch(scan(docs, lengths, np.concatenate(hs), np.concatenate(sizes)))
                docs, lengths, hs, sizes, held = [], [], [], [], 0
        if docs:
            yield batch(scan(docs, lengths, np.concatenate(hs), np.concatenate(sizes)))

    return match
