"""Typo-tolerant expansion of query terms against the vocabulary.

The similarity of two words is twice their longest common subsequence over their
summed lengths (0-100). Where one is at least half as long again as the other, the best
such similarity of the shorter with a window of the longer counts, less a tenth.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftspark.functions import text as T

#: Unknown terms held against the vocabulary at once.
BLOCK = 8000


def _masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def lcs(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    masks = masks or _masks(a)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * lcs(a, b) / n if n else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter with a window of the longer: its length inside, less at the ends."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    n, best = len(s), 0.0
    if not n:
        return 0.0
    letters = set(s)
    for i in range(1 - n, len(t)):
        w = t[max(0, i) : min(len(t), i + n)]
        edge = w[-1] if i <= 0 and i + n <= len(t) else w[0]
        if (i < 0 or i + n > len(t)) and edge not in letters:
            continue  # such a window is no better than a shorter one
        best = max(best, ratio(s, w))
        if best == 100.0:
            break
    return best


def similarity(a: str, b: str) -> float:
    """Of two words without blanks, 0-100."""
    if not a or not b:
        return 0.0
    long, short = max(len(a), len(b)), min(len(a), len(b))
    r = ratio(a, b)
    if long < 1.5 * short:
        return r
    return max(r, partial_ratio(a, b) * (0.6 if long > 8 * short else 0.9))


def pieces(s: str, edits: int) -> list[str] | None:
    """The word in ``edits + 1`` pieces, as equal as can be; None if it has too few letters."""
    n = edits + 1
    if n > len(s):
        return None
    at = [len(s) * i // n for i in range(n + 1)]
    return [s[a:b] for a, b in zip(at, at[1:])]


def window_ratio(s: str, t: str, cuts: list[str], edits: int) -> float:
    """partial_ratio of the shorter ``s``, if no more than ``edits`` letters are left out in its best window; less otherwise.

    Such a window has a piece of ``cuts`` (the shorter word, in order) unbroken, moved by ``edits`` at most.
    """
    if s in t:
        return 100.0
    n, at, starts = len(s), 0, set()
    for x in cuts:
        j = t.find(x)
        while j >= 0:
            starts.update(range(max(1 - n, j - at - edits), min(len(t) - 1, j - at + edits) + 1))
            j = t.find(x, j + 1)
        at += len(x)
    masks, best = _masks(s), 0.0
    for i in starts:
        w = t[max(0, i) : i + n]
        best = max(best, 200.0 * lcs(s, w, masks) / (n + len(w)))
    return best


class _Scorer:
    """Terms prepared for many comparisons; finds the pairs that can reach the cut by parts of words, not one by one.

    Letters left out of the common subsequence, in either word, are at most a share of the
    lengths (``edits``), and each breaks at most one piece of a word cut into one piece more: one
    at least stands unbroken in the other word. Where the words as a whole are compared, it is
    moved by no more letters than are left out before and after it, so the pieces of a term are kept by
    the length of the word and their place in it. Where a window counts, a piece of the shorter stands anywhere in the longer.

    Pairs with such a piece are held to counts of letters (hashed to 32 kinds, which can only raise the number of
    common ones), whole blocks at once. Terms above LONG letters have too many pieces and skip the places.
    """

    KINDS = 32
    LONG = 32
    #: Words whose pairs are gathered at once.
    WORDS = 1000

    def __init__(self, terms: list[str], cut: float, keep: int | None = None) -> None:
        """``keep``: only the best so many of each term are wanted, and the words come in ascending order."""
        self.terms, self.cut, self.p, self.keep = terms, cut, cut / 0.9, keep
        self.best: list[list[float]] = [[] for _ in terms]
        self.floor = np.zeros(len(terms))  # similarity that a later word must exceed
        self.bags = self._bags(terms)
        self.sizes = np.array([len(t) for t in terms], np.int64)
        self._pieces = functools.lru_cache(200_000)(pieces)
        self.placed: dict[int, dict[str, list[int]]] = {}  # length of the word: place and piece: terms
        self.always: dict[int, list[int]] = {}  # length of the word: terms held against all such
        self.inside: dict[str, list[int]] = {}  # piece of a term that may stand in a window: terms
        self.loose: list[int] = []  # terms without enough letters for that
        self.parts: dict[int, dict[str, list[int]]] = {}  # length: part of a term: terms
        for i, (term, n) in enumerate(zip(terms, self.sizes.tolist())):
            for m in range(n * 2 // 3, n * 3 // 2 + 1):
                if m and max(n, m) < 1.5 * min(n, m) and min(n, m) >= cut * (m + n) / 200 - 1e-9:
                    self._place(i, term, n, m)
            if n and self.p <= 100:
                cuts = pieces(term, int(2 * n * (1 - self.p / 100) + 1e-9))
                for x in cuts or ():
                    self.inside.setdefault(x, []).append(i)
                if cuts is None:
                    self.loose.append(i)
        self.lengths = {m: sorted({len(x) - 1 for x in at}) for m, at in self.placed.items()}
        self.inside_lengths = sorted({len(x) for x in self.inside})

    def _place(self, i: int, term: str, n: int, m: int) -> None:
        edits = int((n + m) * (1 - self.cut / 100) + 1e-9)
        cuts = pieces(term, edits) if n <= self.LONG else None
        if cuts is None:
            self.always.setdefault(m, []).append(i)
            return
        at, keys = 0, set()
        for x in cuts:
            for j in range(max(0, at - edits), min(m - len(x), at + edits) + 1):
                if abs(j - at) + abs(m - n - (j - at)) <= edits:
                    keys.add(chr(j) + x)
            at += len(x)
        held = self.placed.setdefault(m, {})
        for key in keys:
            held.setdefault(key, []).append(i)

    def _parts(self, length: int) -> dict[str, list[int]]:
        if length not in self.parts:
            held: dict[str, list[int]] = {}
            for i, term in enumerate(self.terms):
                for x in {term[j : j + length] for j in range(len(term) - length + 1)}:
                    held.setdefault(x, []).append(i)
            self.parts[length] = held
        return self.parts[length]

    def _bags(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), self.KINDS), np.uint8)
        for row, w in zip(out, words):
            for c in w[:200]:
                row[ord(c) % self.KINDS] += 1
        return out

    def _near(self, word: str) -> list[int]:
        """Terms that share a piece with the word, some of them more than once."""
        m = len(word)
        got = list(self.always.get(m, ()))
        if held := self.placed.get(m):
            for size in self.lengths[m]:
                for j in range(m - size + 1):
                    got += held.get(chr(j) + word[j : j + size], ())
        if self.p <= 100:
            if 1.5 * self.least <= m <= 8 * self.most:
                got += self.loose
                for size in self.inside_lengths:
                    for j in range(m - size + 1):
                        got += self.inside.get(word[j : j + size], ())
            if 1.5 * m <= self.most:
                cuts = pieces(word, int(2 * m * (1 - self.p / 100) + 1e-9))
                got += range(len(self.terms)) if cuts is None else [i for x in cuts for i in self._parts(len(x)).get(x, ())]
        return got

    def block(self, words: list[str]) -> list[tuple[str, str, float]]:
        """(term, word, similarity) of the pairs that reach the cut."""
        words = [w for w in words if w]
        if not words or not self.terms:
            return []
        self.least, self.most = int(self.sizes.min()), int(self.sizes.max())
        out = []
        for a in range(0, len(words), self.WORDS):
            out += self._block(words[a : a + self.WORDS])
        return out

    def _block(self, words: list[str]) -> list[tuple[str, str, float]]:
        near_to = [self._near(w) for w in words]
        codes = np.repeat(np.arange(len(words)), [len(x) for x in near_to]) * len(self.terms) + np.array([i for x in near_to for i in x], np.int64)
        k, i = np.divmod(np.unique(codes), len(self.terms))
        m, n, p = np.array([len(w) for w in words], np.int64)[k], self.sizes[i], self.p
        long, short = np.maximum(m, n), np.minimum(m, n)
        near = long < 1.5 * short
        # common letters that the ratio needs; or a window of the longer, which has at most as many as its length
        least = np.where(near, self.cut * (m + n) / 200, p * short / (200 - p) if p <= 100 else np.inf)
        fit = np.flatnonzero((short >= least - 1e-9) & (near | (long <= 8 * short)) & (short > 0))
        bags, common = self._bags(words), np.empty(len(fit), np.int64)
        for a in range(0, len(fit), 1 << 18):
            some = fit[a : a + (1 << 18)]
            common[a : a + len(some)] = np.minimum(bags[k[some]], self.bags[i[some]]).sum(1, dtype=np.int64)
        most = np.where((m[fit] > 200) | (n[fit] > 200), 101.0, np.where(near[fit], 200.0 * common / (m + n)[fit], 90.0))
        fit = fit[((common >= least[fit] - 1e-9) | (m[fit] > 200) | (n[fit] > 200)) & (most > self.floor[i[fit]])]
        out = []
        for at, x, close in zip(k[fit].tolist(), i[fit].tolist(), near[fit].tolist()):
            word, term = words[at], self.terms[x]
            a, t = (term, word) if len(term) <= len(word) else (word, term)
            edits = int(((len(a) + len(t)) * (1 - self.cut / 100) if close else 2 * len(a) * (1 - p / 100)) + 1e-9)
            cut = self._pieces(a, edits)
            if not close and self.floor[x] >= 90 or cut is not None and not any(y in t for y in cut):
                continue
            s = ratio(a, t) if close else similarity(term, word) if cut is None else max(ratio(a, t) if self.cut <= 80 else 0.0, 0.9 * window_ratio(a, t, cut, edits))
            if s >= self.cut:
                out.append((term, word, s))
                if self.keep and term != word:
                    self.best[x] = sorted([*self.best[x], s], reverse=True)[: self.keep]
                    self.floor[x] = self.best[x][-1] if len(self.best[x]) == self.keep else 0.0
        return out


def unknown_terms(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """``query_id, pos, term``: identifiers of the queries that the vocabulary lacks."""
    said = queries.where("query_text is not null").select("query_id", F.posexplode(T.query_terms(F.col("query_text"))).alias("pos", "term"))
    return said.join(vocab.select(F.col("token").alias("term")).distinct(), "term", "left_anti").select("query_id", "pos", "term")


def candidates(terms: DataFrame, vocab: DataFrame, threshold: float = 82, per_term: int = 3) -> DataFrame:
    """``term, candidate, similarity, rank``: the best vocabulary words per distinct term.

    Terms are taken in blocks of BLOCK against the whole vocabulary, whose words come to a task in order. Ties go
    to the alphabetically first word, so a word that cannot exceed a task's best of a term is left.
    """
    spark = vocab.sparkSession
    wanted = terms.select("term").distinct()
    n_blocks = max(1, -(-wanted.count() // BLOCK))
    found = None
    words = vocab.select("token").distinct().repartition(spark.sparkContext.defaultParallelism).sortWithinPartitions("token")  # few bytes, much work
    for block in range(n_blocks):
        part = [r["term"] for r in wanted.where(F.pmod(F.xxhash64("term"), F.lit(n_blocks)) == block).collect()]  # about BLOCK terms
        held = spark.sparkContext.broadcast(part)

        def score(it, held=held):
            scorer = _Scorer(held.value, threshold, per_term)
            for batch in it:
                rows = [r for r in scorer.block(batch.column("token").to_pylist()) if r[0] != r[1]]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["term", "candidate", "similarity"])

        near = words.mapInArrow(score, "term string, candidate string, similarity double")
        found = near if found is None else found.unionByName(near)
    order = W.partitionBy("term").orderBy(F.desc("similarity"), "candidate")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_term)


def expand(queries: DataFrame, vocab: DataFrame, threshold: float = 82, per_term: int = 3, expand_stopwords: bool = True) -> DataFrame:
    """``query_id, term, candidate, similarity, rank``; a candidate of two terms is there twice.

    Stop words are unknown to the vocabulary and are expanded unless told otherwise.
    """
    terms = unknown_terms(queries, vocab)
    if not expand_stopwords:
        terms = terms.where(~F.col("term").isin(*T.STOPWORDS))
    best = candidates(terms, vocab, threshold, per_term)
    return terms.join(best, "term").select("query_id", "pos", "term", "candidate", "similarity", "rank")


def expanded_queries(queries: DataFrame, expansion: DataFrame) -> DataFrame:
    """Query texts with their candidates appended, the original kept."""
    more = expansion.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "rank", "candidate"))), lambda x: x["candidate"]).alias("_c"))
    return queries.join(more, "query_id", "left").select(
        "query_id", F.concat_ws(" ", F.col("query_text"), F.coalesce(F.col("_c"), F.array().cast("array<string>"))).alias("query_text")
    )
