"""Near-duplicate records: exact set-similarity self-join with set-relation skipping.

Records become sets of word shingles. Equal sets form one class, so copies are
joined once and expanded only in the answer. The join follows the prefix filter:
with all shingles in one global order (rarest first), two sets of similarity t
share a shingle among their first ``n - ceil(t*n) + 1``.

* Index-level skipping. The inverted list of a shingle is ordered by set size
  and position and cut into blocks; a pair of blocks whose sizes or positions
  cannot reach the needed overlap is skipped as a whole, without touching its
  entries.
* Answer-level skipping. Probing sets are ordered so that highly similar ones
  (same least hash) follow each other. For the second and later sets of
  such a run the overlap with a partner is derived from the first one's answer:
  ``|S'&B| = |S&B| - |(S-S')&B| + |(S'-S)&B|``; only the small differences are
  looked up.

The global order comes from a counting sketch over all rows. It has a bounded
size; an inexact count only makes the prefix a little less selective. A shingle is a
56-bit hash below its 8-bit count code, so one sort gives a set and its order; "exact"
means up to collisions of such hashes. A list longer than CELL by the sketch is cut into as
many groups as that takes, and every pair of groups is joined on its own. Candidates
are first held against the parity bitmaps of their sets, which bound the overlap from
above (two sets differ in at least as many elements as their bitmaps in bits).
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import common as C

BLOCK = 64
#: Longest list kept in one cell; longer ones are split into cells of group pairs.
CELL = 4096
#: Members of a class that are expanded at once.
MEMBERS = 2048
#: Bits of the parity bitmap of a set.
BITMAP = 256


def needed_overlap(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Least overlap of sets of sizes a and b at Jaccard num/den (integers, exact)."""
    s = (a.astype(np.int64) + b) * num
    d = num + den
    return (s + d - 1) // d


def pairs_in_lists(key: np.ndarray, n: np.ndarray, pos: np.ndarray, num: int, den: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within equal runs of ``key`` that pass size and position bounds.

    Entries of a run are ordered by (n, pos). Runs are cut into blocks; block pairs
    are tested by their least and greatest size and least position first.
    """
    total = len(key)
    if total < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[starts, total])
    keep = lengths > 1
    starts, lengths = starts[keep], lengths[keep]
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    nblocks = -(-lengths // block)
    run = np.repeat(np.arange(len(starts)), nblocks)
    first = np.cumsum(nblocks) - nblocks
    b0 = starts[run] + (np.arange(len(run)) - first[run]) * block
    b1 = np.minimum(b0 + block, (starts + lengths)[run])
    least, most = n[b0], n[b1 - 1]
    reach = n - pos  # at most this many shingles from here on
    cover = np.zeros(len(b0), np.int64)
    # greatest reach per block; blocks do not touch rows of dropped runs
    bounds = np.empty(2 * len(b0), np.int64)
    bounds[0::2], bounds[1::2] = b0, b1
    cover = np.maximum.reduceat(np.r_[reach, 0], bounds)[0::2]
    out_i, out_j = [], []
    alive = np.arange(len(b0))
    d = 0
    while len(alive):
        other = alive + d
        ok = other < len(b0)
        alive, other = alive[ok], other[ok]
        ok = run[alive] == run[other]
        ok &= least[other].astype(np.int64) * num <= most[alive].astype(np.int64) * den  # sizes only grow with d
        alive, other = alive[ok], other[ok]
        go = np.minimum(cover[alive], cover[other]) >= needed_overlap(least[alive], least[other], num, den)
        for lo in range(0, int(go.sum()), 2048):
            x, y = alive[go][lo : lo + 2048], other[go][lo : lo + 2048]
            la, lb = b1[x] - b0[x], b1[y] - b0[y]
            cells = la * lb
            at = np.repeat(np.arange(len(x)), cells)
            k = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
            i, j = b0[x][at] + k // lb[at], b0[y][at] + k % lb[at]
            fit = i < j
            i, j = i[fit], j[fit]
            fit = n[j].astype(np.int64) * num <= n[i].astype(np.int64) * den
            fit &= np.minimum(reach[i], reach[j]) >= needed_overlap(n[i], n[j], num, den)
            out_i.append(i[fit])
            out_j.append(j[fit])
        d += 1
    if not out_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_i), np.concatenate(out_j)


class SkippingVerifier:
    """Overlaps of probing sets with partners, derived from a similar set's answers."""

    def __init__(self) -> None:
        self.relation = None
        self.leader: np.ndarray | None = None
        self.answers: dict[bytes, int] = {}
        self.member = None
        self.gone = self.new = None
        self.derived = self.computed = 0

    @staticmethod
    def _inside(few: np.ndarray, many: np.ndarray) -> int:
        at = np.searchsorted(many, few)
        at[at == len(many)] = 0
        return int((many[at] == few).sum()) if len(many) else 0

    def overlap(self, relation: int, a_key: bytes, a: np.ndarray, b_key: bytes, b: np.ndarray) -> int:
        if relation != self.relation:
            self.relation, self.leader, self.answers, self.member = relation, a, {}, a_key
            self.gone = self.new = None
        elif a_key != self.member:
            self.member = a_key
            self.gone = np.setdiff1d(self.leader, a, assume_unique=True)
            self.new = np.setdiff1d(a, self.leader, assume_unique=True)
        if self.gone is not None and b_key in self.answers and len(self.gone) + len(self.new) < len(a):
            self.derived += 1
            return self.answers[b_key] - self._inside(self.gone, b) + self._inside(self.new, b)
        self.computed += 1
        got = self._inside(a, b)
        if self.gone is None and len(self.answers) < 100_000:
            self.answers[b_key] = got
        return got


def _slices(weights: np.ndarray, most: int = 2_000_000) -> list[tuple[int, int]]:
    """Bounds of stretches of at most that weight, or of single rows."""
    total = np.cumsum(weights)
    out, a = [], 0
    while a < len(weights):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        out.append((a, b))
        a = b
    return out


def near_duplicate_classes(
    df: DataFrame, id_col: str, text_col: str, group_col: str | None = None, *, width: int = 5, threshold: float = 0.8, min_words: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the exact similarity self-join.

    members: ``id, grp, cls, chk`` - one row per record that has at least
    ``min_words`` words (default: ``width``), with the class of its shingle set.
    links: ``cls_a, chk_a, cls_b, chk_b`` - pairs of different classes whose
    Jaccard similarity is at least ``threshold``.

    Null and too short texts belong to no class and have no links; repeated rows
    are members once. Columns other than the named ones are not read.
    """
    spark = df.sparkSession
    share = Fraction(str(threshold))
    num, den = share.numerator, share.denominator
    least_words = max(width, min_words or width)
    base = df.select(
        F.col(id_col).cast("string").alias("id"),
        (F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")).alias("grp"),
        F.col(text_col).alias("text"),
    ).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    bits = C.sketch_bits(df.count(), 100)

    def all_hashes(it):
        cache = C.WordHashes()
        for batch in it:
            yield C.batch_shingles(batch.column("text").to_pylist(), width, cache, least_words)[1]

    counts = C.counting_sketch(base.select("text"), all_hashes, bits)
    floor = int(np.median(counts))  # what chance adds to every counter of a full sketch
    sketch = spark.sparkContext.broadcast(C.compact(counts))
    del counts

    def keyed(texts, cache):
        """(rows, sorted distinct keys end to end, bounds) of the texts with enough words; key = count and hash."""
        rows, h, bounds = C.batch_shingles(texts, width, cache, least_words)
        if not rows:
            return rows, h, bounds
        key = (C.code_of(sketch.value, bits, h).astype(np.uint64) << np.uint64(56)) | (h >> np.uint64(8))
        ends = bounds.tolist()
        for a, b in zip(ends, ends[1:]):
            key[a:b].sort()
        keep = np.r_[True, key[1:] != key[:-1]]
        keep[bounds[:-1]] = True
        return rows, key[keep], np.r_[0, np.cumsum(np.add.reduceat(keep, bounds[:-1], dtype=np.int64))]

    def index(it):
        """Prefix entries of each class that this task has not met yet."""
        cache, seen = C.WordHashes(), set()
        for batch in it:
            rows, key, bounds = keyed(batch.column("text").to_pylist(), cache)
            if not rows:
                continue
            ends, name, fresh = bounds.tolist(), [], np.ones(len(rows), bool)
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                digest = xxhash.xxh3_128_digest(key[a:b])
                name.append(digest[:8])
                if digest in seen:
                    fresh[i] = False
                elif len(seen) < 500_000:
                    seen.add(digest)
            size = np.diff(bounds)
            at = np.repeat(np.arange(len(rows)), size)
            pos = np.arange(len(key)) - bounds[at]
            prefix = size - -(-size * num // den) + 1
            pick = (pos < prefix[at]) & (key >= np.uint64(2 << 56)) & fresh[at]  # what occurs once has no partner
            tok, at, pos = key[pick], at[pick], pos[pick]
            cls = np.frombuffer(b"".join(name), np.int64)[at]
            order = (size[at] << 32) | pos
            count = C.CODES[(tok >> np.uint64(56)).astype(np.int64)] - floor
            part = np.zeros(len(tok), np.int64)
            low, high = part, part
            if (count > CELL).any():  # a long list is cut into groups; each pair of groups is a cell
                groups = np.maximum(1, -(-count // CELL))
                part = (cls.view(np.uint64) % groups.astype(np.uint64)).astype(np.int64)
                for a, b in _slices(groups):
                    yield cells(tok[a:b], order[a:b], cls[a:b], part[a:b], groups[a:b])
                continue
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (C.signed(tok), order, cls, np.zeros(len(tok), np.int8))], ["list", "ord", "cls", "side"])

    def cells(tok, order, cls, part, groups):
        """Entries of each of the cells they take part in; ``side`` 1 and 2 where a cell joins two groups."""
        reps = np.repeat(np.arange(len(tok)), groups)
        other = np.arange(len(reps)) - np.repeat(np.cumsum(groups) - groups, groups)
        tok, cls, order, part = tok[reps], cls[reps], order[reps], part[reps]
        low, high = np.minimum(part, other).astype(np.uint64), np.maximum(part, other).astype(np.uint64)
        name = np.where(groups[reps] > 1, C.mix64(tok + low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)), tok)  # one list per cell
        side = np.where(low == high, 0, 1 + (part.astype(np.uint64) == high))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (C.signed(name), order, cls, side.astype(np.int8))], ["list", "ord", "cls", "side"])

    entries = base.select("text").mapInArrow(index, "list long, ord long, cls long, side byte")

    def probe(it):
        """Candidate pairs of the lists; a list may span batches."""
        names = ["list", "ord", "cls", "side"]
        held = None

        def pairs(lst, order, cls, side):
            new = np.r_[True, lst[1:] != lst[:-1]]
            i, j = pairs_in_lists(np.cumsum(new), order >> 32, order & 0xFFFFFFFF, num, den)
            a, b = cls[i], cls[j]
            ok = ((side[i] == 0) | (side[i] != side[j])) & (a != b)
            a, b = a[ok], b[ok]
            pq = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pq[:, 0])), pa.array(np.ascontiguousarray(pq[:, 1]))], ["a", "b"])

        for batch in it:
            cols = [batch.column(x).to_numpy(zero_copy_only=False) for x in names]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            if not len(cols[0]):
                continue
            open_ = cols[0] == cols[0][-1]
            last = int(np.flatnonzero(~open_)[-1]) + 1 if not open_.all() else 0
            if last:
                yield pairs(*(c[:last] for c in cols))
            held = [c[last:] for c in cols]
        if held is not None and len(held[0]):
            yield pairs(*held)

    lists = entries.repartition("list").sortWithinPartitions("list", "ord")
    candidates = _cut(lists.mapInArrow(probe, "a long, b long").distinct())

    # A bitmap of the candidate classes, of bounded size: only these need more than a name.
    def classes(it):
        for batch in it:
            both = np.unique(np.concatenate([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
            yield np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) for x in both), np.uint64, len(both))

    hot = spark.sparkContext.broadcast(np.packbits(C.counting_sketch(candidates, classes, bits) > 0))

    def describe(it):
        """Class of every record; of candidates also size, relation (least hash) and parity bitmap."""
        cache, bitmap = C.WordHashes(), hot.value
        for batch in it:
            ids, grps = batch.column("id").to_pylist(), batch.column("grp").to_pylist()
            out = []
            rows, key, bounds = keyed(batch.column("text").to_pylist(), cache)
            ends = bounds.tolist()
            for row, lo, hi in zip(rows, ends, ends[1:]):
                s = key[lo:hi]
                digest = xxhash.xxh3_128_digest(s)
                names = (ids[row], grps[row], int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True))
                at = xxhash.xxh3_64_intdigest(digest[:8]) >> (64 - bits)
                if not bitmap[at >> 3] >> (7 - (at & 7)) & 1:
                    out.append((*names, None, None, None))
                    continue
                low = (s * np.uint64(0x9E3779B97F4A7C15)).min(keepdims=True)
                parity = np.packbits((np.bincount((s & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP) & 1).astype(np.uint8))
                out.append((*names, len(s), xxhash.xxh3_64_intdigest(np.sort(low)) - (1 << 63), parity.tobytes()))
            types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["id", "grp", "cls", "chk", "n", "rel", "parity"])

    described = _cut(base.mapInArrow(describe, "id string, grp string, cls long, chk long, n int, rel long, parity binary"))
    # One exchange by class serves every use of the members in a plan.
    members = described.select("id", "grp", "cls", "chk").repartition("cls", "chk").dropDuplicates()
    facts = described.where("parity is not null").groupBy("cls", "chk").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("rel").alias("rel"), F.max("parity").alias("parity"))
    facts = _cut(facts)
    side = lambda s: facts.select(*[F.col(c).alias(f"{c}_{s}") for c in facts.columns])
    told = candidates.join(side("a"), F.col("a") == F.col("cls_a")).join(side("b"), F.col("b") == F.col("cls_b"))

    def bounded(it):
        for batch in it:
            size = batch.column("n_a").to_numpy().astype(np.int64) + batch.column("n_b").to_numpy()
            x = np.frombuffer(b"".join(batch.column("parity_a").to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
            y = np.frombuffer(b"".join(batch.column("parity_b").to_pylist()), np.uint64).reshape(-1, BITMAP // 64)
            most = (size - np.bitwise_count(x ^ y).sum(1)) // 2
            fit = pa.array(most * (num + den) >= num * size)
            yield batch.select(["cls_a", "chk_a", "rel_a", "rep_a", "cls_b", "chk_b", "rep_b"]).filter(fit)

    kept = _cut(told.mapInArrow(bounded, "cls_a long, chk_a long, rel_a long, rep_a string, cls_b long, chk_b long, rep_b string"))

    # A bitmap of the representatives, of bounded size, tells which texts to read once more.
    def reps(it):
        for batch in it:
            names = batch.column("rep_a").to_pylist() + batch.column("rep_b").to_pylist()
            yield np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))

    wanted = spark.sparkContext.broadcast(np.packbits(C.counting_sketch(kept.select("rep_a", "rep_b"), reps, bits) > 0))

    def sets(it):
        cache, bitmap = C.WordHashes(), wanted.value
        for batch in it:
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            at = (xxhash.xxh3_64_intdigest(i) >> (64 - bits) for i in ids)
            pick = [k for k, x in enumerate(at) if bitmap[x >> 3] >> (7 - (x & 7)) & 1]
            rows, key, bounds = keyed([texts[k] for k in pick], cache)
            out = [(ids[pick[row]], key[lo:hi].tobytes()) for row, lo, hi in zip(rows, bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.binary())], ["rep", "set"])

    # Repeated rows of an id hold the same text.
    chosen = base.select("id", "text").mapInArrow(sets, "rep string, set binary")
    pick = kept.select(F.col("rep_a").alias("rep")).union(kept.select("rep_b")).distinct()
    chosen = _cut(chosen.join(pick, "rep", "left_semi").groupBy("rep").agg(F.max("set").alias("set")))
    joined = kept.join(chosen.select(F.col("rep").alias("rep_a"), F.col("set").alias("set_a")), "rep_a").join(chosen.select(F.col("rep").alias("rep_b"), F.col("set").alias("set_b")), "rep_b")

    def verify(it):
        check = SkippingVerifier()
        for batch in it:
            cols = [batch.column(c).to_pylist() for c in ("cls_a", "chk_a", "rel_a", "set_a", "cls_b", "chk_b", "set_b")]
            out = []
            for a, ka, rel, sa, b, kb, sb in zip(*cols):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                got = check.overlap(rel, (a, ka), x, (b, kb), y)
                if got * (num + den) >= num * (len(x) + len(y)):
                    out.append((a, ka, b, kb))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], ["cls_a", "chk_a", "cls_b", "chk_b"])

    # Range partitions split a large family by class; within one, similar sets follow each other.
    links = joined.repartitionByRange("rel_a", "cls_a").sortWithinPartitions("rel_a", "cls_a", "cls_b").mapInArrow(verify, "cls_a long, chk_a long, cls_b long, chk_b long")
    return members, _cut(links)


def _cut(df: DataFrame) -> DataFrame:
    from siftspark.session import cut_lineage

    return cut_lineage(df)


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, group_col: str, **options) -> DataFrame:
    """Pairs ``<id>_a < <id>_b`` of records of different groups that are near duplicates.

    Links between classes are expanded by their members, and classes by themselves. The
    members of a class are cut into groups of MEMBERS, and each pair of groups is expanded
    on its own, so no task holds the pairs of a large class. (``near_duplicate_groups``
    says the same without expanding copies.)
    """
    members, links = near_duplicate_classes(df, id_col, text_col, group_col, **options)
    key = ["cls", "chk"]
    sizes = _cut(members.groupBy(*key).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"), (F.count("*") > 1).alias("several")))
    placed = members.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    side = lambda s: placed.select(*[F.col(c).alias(f"{c}_{s}") for c in ("id", "grp", *key, "part")])
    count = lambda s: sizes.select(*[F.col(c).alias(f"{c}_{s}") for c in (*key, "parts")])
    cells = lambda n: F.sequence(F.lit(0), n - 1)
    across = links.join(count("a"), ["cls_a", "chk_a"]).join(count("b"), ["cls_b", "chk_b"])
    across = across.withColumn("part_a", F.explode(cells(F.col("parts_a")))).withColumn("part_b", F.explode(cells(F.col("parts_b")))).drop("parts_a", "parts_b")
    within = sizes.where("several").withColumn("part_a", F.explode(cells(F.col("parts")))).withColumn("part_b", F.explode(F.sequence("part_a", F.col("parts") - 1)))
    within = within.select(F.col("cls").alias("cls_a"), F.col("chk").alias("chk_a"), F.col("cls").alias("cls_b"), F.col("chk").alias("chk_b"), "part_a", "part_b")
    both = across.select(*within.columns).unionByName(within).join(side("a"), ["cls_a", "chk_a", "part_a"]).join(side("b"), ["cls_b", "chk_b", "part_b"])
    pairs = both.where("id_a <> id_b and not (grp_a <=> grp_b)")
    return pairs.select(F.least("id_a", "id_b").alias(f"{id_col}_a"), F.greatest("id_a", "id_b").alias(f"{id_col}_b")).distinct()


def near_duplicate_links(df: DataFrame, id_col: str, text_col: str, group_col: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of class representatives and who belongs to which class, nothing expanded.

    pairs: ``rep_a < rep_b``, the least ids of two different texts that are near duplicates.
    members: ``<id>, rep``, one row per record with enough words.
    """
    members, links = near_duplicate_classes(df, id_col, text_col, group_col, **options)
    reps = _cut(members.groupBy("cls", "chk").agg(F.min("id").alias("rep")))
    side = lambda s: reps.select(*[F.col(c).alias(f"{c}_{s}") for c in reps.columns])
    pairs = links.join(side("a"), ["cls_a", "chk_a"]).join(side("b"), ["cls_b", "chk_b"])
    return pairs.select(F.least("rep_a", "rep_b").alias("rep_a"), F.greatest("rep_a", "rep_b").alias("rep_b")), members.join(reps, ["cls", "chk"]).select(F.col("id").alias(id_col), "rep").distinct()


def near_duplicate_groups(df: DataFrame, id_col: str, text_col: str, group_col: str | None = None, **options) -> DataFrame:
    """One row per record: ``<id>, group_id, class_size, n_links``.

    ``group_id`` is the least class representative (least id of an equal text) reachable over links (connected component);
    ``class_size`` counts the records of the same text, ``n_links`` the other texts it is linked with. With
    ``group_col``, records of one group are not linked, whatever their texts. Records
    without words are their own group with no links. The component search repeats
    hash-min with pointer jumping over distributed tables until nothing changes.
    """
    members, links = near_duplicate_classes(df, id_col, text_col, group_col, **options)
    classes = _cut(members.groupBy("cls", "chk").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("class_size"), F.min(F.coalesce("grp", F.lit(""))).alias("lo"), F.max(F.coalesce("grp", F.lit(""))).alias("hi")))
    side = lambda s: classes.select(*[F.col(c).alias(f"{c}_{s}") for c in ("cls", "chk", "rep", "lo", "hi")])
    edges = links.join(side("a"), ["cls_a", "chk_a"]).join(side("b"), ["cls_b", "chk_b"])
    if group_col:
        edges = edges.where("not (lo_a = hi_a and lo_b = hi_b and lo_a = lo_b)")
    both = _cut(edges.select("rep_a", "rep_b").union(edges.select("rep_b", "rep_a")).distinct())
    labels = _cut(both.groupBy(F.col("rep_a").alias("v")).agg(F.least(F.min("rep_b"), F.first("rep_a")).alias("root")))
    while True:
        heard = both.join(labels.select(F.col("v").alias("rep_b"), "root"), "rep_b").groupBy(F.col("rep_a").alias("v")).agg(F.min("root").alias("near"))
        step = labels.join(heard, "v").select("v", "root", F.least("root", "near").alias("hop"))
        far = labels.select(F.col("v").alias("hop"), F.col("root").alias("jump"))
        new = _cut(step.join(far, "hop", "left").select("v", F.col("root").alias("old"), F.least("hop", F.coalesce("jump", "hop")).alias("root")))
        changed = new.where("old <> root").limit(1).count()
        labels = new.select("v", "root")
        if not changed:
            break
    degree = both.groupBy(F.col("rep_a").alias("v")).agg(F.count("*").alias("n_links"))
    facts = classes.join(labels.withColumnRenamed("v", "rep"), "rep", "left").join(degree.withColumnRenamed("v", "rep"), "rep", "left")
    tied = F.col("root").isNotNull() if group_col else F.lit(True)
    own = F.when(tied | (F.col("lo") < F.col("hi")), F.coalesce("root", "rep"))  # equal texts of one group alone are not tied
    known = members.select("id", "cls", "chk").distinct().join(facts, ["cls", "chk"]).select("id", own.alias("group_id"), "class_size", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    ids = df.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
    return ids.join(known, "id", "left").select(
        F.col("id").alias(id_col), F.coalesce("group_id", "id").alias("group_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
