"""Files that nobody wrote by hand: generated, minified, vendored, data saved as code.

Clusters decide where they can. Code becomes tokens with masked identifiers, and shingles
of five of them are MinHashed, banded and verified, at two levels:

* statements of a file (lines; long lines in stretches). A file most of whose tokens are in
  one statement family repeats a template: a generator's output, or data if the family
  is made of literals;
* files. Families are the connected components of similar files. One of templated files
  within a repository is a generator's output and takes its members along; a file that is
  in a cluster across repositories with a known third-party file, and much like that, or
  that is contained in one, is a copy of it.

A file that belongs to no such cluster can still show its origin by its layout (one
endless line), by how its tool or library signed it, or by its path. ``evidence`` says
what decided.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import common as C
from siftspark.session import cut_lineage

#: Extensions that hold prose or configuration, never source.
PROSE = ("md", "markdown", "rst", "txt", "text", "json", "yaml", "yml", "toml", "ini", "cfg", "csv", "xml", "html")
GENERATED_PATH = r"/(generated|gen|__generated__|_generated|autogen|codegen_out|auto_generated)/|[._](pb|pb2|pb2_grpc|generated|gen|autogen|designer|g)\.(d\.)?\w+$|\.(tab|yy|lex)\.[ch]\w*$|\.pb-c\.[ch]$|(Grpc|OuterClass)\.java$"
VENDORED_PATH = r"(^|/)(third_party|thirdparty|third-party|3rdparty|extern|external|externals|deps|vendor|vendored|bundled|node_modules|bower_components|site-packages)/|/[A-Za-z]\w*-\d+(\.\d+)+/"
MINIFIED_PATH = r"\.(min|prod|bundle)\.(js|css|mjs)$|[.\-](?=[0-9a-f]*\d)[0-9a-f]{6,16}\.(js|css|mjs)$"
_COMMENT = r"^\s*(?://|#|--|/\*+!?|\*|;|<!--|%|\"\"\")\s*"
#: How tools sign their output, in the languages of the collection.
GENERATED_SIGNS = (
    r"auto(?:matically)?[- ]?generated (?:by|file|from)\b",
    r"code generated by\b.*do not edit",
    r"@generated\b",
    r"<auto-?generated\b",
    r"generated (?:from|by) \S+",
    r"(?:this|the) (?:file|code) (?:is|was) (?:\w+ )?(?:generated|produced|created|written) by\b",
    r"(?:-\*- )?output of \S+ v?\d",
    r"machine[- ](?:written|generated|made)\b",
    r"(?:automatisch|maschinell) (?:erzeugt|generiert)\b",
    r"(?:fichier|code) (?:créé|généré|produit) (?:par|automatiquement)\b",
    r"(?:archivo|fichero|código) (?:generado|creado) (?:por|automáticamente)\b",
    r"(?:arquivo|código) (?:gerado|criado) (?:por|pel[ao]|automaticamente)\b",
    r"(?:plik |kod )?wygenerowan\w+ (?:przez|automatycznie)\b",
    r"(?:файл|код) (?:создан|сгенерирован)|сгенерировано\b",
    r"自动生成|由\s?\S{1,30}\s?(?:自动)?生成",
)
GENERATED_HEAD = re.compile(_COMMENT + "(?:" + "|".join(GENERATED_SIGNS) + ")", re.I | re.M)
VENDORED_HEAD = re.compile(
    _COMMENT + r"(?:licensed under the .{1,30}licen[cs]e by the \w+ authors|imported unchanged from\b|[\w.\-]+ v?\d+(?:\.\d+)+ (?:\| )?\(c\)|home page of \w+:|upstream:\s*https?://)",
    re.I | re.M,
)
#: Length of a machine-made line, and shares that decide; a template is repeated at least so often.
LONG_LINE, LONG_SHARE, TEMPLATE_SHARE, LITERAL_SHARE, LEAST_STATEMENTS = 250, 0.6, 0.6, 0.8, 8
#: Masked tokens of a line from which it is cut into stretches, and of a stretch.
LONG_STATEMENT, STRETCH = 64, 16
#: Lines of a file that are taken together; a larger file counts as several parts.
PART_LINES = 16_384
SHINGLE, BINS, ROWS = 5, 64, 4
SIMILAR, CONTAINED = 0.8, 0.8
#: Similarity of masked sets to that of a third-party file of another repository, and the least size of such a set: names say nothing here.
ALIKE, LEAST_MASKED = 0.9, 40
#: Members of a bucket that are compared at once; larger buckets are cut into such cells. 64-bit words of a parity bitmap.
CELL, PARITY = 32_768, 8
#: Nearest candidates of a file that are verified in the first round of its family, and how many times more in each further one.
#: Candidates that a task holds at once; cells are smaller in rounds of many candidates a file.
NEAREST, WIDER, HELD = 4, 16, 1 << 22

_STRING = re.compile(rb"\"[^\"\n]*\"|'[^'\n]*'")
#: Byte classes: a letter or underscore, 0 digit, 0 byte blank, line feed and signs themselves.
_TABLE = np.zeros(256, np.uint8)
for _b in range(256):
    _c = chr(_b)
    _TABLE[_b] = 97 if _c == "_" or _b >= 128 or _c.isalpha() else 48 if _c.isdigit() else 10 if _b == 10 else 0 if _c.isspace() else _b


class Masked:
    """Masked tokens of many texts at once.

    ``tokens``: one byte each, ``a`` for names, ``0`` for numbers, a quote for strings, other
    signs themselves. ``line`` of each token, ``text`` of each line, ``size`` of each line
    in bytes and ``names``, those of them that belong to names.
    """

    def __init__(self, texts: list[str]) -> None:
        raw = "\n".join(texts).encode("utf-8", "replace")
        ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        self.size = np.diff(np.r_[-1, ends, len(raw)]) - 1
        self.text = np.repeat(np.arange(len(texts)), [x.count("\n") + 1 for x in texts]) if texts else np.empty(0, np.int64)
        if b'"' in raw or b"'" in raw:
            raw = _STRING.sub(b'"', raw)
        kind = _TABLE[np.frombuffer(raw, np.uint8)]
        at = np.cumsum(kind == 10) - (kind == 10)
        word = (kind == 97) | (kind == 48)
        first = np.r_[True, ~(word[1:] & word[:-1])][: len(kind)]  # a run of letters and digits is one token, named by its first
        begun = np.maximum.accumulate(np.where(first, np.arange(len(kind)), 0))
        self.names = np.bincount(at[word & (kind[begun] == 97)], minlength=len(self.size))
        keep = first & (kind != 0)
        kind, at = kind[keep], at[keep]
        sign = np.flatnonzero((kind[1:-1] == 45) & (kind[2:] == 48) & ~np.isin(kind[:-2], (97, 48, 41, 93))) + 1
        keep = kind != 10
        keep[sign] = False  # the sign of a number is part of it
        self.tokens, self.line = kind[keep], at[keep]

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, 32-bit hash) of the distinct runs of five tokens of each text, in order of both."""
        v = packed(self.tokens)
        owner = self.text[self.line]
        inside = owner[: len(v)] == owner[SHINGLE - 1 :] if len(v) else np.empty(0, bool)
        return distinct(owner[: len(v)][inside], (C.mix64(v[inside]) >> np.uint64(32)).astype(np.uint32))

    def statements(self):
        """(text, mask, tokens, share of its line's bytes, of its line's name bytes) of each statement."""
        n = np.bincount(self.line, minlength=len(self.size))
        start = np.cumsum(n) - n
        pos = np.arange(len(self.line)) - start[self.line]
        cut = np.flatnonzero((pos == 0) | ((n[self.line] > LONG_STATEMENT) & (pos % STRETCH == 0)))
        raw, ends, lines = self.tokens.tobytes(), np.r_[cut[1:], len(self.tokens)], self.line[cut]
        part = (ends - cut) / np.maximum(1, n[lines])
        masks = [raw[a:b] for a, b in zip(cut.tolist(), ends.tolist())]
        return self.text[lines].tolist(), masks, (self.size[lines] * part).tolist(), (self.names[lines] * part).tolist()


def packed(tokens: np.ndarray) -> np.ndarray:
    """Runs of five tokens as numbers, one per place."""
    t = tokens.astype(np.uint64)
    n = max(0, len(t) - SHINGLE + 1)
    v = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        v = (v << np.uint64(8)) | t[i : i + n]
    return v


def distinct(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, hash) without repeats, in order of both."""
    both = C.sorted_distinct((owner.astype(np.uint64) << np.uint64(32)) | h.astype(np.uint64))
    return (both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.uint32)


#: Odd multipliers of the twelve hash functions of statements; two make a band.
_TURNS = np.array([(0xD6E8FEB86659FD93 * (2 * i + 1)) & 0xFFFFFFFFFFFFFFFF | 1 for i in range(12)], np.uint64)


def statement_family(masks: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Indices of the statements of the family that holds most tokens.

    ``masks`` are distinct. Equal masks are similar without more; others are candidates if
    they agree in a band of two MinHashes, and belong together if their shingle sets are
    similar. Statements of fewer than five tokens are like none but their equals. No
    family is sought where neither equal nor all longer statements could make up TEMPLATE_SHARE.
    """
    size = np.array([len(m) for m in masks])
    weight = size * counts
    top = int(weight.argmax())
    whole = weight.sum()
    long = np.flatnonzero(size >= SHINGLE)
    if weight[top] >= TEMPLATE_SHARE * whole or weight[long].sum() < TEMPLATE_SHARE * whole:
        return np.array([top])
    v = packed(np.frombuffer(b"".join(masks[i] for i in long), np.uint8))
    ends = np.cumsum(size[long])
    begin = ends - size[long]
    here = np.repeat(np.arange(len(long)), size[long] - SHINGLE + 1)
    n = size[long] - SHINGLE + 1
    at = np.arange(len(here)) - np.repeat(np.cumsum(n) - n, n) + begin[here]
    h = C.mix64(v[at])
    low = np.minimum.reduceat(C.mix64(h[None] * _TURNS[:, None]), np.cumsum(n) - n, axis=1)
    bands = low[0::2] * np.uint64(0x9E3779B97F4A7C15) + low[1::2]
    sets, root = {}, list(range(len(long)))

    def of(i: int) -> set:
        if i not in sets:
            k = int(np.searchsorted(here, i))
            sets[i] = set(h[k : k + n[i]].tolist())
        return sets[i]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    heavy = np.argsort(-weight[long], kind="stable")
    for band in bands:
        order = heavy[np.argsort(band[heavy], kind="stable")]
        cuts = np.flatnonzero(np.r_[True, band[order][1:] != band[order][:-1], True])
        several = np.flatnonzero(np.diff(cuts) > 1)
        for a, b in zip(cuts[several].tolist(), cuts[several + 1].tolist()):
            rest = order[a:b].tolist()
            while len(rest) > 1:  # against the heaviest; those that are not like it are tried against the next
                head, left = rest[0], []
                for i in rest[1:]:
                    if find(i) != find(head):
                        both = len(of(head) & of(i))
                        if both >= SIMILAR * (len(of(head)) + len(of(i)) - both):
                            root[find(i)] = find(head)
                        else:
                            left.append(i)
                rest = left
    roots = np.array([find(i) for i in range(len(long))])
    total = np.bincount(roots, weights=weight[long], minlength=len(long))
    best = int(total.argmax())
    return long[roots == best] if total[best] >= weight[top] else np.array([top])


def signature(s: np.ndarray) -> np.ndarray:
    """One-permutation MinHash; an empty bin takes the value of the next filled one."""
    bins = np.full(BINS, 0xFFFFFFFF, np.uint32)
    h = (s * np.uint32(0x9E3779B1)).astype(np.uint32)
    np.minimum.at(bins, h >> np.uint32(26), h & np.uint32(0x3FFFFFF))
    full = bins != 0xFFFFFFFF
    if not full.all() and full.any():
        at = np.flatnonzero(full)
        nxt = at[np.searchsorted(at, np.arange(BINS)) % len(at)]
        bins = bins[nxt] + (nxt != np.arange(BINS)).astype(np.uint32) * np.uint32(0x4000000)
    return bins


def band_keys(s: np.ndarray, salt: int) -> list[int]:
    sig = signature(s)
    return [xxhash.xxh3_64_intdigest(sig[i : i + ROWS].tobytes(), seed=salt + i) - (1 << 63) for i in range(0, BINS, ROWS)]


#: A bundler's reference to the map of what it bundled.
_SOURCE_MAP = re.compile(r"^\s*(?://|/\*)# sourceMappingURL=", re.M)
_FLAGS = ("mapped", "gen_head", "ven_head")
FACTS = "rel_path string, part int, tokens double, family_tokens double, family_size int, family_literal double, chars long, long_chars long, mapped boolean, gen_head boolean, ven_head boolean, masked binary, plain binary"


def _part(it):
    """One row per chunk: its statements by mask, its shingle sets, its long lines and signatures."""
    cache = C.WordHashes()
    for batch in it:
        texts = batch.column("text").to_pylist()
        m = Masked(texts)
        held: list[dict] = [{} for _ in texts]
        for i, mask, size, names in zip(*m.statements()):
            row = held[i].get(mask)
            if row is None:
                held[i][mask] = [1, size, names]
            else:
                row[0] += 1
                row[1] += size
                row[2] += names
        owner, masked = m.shingles()
        rows, h, bounds = C.batch_shingles(texts, SHINGLE, cache, SHINGLE)
        of, plain = distinct(np.repeat(np.array(rows, np.int64), np.diff(bounds)), (h >> np.uint64(32)).astype(np.uint32))
        slices = [np.searchsorted(x, np.arange(len(texts) + 1)) for x in (owner, of)]
        long = [sum(len(x) for x in t.split("\n") if len(x) > LONG_LINE and (x.isascii() or len(x.encode("utf-8", "replace")) < 1.5 * len(x))) if len(t) > LONG_LINE else 0 for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("rel_path"), batch.column("part"), pa.array([len(t) for t in texts], pa.int64()), pa.array(long, pa.int64()),
                *(pa.array([bool(p.search(t)) for t in texts], pa.bool_()) for p in (_SOURCE_MAP, GENERATED_HEAD, VENDORED_HEAD)),
                pa.array([b"\n".join(x) for x in held], pa.binary()), pa.array([np.array(list(x.values()), np.float32).tobytes() for x in held], pa.binary()),
                *(pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for x, cut in zip((masked, plain), slices)),
            ],
            ["rel_path", "part", "chars", "long_chars", *_FLAGS, "masks", "counts", "masked", "plain"],
        )


def _merge(it):
    """One row per part of a file, from its chunks, which follow each other."""
    names = [x.split()[0] for x in FACTS.split(", ")]
    types = [pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), *[pa.bool_()] * 3, pa.binary(), pa.binary()]
    now, out = None, []

    def close():
        key, chars, long, flags, held, masked, plain = now
        masks = list(held)
        facts = (0.0, 0.0, 0, 0.0)
        if masks:
            sums = np.array([held[x] for x in masks])
            tokens = sums[:, 0] * [len(x) for x in masks]
            best = statement_family(masks, sums[:, 0])
            facts = (float(tokens.sum()), float(tokens[best].sum()), int(sums[best, 0].sum()), float(1 - sums[best, 2].sum() / max(1.0, sums[best, 1].sum())))
        union = lambda x: C.sorted_distinct(np.concatenate(x)).tobytes()
        return (*key, *facts, chars, long, *flags, union(masked), union(plain))

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    for rows in it:
        for path, part, chars, long, f0, f1, f2, masks, counts, masked, plain in zip(*(rows.column(i).to_pylist() for i in range(rows.num_columns))):
            if now is None or now[0] != (path, part):
                if now is not None:
                    out.append(close())
                    if len(out) >= 500:
                        yield batch()
                        out = []
                now = [(path, part), 0, 0, [False] * 3, {}, [], []]
            now[1] += chars
            now[2] += long
            now[3] = [a or b for a, b in zip(now[3], (f0, f1, f2))]
            for mask, row in zip(masks.split(b"\n") if masks else (), np.frombuffer(counts, np.float32).reshape(-1, 3).tolist()):
                have = now[4].setdefault(mask, [0.0, 0.0, 0.0])
                for i in range(3):
                    have[i] += row[i]
            for k, s in ((5, masked), (6, plain)):
                now[k].append(np.frombuffer(s, np.uint32))
                if len(now[k]) >= 256:
                    now[k] = [C.sorted_distinct(np.concatenate(now[k]))]
    if now is not None:
        out.append(close())
    if out:
        yield batch()


def _facts(chunks: DataFrame) -> DataFrame:
    """One row per part of a source file (FACTS); parts are stretches of PART_LINES lines, so a row is bounded."""
    rows = chunks.withColumn("part", F.floor(F.greatest(F.col("start_line"), F.lit(0)) / PART_LINES).cast("int")).select("rel_path", "part", "text")
    made = rows.mapInArrow(_part, "rel_path string, part int, chars long, long_chars long, mapped boolean, gen_head boolean, ven_head boolean, masks binary, counts binary, masked binary, plain binary")
    return made.repartition("rel_path", "part").sortWithinPartitions("rel_path", "part").mapInArrow(_merge, FACTS)


def _compare(pairs: DataFrame, sets: DataFrame, column: str, contained: bool, least: float, others: DataFrame | None = None) -> DataFrame:
    """Pairs ``a, b`` whose sets are similar enough (or a contained in b, one of ``others``), verified exactly."""
    kind = dict(pairs.dtypes)["a"]
    left = sets.select(F.col("rel_path").alias("a"), F.col(column).alias("set_a"))
    right = (others or sets).select(F.col("rel_path").alias("b"), F.col(column).alias("set_b"))

    def verify(it):
        for batch in it:
            ok = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist()):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                n = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(n >= least * (len(x) if contained else len(x) + len(y) - n) and n > 0)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])

    return pairs.join(left, "a").join(right, "b").mapInArrow(verify, f"a {kind}, b {kind}, ok boolean").where("ok").select("a", "b")


def parity(s: np.ndarray) -> np.ndarray:
    """Bitmap of the parities of hashed counts: two differ in no more bits than the sets in elements."""
    at = (s * np.uint32(0x85EBCA6B)).astype(np.uint32) >> np.uint32(23)
    return np.packbits(np.bincount(at, minlength=64 * PARITY).astype(np.uint8) & 1).view(np.uint64)


def _may_be_similar(n: np.ndarray, bits: np.ndarray, split: int, label: np.ndarray, least: float):
    """(i, j, distance) of the pairs of unlike labels that sizes and bitmaps allow: of all pairs if ``split`` is 0, else of those across it. Sizes ascend on either side."""
    right = np.arange(split, len(n))
    for at in range(0, split or len(n), 64):
        left = np.arange(at, min(at + 64, split or len(n)))
        cols = right[np.searchsorted(n[right], least * n[left[0]] - 1e-6) : np.searchsorted(n[right], n[left[-1]] / least + 1e-6, side="right")]
        if not split:
            cols = cols[cols > at]
        most = ((1 - least) * (n[left][:, None] + n[cols][None, :]) + 1e-6) / (1 + least)
        apart = np.zeros((len(left), len(cols)), np.uint16)
        for w in range(PARITY // 2):
            apart += np.bitwise_count(bits[left, w][:, None] ^ bits[cols, w][None, :])
        i, j = np.nonzero(apart <= most)  # the other half of the bitmap only for these
        most, apart, i, j = most[i, j], apart[i, j], left[i], cols[j]
        for w in range(PARITY // 2, PARITY):
            apart += np.bitwise_count(bits[i, w] ^ bits[j, w])
        x, y = n[i], n[j]
        ok = (apart <= most) & (np.minimum(x, y) >= least * np.maximum(x, y) - 1e-6) & (label[i] != label[j])
        if not split:
            ok &= i < j
        yield i[ok], j[ok], (apart[ok].astype(np.int64) << 16) // (x[ok] + y[ok])


def _nearest(files: DataFrame, most: int, least: float) -> DataFrame:
    """``id, others, more``: the up to ``most`` nearest files of another label that may be similar and share a bucket, and whether there are more.

    Buckets of more than CELL members are sorted by size and cut, and pairs of cells
    whose sizes allow a similar pair are compared each on its own.
    """
    cell = min(CELL, max(64, HELD // most))
    rows = files.select("id", "n", "bits", "label", F.explode("bands").alias("band"))
    columns = ["band", "i", "j", "cell", "n", "id", "label", "bits"]
    one = lambda df: df.select("band", *[F.lit(0).alias(c) for c in ("i", "j", "cell")], "n", "id", "label", "bits")
    hot = cut_lineage(files.select(F.explode("bands").alias("band")).groupBy("band").agg(F.count("*").alias("k")).where(F.col("k") > cell).select("band"))
    if hot.limit(1).count():
        placed = C.running(rows.join(hot, "band", "left_semi"), ["band"], [F.col("n"), F.col("id")])
        placed = cut_lineage(placed.withColumn("cell", F.floor(F.col("_before") / cell).cast("int")).drop("_before"))
        cells = placed.groupBy("band", "cell").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        first = cells.select("band", F.col("cell").alias("i"), F.col("hi").alias("most"))
        blocks = first.join(cells.select("band", F.col("cell").alias("j"), "lo"), "band").where((F.col("i") <= F.col("j")) & (F.col("lo") * least <= F.col("most") + 1e-6))
        shares = blocks.select("band", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("cell"))
        shared = one(rows.join(hot, "band", "left_anti")).union(placed.join(shares, ["band", "cell"]).select(*columns))
    else:
        shared = one(rows)

    def best(owner, other, d, ids):
        """The first ``most`` and one more of each owner."""
        order = np.lexsort((ids[other], d, owner))
        owner, other, d = owner[order], other[order], d[order]
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        keep = np.arange(len(owner)) - np.repeat(start, np.diff(np.r_[start, len(owner)])) <= most
        return owner[keep], other[keep], d[keep]

    def near(it):
        for group in _groups(it, ("band", "i", "j")):
            label = group.column("label").to_numpy()
            if (label == label[0]).all():
                continue
            n, cell = group.column("n").to_numpy().astype(np.int64), group.column("cell").to_numpy()
            order = np.lexsort((n, cell))
            n, cell, label, ids = n[order], cell[order], label[order], group.column("id").to_numpy()[order]
            bits = np.frombuffer(b"".join(group.column("bits").to_pylist()), np.uint64).reshape(-1, PARITY)[order]
            pend, held = [], 0
            for x, y, d in _may_be_similar(n, bits, int(np.searchsorted(cell, cell[-1])) if cell[0] != cell[-1] else 0, label, least):
                if len(x):
                    pend.append((np.r_[x, y], np.r_[y, x], np.r_[d, d]))
                    held += 2 * len(x)
                    if held > HELD:
                        pend, held = [best(*map(np.concatenate, zip(*pend)), ids)], 0
            if pend:
                owner, other, d = best(*map(np.concatenate, zip(*pend)), ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids[owner]), pa.array(ids[other]), pa.array(d)], ["id", "other", "d"])

    found = shared.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(near, "id long, other long, d long")
    lists = found.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("d", "other"))).alias("near"))
    return lists.select("id", F.transform(F.slice("near", 1, most), lambda x: x["other"]).alias("others"), (F.size("near") > most).alias("more"))


def _groups(it, keys: tuple[str, ...]):
    """Tables of the rows of equal keys from batches sorted by them."""
    pend, last = [], None
    for batch in it:
        k = np.stack([batch.column(c).to_numpy() for c in keys], 1)
        cuts = np.r_[0, np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, len(k)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if pend and tuple(k[a]) != last:
                yield pa.Table.from_batches(pend).combine_chunks()
                pend = []
            last = tuple(k[a])
            pend.append(batch.slice(a, b - a))
    if pend:
        yield pa.Table.from_batches(pend).combine_chunks()


def _components(edges: DataFrame) -> DataFrame:
    """``v, root``: the least name that is reachable, by hash-min with pointer jumping until nothing changes."""
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        heard = both.join(labels.select(F.col("v").alias("b"), "root"), "b").groupBy(F.col("a").alias("v")).agg(F.min("root").alias("near"))
        step = labels.join(heard, "v").select("v", "root", F.least("root", "near").alias("hop"))
        far = labels.select(F.col("v").alias("hop"), F.col("root").alias("jump"))
        new = cut_lineage(step.join(far, "hop", "left").select("v", F.col("root").alias("old"), F.least("hop", F.coalesce("jump", "hop")).alias("root")))
        changed = new.where("old <> root").limit(1).count()
        labels = new.select("v", "root")
        if not changed:
            return labels


def _described(sets: DataFrame) -> DataFrame:
    """``rel_path, masked`` with an ``id``, the number of shingles, their bitmap and bands."""

    def describe(it):
        for batch in it:
            held = [np.frombuffer(s, np.uint32) for s in batch.column("masked").to_pylist()]
            made = [pa.array([len(s) for s in held], pa.int32()), pa.array([parity(s).tobytes() for s in held], pa.binary()), pa.array([band_keys(s, 1) for s in held], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("rel_path"), batch.column("masked"), *made], ["rel_path", "masked", "n", "bits", "bands"])

    made = sets.select("rel_path", "masked").mapInArrow(describe, "rel_path string, masked binary, n int, bits binary, bands array<long>")
    return cut_lineage(made.withColumn("id", F.monotonically_increasing_id()))


def _families(facts: DataFrame) -> DataFrame:
    """``rel_path, family``: files tied by similar masked sets, directly or over others.

    Equal sets are compared once, which also ties files of too few shingles for bands. Of the
    pairs that share a bucket and may be similar, a first round verifies the nearest few of each
    file; files with more are taken on, with more pairs each round, but only pairs that are
    not tied yet. A pair that is never verified thus lies within one family: the families
    are those of all pairs, while the pairs follow the number of files.
    """
    named = facts.where(F.length("masked") > 0).select("rel_path", F.md5("masked").alias("set"))
    same = cut_lineage(named.join(named.groupBy("set").agg(F.min("rel_path").alias("rep")), "set").select("rel_path", "rep"))
    sets = facts.select("rel_path", "masked").where(F.length("masked") >= 32).join(same.where("rel_path = rep").select("rel_path"), "rel_path", "left_semi")

    files = _described(sets)
    rest, labels, most = files.withColumn("label", F.col("id")), None, NEAREST
    while True:
        near = cut_lineage(_nearest(rest, most, SIMILAR))
        pairs = near.select("id", F.explode("others").alias("other")).select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
        ties = _compare(pairs, rest.select(F.col("id").alias("rel_path"), "masked"), "masked", False, SIMILAR)
        labels = _components(ties if labels is None else ties.union(labels.where("v <> root").select("v", "root")))
        more = near.where("more").select("id")
        if not more.limit(1).count():
            break
        rest = cut_lineage(rest.drop("label").join(more, "id", "left_semi").join(labels.withColumnRenamed("v", "id"), "id", "left").select("id", "masked", "n", "bits", "bands", F.coalesce("root", "id").alias("label")))
        most *= WIDER
    tied = files.select("id", "rel_path").join(labels.withColumnRenamed("v", "id"), "id")
    roots = tied.join(tied.groupBy("root").agg(F.min("rel_path").alias("family")), "root").select(F.col("rel_path").alias("rep"), "family")
    return same.join(roots, "rep", "left").select("rel_path", F.coalesce("family", "rep").alias("family"))


def _across(sets: DataFrame, families: DataFrame, seeds: DataFrame, asked: DataFrame) -> DataFrame:
    """``rel_path`` of the files of ``asked`` whose masked set is to ALIKE that of a seed of another repository, whatever its names.

    Such files are in one family, so each is compared within its family, with its nearest seeds
    first and, until one is enough, with more of them each round.
    """
    tied = families.join(seeds.select("rel_path", F.lit(1).alias("label")).union(asked.join(seeds, "rel_path", "left_anti").select("rel_path", F.lit(0))), "rel_path")
    mixed = tied.groupBy("family").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("family")
    tied = cut_lineage(tied.join(mixed, "family", "left_semi").select("rel_path", "label", F.xxhash64("family").alias("family"), F.regexp_extract("rel_path", r"^([^/]+)/", 1).alias("repo")))
    wide = sets.where(F.length("masked") >= 4 * LEAST_MASKED).join(tied.select("rel_path"), "rel_path", "left_semi")
    rest, most, found = _described(wide).drop("bands").join(tied, "rel_path").withColumn("bands", F.array("family")), NEAREST, None
    rest = cut_lineage(rest)
    while True:
        near = cut_lineage(_nearest(rest, most, ALIKE).join(rest.where("label = 0").select("id", "repo"), "id"))
        of = rest.where("label = 1").select(F.col("id").alias("b"), F.col("repo").alias("repo_b"))
        pairs = near.select(F.col("id").alias("a"), "repo", F.explode("others").alias("b")).join(of, "b").where("repo <> repo_b").select("a", "b")
        ids = _compare(pairs, rest.select(F.col("id").alias("rel_path"), "masked"), "masked", False, ALIKE).select(F.col("a").alias("id")).distinct()
        ids = cut_lineage(rest.join(ids, "id", "left_semi").select("id", "rel_path"))
        found = ids if found is None else found.union(ids)
        more = cut_lineage(near.where("more").select("id").join(ids, "id", "left_anti"))
        if not more.limit(1).count():
            return found.select("rel_path")
        rest = cut_lineage(rest.where("label = 0").join(more, "id", "left_semi").unionByName(rest.where("label = 1")))
        most *= WIDER


def _copies(plain: DataFrame, seeds: DataFrame) -> DataFrame:
    """``rel_path`` of the files of ``plain`` contained in a seed other than themselves, whichever it is.

    Equal sets are one class, looked up once. A file contained to the share CONTAINED
    shares one at least of its rarest 1 - CONTAINED shingles and one more with that seed,
    so those are looked up in whole lists of the seeds. Files of which fewer shingles
    occur in any seed, by a sketch that never counts too low, need no lookup. Files of fewer
    than 8 shingles say too little to be parts and are copies only of files with the same set.
    """
    named = cut_lineage(plain.where(F.length("plain") > 0).select("rel_path", F.md5("plain").alias("set")).join(seeds.select("rel_path", F.lit(True).alias("seed")), "rel_path", "left"))
    classes = cut_lineage(named.groupBy("set").agg(F.max("seed").alias("seed"), F.count("*").alias("k"), F.min("rel_path").alias("rel_path")))
    equal = classes.where("seed and k > 1").select("set")
    reps = plain.where(F.length("plain") >= 32).join(classes.select("rel_path", "seed"), "rel_path")
    seeds = cut_lineage(reps.where("seed").drop("seed"))
    rest = reps.drop("seed")
    n_seeds, size = seeds.agg(F.count("*"), F.coalesce(F.sum(F.length("plain") / 4), F.lit(0))).first()
    if not n_seeds:
        return named.join(equal, "set", "left_semi").select("rel_path")
    bits = C.sketch_bits(int(size), 4)  # counters: four a shingle
    spread = lambda s: C.mix64(s.astype(np.uint64))

    def hashes(it):
        for batch in it:
            for s in batch.column("plain").to_pylist():
                yield spread(np.frombuffer(s, np.uint32))

    codes = rest.sparkSession.sparkContext.broadcast(C.compact(C.counting_sketch(seeds.select("plain"), hashes, bits)))

    def rare(it):
        for batch in it:
            paths, out = [], []
            for path, s in zip(batch.column("rel_path").to_pylist(), batch.column("plain").to_pylist()):
                s = np.frombuffer(s, np.uint32)
                count = C.lookup(codes.value, bits, spread(s))
                need = int(np.ceil(CONTAINED * len(s) - 1e-6))
                if np.count_nonzero(count) < need:
                    continue
                first = np.argsort(count, kind="stable")[: len(s) - need + 1]
                paths.append(path)
                out.append(s[first[count[first] > 0]].view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(out, pa.list_(pa.int32()))], ["a", "shingles"])

    def whole(it):
        for batch in it:
            out = [np.frombuffer(s, np.uint32).view(np.int32) for s in batch.column("plain").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rel_path"), pa.array(out, pa.list_(pa.int32()))], ["b", "shingles"])

    asked = cut_lineage(rest.mapInArrow(rare, "a string, shingles array<int>"))
    lists = seeds.mapInArrow(whole, "b string, shingles array<int>").select("b", F.explode("shingles").alias("shingle"))
    pairs = asked.select("a", F.explode("shingles").alias("shingle")).join(lists, "shingle").where("a <> b").select("a", "b").distinct()
    known = rest.join(asked.select(F.col("a").alias("rel_path")), "rel_path", "left_semi")
    parts = _compare(pairs, known, "plain", True, CONTAINED, seeds).select(F.col("a").alias("rel_path")).distinct()
    found = classes.join(parts, "rel_path", "left_semi").select("set").union(equal).distinct()
    return named.join(found, "set", "left_semi").select("rel_path")


def _unit(facts: DataFrame) -> DataFrame:
    """Parts as files of their own: the first has the file's path, others a number after a NUL."""
    return facts.withColumn("file", F.col("rel_path")).withColumn("rel_path", F.when(F.col("part") == 0, F.col("rel_path")).otherwise(F.concat("rel_path", F.lit("\0"), "part")))


def not_hand_written(files: DataFrame, chunks: DataFrame, signatures: bool = True) -> DataFrame:
    """``rel_path, kind, evidence, family_size``: one row per file that was not written by hand.

    ``kind`` is ``generated``, ``minified``, ``vendored`` or ``data``; ``evidence`` is
    ``family`` (a cluster of statements or files), ``layout``, ``header`` or ``path``, the first
    of these that decides. ``family_size`` counts the files of the repository in the file's family.
    Without ``signatures``, paths and headers are evidence for nothing (copies of
    third-party files are then not known as such). Prose and configuration formats are
    never listed, nor files of size 0. Null texts give no evidence, null sizes and
    languages none either; repeated rows of a chunk and overlapping chunks do not
    change shares much and sets not at all.
    """
    prose = F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)).isin(*PROSE)
    by_language = F.coalesce(F.lower(F.col("language")).isin("markdown", "rst", "text", "json", "yaml"), F.lit(False))
    source = files.where(F.col("rel_path").isNotNull() & ~prose & ~by_language & (F.coalesce(F.col("size"), F.lit(1)) > 0)).select("rel_path").distinct()
    texts = chunks.where(F.col("text").isNotNull() & F.col("rel_path").isNotNull() & ~prose & ~by_language).select("rel_path", F.coalesce(F.col("start_line"), F.lit(1)).alias("start_line"), "text")
    parts = cut_lineage(_unit(_facts(texts)))
    whole = parts.groupBy(F.col("file").alias("rel_path")).agg(
        *[F.sum(c).alias(c) for c in ("tokens", "family_tokens", "chars", "long_chars")], F.sum("family_size").alias("statements"), F.max_by("family_literal", "family_tokens").alias("family_literal"), *[F.max(c).alias(c) for c in _FLAGS]
    )
    slash = F.concat(F.lit("/"), F.col("rel_path"))
    told = lambda c: F.coalesce(c, F.lit(False)) if signatures else F.lit(False)
    templated = F.coalesce((F.col("family_tokens") >= TEMPLATE_SHARE * F.col("tokens")) & (F.col("statements") >= LEAST_STATEMENTS), F.lit(False))
    known = source.join(whole, "rel_path", "left").select(
        "rel_path",
        F.regexp_extract("rel_path", r"^([^/]+)/", 1).alias("repo"),
        (templated & (F.col("family_literal") >= LITERAL_SHARE)).alias("literal_only"), F.coalesce(F.col("long_chars") >= LONG_SHARE * F.col("chars"), F.lit(False)).alias("dense"), templated.alias("templated"),
        told(slash.rlike(GENERATED_PATH)).alias("gen_path"), told(slash.rlike(VENDORED_PATH)).alias("ven_path"), told(slash.rlike(MINIFIED_PATH) | F.coalesce("mapped", F.lit(False))).alias("min_path"),
        told(F.col("gen_head")).alias("gen_head"), told(F.col("ven_head")).alias("ven_head"),
    )
    families = cut_lineage(_families(parts))
    family = cut_lineage(known.join(families, "rel_path", "left").withColumn("family", F.coalesce("family", "rel_path")))
    machine = (F.col("templated") | F.col("gen_path") | F.col("gen_head")).cast("int")
    in_repo = family.groupBy("family", "repo").agg(F.count("*").alias("family_size"), F.avg(machine).alias("machine_share"), F.avg(F.col("literal_only").cast("int")).alias("literal_share"), F.max(F.col("templated").cast("int")).alias("any_templated"))

    # Clusters with a known third-party file: copies of it, and itself if it has a copy.
    third = family.where("ven_path or ven_head").select(F.col("rel_path").alias("file"))
    sets = parts.select("rel_path", "file", "masked", "plain")
    seeds = cut_lineage(sets.select("rel_path", "file").join(third, "file", "left_semi").select("rel_path"))
    held = cut_lineage(_copies(sets.select("rel_path", "plain"), sets.select("rel_path", "plain").join(seeds, "rel_path", "left_semi")).distinct())
    asked = sets.select("rel_path", "file").join(family.where("not (literal_only or dense or templated)").select(F.col("rel_path").alias("file")), "file", "left_semi").select("rel_path").join(held, "rel_path", "left_anti")
    held = held.union(_across(sets, families, seeds, asked)).distinct()
    of = held.join(parts.select("rel_path", "file", "chars"), "rel_path").groupBy("file").agg(F.sum("chars").alias("copied_chars"))
    copies = of.join(whole.select(F.col("rel_path").alias("file"), "chars"), "file").where(F.col("copied_chars") >= CONTAINED * F.col("chars")).select(F.col("file").alias("rel_path"), F.lit(True).alias("copied"))

    judged = family.join(in_repo, ["family", "repo"]).join(copies, "rel_path", "left")
    generated_family = (F.col("family_size") > 1) & (F.col("machine_share") > 0.5) & (F.col("any_templated") == 1)
    rules = [
        (F.col("literal_only") | (F.col("literal_share") > 0.5), "data", "family"),
        (F.col("dense"), "minified", "layout"),
        (F.col("templated") | generated_family, "generated", "family"),
        (F.col("copied"), "vendored", "family"),
        (F.col("min_path"), "minified", "path"),
        (F.col("gen_head"), "generated", "header"),
        (F.col("gen_path"), "generated", "path"),
        (F.col("ven_head"), "vendored", "header"),
        (F.col("ven_path"), "vendored", "path"),
    ]
    verdict = F.coalesce(*[F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(evidence).alias("evidence"))) for when, kind, evidence in rules])
    return judged.withColumn("_v", verdict).where("_v is not null").select("rel_path", F.col("_v.kind").alias("kind"), F.col("_v.evidence").alias("evidence"), "family_size")
