"""Embeddings and exact nearest neighbours for a stated set of queries."""

from __future__ import annotations

import functools
import inspect
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from siftspark.operators.kept import KeptIds
from siftspark.session import cut_lineage

#: Queries held against all rows in one pass at most, and numbers in their vectors.
BLOCK, NUMBERS = 65_536, 1 << 24
#: Words whose features a worker keeps.
WORDS = 100_000
#: Rows and queries multiplied at once; pairs whose distance is taken exactly at once.
ROWS, QUERIES, PAIRS = 8192, 512, 4096


def l2_normalise(c):
    """Unit vector; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(c, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def hash_embedder(dim: int = 384) -> Callable[[list[str]], np.ndarray]:
    """Offline default: signed feature hashing of words and character trigrams, unit length.

    It carries spelling, not meaning; give a model's function in its place for that.
    """

    known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def word(said: str) -> tuple[np.ndarray, np.ndarray]:
        import xxhash

        features = [(said, 1.0), *((f"#{said[i : i + 3]}", 0.4) for i in range(max(1, len(said) - 2)))]
        hashes = [xxhash.xxh3_64_intdigest(f) for f, _ in features]
        made = np.array([h % dim for h in hashes], np.int64), np.array([w if h >> 63 else -w for h, (_, w) in zip(hashes, features)], np.float32)
        if len(known) >= WORDS:
            known.clear()
        known[said] = made
        return made

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in zip(out, texts):
            if words := [known.get(w) or word(w) for w in re.findall(r"\w+", text.lower())]:
                np.add.at(row, np.concatenate([at for at, _ in words]), np.concatenate([w for _, w in words]))  # one after the other
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


class ModelEmbedder:
    """A local ONNX encoder and its tokenizer file, loaded once per Python worker.

    The hidden states of the last layer are averaged over the tokens (``pool="mean"``) or
    taken at the first one (``"first"``). ``query_prefix`` goes before query texts, for
    models that tell questions and passages apart. Paths are on storage that executors see.
    """

    _loaded: dict = {}

    def __init__(self, model: str, tokenizer: str, pool: str = "mean", query_prefix: str = "", max_tokens: int = 512) -> None:
        self.model, self.tokenizer, self.pool, self.query_prefix, self.max_tokens = model, tokenizer, pool, query_prefix, max_tokens

    def _load(self):
        key = (self.model, self.tokenizer)
        if key not in self._loaded:
            import onnxruntime
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(self.tokenizer)
            tok.enable_truncation(self.max_tokens)
            tok.enable_padding()
            self._loaded[key] = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"]), tok
        return self._loaded[key]

    def __call__(self, texts: list[str], mode: str = "passage") -> np.ndarray:
        session, tok = self._load()
        said = tok.encode_batch([self.query_prefix + t for t in texts] if mode == "query" else texts)
        ids, mask = (np.array([getattr(e, k) for e in said], np.int64) for k in ("ids", "attention_mask"))
        known = {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros_like(ids)}
        hidden = session.run(None, {i.name: known[i.name] for i in session.get_inputs()})[0]
        out = hidden[:, 0] if self.pool == "first" else (hidden * mask[..., None]).sum(1) / np.maximum(1, mask.sum(1, keepdims=True))
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)


def embed(df: DataFrame, text_col: str, embedder: Callable[..., np.ndarray] | None = None, dim: int = 384, batch: int = 64, mode: str = "passage") -> DataFrame:
    """Adds ``vector``; empty and null texts are embedded as a blank.

    ``mode`` is ``passage`` or ``query``; an embedder that takes a ``mode`` is told.
    """
    make = embedder or hash_embedder(dim)
    if "mode" in inspect.signature(make).parameters:
        make = functools.partial(make, mode=mode)

    @F.pandas_udf("array<float>")
    def vector(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in series:
            said = [t or " " for t in texts]
            rows: list = []
            for i in range(0, len(said), batch):
                rows += list(np.asarray(make(said[i : i + batch]), np.float32))
            yield pd.Series(rows)

    return df.withColumn("vector", vector(F.col(text_col)))


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", row_id: str = "chunk_id", ordered: bool = False) -> DataFrame:
    """``<query>, <row>, distance, rank``: the k nearest rows by Euclidean distance, exactly.

    Queries are taken in blocks, of BLOCK or of NUMBERS numbers, against all rows. Each task keeps k rows per
    query; equal distances (six digits) are settled by the row id. Null vectors take no
    part; vectors of another length are an error. ``ordered``: the rows of every partition come in
    order of their ids (else they are sorted), in few partitions, since each sends k rows per query.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(row_id).alias("rid"), F.col("vector")).where("rid is not null")  # null vectors are left out by the scan: a filter would embed texts twice
    if not ordered:
        rows = rows.coalesce(2 * spark.sparkContext.defaultParallelism).sortWithinPartitions("rid")
    id_type = rows.schema["rid"].dataType.simpleString()
    asked = cut_lineage(queries.select(F.col(query_id).alias("qid"), F.col("vector")).where("qid is not null and vector is not null"))
    q_type = asked.schema["qid"].dataType.simpleString()
    found = None
    n_asked, numbers = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    n_blocks = max(1, -(-n_asked // BLOCK), -(-numbers // NUMBERS))
    for block in range(n_blocks):
        part = asked.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == block).toArrow()
        held = spark.sparkContext.broadcast((part["qid"].to_pylist(), _matrix(part["vector"].combine_chunks())))
        near = rows.mapInArrow(_scan(held, k), f"qid {q_type}, rid {id_type}, distance double")
        found = near if found is None else found.unionByName(near)
    order = W.partitionBy("qid").orderBy(F.round("distance", 6), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("qid").alias(query_id), F.col("rid").alias(row_id), "distance", "rank")


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = np.diff(column.offsets.to_numpy())
    width = int(sizes[0]) if width is None and len(sizes) else width or 0
    if (sizes != width).any():
        raise ValueError(f"vectors of {width} numbers are held against others")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), width)


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in their order, in blocks of ROWS."""
    parts, n = [], 0
    for batch in it:
        batch, at = batch.filter(batch.column("vector").is_valid()), 0
        while at < batch.num_rows:
            part = batch.slice(at, ROWS - n)
            parts.append(part)
            at, n = at + part.num_rows, n + part.num_rows
            if n == ROWS:
                yield pa.Table.from_batches(parts).combine_chunks()
                parts, n = [], 0
    if parts:
        yield pa.Table.from_batches(parts).combine_chunks()


def _scan(held, k: int):
    """Distances are told apart in single precision first; pairs within its error of a query's k best so far are taken exactly."""

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, every = held.value
        first: dict[bytes, int] = {}
        same = np.array([first.setdefault(v.tobytes(), len(first)) for v in every], np.int64)  # queries of equal vectors are compared once
        q = every[np.unique(same, return_index=True)[1]]
        dim = q.shape[1]
        q32 = np.ones((len(q), dim + 1), np.float32)
        q32[:, :dim] = q
        square = (q.astype(np.float64) ** 2).sum(1)
        best, which, ids = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64), KeptIds()
        for block in _batches(it):
            if not len(q):
                return
            x = _matrix(block["vector"], dim)
            own = (x.astype(np.float64) ** 2).sum(1)
            x32 = np.empty((dim + 1, len(x)), np.float32)
            x32[:dim], x32[dim] = x.T, -own / 2
            error = (dim + 8) * 1.3e-7 * (np.sqrt(square * own.max()) + own.max())
            for a in range(0, len(q), QUERIES):
                z = min(len(q), a + QUERIES)
                close = q32[a:z] @ x32  # the greater, the nearer
                least = (square[a:z] - (best[a:z, -1] + 1e-6) ** 2) / 2
                if len(x) > k and (which[a:z, -1] < 0).any():
                    least = np.maximum(least, np.partition(close, len(x) - k, axis=1)[:, len(x) - k] - error[a:z])
                at = np.flatnonzero(close >= (least - error[a:z])[:, None].astype(np.float32))
                if len(at):
                    _merge(best[a:z], which[a:z], q[a:z], x, *np.divmod(at, len(x)), ids.n)
            ids.add(block["rid"].combine_chunks() if not isinstance(c := block["rid"].combine_chunks(), pa.ChunkedArray) else pa.concat_arrays(c.chunks))
            which = ids.compact(which)
        if not ids.n:
            return
        names, asked = ids.all(), pa.array(qids)
        for a in range(0, len(qids), 4096):
            mine = same[a : a + 4096]
            row, place = np.nonzero(which[mine] >= 0)
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(a + row)), names.take(pa.array(which[mine[row], place])), pa.array(best[mine[row], place])], ["qid", "rid", "distance"])

    return scan


def _merge(best: np.ndarray, which: np.ndarray, q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, n_ids: int) -> None:
    """Rows ``j`` into the k best of queries ``i`` (ascending); of equal distances (six digits) those that came first stay."""
    exact = np.concatenate([np.sqrt(((x[j[a : a + PAIRS]].astype(np.float64) - q[i[a : a + PAIRS]]) ** 2).sum(1)) for a in range(0, len(i), PAIRS)])
    fit = np.round(exact, 6) < np.round(best[i, -1], 6)
    i, j, exact = i[fit], j[fit], exact[fit]
    touched, k = np.unique(i), best.shape[1]
    who = np.concatenate([np.repeat(touched, k), i])
    far, row = np.concatenate([best[touched].ravel(), exact]), np.concatenate([which[touched].ravel(), j + n_ids])
    order = np.lexsort((np.round(far, 6), who))
    start = np.searchsorted(who[order], touched)
    keep = order[start[:, None] + np.arange(k)]
    best[touched], which[touched] = far[keep], row[keep]
