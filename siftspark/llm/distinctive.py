"""Distinctive terms: saturating, length-normalised relevance weights per record.

weight(t, d) = idf(t) * tf / (tf + k1 * (1 - b + b * len(d) / avg_len)) with
idf(t) = ln(1 + (N - df + 0.5) / (df + 0.5)).
N counts the distinct records with a text; lengths and frequencies count words
(maximal runs of letters, digits and underscores, lower-cased).
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm import common as C
from siftspark.session import cut_lineage

#: Terms a task holds before it hands on its partial document frequencies.
HELD_TERMS = 400_000


def _first_of_each(it):
    """(id, text) of each id once; all rows of an id are in one partition."""
    seen = set()
    for rid, text in C.frame_rows(it, "id", "text"):
        if rid not in seen:
            seen.add(rid)
            yield rid, text


def distinctive_terms(df: DataFrame, id_col: str, text_col: str, *, k1: float = 1.5, b: float = 0.75, least_tf: int = 1) -> DataFrame:
    """``<id>, term, tf, df, doc_len, weight``: one row per record and distinct word.

    Rows with a null id or text give nothing; repeated rows of an id count once;
    a text without words gives no row but counts in N. ``least_tf`` leaves out rows
    of rarer terms before they are moved (statistics still count them).
    """
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null").repartition("id")

    def vocabulary(it):
        held: Counter = Counter()
        docs = total = 0

        def batch(counts, n, w):
            terms = [None, *counts]
            return pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([n, *counts.values()], pa.int64()), pa.array([w] + [0] * len(counts), pa.int64())],
                ["term", "df", "words"],
            )

        for _, text in _first_of_each(it):
            found = C.words(text)
            docs += 1
            total += len(found)
            held.update(set(found))
            if len(held) > HELD_TERMS:
                yield batch(held, 0, 0)
                held = Counter()
        yield batch(held, docs, total)

    # The row without a term carries the number of records and of words.
    vocab = cut_lineage(base.mapInArrow(vocabulary, "term string, df long, words long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")))
    corpus = vocab.where("term is null").agg(F.max("df").alias("n_docs"), F.max("words").alias("n_words"))

    def postings(it):
        ids, terms, tfs, lens = [], [], [], []
        for rid, text in _first_of_each(it):
            found = C.words(text)
            kept = [(t, c) for t, c in Counter(found).items() if c >= least_tf]
            ids += [rid] * len(kept)
            terms += [t for t, _ in kept]
            tfs += [c for _, c in kept]
            lens += [len(found)] * len(kept)
            if len(ids) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(lens, pa.int64())], ["id", "term", "tf", "doc_len"])
                ids, terms, tfs, lens = [], [], [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(lens, pa.int64())], ["id", "term", "tf", "doc_len"])

    rows = base.withColumn("id", F.col("id").cast("string")).mapInArrow(postings, "id string, term string, tf long, doc_len long")
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("doc_len") * F.col("n_docs") / F.col("n_words"))
    idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    return (
        rows.join(vocab.where("term is not null").select("term", "df"), "term")
        .crossJoin(F.broadcast(corpus))  # one row
        .select(F.col("id").alias(id_col), "term", "tf", "df", "doc_len", (idf * F.col("tf") / (F.col("tf") + norm)).alias("weight"))
    )
