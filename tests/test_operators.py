import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.operators import bm25, fusion, fuzzy, incremental, lifecycle, rag, vectors
from siftspark.streaming.ingest import ingest_stream


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_diff_purge_upsert(spark):
    s = "rel_path string, file_hash string"
    known = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("n", None)], s)
    now = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4"), ("n", "5")], s)
    changes = lifecycle.diff(known, now)
    assert rows(changes, "rel_path", "change") == [("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "new"), ("n", "changed")]
    assert rows(lifecycle.purge(known, lifecycle.to_purge(changes)), "rel_path") == [("a",)]
    assert rows(lifecycle.upsert(known, now, ["rel_path"]), "rel_path", "file_hash") == [("a", "1"), ("b", "9"), ("c", "3"), ("d", "4"), ("n", "5")]
    got = lifecycle.stats(changes, known, now).first()
    assert (got.scanned_files, got.new_files, got.changed_files, got.unchanged_files, got.removed_files, got.total_chunks, got.embedded_chunks) == (4, 1, 2, 1, 1, 4, 4)


def test_changed_per_run(spark):
    scans = spark.createDataFrame(
        [(1, "a", "x", 1), (1, "a", "x", 1), (1, "b", "y", 1), (2, "a", "z", 2), (3, "a", "x", 3), (3, "a", "w", 4), (3, "b", None, 3), (3, "c", "q", None), (5, "a", "w", 1), (5, "b", "y", 9), (None, "a", "x", 1)],
        "run_id long, rel_path string, file_hash string, t int",
    ).withColumns({"recorded_at": F.timestamp_seconds("t"), "size": F.length("rel_path"), "batch": F.lit("clash")})
    runs = spark.createDataFrame([(1, "ok"), (2, "failed"), (3, "ok"), (4, "aborted"), (5, "ok"), (5, "ok")], "run_id long, status string")
    got = incremental.changed_per_run(scans, runs)
    assert rows(got, "run_id", "rel_path") == [(1, "a"), (1, "b"), (3, "a"), (3, "c"), (5, "b")]
    assert incremental.changed_per_run(scans.limit(0), runs).count() == 0
    assert incremental.changed_per_run(scans, runs.limit(0)).count() == 0


def test_manifest_survives_failures(spark, tmp_path):
    s = "rel_path string, file_hash string"
    m = incremental.Manifest(spark, str(tmp_path / "m"))
    one = spark.createDataFrame([("a", "1"), ("b", "2"), ("x", None)], s)
    work = lambda df: df.select("rel_path")
    with pytest.raises(RuntimeError):
        m.run(1, one, lambda df: (_ for _ in ()).throw(RuntimeError()))
    assert m.batches() == [] and m.pending(one).count() == 2
    # a batch that wrote its output but did not commit is repeated, not doubled
    one.select("rel_path").write.parquet(str(tmp_path / "m/data/batch=1"))
    m.run(1, one, work)
    m.run(1, one, work)
    assert rows(m.output(), "rel_path", "batch") == [("a", 1), ("b", 1)]
    two = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], s)
    assert rows(m.pending(two), "rel_path") == [("b",), ("c",)]
    m.run(2, two, work)
    assert m.pending(two).count() == 0 and m.output().count() == 4
    assert rows(m.removed(two.where("rel_path <> 'a'")), "rel_path") == [("a",)]


def test_stream_of_listings(spark, tmp_path):
    s = "rel_path string, file_hash string"
    folder, m = str(tmp_path / "in"), incremental.Manifest(spark, str(tmp_path / "m"))
    for part in ([("a", "1"), ("b", "2")], [("b", "3"), ("a", "1")]):
        spark.createDataFrame(part, s).coalesce(1).write.mode("append").json(folder)
        q = ingest_stream(spark.readStream.schema(s).json(folder), m, lambda df: df, str(tmp_path / "cp"))
        assert q.awaitTermination(120)
    assert rows(m.output(), "rel_path", "file_hash", "batch") == [("a", "1", 0), ("b", "2", 0), ("b", "3", 1)]


def test_a_file_unreadable_once_is_not_processed_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental.Manifest, "COMPACT", 3)  # the manifest is compacted on the way
    s = "rel_path string, file_hash string, at int"
    folder, m = str(tmp_path / "in"), incremental.Manifest(spark, str(tmp_path / "m"))
    parts = [[("a", "1", 1), ("b", "2", 1)], [("a", None, 2), (None, "9", 2)], [("a", "1", 3), ("b", "2", 3)], [("a", "7", 5), ("a", "8", 4), ("a", "7", 5)], [("a", "7", 6), ("b", "3", 6)]]
    for part in parts:
        spark.createDataFrame(part, s).coalesce(1).write.mode("append").json(folder)
        q = ingest_stream(spark.readStream.schema(s).json(folder), m, lambda df: df.select("rel_path", "file_hash"), str(tmp_path / "cp"), "at")
        assert q.awaitTermination(120)
    assert rows(m.output(), "rel_path", "file_hash", "batch") == [("a", "1", 0), ("a", "7", 3), ("b", "2", 0), ("b", "3", 4)]
    assert rows(m.current(), "rel_path", "file_hash") == [("a", "7"), ("b", "3")]


def test_outputs_of_batches_may_differ_in_columns(spark, tmp_path):
    m = incremental.Manifest(spark, str(tmp_path / "m"))
    m.commit(1, spark.createDataFrame([("a", "1", 5)], "rel_path string, file_hash string, size int"), spark.createDataFrame([("a", 1)], "rel_path string, x int"))
    m.commit(2, spark.createDataFrame([("b", "1")], "rel_path string, file_hash string"), spark.createDataFrame([("b",)], "rel_path string"))
    m.commit(3, spark.createDataFrame([("b", "1")], "rel_path string, file_hash string"))
    (tmp_path / "m/commits/4.json.1.tmp").write_text('{"who')  # of a writer that died: does not count
    assert m.batches() == [1, 2, 3]
    assert sorted(map(tuple, m.output().collect())) == [("a", 1, 1), ("b", None, 2)]
    m.commit(4, spark.createDataFrame([("c", "1")], "rel_path string, file_hash string"))
    with pytest.raises(FileExistsError):
        m.log.add(4, {})
    assert m.batches() == [1, 2, 3, 4] and rows(m.current(), "rel_path", "size") == [("c", None)]


def test_keyword_search_and_padding(spark):
    chunks = spark.createDataFrame([("c1", "alpha beta beta"), ("c2", "alpha"), ("c3", None), ("c4", "the of"), ("c1", "alpha beta beta")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "the Beta alpha"), (2, ""), (3, None)], "query_id long, query_text string")
    index = bm25.KeywordIndex.build(chunks)
    assert index.corpus.first().n_docs == 4
    assert rows(index.search(asked, 5), "query_id", "rank", "chunk_id") == [(1, 1, "c1"), (1, 2, "c2")]
    assert rows(index.search(asked, 3, pad=True), "query_id", "rank", "chunk_id") == [(1, 1, "c1"), (1, 2, "c2"), (1, 3, "c3"), (2, 1, "c1"), (2, 2, "c2"), (2, 3, "c3"), (3, 1, "c1"), (3, 2, "c2"), (3, 3, "c3")]


def test_fuzzy_expansion(spark):
    vocab = spark.createDataFrame([("ingestion",), ("pipeline",), ("retriever",), ("them",)], "token string")
    asked = spark.createDataFrame([(1, "ingesion pipelin pipeline ingesion"), (2, "the"), (3, None)], "query_id long, query_text string")
    got = fuzzy.expand(asked, vocab)
    assert rows(got, "query_id", "pos", "candidate") == [(1, 0, "ingestion"), (1, 1, "pipeline"), (1, 3, "ingestion"), (2, 0, "them")]
    assert fuzzy.expand(asked, vocab, expand_stopwords=False).where("query_id = 2").count() == 0
    said = {r.query_id: r.query_text for r in fuzzy.expanded_queries(asked, got).collect()}
    assert said[1] == "ingesion pipelin pipeline ingesion ingestion pipeline ingestion"


def test_fusion_equals_a_plain_one(spark):
    r = random.Random(1)
    lists = {(q, s): r.sample(range(12), 7) for q in range(20) for s in (0, 1)}
    frame = lambda s: spark.createDataFrame([(q, f"c{d:02d}", i + 1) for (q, t), ids in lists.items() if t == s for i, d in enumerate(ids)], "query_id long, chunk_id string, rank int")
    got = {}
    for x in fusion.fuse_ranks(frame(0), frame(1), 60, 5).orderBy("query_id", "position").collect():
        got.setdefault(x.query_id, []).append(x.chunk_id)
    for q in range(20):
        score = {}
        for s in (0, 1):
            for i, d in enumerate(lists[q, s]):
                score[f"c{d:02d}"] = score.get(f"c{d:02d}", 0) + 1 / (61 + i)
        assert got[q] == sorted(score, key=lambda c: -score[c])[:5]


def test_hydration_drops_unknown_ids_after_the_cut(spark):
    fused = spark.createDataFrame([(1, 1, "gone", 0.5, 1, None), (1, 2, "c", 0.4, None, 1)], "query_id long, position int, chunk_id string, score double, bm25_rank int, vector_rank int")
    chunks = spark.createDataFrame([("c", "p", None, 1, 2, "t"), ("c", "p", None, 1, 2, "t")], "chunk_id string, rel_path string, language string, start_line int, end_line int, text string")
    assert rows(fusion.hydrate(fused, chunks), "position", "chunk_id") == [(2, "c")]


def test_lookup_moves_no_texts_of_other_chunks(spark, data):
    """The scan of the chunks' texts meets the broadcast ids before any exchange."""
    from siftspark.plans import catalogue

    plan = catalogue.hybrid_search(spark, data)._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [i for i, line in enumerate(plan) if "FileScan" in line and "text" in line and "chunks.parquet" in line]
    assert scans
    for i in scans:
        above, at = [], depth(plan[i])
        for line in reversed(plan[:i]):
            if depth(line) < at:
                at = depth(line)
                above.append(line)
        first = next(line for line in above if "Join" in line or "Exchange" in line)
        assert "BroadcastHashJoin" in first and "LeftSemi" in first


def test_stored_postings_are_sorted_and_pruned(spark, tmp_path):
    chunks = spark.range(3000).select(F.format_string("c%04d", "id").alias("chunk_id"), F.concat_ws(" ", F.format_string("w%03d", F.pmod("id", F.lit(700))), F.lit("common")).alias("text"))
    built = bm25.KeywordIndex.build(chunks)
    built.write(str(tmp_path / "i"))
    index = bm25.KeywordIndex.read(spark, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, "w123 w124"), (2, "common nothing")], "query_id long, query_text string")
    assert sorted(map(tuple, index.search(asked, 5).collect())) == sorted(map(tuple, built.search(asked, 5).collect()))
    plan = index.search(asked.where("query_id = 1"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(token,w123), LessThanOrEqual(token,w124)" in plan


def test_search_moves_no_pairs_of_query_and_chunk_and_is_exact(spark, tmp_path, monkeypatch):
    """Chunks of several blocks and queries of several passes, many of equal score, against a plain ranking."""
    monkeypatch.setattr(bm25, "BLOCK", 10, raising=False)
    r = random.Random(3)
    names = [f"w{i}" for i in range(30)]
    texts = {f"c{i:05d}": " ".join(r.choices(names, weights=range(1, 31), k=r.choice((3, 4, 40)))) for i in range(3000)}
    said = {q: " ".join(r.choices([*names, "absent"], k=1 + q % 4)) for q in range(40)}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string").repartition(3)
    asked = spark.createDataFrame([*said.items(), (98, said[3]), (99, "absent"), (100, "")], "query_id long, query_text string")
    index = bm25.KeywordIndex.build(chunks)
    found = index.search(asked, 7)
    assert not re.search(r"hashpartitioning\(query_id#\d+L, chunk_id#", found._jdf.queryExecution().executedPlan().toString())
    tf = {c: Counter(t.split()) for c, t in texts.items()}
    df, mean = Counter(w for x in tf.values() for w in x), sum(len(t.split()) for t in texts.values()) / len(texts)
    want = []
    for q, text in [*said.items(), (98, said[3])]:
        score = {c: sum(n * math.log(1 + (len(tf) - df[w] + 0.5) / (df[w] + 0.5)) * x[w] / (1.5 * (0.25 + 0.75 * x.total() / mean) + x[w]) for w, n in Counter(text.split()).items()) for c, x in tf.items()}
        best = sorted((c for c in score if score[c] > 0), key=lambda c: (-round(score[c], 9), c))[:7]
        want += [(q, i + 1, c, round(score[c], 6)) for i, c in enumerate(best)]
    plain = lambda x: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6)) for r in x.collect())
    assert plain(found) == sorted(want)
    index.write(str(tmp_path / "i"))
    assert plain(bm25.KeywordIndex.read(spark, str(tmp_path / "i")).search(asked, 7)) == sorted(want)


def test_fuzzy_search_moves_no_postings(spark, data, monkeypatch):
    """Neither for the vocabulary nor for the scores are rows moved by chunk and word, or by query and chunk, before the cut."""
    from siftspark.plans import catalogue

    plans, cut = [], bm25.cut_lineage
    monkeypatch.setattr(bm25, "cut_lineage", lambda df, *by: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, *by))
    assert catalogue.fuzzy_search(spark, data).groupBy("query_id").count().where("count <> 20").count() == 0
    assert any("posexplode" not in p and "explode(array_distinct(tokens" in p for p in plans)
    assert not any(re.search(r"hashpartitioning\((chunk_id#\d+, token|query_id#\d+L, chunk_id)#", p) for p in plans)


def test_terms_find_their_words_by_pieces(monkeypatch):
    """Equal to all pairs, whole or cut to the best of each term; few pairs are compared letter by letter."""
    r = random.Random(5)
    part = lambda: "".join(r.choices("abcdefgh", k=r.randint(2, 6)))
    words = sorted({"_".join(part() for _ in range(r.randint(1, 3))) for _ in range(700)} | {"x" * 40 + part() for _ in range(5)})
    terms = [w[:i] + r.choice("abc") + w[i + 1 :] for w in words[::12] for i in [r.randrange(len(w))]]
    want = sorted((t, w, s) for t in terms for w in words if max(len(t), len(w)) <= 8 * min(len(t), len(w)) and (s := fuzzy.similarity(t, w)) >= 82)
    calls, lcs = [], fuzzy.lcs
    monkeypatch.setattr(fuzzy, "lcs", lambda *a: calls.append(1) or lcs(*a))
    assert sorted(fuzzy._Scorer(terms, 82).block(words)) == sorted(want)
    assert len(calls) < 0.1 * len(terms) * len(words)
    best = lambda found, t: sorted((-s, w) for x, w, s in found if x == t and w != t)[:3]
    kept = fuzzy._Scorer(terms, 82, 3).block(words)
    assert len(kept) < len(want) and all(best(kept, t) == best(want, t) for t in set(terms))


def test_context_stops_at_the_first_block_that_does_not_fit(spark):
    s = "query_id long, position int, rel_path string, start_line int, end_line int, language string, text string"
    hits = spark.createDataFrame([(1, 1, "a", 1, 2, "text", "x"), (1, 2, "b", 1, 2, "go", "y" * 100), (1, 3, "c", 1, 2, "text", "z")], s)
    got = rag.bounded_context(hits, 100).first()
    assert got.context == "### a:1-2 (text)\n```\nx\n```" and got.n_blocks == 1
    assert rag.bounded_context(hits, 100_000).first().n_blocks == 3


def test_nearest_is_exact(spark):
    r = np.random.default_rng(0)
    x = r.integers(0, 3, (300, 4)).astype(float)  # many ties
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id long, vector array<double>").repartition(5)
    asked = df.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    got = {}
    for z in vectors.nearest(asked, df, 10).orderBy("query_id", "rank").collect():
        got.setdefault(z.query_id, []).append(z.chunk_id)
    for q in got:
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 6)
        assert got[q] == sorted(range(300), key=lambda i: (d[i], i))[:10]


def test_nearest_sends_few_rows_and_reads_rows_once(spark, monkeypatch):
    """Many partitions and queries, equal queries, rows of several blocks, many equal distances: one pass, k rows a query from two tasks a core."""
    sent, scan = spark.sparkContext.accumulator(0), vectors._scan

    def counting(held, k):
        inner = scan(held, k)
        return lambda it: (sent.add(b.num_rows) or b for b in inner(it))

    monkeypatch.setattr(vectors, "_scan", counting)
    r = np.random.default_rng(1)
    x = np.concatenate([r.integers(0, 9, (30_000, 3)), r.integers(0, 2, (1000, 3))]).astype(float)
    df = spark.createDataFrame([(f"r{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)], "chunk_id string, vector array<double>").repartition(60)
    q = np.concatenate([r.integers(0, 9, (2500, 3)), np.zeros((3, 3))]) + 0.25
    asked = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(q)], "query_id long, vector array<float>")
    near = vectors.nearest(asked, df, 5)
    assert near._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {}
    for z in near.orderBy("query_id", "rank").collect():
        got.setdefault(z.query_id, []).append((int(z.chunk_id[1:]), round(z.distance, 6)))
    assert sent.value <= 5 * len(q) * 2 * spark.sparkContext.defaultParallelism
    assert len(got) == len(q)
    for i in [*range(0, 2500, 25), 2500, 2501, 2502]:
        d = np.round(np.sqrt(((x - q[i]) ** 2).sum(1)), 6)
        assert got[i] == [(j, d[j]) for j in np.lexsort((np.arange(len(x)), d))[:5]]


def test_nearest_embeds_each_row_once(spark):
    texts = spark.createDataFrame([("a", "alpha beta"), ("b", "beta"), ("c", None)], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, [1.0] + [0.0] * 7)], "query_id long, vector array<float>")
    near = vectors.nearest(asked, vectors.embed(texts, "text", dim=8), 2)
    assert near._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    some = spark.createDataFrame([("a", None), ("b", [0.0] * 8)], "chunk_id string, vector array<float>")
    assert [r.chunk_id for r in vectors.nearest(asked, some, 2).collect()] == ["b"]


def test_embedding_is_unit_and_stable(spark):
    df = spark.createDataFrame([("alpha beta",), ("",), (None,)], "t string")
    got = [np.array(r.vector) for r in vectors.embed(df, "t", dim=32).collect()]
    assert abs(np.linalg.norm(got[0]) - 1) < 1e-6 and np.allclose(got[1], got[2])
