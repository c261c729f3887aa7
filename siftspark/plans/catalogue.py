"""Queries of the core over the driver's tables, and the SQL that says the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from siftspark import models
from siftspark.config import IGNORED_DIRS, IGNORED_FILES, LANGUAGE_BY_SUFFIX, SPECIAL_LANGUAGE, SPECIAL_NAMES, SUPPORTED_SUFFIXES
from siftspark.functions import text as T
from siftspark.operators import bm25, chunking, fusion, fuzzy, incremental, lifecycle, rag, vectors
from siftspark.plans import trees
from siftspark.session import cut_lineage, release, table

FIELDS = ["query_id", "chunk_id", "rel_path", "language", "start_line", "end_line", "text"]


def p7_found(spark, d):
    return incremental.changed_per_run(table(spark, d, "file_scans"), table(spark, d, "index_runs")).select("run_id", "rel_path")


def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


def duplicate_content(spark, d):
    hashed = table(spark, d, "documents").where("text is not null").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return hashed.groupBy("content_hash").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("kept_doc")).where("n_docs > 1")


def path_filter(spark, d):
    return table(spark, d, "files").select("rel_path").distinct().withColumn("indexed", T.is_indexed_path(F.col("rel_path")))


def language_detect(spark, d):
    return table(spark, d, "files").select("rel_path").distinct().withColumn("detected", T.language(F.col("rel_path")))


def loc_count(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("file_count"), F.sum(T.line_count(F.col("text"))).alias("total_loc"))


def tier_recommendation(spark, d):
    return loc_count(spark, d).withColumn("tier", models.advise(F.col("file_count"), F.col("total_loc")))


def _documents_as_files(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("rel_path"), T.content_hash(F.col("text")).alias("file_hash"), "language", "text")


def line_chunks(spark, d):
    return chunking.chunk_files(_documents_as_files(spark, d)).select(F.col("rel_path").cast("long").alias("doc_id"), "chunk_id", "start_line", "end_line", F.length("text").cast("int").alias("n_chars"))


def _listings(spark, d):
    """The last two successful listings of the history."""
    scans, runs = table(spark, d, "file_scans"), table(spark, d, "index_runs")
    ok = runs.where("status = 'ok'").select("run_id").distinct()
    last = ok.agg(F.max("run_id").alias("b"))
    before = ok.join(F.broadcast(last), F.col("run_id") < F.col("b")).agg(F.max("run_id").alias("run_id"))  # one row
    listing = incremental.settled_listing(scans, ["run_id"], extra=("size", "language", "mtime"))
    return listing.join(before, "run_id").drop("run_id"), listing.join(last.withColumnRenamed("b", "run_id"), "run_id").drop("run_id")


def incremental_diff(spark, d):
    known, current = _listings(spark, d)
    return lifecycle.diff(known, current)


def index_stats(spark, d):
    changes = incremental_diff(spark, d)
    chunks = bm25.one_text(table(spark, d, "chunks").where("chunk_id is not null"))
    fresh = table(spark, d, "chunks").select("chunk_id", "rel_path").distinct().join(changes.where("change in ('new', 'changed')").select("rel_path"), "rel_path", "left_semi")
    return lifecycle.stats(changes, chunks, fresh)


def purge_chunks(spark, d):
    kept = lifecycle.purge(table(spark, d, "chunks").select("chunk_id", "rel_path").distinct(), lifecycle.to_purge(incremental_diff(spark, d)))
    return kept.groupBy("rel_path").agg(F.count("*").alias("n_chunks"))


def upsert_files(spark, d):
    known, current = _listings(spark, d)
    cols = ["rel_path", "file_hash"]
    return lifecycle.upsert(known.select(*cols), current.select(*cols), ["rel_path"])


def keyword_tokens(spark, d):
    return bm25.postings(bm25.one_text(table(spark, d, "chunks")))


def vocabulary(spark, d):
    return bm25.vocabulary(bm25.postings(bm25.one_text(table(spark, d, "chunks"))))


def corpus_stats(spark, d):
    return bm25.corpus(bm25.doc_lengths(bm25.one_text(table(spark, d, "chunks")))).withColumn("avg_dl", F.round("avg_dl", 6))


def _queries(spark, d):
    return table(spark, d, "queries").where("query_id is not null").groupBy("query_id").agg(F.max("query_text").alias("query_text"))


def bm25_topk(spark, d):
    ranked = bm25.KeywordIndex.build(table(spark, d, "chunks")).search(_queries(spark, d), 20)
    return ranked.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def fuzzy_expand(spark, d):
    vocab = bm25.KeywordIndex.build(table(spark, d, "chunks"), keep_vocabulary=True).vocab
    found = fuzzy.expand(_queries(spark, d), vocab)
    return found.withColumn("similarity", F.round("similarity", 6))


def fuzzy_search(spark, d):
    """Keyword search of the expanded queries, rankings padded to the pool."""
    index, asked = bm25.KeywordIndex.build(table(spark, d, "chunks"), keep_vocabulary=True), _queries(spark, d)
    ranked = index.search(asked, 20, fuzzy.expand(asked, index.vocab), pad=True)
    return ranked.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def l2_normalize(spark, d):
    unit = table(spark, d, "embeddings").select("vec_id", vectors.l2_normalise(F.col("embedding")).alias("u"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))
    return unit.select("vec_id", F.round(norm, 6).alias("norm"), F.round(F.element_at("u", 1), 6).alias("first"), F.round(F.element_at("u", -1), 6).alias("last"))


def vector_topk(spark, d):
    """Every row whose id is divisible by 50 against all rows."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    return vectors.nearest(asked, rows, 10, "query_id", "vec_id").withColumn("distance", F.round("distance", 5))


def _two_rankings(spark, d):
    hits = table(spark, d, "hits").where("query_id is not null and chunk_id is not null")
    rank = lambda c: hits.where(F.col(c).isNotNull()).groupBy("query_id", "chunk_id").agg(F.min(c).alias("rank"))
    return rank("bm25_rank"), rank("vector_rank")


def rrf_merge(spark, d):
    fused = fusion.fuse_ranks(*_two_rankings(spark, d), top_n=8)
    return fused.withColumn("score", F.round("score", 9))


def hybrid_search(spark, d):
    fused = fusion.fuse_ranks(*_two_rankings(spark, d), top_n=8)
    return fusion.hydrate(fused, table(spark, d, "chunks")).withColumn("score", F.round("score", 9))


def _kept(ranked):
    """A ranking written once, the files it was moved by released."""
    made = cut_lineage(ranked)
    release(ranked.sparkSession)
    return made


def hybrid_text_search(spark, d):
    """Words and hashed embeddings of the texts themselves, fused."""
    chunks, asked = table(spark, d, "chunks"), _queries(spark, d).where("query_text is not null")
    by_words = _kept(bm25.KeywordIndex.build(chunks).search(asked, 32).select("query_id", "chunk_id", "rank"))
    rows = vectors.embed(bm25.sorted_texts(chunks), "text")
    by_vector = vectors.nearest(vectors.embed(asked, "query_text"), rows, 32, "query_id", "chunk_id", True)
    return fusion.hydrate(fusion.fuse_ranks(by_words, _kept(by_vector.select("query_id", "chunk_id", "rank")), top_n=8), chunks).drop("text").withColumn("score", F.round("score", 9))


def snippet(spark, d):
    return table(spark, d, "chunks").select("chunk_id", T.snippet(F.col("text"), 320).alias("snippet")).distinct()


def hit_labels(spark, d):
    fused = fusion.fuse_ranks(*_two_rankings(spark, d), top_n=8)
    return fused.select("query_id", "position", T.hit_label(F.col("bm25_rank"), F.col("vector_rank"), F.col("score")).alias("label"))


def context_budget(spark, d):
    fused = fusion.fuse_ranks(*_two_rankings(spark, d), top_n=20)
    made = rag.bounded_context(fusion.hydrate(fused, table(spark, d, "chunks")))
    return made.select("query_id", F.sha1("context").alias("context_hash"), F.length("context").alias("n_chars"), "n_blocks")


def sources_line(spark, d):
    fused = fusion.fuse_ranks(*_two_rankings(spark, d), top_n=8)
    return rag.sources_line(fusion.hydrate(fused, table(spark, d, "chunks")))


def chat_memory(spark, d):
    """Users' events as conversations: the last eight of each."""
    turns = table(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.col("event_type").alias("role"))
    return rag.recent_turns(turns)


def prompt_messages(spark, d):
    """System and user message of each query with the context its hits make."""
    fused = fusion.fuse_ranks(*_two_rankings(spark, d), top_n=8)
    made = rag.bounded_context(fusion.hydrate(fused, table(spark, d, "chunks"))).select("query_id", "context")
    said = _queries(spark, d).join(made, "query_id", "left").select("query_id", F.explode(rag.prompt_messages(F.col("query_text"), F.col("context"))).alias("m"))
    return said.select("query_id", "m.role", F.length("m.content").alias("n_chars"), F.sha1("m.content").alias("content_hash"))


def query_terms(spark, d):
    return _queries(spark, d).where("query_text is not null").select("query_id", F.posexplode(T.query_terms(F.col("query_text"))).alias("pos", "term"))


def embedded(spark, d):
    """Length and size of every chunk's vector, blank texts too."""
    made = vectors.embed(bm25.one_text(table(spark, d, "chunks")), "text")
    return made.select("chunk_id", F.size("vector").alias("dim"), F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)), 4).alias("norm"))


#: Letters that the stub embedder counts.
LETTERS = "aeinorst"


def letter_embedder(texts):
    """An embedder that SQL can say too: how often each of a few letters stands in a text, at unit length."""
    counts = np.array([[t.count(c) for c in LETTERS] for t in texts], np.float64) + 1e-3
    return counts / np.linalg.norm(counts, axis=1, keepdims=True)


def hybrid_letters(spark, d):
    """From texts to hits: keyword ranking and nearest vectors of a stub embedder, fused and looked up."""
    chunks, asked = table(spark, d, "chunks"), _queries(spark, d).where("query_text is not null")
    by_words = _kept(bm25.KeywordIndex.build(chunks).search(asked, 32).select("query_id", "chunk_id", "rank"))
    rows = vectors.embed(bm25.sorted_texts(chunks), "text", letter_embedder)
    by_vector = vectors.nearest(vectors.embed(asked, "query_text", letter_embedder), rows, 32, "query_id", "chunk_id", True)
    found = fusion.hydrate(fusion.fuse_ranks(by_words, _kept(by_vector.select("query_id", "chunk_id", "rank")), top_n=8), chunks)
    return found.withColumn("score", F.round("score", 9)).withColumn("text", T.snippet(F.col("text"), 320))


QUERIES = {
    f.__name__: f
    for f in (
        query_terms, embedded, hybrid_letters, trees.scan_tree, trees.project_size, trees.index_builds, trees.index_contents,
        p7_found, content_hash, duplicate_content, path_filter, language_detect, loc_count, tier_recommendation, line_chunks, incremental_diff, index_stats,
        purge_chunks, upsert_files, keyword_tokens, vocabulary, corpus_stats, bm25_topk, fuzzy_expand, fuzzy_search, l2_normalize, vector_topk, rrf_merge,
        hybrid_search, hybrid_text_search, snippet, hit_labels, context_budget, sources_line, chat_memory, prompt_messages,
    )
}


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(values))


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NAME = "regexp_extract(rel_path, '([^/]*)$', 1)"
SUFFIX = f"lower(regexp_extract({NAME}, '.(\\.[^.]+)$', 1))"
TOKENS = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({_in(T.STOPWORDS)}))"
TEXTS = "SELECT chunk_id, coalesce(max(text), '') AS text FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id"
POSTINGS = f"SELECT chunk_id, token, count(*)::INT AS tf FROM (SELECT chunk_id, unnest({TOKENS}) AS token FROM texts) GROUP BY ALL"
LENGTHS = f"SELECT chunk_id, len({TOKENS}) AS dl FROM texts"
LOC = "coalesce(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT suffix(text, chr(10)) THEN 1 ELSE 0 END, 0)"
LISTING = """
    ok AS (SELECT DISTINCT run_id FROM index_runs WHERE status = 'ok'),
    b AS (SELECT max(run_id) AS run_id FROM ok), a AS (SELECT max(run_id) AS run_id FROM ok WHERE run_id < (SELECT run_id FROM b)),
    seen AS (SELECT run_id, rel_path, file_hash FROM (SELECT *, row_number() OVER (PARTITION BY run_id, rel_path ORDER BY recorded_at DESC NULLS LAST, file_hash DESC) AS rn
             FROM file_scans WHERE file_hash IS NOT NULL AND rel_path IS NOT NULL) WHERE rn = 1),
    known AS (SELECT rel_path, file_hash FROM seen WHERE run_id = (SELECT run_id FROM a)), cur AS (SELECT rel_path, file_hash FROM seen WHERE run_id = (SELECT run_id FROM b)),
    changes AS (SELECT coalesce(c.rel_path, k.rel_path) AS rel_path, c.file_hash, k.file_hash AS old_hash,
        CASE WHEN c.rel_path IS NULL THEN 'removed' WHEN k.rel_path IS NULL THEN 'new' WHEN c.file_hash = k.file_hash THEN 'unchanged' ELSE 'changed' END AS change
        FROM cur c FULL JOIN known k ON c.rel_path = k.rel_path)"""
RRF = """
    rk AS (SELECT query_id, chunk_id, min(bm25_rank) AS bm25_rank, min(vector_rank) AS vector_rank FROM hits WHERE query_id IS NOT NULL AND chunk_id IS NOT NULL
           GROUP BY ALL HAVING min(bm25_rank) IS NOT NULL OR min(vector_rank) IS NOT NULL),
    sc AS (SELECT *, coalesce(1e0 / (60e0 + bm25_rank), 0) + coalesce(1e0 / (60e0 + vector_rank), 0) AS score FROM rk),
    po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST, chunk_id) AS position FROM sc)"""
ONE_CHUNK = "SELECT chunk_id, any_value(rel_path) AS rel_path, any_value(language) AS language, any_value(start_line) AS start_line, any_value(end_line) AS end_line, any_value(text) AS text FROM (SELECT DISTINCT * FROM chunks) GROUP BY chunk_id"
REF = "rel_path || ':' || start_line || '-' || coalesce(end_line::VARCHAR, '?')"
END = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+\z"

def _context(name, most):
    return f"""
    bl{name} AS (SELECT query_id, position, '### ' || {REF} || ' (' || coalesce(language, 'text') || ')' || chr(10) || '```' || CASE WHEN coalesce(language, 'text') = 'text' THEN '' ELSE language END || chr(10) || coalesce(text, '') || chr(10) || '```' AS block
           FROM po JOIN one USING (chunk_id) WHERE position <= {most}),
    us{name} AS (SELECT *, coalesce(sum(length(block) + 1) OVER (PARTITION BY query_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM bl{name}),
    {name} AS (SELECT query_id, string_agg(block, chr(10) || chr(10) ORDER BY position) AS context, count(*) AS n_blocks FROM us{name} WHERE used + length(block) <= 8000 GROUP BY query_id)"""


CONTEXT = f"{RRF}, one AS ({ONE_CHUNK}), {_context('cx', 8)}, {_context('cx20', 20)}"

#: Chunks of src (id, text): greedy packing of lines over prefix sums.
CHUNKED = r"""
    lines AS (SELECT id, text, regexp_extract_all(text, '[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])|[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]+\z') AS ls FROM src WHERE length(text) > 0),
    sums AS (SELECT *, list_transform(range(0, len(ls) + 1), lambda k: coalesce(list_sum(list_transform(ls[:k], lambda x: length(x))), 0)::BIGINT) AS ps FROM lines),
    walk AS (
        SELECT id, 0::BIGINT AS i, greatest(1, len(list_filter(ps, lambda p: p <= 800)) - 1)::BIGINT AS j FROM sums
        UNION ALL
        SELECT id, i2, greatest(i2 + 1, len(list_filter(ps, lambda p: p <= ps[i2 + 1] + 800)) - 1)::BIGINT FROM (
            SELECT w.id, s.ps, greatest(w.i + 1, len(list_filter(s.ps, lambda p: p <= s.ps[w.j + 1] - 120)) - 1)::BIGINT AS i2 FROM walk w JOIN sums s ON s.id = w.id WHERE w.j < len(s.ls))),
    parts AS (SELECT w.id, i, j, sha1(s.text) AS h, trim(list_aggregate(s.ls[i + 1 : j], 'string_agg', ''), chr(10)) AS body FROM walk w JOIN sums s ON s.id = w.id),
    cut AS (SELECT id, h, h || ':' || (row_number() OVER (PARTITION BY id ORDER BY i) - 1) AS chunk_id, (i + 1)::INT AS start_line, j::INT AS end_line, length(body)::INT AS n_chars FROM parts WHERE regexp_matches(body, '\S'))"""
#: The documents as files of a tree, and as they are at the second build.
TREE = """
    tree AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN '_d/' || doc_id || '.md' WHEN 1 THEN '_d/' || doc_id || '.py' WHEN 2 THEN '_d/' || doc_id || '.txt' WHEN 3 THEN '_d/' || doc_id || '.YAML' ELSE 'm' || doc_id || '/Makefile' END AS rel_path,
             CASE doc_id % 5 WHEN 0 THEN 'markdown' WHEN 1 THEN 'python' WHEN 2 THEN 'text' WHEN 3 THEN 'yaml' ELSE 'makefile' END AS language
             FROM (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY doc_id)),
    later AS (SELECT rel_path, language, CASE WHEN doc_id % 10 = 2 THEN text || chr(10) || 'last line' ELSE text END AS text FROM tree WHERE doc_id % 10 <> 1
              UNION ALL SELECT 'new/' || doc_id || '.txt', 'text', text FROM tree WHERE doc_id % 10 = 3)"""

#: Longest common subsequence of a and w, a row of the table at a time.
LCS = "list_reduce(string_split(w, ''), lambda r, c: list_transform(range(1, length(a) + 2), lambda j: greatest(r[j], coalesce(list_max(list_transform(list_filter(range(2, j + 1), lambda i: a[i - 1] = c), lambda i: r[i - 1] + 1)), 0))), list_transform(range(0, length(a) + 1), lambda x: 0::BIGINT))[-1]"
EXPANSION = f"""
    texts AS ({TEXTS}), vo AS (SELECT DISTINCT unnest({TOKENS}) AS token FROM texts),
    aq AS (SELECT query_id, max(query_text) AS text FROM queries WHERE query_id IS NOT NULL GROUP BY query_id),
    said AS (SELECT query_id, unnest(range(0, len(ts)))::INT AS pos, unnest(ts) AS term FROM (SELECT query_id, list_transform(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{{1,}}'), lambda t: lower(t)) AS ts FROM aq WHERE text IS NOT NULL)),
    unk AS (SELECT * FROM said WHERE term NOT IN (SELECT token FROM vo)),
    pr AS (SELECT term, token, CASE WHEN length(term) <= length(token) THEN term ELSE token END AS a, CASE WHEN length(term) <= length(token) THEN token ELSE term END AS t FROM (SELECT DISTINCT term FROM unk), vo WHERE term <> token),
    sz AS (SELECT *, length(t) < 15e-1 * length(a) AS near, floor(CASE WHEN length(t) < 15e-1 * length(a) THEN 18e-2 * (length(a) + length(t)) ELSE 2 * length(a) * (1 - 82 / 90e0) END + 1e-9)::INT + 1 AS parts FROM pr WHERE length(t) <= 8 * length(a)),
    fit AS (SELECT * FROM sz WHERE (NOT near OR 200 * length(a) >= 82 * (length(a) + length(t))) AND (parts > length(a) OR len(list_filter(range(0, parts),
        lambda k: contains(t, substring(a, (length(a) * k // parts + 1)::BIGINT, (length(a) * (k + 1) // parts - length(a) * k // parts)::BIGINT)))) > 0)),
    win AS (SELECT term, token, a, near, t AS w, 1e0 AS f FROM fit WHERE near OR length(t) * 82 <= length(a) * 118
            UNION ALL SELECT term, token, a, near, substring(t, (greatest(0, i) + 1)::BIGINT, (least(length(t), i + length(a)) - greatest(0, i))::BIGINT), 9e-1 FROM (SELECT *, unnest(range(1 - length(a), length(t))) AS i FROM fit WHERE NOT near)),
    sim AS (SELECT term, token AS candidate, max(f * 2e2 * {LCS} / (length(a) + length(w))) AS similarity FROM win GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY similarity DESC, candidate) AS rank FROM sim WHERE similarity >= 82),
    ex AS (SELECT query_id, pos, term, candidate, similarity, rank FROM unk JOIN best USING (term) WHERE rank <= 3)"""

ORACLE = {
    "query_terms": "SELECT query_id, unnest(range(0, len(ts)))::INT AS pos, unnest(ts) AS term FROM (SELECT query_id, list_transform(regexp_extract_all(max(query_text), '[A-Za-z_][A-Za-z0-9_]{1,}'), lambda t: lower(t)) AS ts FROM queries WHERE query_id IS NOT NULL GROUP BY query_id)",
    "embedded": f"WITH texts AS ({TEXTS}) SELECT chunk_id, 384 AS dim, CASE WHEN regexp_matches(text, '[\\p{{L}}\\p{{N}}_]') THEN 1e0 ELSE 0e0 END AS norm FROM texts",
    "hybrid_letters": f"""
        WITH texts AS ({TEXTS}), p AS ({POSTINGS}), l AS ({LENGTHS}), v AS (SELECT token, count(*) AS df FROM p GROUP BY token), c AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM l),
        aq AS (SELECT query_id, max(query_text) AS text FROM queries WHERE query_id IS NOT NULL GROUP BY query_id HAVING max(query_text) IS NOT NULL),
        q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS}) AS token FROM aq) GROUP BY ALL),
        s AS (SELECT query_id, chunk_id, sum(qtf * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf / (15e-1 * (25e-2 + 75e-2 * dl / a) + tf)) AS score FROM q JOIN v USING (token) JOIN p USING (token) JOIN l USING (chunk_id), c GROUP BY ALL),
        wr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s),
        raw AS (SELECT 'c' AS kind, chunk_id AS id, text FROM texts UNION ALL SELECT 'q', query_id::VARCHAR, text FROM aq),
        lc AS (SELECT kind, id, list_transform(string_split('{LETTERS}', ''), lambda k: length(CASE WHEN text = '' THEN ' ' ELSE text END) - length(replace(CASE WHEN text = '' THEN ' ' ELSE text END, k, '')) + 1e-3) AS e FROM raw),
        un AS (SELECT kind, id, list_transform(e, lambda x: (x / sqrt(list_sum(list_transform(e, lambda y: y * y))))::FLOAT::DOUBLE) AS e FROM lc),
        di AS (SELECT a.id::BIGINT AS query_id, b.id AS chunk_id, round(list_distance(a.e, b.e), 6) AS d FROM un a, un b WHERE a.kind = 'q' AND b.kind = 'c'),
        vr AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_id) AS rank FROM di),
        rk AS (SELECT query_id, chunk_id, min(CASE WHEN w = 0 THEN rank END) AS bm25_rank, min(CASE WHEN w = 1 THEN rank END) AS vector_rank FROM (SELECT *, 0 AS w FROM wr WHERE rank <= 32 UNION ALL SELECT *, 1 FROM vr WHERE rank <= 32) GROUP BY ALL),
        sc AS (SELECT *, coalesce(1e0 / (60e0 + bm25_rank), 0) + coalesce(1e0 / (60e0 + vector_rank), 0) AS score FROM rk),
        po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm25_rank NULLS LAST, vector_rank NULLS LAST, chunk_id) AS position FROM sc), one AS ({ONE_CHUNK})
        SELECT query_id, position, chunk_id, rel_path, language, start_line, end_line, round(score, 9) AS score, bm25_rank, vector_rank,
          CASE WHEN length(regexp_replace(text, '{END}', '')) <= 320 THEN regexp_replace(text, '{END}', '') ELSE regexp_replace(left(regexp_replace(text, '{END}', ''), 320), '{END}', '') || chr(10) || '...' END AS text
        FROM po JOIN one USING (chunk_id) WHERE position <= 8""",
    "scan_tree": f"WITH {TREE} SELECT rel_path, octet_length(encode(text))::BIGINT AS size, sha1(text) AS file_hash, language, sha1(text) AS text_hash FROM tree",
    "project_size": f"""WITH {TREE}, s AS (SELECT count(*) AS file_count, sum({LOC})::BIGINT AS total_loc FROM tree)
        SELECT *, CASE WHEN file_count <= 200 AND total_loc <= 50000 THEN 'tiny' WHEN file_count <= 1500 AND total_loc <= 500000 THEN 'small' ELSE 'deep' END AS tier FROM s""",
    "index_builds": f"""
        WITH RECURSIVE {TREE}, src AS (SELECT '1' || rel_path AS id, text FROM tree UNION ALL SELECT '2' || rel_path, text FROM later), {CHUNKED},
        n AS (SELECT left(id, 1) AS b, substring(id, 2) AS rel_path, count(*) AS k FROM cut GROUP BY ALL),
        f AS (SELECT a.rel_path AS old, z.rel_path AS now, a.text = z.text AS same FROM tree a FULL JOIN later z ON a.rel_path = z.rel_path)
        SELECT 1::BIGINT AS build, (SELECT count(*) FROM tree) AS scanned_files, (SELECT count(*) FROM tree) AS new_files, 0::BIGINT AS changed_files, 0::BIGINT AS unchanged_files, 0::BIGINT AS removed_files,
          (SELECT sum(k) FROM n WHERE b = '1')::BIGINT AS total_chunks, (SELECT sum(k) FROM n WHERE b = '1')::BIGINT AS embedded_chunks
        UNION ALL SELECT 2, (SELECT count(*) FROM tree), 0, 0, (SELECT count(*) FROM tree), 0, (SELECT sum(k) FROM n WHERE b = '1'), 0
        UNION ALL SELECT 3, count(now), count(*) FILTER (old IS NULL), count(*) FILTER (NOT same), count(*) FILTER (same), count(*) FILTER (now IS NULL),
          (SELECT sum(k) FROM n WHERE b = '2'), coalesce((SELECT sum(k) FROM n JOIN f g ON g.now = n.rel_path WHERE b = '2' AND (g.old IS NULL OR NOT g.same)), 0) FROM f""",
    "index_contents": f"WITH RECURSIVE {TREE}, src AS (SELECT rel_path AS id, text FROM later), {CHUNKED} SELECT chunk_id, id AS rel_path, language, start_line, end_line, n_chars, 8 AS dim FROM cut JOIN later ON later.rel_path = cut.id",
    "fuzzy_expand": f"WITH {EXPANSION} SELECT query_id, pos, term, candidate, round(similarity, 6) AS similarity, rank FROM ex",
    "fuzzy_search": f"""
        WITH {EXPANSION}, p AS ({POSTINGS}), l AS ({LENGTHS}), v AS (SELECT token, count(*) AS df FROM p GROUP BY token), c AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM l),
        words AS (SELECT query_id, unnest({TOKENS}) AS token FROM aq UNION ALL SELECT query_id, candidate FROM ex),
        q AS (SELECT query_id, token, count(*) AS qtf FROM words GROUP BY ALL),
        s AS (SELECT query_id, chunk_id, sum(qtf * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf / (15e-1 * (25e-2 + 75e-2 * dl / a) + tf)) AS score FROM q JOIN v USING (token) JOIN p USING (token) JOIN l USING (chunk_id), c GROUP BY ALL),
        every AS (SELECT aq.query_id, texts.chunk_id, coalesce(score, 0e0) AS score FROM aq CROSS JOIN texts LEFT JOIN s ON s.query_id = aq.query_id AND s.chunk_id = texts.chunk_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM every)
        SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 20""",
    "p7_found": """
        WITH ok AS (SELECT run_id, lag(run_id) OVER (ORDER BY run_id) AS prev FROM (SELECT DISTINCT run_id FROM index_runs WHERE status = 'ok')),
        seen AS (SELECT run_id, rel_path, file_hash FROM (
            SELECT *, row_number() OVER (PARTITION BY run_id, rel_path ORDER BY recorded_at DESC NULLS LAST, file_hash DESC) AS rn
            FROM file_scans WHERE file_hash IS NOT NULL AND rel_path IS NOT NULL) WHERE rn = 1)
        SELECT s.run_id, s.rel_path FROM seen s JOIN ok ON s.run_id = ok.run_id
        LEFT JOIN seen p ON p.run_id = ok.prev AND p.rel_path = s.rel_path AND p.file_hash = s.file_hash
        WHERE p.run_id IS NULL""",
    "content_hash": "SELECT doc_id, sha1(text) AS content_hash FROM documents",
    "duplicate_content": "SELECT sha1(text) AS content_hash, count(*) AS n_docs, max(doc_id) AS kept_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "path_filter": f"""
        SELECT DISTINCT rel_path, NOT list_has_any(string_split(rel_path, '/')[:-2], [{_in(IGNORED_DIRS)}]) AND NOT regexp_matches(rel_path, '(^|/)\\.')
          AND {NAME} NOT IN ({_in(IGNORED_FILES)}) AND NOT regexp_matches({NAME}, '(\\.min\\.(js|css)|\\.map|\\.bundle\\.(js|css)|\\.lock)$')
          AND ({SUFFIX} IN ({_in(SUPPORTED_SUFFIXES)}) OR lower({NAME}) IN ({_in(SPECIAL_NAMES)})) AS indexed FROM files""",
    "language_detect": f"SELECT DISTINCT rel_path, CASE {' '.join(f'WHEN lower({NAME}) = {_quote(k)} THEN {_quote(v)}' for k, v in SPECIAL_LANGUAGE.items())} {' '.join(f'WHEN {SUFFIX} = {_quote(k)} THEN {_quote(v)}' for k, v in LANGUAGE_BY_SUFFIX.items())} ELSE 'text' END AS detected FROM files",
    "loc_count": f"SELECT source, count(*) AS file_count, sum({LOC})::BIGINT AS total_loc FROM documents GROUP BY source",
    "tier_recommendation": f"""SELECT *, CASE WHEN file_count <= 200 AND total_loc <= 50000 THEN 'tiny' WHEN file_count <= 1500 AND total_loc <= 500000 THEN 'small' ELSE 'deep' END AS tier
        FROM (SELECT source, count(*) AS file_count, sum({LOC})::BIGINT AS total_loc FROM documents GROUP BY source)""",
    "line_chunks": f"WITH RECURSIVE src AS (SELECT doc_id AS id, text FROM documents), {CHUNKED} SELECT id AS doc_id, chunk_id, start_line, end_line, n_chars FROM cut",
    "incremental_diff": f"WITH {LISTING} SELECT * FROM changes",
    "index_stats": f"""WITH {LISTING} SELECT count(*) FILTER (change <> 'removed') AS scanned_files, count(*) FILTER (change = 'new') AS new_files, count(*) FILTER (change = 'changed') AS changed_files,
        count(*) FILTER (change = 'unchanged') AS unchanged_files, count(*) FILTER (change = 'removed') AS removed_files, (SELECT count(DISTINCT chunk_id) FROM chunks) AS total_chunks,
        (SELECT count(*) FROM (SELECT DISTINCT chunk_id, rel_path FROM chunks WHERE rel_path IN (SELECT rel_path FROM changes WHERE change IN ('new', 'changed')))) AS embedded_chunks FROM changes""",
    "purge_chunks": f"WITH {LISTING} SELECT rel_path, count(*) AS n_chunks FROM (SELECT DISTINCT chunk_id, rel_path FROM chunks) WHERE rel_path NOT IN (SELECT rel_path FROM changes WHERE change <> 'unchanged') GROUP BY rel_path",
    "upsert_files": f"WITH {LISTING} SELECT rel_path, coalesce(file_hash, old_hash) AS file_hash FROM changes",
    "keyword_tokens": f"WITH texts AS ({TEXTS}) {POSTINGS}",
    "vocabulary": f"WITH texts AS ({TEXTS}), p AS ({POSTINGS}) SELECT token, count(*) AS df FROM p GROUP BY token",
    "corpus_stats": f"WITH texts AS ({TEXTS}), l AS ({LENGTHS}) SELECT count(*) AS n_docs, round(avg(dl), 6) AS avg_dl FROM l",
    "bm25_topk": f"""
        WITH texts AS ({TEXTS}), p AS ({POSTINGS}), l AS ({LENGTHS}), v AS (SELECT token, count(*) AS df FROM p GROUP BY token), c AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS a FROM l),
        q AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest({TOKENS}) AS token FROM (SELECT query_id, max(query_text) AS text FROM queries WHERE query_id IS NOT NULL GROUP BY query_id)) GROUP BY ALL),
        s AS (SELECT query_id, chunk_id, sum(qtf * ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * tf / (15e-1 * (25e-2 + 75e-2 * dl / a) + tf)) AS score
              FROM q JOIN v USING (token) JOIN p USING (token) JOIN l USING (chunk_id), c GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)
        SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 20""",
    "l2_normalize": """
        WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM u)
        SELECT vec_id, round(sqrt(list_sum(list_transform(e, lambda x: (x / n) * (x / n)))), 6) AS norm, round(e[1] / n, 6) AS first, round(e[-1] / n, 6) AS last FROM n""",
    "vector_topk": """
        WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
        p AS (SELECT q.vec_id AS query_id, e.vec_id, list_distance(q.v, e.v) AS dist FROM e q, e WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(dist, 6), vec_id) AS rank FROM p)
        SELECT query_id, vec_id, round(dist, 5) AS distance, rank FROM r WHERE rank <= 10""",
    "rrf_merge": f"WITH {RRF} SELECT query_id, chunk_id, bm25_rank, vector_rank, round(score, 9) AS score, position FROM po WHERE position <= 8",
    "hybrid_search": f"WITH {RRF}, one AS ({ONE_CHUNK}) SELECT query_id, position, chunk_id, rel_path, language, start_line, end_line, text, round(score, 9) AS score, bm25_rank, vector_rank FROM po JOIN one USING (chunk_id) WHERE position <= 8",
    "snippet": f"""SELECT DISTINCT chunk_id, CASE WHEN length(w) <= 320 THEN w ELSE regexp_replace(left(w, 320), '{END}', '') || chr(10) || '...' END AS snippet
        FROM (SELECT chunk_id, regexp_replace(text, '{END}', '') AS w FROM chunks)""",
    "hit_labels": f"WITH {RRF} SELECT query_id, position, coalesce('bm25#' || bm25_rank, '--') || ' ' || coalesce('vec#' || vector_rank, '--') || ' ' || format('rrf={{:.4f}}', score) AS label FROM po WHERE position <= 8",
    "context_budget": f"WITH {CONTEXT} SELECT query_id, sha1(context) AS context_hash, length(context)::INT AS n_chars, n_blocks FROM cx20",
    "sources_line": f"WITH {RRF}, one AS ({ONE_CHUNK}) SELECT query_id, string_agg({REF}, ', ' ORDER BY position) AS sources FROM po JOIN one USING (chunk_id) WHERE position <= 8 GROUP BY query_id",
    "chat_memory": "SELECT * FROM (SELECT user_id AS conv_id, event_id AS turn, event_type AS role, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS age FROM events) WHERE age <= 8",
    "prompt_messages": f"""
        WITH {CONTEXT}, q AS (SELECT query_id, max(query_text) AS query_text FROM queries WHERE query_id IS NOT NULL GROUP BY query_id),
        m AS (SELECT query_id, 'system' AS role, {_quote(rag.SYSTEM_PROMPT)} AS content FROM q
              UNION ALL SELECT query_id, 'user', replace(replace({_quote(rag.USER_PROMPT)}, '{{context}}', coalesce(context, '')), '{{query}}', coalesce(query_text, '')) FROM q LEFT JOIN cx USING (query_id))
        SELECT query_id, role, length(content)::INT AS n_chars, sha1(content) AS content_hash FROM m""",
}
