"""Queries and SQL of the training-text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.llm import distinctive, leakage, mixture, mojibake, nearduplicates, pii, provenance, rankmix, splitting
from siftspark.session import table


def p1_found(spark, d):
    return nearduplicates.near_duplicate_pairs(table(spark, d, "chunks"), "chunk_id", "text", "rel_path", width=3, threshold=0.6, min_words=20)


def p1_groups(spark, d):
    return nearduplicates.near_duplicate_groups(table(spark, d, "chunks"), "chunk_id", "text", "rel_path", width=3, threshold=0.6, min_words=20)


def p2_found(spark, d):
    return rankmix.best_of_all(table(spark, d, "hits"), 5).select("query_id", "chunk_id")


def p2_ranking(spark, d):
    ranked = rankmix.fuse_scores(table(spark, d, "hits"))
    return ranked.select("query_id", "position", "chunk_id", F.round("fused", 9).alias("fused"), "place_bm25", "place_vector", "place_score")


def p3_found(spark, d):
    return provenance.not_hand_written(table(spark, d, "files"), table(spark, d, "chunks")).select("rel_path")


def p3_kinds(spark, d):
    return provenance.not_hand_written(table(spark, d, "files"), table(spark, d, "chunks"))


def p4_found(spark, d):
    return mojibake.garbled_text(table(spark, d, "chunks")).select("chunk_id").distinct()


def p4_restored(spark, d):
    return mojibake.garbled_text(table(spark, d, "chunks"))


def p5_found(spark, d):
    scored = distinctive.distinctive_terms(table(spark, d, "chunks"), "chunk_id", "text", least_tf=4)
    return scored.where("length(term) >= 4 and tf >= 4 and df between 2 and 8").select("chunk_id", "term")


def p5_weights(spark, d):
    scored = distinctive.distinctive_terms(table(spark, d, "chunks"), "chunk_id", "text")
    return scored.withColumn("weight", F.round("weight", 6))


def p6_found(spark, d):
    return splitting.split_oversized(table(spark, d, "chunks")).select("chunk_id").distinct()


def p6_pieces(spark, d):
    return splitting.split_oversized(table(spark, d, "chunks"))


def p6_tiles(spark, d):
    """What the pieces of a chunk make together: its text, within the limit, with lines that fit."""
    pieces = splitting.split_oversized(table(spark, d, "chunks"))
    core = F.substr("text", F.col("core_start") - F.col("start_char") + 1)
    own = F.collect_list(F.struct("piece", core.alias("core")))
    return pieces.groupBy("chunk_id").agg(
        F.md5(F.array_join(F.transform(F.sort_array(own), lambda x: x["core"]), "")).alias("text_hash"), F.max(F.length("text")).alias("longest"), F.max(F.col("core_start") - F.col("start_char")).alias("overlap"),
        F.min("start_line").alias("start_line"), (F.max("end_line") - F.min("start_line") + 1).alias("n_lines"),
    ).select("chunk_id", "text_hash", (F.col("longest") <= 800).alias("within"), (F.col("overlap") <= 120).alias("overlapping"), "start_line", "n_lines")


def p8_found(spark, d):
    hits = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.where("run_words >= 12").select("doc_id", "item_id")


def p8_report(spark, d):
    hits = leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.withColumns({c: F.round(c, 6) for c in ("best_similarity", "item_similarity")})


def p9_mixture(spark, d):
    return mixture.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))[0]


def p9_shares(spark, d):
    return mixture.mix_sources(table(spark, d, "documents"), table(spark, d, "source_targets"))[1]


def p10_found(spark, d):
    shown = pii.redact(table(spark, d, "documents"), table(spark, d, "name_list"))
    return shown.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.kind", "e.found").distinct()


def p10_redacted(spark, d):
    return pii.redact(table(spark, d, "documents"), table(spark, d, "name_list")).select("doc_id", "redacted")


def queries():
    here = globals()
    return {k: v for k, v in here.items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
ONE_TEXT = "SELECT chunk_id, any_value(text) AS text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL GROUP BY chunk_id"


#: Classes of chunks by their sets of three-word runs, and links of classes; pairs of one path do not count.
NEAR = f"""
    one AS (SELECT DISTINCT chunk_id, rel_path, text FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
    w AS (SELECT chunk_id, rel_path, {WORDS} AS ws FROM one),
    s AS (SELECT chunk_id, rel_path, list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda k: array_to_string(ws[k : k + 2], ' ')))) AS grams FROM w WHERE len(ws) >= 20),
    m AS (SELECT DISTINCT chunk_id, rel_path, md5(array_to_string(grams, chr(10))) AS cls FROM s),
    c AS (SELECT md5(array_to_string(grams, chr(10))) AS cls, any_value(grams) AS grams, min(chunk_id) AS rep, count(DISTINCT chunk_id) AS class_size, min(rel_path) AS lo, max(rel_path) AS hi FROM s GROUP BY 1),
    g AS (SELECT cls, len(grams) AS n, unnest(grams) AS gram FROM c),
    l AS (SELECT a.cls AS a, b.cls AS b FROM g a JOIN g b ON a.gram = b.gram AND a.cls < b.cls GROUP BY ALL HAVING count(*) * 10 >= 6 * (any_value(a.n) + any_value(b.n) - count(*)))"""


def oracle_sql():
    return {
        "p1_found": f"""
            WITH {NEAR}, t AS (SELECT a, b FROM l UNION ALL SELECT cls, cls FROM c)
            SELECT DISTINCT least(x.chunk_id, y.chunk_id) AS chunk_id_a, greatest(x.chunk_id, y.chunk_id) AS chunk_id_b
            FROM t JOIN m x ON x.cls = t.a JOIN m y ON y.cls = t.b WHERE x.chunk_id <> y.chunk_id AND x.rel_path <> y.rel_path""",
        "p1_groups": f"""
            WITH RECURSIVE {NEAR},
            e AS (SELECT x.rep AS a, y.rep AS b FROM l JOIN c x ON x.cls = l.a JOIN c y ON y.cls = l.b WHERE NOT (x.lo = x.hi AND y.lo = y.hi AND x.lo = y.lo)),
            d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
            r AS (SELECT a AS v, a AS met FROM d UNION SELECT r.v, d.b FROM r JOIN d ON d.a = r.met),
            root AS (SELECT v, min(met) AS root FROM r GROUP BY v), deg AS (SELECT a AS v, count(*) AS n FROM d GROUP BY a),
            f AS (SELECT DISTINCT m.chunk_id, CASE WHEN root IS NOT NULL OR lo < hi THEN coalesce(root, rep) ELSE chunk_id END AS group_id, class_size, coalesce(n, 0) AS n_links
                  FROM m JOIN c USING (cls) LEFT JOIN root ON root.v = c.rep LEFT JOIN deg ON deg.v = c.rep)
            SELECT i.chunk_id, coalesce(group_id, i.chunk_id) AS group_id, coalesce(class_size, 1) AS class_size, coalesce(n_links, 0) AS n_links
            FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) i LEFT JOIN f USING (chunk_id)""",
        "p2_found": """
            WITH h AS (SELECT DISTINCT * FROM hits WHERE query_id IS NOT NULL),
            s AS (SELECT *, rank() OVER (PARTITION BY query_id, score IS NULL ORDER BY score DESC) AS place FROM h)
            SELECT query_id, chunk_id FROM s WHERE bm25_rank <= 5 AND vector_rank <= 5 AND score IS NOT NULL AND place <= 5""",
        "p2_ranking": """
            WITH h AS (SELECT DISTINCT * FROM hits WHERE query_id IS NOT NULL),
            x AS (SELECT *, -bm25_rank::DOUBLE AS vb, -vector_rank::DOUBLE AS vv, CASE WHEN NOT isnan(score) THEN score END AS vs FROM h),
            m AS (SELECT query_id, median(vb) AS mb, median(vv) AS mv, median(vs) AS ms FROM x GROUP BY query_id),
            y AS (SELECT x.*, vb - mb AS db, vv - mv AS dv, vs - ms AS ds FROM x JOIN m USING (query_id)),
            k AS (SELECT query_id, 14826e-4 * median(abs(db)) AS kb, 14826e-4 * median(abs(dv)) AS kv, 14826e-4 * median(abs(ds)) AS ks FROM y GROUP BY query_id),
            z AS (SELECT y.*, db / CASE WHEN kb > 0 THEN kb ELSE 1 END AS zb, dv / CASE WHEN kv > 0 THEN kv ELSE 1 END AS zv, ds / CASE WHEN ks > 0 THEN ks ELSE 1 END AS zs FROM y JOIN k USING (query_id)),
            u AS (SELECT *, exp((ln(coalesce(1 / (1 + exp(-greatest(-30, least(30, zb)))), 5e-2)) + ln(coalesce(1 / (1 + exp(-greatest(-30, least(30, zv)))), 5e-2)) + ln(coalesce(1 / (1 + exp(-greatest(-30, least(30, zs)))), 5e-2))) / 3) AS fused FROM z)
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(fused, 12) DESC, chunk_id NULLS LAST) AS position, chunk_id, round(fused, 9) AS fused,
              CASE WHEN vb IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY vb DESC NULLS LAST) END AS place_bm25,
              CASE WHEN vv IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY vv DESC NULLS LAST) END AS place_vector,
              CASE WHEN vs IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY vs DESC NULLS LAST) END AS place_score FROM u""",
        "p5_found": f"""
            WITH d AS ({ONE_TEXT}),
            p AS (SELECT chunk_id, unnest({WORDS}) AS term FROM d),
            tf AS (SELECT chunk_id, term, count(*) AS tf FROM p GROUP BY ALL),
            df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
            SELECT chunk_id, term FROM tf JOIN df USING (term) WHERE length(term) >= 4 AND tf >= 4 AND df BETWEEN 2 AND 8""",
        "p5_weights": f"""
            WITH d AS ({ONE_TEXT}),
            w AS (SELECT chunk_id, {WORDS} AS ws FROM d),
            c AS (SELECT count(*)::DOUBLE AS n_docs, sum(len(ws))::DOUBLE AS n_words FROM w),
            tf AS (SELECT chunk_id, term, doc_len, count(*) AS tf FROM (SELECT chunk_id, len(ws) AS doc_len, unnest(ws) AS term FROM w) GROUP BY ALL),
            df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
            SELECT chunk_id, term, tf, df, doc_len,
              round(ln(1e0 + (n_docs - df + 5e-1) / (df + 5e-1)) * tf / (tf + 15e-1 * (25e-2 + 75e-2 * doc_len * n_docs / n_words)), 6) AS weight
            FROM tf JOIN df USING (term), c""",
        "p8_found": f"""
            WITH d AS (SELECT doc_id AS id, {WORDS} AS ws FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
            i AS (SELECT item_id AS id, {WORDS} AS ws FROM eval_items WHERE text IS NOT NULL AND item_id IS NOT NULL),
            dg AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k : k + 11], ' '))) AS gram FROM d),
            ig AS (SELECT DISTINCT id, unnest(list_transform(range(1, len(ws) - 10), lambda k: array_to_string(ws[k : k + 11], ' '))) AS gram FROM i)
            SELECT DISTINCT dg.id AS doc_id, ig.id AS item_id FROM dg JOIN ig USING (gram)""",
        "p6_tiles": """
            SELECT DISTINCT chunk_id, md5(text) AS text_hash, TRUE AS within, TRUE AS overlapping, coalesce(start_line, 1)::BIGINT AS start_line,
              (length(text) - length(replace(text, chr(10), '')) + CASE WHEN suffix(text, chr(10)) THEN 0 ELSE 1 END)::BIGINT AS n_lines FROM chunks WHERE length(text) > 800""",
        "p6_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 800",
    }
