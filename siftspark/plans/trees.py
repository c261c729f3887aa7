"""Queries that run the engine over a tree of files, written from the documents table.

Each document becomes a file on the shared folder; names that an index must not take up
stand beside some. The folder must be a path that driver and executors see as files.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.config import Config
from siftspark.plans.engine import Engine
from siftspark.session import checkpoint_dir, delete_at_end, table
from siftspark.sources import srcfiles

#: Suffix of a document's file by the remainder of its id.
SUFFIXES = (".md", ".py", ".txt", ".YAML", "")
SETTINGS = Config(embedding_dim=8)


def documents(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, text, rel_path``: one row per id with a text."""
    rows = table(spark, d, "documents").where("doc_id is not null and text is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.pmod("doc_id", F.lit(len(SUFFIXES))) + 1).cast("int"))
    name = F.when(suffix == "", F.concat(F.lit("m"), F.col("doc_id"), F.lit("/Makefile"))).otherwise(F.concat(F.lit("_d/"), F.col("doc_id"), suffix))
    return rows.withColumn("rel_path", name)


def write_tree(docs: DataFrame, root: str) -> None:
    """The documents as files; of every tenth also copies under names that are not indexed."""

    def put(rows):
        for r in rows:
            wanted = [r["rel_path"]]
            if r["doc_id"] % 10 == 0:
                wanted += [f"node_modules/{r['doc_id']}.md", f".cache/{r['doc_id']}.md", f"_d/.{r['doc_id']}.md", f"_d/{r['doc_id']}.min.js", f"_d/{r['doc_id']}.bin"]
            for name in wanted:
                at = os.path.join(root, name)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(at, "wb") as f:
                    f.write(r["text"].encode("utf-8"))

    docs.foreachPartition(put)


def _new_folder(spark: SparkSession, name: str) -> str:
    at = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    delete_at_end(spark, at)
    return at.removeprefix("file://") if at.startswith("file:///") else at.removeprefix("file:")


def _tree(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    docs, root = documents(spark, d), _new_folder(spark, "tree")
    write_tree(docs, root)
    return docs, root


def scan_tree(spark, d):
    """Files that a scan takes up, with their decoded texts."""
    _, root = _tree(spark, d)
    found = srcfiles.with_text(srcfiles.scan(spark, root))
    return found.select("rel_path", "size", "file_hash", "language", F.sha1(F.col("text").cast("binary")).alias("text_hash"))


def project_size(spark, d):
    return srcfiles.project_stats(srcfiles.scan(spark, _tree(spark, d)[1]))


def later(docs: DataFrame) -> DataFrame:
    """The documents at the second build: a tenth is gone, a tenth has a line more, a tenth is new under another name."""
    kept = docs.where("doc_id % 10 <> 1").withColumn("text", F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("\nlast line"))).otherwise(F.col("text")))
    return kept.unionByName(docs.where("doc_id % 10 = 3").withColumn("rel_path", F.concat(F.lit("new/"), F.col("doc_id"), F.lit(".txt"))))


def _built(spark, d) -> tuple[Engine, list[dict]]:
    docs, root = _tree(spark, d)
    engine = Engine(spark, root, SETTINGS, folder=_new_folder(spark, "index"))
    counters = [engine.index(), engine.index()]
    gone = docs.where("doc_id % 10 = 1").select("rel_path")

    def remove(rows):
        for r in rows:
            os.remove(os.path.join(root, r["rel_path"]))

    gone.foreachPartition(remove)
    write_tree(later(docs), root)
    return engine, [*counters, engine.index()]


def index_builds(spark, d):
    """The counters of three builds: of a new tree, of the same, and of a changed one."""
    _, counters = _built(spark, d)
    names = list(counters[0])
    return spark.createDataFrame([(i + 1, *(c[n] for n in names)) for i, c in enumerate(counters)], "build long, " + ", ".join(f"{n} long" for n in names))


def index_contents(spark, d):
    """Chunks and vectors after the third build."""
    engine, _ = _built(spark, d)
    vectors = engine.vectors().select("chunk_id", "rel_path", F.size("vector").alias("dim"))
    return engine.all_chunks().join(vectors, ["chunk_id", "rel_path"], "left").select("chunk_id", "rel_path", "language", "start_line", "end_line", F.length("text").cast("int").alias("n_chars"), "dim")
