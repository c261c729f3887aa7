"""The engine: build and update an index of a source tree, search it, make contexts.

Every build writes a new generation of the tables and then its commit file, which is the
commit point: a build that fails leaves the generation before it in force. Tables and
commit files lie in one folder, by default inside the tree, on any file system that
driver and executors share.
"""

from __future__ import annotations

import importlib.util
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.config import Config
from siftspark.functions import text as T
from siftspark.operators import bm25, chunking, fusion, fuzzy, lifecycle, rag, vectors
from siftspark.session import ship
from siftspark.sources import srcfiles
from siftspark.storage import CommitLog, Folder

FILES = "rel_path string, file_hash string, mtime double, size long, language string"
CHUNKS = "chunk_id string, rel_path string, file_hash string, language string, start_line int, end_line int, text string"
VECTORS = "chunk_id string, rel_path string, file_hash string, vector array<float>"


class Engine:
    def __init__(self, spark: SparkSession, root: str, cfg: Config | None = None, embedder: Callable | None = None, folder: str | None = None) -> None:
        self.spark, self.cfg, self.embedder = spark, cfg or Config(), embedder
        self.root = srcfiles.absolute(str(root))
        self.folder = Folder(spark, folder or f"{self.root}/{self.cfg.index_dir_name}")
        self.log = CommitLog(self.folder)
        ship(spark)

    # ------------------------------------------------------------ state
    def state(self) -> dict:
        """What the last commit says, with its ``generation``; empty without one."""
        done = self.log.numbers()
        return {**self.log.read(done[-1]), "generation": done[-1]} if done else {}

    def exists(self) -> bool:
        return bool(self.state())

    def destroy(self) -> None:
        self.folder.remove()

    def _table(self, name: str, schema: str) -> DataFrame:
        at = f"gen={self.state().get('generation', 0)}/{name}"
        return self.spark.read.schema(schema).parquet(self.folder.path(at)) if self.folder.exists(at) else self.spark.createDataFrame([], schema)

    def files(self) -> DataFrame:
        return self._table("files", FILES)

    def chunks(self) -> DataFrame:
        return self._table("chunks", CHUNKS)

    def all_chunks(self) -> DataFrame:
        """Chunks in reading order: by path, then by line."""
        return self.chunks().orderBy("rel_path", "start_line", "chunk_id")

    def vectors(self) -> DataFrame:
        return self._table("vectors", VECTORS)

    def keywords(self) -> bm25.KeywordIndex | None:
        state = self.state()
        return bm25.KeywordIndex.read(self.spark, self.folder.path(f"gen={state['generation']}")) if state else None

    # ------------------------------------------------------------ build
    def index(self, rebuild: bool = False, progress: Callable[[str], None] | None = None) -> dict:
        """Take up new and changed files, drop removed ones; the seven counters of the build.

        The tree is hashed once; only new and changed files are read again for their text.
        """
        say = progress or (lambda phase: None)
        if rebuild:
            self.destroy()
        generation = self.state().get("generation", 0) + 1
        self.folder.remove(f"gen={generation}")  # left by a build that did not commit
        at = lambda name: self.folder.path(f"gen={generation}/{name}")

        def kept(df: DataFrame, name: str, schema: str) -> DataFrame:
            df.write.parquet(at(name))
            return self.spark.read.schema(schema).parquet(at(name))

        say("scan")
        scanned = srcfiles.scan(self.spark, self.root, self.cfg.max_file_bytes)
        current = kept(scanned.select("rel_path", "file_hash", "mtime", "size", "language"), "files", FILES)
        changes = lifecycle.diff(self.files(), current)
        stale = lifecycle.to_purge(changes)
        fresh = current.join(changes.where("change in ('new', 'changed')").select("rel_path"), "rel_path", "left_semi")
        if importlib.util.find_spec("pypdf") is None and (n := fresh.where("language = 'pdf'").count()):
            warnings.warn(f"pypdf is not installed: {n} PDF files are indexed without text", stacklevel=2)
        say("chunk")
        made = chunking.chunk_files(srcfiles.with_text(srcfiles.contents(fresh, self.root)), self.cfg.chunk_size, self.cfg.chunk_overlap)
        added = kept(made, "new_chunks", CHUNKS)
        # Files of equal content make equal chunk ids: both keep their rows, and a search shows the last path.
        chunks = kept(lifecycle.upsert(lifecycle.purge(self.chunks(), stale), added, ["chunk_id", "rel_path"]), "chunks", CHUNKS)
        say("embed")
        key = ["chunk_id", "rel_path"]
        known = self.vectors().join(chunks.select(*key), key, "left_semi")
        new = vectors.embed(chunks.join(known.select(*key), key, "left_anti"), "text", self.embedder, self.cfg.embedding_dim)
        known.unionByName(new.select("chunk_id", "rel_path", "file_hash", "vector")).write.parquet(at("vectors"))
        say("keywords")
        bm25.KeywordIndex.build(chunks).write(self.folder.path(f"gen={generation}"))
        counters = lifecycle.stats(changes, chunks, added).first().asDict()
        self.log.add(generation, {"embedding": [self.cfg.embedding_model, self.cfg.embedding_dim], "tree": self.root, "counters": counters})
        self.folder.remove(f"gen={generation}/new_chunks")
        for name in self.folder.names():
            if name.startswith("gen=") and name != f"gen={generation}":
                self.folder.remove(name)
        for n in self.log.numbers():
            if n < generation:
                self.folder.remove(f"commits/{n}.json")
        return counters

    # ------------------------------------------------------------ search
    def _queries(self, query: str | DataFrame) -> DataFrame:
        return self.spark.createDataFrame([(1, query)], "query_id long, query_text string") if isinstance(query, str) else query

    def search(self, query: str | DataFrame, k: int | None = None, pad_zero_scores: bool = True) -> DataFrame:
        """Hits of one query or a frame of queries (``query_id, query_text``).

        Without a table of vectors the keyword ranking stands alone; a vector search that
        fails is an error, not half a result.
        """
        k, pool = self.cfg.k(k), self.cfg.pool(k)
        queries = self._queries(query).where("query_text is not null")
        index = self.keywords()
        if index is None:
            raise FileNotFoundError(f"no index under {self.folder.root}")
        extra = fuzzy.expand(queries, index.vocab, self.cfg.fuzzy_threshold, self.cfg.fuzzy_expand_per_term)
        by_words = index.search(queries, pool, extra, pad_zero_scores)
        asked = vectors.embed(queries, "query_text", self.embedder, self.cfg.embedding_dim, mode="query")
        by_vector = vectors.nearest(asked, self.vectors().dropDuplicates(["chunk_id"]), pool)
        return fusion.hydrate(fusion.fuse_ranks(by_words, by_vector, self.cfg.rrf_k, k), self.chunks())

    def context(self, hits: DataFrame) -> DataFrame:
        return rag.bounded_context(hits, self.cfg.context_chars)

    def snippets(self, hits: DataFrame) -> DataFrame:
        return hits.withColumn("snippet", T.snippet(F.col("text"), self.cfg.snippet_chars)).withColumn("label", T.hit_label(F.col("bm25_rank"), F.col("vector_rank"), F.col("score")))

    def stats(self) -> dict:
        return {"files": self.files().count(), "chunks": self.chunks().count(), "vectors": self.vectors().count()}

    def project_stats(self) -> dict:
        """Files and lines of the tree, without an index."""
        return srcfiles.project_stats(srcfiles.scan(self.spark, str(self.root), self.cfg.max_file_bytes)).first().asDict()
