"""Line-aligned chunks with overlap.

With prefix sums of line lengths, a chunk from line i ends before the last line that
keeps it within the size (one line at least); the next one starts as many whole lines
back as hold the overlap, but moves on by one line at least.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunk_lines(text: str, size: int = 800, overlap: int = 120) -> list[tuple[int, int, str]]:
    """(start_line, end_line, text): lines 1-based and inclusive, outer line feeds removed, blank chunks left out."""
    lines = text.splitlines(keepends=True)
    sums = [0, *accumulate(map(len, lines))]
    out, i, n = [], 0, len(lines)
    while i < n:
        j = max(i + 1, bisect_right(sums, sums[i] + size) - 1)
        body = "".join(lines[i:j]).strip("\n")
        if body.strip():
            out.append((i + 1, j, body))
        if j >= n:
            break
        i = max(i + 1, bisect_right(sums, sums[j] - overlap) - 1)
    return out


def chunk_files(files: DataFrame, size: int = 800, overlap: int = 120) -> DataFrame:
    """Chunks of files (``rel_path, file_hash, language, text``); null or empty texts give none.

    ``chunk_id`` is the hash and the running number of the kept chunks. Files are
    independent, so there is no shuffle.
    """
    base = files.where(F.length("text") > 0).select("rel_path", "file_hash", "language", "text")

    def cut(it):
        for batch in it:
            rows = []
            for path, digest, lang, text in zip(*(batch.column(c).to_pylist() for c in ("rel_path", "file_hash", "language", "text"))):
                rows += [(f"{digest}:{k}", path, digest, lang, a, b, body) for k, (a, b, body) in enumerate(chunk_lines(text, size, overlap))]
                if len(rows) > 5000:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)

    return base.mapInArrow(cut, "chunk_id string, rel_path string, file_hash string, language string, start_line int, end_line int, text string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()]
    names = ["chunk_id", "rel_path", "file_hash", "language", "start_line", "end_line", "text"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
