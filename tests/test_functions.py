import random

import pytest
from pyspark.sql import functions as F

from siftspark import models
from siftspark.config import Config
from siftspark.functions import text as T
from siftspark.operators import rag
from siftspark.operators.chunking import chunk_lines
from siftspark.operators.fuzzy import _Scorer, lcs, partial_ratio, ratio, similarity


def plain_chunks(text, size, overlap):
    """The chunking rules, line by line."""
    lines, out, i = text.splitlines(keepends=True), [], 0
    while i < len(lines):
        j, n = i, 0
        while j < len(lines) and (j == i or n + len(lines[j]) <= size):
            n += len(lines[j])
            j += 1
        body = "".join(lines[i:j]).strip("\n")
        if body.strip():
            out.append((i + 1, j, body))
        if j >= len(lines):
            break
        k, back = j, 0
        while k > i + 1 and back < overlap:
            k -= 1
            back += len(lines[k])
        i = max(k, i + 1)
    return out


@pytest.mark.parametrize("size,overlap", [(40, 10), (40, 0), (10, 40), (25, 7)])
def test_chunks_follow_the_rules(size, overlap):
    r = random.Random(size)
    for _ in range(200):
        text = "".join("".join(r.choice("ab \n\r\x0b ") for _ in range(r.randrange(30))) + "\n" for _ in range(r.randrange(9)))
        assert chunk_lines(text, size, overlap) == plain_chunks(text, size, overlap)


def test_one_long_line_is_one_chunk():
    assert chunk_lines("x" * 2000, 800, 120) == [(1, 1, "x" * 2000)]
    assert chunk_lines("\n \n", 800, 120) == []


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def slow_partial(a, b):
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    windows = [t[max(0, i) : i + len(s)] for i in range(1 - len(s), len(t))]
    return max((200 * slow_lcs(s, w) / (len(s) + len(w)) for w in windows if w), default=0)


def test_similarity_against_tables():
    r = random.Random(3)
    words = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 12))) for _ in range(60)]
    for a in words[:30]:
        for b in words[30:]:
            assert lcs(a, b) == slow_lcs(a, b)
            assert partial_ratio(a, b) == pytest.approx(slow_partial(a, b))
    assert round(ratio("ingesion", "ingestion"), 2) == 94.12
    assert round(similarity("the", "them"), 1) == 85.7


def test_pruning_loses_nothing():
    r = random.Random(4)
    words = ["".join(r.choice("abce") for _ in range(r.randrange(1, 14))) for _ in range(150)]
    scorer = _Scorer(words[:50], 82)
    want = [(t, w, similarity(t, w)) for t in words[:50] for w in words[50:] if similarity(t, w) >= 82]
    assert sorted(scorer.block(words[50:])) == sorted(want) and len(want) > 20


def test_decoding():
    assert T.decode_bytes("é".encode()) == "é"
    assert T.decode_bytes(b"a" * 4095 + b"\0") == ""
    assert T.decode_bytes(b"a" * 4096 + b"\0") == "a" * 4096 + "\0"
    assert T.decode_bytes("naïve zz".encode("latin-1") + b"!") == "naïve zz!"
    assert T.decode_bytes(None) is None
    assert T.pdf_text(b"no pdf") == ""


def test_paths_and_languages(spark):
    rows = {
        "a/__init__.py": (True, "python"), "a/_x/y.go": (True, "go"), ".hid/a.py": (False, "python"), "a/.hid.py": (False, "python"), "a/Dockerfile": (True, "dockerfile"),
        "GNUmakefile": (True, "makefile"), "x.dockerfile": (True, "text"), "a.pyi": (False, "python"), "A.PY": (True, "python"), "x.bundle.css": (False, "css"), "foo.lock": (False, "text"),
        "node_modules/x/e.js": (False, "javascript"), "src/build/x.c": (False, "c"), "coverage.xml": (False, "xml"), "noext": (False, "text"), "Build/x.c": (True, "c"), "dot.": (False, "text"),
    }
    df = spark.createDataFrame([(p,) for p in rows], "p string")
    got = {r.p: (r.i, r.l) for r in df.select("p", T.is_indexed_path(F.col("p")).alias("i"), T.language(F.col("p")).alias("l")).collect()}
    assert got == rows


def test_lines_and_snippets(spark):
    df = spark.createDataFrame([("a\nb\n", 2), ("a\nb", 2), ("", 0), (None, 0), ("\n", 1)], "t string, n int")
    assert all(r.n == r.c for r in df.select("n", T.line_count(F.col("t")).alias("c")).collect())
    df = spark.createDataFrame([("abc  \n", "abc"), ("abcdef ghi", "abcdef\n..."), ("ab　", "ab")], "t string, w string")
    assert all(r.w == r.s for r in df.select("w", T.snippet(F.col("t"), 7).alias("s")).collect())


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    assert Config.from_file(path) == Config()
    path.write_text("top_k = 3\nnonsense = 1\n")
    assert Config.from_file(path, rrf_k=9, model=None) == Config(top_k=3, rrf_k=9)
    path.write_text("top_k = = 3")
    assert Config.from_file(path) == Config()
    Config.save(path, model='a"b\\é', show_line_ranges=False, other=1)
    Config.save(path, llm_temperature=0.5)
    assert Config.from_file(path) == Config(model='a"b\\é', show_line_ranges=False, llm_temperature=0.5)
    assert Config().k(0) == 8 and Config().pool() == 32 and Config().pool(2) == 20
    with pytest.raises(ValueError):
        Config().k(-1)


TIERS = [(0, 0, "tiny"), (10, 500, "tiny"), (200, 50_000, "tiny"), (201, 50_001, "small"), (1000, 200_000, "small"), (1500, 500_000, "small"), (1501, 500_001, "deep"), (5000, 5_000_000, "deep"), (-1, -5, "tiny"), (10, 60_000, "small")]


def test_tiers(spark):
    df = spark.createDataFrame(TIERS, "f long, n long, t string")
    assert df.where(models.advise(F.col("f"), F.col("n")) != F.col("t")).count() == 0
    assert models.resolve(" Medium ") == "deep" and "* small" in models.table("small")
    with pytest.raises(ValueError):
        models.resolve("huge")


def test_conversation_keeps_the_last_messages():
    seen = []

    def fake(messages):
        seen.append(messages)
        yield from ("An", "", "swer")

    talk = rag.Conversation(fake, keep=4)
    for i in range(4):
        assert "".join(talk.ask(f"q{i}", "ctx")) == "Answer"
    assert [m["content"] for m in talk.history] == ["q2", "Answer", "q3", "Answer"]
    assert [m["role"] for m in seen[-1]][-2:] == ["system", "user"] and len(seen[-1]) == 6
    assert rag.model_available(["a:1b"], "a:7b") and not rag.model_available(None, "a")
