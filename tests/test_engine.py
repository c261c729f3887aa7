import io

import numpy as np
import pytest

from siftspark import cli
from siftspark.config import Config
from siftspark.operators import vectors
from siftspark.plans.engine import Engine
from siftspark.sources import srcfiles


@pytest.fixture(autouse=True)
def home(tmp_path, monkeypatch):
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "proj"
    files = {
        "pipeline.py": '"""Reads documents."""\n\nclass IngestionPipeline:\n    def load_documents(self, folder):\n        return folder\n',
        "auth.md": "# Sessions\n\nA session expires after thirty minutes without a request.\n",
        "pkg/__init__.py": "", "_private.py": "x = 1\n", "node_modules/a/b.js": "no", ".hidden.py": "no", "data.bin": "no", "big.txt": "x" * 2_000_001, "edge.txt": "y" * 2_000_000,
    }
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_scan_sees_what_the_binary_source_hides(spark, project):
    got = {r.rel_path: r for r in srcfiles.scan(spark, str(project)).drop("content").collect()}
    assert sorted(got) == ["_private.py", "auth.md", "edge.txt", "pipeline.py", "pkg/__init__.py"]
    assert got["auth.md"].language == "markdown" and got["pkg/__init__.py"].size == 0
    stats = srcfiles.project_stats(srcfiles.scan(spark, str(project))).first()
    assert (stats.file_count, stats.total_loc) == (5, 5 + 3 + 0 + 1 + 1)


def test_life_of_an_index(spark, project):
    engine = Engine(spark, project, Config(embedding_dim=64))
    assert not engine.exists()
    with pytest.raises(FileNotFoundError):
        engine.search("x")
    (project / "edge.txt").unlink()
    first = engine.index()
    assert first["new_files"] == 4 and first["total_chunks"] == 3 and first["embedded_chunks"] == 3
    again = engine.index()
    assert (again["new_files"], again["changed_files"], again["unchanged_files"], again["embedded_chunks"]) == (0, 0, 4, 0)
    best = lambda q: engine.search(q, 2).orderBy("position").first().rel_path
    assert best("IngestionPipeline load documents") == "pipeline.py"
    assert best("ingestionpipelin load_document") == "pipeline.py"
    assert best("session expires minutes") == "auth.md"
    # a copy, then a change of the original: the copy keeps its chunks
    (project / "copy.py").write_text((project / "pipeline.py").read_text())
    assert engine.index()["new_files"] == 1
    (project / "pipeline.py").write_text("def other():\n    return 2\n")
    (project / "_private.py").unlink()
    third = engine.index()
    assert (third["changed_files"], third["removed_files"]) == (1, 1)
    assert {r.rel_path for r in engine.chunks().collect()} == {"auth.md", "copy.py", "pipeline.py"}
    assert {r.rel_path for r in engine.vectors().collect()} == {"auth.md", "copy.py", "pipeline.py"}
    assert [r.rel_path for r in engine.all_chunks().collect()] == ["auth.md", "copy.py", "pipeline.py"]
    left = sorted(p.name for p in (project / ".siftspark").iterdir())
    assert left == ["commits", "gen=4"] and engine.state()["counters"]["changed_files"] == 1
    (project / ".siftspark/gen=5").mkdir()  # of a build that did not commit
    assert engine.state()["generation"] == 4 and engine.stats()["chunks"] == 3
    hits = engine.search("session", 2)
    assert "### auth.md:1-3 (markdown)" in engine.context(hits).first().context
    engine.destroy()
    assert not engine.exists()


def test_a_failing_embedder_is_an_error(spark, project, tmp_path):
    (project / "edge.txt").unlink()

    def broken(texts, mode="passage"):
        if mode == "query":
            raise RuntimeError("no model")
        return np.ones((len(texts), 4)) / 2

    engine = Engine(spark, project, Config(embedding_dim=4), broken, folder=str(tmp_path / "elsewhere"))
    assert engine.index()["embedded_chunks"] == 3 and not (project / ".siftspark").exists()
    with pytest.raises(Exception, match="no model"):
        engine.search("session", 2).collect()


def test_an_encoder_of_a_given_file(spark, monkeypatch):
    class Piece:
        def __init__(self, text):
            self.ids = [len(w) for w in text.split()][:3] + [0] * (3 - len(text.split()))
            self.attention_mask = [int(i > 0) for i in self.ids]

    class Stub:
        def encode_batch(self, texts):
            return [Piece(t) for t in texts]

        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def run(self, _, said):
            return [np.stack([said["input_ids"], said["input_ids"] * 0 + 1], -1).astype(float)]

    make = vectors.ModelEmbedder("m", "t", query_prefix="xxxxxxxx ")
    monkeypatch.setattr(vectors.ModelEmbedder, "_load", lambda self: (Stub(), Stub()))
    plain = make(["ab abcd", "abc"])
    assert np.allclose(plain, np.array([[3, 1], [3, 1]]) / np.sqrt(10)) and np.allclose(make(["ab"], mode="query"), np.array([[5, 1]]) / np.sqrt(26))


def test_command_line(spark, project, monkeypatch):
    (project / "edge.txt").unlink()

    def run(*args, **kw):
        out = io.StringIO()
        return cli.main([*args, "-p", str(project)], spark=spark, out=out, **kw), out.getvalue()

    code, said = run("search", "session", "--no-auto-index")
    assert code == 1 and "No index found" in said and not (project / ".siftspark").exists()
    code, said = run("search", "session expires", "--auto-index", "--no-summary")
    assert code == 0 and "auth.md:1-3" in said
    code, said = run("search", "session", generator=lambda messages: iter(["It ", "expires."]))
    assert code == 0 and "Answer" in said and "It expires." in said and "Sources" in said
    assert run("ask", "session", "--no-llm")[0] == 0

    def broken(messages):
        yield "a"
        raise OSError("gone")

    assert run("ask", "session", generator=broken)[0] == 3
    monkeypatch.setattr(cli.rag, "server_models", lambda url: None)
    assert run("setup", "--tier", "small")[0] == 0 and "gemma3:4b" in run("doctor")[1]
    assert run("setup", "-y")[0] == 0 and run("setup", "--tier", "tiny", "--no-pull")[0] == 0 and Config.from_file().model == "qwen2.5-coder:1.5b"
    assert run("setup", "--tier", "huge")[0] == 1 and run("setup", "--tier", "tiny", "--pull")[0] == 2
    monkeypatch.setattr(cli.rag, "server_models", lambda url: ["other:1b"])
    fetched = []
    monkeypatch.setattr(cli.rag, "fetch_model", lambda url, name: fetched.append(name))
    assert run("setup", "--model", "m:1", "--pull")[0] == 0 and run("doctor", "--pull", "--write-config")[0] == 0 and fetched == ["m:1", "m:1"]
    monkeypatch.setattr(cli.rag, "fetch_model", lambda url, name: (_ for _ in ()).throw(OSError("gone")))
    assert run("setup", "-m", "m:2", "-y")[0] == 2 and "model: m:2 is missing" in run("doctor", "--pull")[1]
    assert run("reset", "-y")[0] == 0 and not (project / ".siftspark").exists()
    assert cli.parse_slash("/k 0", 8, "m") == ("set", 1, "m") and cli.parse_slash("/k x", 8, "m")[0] == "unknown" and cli.parse_slash("/q", 8, "m")[0] == "exit"
