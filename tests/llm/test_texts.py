"""Encoding repair, distinctive terms, splitting, rank mixing, mixtures, personal information."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siftspark.llm import distinctive, mixture, mojibake, pii, rankmix, splitting

FINE = [
    "Für größere Straße wäre eine zusätzliche Prüfung nötig.", "La vérification a échoué à cause de l'été… “déjà” – voilà • fin.", "NÃO remova função; há exceções em posição.", "¿Por qué? Después de mañana, señal.",
    "Każdą część należy sprawdzić, gdyż źródło ginie.", "Ошибка в проверка приводит к задержке: ссылка ждёт.", "运行文件之前必须检查，否则会变成空的（见说明）。", "├── a.py  # ≤ 15 µs, ±3 °C, √n", "valve更新以后 🚀 naïve café", "ÄNDERUNG DER GRÖSSE", "x = a ?? b; y != z",
]


@pytest.mark.parametrize("line", FINE)
def test_correct_text_is_left_alone(line):
    assert mojibake.repair_line(line) == (line, None)


@pytest.mark.parametrize("page", ["cp1252", "cp437", "cp850", "mac_roman", "latin-1"])
@pytest.mark.parametrize("line", FINE[:5])
def test_multibyte_text_comes_back(line, page):
    bad = "".join(bytes([b]).decode(page) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) or page != "cp1252" else chr(b) for b in line.encode())
    fixed, kind = mojibake.repair_line(bad)
    assert kind in ("multibyte", "lost") and (fixed == line or page == "mac_roman")


def test_other_damage():
    twice = FINE[1].encode().decode("latin-1").encode().decode("latin-1")
    assert mojibake.repair_line(twice) == (FINE[1], "multibyte")
    assert mojibake.repair_line(FINE[5].encode("cp1251").decode("latin-1")) == (FINE[5], "single")
    assert mojibake.repair_line(FINE[5].encode("koi8_r").decode("cp1251")) == (FINE[5], "single")
    assert mojibake.repair_line(FINE[5].encode().decode("cp1251", "replace"))[1] is not None
    assert mojibake.repair_line("пустой.") == ("пустой.", None)
    assert mojibake.repair_text((FINE[5] + "\nпустой.").encode("koi8_r").decode("cp1251")) == (FINE[5] + "\nпустой.", [1, 2], ["single", "single"])
    assert mojibake.repair_line("├── a.py".encode().decode("cp1251", "replace"))[1] is not None
    assert mojibake.repair_line("M�glich")[1] == "lost"
    assert mojibake.repair_line("if c == '�': skip")[1] is None and mojibake.repair_line("'�' and l�ss")[1] == "lost"
    assert mojibake.repair_line("ссылка".encode("koi8_r").decode("cp1251")) == ("ссылка", "single")
    assert mojibake.repair_text("plain\ntext") == ("plain\ntext", [], [])


def test_garbled_rows(spark):
    df = spark.createDataFrame([("a", "ok\nfÃ¼r"), ("a", "ok\nfÃ¼r"), ("b", "für"), ("c", None), ("d", ""), (None, "fÃ¼r"), ("e", "x" * 50_000 + "\nVerzÃ¶gerung")], "chunk_id string, text string").withColumn("restored", F.lit(1))
    got = {r.chunk_id: (r.garbled_lines, r.restored[-12:]) for r in mojibake.garbled_text(df).collect()}
    assert got == {"a": ([2], "ok\nfür"), "e": ([2], "\nVerzögerung"[-12:]), None: ([1], "für")}
    assert mojibake.garbled_text(df.limit(0)).count() == 0


def test_weights_equal_the_formula(spark):
    r = random.Random(1)
    texts = {f"d{i}": " ".join(r.choice("ab cd ef gh ij kl mn Größe x_1 Ü".split()) for _ in range(r.randrange(0, 30))) for i in range(40)}
    df = spark.createDataFrame([*texts.items(), *list(texts.items())[:5], ("n", None), (None, "ab")], "id string, text string").withColumn("tf", F.lit("clash")).repartition(3)
    got = {(x.id, x.term): (x.tf, x.df, x.doc_len, x.weight) for x in distinctive.distinctive_terms(df, "id", "text").collect()}
    words = {d: re.findall(r"\w+", t.lower()) for d, t in texts.items()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df_ = Counter(t for w in words.values() for t in set(w))
    assert set(got) == {(d, t) for d, w in words.items() for t in w}
    for (d, t), (tf, dfreq, dl, weight) in got.items():
        assert (tf, dfreq, dl) == (words[d].count(t), df_[t], len(words[d]))
        assert weight == pytest.approx(math.log(1 + (n - dfreq + 0.5) / (dfreq + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / avg)))
    few = {(x.id, x.term) for x in distinctive.distinctive_terms(df, "id", "text", least_tf=3).collect()}
    assert few == {k for k, v in got.items() if v[0] >= 3}
    assert distinctive.distinctive_terms(df.limit(0), "id", "text").count() == 0


def cores(text, language=None, limit=200):
    return [text[a:b] for a, b in splitting.pack(text, limit, language)]


def test_a_finished_node_does_not_join_its_sibling():
    a1, b = "## A1\n" + "word " * 50 + "\n", "## B\nshort\n"
    text = "# A\n" + a1 + "# C\n" + b
    pieces = cores(text)
    assert not any("word" in p and ("# C" in p or "## B" in p) for p in pieces)
    assert "# C\n## B\nshort\n" in pieces
    siblings = "".join(f"## S{i}\n{'x ' * 20}\n" for i in range(9))
    assert all(p.startswith("## S") and p.count("## S") == 4 for p in cores(siblings)[:-1])


def test_fences_comments_and_elements():
    fenced = "intro text\n\n```\n# not a heading\n\ncode\n```\n\n# Real\n" + "body " * 30
    assert any(p.startswith("```") or "```\n# not a heading\n\ncode\n```" in p for p in cores(fenced, "markdown", 160))
    assert any(p.startswith("# Real") for p in cores(fenced, "markdown", 160))
    code = "def f():\n" + "    x = 1\n" * 8 + "# a comment\n" + "    y = 2\n" * 8 + "def g():\n" + "    z = 3\n" * 12
    assert any(p.startswith("def g") for p in cores(code, "python")) and not any(p.startswith("# a comment") and "def g" in p for p in cores(code, "python"))
    page = "<html><body>" + "".join(f"<div><h2>T{i}</h2><p>{'word ' * 12}<br>{'more ' * 8}</p></div>" for i in range(6)) + "</body></html>"
    pieces = cores(page, "html")
    assert sum(p.startswith("<div>") for p in pieces) >= 5 and all(p.count("<div>") <= 1 for p in pieces) and "".join(pieces) == page


def texts_to_split():
    r = random.Random(2)
    yield "x" * 5000
    yield "a b " * 900
    yield "\r\n".join("word " * r.randrange(1, 30) for _ in range(60))
    yield "# One\n\n" + "para one. " * 40 + "\n\n## Two\n\n" + "\n".join(f"- item {i} " + "t " * 30 for i in range(30)) + "\n\nLast\n====\n" + "end. " * 100
    yield "def f():\n" + "".join(f"    if x{i}:\n" + "        y(z)\n" * r.randrange(1, 9) for i in range(60))
    for _ in range(20):
        yield "".join(r.choice("abc .\n#-\t;é") for _ in range(r.randrange(801, 4000)))


@pytest.mark.parametrize("text", list(texts_to_split()))
def test_pieces_tile_the_text(text):
    for language in (None, "python", "html"):
        check_tiling(text, splitting.split_text(text, 800, 120, language))


def check_tiling(text, pieces):
    assert "".join(text[c:b] for _, c, b in pieces) == text
    for k, (a, c, b) in enumerate(pieces):
        assert 0 < b - a <= 800 and c - a <= 120 and (k == 0) == (a == c == 0 and k == 0)
    assert len(pieces) <= len(text) / 200 + 2


def test_cuts_fall_on_boundaries():
    text = "".join(f"## Part {i}\n\n" + "Some sentence here. " * 15 + "\n\n" for i in range(12))
    for _, c, _ in splitting.split_text(text, 800, 120):
        assert text[c:].startswith("## Part")


def test_split_rows(spark):
    long = "line\n" * 400
    df = spark.createDataFrame([("a", 11, long), ("a", 11, long), ("b", None, long[:-1]), ("c", 1, "x" * 800), ("d", 1, None), ("e", 1, "")], "chunk_id string, start_line int, text string").withColumn("piece", F.lit("clash"))
    got = splitting.split_oversized(df).collect()
    assert {r.chunk_id for r in got} == {"a", "b"}
    for r in got:
        first = 11 if r.chunk_id == "a" else 1
        assert r.start_line == first + long[: r.start_char].count("\n") and r.end_line == first + long[: r.end_char - 1].count("\n")
    assert max(r.end_line for r in got if r.chunk_id == "a") == 410
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_no_signal_dominates(spark):
    s = "query_id long, chunk_id string, bm25_rank int, vector_rank int, score double, fused string"
    rows = [(1, f"c{i}", i, i, 1e9 if i == 20 else 20.0 - i, "x") for i in range(1, 21)]
    got = {r.chunk_id: r for r in rankmix.fuse_scores(spark.createDataFrame([*rows, rows[0], (None, "z", 1, 1, 1.0, None)], s)).collect()}
    assert len(got) == 20 and got["c1"].position == 1 and got["c20"].position > 10 and got["c20"].place_score == 1
    assert all(0 < got[c].u_score < 1 for c in got) and got["c1"].fused_given == "x"


def test_places_medians_and_ties(spark):
    import statistics

    r = random.Random(5)
    rows = [(q, f"c{i}", r.choice([None, *range(1, 9)]), r.choice([None, *range(1, 9)]), r.choice([None, 0.1, 0.2, 0.5, float("nan"), 3.0])) for q in (1, 2) for i in range(61 - q)] + [(3, None, None, None, None)]
    rows += [(4, f"t{i:04d}", None, None, 1.0) for i in range(3000)]  # one hot query of nothing but ties
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, bm25_rank int, vector_rank int, score double").repartition(5)
    got = {(x.query_id, x.chunk_id): x for x in rankmix.fuse_scores(df).collect()}
    assert len(got) == len(rows)
    for q in (1, 2):
        mine = [v for v in rows if v[0] == q]
        for name, at, sign in (("bm25", 2, -1), ("vector", 3, -1), ("score", 4, 1)):
            vals = [sign * v[at] for v in mine if v[at] is not None and v[at] == v[at]]
            m = statistics.median(vals)
            d = 1.4826 * statistics.median(abs(v - m) for v in vals) or 1.0
            for v in mine:
                x, known = got[q, v[1]], v[at] is not None and v[at] == v[at]
                assert x[f"place_{name}"] == (1 + sum(o > sign * v[at] for o in vals) if known else None)
                assert x[f"z_{name}"] == (pytest.approx((sign * v[at] - m) / d) if known else None)
        order = sorted((x for k, x in got.items() if k[0] == q), key=lambda x: (-round(x.fused, 12), x.chunk_id))
        assert [x.position for x in order] == list(range(1, len(mine) + 1))
    assert all(got[4, f"t{i:04d}"].position == i + 1 for i in range(3000))
    assert rankmix.fuse_scores(df.limit(0)).count() == 0


def test_rows_that_all_signals_place_first(spark):
    r = random.Random(6)
    rows = [(q, f"c{i}", r.choice([None, *range(1, 30)]), r.choice([None, *range(1, 30)]), r.choice([None, r.random(), 0.9, 0.95])) for q in range(40) for i in range(30)]
    df = spark.createDataFrame(rows, "query_id long, chunk_id string, bm25_rank int, vector_rank int, score double").withColumn("_bar", F.lit("clash"))
    got = {(x.query_id, x.chunk_id) for x in rankmix.best_of_all(df, 12).collect()}
    above = lambda v: sum(o[0] == v[0] and o[4] is not None and o[4] > v[4] for o in rows)
    assert got == {(v[0], v[1]) for v in rows if None not in v and v[2] <= 12 and v[3] <= 12 and above(v) < 12} and len(got) > 20
    assert rankmix.best_of_all(df.limit(0)).count() == 0


def test_mixture_reaches_its_shares(spark):
    r = random.Random(6)
    docs = [(i, r.choice(["big", "BIG ", "small_one", "small-one", "none", None]) if i % 4 else "big", "word " * r.randrange(1, 60)) for i in range(3000)] + [(5000, "big", None), (5001, "big", ""), (None, "big", "x"), (0, "big", docs0)] if (docs0 := "word ") else []
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("copies", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.3, 1), ("small one", 0.6, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    chosen, shares = mixture.mix_sources(df, targets)
    got = {x.source: x for x in shares.collect()}
    assert set(got) == {"big", "small-one", "absent"} and got["absent"].mixture_tokens == 0
    assert got["big"].actual_share == pytest.approx(0.3 / 0.9, abs=0.03) and got["small-one"].rate <= 3
    assert chosen.where("copies < 1 or tokens < 1").count() == 0
    assert chosen.groupBy("doc_id").count().where("count > 1").count() == 0
    x = got["small-one"]
    per = chosen.where("source = 'small-one'").agg(F.min("copies"), F.max("copies")).first()
    assert math.floor(x.rate) <= per[0] or per[0] == 1
    assert per[1] <= math.ceil(x.rate)
    assert sorted(map(tuple, chosen.collect())) == sorted(map(tuple, mixture.mix_sources(df.repartition(7), targets)[0].collect()))
    empty, none = mixture.mix_sources(df.limit(0), targets)
    assert empty.count() == 0 and none.count() == 3


def test_sources_below_their_caps_make_up_for_the_others(spark):
    tokens = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 1000), ("a", 0)], "source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.25, 3), ("c", 0.25, 1), ("gone", 0.5, 9)], "source string, target_share double, max_repeats int")
    given = lambda n: {x.source: x.rate * x.available_tokens for x in mixture.mixture_rates(tokens, targets, n).collect()}
    assert given(None) == {"a": 200, "b": 100, "c": 100, "gone": 0}
    assert given(1200) == pytest.approx({"a": 200, "b": 500, "c": 500, "gone": 0})
    assert given(3200) == pytest.approx({"a": 200, "b": 2000, "c": 1000, "gone": 0})
    assert given(100) == pytest.approx({"a": 50, "b": 25, "c": 25, "gone": 0})
    assert given(10**6) == pytest.approx({"a": 200, "b": 3000, "c": 1000, "gone": 0})


NAMES = {"given": ["Anna", "Bruno", "Clara", "David", "Elena", "Felix", "Greta", "Hugo"], "family": ["Vossler", "Marenko", "Lindqvist", "Tavares", "Okonski", "Breland", "Duval", "Santori"]}


@pytest.fixture(scope="module")
def model():
    keep = pii.TRAIN_LINES, pii.STEPS
    pii.TRAIN_LINES, pii.STEPS = 2500, 30
    yield pii.fit(NAMES["given"], NAMES["family"])
    pii.TRAIN_LINES, pii.STEPS = keep


def test_held_out_accuracy(model):
    tagger = pii.Tagger(model)
    hits = made = truth = 0
    for doc in pii.training_lines(NAMES["given"], NAMES["family"], 600, seed=99):
        text, want = "", set()
        for line, spans in doc:
            want |= {(len(text) + a, len(text) + b, k) for a, b, k in spans}
            text += line + "\n"
        got = set(tagger.tag([text])[0])
        hits, made, truth = hits + len(got & want), made + len(got), truth + len(want)
    assert hits / truth > 0.9 and hits / made > 0.9


def test_skip_edges_agree_with_exact_marginals(model):
    """On a chain whose ends are joined, propagation is close to the exact sums."""
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    emit = r.normal(size=(4, pii.L))
    node, alpha, beta, *_ = pii.propagate(emit, pii.Layout(np.array([4])), np.array([[0, 3]]), model, rounds=12)
    got = pii._norm(alpha * beta)
    exact = np.zeros((4, pii.L))
    trans, skip = model.trans + pii.ALLOWED, model.skip_matrix()
    for y in itertools.product(range(pii.L), repeat=4):
        s = model.start[y[0]] + (-1e4 if y[0] == 6 else 0) + sum(emit[t, y[t]] for t in range(4)) + sum(trans[a, b] for a, b in zip(y, y[1:])) + skip[y[0], y[3]]
        for t in range(4):
            exact[t, y[t]] += math.exp(s)
    exact /= exact.sum(1, keepdims=True)
    assert abs(got - exact).max() < 0.15


def test_batches_of_chains_equal_single_ones(model):
    """Laid out together, chains of all lengths get the sums and labels they get alone."""
    import numpy as np

    r = np.random.default_rng(2)
    length = r.integers(1, 60, 80)
    emit = r.normal(size=(int(length.sum()), pii.L))
    layout = pii.Layout(length)
    node, alpha, beta, *_ = pii.propagate(emit, layout, np.empty((0, 2), np.int64), model)
    best = pii.viterbi(emit, layout, model)
    for a, n in zip(layout.start, length):
        one = pii.Layout(np.array([n]))
        _, x, y, *_ = pii.propagate(emit[a : a + n], one, np.empty((0, 2), np.int64), model)
        assert np.allclose(alpha[a : a + n], x) and np.allclose(beta[a : a + n], y)
        assert best[a : a + n].tolist() == pii.viterbi(emit[a : a + n], one, model).tolist()


@pytest.mark.parametrize("before", range(140, 240, 3))
def test_names_at_the_edges_of_stretches_are_found_whole(model, before):
    tagger = pii.Tagger(model)
    for name in ("Anna van der Lindqvist", "Clara de la Marenko", "Bruno Tavares"):
        text = "buffer " * before + f'Reported by {name} (anna@example.org), ' + "queue " * 200
        spans = [text[a:b] for a, b, k in tagger.tag([text])[0] if k == "person"]
        assert spans == [name]


def test_overlapping_spans_give_way_to_the_longest():
    spans = [(0, 5, "person"), (0, 12, "person"), (11, 13, "phone"), (13, 20, "email"), (30, 31, "email"), (0, 12, "person")]
    assert pii.apart(spans) == [(0, 12, "person"), (13, 20, "email"), (30, 31, "email")]


def test_skip_edges_join_equal_and_similar_tokens():
    import numpy as np

    doc = [pii.tokenise(t) for t in ("Anna Vossler met the clerk", "mail of vossler and Vosslers, the clerk", "Tel. +1 555 555 0142 or 555-555-0142")]
    start = np.cumsum([len(t) for t in doc]) - [len(t) for t in doc]
    flat = [t for line in doc for t in line]
    pairs = {tuple(sorted((flat[a][3], flat[b][3]))) for a, b in pii.skip_edges([doc], start, {"anna"}).tolist()}
    assert pairs == {("Vossler", "vossler"), ("Vosslers", "vossler"), ("+1 555 555 0142", "555-555-0142")}


def test_the_gate_lets_no_address_by():
    """What the address pattern finds is in a line that is labelled, and is a token there."""
    import re as re_

    whole = re_.compile(pii.TOKENS["address"])
    for doc in pii.training_lines(NAMES["given"], NAMES["family"], 1500, seed=3):
        for line, spans in doc:
            for m in whole.finditer(line):
                assert pii._may_be_street(line, pii._words_of(line)), line
    assert pii._may_be_street(r"x\nAvda. de Kiln, 172", pii._words_of(r"x\nAvda. de Kiln, 172"))


def test_lines_that_repeat_a_found_name_are_labelled_too(model):
    text = "Contact: zorvald.kemmling@example.org (ask for Zorvald Kemmling)\nno entity here at all\nsee mail from zorvald kemmling, about it"
    assert [text[a:b] for a, b, k in pii.Tagger(model).tag([text])[0] if k == "person"][:1] == ["Zorvald Kemmling"]
    assert not pii.Tagger(model).wanted(text.split("\n")[1])


def test_redaction(spark, monkeypatch, model):
    monkeypatch.setattr(pii, "fit", lambda *a: model)
    text = "Questions go to Anna Vossler, phone +1 555 555 0142.\nPinned tool@1.2.3 for now.\nMail to anna.vossler@example.org bounced twice.\nchecksum 00 413 225 064 belongs to role"
    df = spark.createDataFrame([(1, text), (1, text), (2, ""), (3, None), (None, "x"), (4, "buffer " * 40_000)], "doc_id long, text string").withColumn("entities", F.lit(1))
    names = spark.createDataFrame([(n, k) for k, v in NAMES.items() for n in v] + [(None, "given"), ("X", None), (" Anna ", "given")], "name string, kind string")
    got = {r.doc_id: r for r in pii.redact(df, names).collect()}
    assert set(got) == {1, 2, 4} and got[2].redacted == "" and got[4].redacted == "buffer " * 40_000
    assert got[1].redacted.split("\n")[0] == "Questions go to <PERSON>, phone <PHONE>."
    assert got[1].redacted.split("\n")[1:3] == ["Pinned tool@1.2.3 for now.", "Mail to <EMAIL> bounced twice."]
    assert {(e.kind, e.found) for e in got[1].entities} == {("person", "Anna Vossler"), ("phone", "+1 555 555 0142"), ("email", "anna.vossler@example.org")}
    assert pii.redact(df.limit(0), names).count() == 0
