"""Near duplicates, leakage and provenance against plain versions."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.llm import leakage, nearduplicates as nd, provenance

WORD = re.compile(r"\w+")


def shingles(text, width):
    w = WORD.findall(text.lower())
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def corpus(seed=1, n=160):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.6:
            w = r.choice(texts).split()
            for _ in range(r.randrange(0, 6)):
                k = r.randrange(len(w))
                x = r.random()
                if x < 0.4:
                    w[k] = r.choice(vocab)
                elif x < 0.7:
                    w.insert(k, r.choice(vocab))
                elif len(w) > 25:
                    del w[k]
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(r.choice(vocab) for _ in range(r.randrange(15, 80))))
    return texts


def brute(texts, width, num, den, least):
    sets = [shingles(t, width) if len(WORD.findall(t.lower())) >= max(least, width) else None for t in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sets[i] and sets[j] and len(sets[i] & sets[j]) * den >= num * len(sets[i] | sets[j])}


@pytest.mark.parametrize("width,threshold,num,den", [(3, 0.6, 3, 5), (5, 0.8, 4, 5)])
def test_pairs_equal_brute_force(spark, width, threshold, num, den):
    texts = corpus()
    rows = [(f"{i:03d}", f"p{i % 3}", t, 1.0) for i, t in enumerate(texts)] + [("000", "p0", texts[0], 1.0), ("n", "p1", None, 1.0), ("e", "p1", "", None), (None, "p9", texts[0], 1.0)]
    df = spark.createDataFrame(rows, "id string, path string, text string, cls double").repartition(4)  # cls clashes with a name inside
    got = {(int(r.id_a), int(r.id_b)) for r in nd.near_duplicate_pairs(df, "id", "text", "path", width=width, threshold=threshold, min_words=20).collect()}
    assert got == {(i, j) for i, j in brute(texts, width, num, den, 20) if i % 3 != j % 3}
    assert len(got) > 20


def test_groups_are_components(spark):
    texts = corpus(2, 120)
    df = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)] + [("x", None), ("y", "")], "id string, text string")
    got = {r.id: (r.group_id, r.class_size) for r in nd.near_duplicate_groups(df, "id", "text", width=3, threshold=0.6).collect()}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in brute(texts, 3, 3, 5, 3):
        a, b = sorted((find(i), find(j)))
        root[b] = a
    assert {k: v[0] for k, v in got.items()} == {**{f"{i:03d}": f"{find(i):03d}" for i in range(len(texts))}, "x": "x", "y": "y"}


def test_pairs_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id string, path string, text string")
    assert nd.near_duplicate_pairs(df, "id", "text", "path").count() == 0


def test_a_text_of_many_copies(spark):
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.range(300).select(F.format_string("%03d", "id").alias("id"), F.lit(text).alias("text"))
    got = nd.near_duplicate_groups(df, "id", "text").collect()
    assert {r.group_id for r in got} == {"000"} and {r.class_size for r in got} == {300} and {r.n_links for r in got} == {0}


def test_long_lists_and_large_classes_in_cells(spark, monkeypatch):
    """A shingle in every text, lists far above a cell, and classes of many copies: the same pairs."""
    monkeypatch.setattr(nd, "CELL", 8)
    monkeypatch.setattr(nd, "MEMBERS", 4)
    r = random.Random(21)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(3, 7))) for _ in range(260)]  # few words: every shingle is common
    df = spark.createDataFrame([(f"{i:03d}", f"p{i % 5}", t) for i, t in enumerate(texts)], "id string, path string, text string").repartition(4)
    got = {(int(x.id_a), int(x.id_b)) for x in nd.near_duplicate_pairs(df, "id", "text", "path", width=2, threshold=0.6).collect()}
    assert got == {(i, j) for i, j in brute(texts, 2, 3, 5, 2) if i % 5 != j % 5} and len(got) > 500


def test_representatives_and_members_hold_all_links(spark):
    texts = corpus(4, 120)
    texts += texts[:20]
    df = spark.createDataFrame([(f"{i:03d}", t) for i, t in enumerate(texts)], "id string, text string")
    pairs, members = nd.near_duplicate_links(df, "id", "text", width=3, threshold=0.6)
    rep = {x.id: x.rep for x in members.collect()}
    told = {(x.rep_a, x.rep_b) for x in pairs.collect()}
    for i, j in brute(texts, 3, 3, 5, 3):
        a, b = sorted((rep[f"{i:03d}"], rep[f"{j:03d}"]))
        assert a == b or (a, b) in told


def test_groups_across_paths_only(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [("a", "p", text), ("b", "p", text), ("c", "q", text + " more"), ("d", "r", "x " + text[3:]), ("e", "s", " ".join(f"v{i}" for i in range(40))), ("f", "s", " ".join(f"v{i}" for i in range(40)))]
    df = spark.createDataFrame(rows, "id string, path string, text string")
    got = {x.id: (x.group_id, x.class_size, x.n_links) for x in nd.near_duplicate_groups(df, "id", "text", "path", width=3, threshold=0.6).collect()}
    assert got == {"a": ("a", 2, 2), "b": ("a", 2, 2), "c": ("a", 1, 2), "d": ("a", 1, 2), "e": ("e", 2, 0), "f": ("f", 2, 0)}


def test_counts_reach_beyond_two_bytes():
    from siftspark.llm import common as C

    counts = np.array([0, 1, 32, 33, 70_000, 5_000_000, C.MOST], np.uint32)
    assert (C._unpack(C._pack(counts)) == counts).all()
    back = C.CODES[C.compact(counts)]
    assert (back <= counts).all() and (back * 1.1 >= counts).all() and len(C.CODES) <= 256


@pytest.mark.parametrize("block", [1, 3, 64])
def test_block_skipping_loses_no_pair(block):
    r = np.random.default_rng(5)
    key = np.sort(r.integers(0, 12, 400))
    n, pos = r.integers(3, 40, 400), r.integers(0, 10, 400)
    order = np.lexsort((pos, n, key))
    key, n, pos = key[order], n[order], np.minimum(pos, n - 1)[order]
    order = np.lexsort((pos, n, key))
    key, n, pos = key[order], n[order], pos[order]
    i, j = nd.pairs_in_lists(key, n, pos, 3, 5, block)
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if key[a] == key[b] and n[b] * 3 <= n[a] * 5 and min(n[a] - pos[a], n[b] - pos[b]) >= -(-3 * (n[a] + n[b]) // 8)}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)


def test_answers_are_derived_from_a_similar_set():
    r = np.random.default_rng(6)
    partners = [np.unique(r.integers(0, 500, 120).astype(np.uint64)) for _ in range(30)]
    leader = partners[0]
    check = nd.SkippingVerifier()
    for m in range(6):
        s = np.unique(np.r_[leader[m : len(leader) - m], np.arange(600, 600 + m)].astype(np.uint64))
        for k, p in enumerate(partners):
            assert check.overlap(7, (m, 0), s, (k, 0), p) == len(np.intersect1d(s, p))
    assert check.derived == 5 * 30


def test_leaks_equal_brute_force(spark):
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(5, 60)))) for i in range(25)]
    docs = []
    for d in range(120):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 90))]
        if r.random() < 0.5:
            s = r.choice(items)[1].split()
            a = r.randrange(max(1, len(s) - 8))
            w[len(w) // 2 : len(w) // 2] = s[a : a + r.randrange(8, 30)]
        docs.append((d, ", ".join(w).upper()))
    long = " ".join(r.choice(vocab) for _ in range(130_000)) + " " + items[0][1] + " " + " ".join(r.choice(vocab) for _ in range(9000))
    docs += [(900, long), (901, None), (902, ""), (0, docs[0][1])]
    ddf = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit("clash"))
    idf = spark.createDataFrame([*items, (77, None), (78, "")], "item_id long, text string")
    got = {(x.doc_id, x.item_id): x.run_words for x in leakage.leaked_items(ddf, idf).collect()}
    want = {}
    grams = {}
    for i, t in items:
        w = t.split()
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - 11):
            for i in grams.get(tuple(w[k : k + 12]), ()):
                want.setdefault((d, i), 0)
    assert {k for k, v in got.items() if v >= 12} == set(want) and len(want) > 15
    assert leakage.leaked_items(ddf.limit(0), idf).count() == 0 and leakage.leaked_items(ddf, idf.limit(0)).count() == 0
    if len(items[0][1].split()) >= 12:
        assert got[900, 0] == len(items[0][1].split())


@pytest.mark.parametrize("radius", [3, 9, 15])
def test_hamming_blocks_find_all_within_the_radius(radius):
    r = np.random.default_rng(8)
    windows = leakage.Windows(12, radius)
    for k, fp in enumerate(r.integers(0, 2**63, 300).astype(np.uint64)):
        windows.add(k, 0, fp, np.array([k] * 8, np.uint64), np.ones(8, np.int32))
    windows.close()
    flips = [np.bitwise_or.reduce(np.uint64(1) << r.permutation(64)[:n].astype(np.uint64)) for n in r.integers(0, 20, 900)]
    probe = np.concatenate([np.tile(windows.fp, 3) ^ np.array(flips, np.uint64), r.integers(0, 2**63, 500).astype(np.uint64)])
    i, j = windows.near(probe)
    want = {(a, b) for a in range(len(probe)) for b in np.flatnonzero(np.bitwise_count(windows.fp ^ probe[a]) <= radius)}
    assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want) > 100


def test_edited_passages_are_found(spark):
    r = random.Random(13)
    vocab = [f"{a}{b}" for a in "river stone cloud paper light garden window market".split() for b in range(60)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.randrange(40, 112)))) for i in range(60)]
    docs, planted = [], {}
    for d in range(900):
        i, t = r.choice(items)
        w, edits = t.split(), r.randrange(1, 4)
        for _ in range(edits):
            k, x = r.randrange(len(w)), r.random()
            if x < 0.6:
                w[k] = r.choice(vocab)
            elif x < 0.8:
                w.insert(k, r.choice(vocab))
            else:
                del w[k]
        noise = lambda: [r.choice(vocab) for _ in range(r.randrange(0, 120))]
        docs.append((d, " ".join([*noise(), *w, *noise()])))
        planted[d, i] = (edits, len(t.split()))
    docs.append((5000, items[0][1]))
    got = {(x.doc_id, x.item_id): x for x in leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for edits in (1, 2, 3):
        these = [k for k, v in planted.items() if v[0] == edits]
        assert sum(k in got for k in these) >= 0.95 * len(these)
    # as a whole: one edit in sixty words or more leaves a similarity of at least 0.8
    clear = [k for k, v in planted.items() if v[0] == 1 and v[1] >= 60]
    assert sum(got[k].item_similarity is not None for k in clear if k in got) >= 0.9 * len(clear) > 100
    assert got[5000, 0].item_similarity == 1.0 and got[5000, 0].run_words == len(items[0][1].split())
    assert len(got) < 1.1 * len(planted)


def test_short_and_equal_items(spark):
    same = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = [(i, same) for i in range(300)] + [(900, "just seven words stand in this item"), (901, "four words are few"), (None, same)]
    docs = [(1, "x y " + same + " z"), (2, "here just seven words stand in this item too"), (3, "four words are few"), (4, "")]
    got = leakage.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(1, i) for i in range(300)} | {(2, 900)}
    assert {x.run_words for x in got if x.doc_id == 1} == {14} and {x.item_similarity for x in got} == {1.0}


def test_provenance(spark):
    r = random.Random(4)
    word = lambda: r.choice("alpha beta gamma delta omega sigma kappa theta".split())
    forms = ["if {a} > {n}:", "    {a} = {b}({n})", "    return {a}.{b}", "for {a} in {b}:", "    {a}[{n}] += {b}", "def {a}_{b}({a}, {b}=None):", "    log('{a} {b}', {a})", "    raise {a}({b})", "    with {a}({b}) as {a}:", "    {a} = [{b} for {b} in {a} if {b}]", "# {a} keeps the {b} of {n} rows"]
    hand = lambda k=60: "\n".join(r.choice(forms).format(a=word(), b=word(), n=r.randrange(99)) for _ in range(k))
    lib = hand()
    files = {
        "one/src/a.py": hand(), "two/src/b.py": hand(), "one/src/codegen/c.py": '# Emits the header "auto-generated" into what it writes.\n' + hand(),
        "one/pkg/x.pb.go": hand(), "one/pkg/head.py": "# Code generated by tool-gen 1.2. DO NOT EDIT.\n" + hand(), "one/pkg/rep.py": "\n".join(f"FIELD_{i} = table.field(name='{word()}', index={i})" for i in range(40)),
        "one/www/app.js": "".join(f"function {word()}(a){{return a.{word()}()}}" for _ in range(60)), "one/core/blob.py": "DATA = [\n" + "\n".join(f"    ({r.random():.5f}, {-r.random():.4f}, {r.randrange(9999)}, '{word()}')," for _ in range(40)) + "\n]",
        "one/third_party/lib.py": lib, "two/lib/lib.py": "\n".join(lib.split("\n")[10:]), "one/docs/generated/x.md": "# Code generated by x. DO NOT EDIT.", "one/src/empty.py": None,
    }
    fdf = spark.createDataFrame([(p, 0 if t is None else len(t), None) for p, t in files.items()] + [("one/src/a.py", None, None), (None, 1, "python")], "rel_path string, size long, language string")
    cdf = spark.createDataFrame([(p, 1, t) for p, t in files.items()] + [("one/src/a.py", None, None), (None, 1, "x")], "rel_path string, start_line int, text string").withColumn("language", F.lit(None).cast("string"))
    got = {x.rel_path: x.kind for x in provenance.not_hand_written(fdf, cdf).collect()}
    assert got == {"one/pkg/x.pb.go": "generated", "one/pkg/head.py": "generated", "one/pkg/rep.py": "generated", "one/www/app.js": "minified", "one/core/blob.py": "data", "one/third_party/lib.py": "vendored", "two/lib/lib.py": "vendored"}
    assert provenance.not_hand_written(fdf.limit(0), cdf.limit(0)).count() == 0


def _whole_families(sets):
    """Connected components of all pairs of similar sets."""
    names, root = sorted(sets), {}
    find = lambda x: x if root.get(x, x) == x else find(root[x])
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if len(sets[a] & sets[b]) >= provenance.SIMILAR * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in names}


@pytest.mark.parametrize("cell", [1024, 3])
def test_families_are_whole_components(spark, monkeypatch, cell):
    monkeypatch.setattr(provenance, "CELL", cell)
    rng = np.random.default_rng(3)
    sets = {}
    for f in range(6):  # chains: each file is like the next, the ends are not alike
        words = rng.integers(0, 2**32, 400, dtype=np.uint32)
        order = rng.permutation(12)
        for k in range(12):
            sets[f"r{k % 2}/{order[k]:02d}_{f}.py"] = {int(x) for x in words[k * 12 : k * 12 + 200]}
    sets["r0/same.py"] = sets["r0/" + next(x for x in sorted(sets) if x.startswith("r0"))[3:]]
    df = spark.createDataFrame([(p, np.array(sorted(s), np.uint32).tobytes()) for p, s in sets.items()], "rel_path string, masked binary").repartition(3)
    assert {x.rel_path: x.family for x in provenance._families(df).collect()} == _whole_families(sets)


@pytest.mark.parametrize("first", [4, 1])
def test_verified_pairs_follow_the_files(spark, monkeypatch, first):
    """Of a large family only a few pairs of each file are verified; near misses are all held against it."""
    monkeypatch.setattr(provenance, "NEAREST", first)
    monkeypatch.setattr(provenance, "WIDER", 4)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**32, 300, dtype=np.uint32)
    draw = lambda k: {int(x) for x in np.r_[base[rng.permutation(300)[: 300 - k]], rng.integers(0, 2**32, k, dtype=np.uint32)]}
    sets = {f"r{i % 3}/{i:03d}.py": draw(k) for k, many in ((10, 120), (33, 40)) for i in range(k * 1000, k * 1000 + many)}
    seen, compare = [], provenance._compare
    monkeypatch.setattr(provenance, "_compare", lambda pairs, *rest: seen.append(pairs.count()) or compare(pairs, *rest))
    df = spark.createDataFrame([(p, np.array(sorted(s), np.uint32).tobytes()) for p, s in sets.items()], "rel_path string, masked binary").repartition(3)
    assert {x.rel_path: x.family for x in provenance._families(df).collect()} == _whole_families(sets)
    assert sum(seen) <= 12 * len(sets)


def test_family_sizes_do_not_hang_on_the_head(spark):
    line = lambda k: f"x{k} = " + " ".join("+-*/%&|^<>"[int(c)] + " y" for c in f"{k * 7919 % 100000:05d}")
    text = lambda a, b: "\n".join(line(k) for k in range(a, b))
    files = {"one/a.py": text(0, 40), "one/b.py": text(4, 44), "one/c.py": text(8, 48), "one/d.pb.py": text(12, 52)}
    fdf = spark.createDataFrame([(p, len(t), None) for p, t in files.items()], "rel_path string, size long, language string")
    cdf = spark.createDataFrame([(p, 1, t) for p, t in files.items()], "rel_path string, start_line int, text string").withColumn("language", F.lit(None).cast("string"))
    assert [x.family_size for x in provenance.not_hand_written(fdf, cdf).collect()] == [4]


def test_copies_of_any_seed_and_small_parts(spark):
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    big, other = draw(3000), draw(3000)
    seeds = {"a/vendor/v1.js": np.r_[big[:1500], draw(1500)], "b/vendor/v2.js": big, "c/vendor/o.js": other}
    rest = {
        "d/part.js": big[2000:2050], "d/edited.js": np.r_[big[2500:2580], draw(20)], "d/own.js": draw(300),
        "d/half.js": np.r_[big[:40], draw(60)], "d/two.js": np.r_[big[1600:1650], other[:50]], "d/below.js": np.r_[big[2500:2579], draw(21)],
    }
    frame = lambda d: spark.createDataFrame([(p, np.unique(s).tobytes()) for p, s in d.items()], "rel_path string, plain binary")
    assert {x.rel_path for x in provenance._copies(frame({**rest, **seeds}), frame(seeds)).collect()} == {"d/part.js", "d/edited.js"}
    assert provenance._copies(frame(rest), frame(seeds).limit(0)).count() == 0


def test_a_small_copy_of_a_large_library_is_vendored(spark):
    r = random.Random(8)
    forms = ["if {a} > {n}:", "    {a} = {b}({n})", "    return {a}.{b}", "for {a} in {b}:", "    {a}[{n}] += {b}", "    raise {a}({b})", "    with {a}({b}) as {a}:", "    {a} = [{b} for {b} in {a} if {b}]"]
    lib = [r.choice(forms).format(a=f"p{r.randrange(999)}", b=f"q{r.randrange(999)}", n=r.randrange(99)) for _ in range(900)]
    files = {"one/third_party/lib.py": "\n".join(lib), "two/src/part.py": "\n".join(lib[500:530])}
    fdf = spark.createDataFrame([(p, len(t), None) for p, t in files.items()], "rel_path string, size long, language string")
    cdf = spark.createDataFrame([(p, 1, t, None) for p, t in files.items()], "rel_path string, start_line int, text string, language string")
    assert {x.rel_path: x.kind for x in provenance.not_hand_written(fdf, cdf).collect()} == dict.fromkeys(files, "vendored")


def test_a_cluster_across_repositories_tells_renamed_copies(spark, monkeypatch):
    """A library whose names were all changed is vendored elsewhere; copies of a file that is no third party's are not."""
    monkeypatch.setattr(provenance, "NEAREST", 1)
    r = random.Random(21)
    shape = lambda: ["{a} = " + " ".join("{" + r.choice("ab") + "} " + r.choice("+-*/%&|^<>@~") for _ in range(r.randrange(4, 9))) + " {n}" for _ in range(60)]
    named = lambda lines, tag: "\n".join(x.format(a=f"{tag}{r.randrange(999)}", b=f"{tag}_{r.randrange(999)}", n=r.randrange(99)) for x in lines)
    lib, own = shape(), shape()
    files = {f"one/third_party/lib{i}.py": named(lib, f"p{i}") for i in range(3)} | {"two/src/core.py": named(lib, "q"), "one/src/near.py": named(lib, "s"), "two/src/own.py": named(own, "t"), "three/src/own.py": named(own, "u"), "four/x/other.py": named(shape(), "v")}
    fdf = spark.createDataFrame([(p, len(t), None) for p, t in files.items()], "rel_path string, size long, language string")
    cdf = spark.createDataFrame([(p, 1, t, None) for p, t in files.items()], "rel_path string, start_line int, text string, language string")
    got = {x.rel_path: (x.kind, x.evidence) for x in provenance.not_hand_written(fdf, cdf).collect()}
    assert got == {"two/src/core.py": ("vendored", "family")} | {f"one/third_party/lib{i}.py": ("vendored", "path") for i in range(3)}


def test_files_of_few_shingles(spark):
    few = lambda *v: np.array(v, np.uint32).tobytes()
    rows = [("a/1.py", few(1, 2, 3)), ("a/2.py", few(1, 2, 3)), ("a/3.py", few(1, 2)), ("a/4.py", b""), ("a/5.py", b"")]
    df = spark.createDataFrame(rows, "rel_path string, masked binary")
    got = {x.rel_path: x.family for x in provenance._families(df).collect()}
    assert got == {"a/1.py": "a/1.py", "a/2.py": "a/1.py", "a/3.py": "a/3.py"}
    plain = df.withColumnRenamed("masked", "plain")
    seeds = plain.where("rel_path in ('a/1.py', 'a/4.py')")
    assert sorted(x.rel_path for x in provenance._copies(plain, seeds).collect()) == ["a/1.py", "a/2.py"]


def test_clusters_alone_find_what_repeats(spark):
    """Without paths and headers: templates, data and minified files, under plain names, among hand-written ones."""
    r = random.Random(12)
    word = lambda: r.choice("alpha beta gamma delta omega sigma kappa theta".split())
    forms = ["if {a} > {n}:", "    {a} = {b}({n})", "    return {a}.{b}", "for {a} in {b}:", "    {a}[{n}] += {b}", "def {a}_{b}({a}, {b}=None):", "    log('{a} {b}', {a})", "    raise {a}({b})", "    with {a}({b}) as {a}:", "    {a} = [{b} for {b} in {a} if {b}]"]
    hand = lambda: "\n".join(r.choice(forms).format(a=word(), b=word(), n=r.randrange(99)) for _ in range(60))
    fields = lambda: "\n".join(f"FIELD_{i} = table.field(name='{word()}', {', '.join(f'{word()}={r.randrange(9)}' for _ in range(r.randrange(6, 9)))})" for i in range(40))
    rows = lambda: "DATA = [\n" + "\n".join(f"    ({r.random():.5f}, {-r.random():.4f}, {r.randrange(9999)}, '{word()}')," for _ in range(40)) + "\n]"
    line = lambda: "X = [" + ", ".join(str(r.randrange(999)) for _ in range(900)) + "]"
    dense = lambda: "".join(f"function {word()}(a){{return a.{word()}({r.randrange(9)})}}" for _ in range(60))
    want = {f"r{i % 4}/core/f{k}{i}.py": (kind, make()) for i in range(20) for k, (kind, make) in enumerate((("generated", fields), ("data", rows), ("data", line), ("minified", dense)))}
    files = {**{p: t for p, (_, t) in want.items()}, **{f"r{i % 4}/core/h{i}.py": hand() for i in range(60)}}
    fdf = spark.createDataFrame([(p, len(t), "python") for p, t in files.items()], "rel_path string, size long, language string")
    cdf = spark.createDataFrame([(p, 1 + 30 * k, "\n".join(t.split("\n")[30 * k : 30 * k + 31]), None) for p, t in files.items() for k in range(3)], "rel_path string, start_line int, text string, language string")
    got = {x.rel_path: (x.kind, x.evidence) for x in provenance.not_hand_written(fdf, cdf, signatures=False).collect()}
    assert not {p for p in got if p not in want}
    assert sum(got.get(p, (None,))[0] == kind for p, (kind, _) in want.items()) >= 0.95 * len(want)
    assert sum(e == "family" for _, e in got.values()) >= 0.7 * len(got)


def test_banding_recall():
    """Of pairs at the threshold itself, at least 19 of 20 meet in a bucket; of clearer ones, all but a few."""
    rng = np.random.default_rng(9)
    for similar, least in ((0.8, 0.95), (0.88, 0.995)):
        met = 0
        for _ in range(400):
            n = int(rng.integers(60, 400))
            both, own = int(2 * n * similar / (1 + similar)) + 1, 0
            own = n - both
            x = np.unique(rng.integers(0, 2**32, both + 2 * own, dtype=np.uint32))
            rng.shuffle(x)
            a, b = np.sort(x[: both + own]), np.sort(np.r_[x[:both], x[both + own :]])
            met += bool(set(provenance.band_keys(a, 1)) & set(provenance.band_keys(b, 1)))
        assert met >= least * 400


def test_a_statement_family_holds_near_equal_statements():
    base = b"a(a,a,a,a=0,a=\",a=0,a[a],{a:0})"
    near = [base + b",0;" * k for k in range(3)]
    far = [bytes([97, x, 97, x, 48, x]) for x in b"+-*/%&"]
    masks = [*near, *far]
    counts = np.array([5, 5, 5, 2, 2, 2, 2, 2, 2])
    assert sorted(provenance.statement_family(masks, counts).tolist()) == [0, 1, 2]
    assert provenance.statement_family([b"a"], np.array([3])).tolist() == [0]


def test_a_huge_file_is_taken_in_parts(spark, monkeypatch):
    monkeypatch.setattr(provenance, "PART_LINES", 100)
    rows = [("r/big.py", 50 * k, "\n".join(f"    {{ {i}, 'x{i}', {i * 7}, {i % 9} }}," for i in range(50 * k, 50 * k + 50)), None) for k in range(40)] + [("r/null.py", None, "x = 1", None)]
    cdf = spark.createDataFrame(rows, "rel_path string, start_line int, text string, language string")
    fdf = spark.createDataFrame([("r/big.py", None, None), ("r/null.py", 5, None)], "rel_path string, size long, language string")
    got = provenance.not_hand_written(fdf, cdf).collect()
    assert [(x.rel_path, x.kind, x.evidence) for x in got] == [("r/big.py", "data", "family")]
