"""Near-duplicate and repeated-passage operators against brute force on small inputs."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import embedding_dedup, minhash_join, substring_dedup
from strandlake.llm.components import components

WORDS = [a + b for a in "bcdfghklmnprst" for b in "aeiou"]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def union(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40, 60)] + [(rng.randrange(30), rng.randrange(30)) for _ in range(18)] + [(7, 7), (5, None)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    assert got == union({x for p in real for x in p}, real)
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.parametrize("width,block", [(2, 1024), (5, 4)])
def test_minhash(spark, monkeypatch, width, block):
    monkeypatch.setattr(minhash_join, "BLOCK", block)
    rng = random.Random(width)
    texts = ["", None, "one", "One", "one two", " \n", "a b c d e"]
    for _ in range(8):
        base = sentence(rng, 60).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy).upper() if rng.random() < 0.3 else "\n".join(copy))
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, component string")
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = union(range(len(sets)), links)
    got = {r["doc_id"]: r for r in minhash_join.near_duplicates(docs, width=width).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want and {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in enumerate(sets)}
    assert all(r["kept"] == (want[i] == i) for i, r in got.items())


def test_minhash_empty(spark):
    assert minhash_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [1024, 8])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 16))
    rows = [(base[i % 12] + rng.standard_normal(16) * 0.08).tolist() for i in range(90)] + [base[0].tolist(), base[0].tolist()]
    v = np.array(rows) / np.linalg.norm(rows, axis=1, keepdims=True)
    odd = [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, []]
    table = [(i, x, 0) for i, x in enumerate(rows + odd)]
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if v[a] @ v[b] >= 0.95]
    want = union(range(len(table)), links)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>, many int")).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in p for p in links) for i in range(len(table))}


def test_embedding_edges(spark):
    """Repeated rows and no rows; integer and float components; clashing columns."""
    rows = [(1, [1.0, 2.0], 0, 0), (1, [1.0, 2.0], 0, 0), (2, [2.0, 4.0001], 0, 0), (3, [-1.0, 0.5], 0, 0), (4, [0.0, 0.0], 0, 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long, links long")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(v).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]
    assert embedding_dedup.near_duplicates(v.limit(0)).count() == 0


def test_sketch_bounds_hold():
    """Sure pairs are links, no link is dropped by the strict bound, and pieces don't depend on the batch."""
    rng = np.random.default_rng(6)
    raw = np.repeat(rng.standard_normal((40, 64)), 6, axis=0) + rng.standard_normal((240, 64)) * rng.uniform(0.05, 0.4, (240, 1))
    unit = embedding_dedup.unit_vectors(raw)
    s = embedding_dedup.Sketches.unpacked(embedding_dedup.Sketches.of(unit).packed())
    every = np.arange(240)
    x, y, sure = embedding_dedup.block_links(s, 0, 10, every, every, True, 0.95)
    true = {(a, b) for a, b in itertools.combinations(range(240), 2) if unit[a] @ unit[b] >= 0.95}
    got = set(zip(x.tolist(), y.tolist(), strict=True))
    assert true <= got and set(zip(x[sure].tolist(), y[sure].tolist(), strict=True)) <= true and 0 < sure.sum() and len(got) < 3 * len(true)
    one = embedding_dedup.Sketches(s.q[7:8], s.scale[7:8], s.rest[7:8], s.factor[7:8])
    assert (one.pieces(13, 9) == s.pieces(13, 9)[7:8]).all()
    exact = unit @ unit.T
    estimate = (s.q * s.scale[:, None]) @ (np.where(s.q >= 0, 1, -1) / 8).T / s.factor
    slack = embedding_dedup.SIGMAS * np.sqrt((1 - s.factor**2) / (s.factor**2 * 63)) + s.rest[:, None] / s.factor
    assert (np.abs(estimate - exact) <= slack).mean() > 0.9999


def test_unbiased_estimate():
    rng = np.random.default_rng(0)
    a = rng.standard_normal(64)
    b = a + 0.5 * rng.standard_normal(64)
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    got = []
    for k in range(400):
        r = embedding_dedup.rotation(64, k)
        x, q = r @ a, r @ b
        code = np.where(x > 0, 1, -1) / 8
        got.append(code @ q / (code @ x))
    assert abs(np.mean(got) - a @ b) < 0.01


def test_passages(spark):
    rng = random.Random(9)
    passage = sentence(rng, 51)
    texts = [sentence(rng, 200) for _ in range(12)]
    hit = {2: 30, 5: 77, 9: 120}
    for i, at in hit.items():
        w = texts[i].split()
        texts[i] = " ".join(w[:at]) + "\n" + passage + "  " + " ".join(w[at:])
    rows = [(i, t, f"k{i}") for i, t in enumerate(texts)] + [(100, None, "n"), (101, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = {r["doc_id"]: r["spans"] for r in substring_dedup.repeated_spans(docs).collect()}
    assert set(found) == {5, 9} and all(s[0]["first_id"] == 2 for s in found.values())
    out = {r["doc_id"]: r for r in substring_dedup.deduplicate(docs).collect()}
    assert len(out) == len(rows) and out[100]["text"] is None and out[101]["text"] == "" and out[5]["spans"] == "k5"
    for i, (_, t, _) in enumerate(rows[:12]):
        assert (out[i]["text"] == t) == (i not in (5, 9))
        assert (passage in out[i]["text"]) == (i == 2)
    assert " ".join(out[5]["text"].split()[:70]) == " ".join(texts[5].split()[:70])


def test_gear_forgets():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    moved = np.concatenate([rng.integers(0, 1 << 63, 37, dtype=np.uint64), h])
    a = set(substring_dedup.chunk_starts(h, np.array([0, 300])).tolist())
    b = {x - 37 for x in substring_dedup.chunk_starts(moved, np.array([0, 337])).tolist()}
    assert {x for x in a if x > 12} == {x for x in b if x > 12}
    assert len(substring_dedup.chunk_starts(np.full(200, 7, np.uint64), np.array([0, 200]))) == 4


def test_cuts_do_not_depend_on_neighbouring_texts():
    rng = np.random.default_rng(5)
    lengths = [0, 1, 3, 17, 24, 35, 0, 60, 9]
    each = [rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in lengths]
    for order in ([0, 1, 2, 3, 4, 5, 6, 7, 8], [8, 3, 1, 7, 0, 5, 6, 4, 2]):
        offs = np.concatenate([[0], np.cumsum([lengths[i] for i in order])])
        got = substring_dedup.chunk_starts(np.concatenate([each[i] for i in order]), offs)
        for i, a, b in zip(order, offs[:-1], offs[1:], strict=True):
            alone = substring_dedup.chunk_starts(each[i], np.array([0, lengths[i]]))
            assert (got[(got >= a) & (got < b)] - a).tolist() == alone.tolist()


def test_exact_copies_become_empty(spark):
    rng = random.Random(12)
    texts = [sentence(rng, n) for n in range(16, 40)]
    rows = list(enumerate(texts)) + [(100 + i, texts[i]) for i in rng.sample(range(len(texts)), len(texts))]
    out = {r["doc_id"]: r["text"] for r in substring_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert all(out[i] == t and out[100 + i] == "" for i, t in enumerate(texts))


def test_minhash_edges(spark):
    """Null ids, repeated rows, clashing columns, a long text and its near copy."""
    rng = random.Random(9)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(60_000))
    rows = [(1, long), (2, long + " " + sentence(rng, 100)), (3, "a b c"), (3, "a b c"), (None, "a b c"), (None, None), (7, long[: len(long) // 2])]
    docs = spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, id long, n_shingles long")
    got = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in minhash_join.near_duplicates(docs, width=2).collect())
    assert got == [("1", 1, True), ("2", 1, False), ("3", 3, True), ("3", 3, True), ("7", 7, True), ("None", None, True), ("None", None, True)]


def test_components_of_a_hub(spark, monkeypatch):
    """A hub above the share is joined by broadcast; the result is the same."""
    from strandlake.llm import spark_io

    monkeypatch.setattr(spark_io, "LEAST_HOT", 3)
    links = [(500, i) for i in range(400, 460)] + [(i, i + 1) for i in range(600, 640)] + [(460, 459), (640, 500)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert set(got.values()) == {400} and len(got) == 103


def test_passages_against_brute_force(spark):
    """With the same cuts, plain words and dictionaries find the same spans and leave the same texts."""
    rng = random.Random(21)
    stock = [sentence(rng, rng.randrange(20, 70)) for _ in range(6)]
    texts = []
    for _ in range(30):
        parts = [rng.choice(stock) if rng.random() < 0.5 else sentence(rng, rng.randrange(1, 60)) for _ in range(rng.randrange(5))]
        texts.append((" " if rng.random() < 0.5 else "\n").join(parts))
    rows = [*enumerate(texts), (40, None), (41, ""), (42, sentence(rng, 40_000)), (7, texts[7]), (None, stock[0])]
    words = {i: [w.lower() for w in (t or "").split()] for i, t in rows}
    cuts = {}
    for i, t in rows:
        if words[i]:
            one = next(substring_dedup.texts(pa.array([t]), 1 << 30))
            w = substring_dedup.words(one)
            start = substring_dedup.chunk_starts(substring_dedup.word_hashes(one, w), w.offs).tolist()
            cuts[i] = list(zip(start, [*start[1:], len(words[i])], strict=True))
    order = lambda i: -1 if i is None else i
    first = {}
    for i in sorted(cuts, key=order):
        for a, b in cuts[i]:
            first.setdefault(tuple(words[i][a:b]), (i, a))
    want = {}
    for i in cuts:
        spans = []
        for a, b in cuts[i]:
            if first[tuple(words[i][a:b])] != (i, a):
                if spans and spans[-1][1] == a:
                    spans[-1][1] = b
                else:
                    spans.append([a, b])
        gone = {k for a, b in spans if b - a >= substring_dedup.MIN_WORDS for k in range(a, b)}
        want[i] = [w for k, w in enumerate(words[i]) if k not in gone]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, __id int, n int")
    got = substring_dedup.deduplicate(docs)
    assert got.columns == docs.columns
    out = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert len(out) == len(rows) and sum(len(w) for w in want.values()) < sum(len(w) for w in words.values())
    for i, t in out:
        assert (t or "").lower().split() == want.get(i, []) and (t is None) == (i == 40)
    assert substring_dedup.deduplicate(docs.limit(0)).count() == 0


def test_passages_of_repeated_and_missing_ids(spark):
    """Rows of one id with different texts, and several texts without id, lose nothing of their own."""
    rng = random.Random(31)
    own = [sentence(rng, 200) for _ in range(8)]
    twice = f"{own[0]} {own[1]} {own[0]}"  # repeats itself
    rows = [(None, twice), (None, own[2]), (5, f"{own[3]} {own[4]}"), (5, own[5]), (5, own[5]), (6, f"{own[4]} {own[6]}"), (6, own[7]), (5, None), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, row int")
    out = substring_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    texts = [r["text"] for r in out.collect()]
    for k in (2, 3, 5, 7):
        assert own[k] in " ".join(x or "" for x in texts)
    assert texts.count(own[2]) == 1 and texts.count(own[5]) == 2 and texts.count(own[7]) == 1 and texts.count(None) == 2 and texts.count("") == 1
    every = " ".join(x or "" for x in texts)
    for k in (0, 1, 4, 6):  # the words of each stay once at least
        assert all(w in every.split() for w in own[k].split())
    spans = {r["doc_id"]: r["spans"] for r in substring_dedup.repeated_spans(docs).collect()}
    assert set(spans) == {None, 6} and sum(s["n_words"] for s in spans[None]) > 170 and sum(s["n_words"] for s in spans[6]) > 170
    assert sum(len((x or "").split()) for x in texts) == sum(len((t or "").split()) for _, t in rows) - sum(s["n_words"] for x in spans.values() for s in x)


@pytest.mark.parametrize("threshold", [60, 80, 90])
def test_minhash_thresholds(spark, threshold):
    """All links are found at other thresholds too, of sets of any size down to the least that can be linked."""
    rng = random.Random(threshold)
    sets, texts = [], []
    for size in (1, 2, 3, 4, 5, 9, 10, 12, 40, 60):
        for _ in range(3):
            base = rng.sample(range(10**6), size)
            for lost in range(0, size // 2 + 1, max(1, size // 12)):
                texts.append(" ".join(f"w{x}" for x in [*base[lost:], *rng.sample(range(10**6, 2 * 10**6), lost if lost % 2 else 0)]))
            texts.append(" ".join(f"w{x}" for x in [*base, 7]))
    for t in texts:
        w = t.split()
        sets.append(set(w))
    links = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash_join.near_duplicates(docs, width=1, threshold=threshold).collect()}
    assert got == union(range(len(sets)), links) and len(links) > 10
