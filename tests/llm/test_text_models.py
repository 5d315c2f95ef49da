"""Decontamination, language, quality, language model, rollups, main text."""

import collections
import itertools
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from strandlake.llm import decontam, html_template, langid_ppm, pitman_yor, quality_nbsvm, queries, token_rollup

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_token_rollup", "op4_decontaminate"])
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF).toPandas()
    want = c.execute(queries.oracle_sql()[name]).df()[list(got.columns)]
    assert sorted(map(tuple, got.astype(str).values)) == sorted(map(tuple, want.astype(str).values))


def test_substitutions(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(30)]
    swapped = list(item)
    for i in (4, 15, 22):
        swapped[i] = word()
    half = [*item[:8], *[word() for _ in range(30)]]
    docs = [(1, " ".join(["x1", *item, "y2"])), (2, "A, " + "; ".join(swapped).upper()), (3, " ".join(half)), (4, None), (5, ""), (6, " ".join(word() for _ in range(60)))]
    bench = spark.createDataFrame([(9, " ".join(item)), (10, None), (11, "too short")], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r for r in decontam.leaks(d, bench).collect()}
    assert set(got) == {1, 2} and got[1]["matched"] == 20 and got[1]["start_token"] == 1 and got[2]["matched"] >= 16
    assert sorted(r["doc_id"] for r in decontam.clean(d, bench).collect()) == [3, 4, 5, 6]
    assert decontam.leaks(d, bench.limit(0)).count() == 0


def test_language(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * (1 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    model = langid_ppm.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    more = spark.createDataFrame([(1, "the dog"), (2, "die katze"), (3, None), (4, ""), (5, "123 ..."), (5, "der hund " * 20_000)], "doc_id long, text string")
    got = [tuple(r) for r in langid_ppm.predict(more, model).select("doc_id", "lang_pred", "score").collect()]
    assert [g[1] for g in got] == ["en", "de", "und", "und", "und", "de"] and all(0 <= g[2] <= 1 for g in got) and got[2][2] == 0
    assert langid_ppm.predict(more, langid_ppm.fit(more.selectExpr("text", "null as lang"))).where("lang_pred != 'und'").count() == 0


def ppm(samples, order):
    """Code length of a text by plain recursion over dictionaries."""
    seen = collections.defaultdict(collections.Counter)
    for s in samples:
        line = b" " * order + s
        for i in range(order, len(line)):
            for k in range(order + 1):
                seen[line[i - k : i]][line[i]] += 1

    def p(context, byte):
        shorter = lambda b: p(context[1:], b) if context else 1 / 256
        here = seen.get(context)
        if not here:
            return shorter(byte)
        total, q = sum(here.values()), len(here)
        if q == 256:
            return here[byte] / total
        if byte in here:
            return here[byte] / (total + q)
        return q / (total + q) * shorter(byte) / (1 - sum(shorter(b) for b in here))

    return p, lambda s: sum(-math.log2(p((b" " * order + s)[i : i + order], s[i])) for i in range(len(s)))


@pytest.mark.parametrize("order", [0, 1, 3])
def test_code_lengths_against_plain_recursion(order):
    rng = random.Random(3)
    samples = {"a": [bytes(rng.choices(b"abc ", k=40)) for _ in range(4)], "b": ["žluťoučký kůň pěl".encode(), b"abab"]}
    plain = {k: ppm(v, order) for k, v in samples.items()}
    column = lambda xs: next(langid_ppm.texts(pa.array([x.decode() for x in xs]), 1 << 20))
    counts = []
    for v in samples.values():
        code, n = np.unique(langid_ppm.codes(column(v), order), return_counts=True)
        counts.append((code, n.astype(float)))
    model = langid_ppm.Model.of(list(samples), counts, order)
    for probe in [b"abcabc", "kůň ab".encode(), b"zzz", b"c", "漢".encode()]:
        got = model.lengths(langid_ppm.codes(column([probe]), order)).sum(axis=0)
        assert got == pytest.approx([plain[k][1](probe) for k in samples], rel=1e-5)
    for context in [b"abc"[:order], b" \xc5\xaf"[:order], b"qqq"[:order]]:
        code = np.array([int.from_bytes(context + bytes([s]), "big") for s in range(256)], np.uint64)
        assert (2.0 ** -model.lengths(code).astype(float)).sum(axis=0) == pytest.approx([1, 1], abs=1e-4)


def test_language_edges(spark):
    """Repeated rows, clashing columns, a long text in several pieces, an empty table, one language only."""
    rows = [(i % 7, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 9, "en" if i % 2 else "de", "x", 1.5) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    model = langid_ppm.fit(docs)
    got = langid_ppm.predict(docs, model).collect()
    assert len(got) == 40 and all(r["lang_pred"] in ("en", "de") for r in got) and langid_ppm.predict(docs.limit(0), model).count() == 0
    long = "the dog " * 400_000
    text = next(langid_ppm.texts(pa.array([long])))
    r = langid_ppm.predict(spark.createDataFrame([(1, long)], "doc_id long, text string"), model).first()
    assert r["lang_pred"] == "en" and r["code_bits"] == pytest.approx(model.lengths(langid_ppm.codes(text, model.order)).sum(axis=0, dtype=float).min(), rel=1e-6)
    one = langid_ppm.fit(docs.where("lang = 'de'"))
    assert {r["lang_pred"] for r in langid_ppm.predict(docs, one).collect()} == {"de"}


def test_quality(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["stone", "river", "walks", "slowly", "over", "green", "hills"]) for _ in range(30)).capitalize() + "."
    bad = lambda: " ".join(rng.choice(["BUY", "now", "win"]) + rng.choice(["!!", "$$$"]) for _ in range(30))
    rows = [(i, good() if i % 3 else bad()) for i in range(150)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100)] + [(3, None)], "doc_id long, quality int")
    model = quality_nbsvm.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality_nbsvm.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in range(100, 150)) and got[900] == got[901] and 0 <= got[900] <= 1
    assert quality_nbsvm.score(docs, quality_nbsvm.fit(docs, labels.limit(0))).where("score != 0.5").count() == 0


def test_hinge_loss_against_plain_descent():
    """Dual coordinate descent reaches the objective of a long plain subgradient descent; ratios are those of plain counts."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 12, rng.integers(1, 8))).astype(np.int32) for _ in range(40)]
    y = np.where(np.array([(r < 5).sum() * 2 > len(r) for r in rows]) ^ (rng.random(40) < 0.1), 1.0, -1.0)
    ratio = np.zeros(quality_nbsvm.DIM)
    ratio[:12] = rng.standard_normal(12)
    dense = np.zeros((40, 13))
    for i, r in enumerate(rows):
        dense[i, r] = ratio[r] / math.sqrt(len(r))
    dense[:, 12] = 1
    loss = lambda v: 0.5 * v @ v + quality_nbsvm.COST * np.maximum(0, 1 - y * (dense @ v)).sum()
    v, best = np.zeros(13), math.inf
    for k in range(40_000):
        wrong = y * (dense @ v) < 1
        v = v - (v - quality_nbsvm.COST * (y[wrong, None] * dense[wrong]).sum(axis=0)) / (k + 10)
        best = min(best, loss(v))
    w, bias = quality_nbsvm.descend(rows, ratio, y)
    assert loss(np.append(w[:12], bias)) == pytest.approx(best, rel=0.02)
    model = quality_nbsvm.fit_rows(rows, (y > 0).astype(int))
    up, down = (1.0 + np.bincount(np.concatenate([r for r, s in zip(rows, y, strict=True) if s == side]), minlength=quality_nbsvm.DIM) for side in (1.0, -1.0))
    plain = np.log(up / up.sum()) - np.log(down / down.sum())
    w, bias = quality_nbsvm.descend(rows, plain, y)
    assert model.weight[:12] == pytest.approx((w * plain)[:12], rel=1e-5) and model.bias == pytest.approx(bias)


def test_quality_edges(spark):
    """Repeated rows, clashing columns, a long text, no rows, labels of one class; the same score wherever a text stands."""
    rows = [(i % 60, "BUY now!! " * 5 if i % 2 else "the river walks slowly over green hills. " * 3, 3, 0.5) for i in range(80)] + [(200, "word " * 300_000, 1, 0.1), (None, None, 1, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, score double")
    labels = spark.createDataFrame([(i, (i + 1) % 2, 7) for i in range(50)] + [(4, None, 7), (None, 1, 7)], "doc_id long, quality int, text int")
    model = quality_nbsvm.fit(docs, labels)
    got = [(r["doc_id"], r["score"]) for r in quality_nbsvm.score(docs, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got) and len({s for i, s in got if i is not None and i < 60}) == 2
    assert all((s >= 0.5) == (i % 2 == 0) for i, s in got if i is not None and i < 60)
    assert quality_nbsvm.score(docs.limit(0), model).count() == 0
    one = quality_nbsvm.fit(docs, labels.where("quality = 1"))
    assert {round(r["score"], 2) for r in quality_nbsvm.score(docs, one).collect()} == {1.0}


def test_language_model(spark):
    rng = random.Random(6)
    text = lambda: " ".join(rng.choice(["the", "of", "stone", "river"]) if rng.random() < 0.6 else "".join(rng.choice(["ka", "lo", "mi"]) for _ in range(3)) for _ in range(rng.randrange(40)))
    rows = [(i, text(), i % 4 > 0) for i in range(80)] + [(90, None, True), (91, "", False), (92, "Éé É 漢 the", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r for r in pitman_yor.score(docs, docs["train"]).collect()}
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t, _ in rows}
    c = collections.Counter(x for i, _, train in rows if train for x in tokens[i])
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        assert got[i]["n_tokens"] == len(ts) and got[i]["n_known"] == sum(c[x] > 0 for x in ts) and got[i]["train_tokens"] == n
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts)) and got[i]["score"] < 0
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def partitions(n):
    """All ways to seat customers 0..n-1 at tables, as lists of table sizes."""
    def grow(sizes, left):
        if not left:
            yield sizes
            return
        for k in range(len(sizes)):
            yield from grow([*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]], left - 1)
        yield from grow([*sizes, 1], left - 1)

    return list(grow([1], n - 1))


@pytest.mark.parametrize("discount", [0.1, 0.5, 0.9])
def test_table_counts_against_all_seatings(discount):
    """The drawn number of tables follows the weights of all seatings of the Chinese restaurant process."""
    strength, base, others = 1.5, 0.2, 3
    for c in (2, 3, 6):
        weight = collections.Counter()
        for sizes in partitions(c):
            w = 1.0
            for j, n in enumerate(sizes):
                w *= (strength + discount * (others + j)) * base * math.prod(k - discount for k in range(1, n))
            weight[len(sizes)] += w
        want = np.array([weight[t] for t in range(1, c + 1)])
        many = 40_000
        got = pitman_yor.draw(np.full(many, c), np.full(many, others), np.full(many, base), discount, strength, np.random.default_rng(c))
        assert np.bincount(got, minlength=c + 1)[1:] / many == pytest.approx(want / want.sum(), abs=0.01)


@pytest.mark.parametrize(("discount", "c", "base"), [(0.6, 300, 0.4), (0.6, 2000, 0.05), (0.8, 9000, 0.1), (0.3, 30_000, 0.3)])
def test_many_customers(discount, c, base):
    """Beyond EXACT and beyond WINDOW the weights are those of the full recursion, and so is the mean number of tables."""
    t, row = np.arange(pitman_yor.WINDOW + 1), np.full(pitman_yor.WINDOW + 1, -np.inf)
    row[0] = 0
    for k in range(c):
        row = np.logaddexp(np.append(-np.inf, row[:-1]), np.where(t <= k, np.log(np.maximum(k - t * discount, 1e-300)) + row, -np.inf))
    strength, others = 2.0, 50
    line = np.append(0, np.cumsum(np.log(strength + discount * (others + t[:-1])) + np.log(base)))
    weight = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    want, got = weight((row + line)[1 : c + 1]), weight(pitman_yor.stirling(discount).row(c) + line[1 : c + 1])
    assert abs(want - got).sum() < 0.02
    drawn = pitman_yor.draw(np.full(400, c), np.full(400, others), np.full(400, base), discount, strength, np.random.default_rng(1))
    assert drawn.mean() == pytest.approx((want * t[1 : len(want) + 1]).sum(), rel=0.05)


def test_predictive_against_plain_restaurants():
    """Given the seating, every probability follows from dictionaries of customers and tables; each context sums to one."""
    rng = np.random.default_rng(4)
    hashes = np.sort(rng.integers(1, 1 << 60, 5).astype(np.uint64))
    second, first, dish = rng.integers(0, 5, (3, 300))
    all_ = np.stack(np.meshgrid(range(5), range(5), range(5), indexing="ij")).reshape(3, -1)  # every triple, without training
    second, first, dish = (np.concatenate([x, y]) for x, y in zip((second, first, dish), all_, strict=True))
    train = np.concatenate([np.ones(300, int), np.zeros(125, int)])
    order = pitman_yor.in_order(5, second, first, dish)
    tree = pitman_yor.Subtrees(hashes, second[order], first[order], dish[order], train[order])
    levels, root = [(0.5, 1.0), (0.6, 2.0), (0.7, 0.5)], np.array([0.1, 0.2, 0.3, 0.15, 0.25])
    for _ in range(3):
        tree.sweep(root, levels, rng)
        assert (tree.t2 <= tree.c2).all() and (tree.t1 <= tree.c1).all() and ((tree.t2 > 0) == (tree.c2 > 0)).all() and ((tree.t1 > 0) == (tree.c1 > 0)).all()
    _, p = tree.probabilities(root, levels)
    c2, t2, c1, t1 = (collections.Counter() for _ in range(4))
    for i in range(len(tree.parent)):
        u1, w = int(tree.first[tree.parent[i]]), int(tree.dish[tree.parent[i]])
        u2 = int(tree.context[0][tree.room[i]])
        c2[u2, u1, w], t2[u2, u1, w] = int(tree.c2[i]), int(tree.t2[i])
        c1[u1, w] += int(tree.t2[i])
        t1[u1, w] = int(tree.t1[tree.parent[i]])

    def plain(u2, u1, w):
        below = lambda x: (c1[u1, x] - 0.6 * t1[u1, x] + (2.0 + 0.6 * sum(t1[u1, y] for y in range(5))) * root[x]) / (2.0 + sum(c1[u1, y] for y in range(5)))
        return (c2[u2, u1, w] - 0.7 * t2[u2, u1, w] + (0.5 + 0.7 * sum(t2[u2, u1, y] for y in range(5))) * below(w)) / (0.5 + sum(c2[u2, u1, y] for y in range(5)))

    got = np.empty(425)
    got[order] = p[tree.of]
    for i in range(300, 425):
        assert got[i] == pytest.approx(plain(int(second[i]), int(first[i]), int(dish[i])))
    assert got[300:].reshape(25, 5).sum(axis=1) == pytest.approx(np.ones(25))


def test_root_sums_to_one():
    customers, dishes = np.array([1, 2, 7, 400]), np.array([50, 20, 5, 2])
    root = pitman_yor.Root(customers, dishes, 77, np.random.default_rng(3))
    assert (root.probability(customers) * dishes).sum() + root.probability(np.array([0]))[0] == pytest.approx(1)
    assert (pitman_yor.draw(np.array([0, 1, 1]), np.zeros(3), np.full(3, 0.5), 0.5, 1.0, np.random.default_rng(3)) == [0, 1, 1]).all()
    assert pitman_yor.Root(np.zeros(0, int), np.zeros(0, int), 0, np.random.default_rng(3)).probability(np.array([0]))[0] == pytest.approx(1)


def test_packed_arrays_come_back():
    arrays = [np.zeros(0, np.uint64), np.array([255], np.uint64), np.array([0, 256, 70_000], np.uint64), np.array([1 << 63, 5], np.uint64)]
    assert all((x == y).all() and len(x) == len(y) for x, y in zip(arrays, pitman_yor.unpack(pitman_yor.pack(arrays)), strict=True))


def test_language_model_groups(spark, monkeypatch):
    """Many small groups, with split words: the same counts, nearly the same scores. Repeated rows, clashing columns, no rows, no training."""
    rng = random.Random(7)
    rows = [(i % 150, " ".join(rng.choice(["the", "the", "of", "stone", "river", "hill", f"rare{i // 8}"]) for _ in range(rng.randrange(60))), i % 5 > 0, 1.0, 2) for i in range(200)] + [(900, "the river " * 3000, True, 0.0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean, score double, bucket int")
    key = lambda df: sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), r["score"]) for r in df.collect())
    whole = key(pitman_yor.score(docs, docs["train"]))
    monkeypatch.setattr(pitman_yor, "GROUP", 700)
    for name, value in (("CHUNK", 2), ("HOT", 3), ("RANGE_GROUPS", 2)):  # half of the words are not frequent
        monkeypatch.setattr(pitman_yor, name, value)
    largest = []
    of = pitman_yor.dealt

    def watched(*a):
        out = of(*a)
        n = lambda x: len(pitman_yor.unpack(bytes(x))[4])
        sizes = {}
        for r in out.where("bucket >= 0").collect():
            sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + n(r["data"])
        largest.append((max(sizes.values(), default=0), len(a[6])))
        return out

    monkeypatch.setattr(pitman_yor, "dealt", watched)
    parts = key(pitman_yor.score(docs, docs["train"]))
    # 2,400 times "the river" and as many times "river the" are dealt to several groups
    assert largest[0][1] >= 2 and largest[0][0] < 3000
    assert len(whole) == len(rows) and [x[:5] for x in whole] == [x[:5] for x in parts]
    assert sum(x[5] for x in parts) == pytest.approx(sum(x[5] for x in whole), rel=0.03)
    assert pitman_yor.score(docs.limit(0), docs["train"]).count() == 0
    none = pitman_yor.score(docs, docs["train"] & False).collect()
    assert all(r["train_tokens"] == r["n_known"] == 0 and r["score"] == pytest.approx(0) and r["base_score"] == pytest.approx(0) for r in none)


def test_language_model_sends_back_little(spark, monkeypatch):
    """Texts whose words lie in many groups: what groups send back takes a few bytes a token, and the sums are right."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(60)), i % 5 > 0) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(4, "doc_id")
    for name, value in (("GROUP", 700), ("HOT", 400), ("CHUNK", 64), ("SLICE", 4000)):
        monkeypatch.setattr(pitman_yor, name, value)
    sizes, of = {}, pitman_yor.durable

    def watched(df, label):
        out = of(df, label)
        if label == "parts":
            sizes.update(out.selectExpr("sum(length(sums)) as size", "count(*) as n").first().asDict())
        return out

    monkeypatch.setattr(pitman_yor, "durable", watched)
    got = {r["doc_id"]: r for r in pitman_yor.score(docs, docs["train"]).collect()}
    tokens = {i: [*t.split(), None] for i, t, _ in rows}
    c = collections.Counter(x for i, _, train in rows if train for x in tokens[i])
    n, v = sum(c.values()), len(c)
    assert v > 500 and len(got) == len(rows)
    for i, ts in tokens.items():
        assert got[i]["n_known"] == sum(c[x] > 0 for x in ts) and got[i]["train_tokens"] == n
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in ts), rel=1e-12) and got[i]["score"] < 0
    assert sizes["n"] > 20 and sizes["size"] < 6 * sum(map(len, tokens.values()))


def test_rollup(spark, tmp_path):
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    change = lambda *rows: spark.createDataFrame(list(rows), "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    assert r.totals().count() == 0
    assert r.commit("a", change(("insert", "s", "en", "v1", 10, None), ("insert", "s", "en", "v1", 5, None), ("insert", None, "en", "v1", None, None)))
    assert not r.commit("a", change(("insert", "s", "en", "v1", 99, None)))
    assert r.commit("b", change(("delete", "s", "en", "v1", 5, None), ("revise", "s", "en", "v1", 7, 10))) and r.commit("c", change().limit(0))
    assert {tuple(x) for x in r.totals().collect()} == {("s", "en", "v1", 1, 7), (None, "en", "v1", 1, 0)}
    with pytest.raises(PySparkException):
        r.commit("d", change(("replace", "s", "en", "v1", 1, 1)))
    assert not r.committed("d")


def test_rollup_compaction(spark, tmp_path):
    """Sums stay, ids stay known, later batches add up, a folder that never reached the log is not read."""
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    change = lambda *rows: spark.createDataFrame(list(rows), "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long, extra int")
    r.compact()
    for k in range(3):
        r.commit(f"b{k}", change(("insert", "s", "en", "v1", 10 + k, None, 1), ("insert", "s", "en", "v1", 10 + k, None, 1)))
    before = r.totals().collect()
    r.compact()
    assert r.totals().collect() == before and not r.commit("b1", change(("insert", "s", "en", "v1", 99, None, 1)))
    assert r.commit("b9", change(("delete", "s", "en", "v1", 10, None, 1)))
    r.compact()
    r.totals().withColumnsRenamed({"n_docs": "d_docs", "n_tokens": "d_tokens"}).write.parquet(f"file://{tmp_path}/r/data/lost")
    assert {tuple(x) for x in r.totals().collect()} == {("s", "en", "v1", 5, 56)} and r.committed("b0")


def test_compactions_at_once(spark, tmp_path):
    """From one state of the log, or from overlapping ones, every batch counts once."""
    changes = lambda *n: spark.createDataFrame([("insert", "a", "en", "w/1", x, 0) for x in n], "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long")
    total = lambda r: [tuple(x)[3:] for x in r.totals().collect()]
    one, two, three = (token_rollup.TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(3))
    one.commit("x", changes(3))
    one.commit("y", changes(4, 5))
    early = token_rollup.durable(one._log(), "state")
    one.commit("z", changes(10))
    late = token_rollup.durable(one._log(), "state")
    assert total(one) == [(4, 22)]
    two._log, three._log = lambda: early, lambda: late
    for r in (two, two, three, two):  # the same compaction again, a larger one, and the first once more
        r.compact()
        assert total(one) == [(4, 22)]
    assert not one.commit("y", changes(4, 5)) and one.commit("w", changes(1)) and total(one) == [(5, 23)]
    one.compact()
    assert total(one) == [(5, 23)] and one._active(one._log()).count() == 1
    again = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    again.committed = lambda batch_id: False  # another writer of a batch that is there
    again.commit("v", changes(2))
    again.spark.createDataFrame([("v", "data/elsewhere", None)], "batch_id string, folder string, covers string").write.parquet(f"file://{tmp_path}/r/log/other")
    assert total(one) == [(6, 25)]


def test_rollup_of_a_corpus_by_tokenizer(spark):
    """Against the library: copies out, repeated lines not counted."""
    from tokenizers import Tokenizer

    from strandlake.llm.bpe import default_path

    docs = spark.createDataFrame([(1, "one two\none two\nthree", "a", "en"), (2, "one two\none two\nthree", "a", "en"), (3, "four", None, "en"), (4, None, None, None), (5, "", "a", "en"), (6, "x\nx", "a", "en")], "doc_id long, text string, source string, lang string")
    rollup = token_rollup.TokenRollup(spark, f"{token_rollup.shared_dir(spark)}/rollup-{token_rollup.uuid.uuid4().hex}")
    for name, changes in 2 * token_rollup.bpe_history(docs):
        rollup.commit(name, changes)
    n = lambda t: len(Tokenizer.from_file(default_path()).encode(t, add_special_tokens=False).ids)
    got = {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()}
    assert got == {("a", "en"): (2, n("one two\nthree") + n("x")), (None, "en"): (1, n("four")), (None, None): (1, 0)}
    whole = {tuple(r)[:3]: tuple(r)[3:] for r in queries.op2_bpe_rollup(spark, "/root/testdata/sf0.001").collect()}
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want, seen, count = {}, set(), Tokenizer.from_file(default_path())
    for r in table:
        text = r["text"] or ""
        group = want.setdefault((r["source"], r["lang"], "byte_bpe_50k/1"), [0, 0])
        if text in seen:
            continue
        seen.add(text)
        group[0] += 1
        group[1] += len(count.encode("\n".join(dict.fromkeys(text.split("\n"))), add_special_tokens=False).ids)
    assert whole == {k: tuple(v) for k, v in want.items()}


def test_rollup_of_bpe_tokens(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, "The stone river", "a", "en"), (2, None, "a", "en"), (3, "žluť  kůň", None, "cs"), (3, "žluť  kůň", None, "cs")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    r = token_rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    r.commit("in", token_rollup.bpe_changes(docs, "insert"))
    r.commit("out", token_rollup.bpe_changes(docs.where("doc_id = 1"), "delete"))
    czech = len(library.encode(rows[2][1], add_special_tokens=False).ids)
    assert {tuple(x) for x in r.totals().collect()} == {("a", "en", "byte_bpe_50k/1", 1, 0), (None, "cs", "byte_bpe_50k/1", 2, 2 * czech)}


PAGE = """<html><head><title>T{i}</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li>Home</ul></nav>{open}
<h1>Title {i} &amp; more</h1><p>First  {i}<br>line<p>Second <b>bold {i}</b> text &eacute;<div class="share">Share this</div>{close}
<p>Read more on Example</p><aside>Side {i}</aside><section id="comments"><p>Comment {i}</section><form>Name <input></form><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    marked = [(i, f"http://a.example/{i}", PAGE.format(i=i, open="<article>", close="</article>")) for i in range(20)]
    plain = [(100 + i, f"http://b.example/{i}", PAGE.format(i=i, open="<div class=body>", close="</div>")) for i in range(20)]
    odd = [(500, None, None), (501, "http://a.example/x", ""), (502, "bad", "plain words"), (503, "bad", "<h1>Title</h1><p>Some words</p>"), (504, "http://s.example/", "<body><nav>Menu</nav><article class=share>Own text</article></body>")]
    pages = spark.createDataFrame([*marked, *plain, *odd], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_template.extract(pages).collect()}
    for i in range(20):
        want = f"Title {i} & more\n\nFirst {i} line\n\nSecond bold {i} text é"
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)
        assert got[100 + i]["text"] == want
    assert got[500]["text"] == got[501]["text"] == "" and len(got) == 45
    assert got[502]["text"] == "plain words" and got[503]["text"] == "Title\n\nSome words" and got[504]["text"] == "Own text"
    assert html_template.extract(pages.limit(0)).count() == 0


def words_of(i, n):
    rng = random.Random(i)
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def test_template_finds_what_tags_do_not(spark):
    """Teasers are article elements on this host, the story is a plain container; a page alone would be read by its largest article."""
    html = "<html><body><div id=story><h2>Story {i}</h2>{p}</div><article><p>{teaser}</article><footer>x</footer></body></html>"
    rows = [(i, "http://t.example/", html.format(i=i, p="".join(f"<p>{words_of(100 * i + k, 30)}" for k in range(4 if i % 4 else 1)), teaser=words_of(9000 + i, 20 if i % 4 else 60))) for i in range(24)]
    got = {r["page_id"]: r["text"] for r in html_template.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(24):
        assert got[i] == "\n\n".join([f"Story {i}", *(words_of(100 * i + k, 30) for k in range(4 if i % 4 else 1))])
    alone = html_template.main_text(rows[0][2], None)
    assert alone == words_of(9000, 60) and alone != got[0]


def test_two_layouts_and_copies(spark):
    """The rarer layout of a host has its own slots; pages that are copies of one page are no template; repeated rows stay."""
    one = "<body><div class=a><h1>One {i}</h1><p>{t}</div><div class=z>Side {i}</div></body>"
    two = "<body><div class=wide><div class=inner><h1>Two {i}</h1><p>{t}</div></div><div class=z>Side {i}</div></body>"
    rows = [(i, "http://l.example/", (two if i % 5 == 0 else one).format(i=i, t=words_of(i, 20))) for i in range(40)]
    rows += [(100 + i, "http://c.example/", "<body><article><p>Same text on every copy</article></body>") for i in range(9)] + [rows[0]]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host long")
    got = [(r["page_id"], r["text"]) for r in html_template.extract(pages).collect()]
    assert len(got) == len(rows)
    for i, text in got:
        assert text == ("Same text on every copy" if i >= 100 else f"{'Two' if i % 5 == 0 else 'One'} {i}\n\n{words_of(i, 20)}")


def test_very_long_page(spark):
    html = "<body><article><h1>Long</h1>" + "".join(f"<p>part {i} {words_of(i, 10)}" for i in range(20_000)) + "</article></body>"
    text = html_template.extract(spark.createDataFrame([(1, "http://x.example/", html)], "page_id long, url string, html string")).first()["text"]
    assert text.startswith("Long\n\npart 0 ") and text.count("\n\n") == 20_000


def test_template_line_goes(spark):
    """A line that stands on every page of a host is template, also inside the article."""
    html = "<html><body><article><p>Story {i} begins here.<p>Subscribe to our letter<p>Story {i} ends.</article></body></html>"
    pages = spark.createDataFrame([(i, "http://c.example/", html.format(i=i)) for i in range(12)], "page_id long, url string, html string")
    assert {r["text"] for r in html_template.extract(pages).collect()} == {f"Story {i} begins here.\n\nStory {i} ends." for i in range(12)}


def test_every_leak_has_a_seed():
    """All patterns of places that disagree, for every length of an item: some place of the mask meets none of them."""
    for n in range(1, decontam.WINDOW + 1):
        wrong, picked = next(k for k in range(n, -1, -1) if n - k >= n * decontam.SHARE), decontam.mask(n)
        assert len(picked) > 1 or n < 2
        for places in itertools.combinations(range(n), wrong):
            assert any(not {a + p for p in picked} & set(places) for a in range(n - picked[-1]))
    assert decontam.mask(20) == (0, 5, 10, 15)


def test_leak_edges(spark):
    """Repeated rows, an empty table of documents, clashing columns, a very long text, words that repeat."""
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi"
    rows = [(1, item, 1, "h"), (1, item, 1, "h"), (2, "word " * 200_000 + item, 2, "t"), (3, "alpha " * 300, 3, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long, t string")
    bench = spark.createDataFrame([(9, item), (9, item), (8, "alpha " * 25)], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["matched"], r["start_token"]) for r in decontam.leaks(docs, bench).collect())
    assert got == [(1, 9, 20, 0), (2, 9, 20, 200_000), (3, 8, 20, 0)]
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.clean(docs, bench).columns == docs.columns


def test_leaks_against_all_alignments(spark):
    """Short items and substitutions that spaced seeds miss, against every alignment of every item to every document."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = {n: [word() for _ in range(n)] for n in (1, 2, 4, 5, 7, 8, 10, 12, 15, 20, 31)}
    spoilt = [(n, ()) for n in items] + [(5, (2,)), (8, (3,)), (8, (2, 5)), (10, (3, 6)), (12, (4, 8)), (15, (3, 7, 11)), (20, (4, 8, 12, 16)), (20, (3, 7, 11, 15, 19)), (31, (6, 10, 14, 18, 22))]
    texts = []
    for n, places in spoilt:
        body = [word() if k in places else x for k, x in enumerate(items[n])]
        texts.append([word() for _ in range(rng.randrange(5))] + body + [word() for _ in range(rng.randrange(5))])
    want = {}
    for i, t in enumerate(texts):
        for n, b in items.items():
            w = min(n, decontam.WINDOW)
            matched = max((sum(x == y for x, y in zip(b[p : p + w], t[q : q + w], strict=True)) for p in range(n - w + 1) for q in range(len(t) - w + 1)), default=0)
            if matched * 5 >= w * 4:
                want[i, n] = (matched, w)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(n, " ".join(b)) for n, b in items.items()], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]): (r["matched"], r["compared"]) for r in decontam.leaks(docs, bench).collect()} == want
    assert len(want) == len(spoilt) - 2
