"""Small inputs whose results follow on paper."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.config import StatConfig
from strandlake.functions import sequence
from strandlake.functions.sequence import dust_scores, kmer_codes, with_dust
from strandlake.operators import coverage as cov
from strandlake.operators import reads, selection, taxonomy
from strandlake.operators.compare import cmpstat, unmatched
from strandlake.operators.filters import scored
from strandlake.plans.bamstats import bamstats, read_length_distribution
from strandlake.plans import held, release
from strandlake.plans.refstats import refstats, summary
from strandlake.plans.taxstats import taxstats_from_tags

ALN = "ord long, qname string, flag int, tid int, ref_len long, pos long, end_pos long, qlen int, nm int, as_score int, seq string, xr long"


def alns(spark, rows):
    keys = ["ord", "qname", "flag", "tid", "ref_len", "pos", "end_pos", "qlen", "nm", "as_score", "seq", "xr"]
    base = {"flag": 0, "tid": 0, "ref_len": 20, "pos": 0, "end_pos": 10, "qlen": 10, "nm": 0, "as_score": None, "seq": "ACGTACGTAC", "xr": None}
    return spark.createDataFrame([tuple((base | {"ord": i, "qname": f"r{i}"} | r)[k] for k in keys) for i, r in enumerate(rows)], ALN)


def intervals(spark, *spans, ref_len=20):
    return alns(spark, [{"pos": a, "end_pos": b, "ref_len": ref_len} for a, b in spans])


M1 = [(0, 10), (5, 15)]


@pytest.mark.parametrize("stripe", [1 << 22, 7, 1])
def test_sweep(spark, stripe):
    row = cov.basic(cov.segments(intervals(spark, *M1), ["tid"], stripe), ["tid"]).first()
    assert (row["covbases"], row["depthsum"], row["sumsq"]) == (15, 20, 30)


def test_figures(spark):
    b = cov.basic(cov.segments(intervals(spark, *M1), ["tid"]), ["tid"])
    f = cov.figures(F.lit(20))
    r = b.select(*[v.alias(k) for k, v in f.items()]).first()
    assert r["mean_cov"] == 1.0 and r["breath_cov"] == 0.75 and r["site_density"] == 750
    assert r["exp_breath"] == pytest.approx(0.632121, abs=1e-6) and r["breath_ratio"] == pytest.approx(1.186483, abs=1e-6)
    assert r["mean_covcovered"] == pytest.approx(4 / 3) and r["stdev_covcovered"] ** 2 == pytest.approx(0.222222, abs=1e-6) and r["evenness_cov"] == pytest.approx(0.353553, abs=1e-6)
    t = b.select(cov.figures(F.lit(20), F.col("covbases") / 20)["exp_breath"].alias("x")).first()
    assert t["x"] == pytest.approx(0.527633, abs=1e-6)


def test_bins(spark):
    a = intervals(spark, *M1)
    segs = cov.segments(a, ["tid"])
    bins = cov.bins_of(segs, a.select("tid", "ref_len").distinct(), ["tid"])
    r = bins.first()
    assert (r["q1"], r["q3"], r["n_bins"], r["width"]) == (3, 11, 5, 4.0)
    hist = cov.bin_histogram(segs, bins, ["tid"])
    assert {x["value"]: x["bins"] for x in hist.collect()} == {4: 3, 3: 1, 0: 1}
    s = cov.shape(hist, ["tid"]).first()
    assert s["entropy"] == pytest.approx(1.370951, abs=1e-6) and s["norm_entropy"] == pytest.approx(0.864974, abs=1e-6)
    assert s["gini"] == pytest.approx(0.24) and s["norm_gini"] == pytest.approx(0.3) and s["tad80"] == pytest.approx(3.666667, abs=1e-6)


def test_default_width(spark):
    a = intervals(spark, (0, 3), ref_len=1000)
    r = cov.bins_of(cov.segments(a, ["tid"]), a.select("tid", "ref_len"), ["tid"]).first()
    assert (r["q1"], r["q3"], r["n_bins"]) == (0, 2, 361) and r["width"] == pytest.approx(2.773445, abs=1e-6)


def test_dust():
    tail = "CGGTCATTGCAGATCCGTAAGCTTGACC"
    got = dust_scores(pa.array(["A" * 10, "ACGTACGTAC", "ACNGT", "AC", "", None, "A" * 66 + tail]))
    assert got[0] == 100 and got[1] == pytest.approx(14.285714, abs=1e-6) and list(got[2:6]) == [0, 0, 0, 0]
    assert got[6] < 100  # the first full window of 64 triplets is no candidate


def test_kmers():
    assert len(set(kmer_codes(pa.array(["ACGT"]), 3, 255, 1 << 30)[1].tolist())) == 1
    code = kmer_codes(pa.array(["ACNGT"]), 3, 255, 1 << 30)[1].tolist()
    assert code == [-1, -1, -1]
    assert len(kmer_codes(pa.array(["ACGT", None, "AC"]), 3, 255, 1)[1]) == 1
    with pytest.raises(ValueError):
        kmer_codes(pa.array(["A"]), 40, 255, 1)


def test_read_lengths(spark):
    two = alns(spark, [{"qlen": 50}, {"qlen": 60}])
    f = reads.first_records(two, ["tid"])
    assert reads.read_lengths(f, ["tid"]).first()["stdev_readl"] == pytest.approx(7.071068, abs=1e-6)
    assert reads.read_lengths(f, ["tid"], 3).first()["stdev_readl"] == 0
    assert tuple(reads.median_mode(f, ["tid"]).first())[1:] == (60, 50)
    clip = reads.first_records(alns(spark, [{"qlen": 300}, {"qlen": 400}, {"qlen": 30}]), ["tid"])
    r = reads.read_lengths(clip, ["tid"]).first()
    assert r["mean_readl"] == pytest.approx(243.333333, abs=1e-6) and (r["readl_min"], r["readl_max"]) == (30, 400)
    assert tuple(reads.median_mode(clip, ["tid"]).first())[1:] == (255, 255)


def test_same_read_twice(spark):
    r = refstats(alns(spark, [{"qname": "r", "qlen": 50}, {"qname": "r", "qlen": 0}])).first()
    assert (r["num_alns"], r["num_reads"], r["mean_readl"]) == (2, 1, 50)


def test_score_filter(spark):
    a = alns(spark, [{"as_score": None}, {"as_score": -5}, {"as_score": 3}])
    assert {r["as_score"] for r in a.where(scored(0)).collect()} == {None, 3} and a.where(scored(None)).count() == 3


def test_identity(spark):
    r = reads.alignment_stats(with_dust(alns(spark, [{"nm": n, "qlen": 50} for n in (0, 5, 10)])), ["tid"]).first()
    assert r["mean_alnani"] == pytest.approx(90) and r["stdev_alnani"] == pytest.approx(10) and r["median_alnani"] == pytest.approx(90)


def test_climb(spark):
    nodes = spark.createDataFrame([(100, 90, "species"), (90, 80, "clade"), (80, 70, "family"), (70, 1, "order"), (1, 1, "no rank")], "taxid long, parent long, rank string")
    ids = spark.createDataFrame([(100,), (7,)], "taxid long")
    at = lambda rank: {r["taxid"]: r["rank_taxid"] for r in taxonomy.climb(ids, nodes, rank).collect()}
    assert at("genus") == {100: 80} and at("order") == {100: 70} and at("kingdom") == {100: 100}


def test_selection(spark):
    a = alns(spark, [{"qname": "q", "nm": n, "pos": 0, "end_pos": 100, "ref_len": 200} for n in (0, 0, 5, 20)])
    n = lambda **k: selection.alnfilt(a, **k).count()
    assert (n(), n(mode="RNDTOP"), n(mode="PCTTOP"), n(mode="PCTTOP", pct=0.99), n(mode="ALL"), n(strict=True)) == (2, 1, 3, 2, 3, 0)
    assert n(mode="RNDTOP", seed=3) == 1
    with pytest.raises(ValueError):
        n(mode="BEST")


def test_cmpstat(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    two = spark.createDataFrame([("b", 9), ("c", 8)], "id string, v int")
    assert [tuple(r) for r in cmpstat(one, two, 1, 1).collect()] == [("b", 2, 9)] and [r["Id"] for r in unmatched(one, two).collect()] == ["c"]


def test_taxon_pooling(spark):
    rows = [{"tid": 0, "pos": a, "end_pos": b, "xr": 5} for a, b in M1] + [{"tid": 1, "ref_len": 100, "xr": 5}, {"xr": None}]
    names = spark.createDataFrame([(5, "five")], "taxid long, name string")
    r = taxstats_from_tags(alns(spark, rows), names, StatConfig()).collect()
    assert len(r) == 1 and (r[0]["name"], r[0]["num_accessions"], r[0]["total_length"], r[0]["num_covbases"]) == ("five", 2, 120, 25)
    assert r[0]["mean_cov"] == pytest.approx(0.25) and r[0]["mean_covcovered"] == pytest.approx(1.2) and r[0]["stdev_covcovered"] ** 2 == pytest.approx(0.16)


def test_empty(spark):
    none = alns(spark, [{"flag": 4}])
    assert refstats(none).count() == 0 and bamstats(none.withColumn("file", F.lit("x"))).count() == 0
    assert read_length_distribution(none).agg(F.sum("n")).first()[0] == 0


def test_width_at_a_cube(spark):
    """1000 covered bases: the cube root is 10 exactly, so the width is a whole number."""
    a = intervals(spark, (0, 1000), ref_len=2000)
    r = cov.bins_of(cov.segments(a, ["tid"]), a.select("tid", "ref_len"), ["tid"]).first()
    assert (r["q1"], r["q3"], r["width"], r["n_bins"]) == (250, 750, 100.0, 20)


@pytest.mark.parametrize("stripe", [1 << 22, 7, 1])
def test_quartiles_by_stripes(spark, stripe):
    """The same places however long the stripes are: against a list of the covered bases."""
    rng = random.Random(3)
    spans = [(a, a + rng.randrange(1, 9)) for a in rng.sample(range(90), 12)]
    for k in range(2, len(spans) + 1, 3):
        bases = sorted({p for a, b in spans[:k] for p in range(a, b)})
        r = cov.quartiles(cov.segments(intervals(spark, *spans[:k], ref_len=200), ["tid"]), ["tid"], stripe).first()
        place = lambda t: bases[t - 1] + 1 if t else bases[0]
        assert (r["covbases"], r["q1"], r["q3"]) == (len(bases), place(len(bases) // 4), place(3 * len(bases) // 4))


def test_kmer_counts_against_sets(spark, monkeypatch):
    """Distinct k-mers by group over many small lots and batches, for one key and for two."""
    monkeypatch.setattr(sequence, "COMBINED", 50)
    rng = random.Random(4)
    rows = [(rng.randrange(3), rng.randrange(2), "".join(rng.choice("ACGTN") for _ in range(rng.randrange(12)))) for _ in range(300)]
    df = spark.createDataFrame([(a, b, s) for a, b, s in rows], "tid int, part long, seq string")
    flip = str.maketrans("ACGT", "TGCA")
    for keys, of in ((["tid"], lambda r: (r[0],)), (["tid", "part"], lambda r: (r[0], r[1]))):
        want: dict = {}
        for r in rows:
            for i in range(len(r[2]) - 3):
                k = r[2][i : i + 4]
                want.setdefault(of(r), []).append("N" if "N" in k else min(k, k.translate(flip)[::-1]))
        got = {tuple(r[c] for c in keys): (r["distinct_kmers"], r["total_kmers"]) for r in sequence.kmer_counts(df, keys, 4).collect()}
        assert got == {g: (len(set(x)), len(x)) for g, x in want.items()}
    assert sequence.kmer_counts(df.limit(0), ["tid"], 4).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8, 17, 21, 31])
def test_kmer_codes_by_doubling(k):
    """The same codes as base by base; first bases, most k-mers a row, other bases and short sequences."""
    rng = random.Random(k)
    seqs = [None, "", "A", "acgt"] + ["".join(rng.choice("ACGTacgtN" if i % 3 else "ACGT") for _ in range(rng.randrange(80))) for i in range(40)]
    for longest, most in ((255, 1 << 30), (40, 7)):
        want = []
        for i, s in enumerate(seqs):
            s = (s or "").upper()[:longest]
            for j in range(min(most, max(0, len(s) - k + 1))):
                w = s[j : j + k]
                number = lambda x: int("".join(str("ACGT".index(c)) for c in x), 4)
                want.append((i, -1 if "N" in w else min(number(w), number(w.translate(str.maketrans("ACGT", "TGCA"))[::-1]))))
        row, code = kmer_codes(pa.array(seqs), k, longest, most)
        assert list(zip(row.tolist(), code.tolist(), strict=True)) == want


def test_kmers_of_a_large_lot(spark, monkeypatch):
    """Lots of twenty times what a worker may hold are counted part by part, within that bound."""
    monkeypatch.setattr(sequence, "COMBINED", 3000)
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGT") for _ in range(255)) for _ in range(1500)]
    df = spark.createDataFrame([(i % 2, s) for i, s in enumerate(seqs)] + [(0, seqs[0])] * 40, "tid int, seq string")
    total = sequence.kmer_total(df, 17, 255, 1 << 30)
    lots = sequence.LOTS * 4
    held = total // lots // 20
    got = {r["tid"]: (r["distinct_kmers"], r["total_kmers"]) for r in sequence.kmer_counts(df, ["tid"], 17, held=held).collect()}
    assert total == 1540 * 239 and got == {r["tid"]: (r["distinct_kmers"], r["total_kmers"]) for r in sequence.kmer_counts(df, ["tid"], 17).collect()}
    codes = [kmer_codes(pa.array([s]), 17, 255, 1 << 30)[1].tolist() for s in seqs]
    assert got == {t: (len({c for x in codes[t::2] for c in x}), n * 239) for t, n in ((0, 790), (1, 750))}
    # the same pieces through the counter of a worker
    held_rows = [([np.zeros(1, np.int64)], *kmer_codes(pa.array([s]), 17, 255, 1 << 30)) for s in seqs]
    pieces = sorted((x for at in range(0, 1500, 12) for x in sequence.dealt_kmers(held_rows[at : at + 12], 17, 4, 20)), key=lambda x: x[:2])
    counter, bound, seen = sequence.Counter(1, 17, 2 * (1500 * 239 // 80)), 2 * (1500 * 239 // 80), 0
    for i, (lot, part, raw) in enumerate(pieces):
        if i and pieces[i - 1][:2] != (lot, part):
            seen += int(counter.taken()[1].sum())
        counter.add(raw)
    assert seen + int(counter.taken()[1].sum()) == len({x for _, _, c in held_rows for x in c.tolist()}) and counter.largest <= bound + 3000


def test_deep_tree(spark):
    """A chain of a thousand nodes, a circle, a parent that is no node, roots: in a number of rounds that grows with the logarithm."""
    rows = [(i, i + 1, "clade") for i in range(1, 1000)] + [(1000, 2000, "genus"), (2000, 2000, "domain"), (3000, 3001, "clade"), (3001, 3002, "clade"), (3002, 3000, "clade"), (3003, 3000, "x"), (4000, 4999, "clade"), (4001, 4000, "species"), (5000, 2000, "clade")]
    nodes = spark.createDataFrame(rows, "taxid long, parent long, rank string")
    at = lambda rank: {r["taxid"]: r["rank_taxid"] for r in taxonomy.climb(nodes.select("taxid").union(nodes.select("taxid")), nodes, rank).collect()}
    genus, every = at("genus"), {r[0] for r in rows}
    assert genus == {t: 1000 if t <= 1000 else t for t in every}
    assert at("domain") == {t: t for t in every} and at("species") == {t: t for t in every}  # a root is nobody's ancestor
    missing = taxonomy.climb(spark.createDataFrame([(7777,), (None,), (3,)], "taxid long"), nodes, "genus").collect()
    assert [tuple(r) for r in missing] == [(3, 1000)]


@pytest.mark.parametrize("by", ["tid", "first"])
def test_numbers_of_references(spark, monkeypatch, by):
    monkeypatch.setattr(selection, "RANGE", 4)
    rng = random.Random(5)
    rows = [(i, rng.randrange(1000)) for i in range(60)]
    got = {r["tid"]: r["new_tid"] for r in selection.renumber(spark.createDataFrame(rows, "ord long, tid int"), by).collect()}
    order = sorted({t for _, t in rows}) if by == "tid" else list(dict.fromkeys(t for _, t in rows))
    assert got == {t: k for k, t in enumerate(order)}
    deep = spark.createDataFrame(rows, "ord long, tid int").select(F.struct("ord", "tid").alias("ord"), "tid")
    assert {r["tid"]: r["new_tid"] for r in selection.renumber(deep, by).collect()} == got


def test_one_of_the_best(spark):
    """RNDTOP with a seed keeps one of the best of each read; the same seed the same, other seeds others."""
    rows = [{"qname": f"r{i // 5}", "ord": i, "nm": 0 if i % 5 < 4 else 1, "tid": i % 5} for i in range(200)]
    a = alns(spark, rows)
    pick = lambda seed: sorted((r["qname"], r["tid"]) for r in selection.alnfilt(a, "RNDTOP", seed=seed).collect())
    one, two = pick(1), pick(2)
    assert one == pick(1) and one != two and len(one) == len({q for q, _ in one}) == 40 and all(t < 4 for _, t in one + two)
    assert {t for _, t in one} == {0, 1, 2, 3}


def test_run_totals(spark):
    a = alns(spark, [{"qname": "r", "flag": 4}, {"qname": "a"}, {"qname": "a", "tid": 1}, {"qname": "b"}])
    stats = refstats(a, StatConfig(minreads=2))
    row = lambda every: tuple(summary(a, stats, StatConfig(minreads=2), every).select("alns", "reads", "passed_alns", "passed_reads", "passed_refs").first())
    assert row(False) == (3, 3, 2, 2, 1) and row(True) == (4, 3, 2, 2, 1)
    assert stats.storageLevel == a.storageLevel and len(held(stats)) == 1
    release(stats)
    assert not held(stats)[0].is_cached


def test_last_of_a_repeated_key(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "Id string, n int").coalesce(1)
    assert {tuple(r) for r in cmpstat(one, spark.createDataFrame([("a", 7), ("a", 8)], "Id string, n int"), 1, 1).collect()} == {("a", 3, 7), ("a", 3, 8)}
