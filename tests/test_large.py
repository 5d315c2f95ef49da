"""What keeps the plans small on disk: sequences cross the shuffle once, k-mers only those of large groups, and a plan's
tables go as soon as they are read."""

import numpy as np
import pyarrow as pa
import pytest

from strandlake.functions.sequence import kmer_codes
from strandlake.operators import coverage as cov
from strandlake.operators import kmers
from strandlake.plans import held, taxstats
from strandlake.plans.refstats import refstats
from strandlake.shared import hadoop_path, shared_dir
from tests.test_micro import alns

BOUNDS = (9, 40, 30)


def reads(spark):
    """(rows, alignments): reads that begin other reads, several records of a read, sequences that are absent."""
    draw = np.random.default_rng(3)
    texts = ["".join(draw.choice(list("ACGTN"), 60, p=[0.245] * 4 + [0.02])) for _ in range(12)] + ["A" * 60]
    rows = []
    for i in range(600):
        seq = texts[int(draw.integers(len(texts)))][: int(draw.integers(5, 60))] if i % 50 else None
        rows.append({"qname": f"r{int(draw.integers(300))}", "tid": int(draw.integers(3)) if i < 500 else 3 + i % 20, "ord": int(draw.permutation(10_000)[0]) * 1000 + i, "seq": seq, "qlen": len(seq or "")})
    return rows, alns(spark, rows)


def expected(rows):
    first = {}
    for r in rows:
        at = (r["tid"], r["qname"])
        if at not in first or r["ord"] < first[at]["ord"]:
            first[at] = r
    found = {}
    for (tid, _), r in first.items():
        found.setdefault(tid, []).extend(kmer_codes(pa.array([r["seq"]], pa.string()), *BOUNDS)[1].tolist())
    return first, {t: (len(set(c)), len(c)) for t, c in found.items() if c}


@pytest.mark.parametrize("held_kmers", [10**6, 200, 0])
def test_kmers_of_first_records(spark, monkeypatch, held_kmers):
    """All groups small, some large, all large: the same counts as sets."""
    monkeypatch.setattr(kmers, "HELD", held_kmers)
    rows, df = reads(spark)
    if held_kmers == 10**6:
        monkeypatch.setattr(kmers, "kmer_counts", None)  # k-mers of small groups are not shuffled
    sized = df.groupBy("tid").agg(*kmers.sizes(kmers.per_read(*BOUNDS)))
    table = kmers.read_table(df, ["tid"], *BOUNDS, sized)
    first, want = expected(rows)
    assert {(r["tid"], r["qname"]): r["qlen"] for r in table.collect()} == {at: r["qlen"] for at, r in first.items()} and table.count() == len(first)
    assert {r["tid"]: (r["distinct_kmers"], r["total_kmers"]) for r in kmers.counts(table, ["tid"], *BOUNDS).collect()} == want


def test_sequences_that_begin_others_are_dropped(spark):
    rows = [(1, "ACGTACGTT"), (1, "ACGTACG"), (1, "ACGTACGTT"), (2, "ACGTACG"), (1, "ACGTC"), (2, "")]
    for common in (10**6, 0):
        kmers.ROWS, was = (common or 2), kmers.ROWS
        try:
            got = sorted(tuple(r) for r in kmers.maximal(spark.createDataFrame(rows, "tid int, seq string").coalesce(1), ["tid"], 40).collect())
        finally:
            kmers.ROWS = was
        assert set(got) >= {(1, "ACGTACGTT"), (1, "ACGTC"), (2, "ACGTACG")} and set(got) <= set(rows)
    table = pa.table({"tid": [r[0] for r in rows], "seq": [r[1] for r in rows]})
    assert sorted(zip(*kmers._maximal(table, ["tid"]).to_pydict().values(), strict=True)) == [(1, "ACGTACGTT"), (1, "ACGTC"), (2, "ACGTACG")]


@pytest.mark.parametrize("stripe", [7, 100, cov.STRIPE])
def test_swept_as_segments(spark, stripe):
    draw = np.random.default_rng(5)
    rows = [{"tid": t, "pos": (p := int(draw.integers(0, 90))), "end_pos": p + int(draw.integers(0, 30))} for t in (0, 0, 1, 2) for _ in range(12)] + [{"tid": 3, "pos": 0, "end_pos": 95}]
    df = alns(spark, rows)
    one = lambda x: sorted(tuple(r) for r in x.collect())
    assert one(cov.swept(df, ["tid"], stripe)[0]) == one(cov.segments(df, ["tid"]))


def test_tables_of_refstats_go(spark):
    """Only the result is left in the shared folder, and nothing on the executors."""
    there = lambda: {x.getPath().getName() for x in fs.listStatus(at)}
    _, df = reads(spark)
    fs, at = hadoop_path(spark, shared_dir(spark))
    fs.mkdirs(at)
    before = there()
    stats = refstats(df)
    assert [x.rsplit("-", 1)[0] for x in there() - before if not x.startswith(("stripes", "heads", "sequences"))] == ["refstats"] and len(held(stats)) == 1
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0 or not held(stats)[0].is_cached


def test_taxon_totals(spark):
    """The totals need counts of reads only."""
    df = alns(spark, [{"qname": "a", "tid": 0}, {"qname": "a", "tid": 1}, {"qname": "b", "tid": 0}, {"qname": "c", "tid": 2}, {"qname": "d", "tid": 9}, {"qname": "e", "flag": 4}])
    at = spark.createDataFrame([(0, 5), (1, 5), (2, 6), (9, None)], "tid int, rank_taxid long")
    from strandlake.config import StatConfig

    got = taxstats.summary(df, at, StatConfig(minreads=2)).first().asDict()
    assert got == {"alns": 6, "reads": 3, "passed_reads": 2, "passed_alns": 3, "passed_refs": 2, "passed_taxa": 1}
