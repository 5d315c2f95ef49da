import __spark_entry__ as entry
import corpus_pipeline


def test_runs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len(corpus_pipeline.STAGES) == 5 and 0 < len(rows) < docs.count() and len({r["doc_id"] for r in rows}) == len(rows)
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert out.columns == docs.columns


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, extra columns with clashing names; empty tables."""
    long = " ".join(f"word{i * 7919 % 30011}" for i in range(30_000))
    plain = "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest today"
    rows = [(1, plain, "en", "a", 5, "x", 1), (1, plain, "en", "a", 5, "x", 1), (2, plain + " again", "en", None, None, "x", 1), (3, None, None, None, None, None, None), (4, "", "en", "a", 0, "x", 1), (5, long, None, "a", 9, "x", 1), (None, "some words without any id here", "en", "a", 3, "x", 1), (7, "12 34", "en", "a", 5, "x", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, id string, component int"
    docs = spark.createDataFrame(rows, kinds)
    spark.createDataFrame([(9, "a benchmark item that no document holds at all in any of its many words so nothing should go away here"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        out = stage(spark, docs, str(tmp_path))
        assert name == "bpe" or out.columns == docs.columns
        got = out.collect()
        ids = sorted(str(r["doc_id"]) for r in got)
        want = {"language_id": ["1", "1", "2", "5", "None"], "minhash_near_dedup": ["1", "1", "3", "4", "5", "7", "None"]}.get(name, sorted(str(r[0]) for r in rows))
        assert ids == want, name
        if name == "substring_dedup":
            assert {r["doc_id"]: r["text"] for r in got}[2].endswith("again") and len(next(r["text"] for r in got if r["doc_id"] == 5)) == len(long)
