"""A few registered queries against DuckDB; the driver compares them all."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["aln_view", "cov_bins", "refstats", "taxstats_genus", "alnfilt_strict", "alnfilt_random", "bamstats", "refstats_by_file"])
def test_same_rows(spark, name):
    c = duckdb.connect()
    for t in ("region", "nation", "supplier", "part", "lineitem", "documents"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    want = c.execute(entry.oracle_sql()[name]).df()[list(got.columns)]
    key = lambda df: sorted(tuple("-" if pd.isna(x) else round(float(x), 6) if not isinstance(x, str) else x for x in r) for r in df.astype(object).itertuples(index=False, name=None))
    assert key(got) == key(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    missing = {k for k in entry.queries() if not k.startswith("op") and k != "pipeline"} - set(entry.oracle_sql())
    assert missing == set()
