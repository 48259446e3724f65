"""Queries against their SQL on the smallest tables, where these are there; every query has a docstring."""

import glob
import math
import os

import pytest

FOLDER = "/root/testdata/sf0.001"
CHECKED = ("score_groups", "leaderboard_by_language", "majority_vote", "fix_options_exact", "arxiv_links", "export_flat", "cost_report", "timing_stats")


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def test_docstrings():
    import __spark_entry__

    assert all(q.__doc__ for q in __spark_entry__.queries().values())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, name):
    import duckdb

    import __spark_entry__

    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = __spark_entry__.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = con.execute(__spark_entry__.oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(got.description)}
    want = sorted(repr([_plain(r[at[n]]) for n in names]) for r in got.fetchall())
    assert sorted(repr([_plain(r[n]) for n in names]) for r in df.collect()) == want
