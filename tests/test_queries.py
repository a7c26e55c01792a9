"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
HEADLINE = ["km2_curve", "km5_stratified", "km8_best_cut", "km11_landmark", "cr1_incidence", "mt2_pool_dl", "mt5_adjust_bh", "mt7_leave_one_out", "ep5_family_columns", "ep11_semantics_grid", "ex12_survey", "ex23_batch", "cl15_change_log", "cl24_best_pairs", "ov4_groups", "ct1_sizes", "ct3_lost", "ct5_consistency", "ct6_sweep", "cx3_small_panel", "mt1_two_stage", "ex19_coverage", "au1_audit", "au2_content_hash", "ag3_kappa"]


def norm(v):
    return "~" if v is None else "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", HEADLINE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    mine = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    got = con.execute(entry.oracle_sql()[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    theirs = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in got.fetchall())
    assert mine == theirs


def test_entry_and_registry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) > 0 and "fdr" in rows[0].asDict()
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.basename(os.path.dirname(os.path.abspath(entry.__file__)))
