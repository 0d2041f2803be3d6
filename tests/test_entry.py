"""Every registered query runs on the smallest tables, and those with SQL twins agree with them."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__
from quern.plans.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v) if abs(int(v)) > 2**53 else float(f"{int(v):.9g}")
    if isinstance(v, (float, np.floating)) or type(v).__name__ == "Decimal":
        return None if float(v) != float(v) else float(f"{float(v):.9g}")
    return str(v)


def table(df):
    return sorted(repr(tuple(plain(v) for v in r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def test_entry(spark, sf):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["lang", "split", "reason", "n"]
    assert sum(r["n"] for r in df.collect()) == 200


def test_registry_is_consistent():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert len(QUERIES) > 150


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, sql, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLE_SQL:
        assert len(got.columns) > 0
        return
    want = sql.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


def test_golden_funnel(spark):
    base = "/root/testdata/sf0.01"
    if not os.path.isdir(base):
        pytest.skip("no test tables")
    counts = {r["reason"]: r["n"] for r in QUERIES["reason_by_lang_rollup"](spark, base).where("lang IS NULL AND reason IS NOT NULL").collect()}
    by_reason: dict = {}
    for r in QUERIES["dedup_funnel"](spark, base).collect():
        by_reason[r["reason"]] = by_reason.get(r["reason"], 0) + r["n"]
    assert by_reason == {"length": 36, "benchmark_exact": 26, "exact_document": 68, "kept": 870}
    assert not counts
