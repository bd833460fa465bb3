"""The driver's contract: every query runs on the smallest tables, and SQL agrees where it exists."""

import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["flagship", "window_manifest", "entity_summary", "calibration_vs_oracle", "leakage_stats", "roc_auc"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def _norm(v):
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ran = con.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    want = sorted(tuple(_norm(row[names.index(c)]) for c in cols) for row in ran.fetchall())
    assert sorted(tuple(_norm(v) for v in row) for row in df.select(*cols).collect()) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
