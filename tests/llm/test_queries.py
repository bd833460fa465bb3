"""The registered queries on the smallest tables, against SQL where it can say them, and the pipeline against its stages."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from winaudit.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ran = con.execute(queries.ORACLES[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    want = sorted(str([row[names.index(c)] for c in cols]) for row in ran.fetchall())
    assert sorted(str(list(r)) for r in df.select(*cols).collect()) == want


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    extra = docs.limit(5).withColumns({"doc_id": F.lit(None).cast("long"), "text": F.lit(None).cast("string")})
    docs = docs.unionAll(extra)
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out = out.cache()
        sizes.append(out.count())
        docs = out
    assert sizes[1] <= sizes[0] and sizes[2] <= sizes[1] and sizes[3] <= sizes[2] and sizes[5] == sizes[4]
    assert docs.where("not round_trip").count() == 0


def test_stages_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
