"""Queries with SQL against DuckDB on the smallest tables; joins on hot keys are split."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.llm import queries
from tidelog.llm.common import join_hot, written

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
    found, want = queries.queries()[name](spark, DIR), db.sql(queries.oracle_sql()[name])
    columns = sorted(found.columns)
    assert sorted(want.columns) == columns
    rows = sorted(str(tuple(r[c] for c in columns)) for r in found.collect())
    assert rows and rows == sorted(str(tuple(dict(zip(want.columns, r))[c] for c in columns)) for r in want.fetchall())


def test_hot_keys_are_split(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = written(spark.range(0, 200_000, 1, 16).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 5000).alias("a"), "id"))
        joined = join_hot(rows, rows.groupBy("a").agg(F.min("id").alias("least")), ["a"])
        assert joined.columns == ["a", "id", "least"]
        total = joined.agg(F.sum("id"), F.sum("least"))
        least = {}
        for i in range(200_000):
            least.setdefault(7 if i % 3 == 0 else i % 5000, i)
        assert tuple(total.collect()[0]) == (sum(range(200_000)), sum(least[7 if i % 3 == 0 else i % 5000] for i in range(200_000)))
        assert "skew=true" in total._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
