"""Every registered query against its oracle SQL, and the driver contract."""

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from check import difference, oracle_over
from conftest import plan_of
from workbench import network_queries

SF_DIR = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def oracle():
    return oracle_over(SF_DIR)


@needs_data
@pytest.mark.parametrize("name", list(registered.queries()))
def test_query(spark, oracle, name):
    assert difference(spark, oracle, SF_DIR, name) is None


@needs_data
def test_entry(spark):
    rows = registered.entry(spark)
    # One meter, nine complete months.
    assert {r.id for r in rows.select("id").distinct().collect()} == {"all"}
    assert rows.select("month").distinct().count() == 9


def test_oracles_belong_to_queries():
    assert set(registered.oracle_sql()) <= set(registered.queries())


@pytest.mark.parametrize("name", ["set2_train_valid_split", "set2_split_of_copies"])
def test_more_rows_are_dealt_to_more_tasks(spark, tmp_path, monkeypatch, name):
    """No task gets more than its share of a longer table, and the result stays that of the SQL."""
    monkeypatch.setattr(network_queries, "ROWS_PER_TASK", 1000, raising=False)
    n = 20_000
    number = F.when(F.col("id") % 11 == 0, F.lit(1)).otherwise(F.col("id") % 7 + 1).cast("int")
    lines = spark.range(0, n, 1, 4).select(F.col("id").alias("l_orderkey"), number.alias("l_linenumber"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    result = registered.queries()[name](spark, str(tmp_path))
    # One query is dealt out in its plan, the other wrote a file in each task.
    dealt = re.findall(r"RoundRobinPartitioning\((\d+)\)", plan_of(result))
    assert n / int(dealt[0] if dealt else len(result.inputFiles())) <= 1000
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(map(tuple, result.collect())) == sorted(oracle.execute(registered.oracle_sql()[name]).fetchall())
