"""Tables, views, inserts, explanations, listings and the time limit."""

import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.functions import udf

from loomsheet.model import Project
from loomsheet.operators import statements as S


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    S.create_table_as(df, "made_here", path=str(tmp_path / "made_here"))
    S.insert_into(df, "made_here")
    assert spark.table("made_here").count() == 4
    assert [r[0] for r in S.show(spark, "columns", "made_here").collect()] == ["k", "v"]
    S.rename_table(spark, "made_here", "made_there")
    assert "made_there" in [r.tableName for r in S.show(spark, "tables").collect()]
    S.drop_table(spark, "made_there")
    S.drop_table(spark, "made_there")
    assert "made_there" not in [r.tableName for r in S.show(spark, "tables").collect()]


def test_views_and_plans(spark):
    df = spark.range(3)
    S.create_view(df, "three")
    with pytest.raises(Exception, match="already exists"):
        S.create_view(df, "three")
    S.create_view(df, "three", replace=True)
    S.create_table_as(df, "three", temporary=True)
    assert "Range" in S.explained(spark.table("three"))
    assert S.drop_view(spark, "three") and S.show(spark, "schemas").count() >= 1 and S.show(spark, "functions").count() > 100


def test_time_limit(spark):
    slow = spark.range(8).repartition(8).select(udf(lambda x: time.sleep(30) or x, "long")("id"))
    began = time.time()
    with pytest.raises(Exception), S.time_limit(spark, Project("p", max_report_seconds=2), "slow"):  # noqa: B017, PT011
        slow.collect()
    assert time.time() - began < 25
    with S.time_limit(spark, Project("p", max_report_seconds=0)):
        assert spark.range(5).agg(F.sum("id")).first()[0] == 10
