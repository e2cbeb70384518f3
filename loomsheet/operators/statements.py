"""Statements beside queries: tables, views, inserts, explanations and listings, and a time limit for a report."""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from loomsheet.model import Project


def _quoted(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def create_table_as(df: DataFrame, name: str, temporary: bool = False, path: str | None = None) -> None:
    """A table with the rows of ``df``; a temporary one is a view, evaluated when it is read."""
    if temporary:
        df.createOrReplaceTempView(name)
        return
    writer = df.write.mode("errorifexists").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def create_view(df: DataFrame, name: str, replace: bool = False) -> None:
    (df.createOrReplaceTempView if replace else df.createTempView)(name)


def drop_view(spark: SparkSession, name: str) -> bool:
    return spark.catalog.dropTempView(name)


def drop_table(spark: SparkSession, name: str, if_exists: bool = True) -> None:
    spark.sql(f"DROP TABLE {'IF EXISTS ' if if_exists else ''}{_quoted(name)}")


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {_quoted(old)} RENAME TO {_quoted(new)}")


def insert_into(df: DataFrame, name: str, overwrite: bool = False) -> None:
    """By position, as SQL's INSERT does."""
    df.write.insertInto(name, overwrite)


def explained(df: DataFrame, mode: str = "formatted") -> str:
    """The plan as text: simple, extended, codegen, cost or formatted."""
    jvm = df.sparkSession._jvm
    return df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


_SHOWN = {
    "catalogs": "SHOW CATALOGS", "schemas": "SHOW SCHEMAS", "tables": "SHOW TABLES", "views": "SHOW VIEWS",
    "functions": "SHOW FUNCTIONS", "columns": "SHOW COLUMNS IN {}", "partitions": "SHOW PARTITIONS {}",
}


def show(spark: SparkSession, what: str, name: str | None = None) -> DataFrame:
    return spark.sql(_SHOWN[what].format(_quoted(name) if name else ""))


@contextmanager
def time_limit(spark: SparkSession, project: Project, group: str = "report"):
    """Cancel the Spark jobs of this block once the project's time limit is over; no limit where it is zero or less."""
    sc = spark.sparkContext
    sc.setJobGroup(group, f"report of {project.name}", interruptOnCancel=True)
    timer = threading.Timer(project.max_report_seconds, sc.cancelJobGroup, [group]) if project.max_report_seconds > 0 else None
    if timer:
        timer.daemon = True
        timer.start()
    try:
        yield
    finally:
        if timer:
            timer.cancel()
        sc.setLocalProperty("spark.jobGroup.id", None)
