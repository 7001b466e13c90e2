"""Bounds of columns from the statistics in parquet footers."""

from __future__ import annotations

from collections.abc import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from rowloom.functions import require_columns
from rowloom.operators.aggregate import column_bounds

# The newer file source takes minimum, maximum and count from the footers.
SETTINGS = {
    "spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text",
    "spark.sql.parquet.aggregatePushdown": "true",
}


def footer_bounds(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """``min_<c>`` and ``max_<c>`` of numeric columns, in one row, without reading a row.

    The same row as `column_bounds` of the table, but only the footers are
    read. It runs in a session of its own, whose settings allow that; the
    caller's stay. Spark scans the columns where a filter or a type rules
    out the footers, and fails where a file lacks these statistics, for one
    because a column has no value in it; see `stored_bounds`.
    """
    columns = list(columns)
    own = spark.newSession()
    for name, value in SETTINGS.items():
        own.conf.set(name, value)
    df = own.read.parquet(path)
    require_columns(df, columns)
    return column_bounds(df, columns)


def stored_bounds(spark: SparkSession, path: str, columns: Iterable[str]) -> dict:
    """The row of `footer_bounds`, or of a scan where files lack statistics. Runs a job."""
    columns = list(columns)
    try:
        row = footer_bounds(spark, path, columns).head()
    except (PySparkException, Py4JJavaError) as e:
        if "aggregatePushdown" not in str(e):
            raise
        row = column_bounds(spark.read.parquet(path), columns).head()
    return row.asDict()
