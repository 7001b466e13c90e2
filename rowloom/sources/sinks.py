"""Writing feature tables so that later reads can skip data."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import name_of
from rowloom.session import remove_folder, work_folder, written


def write_features(
    df: DataFrame,
    path: str,
    key: str,
    files: int | None = None,
    mode: str = "overwrite",
    lookups: Mapping[str, int] | None = None,
) -> None:
    """Write parquet files holding disjoint, sorted key ranges.

    A lookup of some keys then reads only the row groups whose range has them.
    ``lookups`` names other columns by which rows are looked up, ids that the
    rows aren't sorted by, and about how many different values a row group
    has: each gets a Bloom filter, so that row groups without the wanted ids
    are skipped. A filter takes some 1.2 bytes a value.
    Finding the ranges reads the rows once before they are written, so they go
    to the shared work folder in between instead of being joined twice.
    """
    spark, by = df.sparkSession, name_of(key)
    folder = work_folder(spark, "features")
    kept = written(df, "features", folder)
    ranged = kept.repartitionByRange(files, by) if files else kept.repartitionByRange(by)
    writer = ranged.sortWithinPartitions(by).write.mode(mode)
    for column, values in (lookups or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer = writer.option(f"parquet.bloom.filter.expected.ndv#{column}", str(values))
    writer.parquet(path)
    remove_folder(spark, folder)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_bucketed(
    df: DataFrame, table: str, key: str, buckets: int, mode: str = "overwrite", report: int = 20
) -> DataFrame:
    """Save as a table bucketed and sorted by the key; returns its most frequent keys.

    Tables with the same number of buckets are grouped and joined on the key
    without a shuffle, which pays off when features are rebuilt regularly. A
    bucket is read by one task and cannot be split: look at the report (key,
    row_count, share of an average bucket), and keep a table whose keys fill
    buckets of their own as plain parquet, whose rows combine map-side.
    """
    (
        df.repartition(buckets, name_of(key))
        .write.mode(mode)
        .bucketBy(buckets, key)
        .sortBy(key)
        .saveAsTable(table)
    )
    rows = df.sparkSession.table(table)
    total = rows.count()
    return (
        rows.groupBy(name_of(key))
        .agg(F.expr("count(1) AS row_count"))
        .selectExpr(name_of(key), "row_count", f"row_count * {buckets}D / {max(1, total)}D AS bucket_share")
        .orderBy(F.desc("row_count"), name_of(key))
        .limit(report)
    )
