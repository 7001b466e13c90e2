"""One-hot encoding as (index, value) vectors, for any number of categories.

A wide table has a plan column for each category and the categories pass
through the driver. Here they are rows of a table on the cluster, the index
comes from a join, and the plan does not know how many there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import name_of, require_columns
from rowloom.operators.select import select_named
from rowloom.session import remove_folder, work_folder, written

ID_BITS = 33  # of the row number within a partition, in Spark's increasing ids


def category_index(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, category, index): numbers from 0 in the order of column and category. Runs jobs.

    The distinct values are sorted by range and numbered within each range;
    one row for each range, its size, is all that reaches the driver.
    """
    require_columns(df, columns)
    spark = df.sparkSession
    place = work_folder(spark, "categories")
    pairs = (
        select_named(df, columns)
        .unpivot([], list(columns), "column", "category")
        .where("category IS NOT NULL")
        .distinct()
        .repartitionByRange("column", "category")
        .sortWithinPartitions("column", "category")
        .withColumn("id", F.monotonically_increasing_id())
    )
    rows = written(pairs, "pairs", f"{place}/pairs")
    sizes = rows.groupBy(F.expr(f"shiftright(id, {ID_BITS})").alias("range")).count().collect()
    starts, total = [], 0
    for r in sorted(sizes, key=lambda r: r["range"]):
        starts.append((r["range"], total))
        total += r["count"]
    first = spark.createDataFrame(starts, "range long, start long")
    numbered = rows.withColumn("range", F.expr(f"shiftright(id, {ID_BITS})")).join(first, "range")
    out = written(
        numbered.selectExpr("column", "category", f"start + (id & {(1 << ID_BITS) - 1}L) AS index"), "category-index"
    )
    remove_folder(spark, place)
    return out


def one_hot_long(df: DataFrame, key: str, columns: Sequence[str], index: DataFrame) -> DataFrame:
    """(key, index): a row for each text value that the index knows.

    Values it doesn't know and missing ones have no row. The index is a plain
    side of the join with one row per category, so adaptive execution splits
    the rows of a hot category.
    """
    long = select_named(df, [key, *columns]).unpivot([key], list(columns), "column", "category")
    return long.join(index, ["column", "category"]).selectExpr(name_of(key), "index")


def one_hot_sparse(df: DataFrame, key: str, columns: Sequence[str], index: DataFrame) -> DataFrame:
    """(key, vector): for every row an array of (index, value), in the order of the index.

    The key must tell the rows apart. Rows of which no value is known have an
    empty vector; a missing key is a key like others.
    """
    require_columns(df, [key, *columns])
    by = name_of(key)
    found = (
        one_hot_long(df, key, columns, index)
        .groupBy(by)
        .agg(F.expr("sort_array(collect_list(struct(index, 1.0D AS value))) AS vector"))
        .withColumnRenamed(key, "its_key")
    )
    rows = select_named(df, [key])
    empty = "CAST(array() AS ARRAY<STRUCT<index: BIGINT, value: DOUBLE>>)"
    return rows.join(found, rows[key].eqNullSafe(found["its_key"]), "left").selectExpr(
        by, f"coalesce(vector, {empty}) AS vector"
    )


def sparse_dot(vector: str, weights: str) -> str:
    """The product of a vector and a map from index to weight; indexes without a weight count 0."""
    return f"aggregate({vector}, 0.0D, (a, x) -> a + x.value * coalesce({weights}[x.index], 0.0D))"
