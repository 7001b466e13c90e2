"""Per-key aggregates.

Every aggregate here is algebraic, so Spark combines rows map-side before the
shuffle and a key that holds a large part of the table reaches the reducer as
one small buffer per map task.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import name_of, value_of
from rowloom.operators.joins import lookup_join


def aggregate_by(df: DataFrame, key: str, measures: Mapping[str, str]) -> DataFrame:
    """One row per non-missing key with the given named aggregates."""
    return (
        df.where(f"{name_of(key)} IS NOT NULL")
        .groupBy(name_of(key))
        .agg(*[F.expr(f"{e} AS {name_of(name)}") for name, e in measures.items()])
    )


def count_of(column: str) -> str:
    """Number of non-missing values."""
    return f"count({name_of(column)})"


def distinct_of(column: str) -> str:
    """Number of distinct non-missing values."""
    return f"count(DISTINCT {name_of(column)})"


def sum_of(df: DataFrame, column: str) -> str:
    """Sum that is 0, not NULL, when every value is missing."""
    floating = isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType))
    return f"coalesce(sum({name_of(column)}), {'0.0D' if floating else '0'})"


def mean_of(df: DataFrame, column: str) -> str:
    """Mean of the non-missing values as double.

    Decimals are summed exactly and divided once, which does not depend on
    the order of the rows.
    """
    kind, n = df.schema[column].dataType, name_of(column)
    if isinstance(kind, T.DecimalType):
        return f"try_divide(CAST(sum({n}) AS DOUBLE), count({n}))"
    return f"avg(CAST({n} AS INT))" if isinstance(kind, T.BooleanType) else f"avg({n})"


def rows_with(column: str, value: str) -> str:
    return f"count(CASE WHEN {name_of(column)} = {value_of(value)} THEN 1 END)"


def share_of(column: str, value: str) -> str:
    """Fraction of all rows of the group, missing ones included, with a value.

    Counts instead of an average of zeros and ones: all shares of a group use
    one common row count, which halves the aggregation buffer.
    """
    return f"{rows_with(column, value)} / count(1)"


def distinct_from_categories(column: str, values: Iterable[str]) -> str:
    """Number of distinct values when all possible values are known.

    Equals ``distinct_of`` but needs no second shuffle. The counts are the
    same expressions ``share_of`` uses, so they are computed once.
    """
    seen = [f"CAST({rows_with(column, v)} > 0 AS BIGINT)" for v in values]
    return " + ".join(["0L", *seen])


def attach_group_aggregates(df: DataFrame, key: str, measures: Mapping[str, str]) -> DataFrame:
    """Give every row its group's aggregates; rows with no key get NULLs. Runs a job.

    A window over the key would pull a whole group into one task. Grouping
    and joining back keeps the group spread.
    """
    return lookup_join(df, aggregate_by(df, key, measures), key)


def column_bounds(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """One row with ``min_<c>`` and ``max_<c>`` for every column, in one pass."""
    columns = list(columns)
    return df.selectExpr(
        *[f"{f}({name_of(c)}) AS {name_of(f'{f}_{c}')}" for f in ("min", "max") for c in columns]
    )


def shape_report(df: DataFrame, label: str) -> DataFrame:
    """One row: label, number of rows, number of columns."""
    return df.selectExpr("count(1) AS row_count").selectExpr(
        f"{value_of(label)} AS label", "row_count", f"{len(df.columns)}L AS column_count"
    )
