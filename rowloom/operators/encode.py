"""Category discovery and one-hot encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import (
    name_of,
    require_columns,
    string_columns,
    told_apart,
    value_of,
)
from rowloom.operators.aggregate import aggregate_by
from rowloom.operators.joins import lookup_join
from rowloom.operators.select import select_named

Categories = dict[str, list[str]]


def _long_categories(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, category) of all non-missing values, from one scan.

    Rows are made distinct before they become one row for each column, so that
    a row of the table is hashed once, not once a column.
    """
    return (
        select_named(df, columns)
        .distinct()
        .unpivot([], list(columns), "column", "category")
        .where("category IS NOT NULL")
    )


def fit_categories_of(
    tables: Mapping[str, tuple[DataFrame, Sequence[str]]],
    max_categories: int | None = None,
) -> dict[str, Categories]:
    """Sorted categories of string columns of several tables. Runs one job.

    Values are made distinct on the cluster; only the distinct ones reach the
    driver, as each becomes a column of the plan. It is the caller who names
    the columns that become wide. With ``max_categories`` a column that has
    more is an error; ``category_share_long`` keeps such shares as rows.
    """
    found: dict[str, Categories] = {
        t: {c: [] for c in columns} for t, (_, columns) in tables.items()
    }
    parts = [
        _long_categories(df, columns).selectExpr(
            f"{value_of(t)} AS table", "column", "category"
        )
        for t, (df, columns) in tables.items()
        if columns
    ]
    if not parts:
        return found
    pairs = reduce(DataFrame.unionAll, parts).distinct()
    if max_categories is not None:
        counts = pairs.groupBy("table", "column").count().where(f"count > {max_categories}")
        wide = sorted(f"{r['table']}.{r['column']}" for r in counts.collect())
        if wide:
            raise ValueError(f"more than {max_categories} categories in: {', '.join(wide)}")
    rows = pairs.collect()
    for r in rows:
        found[r["table"]][r["column"]].append(r["category"])
    for columns in found.values():
        for values in columns.values():
            values.sort()
    return found


def fit_categories(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_categories: int | None = None,
) -> Categories:
    """Sorted categories of the string columns of one table. Runs one job."""
    names = string_columns(df) if columns is None else list(columns)
    return fit_categories_of({"": (df, names)}, max_categories)[""]


def indicator(column: str, value: str) -> str:
    """1 where the column has the value, else 0; missing counts as 0."""
    return f"CASE WHEN {name_of(column)} = {value_of(value)} THEN 1 ELSE 0 END"


def one_hot(
    df: DataFrame, categories: Mapping[str, Sequence[str]], prefix: str | None = None
) -> DataFrame:
    """Replace string columns by 0/1 columns ``<column>_<category>``.

    With ``prefix`` the names are ``<prefix>_<category>``; two columns that
    share a category are then an error. Names that differ in case only get a
    number.

    Categories not seen when fitting become all zeros. Rows are encoded in
    place, so no join and no row order is involved.
    """
    require_columns(df, categories)
    kept = [c for c in df.columns if c not in categories]
    made = [
        (f"{c if prefix is None else prefix}_{v}", indicator(c, v))
        for c, values in categories.items()
        for v in values
    ]
    names = told_apart([*kept, *[name for name, _ in made]])[len(kept) :]
    made = [(name, e) for name, (_, e) in zip(names, made)]
    return df.selectExpr(
        *[name_of(c) for c in kept], *[f"{e} AS {name_of(name)}" for name, e in made]
    )


def category_share_long(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Category shares as rows (key, column, category, share).

    For columns with too many categories for a wide table: nothing is
    collected, and both groupings combine map-side. The number of rows of a key
    is written before it is joined, so that a key with very many categories is
    spread. Runs a job.
    """
    present = df.where(f"{name_of(key)} IS NOT NULL")
    totals = aggregate_by(present, key, {"rows_of_key": "count(1)"})
    counts = (
        select_named(present, [key, *columns])
        .unpivot([key], list(columns), "column", "category")
        .where("category IS NOT NULL")
        .groupBy(name_of(key), "column", "category")
        .agg(F.expr("count(1) AS rows_of_category"))
    )
    joined = lookup_join(counts, totals, key, "inner")
    return joined.selectExpr(
        name_of(key), "column", "category", "rows_of_category / rows_of_key AS share"
    )
