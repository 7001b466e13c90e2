"""Quantiles and distinct counts from sketches that are stored and merged."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import name_of, require_columns, value_of

if TYPE_CHECKING:
    from rowloom.sources.batches import BatchStore

QUANTILE_K = 4_000  # size of a quantile sketch
GROUPS = 32  # groups of map tasks that make a quantile sketch each
DISTINCT_LOG_K = 12  # a distinct sketch has 2 ** 12 slots


def rank_error(k: int = QUANTILE_K) -> float:
    """How far off, as a share of all values, the rank of an answer is in 99 of 100 cases."""
    return 2.296 / k**0.9021


def distinct_error(log_k: int = DISTINCT_LOG_K) -> float:
    """The standard error of a distinct count, relative to it."""
    return 1.04 / 2 ** (log_k / 2)


def quantile_sketches(df: DataFrame, columns: Sequence[str], k: int = QUANTILE_K) -> DataFrame:
    """(column, n, sketch): a sketch of the non-missing values for each column and group of tasks.

    Rows of this table, of several inputs too, can be put together and merged.
    Columns without a value have no row.
    """
    require_columns(df, columns)
    made = [
        e
        for i, c in enumerate(columns)
        for e in (
            f"count({name_of(c)}) AS n{i}",
            f"kll_sketch_agg_double(CAST({name_of(c)} AS DOUBLE), {k}) AS s{i}",
        )
    ]
    grouped = df.groupBy(F.expr(f"pmod(spark_partition_id(), {GROUPS})").alias("tasks"))
    rows = ", ".join(f"struct({value_of(c)} AS column, n{i} AS n, s{i} AS sketch)" for i, c in enumerate(columns))
    return grouped.agg(*[F.expr(e) for e in made]).selectExpr(f"inline(array({rows}))").where("n > 0")


def merge_quantiles(sketches: DataFrame, k: int = QUANTILE_K) -> DataFrame:
    """(column, n, sketch): one row for each column."""
    return sketches.groupBy("column").agg(F.expr("sum(n) AS n"), F.expr(f"kll_merge_agg_double(sketch, {k}) AS sketch"))


def quantiles(sketches: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """(column, n, values): a value near each fraction of the ranks, itself one of the column's."""
    listed = ", ".join(value_of(float(f)) for f in fractions)
    return sketches.selectExpr("column", "n", f"kll_sketch_get_quantile_double(sketch, array({listed})) AS values")


def approx_medians(df: DataFrame, columns: Sequence[str], k: int = QUANTILE_K) -> dict[str, float]:
    """A value near the median of every column with a value: one pass, merged in two steps.

    The rank of the answer is off by `rank_error` of all values in 99 of 100
    cases; `exact_medians` needs two passes or more.
    """
    if not columns:
        return {}
    merged = merge_quantiles(quantile_sketches(df, columns, k), k)
    return {r["column"]: r["values"][0] for r in quantiles(merged, [0.5]).collect()}


class DistinctState:
    """Distinct counts per key, kept as sketches to which batches are added."""

    def __init__(self, store: BatchStore, keys: Sequence[str], log_k: int = DISTINCT_LOG_K):
        self.store, self.keys, self.log_k = store, list(keys), log_k

    def add(self, batch: str, rows: DataFrame, columns: Iterable[str]) -> bool:
        """Sketch the values of some columns; False if the batch was added before."""
        columns = list(columns)
        require_columns(rows, [*self.keys, *columns])
        whole = (T.IntegerType, T.LongType, T.StringType, T.BinaryType)
        made = []
        for c in columns:
            value = name_of(c)
            if not isinstance(rows.schema[c].dataType, whole):
                value = f"CAST({value} AS STRING)"
            made.append(F.expr(f"hll_sketch_agg({value}, {self.log_k}) AS {name_of(c)}"))
        sketches = rows.groupBy(*[name_of(k) for k in self.keys]).agg(*made)
        return self.store.add(batch, {"sketches": sketches})

    def merged(self) -> DataFrame:
        """A row of sketches for each key."""
        parts = self.store.read("sketches")
        columns = [c for c in parts.columns if c not in self.keys]
        return parts.groupBy(*[name_of(k) for k in self.keys]).agg(
            *[F.expr(f"hll_union_agg({name_of(c)}) AS {name_of(c)}") for c in columns]
        )

    def counts(self) -> DataFrame:
        """The keys and, under the name of each column, its distinct values; see `distinct_error`."""
        merged = self.merged()
        return merged.selectExpr(
            *[name_of(k) for k in self.keys],
            *[f"coalesce(hll_sketch_estimate({name_of(c)}), 0L) AS {name_of(c)}" for c in merged.columns if c not in self.keys],
        )

    def compact(self, batch: str) -> bool:
        """Merge all live batches into one, under a new name."""
        return self.store.add(batch, {"sketches": self.merged()}, replaces=self.store.live())
