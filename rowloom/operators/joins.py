"""Equi joins onto an entity table, and skew-safe lookups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from rowloom.functions import name_of, value_of, zero_fill
from rowloom.session import written


def inner_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner equi join; a missing key matches nothing."""
    return left.join(right, key, "inner")


def left_join_zero_fill(entity: DataFrame, aggregates: DataFrame, key: str) -> DataFrame:
    """Left join per-key aggregates and replace what is missing by 0."""
    added = [c for c in aggregates.columns if c != key]
    return entity.join(aggregates, key, "left").selectExpr(
        *[name_of(c) for c in entity.columns],
        *[f"{zero_fill(name_of(c))} AS {name_of(c)}" for c in added],
    )


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join many rows to a table with one row per key, safe for hot keys. Runs a job.

    The right side, often an aggregate, is written to the work folder first.
    Then both sides are ordinary shuffles of one join, and adaptive execution
    splits the rows of a hot key over several tasks, however large its share.
    """
    return left.join(written(right, "lookup"), key, how)


def keep_requested(df: DataFrame, requests: DataFrame | Iterable, key: str) -> DataFrame:
    """Rows whose key is requested; see `Requested`."""
    return Requested(requests, key).keep(df)


class Requested:
    """The distinct requested ids, applied to many tables.

    A list given by the caller is a filter that reaches the scans. A DataFrame,
    of whatever size, is made distinct and written once, and semi-joined to
    each table; Spark picks the way from real sizes.
    """

    def __init__(self, requests: DataFrame | Iterable, key: str):
        self.key = key
        self.ids = self.literals = None
        if isinstance(requests, DataFrame):
            ids = requests.selectExpr(name_of(key)).where(f"{name_of(key)} IS NOT NULL")
            self.ids = written(ids.distinct(), "requested")
        else:
            self.literals = sorted({v for v in requests if v is not None})

    def keep(self, df: DataFrame) -> DataFrame:
        if self.ids is not None:
            return df.join(self.ids, self.key, "left_semi")
        listed = ", ".join(value_of(v) for v in self.literals)
        return df.where(f"{name_of(self.key)} IN ({listed})" if listed else "FALSE")


def unknown_requests(requests: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Requests whose key is not in the table (left anti join).

    The table is cut down to the requested ids first, so that a short list of
    requests does not shuffle the keys of the whole table.
    """
    known = keep_requested(df.selectExpr(name_of(key)), requests, key)
    return requests.join(known, key, "left_anti")
