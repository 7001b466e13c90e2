"""Projection and schema operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from rowloom.functions import name_of, require_columns, require_unique


def select_named(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the named columns in the given order; report all missing names."""
    require_columns(df, names)
    return df.selectExpr(*[name_of(n) for n in names])


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    gone = set(names)
    return df.selectExpr(*[name_of(c) for c in df.columns if c not in gone])


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    out = [names.get(c, c) for c in df.columns]
    require_unique(out)
    return df.selectExpr(*[f"{name_of(c)} AS {name_of(o)}" for c, o in zip(df.columns, out)])


def prefix_columns(df: DataFrame, prefix: str, key: str) -> DataFrame:
    """Put ``<prefix>_`` before every column name but the key."""
    return rename_columns(df, {c: f"{prefix}_{c}" for c in df.columns if c != key})


def with_derived(df: DataFrame, derived: Mapping[str, str]) -> DataFrame:
    """Replace or append columns in one projection, keeping the others."""
    named = {c: f"{e} AS {name_of(c)}" for c, e in derived.items()}
    return df.selectExpr(
        *[named.get(c, name_of(c)) for c in df.columns],
        *[e for c, e in named.items() if c not in df.columns],
    )


def cast_to_category(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Turn numeric codes into strings so that they are encoded as categories."""
    return with_derived(df, {n: f"CAST({name_of(n)} AS STRING)" for n in names})


def split_label(df: DataFrame, key: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Features without the label, and (key, label)."""
    return drop_columns(df, [label]), select_named(df, [key, label])


def peek(df: DataFrame, key: str, rows: int = 2) -> DataFrame:
    """The first rows in the order of a key."""
    return df.orderBy(name_of(key)).limit(rows)
