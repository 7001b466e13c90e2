"""Names, constants, and column lists taken from a DataFrame's schema."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def name_of(column: str) -> str:
    """A quoted column name; it may hold dots, spaces or slashes."""
    return "`" + column.replace("`", "``") + "`"


def value_of(value) -> str:
    """A constant as SQL text; floats keep every digit."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"double('{value!r}')"
    if isinstance(value, int):
        return f"{value}L" if abs(value) > 2_147_483_647 else str(value)
    raise TypeError(f"no SQL constant for {type(value).__name__}")


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Names of the string columns, in schema order."""
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def numeric_columns(
    df: DataFrame, exclude: Iterable[str] = (), booleans: bool = False
) -> list[str]:
    """Names of the numeric columns; booleans only when asked for."""
    kinds = (T.NumericType, T.BooleanType) if booleans else (T.NumericType,)
    skip = set(exclude)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, kinds) and f.name not in skip
    ]


def operand(df: DataFrame, column: str) -> str:
    """A column widened for arithmetic.

    Narrow storage types overflow (ANSI raises) or lose digits, so integers
    are computed as bigint and floats as double. Decimals stay exact.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        return f"CAST({name_of(column)} AS BIGINT)"
    if isinstance(kind, T.FloatType):
        return f"CAST({name_of(column)} AS DOUBLE)"
    return name_of(column)


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    """Raise with every missing name, not only the first."""
    have = set(df.columns)
    missing = [n for n in names if n not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def told_apart(names: Iterable[str]) -> list[str]:
    """The names, a number added to those that differ from an earlier one in case only.

    Spark resolves names without regard to case, so that it could not tell
    them apart. Names that are equal are an error.
    """
    names = list(names)
    require_unique(names)
    taken, out = set(), []
    for name in names:
        free, n = name, 1
        while free.lower() in taken:
            n += 1
            free = f"{name}_{n}"
        taken.add(free.lower())
        out.append(free)
    return out


def require_unique(names: Iterable[str]) -> None:
    """Raise when generated column names collide."""
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if twice:
        raise ValueError(f"column names generated more than once: {', '.join(twice)}")
