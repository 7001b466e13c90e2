"""Missing-value rules. Missing is NULL everywhere; NaN is turned into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowloom.functions.columns import name_of, value_of

INFINITIES = f"{value_of(float('inf'))}, {value_of(float('-inf'))}"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL for NaN in every float and double column, in one projection."""
    out = []
    for f in df.schema.fields:
        n = name_of(f.name)
        floating = isinstance(f.dataType, (T.FloatType, T.DoubleType))
        out.append(f"CASE WHEN NOT isnan({n}) THEN {n} END AS {n}" if floating else n)
    return df.selectExpr(*out)


def zero_fill(e: str) -> str:
    """0 for NULL and NaN; infinities are kept."""
    return f"coalesce(nanvl(CAST({e} AS DOUBLE), NULL), 0.0D)"


def fill_missing(e: str, value) -> str:
    return f"coalesce({e}, {value_of(value)})"


def null_if(e: str, sentinel) -> str:
    """NULL where the value equals a sentinel."""
    return f"CASE WHEN {e} <> {value_of(sentinel)} THEN {e} END"


def null_above(e: str, limit) -> str:
    """NULL where the value is above a limit."""
    return f"CASE WHEN {e} <= {value_of(limit)} THEN {e} END"


def inf_to(e: str, value: float) -> str:
    """Replace both infinities by a constant."""
    return f"CASE WHEN {e} IN ({INFINITIES}) THEN {value_of(value)} ELSE {e} END"


def flag(condition: str) -> str:
    """A comparison that is false, not NULL, when an operand is missing."""
    return f"coalesce({condition}, FALSE)"


def unless_equal(e: str, value) -> str:
    """Filter condition: not equal to a value, missing rows kept."""
    return f"NOT ({e} <=> {value_of(value)})"
