"""Narrow storage types, and what they save."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowloom.functions import name_of, value_of
from rowloom.operators.aggregate import column_bounds
from rowloom.operators.select import with_derived

# Exclusive bounds of the integer types and of float32.
INTEGER_BOUNDS = (
    (T.ByteType(), -128, 127),
    (T.ShortType(), -32768, 32767),
    (T.IntegerType(), -2147483648, 2147483647),
)
FLOAT_LIMIT = 3.4028234663852886e38

# Bytes per value; anything else counts as an 8-byte reference.
WIDTHS = {"tinyint": 1, "boolean": 1, "smallint": 2, "int": 4, "float": 4}

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATS = (T.FloatType, T.DoubleType, T.BooleanType)


def _narrowest(kind: T.DataType, low, high) -> T.DataType:
    if isinstance(kind, INTEGERS):
        if low is None:
            return kind
        for smaller, under, over in INTEGER_BOUNDS:
            if low > under and high < over:
                return smaller
        return T.LongType()
    if low is not None and -FLOAT_LIMIT < float(low) and float(high) < FLOAT_LIMIT:
        return T.FloatType()
    return T.DoubleType()


def narrow_types(
    df: DataFrame, floats: bool = True, bounds: Mapping[str, object] | None = None
) -> dict[str, T.DataType]:
    """Smallest type for every integer, float and boolean column. Runs one job.

    The bounds are exclusive, so a maximum of 127 needs a short. Strings and
    decimals are left alone, and an all-missing float column stays double.
    Without ``floats`` only integers are looked at. ``bounds`` are known
    ``min_<c>`` and ``max_<c>``, from file statistics for example; no job runs
    then.
    """
    looked_at = INTEGERS + FLOATS if floats else INTEGERS
    kinds = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, looked_at)}
    if not kinds:
        return {}
    row = column_bounds(df, kinds).head() if bounds is None else bounds
    return {n: _narrowest(k, row[f"min_{n}"], row[f"max_{n}"]) for n, k in kinds.items()}


def narrow(df: DataFrame, types: Mapping[str, T.DataType] | None = None) -> DataFrame:
    """Cast columns to narrow storage types.

    For writing tables only: derived values are computed on widened columns.
    """
    types = narrow_types(df) if types is None else types
    return with_derived(
        df, {c: f"CAST({name_of(c)} AS {t.simpleString()})" for c, t in types.items()}
    )


def row_bytes(schema: T.StructType) -> int:
    return sum(WIDTHS.get(f.dataType.simpleString(), 8) for f in schema.fields)


def memory_report(df: DataFrame, narrowed: DataFrame, label: str) -> DataFrame:
    """One row: bytes before and after narrowing and the percentage saved."""
    before, after = row_bytes(df.schema), row_bytes(narrowed.schema)
    saved = 100.0 * (before - after) / before
    return df.selectExpr(
        f"{value_of(label)} AS label",
        f"count(1) * {before} AS before_bytes",
        f"count(1) * {after} AS after_bytes",
        f"{value_of(saved)} AS saved_percent",
    )
