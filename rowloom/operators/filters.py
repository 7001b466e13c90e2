"""Row filters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowloom.functions import flag, name_of, unless_equal, value_of


def drop_category(df: DataFrame, column: str, value: str) -> DataFrame:
    """Drop rows with a category; rows where it is missing stay."""
    return df.where(unless_equal(name_of(column), value))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """Rows of one key; the comparison reaches the scan."""
    return df.where(f"{name_of(key)} = {value_of(value)}")


# A text of at most ten digits that may be a whole number; anything that isn't printable may surround it.
NUMBER = r"'^[^!-~]*[+-]?0*[0-9]{1,10}[^!-~]*$'"


def check_ids(
    requests: DataFrame, raw: str, key: str, low: int, high: int
) -> tuple[DataFrame, DataFrame]:
    """Split raw text ids into (accepted, rejected).

    Accepted ids are whole numbers inside the range and appear as ``key``;
    everything else keeps its text in the second DataFrame. A cast that fails
    costs as much as a hundred that don't, so texts that can't be numbers are
    told by a pattern first.
    """
    text = f"CAST({name_of(raw)} AS STRING)"
    number = f"CASE WHEN {text} RLIKE {NUMBER} THEN try_cast({text} AS INT) END"
    parsed = requests.selectExpr("*", f"{number} AS {name_of(key)}")
    valid = flag(f"{name_of(key)} BETWEEN {value_of(low)} AND {value_of(high)}")
    return parsed.where(valid), parsed.where(f"NOT {valid}").drop(key)
