"""The bundle of input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.functions import nan_to_null
from rowloom.operators.narrow import narrow, narrow_types
from rowloom.sources.csv import read_csv

# The input tables by name.
TABLES = (
    "application",
    "bureau",
    "bureau_balance",
    "previous_application",
    "POS_CASH_balance",
    "credit_card_balance",
    "installments_payments",
)

# Types that must not be guessed from the text: keys, and a status code whose
# values are partly digits.
DECLARED = {
    "SK_ID_CURR": "bigint",
    "SK_ID_BUREAU": "bigint",
    "SK_ID_PREV": "bigint",
    "STATUS": "string",
}


def load_tables(
    spark: SparkSession,
    folder: str,
    fmt: str = "parquet",
    types: dict[str, dict[str, str]] | None = None,
    names: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Read ``<folder>/<name>.<fmt>`` for every table of the bundle.

    ``names`` gives another file stem for a table, such as a training or test
    part of the main table. NaN becomes NULL.
    """
    out = {}
    for table in TABLES:
        path = f"{folder.rstrip('/')}/{(names or {}).get(table, table)}.{fmt}"
        if fmt == "csv":
            known = {**DECLARED, **(types or {}).get(table, {})}
            out[table] = nan_to_null(read_csv(spark, path, known))
        else:
            out[table] = nan_to_null(spark.read.format(fmt).load(path))
    return out


def store_tables(
    tables: dict[str, DataFrame], folder: str, narrowed: bool = True, single: bool = False
) -> None:
    """Write the bundle as parquet, by default in narrow integer types. Runs one pass each.

    Text tables are then parsed and measured once instead of on every use.
    Doubles stay as they are, so every value is read back; ``single`` makes them
    single precision where their range allows it.
    """
    for table, df in tables.items():
        out = narrow(df, narrow_types(df, floats=single)) if narrowed else df
        out.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{table}.parquet")
