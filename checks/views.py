"""The generated tables under the column names of the credit tables.

Every view is a list of columns, each a SQL expression that Spark and DuckDB
read alike, so both sides of a check start from the same definition. Money is
decimal in the loans and a whole number of cents, or of hundredths of a cent,
elsewhere: exact sums do not depend on the order of the rows, so that both
engines agree to the last digit. None of the tables has missing values, hence
the CASE expressions that make some.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from rowloom.functions import half_up

CUSTOMER_COLUMNS = {
    "SK_ID_CURR": "c_custkey",
    "TARGET": "CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END",
    "CODE_GENDER": "CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'XNA' WHEN 'BUILDING' THEN NULL"
    " ELSE c_mktsegment END",
    "NAME_CONTRACT_TYPE": "CASE WHEN c_nationkey < 5 THEN NULL WHEN c_nationkey < 15"
    " THEN 'Cash loans' ELSE 'Revolving / other' END",
    "DAYS_BIRTH": "-(7000 + (c_custkey * 37) % 18000)",
    "DAYS_EMPLOYED": "CASE WHEN c_nationkey % 5 = 0 THEN 365243"
    " ELSE -(100 + (c_custkey * 13) % 9000) END",
    "OBS_30_CNT_SOCIAL_CIRCLE": "CASE WHEN c_nationkey = 3 THEN NULL"
    " ELSE CAST((c_custkey * 7) % 45 AS DOUBLE) END",
    "OBS_60_CNT_SOCIAL_CIRCLE": "CAST(c_nationkey * 2 AS DOUBLE)",
    "REGION_RATING_CLIENT": "c_nationkey % 3 + 1",
    "REGION_RATING_CLIENT_W_CITY": "CASE WHEN c_nationkey % 7 = 0 THEN NULL"
    " ELSE c_nationkey % 4 + 1 END",
    "AMT_INCOME_TOTAL": "c_acctbal + CAST(1000 AS DOUBLE)",
    "AMT_CREDIT": "CASE WHEN c_nationkey % 6 = 0 THEN NULL"
    " ELSE abs(c_acctbal) * CAST(3.5 AS DOUBLE) END",
    "AMT_ANNUITY": "abs(c_acctbal) / CAST(12 AS DOUBLE)",
}

BUREAU_COLUMNS = {
    "SK_ID_CURR": "o_custkey",
    "SK_ID_BUREAU": "o_orderkey",
    "CREDIT_TYPE": "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END",
    "CREDIT_ACTIVE": "o_orderstatus",
    "AMT_CREDIT_SUM": "CAST(o_totalprice AS DECIMAL(18,2))",
    "AMT_CREDIT_SUM_DEBT": "CASE WHEN o_orderstatus = 'O'"
    " THEN CAST(o_totalprice AS DECIMAL(18,2)) END",
    "AMT_CREDIT_SUM_OVERDUE": "CASE WHEN o_orderpriority = '1-URGENT'"
    " THEN CAST(o_totalprice AS DECIMAL(18,2)) END",
    "DAYS_CREDIT": "-(o_orderkey % 3000)",
    "FLAG_OPEN": "o_orderstatus = 'O'",
}

BALANCE_COLUMNS = {
    "SK_ID_BUREAU": "l_orderkey",
    "MONTHS_BALANCE": "-l_linenumber",
    "STATUS": "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'C'"
    " WHEN l_returnflag = 'A' THEN '0' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN '1'"
    " WHEN l_returnflag = 'N' THEN '2' WHEN l_linestatus = 'F' THEN 'X' ELSE '9' END",
}

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
TAX_PERCENT = "CAST(round(l_tax * 100) AS BIGINT)"
DISCOUNT_PERCENT = "CAST(round(l_discount * 100) AS BIGINT)"

PREVIOUS_COLUMNS = {
    "SK_ID_CURR": "o_custkey",
    "SK_ID_PREV": "l_orderkey * 10 + l_linenumber",
    "NAME_CONTRACT_STATUS": "l_returnflag",
    "NAME_YIELD_GROUP": "CASE WHEN l_tax = 0 THEN NULL ELSE l_linestatus END",
    "CNT_PAYMENT": "CAST(l_quantity AS INT)",
    "AMT_CREDIT": f"{CENTS} * 100",
    "AMT_ANNUITY": f"{CENTS} * {TAX_PERCENT}",
    "AMT_APPLICATION": f"{CENTS} * (100 + {TAX_PERCENT})",
    "AMT_GOODS_PRICE": f"CASE WHEN l_tax = 0 THEN NULL ELSE {CENTS} * (100 - {DISCOUNT_PERCENT}) END",
}

POS_COLUMNS = {
    "SK_ID_CURR": "user_id",
    "SK_ID_PREV": "event_id",
    "NAME_CONTRACT_STATUS": "event_type",
    "SK_DPD": "CAST(event_id % 4 AS INT)",
    "SK_DPD_DEF": "CAST(event_id % 3 + 1 AS INT)",
    "CNT_INSTALMENT": "CASE WHEN event_id % 11 = 0 THEN NULL"
    " ELSE CAST(event_id % 24 AS DOUBLE) END",
    "CNT_INSTALMENT_FUTURE": "CAST(event_id % 12 AS DOUBLE)",
}

EVENT_CENTS = "CAST(round(value * 100) AS BIGINT)"

INSTALLMENT_COLUMNS = {
    "SK_ID_CURR": "user_id",
    "SK_ID_PREV": "event_id",
    "AMT_INSTALMENT": f"{EVENT_CENTS} + 100",
    "AMT_PAYMENT": f"CASE WHEN event_id % 13 = 0 THEN NULL ELSE {EVENT_CENTS} END",
    "DAYS_INSTALMENT": "CAST(-(event_id % 900 + 10) AS DOUBLE)",
    "DAYS_ENTRY_PAYMENT": "CAST(-(event_id % 880 + 11) AS DOUBLE)",
}

CARD_COLUMNS = {
    "SK_ID_CURR": "user_id",
    "SK_ID_PREV": "event_id",
    "NAME_CONTRACT_STATUS": "CASE WHEN event_type = 'error' THEN NULL ELSE event_type END",
    "AMT_DRAWINGS_ATM_CURRENT": EVENT_CENTS,
    "AMT_DRAWINGS_CURRENT": "event_id % 50",
    "AMT_DRAWINGS_OTHER_CURRENT": "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 7 END",
    "AMT_DRAWINGS_POS_CURRENT": "event_id % 3",
    "CNT_DRAWINGS_ATM_CURRENT": "CAST(event_id % 5 AS INT)",
    "CNT_DRAWINGS_CURRENT": "CAST(event_id % 6 AS INT)",
    "CNT_DRAWINGS_OTHER_CURRENT": "CAST(event_id % 2 AS INT)",
    "CNT_DRAWINGS_POS_CURRENT": "CAST(event_id % 4 AS INT)",
    "CNT_INSTALMENT_MATURE_CUM": "CAST(event_id % 30 AS INT)",
    "AMT_BALANCE": f"{EVENT_CENTS} * 2",
    "AMT_CREDIT_LIMIT_ACTUAL": "CAST(event_id % 400 + 100 AS INT)",
    "AMT_PAYMENT_CURRENT": EVENT_CENTS,
    "AMT_PAYMENT_TOTAL_CURRENT": f"{EVENT_CENTS} + 5",
    "AMT_INST_MIN_REGULARITY": "event_id % 60 + 1",
    "AMT_TOTAL_RECEIVABLE": f"{EVENT_CENTS} * 3",
    "AMT_RECEIVABLE_PRINCIPAL": f"{EVENT_CENTS} * 2",
    "SK_DPD": "CAST(event_id % 4 AS INT)",
    "SK_DPD_DEF": "CAST(event_id % 3 + 1 AS INT)",
    "FLAG_OVERDUE": "event_id % 4 = 0",
}

# One request per line item: ids repeat, a third of the customers is never asked for, and
# some ids belong to no customer.
REQUEST_COLUMNS = {
    "SK_ID_CURR": "CASE WHEN l_partkey % 3 = 0 THEN l_partkey + 100000000 ELSE l_partkey END"
}

# Request texts from all orders: below, inside and above the range, and no numbers.
RAW_REQUEST_COLUMNS = {
    "request_no": "o_orderkey",
    "raw": "CASE WHEN o_orderstatus = 'P' THEN o_orderpriority"
    " ELSE CAST(o_orderkey * 40 AS VARCHAR(20)) END",
}

# View name: source tables, join condition, columns.
VIEWS = {
    "application": (("customer",), None, CUSTOMER_COLUMNS),
    "bureau": (("orders",), None, BUREAU_COLUMNS),
    "bureau_balance": (("lineitem",), None, BALANCE_COLUMNS),
    "previous_application": (
        ("lineitem", "orders"),
        "l_orderkey = o_orderkey",
        PREVIOUS_COLUMNS,
    ),
    "POS_CASH_balance": (("events",), None, POS_COLUMNS),
    "installments_payments": (("events",), None, INSTALLMENT_COLUMNS),
    "credit_card_balance": (("events",), None, CARD_COLUMNS),
    "requests": (("lineitem",), None, REQUEST_COLUMNS),
    "raw_requests": (("orders",), None, RAW_REQUEST_COLUMNS),
}

BUNDLE = [v for v in VIEWS if v not in ("requests", "raw_requests")]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def in_spark(expr: str) -> str:
    """The expression with Spark's `round` of a double, which goes over decimals, done faster."""
    return re.sub(r"\bround\(([^()]+)\)", lambda m: f"({half_up(m[1])})", expr)


def view(
    spark: SparkSession, folder: str, name: str, read: dict[str, DataFrame] | None = None
) -> DataFrame:
    """One view; ``read`` keeps the source tables, so that each is opened once."""
    read = {} if read is None else read
    sources, on, columns = VIEWS[name]
    for source in sources:
        if source not in read:
            read[source] = table(spark, folder, source)
    df = read[sources[0]]
    for other in sources[1:]:
        left, right = on.split(" = ")
        df = df.join(read[other], df[left] == read[other][right])
    return df.selectExpr(*[f"{in_spark(expr)} AS `{out}`" for out, expr in columns.items()])


def bundle(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    read: dict[str, DataFrame] = {}
    return {name: view(spark, folder, name, read) for name in BUNDLE}


def cte(name: str) -> str:
    """The view as a common table expression for DuckDB."""
    sources, on, columns = VIEWS[name]
    source = sources[0]
    for other in sources[1:]:
        source += f" JOIN {other} ON {on}"
    listed = ", ".join(f'{expr} AS "{out}"' for out, expr in columns.items())
    return f"{name} AS (SELECT {listed} FROM {source})"


def with_views(*names: str) -> str:
    return "WITH " + ", ".join(cte(n) for n in names)
