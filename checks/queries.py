"""One query per operator, over whole tables.

Values that are means of ratios are rounded, because two engines add doubles
in different orders; everything else is compared as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.views import BUNDLE, REQUEST_COLUMNS, bundle, table, view
from rowloom import functions as fn
from rowloom import operators as op
from rowloom.functions import name_of
from rowloom.plans import build, clean, history, scoring
from rowloom.plans import domain as d
from rowloom.plans.incremental import HistoryState, refresh
from rowloom.plans.params import MAIN, FittedParams
from rowloom.plans.stages import PrepareApplications
from rowloom.plans.trees import Node, TreeModel
from rowloom.session import work_folder
from rowloom.sources import (
    BatchStore,
    PartitionedTable,
    footer_bounds as bounds_in_footers,
    load_tables,
    read_csv,
    read_features,
    store_tables,
    write_features,
)
from rowloom.streaming import score_request_stream, score_requests_joined as start_joined, stored_answers

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def plain(
    df: DataFrame,
    digits: int | None = None,
    keep: tuple[str, ...] = (),
    gaps: tuple[str, ...] = (),
) -> DataFrame:
    """Decimals and floats as double, small integers as bigint, doubles rounded.

    Whole numbers with missing values (``gaps``) become double as well.
    """
    out = []
    for f in df.schema.fields:
        c = name_of(f.name)
        if f.name in gaps:
            c = f"CAST({c} AS DOUBLE)"
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType, T.DoubleType)):
            c = f"CAST({c} AS DOUBLE)"
            if digits is not None and f.name not in keep:
                c = fn.half_up(c, digits)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = f"CAST({c} AS BIGINT)"
        out.append(f"{c} AS {name_of(f.name)}")
    return df.selectExpr(*out)


# Sources and sinks -----------------------------------------------------------


@query
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written as CSV with missing-value texts, read back and typed."""
    path = work_folder(spark, "csv")
    orders = table(spark, sf, "orders")
    orders.selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderstatus = 'P' THEN 'NA' ELSE CAST(o_totalprice AS STRING) END AS price",
        "CASE o_orderpriority WHEN '5-LOW' THEN 'n/a' WHEN '2-HIGH' THEN 'XNA'"
        " ELSE o_orderpriority END AS priority",
    ).write.option("header", True).csv(path)
    return read_csv(spark, path)


@query
def bundle_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """The seven tables written in narrow types, loaded as a bundle, and measured."""
    path = work_folder(spark, "bundle")
    store_tables(bundle(spark, sf), path)
    reports = [op.shape_report(df, n) for n, df in load_tables(spark, path).items()]
    return reduce(DataFrame.unionAll, reports)


@query
def fitted_params_store(spark: SparkSession, sf: str) -> DataFrame:
    """Categories fitted on all tables, saved, loaded, and listed."""
    path = work_folder(spark, "params")
    build.fit_params(bundle(spark, sf)).save(spark, path)
    listed = FittedParams.load(spark, path).tables(spark)["onehot"]
    return plain(listed)


@query
def fitted_scale_store(spark: SparkSession, sf: str) -> DataFrame:
    """Median, minimum and maximum of the application columns, saved and loaded."""
    path = work_folder(spark, "scale")
    params = FittedParams(scale=op.fit_impute_scale(view(spark, sf, "application"), d.CUSTOMER))
    params.save(spark, path)
    return plain(FittedParams.load(spark, path).tables(spark)["impute_scale"], 8)


@query
def feature_sink(spark: SparkSession, sf: str) -> DataFrame:
    """Installment roll-ups written in sorted key ranges and read back."""
    path = work_folder(spark, "features")
    rolled = history.rollup_installments(view(spark, sf, "installments_payments"))
    write_features(rolled, path, d.CUSTOMER)
    return plain(read_features(spark, path), 4, EXACT_INSTPAY)


# Projection and schema -------------------------------------------------------


@query
def select_features(spark: SparkSession, sf: str) -> DataFrame:
    """A stored list of columns, one dropped, one renamed."""
    app = view(spark, sf, "application")
    some = op.select_named(app, ["SK_ID_CURR", "AMT_ANNUITY", "TARGET", "DAYS_BIRTH"])
    return op.rename_columns(op.drop_columns(some, ["TARGET"]), {"DAYS_BIRTH": "age_days"})


@query
def select_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """Text columns and numeric columns of one table, taken from its schema."""
    item = table(spark, sf, "lineitem")
    texts, numbers = fn.string_columns(item), fn.numeric_columns(item, ["l_orderkey"])
    kinds = [("string", c) for c in texts] + [("numeric", c) for c in numbers]
    return item.selectExpr(*[f"count({c}) AS {kind}_{c}" for kind, c in kinds])


@query
def label_table(spark: SparkSession, sf: str) -> DataFrame:
    _, labels = op.split_label(view(spark, sf, "application"), d.CUSTOMER, d.LABEL)
    return plain(labels)


@query
def prefix_columns(spark: SparkSession, sf: str) -> DataFrame:
    some = view(spark, sf, "POS_CASH_balance").select("SK_ID_CURR", "SK_DPD", "CNT_INSTALMENT")
    return plain(op.prefix_columns(some, "POS", d.CUSTOMER))


@query
def cast_to_category(spark: SparkSession, sf: str) -> DataFrame:
    app = view(spark, sf, "application").select("SK_ID_CURR", *d.RATING_COLUMNS)
    return op.cast_to_category(app, d.RATING_COLUMNS)


@query
def peek_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "application").select("SK_ID_CURR", "DAYS_EMPLOYED")
    return plain(op.peek(rows, d.CUSTOMER))


# Filters ---------------------------------------------------------------------


@query
def null_safe_filter(spark: SparkSession, sf: str) -> DataFrame:
    app = view(spark, sf, "application").select("SK_ID_CURR", "CODE_GENDER")
    return op.drop_category(app, "CODE_GENDER", d.UNKNOWN_CATEGORY)


@query
def lookup_customer(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the newest customer."""
    app = view(spark, sf, "application")
    newest = op.lookup(app, d.CUSTOMER, app.agg(F.max(d.CUSTOMER)).head()[0])
    return plain(newest, gaps=("REGION_RATING_CLIENT_W_CITY",))


@query
def outlier_null(spark: SparkSession, sf: str) -> DataFrame:
    app = view(spark, sf, "application")
    capped = [f"{fn.null_above(c, d.SOCIAL_CIRCLE_LIMIT)} AS {c}" for c in d.SOCIAL_CIRCLE_COLUMNS]
    return app.selectExpr("SK_ID_CURR", *capped)


@query
def request_id_rules(spark: SparkSession, sf: str) -> DataFrame:
    raw = view(spark, sf, "raw_requests")
    accepted, rejected = op.check_ids(raw, "raw", d.CUSTOMER, *d.REQUEST_IDS)
    accepted = accepted.selectExpr("*", "'accepted' AS status")
    refused = rejected.selectExpr("*", f"'{scoring.REJECTED}' AS status")
    both = accepted.unionByName(refused, allowMissingColumns=True)
    return plain(both, gaps=(d.CUSTOMER,))


# Joins -----------------------------------------------------------------------


@query
def inner_join_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Loans joined to their months, summed per customer the plain way."""
    months = clean.clean_bureau_balance(view(spark, sf, "bureau_balance"))
    loans = view(spark, sf, "bureau").select("SK_ID_CURR", "SK_ID_BUREAU")
    joined = op.inner_join(loans, months, d.BUREAU_LOAN)
    sums = {c: op.sum_of(joined, c) for c in history.BALANCE_COLUMNS}
    return plain(op.aggregate_by(joined, d.CUSTOMER, sums), 6)


@query
def left_join_zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    pos = view(spark, sf, "POS_CASH_balance")
    rolled = op.aggregate_by(pos, d.CUSTOMER, {"dpd": op.sum_of(pos, "SK_DPD")})
    app = view(spark, sf, "application").select("SK_ID_CURR")
    return op.left_join_zero_fill(app, rolled, d.CUSTOMER)


@query
def requested_applications(spark: SparkSession, sf: str) -> DataFrame:
    app = view(spark, sf, "application").select("SK_ID_CURR", "AMT_INCOME_TOTAL")
    return op.keep_requested(app, view(spark, sf, "requests"), d.CUSTOMER)


@query
def listed_applications(spark: SparkSession, sf: str) -> DataFrame:
    """The applications of a list of ids, some unknown and one repeated."""
    app = view(spark, sf, "application").select("SK_ID_CURR", "AMT_INCOME_TOTAL")
    return op.keep_requested(app, [3, 5, 8, 8, 900, 77777777, None], d.CUSTOMER)


@query
def missing_requests(spark: SparkSession, sf: str) -> DataFrame:
    app, requests = view(spark, sf, "application"), view(spark, sf, "requests")
    return op.unknown_requests(requests, app, d.CUSTOMER)


@query
def agg_join_back(spark: SparkSession, sf: str) -> DataFrame:
    """Every loan with the totals of its customer."""
    derived = clean.derive_bureau(view(spark, sf, "bureau"))
    return plain(
        op.drop_columns(derived, ["CREDIT_TYPE", "CREDIT_ACTIVE", "DAYS_CREDIT", "FLAG_OPEN"])
    )


# Aggregates ------------------------------------------------------------------


def _by_customer(name: str, measure) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        loans = view(spark, sf, "bureau")
        return plain(op.aggregate_by(loans, d.CUSTOMER, measure(loans)))

    QUERIES[name] = run
    return run


_by_customer(
    "count_nonnull",
    lambda df: {
        "LOAN_COUNT": op.count_of(d.BUREAU_LOAN),
        "DEBTS": op.count_of("AMT_CREDIT_SUM_DEBT"),
    },
)
_by_customer("count_distinct", lambda df: {"LOAN_TYPES": op.distinct_of("CREDIT_TYPE")})
_by_customer(
    "sum_zero", lambda df: {c: op.sum_of(df, c) for c in ("AMT_CREDIT_SUM_DEBT", "DAYS_CREDIT")}
)
_by_customer(
    "mean_numeric",
    lambda df: {c: op.mean_of(df, c) for c in fn.numeric_columns(df, [d.CUSTOMER, d.BUREAU_LOAN])},
)


@query
def rows_per_customer(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of previous applications and of point-of-sale rows, in one column pair."""
    previous = history.rows_per_customer(view(spark, sf, "previous_application"), "PREV_APP_COUNT")
    pos = history.rows_per_customer(view(spark, sf, "POS_CASH_balance"), "POS_COUNT")
    return plain(previous.join(pos, d.CUSTOMER, "left"), gaps=("POS_COUNT",))


@query
def category_share(spark: SparkSession, sf: str) -> DataFrame:
    loans = view(spark, sf, "bureau").select("SK_ID_CURR", "CREDIT_TYPE")
    found = op.fit_categories(loans)["CREDIT_TYPE"]
    shares = {f"Bureau_{v}": op.share_of("CREDIT_TYPE", v) for v in found}
    return op.aggregate_by(loans, d.CUSTOMER, shares)


@query
def category_share_long(spark: SparkSession, sf: str) -> DataFrame:
    return op.category_share_long(
        view(spark, sf, "bureau"), d.CUSTOMER, ["CREDIT_TYPE", "CREDIT_ACTIVE"]
    )


@query
def column_bounds(spark: SparkSession, sf: str) -> DataFrame:
    item = table(spark, sf, "lineitem")
    bounds = plain(op.column_bounds(item, fn.numeric_columns(item)))
    # Adding 0 drops the sign of -0, which the data holds and engines order differently.
    return bounds.selectExpr(*[f"{c} + 0 AS {c}" for c in bounds.columns])


@query
def memory_report(spark: SparkSession, sf: str) -> DataFrame:
    item = table(spark, sf, "lineitem")
    return op.memory_report(item, op.narrow(item), "lineitem")


# Scalar functions ------------------------------------------------------------


@query
def round_half_even(spark: SparkSession, sf: str) -> DataFrame:
    halves = fn.half_even("l_quantity / 2.0D")
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_quantity")
        .agg(F.expr(f"max({halves}) AS rounded"))
    )


@query
def abs_and_signs(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer")
    return customers.selectExpr(
        "c_custkey", "abs(c_acctbal) AS magnitude", "-c_acctbal AS negated"
    )


@query
def sentinel_null_flag(spark: SparkSession, sf: str) -> DataFrame:
    days = "abs(CAST(DAYS_EMPLOYED AS BIGINT))"
    anomaly = fn.flag(f"{days} = {d.EMPLOYED_SENTINEL}")
    return view(spark, sf, "application").selectExpr(
        "SK_ID_CURR",
        f"CAST({fn.null_if(days, d.EMPLOYED_SENTINEL)} AS DOUBLE) AS days",
        f"CAST({anomaly} AS BIGINT) AS anomaly",
    )


@query
def status_map_weight(spark: SparkSession, sf: str) -> DataFrame:
    months = clean.clean_bureau_balance(view(spark, sf, "bureau_balance"))
    return plain(
        months.groupBy("MONTHS_BALANCE", "STATUS").agg(
            F.expr("count(1) AS row_count"), F.expr("max(WEIGHT_status) AS WEIGHT_status")
        ),
        gaps=("STATUS",),
    )


@query
def safe_ratio(spark: SparkSession, sf: str) -> DataFrame:
    price, discount = "l_extendedprice", "l_discount"
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        f"{fn.safe_ratio(discount, price, d.GUARD_SMALL)} AS small_guard",
        f"{fn.safe_ratio(discount, price, d.GUARD_MIN_PAYMENT)} AS payment_guard",
        f"{fn.safe_ratio(price, discount, d.GUARD_ONE)} AS unit_guard",
    )


@query
def ieee_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Unguarded division, infinities spelled out as text."""
    signed = (
        "CASE l_returnflag WHEN 'A' THEN -l_extendedprice WHEN 'N' THEN 0.0D"
        " ELSE l_extendedprice END"
    )
    ratio = fn.ieee_div(signed, "l_discount")
    return (
        table(spark, sf, "lineitem")
        .selectExpr("l_returnflag", f"{ratio} AS ratio")
        .selectExpr(
            "l_returnflag",
            "CASE WHEN ratio IS NULL THEN 'missing' WHEN ratio = double('Infinity') THEN '+inf'"
            " WHEN ratio = double('-Infinity') THEN '-inf' ELSE 'finite' END AS kind",
        )
        .groupBy("kind", "l_returnflag")
        .agg(F.expr("count(1) AS row_count"))
    )


@query
def inf_to_zero(spark: SparkSession, sf: str) -> DataFrame:
    ratio = fn.ieee_div("l_extendedprice", "l_discount")
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{fn.inf_to(ratio, 0.0)} AS ratio"
    )


@query
def zero_fill(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of both infinities is NaN and becomes 0; one infinity stays."""
    ratio = fn.ieee_div("CASE WHEN l_linenumber % 2 = 0 THEN -1.0D ELSE 1.0D END", "l_discount")
    infinite = "avg(CASE WHEN l_discount = 0 THEN ratio END)"
    return (
        table(spark, sf, "lineitem")
        .selectExpr("l_orderkey", "l_discount", f"{ratio} AS ratio")
        .groupBy("l_orderkey")
        .agg(F.expr(f"{fn.zero_fill(infinite)} AS filled"))
        .selectExpr(
            "l_orderkey",
            "CASE WHEN filled = double('Infinity') THEN '+inf'"
            " WHEN filled = double('-Infinity') THEN '-inf'"
            " ELSE CAST(filled AS STRING) END AS mean_of_infinities",
        )
    )


@query
def fill_category(spark: SparkSession, sf: str) -> DataFrame:
    app = view(spark, sf, "application")
    return clean.fill_categories(app).select(
        "SK_ID_CURR", "CODE_GENDER", "NAME_CONTRACT_TYPE", *d.RATING_COLUMNS
    )


@query
def float32_downcast(spark: SparkSession, sf: str) -> DataFrame:
    ratio = fn.safe_ratio("l_extendedprice", "l_quantity", d.GUARD_ONE)
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"CAST({fn.to_float32(ratio)} AS DOUBLE) AS ratio"
    )


@query
def score_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """Classes and verdicts of a made-up probability: 0.5 itself, NaN and missing included."""
    return plain(
        table(spark, sf, "lineitem")
        .selectExpr(
            "CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN double('NaN')"
            " ELSE l_quantity / 50.0D END AS p"
        )
        .selectExpr("p", f"{fn.class_of('p', d.THRESHOLD)} AS pred")
        .selectExpr(
            "coalesce(CASE WHEN isnan(p) THEN -1D ELSE p END, -2D) AS prob",
            "CAST(pred AS DOUBLE) AS pred",
            f"{scoring.verdict_of('pred')} AS verdict",
        )
        .groupBy("prob", "pred", "verdict")
        .agg(F.expr("count(1) AS row_count"))
    )


# Narrowing -------------------------------------------------------------------


@query
def narrow_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen type per column, next to the bounds that decided."""
    item = table(spark, sf, "lineitem")
    types = op.narrow_types(item)
    bounds = op.column_bounds(item, types)
    rows = ", ".join(
        f"struct('{c}' AS column, '{t.simpleString()}' AS type,"
        f" CAST(min_{c} AS DOUBLE) + 0 AS low, CAST(max_{c} AS DOUBLE) + 0 AS high)"
        for c, t in types.items()
    )
    return bounds.selectExpr(f"inline(array({rows}))")


@query
def narrow_table(spark: SparkSession, sf: str) -> DataFrame:
    narrowed = op.narrow(table(spark, sf, "lineitem"))
    return plain(narrowed.withColumn("l_shipdate", F.col("l_shipdate").cast("string")))


# Encoders and scalers --------------------------------------------------------


@query
def onehot_fitted(spark: SparkSession, sf: str) -> DataFrame:
    app = clean.fill_categories(view(spark, sf, "application"))
    some = app.select("SK_ID_CURR", "CODE_GENDER", "NAME_CONTRACT_TYPE", *d.RATING_COLUMNS)
    return plain(op.one_hot(some, op.fit_categories(some)))


@query
def onehot_unknown_zero(spark: SparkSession, sf: str) -> DataFrame:
    """Categories fitted on the nations of four regions, applied to all customers."""
    seen = table(spark, sf, "nation").selectExpr(
        "CASE WHEN n_regionkey > 0 THEN CAST(n_nationkey AS STRING) END AS nation"
    )
    customers = table(spark, sf, "customer").selectExpr(
        "c_custkey", "CAST(c_nationkey AS STRING) AS nation"
    )
    return plain(op.one_hot(customers, op.fit_categories(seen)))


@query
def onehot_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    loans = view(spark, sf, "bureau").select("SK_ID_BUREAU", "CREDIT_TYPE", "CREDIT_ACTIVE")
    return plain(op.one_hot(loans, op.fit_categories(loans)))


SCALED = ["AMT_CREDIT", "OBS_30_CNT_SOCIAL_CIRCLE", "REGION_RATING_CLIENT_W_CITY"]


@query
def median_impute(spark: SparkSession, sf: str) -> DataFrame:
    app = view(spark, sf, "application")
    params = op.fit_impute_scale(app, d.CUSTOMER, SCALED)
    filled = [
        f"{fn.fill_missing(f'CAST({c} AS DOUBLE)', params[c].median)} AS {c}" for c in SCALED
    ]
    return plain(app.selectExpr("SK_ID_CURR", *filled), 8)


@query
def minmax_scale(spark: SparkSession, sf: str) -> DataFrame:
    app = view(spark, sf, "application").select("SK_ID_CURR", *SCALED)
    return plain(op.impute_scale(app, op.fit_impute_scale(app, d.CUSTOMER)), 8)


@query
def exact_median_large(spark: SparkSession, sf: str) -> DataFrame:
    """Medians by narrowing intervals, the way taken for tables of any size."""
    item = table(spark, sf, "lineitem")
    names = fn.numeric_columns(item)
    counts = item.selectExpr(*[f"count({c}) AS {c}" for c in names]).head().asDict()
    found = op.exact_medians(item, counts)
    return item.selectExpr(
        "count(1) AS row_count", *[f"{fn.value_of(found[c])} AS {c}" for c in names]
    )


# Cleaners and derived features -----------------------------------------------


@query
def clean_application(spark: SparkSession, sf: str) -> DataFrame:
    cleaned = clean.clean_application(view(spark, sf, "application"))
    as_number = {"Year_Empolyed_ANOM": "CAST(Year_Empolyed_ANOM AS BIGINT)"}
    return plain(op.with_derived(cleaned, as_number), gaps=("REGION_RATING_CLIENT_W_CITY",))


@query
def main_features(spark: SparkSession, sf: str) -> DataFrame:
    derived = clean.derive_application(view(spark, sf, "application"))
    flag = "CAST(INCOME_GT_CREDIT_FLAG AS BIGINT) AS INCOME_GT_CREDIT_FLAG"
    return derived.selectExpr("SK_ID_CURR", flag, "DIR", "AIR", "ACR", "DAR")


@query
def bureau_features(spark: SparkSession, sf: str) -> DataFrame:
    """Per-customer totals of the loans in one grouping."""
    loans = view(spark, sf, "bureau")
    return plain(op.aggregate_by(loans, d.CUSTOMER, clean.bureau_totals(loans)))


# Differences and sums of whole numbers with a missing operand somewhere.
GAPS = ("AMT_CREDIT_GOODS_DIFF", "AMT_PAYMENT_DIFF", "AMT_DRAWING_SUM")


def _derived(name: str, source: str, derive, columns: list[str]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        derived = derive(view(spark, sf, source)).select("SK_ID_CURR", "SK_ID_PREV", *columns)
        return plain(derived, gaps=GAPS)

    QUERIES[name] = run


PREVIOUS_DERIVED = [
    "AMT_INTEREST",
    "INTEREST_SHARE",
    "INTEREST_RATE",
    "AMT_DECLINED",
    "AMT_CREDIT_GOODS_RATIO",
    "AMT_CREDIT_GOODS_DIFF",
    "ANNUITY",
    "ANNUITY_GOODS",
]
POS_DERIVED = ["SK_DPD_RATIO", "TOTAL_TERM"]
INSTALLMENT_DERIVED = [
    "AMT_PAYMENT_DIFF",
    "AMT_PAYMENT_RATIO",
    "DAYS_PAYMENT_RATIO",
    "DAYS_PAYMENT_DIFF",
]
CARD_DERIVED = [
    "AMT_DRAWING_SUM",
    "BALANCE_LIMIT_RATIO",
    "CNT_DRAWING_SUM",
    "MIN_PAYMENT_RATIO",
    "MIN_PAYMENT_TOTAL_RATIO",
    "PAYMENT_MIN_DIFF",
    "AMT_INTEREST_RECEIVABLE",
    "SK_DPD_RATIO",
]

_derived("prevapp_features", "previous_application", clean.derive_previous, PREVIOUS_DERIVED)
_derived("pos_features", "POS_CASH_balance", clean.derive_pos, POS_DERIVED)
_derived("instpay_features", "installments_payments", clean.derive_installments, INSTALLMENT_DERIVED)
_derived("creditbal_features", "credit_card_balance", clean.derive_card_balance, CARD_DERIVED)


# Roll-ups --------------------------------------------------------------------

# Means of exact decimals or whole numbers: compared as they are, not rounded.
EXACT_INSTPAY = ("INSTPAY_AMT_INSTALMENT", "INSTPAY_AMT_PAYMENT", "INSTPAY_AMT_PAYMENT_DIFF")
RATIOS = {
    "PREV_APP": ("INTEREST_SHARE", "INTEREST_RATE", "AMT_CREDIT_GOODS_RATIO", "ANNUITY",
                 "ANNUITY_GOODS"),
    "POS": ("SK_DPD_RATIO",),
    "INSTPAY": ("AMT_PAYMENT_RATIO", "DAYS_PAYMENT_RATIO"),
    "CREDITBAL": ("BALANCE_LIMIT_RATIO", "MIN_PAYMENT_RATIO", "MIN_PAYMENT_TOTAL_RATIO",
                  "SK_DPD_RATIO"),
    "Bureau_bal": ("WEIGHT_status",),
}
RATIO_COLUMNS = {f"{p}_{c}" for p, columns in RATIOS.items() for c in columns}
# Ratios of about ten million, where four digits would show the order of adding.
LARGE_RATIOS = {"PREV_APP_ANNUITY", "PREV_APP_ANNUITY_GOODS"}


def rounded(df: DataFrame, scaled: tuple[str, ...] = ()) -> DataFrame:
    """Means of ratios to 4 digits (large ones 1), scaled columns to 8, the rest as it is."""
    typed = plain(df)
    digits = {c: 1 if c in LARGE_RATIOS else 4 for c in RATIO_COLUMNS} | {c: 8 for c in scaled}
    return typed.selectExpr(
        *[
            f"{fn.half_up(name_of(c), digits[c])} AS {name_of(c)}" if c in digits else name_of(c)
            for c in typed.columns
        ]
    )


@query
def rollup_bureau(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.rollup_bureau(view(spark, sf, "bureau")))


@query
def rollup_bureau_balance(spark: SparkSession, sf: str) -> DataFrame:
    loans, months = view(spark, sf, "bureau"), view(spark, sf, "bureau_balance")
    return rounded(history.rollup_bureau_balance(loans, months))


@query
def rollup_prev_app(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.rollup_previous(view(spark, sf, "previous_application")))


@query
def rollup_pos(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.rollup_pos(view(spark, sf, "POS_CASH_balance")))


@query
def rollup_instpay(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.rollup_installments(view(spark, sf, "installments_payments")))


@query
def rollup_credit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(history.rollup_card_balance(view(spark, sf, "credit_card_balance")))


# Feature table and scoring ---------------------------------------------------

# A fixed logistic expression stands for the model, which is not published.
WEIGHTS = {"DIR": 1.5, "DAYS_EMPLOYED": -2.0, "Bureau_debt_credit_ratio": 1.0, "POS_SK_DPD": 0.25}
INTERCEPT = -0.5
SELECTED = [d.CUSTOMER, *WEIGHTS]


def main_columns(df: DataFrame) -> tuple[str, ...]:
    prefixes = tuple(f"{p}_" for p in d.PREFIXES.values())
    return tuple(c for c in df.columns if c != d.CUSTOMER and not c.startswith(prefixes))


@query
def prepared_applications(spark: SparkSession, sf: str) -> DataFrame:
    """Applications cleaned, encoded, derived, imputed and scaled."""
    tables = bundle(spark, sf)
    out = build.prepare_main(tables[MAIN], build.fit_params(tables))
    return rounded(out, main_columns(out))


@query
def customer_features(spark: SparkSession, sf: str) -> DataFrame:
    out = build.build_features(bundle(spark, sf))
    return rounded(out, main_columns(out))


@query
def requested_features(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table of the requested customers only."""
    tables = bundle(spark, sf)
    params = build.fit_params(tables)
    out = build.build_features(tables, params, view(spark, sf, "requests"))
    return rounded(out, main_columns(out))


def _features(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    tables = bundle(spark, sf)
    return tables[MAIN], build.build_features(tables)


def _stored_features(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Applications and their features, written once and read from there."""
    application, features = _features(spark, sf)
    path = work_folder(spark, "feature-table")
    write_features(features, path, d.CUSTOMER)
    return application, read_features(spark, path)


@query
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    application, features = _features(spark, sf)
    _, labels = op.split_label(application, d.CUSTOMER, d.LABEL)
    scorer = scoring.logistic_scorer(WEIGHTS, INTERCEPT)
    path = work_folder(spark, "selected")
    FittedParams(selected=SELECTED).save(spark, path)
    scored = scoring.score_features(features, scorer, FittedParams.load(spark, path).selected)
    return plain(scoring.prediction_table(scored, labels), 6)


@query
def score_requests(spark: SparkSession, sf: str) -> DataFrame:
    application, features = _stored_features(spark, sf)
    scorer = scoring.logistic_scorer(WEIGHTS, INTERCEPT)
    answers = scoring.score_requests(
        view(spark, sf, "requests"), application, features, scorer, SELECTED
    )
    return plain(answers, 6, gaps=("pred",))


@query
def answer_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Request texts checked, scored, and answered, with all four outcomes."""
    application, features = _stored_features(spark, sf)
    raw = table(spark, sf, "orders").selectExpr(
        "o_orderkey AS request_no",
        "CASE WHEN o_orderstatus = 'P' THEN o_orderpriority"
        " ELSE CAST(o_orderkey % 4000 AS STRING) END AS raw",
    )
    scorer = scoring.logistic_scorer(WEIGHTS, INTERCEPT)
    ids = (50, 3500)
    answers = scoring.answer_requests(raw, "raw", application, features, scorer, SELECTED, ids)
    return plain(answers, 6, gaps=(d.CUSTOMER, "pred"))


@query
def score_requests_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same answers with the requests arriving as a stream."""
    application, features = _stored_features(spark, sf)
    path, checkpoint = work_folder(spark, "answers"), work_folder(spark, "progress")
    items = table(spark, sf, "lineitem")
    stream = spark.readStream.schema(items.schema).parquet(f"{sf}/lineitem.parquet*")
    score_request_stream(
        stream.selectExpr(f"{REQUEST_COLUMNS[d.CUSTOMER]} AS {d.CUSTOMER}"),
        application,
        features,
        scoring.logistic_scorer(WEIGHTS, INTERCEPT),
        path,
        checkpoint,
        SELECTED,
    ).awaitTermination()
    return plain(spark.read.parquet(path).drop("batch"), 6, gaps=("pred",))


# States, upserts and sketches ------------------------------------------------

# Which rows of a history table come with the second batch, about a third.
LATER = {t: "SK_ID_PREV % 3 = 2" for t in BUNDLE} | {
    "bureau": "SK_ID_BUREAU % 3 = 2",
    "bureau_balance": "MONTHS_BALANCE % 3 = 0",
}


def _batches(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    history = {t: df for t, df in tables.items() if t != MAIN}
    first = {t: df.where(f"NOT ({LATER[t]})") for t, df in history.items()}
    return first, {t: df.where(LATER[t]) for t, df in history.items()}


def _two_batches(spark: SparkSession, sf: str, *names: str) -> HistoryState:
    """The states of some tables: two thirds stored, a third added, once though asked for twice."""
    state = HistoryState(spark, work_folder(spark, "state"))
    first, second = _batches({t: view(spark, sf, t) for t in names})
    state.add("first", first)
    state.add("second", second)
    state.add("second", second)
    return state


@query
def rollup_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The bureau roll-up from stored sums: shares, means, totals and distinct loan types."""
    return rounded(_two_batches(spark, sf, "bureau").bureau())


@query
def rollup_incremental_balance(spark: SparkSession, sf: str) -> DataFrame:
    """The balance roll-up from sums per loan, merged before it is read."""
    state = _two_batches(spark, sf, "bureau", "bureau_balance")
    state.compact("merged")
    return rounded(state.balance.rollup())


@query
def rollup_incremental_card(spark: SparkSession, sf: str) -> DataFrame:
    """The card roll-up from stored sums of its derived columns, booleans included."""
    state = _two_batches(spark, sf, "credit_card_balance")
    return rounded(state.children["credit_card_balance"].rollup(d.PREFIXES["credit_card_balance"]))


@query
def features_refreshed(spark: SparkSession, sf: str) -> DataFrame:
    """The feature table of two thirds of the history, brought up to date with the last third."""
    tables = bundle(spark, sf)
    params = build.fit_params(tables)
    state = HistoryState(spark, work_folder(spark, "state"))
    stored = PartitionedTable(spark, work_folder(spark, "features"), d.CUSTOMER, parts=16)
    first, second = _batches(tables)
    state.add("first", first)
    stored.write(state.features(tables[MAIN], params))
    state.add("second", second)
    refresh(stored, state, "second", tables[MAIN], params)
    out = stored.read()
    return rounded(out, main_columns(out))


@query
def feature_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Installment roll-ups of older rows, those of customers with newer rows replaced."""
    rows = view(spark, sf, "installments_payments")
    newer = rows.where(LATER["installments_payments"])
    stored = PartitionedTable(spark, work_folder(spark, "features"), d.CUSTOMER, parts=16)
    stored.write(history.rollup_installments(rows.where(f"NOT ({LATER['installments_payments']})")))
    stored.upsert(history.rollup_installments(op.keep_requested(rows, newer, d.CUSTOMER)))
    return plain(stored.read(), 4, EXACT_INSTPAY)


# Fixed nodes of a small model: splits on amounts, days and codes with missing values.
TREES = (
    Node(0, 0, "AMT_CREDIT", 15000.0, 1, 2, True),
    Node(0, 1, "DAYS_EMPLOYED", -3000.0, 3, 4, False),
    Node(0, 2, "REGION_RATING_CLIENT_W_CITY", 2.5, 5, 6, False),
    Node(0, 3, value=0.3),
    Node(0, 4, value=-0.2),
    Node(0, 5, value=0.15),
    Node(0, 6, value=-0.45),
    Node(1, 0, "OBS_30_CNT_SOCIAL_CIRCLE", 20.0, 1, 2, False),
    Node(1, 1, value=0.25),
    Node(1, 2, "AMT_INCOME_TOTAL", 5000.5, 3, 4, True),
    Node(1, 3, value=-0.6),
    Node(1, 4, value=0.1),
    Node(2, 0, value=0.05),
)


@query
def tree_scores(spark: SparkSession, sf: str) -> DataFrame:
    """All applications scored by a stored ensemble of trees, missing values going their way."""
    path = work_folder(spark, "trees")
    TreeModel(TREES, base=-0.1).save(spark, path)
    scored = TreeModel.load(spark, path).scorer()(view(spark, sf, "application"))
    return scored.selectExpr("SK_ID_CURR", "round(prob, 9) AS prob")


@query
def onehot_sparse(spark: SparkSession, sf: str) -> DataFrame:
    """Loans as (index, value) vectors, a row for each entry."""
    loans = view(spark, sf, "bureau")
    texts = ["CREDIT_TYPE", "CREDIT_ACTIVE"]
    vectors = op.one_hot_sparse(loans, d.BUREAU_LOAN, texts, op.category_index(loans, texts))
    return vectors.selectExpr("SK_ID_BUREAU", "inline(vector)")


@query
def score_requests_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same answers from a stream that is joined to stored ones."""
    application, features = _stored_features(spark, sf)
    scorer = scoring.logistic_scorer(WEIGHTS, INTERCEPT)
    answers = stored_answers(application, features, scorer, SELECTED)
    path, checkpoint = work_folder(spark, "answers"), work_folder(spark, "progress")
    items = table(spark, sf, "lineitem")
    stream = spark.readStream.schema(items.schema).parquet(f"{sf}/lineitem.parquet*")
    requests = stream.selectExpr(f"{REQUEST_COLUMNS[d.CUSTOMER]} AS {d.CUSTOMER}")
    start_joined(requests, answers, path, checkpoint).awaitTermination()
    return plain(spark.read.parquet(path), 6, gaps=("pred",))


@query
def median_approx(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the rank of each answer is within three times the stated error of the middle."""
    item = table(spark, sf, "lineitem")
    names = fn.numeric_columns(item)
    found = op.approx_medians(item, names)
    error = 3 * op.rank_error()
    ranks = item.selectExpr(
        "count(1) AS n",
        *[f"count_if({c} < {fn.value_of(found[c])}) AS under_{c}" for c in names],
        *[f"count_if({c} <= {fn.value_of(found[c])}) AS upto_{c}" for c in names],
    )
    rows = ", ".join(
        f"struct('{c}' AS column, n AS row_count, under_{c} <= n * {0.5 + error}D"
        f" AND upto_{c} >= n * {0.5 - error}D AS within)"
        for c in names
    )
    return ranks.selectExpr(f"inline(array({rows}))")


@query
def distinct_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct orders and parts by line number, counted, and whether merged sketches agree."""
    item = table(spark, sf, "lineitem")
    columns = ["l_orderkey", "l_partkey", "l_shipdate"]
    state = op.DistinctState(BatchStore(spark, work_folder(spark, "sketches")), ["l_linenumber"])
    state.add("first", item.where("l_orderkey % 3 < 2"), columns)
    state.add("second", item.where("l_orderkey % 3 = 2"), columns)
    counted = item.groupBy("l_linenumber").agg(*[F.expr(f"count(DISTINCT {c}) AS n_{c}") for c in columns])
    allowed = 3 * op.distinct_error()
    near = " AND ".join(f"abs({c} - n_{c}) <= {allowed}D * n_{c}" for c in columns)
    both = counted.join(state.counts(), "l_linenumber")
    return both.selectExpr(
        "CAST(l_linenumber AS BIGINT) AS l_linenumber", *[f"n_{c}" for c in columns], f"{near} AS within"
    )


@query
def pipeline_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A pipeline saved, loaded and fitted, its model saved, loaded and applied."""
    application = view(spark, sf, "application")
    plan, fitted = work_folder(spark, "pipeline"), work_folder(spark, "pipeline-model")
    Pipeline(stages=[PrepareApplications()]).write().overwrite().save(plan)
    Pipeline.load(plan).fit(application).write().overwrite().save(fitted)
    out = PipelineModel.load(fitted).transform(application)
    return rounded(out, main_columns(out))


@query
def footer_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The bounds of all numeric columns, from file statistics alone."""
    names = fn.numeric_columns(table(spark, sf, "lineitem"))
    bounds = bounds_in_footers(spark, f"{sf}/lineitem.parquet", names)
    return plain(bounds.selectExpr(*[f"{c} + 0 AS {c}" for c in bounds.columns]))


@query
def bloom_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of some loan ids from files that are sorted by customer, one of them absent."""
    pos = view(spark, sf, "POS_CASH_balance")
    path = work_folder(spark, "pos")
    write_features(pos, path, d.CUSTOMER, files=4, lookups={"SK_ID_PREV": 10_000})
    some = read_features(spark, path).where("SK_ID_PREV IN (0, 77, 4242, 99, 123456789)")
    return plain(some, gaps=("CNT_INSTALMENT",))


@query
def bundle_values(spark: SparkSession, sf: str) -> DataFrame:
    """The applications after they were stored in narrow types and loaded: every value."""
    path = work_folder(spark, "bundle")
    store_tables(bundle(spark, sf), path)
    return plain(load_tables(spark, path)["application"], gaps=("REGION_RATING_CLIENT_W_CITY",))


def _predicted(spark: SparkSession, sf: str, scorer: scoring.Scorer) -> DataFrame:
    application, features = _stored_features(spark, sf)
    _, labels = op.split_label(application, d.CUSTOMER, d.LABEL)
    return plain(scoring.prediction_table(scoring.score_features(features, scorer, SELECTED), labels), 6)


@query
def ml_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The predictions of a Spark ML pipeline with the same fixed coefficients."""
    weights = Vectors.dense(list(WEIGHTS.values()))
    made = JavaWrapper._new_java_obj(
        "org.apache.spark.ml.classification.LogisticRegressionModel", "fixed", weights, INTERCEPT
    )
    model = LogisticRegressionModel(made)
    assembler = VectorAssembler(inputCols=list(WEIGHTS), outputCol="features")
    return _predicted(spark, sf, scoring.ml_scorer(PipelineModel([assembler, model])))


@query
def python_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The predictions of a Python model, called on batches of rows."""
    names, weights = list(WEIGHTS), np.array(list(WEIGHTS.values()))

    def predict(rows):
        return 1 / (1 + np.exp(-(rows.to_numpy(float) @ weights + INTERCEPT)))

    return _predicted(spark, sf, scoring.pandas_scorer(predict, names))
