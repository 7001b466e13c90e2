"""The SQL every query is checked against, written for DuckDB.

Nothing here uses the library. Category lists are spelled out; formulas are
written once more.
"""

from __future__ import annotations

from checks.views import with_views

ORACLE: dict[str, str] = {}


def q(name: str) -> str:
    return '"' + name + '"'


def div(n: str, d: str) -> str:
    """Division with signed infinities for x/0 and NULL for 0/0."""
    return (
        f"CASE WHEN ({d}) <> 0 THEN ({n}) / ({d}) WHEN ({d}) = 0 AND ({n}) > 0"
        f" THEN 'Infinity'::DOUBLE WHEN ({d}) = 0 AND ({n}) < 0 THEN '-Infinity'::DOUBLE END"
    )


def dbl(e: str) -> str:
    return f"CAST({e} AS DOUBLE)"


def ratio(n: str, d: str, guard: str) -> str:
    return div(dbl(n), f"{dbl(d)} + {guard}::DOUBLE")


def total(c: str) -> str:
    return f"coalesce(sum({c}), 0)"


# Names written out -----------------------------------------------------------

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
ORDER_STATES = ("F", "O", "P")
RETURN_FLAGS = ("A", "N", "R")
LINE_STATES = ("F", "O")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
GENDERS = ("AUTOMOBILE", "FURNITURE", "MACHINERY", "XNA")
CONTRACTS = ("Cash loans", "Revolving / other", "XNA")
RATINGS = {"REGION_RATING_CLIENT": "123", "REGION_RATING_CLIENT_W_CITY": "1234"}

# Derived columns -------------------------------------------------------------

PREVIOUS = {
    "AMT_INTEREST": "CNT_PAYMENT * AMT_ANNUITY - AMT_CREDIT",
    "INTEREST_SHARE": ratio(
        "CNT_PAYMENT * AMT_ANNUITY - AMT_CREDIT", "AMT_CREDIT", "0.00001"
    ),
    "INTEREST_RATE": div(
        "24::DOUBLE * CAST(CNT_PAYMENT * AMT_ANNUITY - AMT_CREDIT AS DOUBLE)",
        "CAST(AMT_CREDIT AS DOUBLE) * (CAST(CNT_PAYMENT AS DOUBLE) + 1::DOUBLE)",
    ),
    "AMT_DECLINED": "AMT_APPLICATION - AMT_CREDIT",
    "AMT_CREDIT_GOODS_RATIO": ratio("AMT_CREDIT", "AMT_GOODS_PRICE", "0.00001"),
    "AMT_CREDIT_GOODS_DIFF": "AMT_CREDIT - AMT_GOODS_PRICE",
    "ANNUITY": ratio("AMT_CREDIT", "CNT_PAYMENT", "0.00001"),
    "ANNUITY_GOODS": ratio("AMT_GOODS_PRICE", "CNT_PAYMENT", "0.00001"),
}
POS = {
    "SK_DPD_RATIO": ratio("SK_DPD", "SK_DPD_DEF", "0.00001"),
    "TOTAL_TERM": "CNT_INSTALMENT + CNT_INSTALMENT_FUTURE",
}
INSTALLMENTS = {
    "AMT_PAYMENT_DIFF": "AMT_INSTALMENT - AMT_PAYMENT",
    "AMT_PAYMENT_RATIO": ratio("AMT_PAYMENT", "AMT_INSTALMENT", "0.00001"),
    "DAYS_PAYMENT_RATIO": ratio("DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT", "0.00001"),
    "DAYS_PAYMENT_DIFF": "DAYS_INSTALMENT - DAYS_ENTRY_PAYMENT",
}
CARDS = {
    "AMT_DRAWING_SUM": "AMT_DRAWINGS_ATM_CURRENT + AMT_DRAWINGS_CURRENT"
    " + AMT_DRAWINGS_OTHER_CURRENT + AMT_DRAWINGS_POS_CURRENT",
    "BALANCE_LIMIT_RATIO": ratio("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "0.00001"),
    "CNT_DRAWING_SUM": "CNT_DRAWINGS_ATM_CURRENT + CNT_DRAWINGS_CURRENT"
    " + CNT_DRAWINGS_OTHER_CURRENT + CNT_DRAWINGS_POS_CURRENT + CNT_INSTALMENT_MATURE_CUM",
    "MIN_PAYMENT_RATIO": ratio("AMT_PAYMENT_CURRENT", "AMT_INST_MIN_REGULARITY", "0.0001"),
    "MIN_PAYMENT_TOTAL_RATIO": ratio(
        "AMT_PAYMENT_TOTAL_CURRENT", "AMT_INST_MIN_REGULARITY", "0.00001"
    ),
    "PAYMENT_MIN_DIFF": "AMT_PAYMENT_TOTAL_CURRENT - AMT_INST_MIN_REGULARITY",
    "AMT_INTEREST_RECEIVABLE": "AMT_TOTAL_RECEIVABLE - AMT_RECEIVABLE_PRINCIPAL",
    "SK_DPD_RATIO": ratio("SK_DPD", "SK_DPD_DEF", "0.00001"),
}

WHOLE = (
    "AMT_INTEREST",
    "AMT_DECLINED",
    "CNT_DRAWING_SUM",
    "PAYMENT_MIN_DIFF",
    "AMT_INTEREST_RECEIVABLE",
)


def derived_rows(view: str, columns: dict[str, str]) -> str:
    listed = ", ".join(
        f"{'CAST(' + e + ' AS BIGINT)' if c in WHOLE else dbl(e)} AS {q(c)}"
        for c, e in columns.items()
    )
    return f"{with_views(view)} SELECT SK_ID_CURR, SK_ID_PREV, {listed} FROM {view}"


ORACLE["prevapp_features"] = derived_rows("previous_application", PREVIOUS)
ORACLE["pos_features"] = derived_rows("POS_CASH_balance", POS)
ORACLE["instpay_features"] = derived_rows("installments_payments", INSTALLMENTS)
ORACLE["creditbal_features"] = derived_rows("credit_card_balance", CARDS)

STATUS_WEIGHT = (
    "CASE STATUS WHEN 'C' THEN 0 WHEN '0' THEN 1 WHEN '1' THEN 2 WHEN '2' THEN 3"
    " WHEN 'X' THEN 4 WHEN '3' THEN 5 WHEN '4' THEN 6 WHEN '5' THEN 7 END"
)
MONTHS = (
    "months AS (SELECT SK_ID_BUREAU, abs(MONTHS_BALANCE) AS MONTHS_BALANCE,"
    f" {STATUS_WEIGHT} AS STATUS, CAST({STATUS_WEIGHT} AS DOUBLE)"
    " / (CAST(abs(MONTHS_BALANCE) AS DOUBLE) + 1::DOUBLE) AS WEIGHT_status FROM bureau_balance)"
)

# Bureau totals ---------------------------------------------------------------

DEBT, CREDIT = total("AMT_CREDIT_SUM_DEBT"), total("AMT_CREDIT_SUM")
OVERDUE = total("AMT_CREDIT_SUM_OVERDUE")
BUREAU_TOTALS = {
    "LOAN_COUNT_BUREAU": "count(SK_ID_BUREAU)",
    "LOAN_TYPES_BUREAU": "count(DISTINCT CREDIT_TYPE)",
    "TOTAL_LOAN_AMT_SUM": dbl(CREDIT),
    "TOTAL_LOAN_AMT_SUM_DEBT": dbl(DEBT),
    "debt_credit_ratio": ratio(DEBT, CREDIT, "1"),
    "SUM_AMT_CREDIT_SUM_OVERDUE": dbl(OVERDUE),
    "TOTAL_CUSTOMER_DEBT": dbl(DEBT),
    "overdue_debt_ratio": f"CAST(CAST({ratio(OVERDUE, DEBT, '1')} AS FLOAT) AS DOUBLE)",
}


def listed(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {q(c)}" for c, e in columns.items())


ORACLE["bureau_features"] = (
    f"{with_views('bureau')} SELECT SK_ID_CURR, {listed(BUREAU_TOTALS)}"
    " FROM bureau GROUP BY SK_ID_CURR"
)
ORACLE["agg_join_back"] = f"""{with_views('bureau')},
totals AS (SELECT SK_ID_CURR, {listed(BUREAU_TOTALS)} FROM bureau GROUP BY SK_ID_CURR)
SELECT b.SK_ID_CURR, b.SK_ID_BUREAU, CAST(b.AMT_CREDIT_SUM AS DOUBLE) AS AMT_CREDIT_SUM,
  CAST(b.AMT_CREDIT_SUM_DEBT AS DOUBLE) AS AMT_CREDIT_SUM_DEBT,
  CAST(b.AMT_CREDIT_SUM_OVERDUE AS DOUBLE) AS AMT_CREDIT_SUM_OVERDUE,
  t.* EXCLUDE (SK_ID_CURR)
FROM bureau b LEFT JOIN totals t ON b.SK_ID_CURR = t.SK_ID_CURR"""

# Roll-ups --------------------------------------------------------------------


def mean_exact(e: str) -> str:
    return f"CAST(sum({e}) AS DOUBLE) / count({e})"


def share(column: str, value: str) -> str:
    return (
        f"CAST(sum(CASE WHEN {column} = '{value}' THEN 1 ELSE 0 END) AS DOUBLE) / count(*)"
    )


def shares(prefix: str, column: str, values) -> dict[str, str]:
    return {f"{prefix}_{column}_{v}": share(column, v) for v in values}


def means(prefix: str, plain: tuple[str, ...], derived: dict[str, str]) -> dict[str, str]:
    out = {f"{prefix}_{c}": mean_exact(c) for c in plain}
    for c, e in derived.items():
        digits = 1 if c in ("ANNUITY", "ANNUITY_GOODS") else 4
        out[f"{prefix}_{c}"] = f"round(avg({e}), {digits})" if "/" in e else mean_exact(e)
    return out


BUREAU_ROLLUP = (
    {f"Bureau_{v}": share("CREDIT_TYPE", v) for v in PRIORITIES}
    | {f"Bureau_{v}": share("CREDIT_ACTIVE", v) for v in ORDER_STATES}
    | means(
        "Bureau",
        ("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE", "DAYS_CREDIT"),
        {},
    )
    | {"Bureau_FLAG_OPEN": mean_exact("CAST(FLAG_OPEN AS INTEGER)")}
    | {f"Bureau_{c}": e for c, e in BUREAU_TOTALS.items()}
)
PREVIOUS_ROLLUP = (
    shares("PREV_APP", "NAME_CONTRACT_STATUS", RETURN_FLAGS)
    | shares("PREV_APP", "NAME_YIELD_GROUP", LINE_STATES)
    | means(
        "PREV_APP",
        ("CNT_PAYMENT", "AMT_CREDIT", "AMT_ANNUITY", "AMT_APPLICATION", "AMT_GOODS_PRICE"),
        PREVIOUS,
    )
)
POS_ROLLUP = shares("POS", "NAME_CONTRACT_STATUS", EVENT_TYPES) | means(
    "POS", ("SK_DPD", "SK_DPD_DEF", "CNT_INSTALMENT", "CNT_INSTALMENT_FUTURE"), POS
)
INSTALLMENT_ROLLUP = means(
    "INSTPAY",
    ("AMT_INSTALMENT", "AMT_PAYMENT", "DAYS_INSTALMENT", "DAYS_ENTRY_PAYMENT"),
    INSTALLMENTS,
)
CARD_PLAIN = (
    "AMT_DRAWINGS_ATM_CURRENT",
    "AMT_DRAWINGS_CURRENT",
    "AMT_DRAWINGS_OTHER_CURRENT",
    "AMT_DRAWINGS_POS_CURRENT",
    "CNT_DRAWINGS_ATM_CURRENT",
    "CNT_DRAWINGS_CURRENT",
    "CNT_DRAWINGS_OTHER_CURRENT",
    "CNT_DRAWINGS_POS_CURRENT",
    "CNT_INSTALMENT_MATURE_CUM",
    "AMT_BALANCE",
    "AMT_CREDIT_LIMIT_ACTUAL",
    "AMT_PAYMENT_CURRENT",
    "AMT_PAYMENT_TOTAL_CURRENT",
    "AMT_INST_MIN_REGULARITY",
    "AMT_TOTAL_RECEIVABLE",
    "AMT_RECEIVABLE_PRINCIPAL",
    "SK_DPD",
    "SK_DPD_DEF",
)
CARD_ROLLUP = shares(
    "CREDITBAL", "NAME_CONTRACT_STATUS", [v for v in EVENT_TYPES if v != "error"]
) | means("CREDITBAL", CARD_PLAIN, CARDS) | {
    "CREDITBAL_FLAG_OVERDUE": mean_exact("CAST(FLAG_OVERDUE AS INTEGER)")
}

BALANCE_SUMS = (
    "SELECT b.SK_ID_CURR, CAST(sum(m.MONTHS_BALANCE) AS BIGINT) AS {p}MONTHS_BALANCE,"
    " CAST(coalesce(sum(m.STATUS), 0) AS BIGINT) AS {p}STATUS,"
    " round(coalesce(sum(m.WEIGHT_status), 0), {digits}) AS {p}WEIGHT_status"
    " FROM bureau b JOIN months m ON b.SK_ID_BUREAU = m.SK_ID_BUREAU GROUP BY b.SK_ID_CURR"
)


def grouped(view: str, columns: dict[str, str]) -> str:
    return f"SELECT SK_ID_CURR, {listed(columns)} FROM {view} GROUP BY SK_ID_CURR"


ROLLUPS = {
    "r_bureau": (grouped("bureau", BUREAU_ROLLUP), tuple(BUREAU_ROLLUP)),
    "r_balance": (
        BALANCE_SUMS.format(p="Bureau_bal_", digits=4),
        tuple(f"Bureau_bal_{c}" for c in ("MONTHS_BALANCE", "STATUS", "WEIGHT_status")),
    ),
    "r_previous": (grouped("previous_application", PREVIOUS_ROLLUP), tuple(PREVIOUS_ROLLUP)),
    "r_pos": (grouped("POS_CASH_balance", POS_ROLLUP), tuple(POS_ROLLUP)),
    "r_installments": (
        grouped("installments_payments", INSTALLMENT_ROLLUP),
        tuple(INSTALLMENT_ROLLUP),
    ),
    "r_cards": (grouped("credit_card_balance", CARD_ROLLUP), tuple(CARD_ROLLUP)),
}

ORACLE["rollup_bureau"] = f"{with_views('bureau')} {ROLLUPS['r_bureau'][0]}"
ORACLE["rollup_bureau_balance"] = (
    f"{with_views('bureau', 'bureau_balance')}, {MONTHS} {ROLLUPS['r_balance'][0]}"
)
ORACLE["inner_join_sum"] = (
    f"{with_views('bureau', 'bureau_balance')}, {MONTHS} {BALANCE_SUMS.format(p='', digits=6)}"
)
ORACLE["rollup_prev_app"] = f"{with_views('previous_application')} {ROLLUPS['r_previous'][0]}"
ORACLE["rollup_pos"] = f"{with_views('POS_CASH_balance')} {ROLLUPS['r_pos'][0]}"
ORACLE["rollup_instpay"] = f"{with_views('installments_payments')} {ROLLUPS['r_installments'][0]}"
ORACLE["feature_sink"] = f"""{with_views('installments_payments')}
SELECT SK_ID_CURR, INSTPAY_AMT_INSTALMENT, INSTPAY_AMT_PAYMENT, INSTPAY_AMT_PAYMENT_DIFF,
  round(INSTPAY_DAYS_INSTALMENT, 4) AS INSTPAY_DAYS_INSTALMENT,
  round(INSTPAY_DAYS_ENTRY_PAYMENT, 4) AS INSTPAY_DAYS_ENTRY_PAYMENT,
  INSTPAY_AMT_PAYMENT_RATIO, INSTPAY_DAYS_PAYMENT_RATIO,
  round(INSTPAY_DAYS_PAYMENT_DIFF, 4) AS INSTPAY_DAYS_PAYMENT_DIFF
FROM ({ROLLUPS['r_installments'][0]})"""
ORACLE["rollup_credit"] = f"{with_views('credit_card_balance')} {ROLLUPS['r_cards'][0]}"

# Applications ----------------------------------------------------------------

CLEANED = """cleaned AS (
SELECT * REPLACE (
  round_even(-DAYS_BIRTH / 365::DOUBLE, 0) + 0::DOUBLE AS DAYS_BIRTH,
  CASE WHEN abs(DAYS_EMPLOYED) <> 365243 THEN abs(DAYS_EMPLOYED) / 365::DOUBLE END
    AS DAYS_EMPLOYED,
  CASE WHEN OBS_30_CNT_SOCIAL_CIRCLE <= 30 THEN OBS_30_CNT_SOCIAL_CIRCLE END
    AS OBS_30_CNT_SOCIAL_CIRCLE,
  CASE WHEN OBS_60_CNT_SOCIAL_CIRCLE <= 30 THEN OBS_60_CNT_SOCIAL_CIRCLE END
    AS OBS_60_CNT_SOCIAL_CIRCLE),
  CASE WHEN abs(DAYS_EMPLOYED) = 365243 THEN 1 ELSE 0 END::BIGINT AS Year_Empolyed_ANOM
FROM application WHERE CODE_GENDER IS DISTINCT FROM 'XNA')"""

ORACLE["clean_application"] = f"""{with_views('application')}, {CLEANED}
SELECT * REPLACE (TARGET::BIGINT AS TARGET, REGION_RATING_CLIENT::BIGINT AS REGION_RATING_CLIENT,
  REGION_RATING_CLIENT_W_CITY::DOUBLE AS REGION_RATING_CLIENT_W_CITY) FROM cleaned"""


def main_ratios() -> dict[str, str]:
    return {
        "INCOME_GT_CREDIT_FLAG": "CAST(coalesce(AMT_INCOME_TOTAL > AMT_CREDIT, FALSE) AS BIGINT)",
        "DIR": ratio("AMT_CREDIT", "AMT_INCOME_TOTAL", "1"),
        "AIR": ratio("AMT_ANNUITY", "AMT_INCOME_TOTAL", "1"),
        "ACR": ratio("AMT_CREDIT", "AMT_CREDIT", "1"),
        "DAR": div(dbl("DAYS_EMPLOYED"), dbl("DAYS_BIRTH")),
    }


ORACLE["main_features"] = (
    f"{with_views('application')} SELECT SK_ID_CURR, {listed(main_ratios())} FROM application"
)


def hot(column: str, value: str) -> tuple[str, str]:
    return f"{column}_{value}", f"CASE WHEN {column} = '{value}' THEN 1 ELSE 0 END"


ONE_HOT = dict(
    [hot("CODE_GENDER", v) for v in GENDERS]
    + [hot("NAME_CONTRACT_TYPE", v) for v in CONTRACTS]
    + [hot(c, v) for c, values in RATINGS.items() for v in values]
)
FILLED = """SELECT * REPLACE (coalesce(CODE_GENDER, 'XNA') AS CODE_GENDER,
  coalesce(NAME_CONTRACT_TYPE, 'XNA') AS NAME_CONTRACT_TYPE,
  CAST(REGION_RATING_CLIENT AS VARCHAR) AS REGION_RATING_CLIENT,
  CAST(REGION_RATING_CLIENT_W_CITY AS VARCHAR) AS REGION_RATING_CLIENT_W_CITY)"""

ORACLE["fill_category"] = f"""{with_views('application')}
SELECT SK_ID_CURR, CODE_GENDER, NAME_CONTRACT_TYPE, REGION_RATING_CLIENT,
  REGION_RATING_CLIENT_W_CITY FROM ({FILLED} FROM application)"""
ORACLE["onehot_fitted"] = f"""{with_views('application')}
SELECT SK_ID_CURR, {listed({c: f'CAST({e} AS BIGINT)' for c, e in ONE_HOT.items()})}
FROM ({FILLED} FROM application)"""

# A category that cleaning removes but filling brings back stays a category.
MAIN_NUMERIC = (
    "DAYS_BIRTH",
    "DAYS_EMPLOYED",
    "OBS_30_CNT_SOCIAL_CIRCLE",
    "OBS_60_CNT_SOCIAL_CIRCLE",
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
    "Year_Empolyed_ANOM",
)
MAIN_COLUMNS = (*MAIN_NUMERIC, *ONE_HOT, *main_ratios())


def scaled(c: str) -> str:
    """Imputed and scaled; a constant column is divided by 1."""
    x = f"coalesce(CAST({q(c)} AS DOUBLE), {q('md_' + c)})"
    lo, hi = q("lo_" + c), q("hi_" + c)
    return f"({x} - {lo}) / (CASE WHEN {hi} = {lo} THEN 1::DOUBLE ELSE {hi} - {lo} END)"


def fitted(columns) -> str:
    return ", ".join(
        f"CAST(median(CAST({q(c)} AS DOUBLE)) AS DOUBLE) AS {q('md_' + c)},"
        f" CAST(min({q(c)}) AS DOUBLE) AS {q('lo_' + c)},"
        f" CAST(max({q(c)}) AS DOUBLE) AS {q('hi_' + c)}"
        for c in columns
    )


PREPARED = f"""{CLEANED},
filled AS ({FILLED} FROM cleaned),
encoded AS (SELECT SK_ID_CURR, {', '.join(MAIN_NUMERIC)}, {listed(ONE_HOT)},
  {listed(main_ratios())} FROM filled),
fitted AS (SELECT {fitted(MAIN_COLUMNS)} FROM encoded),
prepared AS (SELECT SK_ID_CURR,
  {', '.join(f'{scaled(c)} AS {q(c)}' for c in MAIN_COLUMNS)} FROM encoded CROSS JOIN fitted)"""

ROUNDED_MAIN = ", ".join(f"round(p.{q(c)}, 8) AS {q(c)}" for c in MAIN_COLUMNS)

ORACLE["prepared_applications"] = (
    f"{with_views('application')}, {PREPARED} SELECT SK_ID_CURR, {ROUNDED_MAIN} FROM prepared p"
)

ALL_VIEWS = with_views(
    "application",
    "bureau",
    "bureau_balance",
    "previous_application",
    "POS_CASH_balance",
    "installments_payments",
    "credit_card_balance",
    "requests",
)
FEATURES = f"{ALL_VIEWS}, {MONTHS}, {PREPARED}, " + ", ".join(
    f"{name} AS ({sql})" for name, (sql, _) in ROLLUPS.items()
)
ROLLED = ", ".join(
    f"coalesce(CAST({name}.{q(c)} AS DOUBLE), 0) AS {q(c)}"
    for name, (_, columns) in ROLLUPS.items()
    for c in columns
)
JOINED = "prepared p " + " ".join(
    f"LEFT JOIN {name} ON p.SK_ID_CURR = {name}.SK_ID_CURR" for name in ROLLUPS
)

ORACLE["customer_features"] = (
    f"{FEATURES} SELECT p.SK_ID_CURR, {ROUNDED_MAIN}, {ROLLED} FROM {JOINED}"
)
ORACLE["requested_features"] = (
    f"{ORACLE['customer_features']}"
    " WHERE p.SK_ID_CURR IN (SELECT r.SK_ID_CURR FROM requests r)"
)

# Scoring ---------------------------------------------------------------------

GOOD = "Customer having good Credit history, capabale to repay a debt "
BAD = "Customer having bad Credit history, risky customer "

SCORED = f"""{FEATURES},
scores AS (SELECT p.SK_ID_CURR, 1::DOUBLE / (1::DOUBLE + exp(-(
  -0.5::DOUBLE + 1.5::DOUBLE * p.DIR + -2.0::DOUBLE * p.DAYS_EMPLOYED
  + 1.0::DOUBLE * coalesce(r_bureau.Bureau_debt_credit_ratio, 0)
  + 0.25::DOUBLE * coalesce(r_pos.POS_SK_DPD, 0)))) AS prob FROM {JOINED})"""

ORACLE["predictions"] = f"""{SCORED}
SELECT s.SK_ID_CURR, a.TARGET::BIGINT AS Actual,
  CASE WHEN prob > 0.5 THEN 1 ELSE 0 END::BIGINT AS Predicted, round(prob, 6) AS prob
FROM scores s JOIN application a ON s.SK_ID_CURR = a.SK_ID_CURR"""

ORACLE["score_requests"] = f"""{SCORED}
SELECT r.SK_ID_CURR, round(prob, 6) AS prob,
  CASE WHEN prob > 0.5 THEN 1 WHEN prob <= 0.5 THEN 0 END::DOUBLE AS pred,
  CASE WHEN prob > 0.5 THEN '{BAD}' WHEN prob <= 0.5 THEN '{GOOD}' END AS verdict,
  CASE WHEN prob IS NOT NULL THEN 'ok' WHEN a.SK_ID_CURR IS NOT NULL THEN 'filtered'
    ELSE 'not_found' END AS status
FROM requests r LEFT JOIN application a ON r.SK_ID_CURR = a.SK_ID_CURR
LEFT JOIN scores s ON r.SK_ID_CURR = s.SK_ID_CURR"""
ORACLE["answer_requests"] = f"""{SCORED},
raw_texts AS (SELECT o_orderkey AS request_no, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority
  ELSE CAST(o_orderkey % 4000 AS VARCHAR) END AS raw FROM orders),
parsed AS (SELECT request_no, raw, CASE WHEN TRY_CAST(raw AS INTEGER) BETWEEN 50 AND 3500
  THEN TRY_CAST(raw AS BIGINT) END AS SK_ID_CURR FROM raw_texts)
SELECT r.request_no, r.raw, r.SK_ID_CURR::DOUBLE AS SK_ID_CURR, round(prob, 6) AS prob,
  CASE WHEN prob > 0.5 THEN 1 WHEN prob <= 0.5 THEN 0 END::DOUBLE AS pred,
  CASE WHEN prob > 0.5 THEN '{BAD}' WHEN prob <= 0.5 THEN '{GOOD}' END AS verdict,
  CASE WHEN r.SK_ID_CURR IS NULL THEN 'rejected' WHEN prob IS NOT NULL THEN 'ok'
    WHEN a.SK_ID_CURR IS NOT NULL THEN 'filtered' ELSE 'not_found' END AS status
FROM parsed r LEFT JOIN application a ON r.SK_ID_CURR = a.SK_ID_CURR
LEFT JOIN scores s ON r.SK_ID_CURR = s.SK_ID_CURR"""
ORACLE["score_requests_stream"] = ORACLE["score_requests"]

# Sources and sinks -----------------------------------------------------------

ORACLE["csv_scan"] = """SELECT o_orderkey,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price,
  CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN 'XNA'
    ELSE o_orderpriority END AS priority
FROM orders"""

_SHAPES = {
    "application": 13,
    "bureau": 9,
    "bureau_balance": 3,
    "previous_application": 9,
    "POS_CASH_balance": 7,
    "credit_card_balance": 22,
    "installments_payments": 6,
}
ORACLE["bundle_shapes"] = with_views(*_SHAPES) + " UNION ALL ".join(
    f" SELECT '{t}' AS label, count(*) AS row_count, {n}::BIGINT AS column_count FROM {t}"
    for t, n in _SHAPES.items()
)


def categories(table: str, column: str, source: str) -> str:
    return (
        f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", c AS category,"
        f" row_number() OVER (ORDER BY c) - 1 AS position"
        f" FROM (SELECT DISTINCT {column} AS c FROM {source} WHERE {column} IS NOT NULL)"
    )


ORACLE["fitted_params_store"] = (
    with_views(
        "application", "bureau", "previous_application", "POS_CASH_balance", "credit_card_balance"
    )
    + f", {CLEANED}, filled AS ({FILLED} FROM cleaned) "
    + " UNION ALL ".join(
        categories(t, c, s)
        for t, c, s in (
            ("application", "CODE_GENDER", "filled"),
            ("application", "NAME_CONTRACT_TYPE", "filled"),
            ("application", "REGION_RATING_CLIENT", "filled"),
            ("application", "REGION_RATING_CLIENT_W_CITY", "filled"),
            ("bureau", "CREDIT_TYPE", "bureau"),
            ("bureau", "CREDIT_ACTIVE", "bureau"),
            ("previous_application", "NAME_CONTRACT_STATUS", "previous_application"),
            ("previous_application", "NAME_YIELD_GROUP", "previous_application"),
            ("POS_CASH_balance", "NAME_CONTRACT_STATUS", "POS_CASH_balance"),
            ("credit_card_balance", "NAME_CONTRACT_STATUS", "credit_card_balance"),
        )
    )
)
_RAW_NUMERIC = (
    "TARGET",
    "DAYS_BIRTH",
    "DAYS_EMPLOYED",
    "OBS_30_CNT_SOCIAL_CIRCLE",
    "OBS_60_CNT_SOCIAL_CIRCLE",
    "REGION_RATING_CLIENT",
    "REGION_RATING_CLIENT_W_CITY",
    "AMT_INCOME_TOTAL",
    "AMT_CREDIT",
    "AMT_ANNUITY",
)
ORACLE["fitted_scale_store"] = with_views("application") + " UNION ALL ".join(
    f" SELECT '{c}' AS \"column\", round(median(CAST({c} AS DOUBLE)), 8) AS median,"
    f" round(CAST(min({c}) AS DOUBLE), 8) AS min, round(CAST(max({c}) AS DOUBLE), 8) AS max"
    " FROM application"
    for c in _RAW_NUMERIC
)

# Projection, filters, joins --------------------------------------------------

ORACLE["select_features"] = f"""{with_views('application')}
SELECT SK_ID_CURR, AMT_ANNUITY, DAYS_BIRTH AS age_days FROM application"""
ORACLE["select_by_type"] = """SELECT count(l_returnflag) AS string_l_returnflag,
  count(l_linestatus) AS string_l_linestatus, count(l_partkey) AS numeric_l_partkey,
  count(l_suppkey) AS numeric_l_suppkey, count(l_linenumber) AS numeric_l_linenumber,
  count(l_quantity) AS numeric_l_quantity, count(l_extendedprice) AS numeric_l_extendedprice,
  count(l_discount) AS numeric_l_discount, count(l_tax) AS numeric_l_tax FROM lineitem"""
ORACLE["label_table"] = f"""{with_views('application')}
SELECT SK_ID_CURR, TARGET::BIGINT AS TARGET FROM application"""
ORACLE["prefix_columns"] = f"""{with_views('POS_CASH_balance')}
SELECT SK_ID_CURR, SK_DPD::BIGINT AS POS_SK_DPD, CNT_INSTALMENT AS POS_CNT_INSTALMENT
FROM POS_CASH_balance"""
ORACLE["cast_to_category"] = f"""{with_views('application')}
SELECT SK_ID_CURR, CAST(REGION_RATING_CLIENT AS VARCHAR) AS REGION_RATING_CLIENT,
  CAST(REGION_RATING_CLIENT_W_CITY AS VARCHAR) AS REGION_RATING_CLIENT_W_CITY FROM application"""
ORACLE["null_safe_filter"] = f"""{with_views('application')}
SELECT SK_ID_CURR, CODE_GENDER FROM application WHERE CODE_GENDER IS DISTINCT FROM 'XNA'"""
ORACLE["lookup_customer"] = f"""{with_views('application')}
SELECT * REPLACE (TARGET::BIGINT AS TARGET, REGION_RATING_CLIENT::BIGINT AS REGION_RATING_CLIENT,
  REGION_RATING_CLIENT_W_CITY::DOUBLE AS REGION_RATING_CLIENT_W_CITY)
FROM application WHERE SK_ID_CURR = (SELECT max(c_custkey) FROM customer)"""
ORACLE["outlier_null"] = f"""{with_views('application')}
SELECT SK_ID_CURR,
  CASE WHEN OBS_30_CNT_SOCIAL_CIRCLE > 30 THEN NULL ELSE OBS_30_CNT_SOCIAL_CIRCLE END
    AS OBS_30_CNT_SOCIAL_CIRCLE,
  CASE WHEN OBS_60_CNT_SOCIAL_CIRCLE > 30 THEN NULL ELSE OBS_60_CNT_SOCIAL_CIRCLE END
    AS OBS_60_CNT_SOCIAL_CIRCLE FROM application"""
ORACLE["request_id_rules"] = f"""{with_views('raw_requests')},
parsed AS (SELECT *, TRY_CAST(raw AS INTEGER) AS n FROM raw_requests)
SELECT request_no, raw, CASE WHEN n BETWEEN 100002 AND 456255 THEN n::DOUBLE END AS SK_ID_CURR,
  CASE WHEN n BETWEEN 100002 AND 456255 THEN 'accepted' ELSE 'rejected' END AS status
FROM parsed"""
ORACLE["left_join_zero_fill"] = f"""{with_views('application', 'POS_CASH_balance')}
SELECT a.SK_ID_CURR, coalesce(sum(CAST(p.SK_DPD AS DOUBLE)), 0) AS dpd
FROM application a LEFT JOIN POS_CASH_balance p ON a.SK_ID_CURR = p.SK_ID_CURR
GROUP BY a.SK_ID_CURR"""
ORACLE["requested_applications"] = f"""{with_views('application', 'requests')}
SELECT SK_ID_CURR, AMT_INCOME_TOTAL FROM application a
WHERE EXISTS (SELECT 1 FROM requests r WHERE r.SK_ID_CURR = a.SK_ID_CURR)"""
ORACLE["listed_applications"] = f"""{with_views('application')}
SELECT SK_ID_CURR, AMT_INCOME_TOTAL FROM application WHERE SK_ID_CURR IN (3, 5, 8, 900, 77777777)"""
ORACLE["peek_rows"] = f"""{with_views('application')}
SELECT SK_ID_CURR, DAYS_EMPLOYED::BIGINT AS DAYS_EMPLOYED FROM application
ORDER BY SK_ID_CURR LIMIT 2"""
ORACLE["missing_requests"] = f"""{with_views('application', 'requests')}
SELECT SK_ID_CURR FROM requests r
WHERE NOT EXISTS (SELECT 1 FROM application a WHERE r.SK_ID_CURR = a.SK_ID_CURR)"""

# Aggregates ------------------------------------------------------------------


def per_customer(columns: str) -> str:
    return f"{with_views('bureau')} SELECT SK_ID_CURR, {columns} FROM bureau GROUP BY SK_ID_CURR"


ORACLE["count_nonnull"] = per_customer(
    "count(SK_ID_BUREAU) AS LOAN_COUNT, count(AMT_CREDIT_SUM_DEBT) AS DEBTS"
)
ORACLE["count_distinct"] = per_customer("count(DISTINCT CREDIT_TYPE) AS LOAN_TYPES")
ORACLE["sum_zero"] = per_customer(
    "CAST(coalesce(sum(AMT_CREDIT_SUM_DEBT), 0) AS DOUBLE) AS AMT_CREDIT_SUM_DEBT,"
    " CAST(sum(DAYS_CREDIT) AS BIGINT) AS DAYS_CREDIT"
)
ORACLE["mean_numeric"] = per_customer(
    ", ".join(
        f"{mean_exact(c)} AS {c}"
        for c in ("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE", "DAYS_CREDIT")
    )
)
ORACLE["rows_per_customer"] = f"""{with_views('previous_application', 'POS_CASH_balance')},
a AS (SELECT SK_ID_CURR, count(SK_ID_PREV) AS n FROM previous_application GROUP BY SK_ID_CURR),
b AS (SELECT SK_ID_CURR, count(SK_ID_PREV) AS n FROM POS_CASH_balance GROUP BY SK_ID_CURR)
SELECT a.SK_ID_CURR, a.n AS PREV_APP_COUNT, b.n::DOUBLE AS POS_COUNT
FROM a LEFT JOIN b ON a.SK_ID_CURR = b.SK_ID_CURR"""
ORACLE["category_share"] = per_customer(
    listed({f"Bureau_{v}": share("CREDIT_TYPE", v) for v in PRIORITIES})
)
ORACLE["category_share_long"] = f"""{with_views('bureau')},
n AS (SELECT SK_ID_CURR, count(*) AS rows_of_key FROM bureau GROUP BY SK_ID_CURR),
pairs AS (SELECT SK_ID_CURR, 'CREDIT_TYPE' AS "column", CREDIT_TYPE AS category FROM bureau
  UNION ALL SELECT SK_ID_CURR, 'CREDIT_ACTIVE', CREDIT_ACTIVE FROM bureau)
SELECT p.SK_ID_CURR, "column", category, CAST(count(*) AS DOUBLE) / max(rows_of_key) AS share
FROM pairs p JOIN n ON p.SK_ID_CURR = n.SK_ID_CURR
WHERE category IS NOT NULL GROUP BY p.SK_ID_CURR, "column", category"""
_ITEM_NUMERIC = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
)
_WHOLE_ITEM = _ITEM_NUMERIC[:4]


def as_kind(e: str, c: str) -> str:
    return f"CAST({e} AS {'BIGINT' if c in _WHOLE_ITEM else 'DOUBLE'})"


ORACLE["column_bounds"] = "SELECT " + ", ".join(
    f"{as_kind(f'{f}({c})', c)} + 0 AS {f}_{c}" for f in ("min", "max") for c in _ITEM_NUMERIC
) + " FROM lineitem"


def chosen_type(c: str) -> str:
    if c not in _WHOLE_ITEM:
        return "'float'"
    return (
        f"CASE WHEN min({c}) > -128 AND max({c}) < 127 THEN 'tinyint'"
        f" WHEN min({c}) > -32768 AND max({c}) < 32767 THEN 'smallint'"
        f" WHEN min({c}) > -2147483648 AND max({c}) < 2147483647 THEN 'int' ELSE 'bigint' END"
    )


ORACLE["narrow_bounds"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {chosen_type(c)} AS type, CAST(min({c}) AS DOUBLE) + 0 AS low,"
    f" CAST(max({c}) AS DOUBLE) + 0 AS high FROM lineitem"
    for c in _ITEM_NUMERIC
)
ORACLE["narrow_table"] = "SELECT " + ", ".join(
    c if c in _WHOLE_ITEM[:3] else
    f"CAST({c} AS BIGINT) AS {c}" if c in _WHOLE_ITEM else
    f"CAST(CAST({c} AS FLOAT) AS DOUBLE) AS {c}"
    for c in _ITEM_NUMERIC
) + ", l_returnflag, l_linestatus, CAST(l_shipdate AS VARCHAR) AS l_shipdate FROM lineitem"


def chosen_width(c: str) -> str:
    return (
        f"CASE {chosen_type(c)} WHEN 'tinyint' THEN 1 WHEN 'smallint' THEN 2 WHEN 'int' THEN 4"
        " WHEN 'float' THEN 4 ELSE 8 END"
    )


_BEFORE = 8 * 8 + 4 + 2 * 8
_AFTER = " + ".join(chosen_width(c) for c in _ITEM_NUMERIC) + " + 24"
ORACLE["memory_report"] = f"""SELECT 'lineitem' AS label, n * {_BEFORE} AS before_bytes,
  CAST(n * width AS BIGINT) AS after_bytes,
  100::DOUBLE * ({_BEFORE} - width) / {_BEFORE} AS saved_percent
FROM (SELECT count(*) AS n, {_AFTER} AS width FROM lineitem)"""

# Scalar functions ------------------------------------------------------------

ORACLE["round_half_even"] = """SELECT l_quantity, max(round_even(l_quantity / 2::DOUBLE, 0)) AS rounded
FROM lineitem GROUP BY l_quantity"""
ORACLE["abs_and_signs"] = """SELECT c_custkey, abs(c_acctbal) AS magnitude, -c_acctbal AS negated
FROM customer"""
ORACLE["sentinel_null_flag"] = f"""{with_views('application')}
SELECT SK_ID_CURR, nullif(abs(DAYS_EMPLOYED), 365243)::DOUBLE AS days,
  CAST(abs(DAYS_EMPLOYED) = 365243 AS BIGINT) AS anomaly FROM application"""
ORACLE["status_map_weight"] = f"""{with_views('bureau_balance')}, {MONTHS}
SELECT MONTHS_BALANCE::BIGINT AS MONTHS_BALANCE, STATUS::DOUBLE AS STATUS,
  count(*) AS row_count, max(WEIGHT_status) AS WEIGHT_status
FROM months GROUP BY MONTHS_BALANCE, STATUS"""
ORACLE["safe_ratio"] = f"""SELECT l_orderkey, l_linenumber,
  {ratio('l_discount', 'l_extendedprice', '0.00001')} AS small_guard,
  {ratio('l_discount', 'l_extendedprice', '0.0001')} AS payment_guard,
  {ratio('l_extendedprice', 'l_discount', '1')} AS unit_guard FROM lineitem"""
ORACLE["ieee_ratio"] = """SELECT
  CASE WHEN l_discount <> 0 THEN 'finite' WHEN l_returnflag = 'A' THEN '-inf'
    WHEN l_returnflag = 'N' THEN 'missing' ELSE '+inf' END AS kind,
  l_returnflag, count(*) AS row_count FROM lineitem GROUP BY 1, 2"""
ORACLE["inf_to_zero"] = """SELECT l_orderkey, l_linenumber,
  CASE WHEN l_discount = 0 THEN 0 ELSE l_extendedprice / l_discount END AS ratio FROM lineitem"""
ORACLE["zero_fill"] = """SELECT l_orderkey,
  CASE WHEN coalesce(plus, 0) > 0 AND coalesce(minus, 0) = 0 THEN '+inf'
    WHEN coalesce(minus, 0) > 0 AND coalesce(plus, 0) = 0 THEN '-inf' ELSE '0.0' END
    AS mean_of_infinities
FROM (SELECT l_orderkey, count(*) FILTER (l_discount = 0 AND l_linenumber % 2 = 1) AS plus,
  count(*) FILTER (l_discount = 0 AND l_linenumber % 2 = 0) AS minus
  FROM lineitem GROUP BY l_orderkey)"""
ORACLE["float32_downcast"] = f"""SELECT l_orderkey, l_linenumber,
  CAST(CAST({ratio('l_extendedprice', 'l_quantity', '1')} AS FLOAT) AS DOUBLE) AS ratio
FROM lineitem"""
_PROB = """CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN 'NaN'::DOUBLE
  ELSE l_quantity / 50::DOUBLE END"""
ORACLE["score_threshold"] = f"""WITH scored AS (SELECT {_PROB} AS p FROM lineitem),
classes AS (SELECT CASE WHEN isnan(p) THEN -1 ELSE p END AS prob,
  CASE WHEN p IS NULL THEN NULL WHEN isnan(p) OR p <= 0.5 THEN 0 ELSE 1 END AS pred FROM scored)
SELECT coalesce(prob, -2) AS prob, pred::DOUBLE AS pred,
  CASE pred WHEN 0 THEN '{GOOD}' WHEN 1 THEN '{BAD}' END AS verdict, count(*) AS row_count
FROM classes GROUP BY 1, 2, 3"""

# Encoders and scalers --------------------------------------------------------

NATIONS_OF_REGION_0 = (0, 5, 10, 15, 20)
ORACLE["onehot_unknown_zero"] = (
    "SELECT c_custkey, "
    + ", ".join(
        f"CASE WHEN c_nationkey = {n} THEN 1 ELSE 0 END::BIGINT AS nation_{n}"
        for n in range(25)
        if n not in NATIONS_OF_REGION_0
    )
    + " FROM customer"
)
ORACLE["onehot_dynamic"] = (
    f"{with_views('bureau')} SELECT SK_ID_BUREAU, "
    + listed(
        {
            c: f"CAST({e} AS BIGINT)"
            for c, e in [hot("CREDIT_TYPE", v) for v in PRIORITIES]
            + [hot("CREDIT_ACTIVE", v) for v in ORDER_STATES]
        }
    )
    + " FROM bureau"
)
_SCALED = ("AMT_CREDIT", "OBS_30_CNT_SOCIAL_CIRCLE", "REGION_RATING_CLIENT_W_CITY")
ORACLE["median_impute"] = f"""{with_views('application')},
fitted AS (SELECT {fitted(_SCALED)} FROM application)
SELECT SK_ID_CURR, {listed({c: f'round(coalesce(CAST({c} AS DOUBLE), md_{c}), 8)' for c in _SCALED})}
FROM application CROSS JOIN fitted"""
ORACLE["minmax_scale"] = f"""{with_views('application')},
fitted AS (SELECT {fitted(_SCALED)} FROM application)
SELECT SK_ID_CURR, {', '.join(f'round({scaled(c)}, 8) AS {c}' for c in _SCALED)}
FROM application CROSS JOIN fitted"""
ORACLE["exact_median_large"] = (
    "SELECT count(*) AS row_count, "
    + ", ".join(f"median(CAST({c} AS DOUBLE)) AS {c}" for c in _ITEM_NUMERIC)
    + " FROM lineitem"
)

# States, upserts and sketches ------------------------------------------------

ORACLE["rollup_incremental"] = ORACLE["rollup_bureau"]
ORACLE["rollup_incremental_balance"] = ORACLE["rollup_bureau_balance"]
ORACLE["rollup_incremental_card"] = ORACLE["rollup_credit"]
ORACLE["features_refreshed"] = ORACLE["customer_features"]
ORACLE["feature_upsert"] = ORACLE["feature_sink"]
ORACLE["tree_scores"] = f"""{with_views('application')}
SELECT SK_ID_CURR, round(1::DOUBLE / (1::DOUBLE + exp(-(-0.1::DOUBLE
  + CASE WHEN AMT_CREDIT IS NULL OR AMT_CREDIT < 15000
      THEN CASE WHEN DAYS_EMPLOYED < -3000 THEN 0.3::DOUBLE ELSE -0.2::DOUBLE END
      WHEN REGION_RATING_CLIENT_W_CITY < 2.5 THEN 0.15::DOUBLE ELSE -0.45::DOUBLE END
  + CASE WHEN OBS_30_CNT_SOCIAL_CIRCLE < 20 THEN 0.25::DOUBLE
      WHEN AMT_INCOME_TOTAL IS NULL OR AMT_INCOME_TOTAL < 5000.5 THEN -0.6::DOUBLE
      ELSE 0.1::DOUBLE END
  + 0.05::DOUBLE))), 9) AS prob FROM application"""
ORACLE["onehot_sparse"] = f"""{with_views('bureau')},
entry AS (SELECT SK_ID_BUREAU, 'CREDIT_TYPE' AS c, CREDIT_TYPE AS v FROM bureau
  UNION ALL SELECT SK_ID_BUREAU, 'CREDIT_ACTIVE', CREDIT_ACTIVE FROM bureau),
numbered AS (SELECT c, v, row_number() OVER (ORDER BY c, v) - 1 AS i
  FROM (SELECT DISTINCT c, v FROM entry WHERE v IS NOT NULL))
SELECT SK_ID_BUREAU, i AS "index", 1::DOUBLE AS "value" FROM entry JOIN numbered USING (c, v)"""
ORACLE["score_requests_joined"] = ORACLE["score_requests"]
ORACLE["median_approx"] = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS row_count, TRUE AS within FROM lineitem" for c in _ITEM_NUMERIC
)
ORACLE["distinct_sketched"] = """SELECT l_linenumber::BIGINT AS l_linenumber,
  count(DISTINCT l_orderkey) AS n_l_orderkey, count(DISTINCT l_partkey) AS n_l_partkey,
  count(DISTINCT l_shipdate) AS n_l_shipdate, TRUE AS within FROM lineitem GROUP BY l_linenumber"""
ORACLE["pipeline_roundtrip"] = ORACLE["prepared_applications"]
ORACLE["footer_bounds"] = ORACLE["column_bounds"]
ORACLE["bloom_lookup"] = f"""{with_views('POS_CASH_balance')}
SELECT * REPLACE (SK_DPD::BIGINT AS SK_DPD, SK_DPD_DEF::BIGINT AS SK_DPD_DEF) FROM POS_CASH_balance
WHERE SK_ID_PREV IN (0, 77, 4242, 99, 123456789)"""
ORACLE["bundle_values"] = f"""{with_views('application')}
SELECT * REPLACE (TARGET::BIGINT AS TARGET, REGION_RATING_CLIENT::BIGINT AS REGION_RATING_CLIENT,
  REGION_RATING_CLIENT_W_CITY::DOUBLE AS REGION_RATING_CLIENT_W_CITY) FROM application"""
ORACLE["ml_predictions"] = ORACLE["predictions"]
ORACLE["python_predictions"] = ORACLE["predictions"]
