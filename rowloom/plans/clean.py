"""Cleaners and derived columns of the single tables.

Each function is one projection (plus one filter for the applications).
Missing operands give missing results unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from rowloom.functions import (
    fill_missing,
    flag,
    half_even,
    ieee_div,
    inf_to,
    map_values,
    name_of,
    null_above,
    null_if,
    operand,
    safe_ratio,
    string_columns,
    to_float32,
    value_of,
)
from rowloom.operators.aggregate import (
    attach_group_aggregates,
    count_of,
    distinct_of,
    sum_of,
)
from rowloom.operators.filters import drop_category
from rowloom.operators.select import with_derived
from rowloom.plans import domain as d


def clean_application(df: DataFrame) -> DataFrame:
    """Ages and employment in years, outliers to NULL, unusable gender dropped."""
    year = value_of(float(d.DAYS_PER_YEAR))
    days = f"abs({operand(df, 'DAYS_EMPLOYED')})"
    employed = null_if(days, d.EMPLOYED_SENTINEL)
    derived = {
        "DAYS_BIRTH": half_even(f"-{operand(df, 'DAYS_BIRTH')} / {year}"),
        "DAYS_EMPLOYED": f"CAST({employed} AS DOUBLE) / {year}",
        "Year_Empolyed_ANOM": flag(f"{days} = {value_of(d.EMPLOYED_SENTINEL)}"),
    }
    for c in d.SOCIAL_CIRCLE_COLUMNS:
        derived[c] = null_above(name_of(c), d.SOCIAL_CIRCLE_LIMIT)
    return with_derived(drop_category(df, "CODE_GENDER", d.UNKNOWN_CATEGORY), derived)


def fill_categories(df: DataFrame) -> DataFrame:
    """Name missing categories, then make the ratings categories as well.

    Ratings become strings after the filling, so their missing values stay.
    """
    texts = string_columns(df, d.RATING_COLUMNS)
    derived = {c: fill_missing(name_of(c), d.UNKNOWN_CATEGORY) for c in texts}
    derived |= {c: f"CAST({name_of(c)} AS STRING)" for c in d.RATING_COLUMNS}
    return with_derived(df, derived)


def derive_application(df: DataFrame) -> DataFrame:
    """Income, credit, annuity and employment ratios."""
    income, credit = operand(df, "AMT_INCOME_TOTAL"), operand(df, "AMT_CREDIT")
    return with_derived(
        df,
        {
            "INCOME_GT_CREDIT_FLAG": flag(f"{income} > {credit}"),
            "DIR": safe_ratio(credit, income, d.GUARD_ONE),
            "AIR": safe_ratio(operand(df, "AMT_ANNUITY"), income, d.GUARD_ONE),
            "ACR": safe_ratio(credit, credit, d.GUARD_ONE),
            "DAR": ieee_div(operand(df, "DAYS_EMPLOYED"), operand(df, "DAYS_BIRTH")),
        },
    )


def loan_totals(credit: str, debt: str, overdue: str, loans: str, loan_types: str) -> dict[str, str]:
    """The totals of a customer's loans, from the sums and counts they are made of.

    The two ratios are expressions over the sums, and the debt sum that is
    wanted under two names is one aggregate in the plan.
    """
    overdue_ratio = fill_missing(safe_ratio(overdue, debt, d.GUARD_ONE), 0.0)
    return {
        "LOAN_COUNT_BUREAU": loans,
        "LOAN_TYPES_BUREAU": loan_types,
        "TOTAL_LOAN_AMT_SUM": credit,
        "TOTAL_LOAN_AMT_SUM_DEBT": debt,
        "debt_credit_ratio": safe_ratio(debt, credit, d.GUARD_ONE),
        "SUM_AMT_CREDIT_SUM_OVERDUE": overdue,
        "TOTAL_CUSTOMER_DEBT": debt,
        "overdue_debt_ratio": to_float32(inf_to(overdue_ratio, 0.0)),
    }


def bureau_totals(df: DataFrame, loan_types: str | None = None) -> dict[str, str]:
    """`loan_totals` as per-customer aggregates of the bureau loans."""
    sums = [sum_of(df, c) for c in ("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE")]
    return loan_totals(*sums, count_of(d.BUREAU_LOAN), loan_types or distinct_of("CREDIT_TYPE"))


def derive_bureau(df: DataFrame) -> DataFrame:
    """Every bureau loan with the totals of its customer. Runs jobs (hot keys)."""
    return attach_group_aggregates(df, d.CUSTOMER, bureau_totals(df))


def clean_bureau_balance(df: DataFrame) -> DataFrame:
    """Status as a weight, months as a positive number, weight fading with age."""
    status = f"CAST({map_values('CAST(STATUS AS STRING)', d.STATUS_WEIGHTS)} AS BIGINT)"
    months = f"abs({operand(df, 'MONTHS_BALANCE')})"
    return with_derived(
        df,
        {
            "STATUS": status,
            "MONTHS_BALANCE": months,
            "WEIGHT_status": safe_ratio(status, months, d.GUARD_ONE),
        },
    )


def derive_previous(df: DataFrame) -> DataFrame:
    """Interest, declined amount and goods ratios of previous applications."""
    credit, goods = operand(df, "AMT_CREDIT"), operand(df, "AMT_GOODS_PRICE")
    payments = operand(df, "CNT_PAYMENT")
    interest = f"({payments} * {operand(df, 'AMT_ANNUITY')} - {credit})"
    rate = f"{value_of(float(d.INTEREST_MONTHS))} * CAST({interest} AS DOUBLE)"
    rate_base = f"CAST({credit} AS DOUBLE) * (CAST({payments} AS DOUBLE) + 1.0D)"
    return with_derived(
        df,
        {
            "AMT_INTEREST": interest,
            "INTEREST_SHARE": safe_ratio(interest, credit, d.GUARD_SMALL),
            "INTEREST_RATE": ieee_div(rate, rate_base),
            "AMT_DECLINED": f"{operand(df, 'AMT_APPLICATION')} - {credit}",
            "AMT_CREDIT_GOODS_RATIO": safe_ratio(credit, goods, d.GUARD_SMALL),
            "AMT_CREDIT_GOODS_DIFF": f"{credit} - {goods}",
            "ANNUITY": safe_ratio(credit, payments, d.GUARD_SMALL),
            "ANNUITY_GOODS": safe_ratio(goods, payments, d.GUARD_SMALL),
        },
    )


def _past_due_ratio(df: DataFrame) -> str:
    return safe_ratio(operand(df, "SK_DPD"), operand(df, "SK_DPD_DEF"), d.GUARD_SMALL)


def derive_pos(df: DataFrame) -> DataFrame:
    """Days-past-due ratio and total term of point-of-sale loans."""
    paid, open_ = operand(df, "CNT_INSTALMENT"), operand(df, "CNT_INSTALMENT_FUTURE")
    return with_derived(
        df, {"SK_DPD_RATIO": _past_due_ratio(df), "TOTAL_TERM": f"{paid} + {open_}"}
    )


def derive_installments(df: DataFrame) -> DataFrame:
    """Difference and ratio of what was due and what was paid, and when."""
    due, paid = operand(df, "AMT_INSTALMENT"), operand(df, "AMT_PAYMENT")
    due_day, paid_day = operand(df, "DAYS_INSTALMENT"), operand(df, "DAYS_ENTRY_PAYMENT")
    return with_derived(
        df,
        {
            "AMT_PAYMENT_DIFF": f"{due} - {paid}",
            "AMT_PAYMENT_RATIO": safe_ratio(paid, due, d.GUARD_SMALL),
            "DAYS_PAYMENT_RATIO": safe_ratio(due_day, paid_day, d.GUARD_SMALL),
            "DAYS_PAYMENT_DIFF": f"{due_day} - {paid_day}",
        },
    )


def derive_card_balance(df: DataFrame) -> DataFrame:
    """Drawing sums, limit use, minimum payment ratios of credit cards."""
    kinds = ("ATM_CURRENT", "CURRENT", "OTHER_CURRENT", "POS_CURRENT")
    amounts = [operand(df, f"AMT_DRAWINGS_{kind}") for kind in kinds]
    counts = [operand(df, f"CNT_DRAWINGS_{kind}") for kind in kinds]
    counts.append(operand(df, "CNT_INSTALMENT_MATURE_CUM"))
    balance, limit = operand(df, "AMT_BALANCE"), operand(df, "AMT_CREDIT_LIMIT_ACTUAL")
    minimum = operand(df, "AMT_INST_MIN_REGULARITY")
    paid, paid_total = operand(df, "AMT_PAYMENT_CURRENT"), operand(df, "AMT_PAYMENT_TOTAL_CURRENT")
    owed, principal = operand(df, "AMT_TOTAL_RECEIVABLE"), operand(df, "AMT_RECEIVABLE_PRINCIPAL")
    return with_derived(
        df,
        {
            "AMT_DRAWING_SUM": " + ".join(amounts),
            "BALANCE_LIMIT_RATIO": safe_ratio(balance, limit, d.GUARD_SMALL),
            "CNT_DRAWING_SUM": " + ".join(counts),
            "MIN_PAYMENT_RATIO": safe_ratio(paid, minimum, d.GUARD_MIN_PAYMENT),
            "MIN_PAYMENT_TOTAL_RATIO": safe_ratio(paid_total, minimum, d.GUARD_SMALL),
            "PAYMENT_MIN_DIFF": f"{paid_total} - {minimum}",
            "AMT_INTEREST_RECEIVABLE": f"{owed} - {principal}",
            "SK_DPD_RATIO": _past_due_ratio(df),
        },
    )
