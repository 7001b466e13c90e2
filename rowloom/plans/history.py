"""Roll-ups of the six history tables, one row per customer each.

All of them come back keyed by customer and hash-partitioned on it, so the
joins onto the application table add no shuffle on this side.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import name_of, string_columns
from rowloom.operators.aggregate import aggregate_by, count_of, distinct_from_categories, sum_of
from rowloom.operators.encode import fit_categories
from rowloom.operators.rollup import rollup_child
from rowloom.plans import clean
from rowloom.plans import domain as d

BALANCE_COLUMNS = ("MONTHS_BALANCE", "STATUS", "WEIGHT_status")

Categories = Mapping[str, Sequence[str]]


def rollup_bureau(
    bureau: DataFrame, categories: Categories | None = None, complete: bool = False
) -> DataFrame:
    """Category shares, numeric means and totals of the bureau loans.

    The totals are the same for all loans of a customer, so the mean of the
    attached column is the total itself: they are aggregates of the same
    grouping and nothing is joined back to the loans.

    When the categories hold every value of the table (``complete``, or found
    here) the number of loan types is read off the category counts. Otherwise
    it is counted as distinct values, which costs one more shuffle.
    """
    if categories is None:
        categories = fit_categories(bureau, string_columns(bureau, [d.CUSTOMER, d.BUREAU_LOAN]))
        complete = True
    prefix = d.PREFIXES["bureau"]
    types = categories.get("CREDIT_TYPE")
    known = distinct_from_categories("CREDIT_TYPE", types) if complete and types else None
    return rollup_child(
        bureau,
        d.CUSTOMER,
        prefix,
        drop=[d.BUREAU_LOAN],
        categories=categories,
        share_name=lambda column, value: f"{prefix}_{value}",
        extra=clean.bureau_totals(bureau, known),
    )


def rollup_bureau_balance(bureau: DataFrame, balance: DataFrame) -> DataFrame:
    """Sums of the monthly balances over all loans of a customer.

    The monthly rows, the largest table, are summed per loan before they meet
    the loans; sums of sums are the same and the join moves one row per loan.
    Loans that are listed more than once for a customer are counted, so that
    the join has one row per loan and customer on either side and no hot key.
    """
    months = clean.clean_bureau_balance(balance)
    per_loan = aggregate_by(months, d.BUREAU_LOAN, {c: sum_of(months, c) for c in BALANCE_COLUMNS})
    customer, loan = name_of(d.CUSTOMER), name_of(d.BUREAU_LOAN)
    loans = (
        bureau.where(f"{loan} IS NOT NULL AND {customer} IS NOT NULL")
        .groupBy(loan, customer)
        .agg(F.expr("count(1) AS times"))
    )
    prefix = d.PREFIXES["bureau_balance"]
    return aggregate_by(
        loans.join(per_loan, d.BUREAU_LOAN),
        d.CUSTOMER,
        {f"{prefix}_{c}": f"sum(times * {name_of(c)})" for c in BALANCE_COLUMNS},
    )


def rollup_previous(previous: DataFrame, categories: Categories | None = None) -> DataFrame:
    return rollup_child(
        clean.derive_previous(previous),
        d.CUSTOMER,
        d.PREFIXES["previous_application"],
        drop=[d.PREVIOUS_LOAN],
        categories=categories,
    )


def rollup_pos(pos: DataFrame, categories: Categories | None = None) -> DataFrame:
    return rollup_child(
        clean.derive_pos(pos),
        d.CUSTOMER,
        d.PREFIXES["POS_CASH_balance"],
        drop=[d.PREVIOUS_LOAN],
        categories=categories,
    )


def rollup_installments(installments: DataFrame) -> DataFrame:
    return rollup_child(
        clean.derive_installments(installments),
        d.CUSTOMER,
        d.PREFIXES["installments_payments"],
        drop=[d.PREVIOUS_LOAN],
        shares=False,
    )


def rollup_card_balance(cards: DataFrame, categories: Categories | None = None) -> DataFrame:
    return rollup_child(
        clean.derive_card_balance(cards),
        d.CUSTOMER,
        d.PREFIXES["credit_card_balance"],
        drop=[d.PREVIOUS_LOAN],
        categories=categories,
    )


def rows_per_customer(child: DataFrame, name: str) -> DataFrame:
    """Number of rows with a loan id per customer, as a column of its own."""
    return aggregate_by(child, d.CUSTOMER, {name: count_of(d.PREVIOUS_LOAN)})
