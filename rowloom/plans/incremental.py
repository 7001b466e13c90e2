"""The feature table kept up to date from new rows alone.

The roll-ups of the six history tables live as states. New rows are summed and
added; then only the customers they belong to are built again, from the states,
and replaced in the stored table.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import name_of
from rowloom.operators.aggregate import aggregate_by, sum_of
from rowloom.operators.joins import Requested, left_join_zero_fill
from rowloom.operators.state import RollupState, count_in, merged, sum_in
from rowloom.plans import build, clean
from rowloom.plans import domain as d
from rowloom.plans.history import BALANCE_COLUMNS
from rowloom.plans.params import MAIN, FittedParams
from rowloom.session import written
from rowloom.sources.batches import BatchStore
from rowloom.sources.upsert import PartitionedTable

# What is derived from the rows of a table before they are summed, and its loan id.
CHILDREN = {
    "bureau": (lambda df: df, d.BUREAU_LOAN),
    "previous_application": (clean.derive_previous, d.PREVIOUS_LOAN),
    "POS_CASH_balance": (clean.derive_pos, d.PREVIOUS_LOAN),
    "installments_payments": (clean.derive_installments, d.PREVIOUS_LOAN),
    "credit_card_balance": (clean.derive_card_balance, d.PREVIOUS_LOAN),
}


MONTHS, LOANS = "months", "loans"


class BalanceState:
    """Monthly balances summed per loan, and how often a customer has each loan.

    Months and loans arrive on their own; they meet when the roll-up is read.
    """

    def __init__(self, store: BatchStore):
        self.store = store

    @staticmethod
    def months(balance: DataFrame) -> dict[str, DataFrame]:
        """The sums of a batch of monthly balances."""
        rows = clean.clean_bureau_balance(balance)
        return {MONTHS: aggregate_by(rows, d.BUREAU_LOAN, {c: sum_of(rows, c) for c in BALANCE_COLUMNS})}

    @staticmethod
    def loans(bureau: DataFrame) -> dict[str, DataFrame]:
        """The loans of a batch, by customer."""
        loan, customer = name_of(d.BUREAU_LOAN), name_of(d.CUSTOMER)
        pairs = bureau.where(f"{loan} IS NOT NULL AND {customer} IS NOT NULL")
        return {LOANS: pairs.groupBy(loan, customer).agg(F.expr("count(1) AS times"))}

    def changed_by_months(self, batches: Iterable[str]) -> DataFrame:
        """The customers whose loans have months in the given batches."""
        loans = self.store.read(MONTHS, batches).select(d.BUREAU_LOAN).distinct()
        found = self.store.read(LOANS).join(written(loans, "changed-loans"), d.BUREAU_LOAN, "left_semi")
        return found.select(d.CUSTOMER).distinct()

    def merged_parts(self) -> dict[str, DataFrame]:
        keys = {MONTHS: [d.BUREAU_LOAN], LOANS: [d.BUREAU_LOAN, d.CUSTOMER]}
        return {t: merged(self.store.read(t), k) for t, k in keys.items() if self.store.has(t)}

    def rollup(self, keys: Requested | None = None) -> DataFrame:
        loans, months = self.store.read(LOANS), self.store.read(MONTHS)
        if keys is not None:
            loans = keys.keep(loans)
            wanted = written(loans.select(d.BUREAU_LOAN).distinct(), "wanted-loans")
            months = months.join(wanted, d.BUREAU_LOAN, "left_semi")
        loans = merged(loans, [d.BUREAU_LOAN, d.CUSTOMER])
        prefix = d.PREFIXES["bureau_balance"]
        sums = {f"{prefix}_{c}": f"sum(times * {name_of(c)})" for c in BALANCE_COLUMNS}
        return aggregate_by(loans.join(merged(months, [d.BUREAU_LOAN]), d.BUREAU_LOAN), d.CUSTOMER, sums)


class HistoryState:
    """The six history tables as states in one store."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = BatchStore(spark, path)
        self.children = {t: RollupState(self.store, d.CUSTOMER, f"{t}.") for t in CHILDREN}
        self.balance = BalanceState(self.store)

    def add(self, batch: str, tables: Mapping[str, DataFrame]) -> bool:
        """Add new rows of some of the tables, all together; False if the batch was added before."""
        parts: dict[str, DataFrame] = {}
        for table, rows in tables.items():
            if table == "bureau_balance":
                parts |= self.balance.months(rows)
            elif table in CHILDREN:
                derive, loan = CHILDREN[table]
                texts = None if table in build.WITH_SHARES else ()
                parts |= self.children[table].parts(derive(rows), [loan], texts, [loan])
                if table == "bureau":
                    parts |= self.balance.loans(rows)
        return self.store.add(batch, parts)

    def changed(self, batch: str) -> DataFrame:
        """The customers that a batch has rows of, in any table."""
        tables = self.store.live().get(batch, [])
        parts = [s.changed([batch]) for s in self.children.values() if s.numbers in tables]
        if MONTHS in tables and self.store.has(LOANS):
            parts.append(self.balance.changed_by_months([batch]))
        if not parts:
            raise ValueError(f"no customers in a batch {batch}")
        return reduce(DataFrame.union, parts).distinct()

    def compact(self, batch: str) -> bool:
        """Merge all batches into one, under a new name."""
        parts = self.balance.merged_parts()
        for state in self.children.values():
            parts |= state.merged_parts()
        return self.store.add(batch, parts, replaces=self.store.live())

    def bureau(self, categories=None, keys: Requested | None = None) -> DataFrame:
        prefix = d.PREFIXES["bureau"]
        sums = [sum_in(c) for c in ("AMT_CREDIT_SUM", "AMT_CREDIT_SUM_DEBT", "AMT_CREDIT_SUM_OVERDUE")]
        return self.children["bureau"].rollup(
            prefix,
            categories,
            share_name=lambda column, value: f"{prefix}_{value}",
            extra=clean.loan_totals(*sums, count_in(d.BUREAU_LOAN), "coalesce(loan_types, 0L)"),
            distinct={"loan_types": "CREDIT_TYPE"},
            keys=keys,
        )

    def rollups(self, params: FittedParams, keys: Requested | None = None) -> dict[str, DataFrame]:
        """As `build.history_rollups`, from the states."""
        known = params.categories
        out = {"bureau": self.bureau(known["bureau"], keys), "bureau_balance": self.balance.rollup(keys)}
        for table in CHILDREN:
            if table != "bureau":
                shares = known[table] if table in build.WITH_SHARES else {}
                out[table] = self.children[table].rollup(d.PREFIXES[table], shares, keys=keys)
        return out

    def features(self, application: DataFrame, params: FittedParams, keys: Requested | None = None) -> DataFrame:
        """The feature table, or that of the requested customers."""
        main = keys.keep(application) if keys is not None else application
        out = build.prepare_main(main, params)
        rolled = self.rollups(params, keys)
        for table in build.ROLLUP_ORDER:
            out = left_join_zero_fill(out, rolled[table], d.CUSTOMER)
        return out


def refresh(
    table: PartitionedTable,
    state: HistoryState,
    batch: str,
    application: DataFrame,
    params: FittedParams,
    applicants: DataFrame | None = None,
) -> list[int]:
    """Build the customers of a batch again and replace their rows. Runs jobs.

    ``applicants`` names further customers whose application is new or other.
    Customers who are now filtered out, or who have no application any more,
    lose their row. Returns the folders that were written; the history tables
    aren't read.
    """
    wanted = state.changed(batch)
    if applicants is not None:
        wanted = wanted.union(applicants.select(d.CUSTOMER)).distinct()
    keys = Requested(wanted, d.CUSTOMER)
    return table.upsert(state.features(application, params, keys), keys.ids)


def features_from(tables: Mapping[str, DataFrame], state: HistoryState, batch: str, params: FittedParams) -> DataFrame:
    """Add a first batch and build all features from the state."""
    state.add(batch, {t: df for t, df in tables.items() if t != MAIN})
    return state.features(tables[MAIN], params)
