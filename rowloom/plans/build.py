"""The full feature table: one row per customer."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from rowloom.functions import name_of, string_columns
from rowloom.operators.encode import fit_categories_of, one_hot
from rowloom.operators.joins import Requested, left_join_zero_fill
from rowloom.operators.scale import fit_impute_scale, impute_scale
from rowloom.operators.select import drop_columns
from rowloom.plans import clean, history
from rowloom.plans import domain as d
from rowloom.plans.params import MAIN, FittedParams
from rowloom.session import written

Tables = Mapping[str, DataFrame]

WITH_SHARES = ("bureau", "previous_application", "POS_CASH_balance", "credit_card_balance")
ROLLUP_ORDER = (
    "bureau",
    "bureau_balance",
    "previous_application",
    "POS_CASH_balance",
    "installments_payments",
    "credit_card_balance",
)


def clean_main(application: DataFrame) -> DataFrame:
    """Cleaned applications without the label, before encoding."""
    features = drop_columns(application, [d.LABEL])
    return clean.fill_categories(clean.clean_application(features))


def encode_main(cleaned: DataFrame, params: FittedParams) -> DataFrame:
    """One-hot categories, then the derived ratios; text that was not fitted is left out."""
    wide = params.categories[MAIN]
    texts = [c for c in string_columns(cleaned, [d.CUSTOMER]) if c not in wide]
    return clean.derive_application(one_hot(drop_columns(cleaned, texts), wide))


def prepare_main(application: DataFrame, params: FittedParams) -> DataFrame:
    """Applications cleaned, encoded, imputed and scaled; the key unchanged."""
    return impute_scale(encode_main(clean_main(application), params), params.scale)


def fit_params(
    tables: Tables,
    text_columns: Mapping[str, Sequence[str]] | None = None,
    max_categories: int | None = None,
) -> FittedParams:
    """Fit categories, medians and ranges. Runs jobs.

    One job finds the categories of all tables; the scaling takes a few
    passes over the application table only. ``text_columns`` names, by table,
    the text columns that become wide; without it, or for a table it does not
    have, these are all. Columns left out are no features; use
    ``category_share_long`` for their shares. ``max_categories`` makes a column
    with more an error; there is no limit otherwise.
    """
    chosen = text_columns or {}
    cleaned = clean_main(tables[MAIN])
    wanted = {MAIN: (cleaned, chosen.get(MAIN, string_columns(cleaned, [d.CUSTOMER])))}
    for t in WITH_SHARES:
        ids = [d.CUSTOMER, d.BUREAU_LOAN, d.PREVIOUS_LOAN]
        wanted[t] = (tables[t], chosen.get(t, string_columns(tables[t], ids)))
    params = FittedParams(categories=fit_categories_of(wanted, max_categories))
    params.scale = fit_impute_scale(encode_main(cleaned, params), d.CUSTOMER)
    return params


def restrict(tables: Tables, requests: DataFrame | Iterable) -> dict[str, DataFrame]:
    """All tables cut down to the requested customers.

    Done before any grouping, so that a list of ids filters the scans. The
    monthly balances know no customer; they are cut down to the loans of the
    requested customers, which are written first: a plain side of the join, so
    that adaptive execution can split a loan with very many months.
    """
    wanted = Requested(requests, d.CUSTOMER)
    out = {t: wanted.keep(df) for t, df in tables.items() if t != "bureau_balance"}
    loans = written(out["bureau"].selectExpr(name_of(d.BUREAU_LOAN)).distinct(), "loans")
    return out | {
        "bureau_balance": tables["bureau_balance"].join(loans, d.BUREAU_LOAN, "left_semi")
    }


def history_rollups(
    tables: Tables, params: FittedParams, complete: bool = False
) -> dict[str, DataFrame]:
    """The six roll-ups in the order in which they are attached."""
    known = params.categories
    return {
        "bureau": history.rollup_bureau(tables["bureau"], known["bureau"], complete),
        "bureau_balance": history.rollup_bureau_balance(
            tables["bureau"], tables["bureau_balance"]
        ),
        "previous_application": history.rollup_previous(
            tables["previous_application"], known["previous_application"]
        ),
        "POS_CASH_balance": history.rollup_pos(
            tables["POS_CASH_balance"], known["POS_CASH_balance"]
        ),
        "installments_payments": history.rollup_installments(tables["installments_payments"]),
        "credit_card_balance": history.rollup_card_balance(
            tables["credit_card_balance"], known["credit_card_balance"]
        ),
    }


def build_features(
    tables: Tables,
    params: FittedParams | None = None,
    requests: DataFrame | Iterable | None = None,
    text_columns: Mapping[str, Sequence[str]] | None = None,
    max_categories: int | None = None,
) -> DataFrame:
    """Scaled application columns plus zero-filled history columns. Runs small jobs.

    Without ``params`` they are fitted on the same tables first, with
    ``text_columns`` and ``max_categories`` as in `fit_params`; with
    ``requests``, a DataFrame or a list of ids, only those customers are
    computed. The rows of customers
    whose gender code is unusable are left out.
    """
    complete = params is None
    params = fit_params(tables, text_columns, max_categories) if params is None else params
    if requests is not None:
        tables = restrict(tables, requests)
    out = prepare_main(tables[MAIN], params)
    for rollup in history_rollups(tables, params, complete).values():
        out = left_join_zero_fill(out, rollup, d.CUSTOMER)
    return out
