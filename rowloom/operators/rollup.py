"""Roll a history table up to one wide row per entity."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from rowloom.functions import numeric_columns, string_columns, told_apart
from rowloom.operators.aggregate import aggregate_by, mean_of, share_of
from rowloom.operators.encode import fit_categories


def rollup_child(
    child: DataFrame,
    key: str,
    prefix: str,
    drop: Iterable[str] = (),
    categories: Mapping[str, Sequence[str]] | None = None,
    shares: bool = True,
    share_name=None,
    extra: Mapping[str, str] | None = None,
    max_categories: int | None = None,
) -> DataFrame:
    """Means of the numeric and boolean columns and shares of the categories, per key.

    Everything is one aggregate and one shuffle. Columns are named
    ``<prefix>_<column>_<value>`` and ``<prefix>_<column>``; ``share_name``
    replaces the first form and ``extra`` adds aggregates under
    ``<prefix>_<name>``. Without ``categories`` one job finds those of all text
    columns first; ``max_categories`` makes a column with more an error.
    """
    drop = set(drop)
    if not shares:
        categories = {}
    elif categories is None:
        categories = fit_categories(child, string_columns(child, [key, *drop]), max_categories)
    name_share = share_name or (lambda column, value: f"{prefix}_{column}_{value}")
    named = [
        (name_share(column, value), share_of(column, value))
        for column, values in categories.items()
        for value in values
    ]
    named += [
        (f"{prefix}_{c}", mean_of(child, c)) for c in numeric_columns(child, {key, *drop}, booleans=True)
    ]
    named += [(f"{prefix}_{name}", c) for name, c in (extra or {}).items()]
    names = told_apart([key, *[name for name, _ in named]])[1:]
    return aggregate_by(child, key, dict(zip(names, (e for _, e in named))))
