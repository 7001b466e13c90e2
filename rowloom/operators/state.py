"""Roll-ups kept as sums that can be added to.

A full roll-up reads all rows of a history table. A state holds, for each
batch of rows, sums and counts per key: small, and mergeable by adding. New
rows are summed once and added as a batch; means, shares and totals are made
when the state is read. Category counts are rows (key, column, category), so a
new category needs no new column and nothing is written again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.functions import name_of, numeric_columns, string_columns, told_apart, value_of
from rowloom.operators.joins import Requested
from rowloom.operators.select import select_named

if TYPE_CHECKING:
    from rowloom.sources.batches import BatchStore

SUM, COUNT = "sum of ", "count of "


def total_kind(kind: T.DataType) -> str:
    """A type that holds sums of many values and sums of these; exact unless floating."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return "DOUBLE"
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL(38, {kind.scale})"
    return "DECIMAL(38, 0)" if isinstance(kind, T.LongType) else "BIGINT"


def summed(df: DataFrame, column: str) -> str:
    """The sum of a column, 0 without a value, in a type that can be added to.

    A bigint is summed as its upper and its lower 32 bits, which are put together
    once a key: exact for 2^31 rows of a key, without a decimal for every row.
    """
    kind, c = df.schema[column].dataType, name_of(column)
    value = f"CAST({c} AS INT)" if isinstance(kind, T.BooleanType) else c
    if isinstance(kind, T.LongType):
        upper, lower = (f"CAST(sum({half}) AS DECIMAL(20, 0))" for half in (f"shiftright({c}, 32)", f"{c} & 4294967295L"))
        return f"CAST(coalesce({upper} * 4294967296BD + {lower}, 0) AS {total_kind(kind)})"
    return f"CAST(coalesce(sum({value}), 0) AS {total_kind(kind)})"


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add up everything but the keys. Types stay, so results can be merged again."""
    kinds = {f.name: f.dataType.simpleString() for f in parts.schema.fields if f.name not in keys}
    sums = [f"CAST(coalesce(sum({name_of(c)}), 0) AS {k}) AS {name_of(c)}" for c, k in kinds.items()]
    return parts.groupBy(*[name_of(k) for k in keys]).agg(*[F.expr(s) for s in sums])


class RollupState:
    """The state of the roll-up of one history table to one row per key.

    ``name`` tells it from other states in the same store.
    """

    def __init__(self, store: BatchStore, key: str, name: str = ""):
        self.store, self.key = store, key
        self.numbers, self.counts = f"{name}numbers", f"{name}categories"

    def parts(
        self,
        rows: DataFrame,
        drop: Iterable[str] = (),
        texts: Sequence[str] | None = None,
        counted: Iterable[str] = (),
    ) -> dict[str, DataFrame]:
        """The sums of a batch of rows, by table of the store.

        Numeric and boolean columns but the dropped ones get sums and counts,
        the ``counted`` ones counts alone, and ``texts`` (by default all text
        columns but the dropped ones) a count for each category. Rows without a
        key are left out. The new rows are read twice, older ones not at all.
        """
        key, drop = self.key, set(drop)
        present = rows.where(f"{name_of(key)} IS NOT NULL")
        numbers = numeric_columns(rows, {key, *drop}, booleans=True)
        sums = {"rows": "count(1)"}
        sums |= {SUM + c: summed(rows, c) for c in numbers}
        sums |= {COUNT + c: f"count({name_of(c)})" for c in [*numbers, *counted]}
        totals = present.groupBy(name_of(key)).agg(*[F.expr(f"{e} AS {name_of(n)}") for n, e in sums.items()])
        texts = string_columns(rows, [key, *drop]) if texts is None else list(texts)
        if not texts:
            return {self.numbers: totals}
        long = select_named(present, [key, *texts]).unpivot([key], texts, "column", "category")
        counts = long.where("category IS NOT NULL").groupBy(name_of(key), "column", "category")
        return {self.numbers: totals, self.counts: counts.agg(F.expr("count(1) AS n"))}

    def add(self, batch: str, rows: DataFrame, **options) -> bool:
        """Add the `parts` of a batch of rows; False if the batch was added before."""
        return self.store.add(batch, self.parts(rows, **options))

    def changed(self, batches: Iterable[str]) -> DataFrame:
        """The keys that the given batches have rows of."""
        return self.store.read(self.numbers, batches).select(name_of(self.key)).distinct()

    def categories(self) -> dict[str, list[str]]:
        """Sorted categories by column, from the counts; no row of the table is read."""
        found: dict[str, list[str]] = {}
        if not self.store.has(self.counts):
            return found
        pairs = self.store.read(self.counts).select("column", "category").distinct()
        for column, category in sorted(map(tuple, pairs.collect())):
            found.setdefault(column, []).append(category)
        return found

    def merged_parts(self) -> dict[str, DataFrame]:
        """What all live batches together have, as one."""
        out = {}
        for table, keys in ((self.numbers, [self.key]), (self.counts, [self.key, "column", "category"])):
            if self.store.has(table):
                out[table] = merged(self.store.read(table), keys)
        return out

    def compact(self, batch: str) -> bool:
        """Merge all live batches into one, under a new name."""
        return self.store.add(batch, self.merged_parts(), replaces=self.store.live())

    def rollup(
        self,
        prefix: str,
        categories: Mapping[str, Sequence[str]] | None = None,
        share_name: Callable[[str, str], str] | None = None,
        extra: Mapping[str, str] | None = None,
        distinct: Mapping[str, str] | None = None,
        keys: Requested | None = None,
    ) -> DataFrame:
        """The columns of `rollup_child`, for all keys or the requested ones.

        ``extra`` adds expressions over `sum_in`, `count_in` and the names in
        ``distinct``, which maps such a name to a text column whose different
        values are counted. One shuffle for the numbers, one for the
        categories, and a join of two tables with a row per key.
        """
        categories = self.categories() if categories is None else categories
        keep = keys.keep if keys is not None else lambda df: df
        numbers = merged(keep(self.store.read(self.numbers)), [self.key])
        columns = [c.removeprefix(SUM) for c in numbers.columns if c.startswith(SUM)]
        wide = [(c, v) for c, values in categories.items() for v in values]
        counts = [
            f"sum(CASE WHEN column = {value_of(c)} AND category = {value_of(v)} THEN n END) AS share{i}"
            for i, (c, v) in enumerate(wide)
        ]
        counts += [
            f"count(DISTINCT CASE WHEN column = {value_of(c)} THEN category END) AS {name_of(n)}"
            for n, c in (distinct or {}).items()
        ]
        out = numbers
        if counts and not self.store.has(self.counts):
            nothing = [f"CAST(NULL AS BIGINT) AS {e.rsplit(' AS ', 1)[1]}" for e in counts]
            out = numbers.selectExpr("*", *nothing)
        elif counts:
            found = keep(self.store.read(self.counts)).groupBy(name_of(self.key))
            out = numbers.join(found.agg(*[F.expr(e) for e in counts]), self.key, "left")
        name = share_name or (lambda column, value: f"{prefix}_{column}_{value}")
        made = [(name(c, v), f"coalesce(share{i}, 0) / `rows`") for i, (c, v) in enumerate(wide)]
        made += [
            (f"{prefix}_{c}", f"try_divide(CAST({name_of(SUM + c)} AS DOUBLE), {name_of(COUNT + c)})") for c in columns
        ]
        made += [(f"{prefix}_{n}", e) for n, e in (extra or {}).items()]
        names = told_apart([self.key, *[n for n, _ in made]])[1:]
        return out.selectExpr(name_of(self.key), *[f"{e} AS {name_of(n)}" for n, (_, e) in zip(names, made)])


def sum_in(column: str) -> str:
    """The sum of a column in a state."""
    return f"coalesce({name_of(SUM + column)}, 0)"


def count_in(column: str) -> str:
    """The number of values of a column in a state."""
    return f"coalesce({name_of(COUNT + column)}, 0L)"
