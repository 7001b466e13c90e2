"""Median imputation and min-max scaling, fitted and applied."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import isinf

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowloom.functions import fill_missing, name_of, numeric_columns, require_columns, value_of
from rowloom.operators.select import with_derived
from rowloom.operators.sketch import approx_medians
from rowloom.session import remove_folder, work_folder, written

SKETCH_ACCURACY = 1_000  # relative rank error of a pivot is about 1 / accuracy
SKETCH_GROUPS = 32  # groups of map tasks that each propose pivots


@dataclass(frozen=True)
class ScaleParams:
    median: float
    min: float
    max: float


@dataclass
class _Search:
    """An open value interval known to hold the wanted rank."""

    rank: int  # 0-based rank over all non-missing values
    inside: int  # values inside the interval
    below: int = 0  # values at or under its lower end
    low: float | None = None
    high: float | None = None

    def inside_only(self, e: str) -> str:
        ends = [f"{e} IS NOT NULL"]
        if self.low is not None:
            ends.append(f"{e} > {value_of(self.low)}")
        if self.high is not None:
            ends.append(f"{e} < {value_of(self.high)}")
        return f"CASE WHEN {' AND '.join(ends)} THEN {e} END"

    def pivots(self, e: str, accuracy: int) -> str:
        middle = (self.rank - self.below + 0.5) / self.inside
        step = 2.0 / accuracy
        near = [min(1.0, max(0.0, f)) for f in (middle - step, middle, middle + step)]
        listed = ", ".join(value_of(f) for f in near)
        return f"percentile_approx({self.inside_only(e)}, array({listed}), {accuracy})"


def _spread(values: list[float]) -> list[float]:
    """The lowest, quartile and highest of what groups of tasks propose."""
    ranked = sorted(values)
    return sorted({ranked[round(q * (len(ranked) - 1) / 4)] for q in range(5)})


def _doubles(names: Sequence[str]) -> dict[str, str]:
    return {n: f"CAST({name_of(n)} AS DOUBLE)" for n in names}


def exact_medians(
    df: DataFrame, counts: Mapping[str, int], accuracy: int = SKETCH_ACCURACY
) -> dict[str, float]:
    """Exact medians (mean of the middle two) of many columns. Runs jobs.

    ``counts`` holds the non-missing count of every column. Groups of map
    tasks propose values around the middle, each from a small quantile sketch
    of its own rows; one more pass counts how many rows lie under each value,
    and the interval shrinks until a proposed value is the wanted rank. The
    counts make the result exact, whatever the sketches propose. All columns
    share the passes; a pass returns one small row, or one for each group.
    After the first two passes only the values in an open interval, about one
    in 500, are written and read again.
    """
    values = _doubles(list(counts))
    searching = {n: _Search(rank=(k - 1) // 2, inside=k) for n, k in counts.items() if k}
    lower: dict[str, float] = {}
    upper: dict[str, float] = {}
    rows, folders = df, []
    offset = dict.fromkeys(searching, 0)  # values under those in the rows
    while searching:
        names = list(searching)
        proposed = (
            rows.groupBy(F.expr(f"pmod(spark_partition_id(), {SKETCH_GROUPS})").alias("tasks"))
            .agg(*[F.expr(f"{searching[n].pivots(values[n], accuracy)} AS p{i}") for i, n in enumerate(names)])
            .collect()
        )
        pivots = {
            n: _spread([v for r in proposed for v in r[f"p{i}"] or []])
            for i, n in enumerate(names)
        }
        counted = rows.selectExpr(
            *[
                f"count_if({values[n]} {sign} {value_of(p)}) AS {side}{i}_{j}"
                for i, n in enumerate(names)
                for j, p in enumerate(pivots[n])
                for side, sign in (("u", "<"), ("t", "<="))
            ]
        ).head()
        for i, n in enumerate(names):
            s = searching[n]
            under_high = s.below + s.inside
            for j, p in enumerate(pivots[n]):
                under, upto = (counted[f"{side}{i}_{j}"] + offset[n] for side in "ut")
                if under <= s.rank < upto:
                    lower[n] = p
                    if counts[n] % 2 or s.rank + 1 < upto:
                        upper[n] = p
                    del searching[n]
                    break
                if upto <= s.rank:
                    s.low, s.below = p, upto
                else:
                    s.high, under_high = p, under
                    break
            if n in searching:
                s.inside = under_high - s.below
                offset[n] = s.below
        if searching:
            folders.append(work_folder(df.sparkSession, "medians"))
            inside = rows.selectExpr(*[f"{s.inside_only(values[n])} AS {name_of(n)}" for n, s in searching.items()])
            some = " OR ".join(f"{name_of(n)} IS NOT NULL" for n in searching)
            rows = written(inside.where(some), "medians", folders[-1])
    for folder in folders:
        remove_folder(df.sparkSession, folder)
    open_ends = [n for n in lower if n not in upper]
    if open_ends:
        row = df.selectExpr(
            *[
                f"min(CASE WHEN {values[n]} > {value_of(lower[n])} THEN {values[n]} END)"
                for n in open_ends
            ]
        ).head()
        upper.update(zip(open_ends, row))
    return {n: (lower[n] + upper[n]) / 2.0 for n in lower}


def fit_impute_scale(
    df: DataFrame,
    key: str,
    columns: Sequence[str] | None = None,
    accuracy: int = SKETCH_ACCURACY,
    approx: int | None = None,
) -> dict[str, ScaleParams]:
    """Median, minimum and maximum of every numeric and boolean column but the key.

    Runs jobs. The plan of the table is computed once: its columns are written
    as doubles, and all passes read these. A median lies between minimum
    and maximum, so both are the same before and after imputing. Columns of
    zeros and ones, such as one-hot columns and flags, have their median read
    off the first pass, which counts the ones. With ``approx``, the size of a
    quantile sketch, the other medians come from one pass and are as near as
    `rank_error` says; without it they are exact.
    """
    names = numeric_columns(df, [key], booleans=True) if columns is None else list(columns)
    require_columns(df, names)
    values = _doubles(names)
    spark, folder = df.sparkSession, work_folder(df.sparkSession, "fit")
    df = written(df.selectExpr(*[f"{values[n]} AS {name_of(n)}" for n in names]), "fit", folder)
    try:
        return _fit(df, names, accuracy, approx)
    finally:
        remove_folder(spark, folder)


def _fit(df: DataFrame, names: list[str], accuracy: int, approx: int | None) -> dict[str, ScaleParams]:
    values = _doubles(names)
    first = [("count", "n"), ("min", "lo"), ("max", "hi")]
    row = df.selectExpr(
        *[
            f"{f}({values[n]}) AS {tag}{i}" for i, n in enumerate(names) for f, tag in first
        ],
        *[f"count_if({values[n]} = 1D) AS one{i}" for i, n in enumerate(names)],
        *[f"count_if({values[n]} NOT IN (0D, 1D)) AS odd{i}" for i, n in enumerate(names)],
    ).head()
    counts = {n: row[f"n{i}"] for i, n in enumerate(names)}
    empty = [n for n, k in counts.items() if not k]
    if empty:
        raise ValueError(f"no value to take a median from: {', '.join(empty)}")
    endless = [
        n for i, n in enumerate(names) if isinf(row[f"lo{i}"]) or isinf(row[f"hi{i}"])
    ]
    if endless:
        raise ValueError(f"infinite values cannot be scaled: {', '.join(endless)}")
    medians = {
        n: 0.5 * ((2 * row[f"one{i}"] > counts[n]) + (2 * row[f"one{i}"] >= counts[n]))
        for i, n in enumerate(names)
        if not row[f"odd{i}"]
    }
    others = {n: k for n, k in counts.items() if n not in medians}
    if others:
        medians |= approx_medians(df, list(others), approx) if approx else exact_medians(df, others, accuracy)
    return {
        n: ScaleParams(medians[n], row[f"lo{i}"], row[f"hi{i}"]) for i, n in enumerate(names)
    }


def imputed(e: str, p: ScaleParams) -> str:
    return fill_missing(f"CAST({e} AS DOUBLE)", p.median)


def scaled(e: str, p: ScaleParams) -> str:
    """Map the fitted range to [0, 1] without clipping; a constant maps to 0."""
    width = p.max - p.min
    return f"({e} - {value_of(p.min)}) / {value_of(width if width else 1.0)}"


def impute_scale(df: DataFrame, params: Mapping[str, ScaleParams]) -> DataFrame:
    """Impute then scale the fitted columns; the others, such as the key, stay."""
    require_columns(df, params)
    return with_derived(
        df, {c: scaled(imputed(name_of(c), p), p) for c, p in params.items()}
    )
