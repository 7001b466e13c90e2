"""Arithmetic with defined results for zero denominators under ANSI mode."""

from __future__ import annotations

from rowloom.functions.columns import value_of


def ieee_div(numerator: str, denominator: str) -> str:
    """Division where x/0 is a signed infinity and 0/0 is NULL."""
    n, d = f"CAST({numerator} AS DOUBLE)", f"CAST({denominator} AS DOUBLE)"
    plus, minus = value_of(float("inf")), value_of(float("-inf"))
    return (
        f"CASE WHEN {d} <> 0.0D THEN {n} / {d} WHEN {d} IS NULL THEN NULL"
        f" WHEN {n} > 0.0D THEN {plus} WHEN {n} < 0.0D THEN {minus} END"
    )


def safe_ratio(numerator: str, denominator: str, guard: float) -> str:
    """Ratio whose denominator is moved away from zero by a small constant."""
    return ieee_div(numerator, f"(CAST({denominator} AS DOUBLE) + {value_of(float(guard))})")


def half_even(e: str) -> str:
    """Round to an integer value, ties to even. Adding 0 drops the sign of -0."""
    return f"rint(CAST({e} AS DOUBLE)) + 0.0D"


def half_up(e: str, digits: int = 0) -> str:
    """`round` of a double, ties away from zero, without its detour over decimals.

    The same result for every value: an integer's tie is exact, and what is so
    near a tie of ``digits`` digits, or so large, that scaling might decide it
    wrongly is left to `round`. Adding 0 drops the sign of -0.
    """
    v = f"CAST({e} AS DOUBLE)"
    if not digits:
        tie = f"{v} - rint({v})"
        return (
            f"rint({v}) + CASE WHEN {v} > 0.0D AND {tie} = 0.5D THEN 1.0D"
            f" WHEN {v} < 0.0D AND {tie} = -0.5D THEN -1.0D ELSE 0.0D END"
        )
    unit = value_of(float(10**digits))
    y = f"({v} * {unit})"
    return (
        f"CASE WHEN abs({y}) < 1e12D AND abs(abs({y} - rint({y})) - 0.5D) > 0.001D"
        f" THEN (rint({y}) + 0.0D) / {unit} ELSE round({v}, {digits}) END"
    )


def to_float32(e: str) -> str:
    return f"CAST({e} AS FLOAT)"


def class_of(probability: str, threshold: float) -> str:
    """1 above the threshold, else 0; 0 for NaN, NULL without a probability."""
    return (
        f"CASE WHEN {probability} IS NULL THEN NULL WHEN isnan({probability}) THEN 0"
        f" WHEN {probability} > {value_of(threshold)} THEN 1 ELSE 0 END"
    )
