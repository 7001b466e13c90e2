"""Row-level rules: missing values, division, rounding, lookups."""

from __future__ import annotations

import math

import pytest

from rowloom import functions as fn

INF = float("inf")


def values(spark, schema: str, rows: list, expression: str) -> list:
    df = spark.createDataFrame(rows, schema).coalesce(1)
    return [r[0] for r in df.selectExpr(expression).collect()]


def test_half_even(spark):
    got = values(spark, "x double", [(0.5,), (1.5,), (2.5,), (-0.4,), (None,)], fn.half_even("x"))
    assert got == [0.0, 2.0, 2.0, 0.0, None]
    assert math.copysign(1, got[3]) == 1


def test_half_up_is_round_without_decimals(spark):
    ties = [0.5, 1.5, 2.5, -0.5, -1.5, -2.5, 0.49999999999999994, 4503599627370497.0, 1e300, -0.3, 0.0, INF, -INF]
    near = [1.00005, 2.00015, 1.23455, 1234567.89125, -1.00005, 0.00004999, 5e-324, 0.1 + 0.2, 123456789.87654]
    some = [(math.sin(i) * 10.0 ** (i % 17 - 4),) for i in range(2000)] + [(i / 32.0,) for i in range(-200, 200)]
    rows = [(x,) for x in [*ties, *near]] + some + [(None,)]
    for digits in (0, 1, 4, 8):
        got = values(spark, "x double", rows, fn.half_up("x", digits))
        assert got == values(spark, "x double", rows, f"round(x, {digits})")
        assert all(math.copysign(1, x) == 1 for x in got if x == 0)
        assert math.isnan(values(spark, "x double", [(math.nan,)], fn.half_up("x", digits))[0])
    assert "round(" not in fn.half_up("x")


def test_ieee_div(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (3.0, 2.0)]
    got = values(spark, "n double, d double", rows, fn.ieee_div("n", "d"))
    assert got == [INF, -INF, None, None, None, 1.5]


def test_ieee_div_of_integers_does_not_raise(spark):
    got = values(spark, "n int, d int", [(1, 0), (7, 2)], fn.ieee_div("n", "d"))
    assert got == [INF, 3.5]


def test_safe_ratio_guard(spark):
    assert values(spark, "n int, d int", [(3, 0)], fn.safe_ratio("n", "d", 1)) == [3.0]
    small = values(spark, "n int, d int", [(1, 0)], fn.safe_ratio("n", "d", 0.00001))
    assert small[0] == pytest.approx(100000.0)


def test_null_rules(spark):
    rows = [(31.0,), (30.0,), (None,)]
    assert values(spark, "x double", rows, fn.null_above("x", 30)) == [None, 30.0, None]
    assert values(spark, "x int", [(365243,), (5,), (None,)], fn.null_if("x", 365243)) == [
        None,
        5,
        None,
    ]
    assert values(spark, "x int", [(None,), (6,), (5,)], fn.flag("x > 5")) == [False, True, False]
    texts = [("XNA",), (None,), ("F",)]
    assert values(spark, "x string", texts, fn.unless_equal("x", "XNA")) == [False, True, True]
    assert values(spark, "x string", texts, fn.fill_missing("x", "XNA")) == ["XNA", "XNA", "F"]


def test_infinities_and_nan(spark):
    rows = [(INF,), (-INF,), (float("nan"),), (None,), (2.0,)]
    assert values(spark, "x double", rows, fn.zero_fill("x")) == [INF, -INF, 0.0, 0.0, 2.0]
    assert values(spark, "x double", rows[:2] + rows[4:], fn.inf_to("x", 0.0)) == [0.0, 0.0, 2.0]
    assert values(spark, "x double", [(INF,), (-INF,)], f"{fn.zero_fill('avg(x)')}") == [0.0]
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, "b")], "x double, s string")
    cleaned = fn.nan_to_null(df)
    assert {tuple(r) for r in cleaned.collect()} == {(None, "a"), (1.0, "b")}


def test_map_values(spark):
    weights = {"C": 0, "0": 1, "1": 2, "2": 3, "X": 4, "3": 5, "4": 6, "5": 7}
    rows = [("C",), ("X",), ("9",), (None,)]
    assert values(spark, "s string", rows, fn.map_values("s", weights)) == [0, 4, None, None]


def test_threshold_is_exclusive(spark):
    rows = [(0.5,), (0.500001,), (0.1,), (float("nan"),), (None,)]
    assert values(spark, "p double", rows, fn.class_of("p", 0.5)) == [0, 1, 0, 0, None]


@pytest.mark.parametrize(
    "value", ["it's", "back\\slash", "a`b", "{x}", "é\n", 1e-300, 0.1, -2.5, 10**12, True, INF]
)
def test_constants_survive_as_text(spark, value):
    assert spark.range(1).selectExpr(fn.value_of(value)).head()[0] == value


def test_unusual_column_names(spark):
    name = "a.b / `c` {d}"
    df = spark.createDataFrame([(1,)], "x int").withColumnRenamed("x", name)
    assert df.selectExpr(f"{fn.name_of(name)} + 1").head()[0] == 2


def test_narrow_operands_do_not_overflow(spark):
    df = spark.createDataFrame([(100, 100)], "a tinyint, b tinyint")
    both = f"{fn.operand(df, 'a')} + {fn.operand(df, 'b')}"
    assert df.selectExpr(both).head()[0] == 200


def test_column_lists(spark):
    df = spark.createDataFrame([], "a string, b int, c boolean, d decimal(9,2), e double")
    assert fn.string_columns(df) == ["a"]
    assert fn.numeric_columns(df, ["b"]) == ["d", "e"]
    assert fn.numeric_columns(df, booleans=True) == ["b", "c", "d", "e"]
    with pytest.raises(ValueError, match="y, z"):
        fn.require_columns(df, ["a", "y", "z"])
    with pytest.raises(ValueError, match="n"):
        fn.require_unique(["n", "m", "n"])
