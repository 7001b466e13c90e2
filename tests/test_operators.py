"""Operators against literal rows and against brute force."""

from __future__ import annotations

import statistics

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rowloom import operators as op
from rowloom.operators.encode import _long_categories
from rowloom.operators.joins import Requested
from rowloom.operators.scale import fit_impute_scale


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_aggregate_null_rules(spark):
    df = spark.createDataFrame(
        [(1, None, "a"), (1, None, None), (2, 2.0, "a"), (2, 4.0, "b"), (None, 9.0, "a")],
        "k int, x double, s string",
    )
    got = op.aggregate_by(
        df,
        "k",
        {
            "n": op.count_of("x"),
            "total": op.sum_of(df, "x"),
            "mean": op.mean_of(df, "x"),
            "kinds": op.distinct_of("s"),
            "known": op.distinct_from_categories("s", ["a", "b", "c"]),
            "share": op.share_of("s", "a"),
        },
    )
    assert rows(got) == [(1, 0, 0.0, None, 1, 1, 0.5), (2, 2, 6.0, 3.0, 2, 2, 0.5)]


def test_sum_keeps_whole_numbers_and_decimals(spark):
    df = spark.createDataFrame([(1, None, None)], "k int, n int, m decimal(10,2)")
    got = op.aggregate_by(df, "k", {c: op.sum_of(df, c) for c in ("n", "m")}).head()
    assert (got["n"], float(got["m"])) == (0, 0.0)
    assert isinstance(got["n"], int)


def test_mean_of_decimals_is_exact(spark):
    df = spark.sql("SELECT 1 AS k, explode(array(0.10BD, 0.20BD, 0.30BD)) AS m")
    assert op.aggregate_by(df, "k", {"m": op.mean_of(df, "m")}).head()["m"] == 0.6 / 3


def skewed(spark, n: int = 3000):
    """A third of the rows on one key, a third on no key, the rest spread."""
    return spark.range(n).selectExpr(
        "CASE id % 3 WHEN 0 THEN 7L WHEN 1 THEN NULL ELSE id END AS k", "id AS v"
    )


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_equals_plain_join(spark, how):
    left = skewed(spark)
    right = spark.range(0, 3000, 2).selectExpr("id AS k", "id * 10 AS w").unionAll(
        spark.sql("SELECT 7L AS k, 70L AS w")
    )
    plain = left.join(right, "k", how)
    assert rows(op.lookup_join(left, right, "k", how)) == rows(plain)


def test_attach_group_aggregates(spark):
    got = op.attach_group_aggregates(skewed(spark), "k", {"n": "count(1)"})
    counted = {(r["k"], r["n"]) for r in got.collect()}
    assert got.count() == 3000
    assert (7, 1000) in counted and (None, None) in counted and (8, 1) in counted


def test_requests_by_list_or_table(spark):
    df = spark.range(100).toDF("k")
    asked = spark.createDataFrame([(3,), (5,), (5,), (None,), (500,), (7,), (8,)], "k long")
    wanted = Requested(asked, "k")
    assert rows(wanted.keep(df)) == [(3,), (5,), (7,), (8,)]
    assert rows(op.keep_requested(df, [8, 3, 3, None, 500], "k")) == [(3,), (8,)]
    assert rows(op.keep_requested(df, [], "k")) == []
    assert rows(op.keep_requested(df, asked.limit(0), "k")) == []


def test_few_requests_reach_the_scan(spark, tmp_path):
    spark.range(1000).toDF("k").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    kept = op.keep_requested(df, [3, 5], "k")
    text = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(k, [3,5])]" in text and "Join" not in text


def test_unknown_requests(spark):
    asked = spark.createDataFrame([(1,), (50,), (50,)], "k long")
    assert rows(op.unknown_requests(asked, spark.range(10).toDF("k"), "k")) == [(50,), (50,)]


def test_left_join_zero_fill(spark):
    entity = spark.range(3).toDF("k")
    agg = spark.createDataFrame([(1, float("nan"), 4), (2, float("inf"), None)], "k long, x double, n int")
    got = op.left_join_zero_fill(entity, agg, "k")
    assert rows(got) == [(0, 0.0, 0.0), (1, 0.0, 4.0), (2, float("inf"), 0.0)]


def test_id_rules(spark):
    raw = spark.createDataFrame(
        [("100002",), ("456255",), ("100001",), ("456256",), ("x",), (None,), ("1e5",)], "raw string"
    )
    good, bad = op.check_ids(raw, "raw", "id", 100002, 456255)
    assert rows(good.select("id")) == [(100002,), (456255,)]
    assert bad.count() == 5 and bad.columns == ["raw"]


def test_texts_that_are_no_number_are_not_cast(spark):
    texts = [
        "7", " 7 ", "\t7\n", "\u00017\u007f", "+7", "-7", "007", "0" * 30 + "7", "2147483647", "2147483648", "9" * 10, "9" * 30,
        "", " ", "+", "-", "7 7", "+ 7", "--7", "7.0", "7e0", "1-URGENT", "seven", "\u0667", "\u00a07", "7L", "0x7", None,
    ]
    raw = spark.createDataFrame([(t,) for t in texts], "raw string")
    good, bad = op.check_ids(raw, "raw", "id", -2147483648, 2147483647)
    want = raw.selectExpr("raw", "try_cast(raw AS INT) AS id").where("id IS NOT NULL")
    assert rows(good) == rows(want) and good.count() + bad.count() == len(texts)
    assert "RLIKE" in bad._jdf.queryExecution().optimizedPlan().toString()


def test_one_hot_rules(spark):
    fitted = spark.createDataFrame([("b", "x/ y"), ("a", None), ("b", "z")], "s string, t string")
    categories = op.fit_categories(fitted)
    assert categories == {"s": ["a", "b"], "t": ["x/ y", "z"]}
    later = spark.createDataFrame([(1, "b", "z"), (2, "new", None)], "k int, s string, t string")
    got = op.one_hot(later, categories)
    assert got.columns == ["k", "s_a", "s_b", "t_x/ y", "t_z"]
    assert rows(got) == [(1, 0, 1, 0, 1), (2, 0, 0, 0, 0)]


def test_too_many_categories_is_an_error(spark):
    wide = spark.range(50).selectExpr("CAST(id AS STRING) AS s", "'one' AS t")
    with pytest.raises(ValueError, match=r"more than 10 categories in: \.s"):
        op.fit_categories(wide, max_categories=10)


def test_long_shares_of_a_hot_key_with_many_categories(spark):
    df = spark.range(2000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 1L ELSE id END AS k", "CAST(id AS STRING) AS s"
    )
    got = op.category_share_long(df, "k", ["s"])
    per_key = {r["k"]: r["total"] for r in got.groupBy("k").agg({"share": "sum"}).toDF("k", "total").collect()}
    assert got.count() == 2000 and len(per_key) == 1000
    assert all(v == pytest.approx(1.0) for v in per_key.values())


def test_rollup_names_and_collisions(spark):
    df = spark.createDataFrame(
        [(1, 10, "x", "x", 2.0), (1, 11, None, "y", None)], "k int, id int, s string, t string, v double"
    )
    got = op.rollup_child(df, "k", "P", drop=["id"])
    assert got.columns == ["k", "P_s_x", "P_t_x", "P_t_y", "P_v"]
    assert rows(got) == [(1, 0.5, 0.5, 0.5, 2.0)]
    with pytest.raises(ValueError, match="P_x"):
        op.rollup_child(df, "k", "P", share_name=lambda column, value: f"P_{value}")


def test_shares_of_a_full_column_sum_to_one(spark):
    df = spark.range(500).selectExpr("id % 7 AS k", "CAST(id % 5 AS STRING) AS s")
    got = op.rollup_child(df, "k", "P")
    assert all(sum(r[1:]) == pytest.approx(1.0) for r in got.collect())


# Scaling ---------------------------------------------------------------------


def test_scaling_rules(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 5.0, True), (2, 10.0, 5.0, False), (3, None, None, None)],
        "k int, x double, same double, b boolean",
    )
    params = fit_impute_scale(df, "k")
    assert params["x"].median == 5.0 and params["b"].max == 1.0
    assert rows(op.impute_scale(df, params)) == [
        (1, 0.0, 0.0, 1.0),
        (2, 1.0, 0.0, 0.0),
        (3, 0.5, 0.0, 0.5),
    ]
    later = spark.createDataFrame([(4, 20.0, 6.0, True)], df.schema)
    assert rows(op.impute_scale(later, params)) == [(4, 2.0, 1.0, 1.0)]


def test_scaling_refuses_what_it_cannot_fit(spark):
    df = spark.createDataFrame([(1, None, float("inf"))], "k int, empty double, endless double")
    with pytest.raises(ValueError, match="empty"):
        fit_impute_scale(df, "k")
    with pytest.raises(ValueError, match="endless"):
        fit_impute_scale(df.drop("empty"), "k")


def test_medians_merge_no_sketch_in_one_task(spark, tmp_path):
    df = spark.range(0, 5000, 1, 16).selectExpr("0 AS k", "CAST(id AS DOUBLE) AS x", "id % 3 = 0 AS f")
    from rowloom.operators import scale

    plans = []
    collect = type(df).collect
    def spy(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    type(df).collect = spy
    try:
        found = fit_impute_scale(df, "k")
    finally:
        type(df).collect = collect
    assert found["x"].median == 2499.5 and found["f"].median == 0.0
    sketches = [p for p in plans if "percentile_approx" in p]
    assert sketches and all("SinglePartition" not in p for p in sketches)
    assert "CAST(f" not in " ".join(sketches) and scale.SKETCH_GROUPS > 1


def test_names_that_differ_in_case(spark):
    df = spark.createDataFrame([(1, "Cash"), (1, "cash"), (2, "Cash")], "k long, s string")
    found = op.one_hot(df, op.fit_categories(df))
    assert found.columns == ["k", "s_Cash", "s_cash_2"] and found.select("s_cash_2").count() == 3
    shares = op.rollup_child(df, "k", "P")
    entity = spark.range(3).toDF("k")
    assert rows(op.left_join_zero_fill(entity, shares, "k")) == [(0, 0, 0), (1, 0.5, 0.5), (2, 1, 0)]
    assert op.one_hot(df, {"s": ["Cash"]}, prefix="Z").columns == ["k", "Z_Cash"]


def test_boolean_columns_are_rolled_up(spark):
    df = spark.createDataFrame([(1, True), (1, False), (2, None)], "k long, f boolean")
    assert rows(op.rollup_child(df, "k", "P")) == [(1, 0.5), (2, None)]
    assert op.rollup_child(op.narrow(df), "k", "P").columns == ["k", "P_f"]


def test_a_key_of_few_rows_is_split(spark):
    """With low thresholds a key at 0.5 % of the rows makes a skewed join."""
    low = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "400",
    }
    before = {k: spark.conf.get(k) for k in low}
    for k, v in low.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 200_000, 1, 8).selectExpr("CASE WHEN id % 200 = 0 THEN -1L ELSE id END AS k")
        got = op.attach_group_aggregates(df, "k", {"n": "count(1)"})
        assert got.where("k = -1 AND n = 1000").count() == 1000
        got.collect()
        assert "skew=true" in got._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_median_of_even_count(spark):
    df = spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0)], "x double")
    assert op.exact_medians(df, {"x": 4}) == {"x": 2.5}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    data=st.lists(
        st.one_of(st.sampled_from([1.0, 2.0, -3.5]), st.floats(-1e6, 1e6)), min_size=1, max_size=400
    ),
    accuracy=st.sampled_from([4, 10, 100]),
)
def test_narrowed_median_is_exact(spark, data, accuracy):
    df = spark.createDataFrame([(v, -v) for v in data], "x double, y double")
    counts = {"x": len(data), "y": len(data)}
    got = op.exact_medians(df, counts, accuracy=accuracy)
    assert got["x"] == statistics.median(data)
    assert got["y"] == statistics.median(-v for v in data)


# Narrowing -------------------------------------------------------------------


def test_narrow_types(spark):
    df = spark.createDataFrame(
        [(126, 127, 40000, 5_000_000_000, 1.5, 1e300, None, True, "s")],
        "a int, b int, c long, d long, e double, f double, g double, h boolean, i string",
    )
    types = {c: t.simpleString() for c, t in op.narrow_types(df).items()}
    assert types == {
        "a": "tinyint", "b": "smallint", "c": "int", "d": "bigint",
        "e": "float", "f": "double", "g": "double", "h": "float",
    }
    assert tuple(op.narrow(df).head()) == tuple(df.head())
    report = op.memory_report(df, op.narrow(df), "t").head()
    assert (report["before_bytes"], report["after_bytes"]) == (57, 47)


def test_projection(spark):
    df = spark.createDataFrame([(1, 2, "x")], "k int, v int, s string")
    assert op.prefix_columns(df, "T", "k").columns == ["k", "T_v", "T_s"]
    assert op.select_named(df, ["s", "k"]).columns == ["s", "k"]
    with pytest.raises(ValueError, match="missing columns: no, nor"):
        op.select_named(df, ["no", "k", "nor"])
    with pytest.raises(ValueError, match="more than once: s"):
        op.rename_columns(df, {"v": "s"})
    assert op.cast_to_category(df, ["v"]).dtypes[1] == ("v", "string")
    features, labels = op.split_label(df, "k", "v")
    assert features.columns == ["k", "s"] and labels.columns == ["k", "v"]
    assert op.with_derived(df, {"v": "v + 1", "w": "v"}).head()[1:] == (3, "x", 2)
    assert op.peek(df, "k").count() == 1
    assert op.lookup(df, "k", 1).count() == 1
    assert op.shape_report(df, "t").head()[:] == ("t", 1, 3)


def test_categories_are_found_in_distinct_rows(spark):
    df = spark.createDataFrame([("a", "x"), ("a", None), (None, "y"), ("b", "x")] * 50, "s string, t string")
    assert op.fit_categories(df) == {"s": ["a", "b"], "t": ["x", "y"]}
    plan = _long_categories(df, ["s", "t"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Expand") < plan.index("Aggregate")  # the rows are grouped below the expansion
