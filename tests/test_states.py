"""What is kept and added to: roll-up states, sketches, upserts, refreshed features."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.views import bundle
from rowloom import operators as op
from rowloom.operators.state import count_in, sum_in, summed
from rowloom.plans import build, incremental
from rowloom.plans import domain as d
from rowloom.plans.incremental import HistoryState, refresh
from rowloom.plans.params import MAIN
from rowloom.session import written
from rowloom.sources import BatchStore, PartitionedTable, upsert
from rowloom.sources.upsert import PART


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


def near(a: list[tuple], b: list[tuple]) -> bool:
    """Equal rows, doubles to twelve digits."""

    def same(x, y):
        if isinstance(x, float) and isinstance(y, float):
            return math.isclose(x, y, rel_tol=1e-12, abs_tol=1e-12) or x == y or (x != x and y != y)
        return x == y

    return len(a) == len(b) and all(len(r) == len(s) and all(map(same, r, s)) for r, s in zip(a, b))


# Batches ---------------------------------------------------------------------


def test_a_batch_counts_once(spark, tmp_path):
    store = BatchStore(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1,)], "a int")
    assert store.live() == {} and store.added() == []
    # A writer that was stopped before the log: its files don't count and are replaced.
    one.union(one).write.parquet(f"{store.path}/t/b1")
    assert store.live() == {}
    assert store.add("b1", {"t": one})
    assert not store.add("b1", {"t": one.union(one)})
    assert rows(store.read("t")) == [(1,)]
    assert store.add("b2", {"t": spark.createDataFrame([(2, "x")], "a int, b string")})
    assert rows(store.read("t")) == [(1, None), (2, "x")]
    assert store.add("all", {"t": store.read("t")}, replaces=["b1", "b2"])
    assert store.live() == {"all": ["t"]} and store.has("t") and not store.has("u")
    assert rows(store.read("t")) == [(1, None), (2, "x")]
    assert not store.add("b2", {"t": one})  # merged since
    for bad in ("", "a/b", "_x", ".x"):
        with pytest.raises(ValueError):
            store.add(bad, {"t": one})
    for gone in ([], ["b1"], ["never"]):
        with pytest.raises(ValueError):
            store.read("t", gone)
    with pytest.raises(ValueError):
        store.read("u")


# Roll-ups --------------------------------------------------------------------

CHILD = "k long, loan long, kind string, state string, i int, l long, x double, m decimal(12,2), f boolean"


def child_rows():
    out = []
    for i in range(300):
        k = 7 if i % 3 == 0 else i % 11  # a third of the rows has one key
        out.append(
            (
                None if i % 50 == 49 else k,
                i,
                None if i % 5 == 0 else f"kind {i % 4}",
                "a'b`c" if i % 2 else "é",
                None if i % 7 == 0 else i - 150,
                None if i % 13 == 0 else 9_000_000_000_000_000_000 - i,
                None if i % 6 == 0 else i / 7,
                None if i % 4 == 0 else Decimal(i * 100 + 33) / 100,
                None if i % 9 == 0 else i % 2 == 0,
            )
        )
    return out


@pytest.mark.parametrize("compacted", [False, True])
def test_a_state_equals_the_full_rollup(spark, tmp_path, compacted):
    whole = spark.createDataFrame(child_rows(), CHILD)
    state = op.RollupState(BatchStore(spark, str(tmp_path / "s")), "k")
    for part in range(3):
        state.add(f"b{part}", whole.where(f"loan % 3 = {part}"), drop=["loan"], counted=["loan"])
        assert not state.add(f"b{part}", whole, drop=["loan"])
    if compacted:
        state.compact("c1")
        assert list(state.store.live()) == ["c1"]
    # Sums of whole numbers near the largest long don't overflow, as doubles they lose digits.
    exact = op.rollup_child(whole.drop("l"), "k", "P", drop=["loan"])
    got = state.rollup("P").select(*[c.replace("`", "``").join("``") for c in exact.columns])
    assert near(rows(got), rows(exact))
    means = dict(rows(state.rollup("P").select("k", "P_l")))
    assert all(v == pytest.approx(9e18, rel=1e-15) for v in means.values())
    assert state.categories() == {"kind": [f"kind {i}" for i in range(4)], "state": ["a'b`c", "é"]}
    some = state.rollup(
        "P", {}, extra={"n": count_in("loan"), "s": sum_in("i"), "kinds": "kinds"}, distinct={"kinds": "kind"}
    )
    wanted = whole.where("k IS NOT NULL").groupBy("k").agg(F.expr("count(loan)"), F.expr("sum(i)"), F.expr("count(DISTINCT kind)"))
    assert rows(some.select("k", "P_n", "P_s", "P_kinds")) == rows(wanted)


def test_states_of_missing_infinite_and_new_columns(spark, tmp_path):
    state = op.RollupState(BatchStore(spark, str(tmp_path / "s")), "k")
    inf = float("inf")
    state.add("a", spark.createDataFrame([(1, inf, None), (2, None, None), (None, 1.0, "z")], "k int, x double, t string"))
    state.add("b", spark.createDataFrame([(1, -inf, 5), (3, 2.0, 7)], "k int, x double, y int"))
    state.add("c", spark.createDataFrame([], "k int, x double, y int"))
    got = {r["k"]: r for r in state.rollup("P").collect()}
    assert set(got) == {1, 2, 3}
    assert math.isnan(got[1]["P_x"]) and got[2]["P_x"] is None and got[3]["P_x"] == 2.0
    assert (got[1]["P_y"], got[2]["P_y"], got[3]["P_y"]) == (5.0, None, 7.0)
    assert sorted(r["k"] for r in state.changed(["b"]).collect()) == [1, 3]
    wanted = op.Requested([1, 9], "k")
    assert [r["k"] for r in state.rollup("P", keys=wanted).collect()] == [1]


def test_a_state_reads_no_old_rows(spark, tmp_path):
    """The plan of a roll-up has the state's files and one grouping of each table."""
    state = op.RollupState(BatchStore(spark, str(tmp_path / "s")), "k")
    state.add("a", spark.createDataFrame(child_rows(), CHILD), drop=["loan"])
    plan = state.rollup("P", {"kind": ["kind 1"]})._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and "Window" not in plan
    files = state.rollup("P", {"kind": ["kind 1"]}).inputFiles()
    assert files and all("/numbers/a/" in f or "/categories/a/" in f for f in files)


# Sketches --------------------------------------------------------------------


def test_medians_by_sketch_are_near(spark):
    df = spark.range(200_000, numPartitions=40).selectExpr(
        "id AS a", "CASE WHEN id % 3 = 0 THEN NULL ELSE id * 1.5D END AS b", "CAST(NULL AS DOUBLE) AS c", "7 AS e"
    )
    found = op.approx_medians(df, ["a", "b", "c", "e"])
    slack = 3 * op.rank_error()
    assert abs(found["a"] / 200_000 - 0.5) < slack and abs(found["b"] / 300_000 - 0.5) < slack
    assert found["e"] == 7.0 and "c" not in found
    # Sketches of two inputs merge to that of both.
    halves = op.quantile_sketches(df.where("a < 100000"), ["a"]).union(op.quantile_sketches(df.where("a >= 100000"), ["a"]))
    row = op.quantiles(op.merge_quantiles(halves), [0.25, 0.75]).head()
    assert row["n"] == 200_000
    assert all(abs(v / 200_000 - q) < slack for v, q in zip(row["values"], (0.25, 0.75)))
    assert op.approx_medians(df, []) == {}


def test_scaling_with_approximate_medians(spark):
    df = spark.range(50_000).selectExpr("id AS k", "id % 1000 AS a", "CAST(id % 4 = 0 AS INT) AS flag")
    exact, fast = op.fit_impute_scale(df, "k"), op.fit_impute_scale(df, "k", approx=4000)
    assert exact["flag"] == fast["flag"]
    assert (exact["a"].min, exact["a"].max) == (fast["a"].min, fast["a"].max)
    assert abs(exact["a"].median - fast["a"].median) <= 1000 * 3 * op.rank_error() + 1


def test_distinct_counts_merge(spark, tmp_path):
    df = spark.range(60_000).selectExpr(
        "id % 3 AS g", "id", "CAST(id % 50 AS STRING) AS few", "CAST(NULL AS INT) AS none", "id % 2 = 0 AS flag"
    )
    state = op.DistinctState(BatchStore(spark, str(tmp_path / "s")), ["g"])
    columns = ["id", "few", "none", "flag"]
    state.add("a", df.where("id < 40000"), columns)
    state.add("b", df.where("id >= 20000"), columns)  # a third of the rows in both
    state.add("b", df, columns)
    before = {r["g"]: r for r in state.counts().collect()}
    state.compact("merged")
    after = {r["g"]: r for r in state.counts().collect()}
    assert set(before) == {0, 1, 2} and list(state.store.live()) == ["merged"]
    for found in (before, after):
        for r in found.values():
            assert abs(r["id"] - 20_000) <= 3 * op.distinct_error() * 20_000
            assert (r["few"], r["none"], r["flag"]) == (50, 0, 2)


# Upserts ---------------------------------------------------------------------


def files_of(path) -> dict[str, tuple]:
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.startswith("part-") and f"{PART}=" in folder:
                at = os.path.join(folder, n)
                out[at] = (os.stat(at).st_mtime_ns, os.stat(at).st_size)
    return out


def test_sums_of_bigints_are_exact_without_a_decimal_for_every_row(spark):
    top = 2**63 - 1
    wanted = [top, top, top, -top - 1, -1, 0, 4294967295, -4294967296, 7, None]
    df = spark.createDataFrame([(1, v) for v in wanted] + [(2, None)], "k long, v long")
    out = df.groupBy("k").agg(F.expr(f"{summed(df, 'v')} AS s"))
    assert rows(out) == [(1, Decimal(sum(v for v in wanted if v is not None))), (2, Decimal(0))]
    assert out.schema["s"].dataType.simpleString() == "decimal(38,0)"
    partial = out._jdf.queryExecution().executedPlan().toString().split("partial_sum")[1:]
    assert partial and not any("decimal" in p.split(")")[0].lower() for p in partial)


def test_a_refresh_writes_the_changes_once_besides_the_table(spark, tmp_path, parts, monkeypatch):
    tables, first, second, params = parts
    state = HistoryState(spark, str(tmp_path / "state"))
    state.add("first", first)
    table = PartitionedTable(spark, str(tmp_path / "features"), d.CUSTOMER, parts=4)
    table.write(state.features(tables[MAIN], params))
    state.add("second", second)
    wide = []

    def counted(df, label, path=None):
        if len(df.columns) > 20:
            wide.append(label)
        return written(df, label, path)

    for module in (upsert, incremental):
        monkeypatch.setattr(module, "written", counted)
    refresh(table, state, "second", tables[MAIN], params)
    assert wide == ["changes"]


def test_upsert_equals_a_rebuild_and_leaves_other_files(spark, tmp_path):
    path = str(tmp_path / "t")
    table = PartitionedTable(spark, path, "k", parts=8)
    old = spark.range(500).selectExpr("id AS k", "id * 2 AS v", "'old' AS s")
    table.write(old)
    before = files_of(path)
    assert len(before) == 8
    changes = spark.createDataFrame([(3, 33, "new"), (7_000, 1, "new"), (3, 33, "new"), (None, 1, "lost")], "k int, v int, s string")
    gone = spark.createDataFrame([(5,), (None,), (123_456,)], "k long")
    touched = PartitionedTable(spark, path, "k").upsert(changes, gone)  # the layout is found again
    after = files_of(path)
    kept = {f for f in before if int(f.split(f"{PART}=")[1].split("/")[0]) not in touched}
    assert 0 < len(touched) < 8 and kept and all(after[f] == before[f] for f in kept)
    wanted = old.where("k NOT IN (3, 5)").union(spark.createDataFrame([(3, 33, "new"), (7_000, 1, "new")], old.schema))
    assert rows(table.read()) == rows(wanted)
    assert table.upsert(changes.limit(0)) == []


def test_upsert_of_columns_and_empty_folders(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "t"), "k", parts=2)
    table.write(spark.createDataFrame([(1, 1.5), (2, 2.5)], "k long, v double"))
    table.upsert(spark.createDataFrame([(2, "x"), (3, "y")], "k long, w string"))
    again = PartitionedTable(spark, str(tmp_path / "t"), "k", parts=99)
    assert again.parts == 2
    assert rows(again.read()) == [(1, 1.5, None), (2, None, "x"), (3, None, "y")]
    again.upsert(again.read().limit(0), again.read().select("k"))
    assert rows(again.read()) == [] and files_of(tmp_path / "t") == {}
    again.upsert(spark.createDataFrame([(9, 1.0)], "k long, v double"))
    assert rows(again.read()) == [(9, 1.0, None)]
    empty = PartitionedTable(spark, str(tmp_path / "e"), "k")
    empty.write(spark.createDataFrame([], "k long, v double"))
    assert rows(PartitionedTable(spark, str(tmp_path / "e"), "k").read()) == []
    with pytest.raises(ValueError):
        PartitionedTable(spark, str(tmp_path / "n"), "k").read()


def test_a_lookup_reads_its_folders_only(spark, tmp_path):
    table = PartitionedTable(spark, str(tmp_path / "t"), "k", parts=16)
    table.write(spark.range(1000).selectExpr("id AS k", "id AS v"))
    some = table.read([4, 700, None, 4, 99_999])
    assert rows(some) == [(4, 4), (700, 700)]
    plan = some._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    assert plan.metrics().apply("numFiles").value() <= 3
    assert rows(table.read([])) == [] and table.read([None]).columns == ["k", "v"]


# The feature table -----------------------------------------------------------


@pytest.fixture(scope="module")
def parts(spark, folder):
    tables = bundle(spark, folder)
    later = {t: "SK_ID_PREV % 5 = 4 AND SK_ID_CURR % 4 = 1" for t in tables}
    later |= {"bureau": "SK_ID_BUREAU % 40 = 7", "bureau_balance": "SK_ID_BUREAU % 40 = 3"}
    history = [t for t in tables if t != MAIN]
    first = {t: tables[t].where(f"NOT ({later[t]})") for t in history}
    second = {t: tables[t].where(later[t]) for t in history}
    return tables, first, second, build.fit_params(tables)


def test_refreshed_features_equal_a_rebuild(spark, tmp_path, parts):
    tables, first, second, params = parts
    state = HistoryState(spark, str(tmp_path / "state"))
    state.add("first", first)
    table = PartitionedTable(spark, str(tmp_path / "features"), d.CUSTOMER, parts=32)
    # One customer is filtered out later, another has no application at first.
    main = tables[MAIN]
    shown = main.where("CODE_GENDER IS NOT NULL AND CODE_GENDER <> 'XNA'").orderBy(d.CUSTOMER).limit(2)
    ids = [r[d.CUSTOMER] for r in shown.collect()]
    table.write(state.features(main.where(f"{d.CUSTOMER} <> {ids[1]}"), params))
    state.add("second", second)
    now = main.withColumn("CODE_GENDER", F.expr(f"CASE WHEN {d.CUSTOMER} = {ids[0]} THEN 'XNA' ELSE CODE_GENDER END"))
    others = spark.createDataFrame([(i,) for i in ids], f"{d.CUSTOMER} long")
    refresh(table, state, "second", now, params, others)
    whole = build.build_features({**tables, MAIN: now}, params)
    got = table.read().select(*[f"`{c}`" for c in whole.columns])
    assert ids[0] not in {r[0] for r in got.select(d.CUSTOMER).collect()}
    assert near(rows(got), rows(whole))


def test_changed_customers_are_those_of_the_batch(spark, tmp_path, parts):
    tables, first, second, _ = parts
    state = HistoryState(spark, str(tmp_path / "state"))
    state.add("first", first)
    state.add("second", second)
    loans = second["bureau_balance"].select(d.BUREAU_LOAN).distinct()
    wanted = {
        r[0]
        for t, df in second.items()
        for r in (tables["bureau"].join(loans, d.BUREAU_LOAN) if t == "bureau_balance" else df).select(d.CUSTOMER).collect()
    }
    assert {r[0] for r in state.changed("second").collect()} == wanted
    assert 0 < len(wanted) < tables[MAIN].count()
    with pytest.raises(ValueError):
        state.changed("third")


def test_compacted_states_give_the_same_rollups(spark, tmp_path, parts):
    _, first, second, params = parts
    state = HistoryState(spark, str(tmp_path / "state"))
    state.add("first", first)
    state.add("second", second)
    before = {t: rows(df) for t, df in state.rollups(params).items()}
    state.compact("merged")
    assert list(state.store.live()) == ["merged"]
    assert not state.add("second", second)
    for t, df in state.rollups(params).items():
        assert near(rows(df), before[t])
