"""Tree models, sparse encoding, ML stages, joined streams, file statistics."""

from __future__ import annotations

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler

from checks.views import bundle, view
from rowloom import operators as op
from rowloom.plans import build, scoring
from rowloom.plans import domain as d
from rowloom.plans.stages import PrepareApplications, PreparedApplications
from rowloom.plans.trees import Node, TreeModel, from_spark_ml
from rowloom.session import written
from rowloom.sources import footer_bounds, stored_bounds, write_features
from rowloom.streaming import joined_answers, score_requests_joined, stored_answers


def rows(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


# Trees -----------------------------------------------------------------------

SPLIT = Node(0, 0, "x", 1.0, 1, 2, True)
LEAVES = [Node(0, 1, value=1.0), Node(0, 2, value=-1.0)]


def walk(members, row):
    """A plain walk down one tree."""
    at = members[0]
    while at.feature is not None:
        x = row[at.feature]
        missing = x is None or math.isnan(x)
        at = members[at.left if (at.missing_left if missing else x < at.threshold) else at.right]
    return at.value


def grown(tree, depth, names, draw):
    nodes, counter = [], iter(range(10_000))

    def grow(level):
        at = next(counter)
        if level == depth or draw.random() < 0.1:
            nodes.append(Node(tree, at, value=draw.uniform(-1, 1)))
        else:
            left, right = grow(level + 1), grow(level + 1)
            name = draw.choice(names)
            nodes.append(Node(tree, at, name, draw.choice([0.0, 0.25, 1.0, -0.5]), left, right, draw.random() < 0.5))
        return at

    grow(0)
    return nodes


@pytest.mark.parametrize("at_once", [20, 10_000])
def test_trees_equal_a_plain_walk(spark, tmp_path, at_once):
    import random

    draw = random.Random(3)
    names = ["a", "b b", "c`d"]
    nodes = [n for t in range(25) for n in grown(t, 5, names, draw)]
    model = TreeModel(nodes, base=0.25, scale=0.5)
    model.save(spark, str(tmp_path / "m"))
    model = TreeModel.load(spark, str(tmp_path / "m"))
    values = [None, float("nan"), 0.0, -0.0, 0.25, 1.0, float("inf"), -float("inf"), -0.5, 0.7]
    data = [(i, *[draw.choice(values) for _ in names]) for i in range(400)]
    df = spark.createDataFrame(data, "id int, a double, `b b` double, `c``d` float")
    got = {r["id"]: r["prob"] for r in model.scorer(at_once)(df).collect()}
    for i, *xs in data:
        row = dict(zip(names, xs))
        total = 0.5 * (0.25 + sum(walk(members, row) for members in model.trees.values()))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-12)
    plan = model.scorer(at_once)(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_a_deep_and_wide_model_still_runs(spark):
    import random

    draw = random.Random(5)
    nodes = [n for t in range(100) for n in grown(t, 6, ["x", "y"], draw)]
    model = TreeModel(nodes, logistic=False)
    df = spark.range(50).selectExpr("id / 50D AS x", "id % 7 / 7D AS y")
    for r in model.scorer()(df).collect():
        wanted = sum(walk(m, r.asDict()) for m in model.trees.values())
        assert r["prob"] == pytest.approx(wanted, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize(
    "nodes",
    [
        [SPLIT, LEAVES[0]],  # a child is missing
        [SPLIT, *LEAVES, Node(0, 3, value=0.0)],  # not reached
        [SPLIT, Node(0, 1, "x", 2.0, 0, 2, True), LEAVES[1]],  # a cycle
        [SPLIT, SPLIT, *LEAVES],  # twice
        [Node(0, 0)],  # a leaf without a value
        [Node(0, 0, "x", None, 1, 2, True), *LEAVES],  # a split without a threshold
        [Node(0, 1, value=1.0)],  # no root
    ],
)
def test_broken_trees_are_refused(nodes):
    with pytest.raises(ValueError):
        TreeModel(nodes)


def test_tree_features_must_exist_and_no_trees_give_the_base(spark):
    df = spark.range(2)
    with pytest.raises(ValueError):
        TreeModel([SPLIT, *LEAVES]).scorer()(df)
    assert {r["prob"] for r in TreeModel([], base=0.0).scorer()(df).collect()} == {0.5}
    assert rows(TreeModel([SPLIT, *LEAVES]).scorer()(spark.createDataFrame([], "x double"))) == []


def test_boosted_trees_of_spark_ml_score_alike(spark, folder):
    names = ["DAYS_BIRTH", "AMT_INCOME_TOTAL", "OBS_60_CNT_SOCIAL_CIRCLE", "REGION_RATING_CLIENT"]
    app = view(spark, folder, "application")
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    label = SQLTransformer(statement="SELECT *, CAST(abs(DAYS_BIRTH) % 7 < 3 AS DOUBLE) AS y FROM __THIS__")
    boosted = GBTClassifier(labelCol="y", maxIter=8, maxDepth=4, seed=1)
    fitted = Pipeline(stages=[label, assembler, boosted]).fit(app)
    model = from_spark_ml(fitted.stages[-1], names)
    assert sum(map(len, model.trees.values())) > 8
    ours = {r[d.CUSTOMER]: r["prob"] for r in model.scorer()(app).collect()}
    for r in fitted.transform(app).select(d.CUSTOMER, "probability").collect():
        assert ours[r[d.CUSTOMER]] == pytest.approx(r["probability"][1], rel=1e-9)


# Sparse encoding -------------------------------------------------------------


def test_sparse_vectors_equal_the_wide_table(spark):
    data = [(1, "a", "x"), (2, None, "y"), (3, "b", None), (4, None, None), (None, "a", "x")]
    df = spark.createDataFrame(data, "k int, t string, u string")
    index = op.category_index(df, ["t", "u"])
    assert rows(index) == [("t", "a", 0), ("t", "b", 1), ("u", "x", 2), ("u", "y", 3)]
    wide = op.one_hot(df, {"t": ["a", "b"], "u": ["x", "y"]})
    got = {r["k"]: [(e["index"], e["value"]) for e in r["vector"]] for r in op.one_hot_sparse(df, "k", ["t", "u"], index).collect()}
    for k, *hot in wide.collect():
        assert got[k] == [(i, 1.0) for i, v in enumerate(hot) if v]
    new = spark.createDataFrame([(9, "unseen", "y"), (10, "z", "z")], "k int, t string, u string")
    seen = op.one_hot_sparse(new, "k", ["t", "u"], index)
    assert rows(seen.selectExpr("k", "vector.index")) == [(10, []), (9, [3])]
    dots = seen.selectExpr("k", f"{op.sparse_dot('vector', 'map(3L, 2.5D, 0L, 1D)')} AS dot")
    assert rows(dots) == [(10, 0.0), (9, 2.5)]
    assert rows(op.category_index(df.limit(0), ["t"])) == []


def test_very_many_categories_plan_like_few(spark):
    def plan(n):
        df = spark.range(2 * n).selectExpr("id AS k", f"concat('c', CASE WHEN id % 3 = 0 THEN 0 ELSE id % {n} END) AS t")
        index = op.category_index(df, ["t"])
        vectors = op.one_hot_sparse(df, "k", ["t"], index)
        return index, vectors, len(vectors._jdf.queryExecution().optimizedPlan().toString())

    _, _, small = plan(20)
    index, vectors, large = plan(200_000)
    assert abs(large - small) < 200  # digits of numbers, nothing else
    known = index.selectExpr("count(1)", "min(index)", "max(index)", "count(DISTINCT index)").head()
    assert known[0] == known[2] + 1 == known[3] and known[1] == 0 and known[0] > 150_000
    # A third of the rows has one category.
    assert vectors.where("size(vector) = 1").count() == 400_000


# Pipeline stages -------------------------------------------------------------


def test_stages_survive_storage_within_a_pipeline(spark, folder, tmp_path):
    app = view(spark, folder, "application")
    plan = Pipeline(stages=[PrepareApplications(["CODE_GENDER"], 10), SQLTransformer(statement="SELECT * FROM __THIS__")])
    plan.write().overwrite().save(str(tmp_path / "p"))
    loaded = Pipeline.load(str(tmp_path / "p"))
    first = loaded.getStages()[0]
    assert (first.text_columns, first.max_categories, first.uid) == (["CODE_GENDER"], 10, plan.getStages()[0].uid)
    model = loaded.fit(app)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert isinstance(again.stages[0], PreparedApplications) and again.stages[0].uid == model.stages[0].uid
    assert again.stages[0].fitted == model.stages[0].fitted
    assert rows(again.transform(app)) == rows(model.transform(app))
    assert not any(c.startswith("NAME_CONTRACT_TYPE") for c in again.transform(app).columns)
    with pytest.raises(ValueError):
        PrepareApplications(max_categories=1).fit(app)


def test_the_default_stage_prepares_like_the_library(spark, folder):
    tables = bundle(spark, folder)
    whole = build.prepare_main(tables["application"], build.fit_params(tables))
    assert rows(PrepareApplications().fit(tables["application"]).transform(tables["application"])) == rows(whole)


# Requests as a stream --------------------------------------------------------


def test_a_stream_is_joined_without_state(spark, tmp_path):
    schema = f"{d.CUSTOMER} long, note string"
    app = spark.createDataFrame([(1,), (2,), (None,)], f"{d.CUSTOMER} long")
    features = spark.createDataFrame([(1, 4.0)], f"{d.CUSTOMER} long, x double")
    answers = stored_answers(app, features, scoring.logistic_scorer({"x": 1.0}, 0.0))
    asked = [(1, "a")] * 300 + [(2, "b"), (3, "c"), (None, "d")]  # one customer asks for nearly all
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    spark.createDataFrame(asked, schema).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    plan = joined_answers(stream, answers)
    assert plan.isStreaming
    logical = plan._jdf.queryExecution().analyzed().toString()
    assert "Join LeftOuter" in logical and "Aggregate" not in logical
    query = score_requests_joined(stream, answers, out, progress)
    query.awaitTermination()
    assert query.lastProgress["stateOperators"] == []
    spark.createDataFrame([(2, "later")], schema).write.mode("append").parquet(source)
    score_requests_joined(stream, answers, out, progress).awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(out).select(d.CUSTOMER, "note", "pred", "status").collect()]
    wanted = [(1, "a", 1, "ok")] * 300 + [(2, "b", None, "filtered"), (2, "later", None, "filtered")]
    wanted += [(3, "c", None, "not_found"), (None, "d", None, "not_found")]
    assert sorted(got, key=str) == sorted(wanted, key=str)


# File statistics -------------------------------------------------------------


def test_bounds_come_from_the_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000, numPartitions=4).selectExpr("id AS a", "id / 8D AS b", "CAST(NULL AS INT) AS c", "'x' AS t").write.parquet(path)
    found = footer_bounds(spark, path, ["a", "b"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(a), MIN(b)" in plan.replace("`", "") or "min(a)" in plan.split("BatchScan")[1]
    assert rows(found) == rows(op.column_bounds(spark.read.parquet(path), ["a", "b"]))
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"  # the caller's settings stay
    known = stored_bounds(spark, path, ["a", "b", "c"])  # c has none, and all are scanned
    df = spark.read.parquet(path)
    assert op.narrow_types(df, bounds=known) == op.narrow_types(df)
    with pytest.raises(ValueError):
        footer_bounds(spark, path, ["absent"])


def test_files_without_statistics_are_scanned(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("id AS a").write.option("parquet.column.statistics.enabled", "false").parquet(path)
    assert stored_bounds(spark, path, ["a"]) == {"min_a": 0, "max_a": 99}


def scanned(df) -> int:
    """The rows that the scan of a plain query gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().apply(0)
    return plan.metrics().apply("numOutputRows").value()


def test_bloom_filters_skip_absent_ids(spark, tmp_path):
    # Even ids in no order of the key, and far too many for a dictionary.
    df = written(spark.range(200_000).selectExpr("id % 1000 AS k", "xxhash64(id) & -2L AS loan", "id AS v"), "rows")
    plain, filtered = str(tmp_path / "plain"), str(tmp_path / "filtered")
    write_features(df, plain, "k", files=4)
    write_features(df, filtered, "k", files=4, lookups={"loan": 50_000})
    absent = [4 * i + 1 for i in range(10)]
    some = df.orderBy("v").limit(3).collect()
    for ids in (absent, [r["loan"] for r in some]):
        condition = f"loan IN ({', '.join(f'{i}L' for i in ids)})"
        assert rows(spark.read.parquet(filtered).where(condition)) == rows(df.where(condition).select("k", "loan", "v"))
    # One file in a hundred is read in vain.
    for path, least, most in ((plain, 2_000_000, 2_000_000), (filtered, 0, 200_000)):
        read = sum(scanned(spark.read.parquet(path).where(f"loan = {i}L")) for i in absent)
        assert least <= read <= most
