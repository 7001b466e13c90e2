"""The credit tables: formulas on literal rows, properties, plan shapes."""

from __future__ import annotations

import re

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from checks.views import bundle, view
from rowloom import operators as op
from rowloom.plans import build, clean, history, scoring
from rowloom.plans import domain as d
from rowloom.plans.params import FittedParams


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, folder):
    return bundle(spark, folder)


@pytest.fixture(scope="module")
def params(tables):
    return build.fit_params(tables)


@pytest.fixture(scope="module")
def features(spark, tables, params, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features") / "t")
    build.build_features(tables, params).write.parquet(path)
    return spark.read.parquet(path)


# Cleaning and derived columns ------------------------------------------------

APPLICATION = (
    "SK_ID_CURR int, CODE_GENDER string, DAYS_BIRTH int, DAYS_EMPLOYED int,"
    " OBS_30_CNT_SOCIAL_CIRCLE double, OBS_60_CNT_SOCIAL_CIRCLE double,"
    " REGION_RATING_CLIENT int, REGION_RATING_CLIENT_W_CITY int,"
    " AMT_INCOME_TOTAL double, AMT_CREDIT double, AMT_ANNUITY double"
)


def test_clean_application(spark):
    df = spark.createDataFrame(
        [
            (1, "F", -7300, 365243, 31.0, 30.0, 1, None, 10.0, 5.0, 1.0),
            (2, "XNA", -7300, -730, 0.0, 0.0, 1, 2, 10.0, 5.0, 1.0),
            (3, None, -7482, -730, None, 40.0, 2, 2, 5.0, 10.0, None),
        ],
        APPLICATION,
    )
    got = {r["SK_ID_CURR"]: r for r in clean.clean_application(df).collect()}
    assert set(got) == {1, 3}
    years = {k: (r["DAYS_BIRTH"], r["DAYS_EMPLOYED"], r["Year_Empolyed_ANOM"]) for k, r in got.items()}
    assert years == {1: (20.0, None, True), 3: (20.0, 2.0, False)}
    assert (got[1]["OBS_30_CNT_SOCIAL_CIRCLE"], got[1]["OBS_60_CNT_SOCIAL_CIRCLE"]) == (None, 30.0)
    assert (got[3]["OBS_30_CNT_SOCIAL_CIRCLE"], got[3]["OBS_60_CNT_SOCIAL_CIRCLE"]) == (None, None)

    filled = {r["SK_ID_CURR"]: r for r in clean.fill_categories(df).collect()}
    assert filled[3]["CODE_GENDER"] == "XNA"
    assert (filled[1]["REGION_RATING_CLIENT"], filled[1]["REGION_RATING_CLIENT_W_CITY"]) == ("1", None)

    ratios = {r["SK_ID_CURR"]: r for r in clean.derive_application(df).collect()}
    assert (ratios[1]["INCOME_GT_CREDIT_FLAG"], ratios[3]["INCOME_GT_CREDIT_FLAG"]) == (True, False)
    assert ratios[1]["DIR"] == 5.0 / 11 and ratios[1]["ACR"] == 5.0 / 6
    assert ratios[1]["AIR"] == 1.0 / 11 and ratios[3]["AIR"] is None
    assert ratios[2]["DAR"] == -730 / -7300


def test_bureau_totals_without_debt(spark):
    df = spark.createDataFrame(
        [(1, 10, "Car", None, None, None), (1, 11, None, 99.0, None, 3.0), (2, 12, "Car", -1.0, -1.0, 1.0)],
        "SK_ID_CURR int, SK_ID_BUREAU int, CREDIT_TYPE string, AMT_CREDIT_SUM double,"
        " AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_SUM_OVERDUE double",
    )
    rolled = op.aggregate_by(df, d.CUSTOMER, clean.bureau_totals(df))
    got = {r[0]: tuple(r)[1:] for r in rolled.collect()}
    assert got[1] == (2, 1, 99.0, 0.0, 0.0, 3.0, 0.0, 3.0)
    # The debt sum of -1 makes both denominators 0: the first ratio keeps the
    # infinity, the second one turns it into 0.
    assert got[2] == (1, 1, -1.0, -1.0, float("-inf"), 1.0, -1.0, 0.0)


def test_balance_status(spark):
    df = spark.createDataFrame(
        [(1, -3, "C"), (1, 0, "X"), (2, -1, "5"), (2, -1, "9"), (2, -1, None)],
        "SK_ID_BUREAU int, MONTHS_BALANCE tinyint, STATUS string",
    )
    got = [tuple(r)[1:] for r in clean.clean_bureau_balance(df).collect()]
    assert got == [(3, 0, 0.0), (0, 4, 4.0), (1, 7, 3.5), (1, None, None), (1, None, None)]


def test_previous_applications_with_zero_credit(spark):
    df = spark.createDataFrame(
        [(1, 9, 12.0, 10.0, 0.0, 100.0, 50.0), (1, 8, None, 10.0, 100.0, 100.0, None)],
        "SK_ID_CURR int, SK_ID_PREV int, CNT_PAYMENT double, AMT_ANNUITY double,"
        " AMT_CREDIT double, AMT_APPLICATION double, AMT_GOODS_PRICE double",
    )
    first, second = clean.derive_previous(df).collect()
    assert first["AMT_INTEREST"] == 120.0 and first["INTEREST_RATE"] == float("inf")
    assert first["INTEREST_SHARE"] == 120.0 / 0.00001
    assert first["AMT_DECLINED"] == 100.0 and first["AMT_CREDIT_GOODS_DIFF"] == -50.0
    assert first["ANNUITY_GOODS"] == 50.0 / 12.00001
    assert second["AMT_INTEREST"] is None and second["INTEREST_RATE"] is None
    assert second["AMT_DECLINED"] == 0.0 and second["AMT_CREDIT_GOODS_RATIO"] is None


def test_card_guards_differ(spark):
    names = [
        *(f"AMT_DRAWINGS_{k}" for k in ("ATM_CURRENT", "CURRENT", "OTHER_CURRENT", "POS_CURRENT")),
        *(f"CNT_DRAWINGS_{k}" for k in ("ATM_CURRENT", "CURRENT", "OTHER_CURRENT", "POS_CURRENT")),
        "CNT_INSTALMENT_MATURE_CUM", "AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL", "AMT_PAYMENT_CURRENT",
        "AMT_PAYMENT_TOTAL_CURRENT", "AMT_INST_MIN_REGULARITY", "AMT_TOTAL_RECEIVABLE",
        "AMT_RECEIVABLE_PRINCIPAL", "SK_DPD", "SK_DPD_DEF",
    ]
    row = (1.0, 2.0, 3.0, 4.0, 1.0, 1.0, 1.0, 1.0, 6.0, 50.0, 100.0, 7.0, 8.0, 0.0, 9.0, 4.0, 3.0, 0.0)
    df = spark.createDataFrame([row], ", ".join(f"{n} double" for n in names))
    got = clean.derive_card_balance(df).head()
    assert (got["AMT_DRAWING_SUM"], got["CNT_DRAWING_SUM"]) == (10.0, 10.0)
    assert got["MIN_PAYMENT_RATIO"] == 7.0 / 0.0001
    assert got["MIN_PAYMENT_TOTAL_RATIO"] == 8.0 / 0.00001
    assert got["PAYMENT_MIN_DIFF"] == 8.0 and got["AMT_INTEREST_RECEIVABLE"] == 5.0
    assert got["SK_DPD_RATIO"] == 3.0 / 0.00001


def test_formulas_on_narrow_types_do_not_wrap(spark, folder):
    wide = view(spark, folder, "credit_card_balance")
    narrow = op.narrow(wide)
    assert dict(narrow.dtypes)["CNT_DRAWINGS_CURRENT"] == "tinyint"
    columns = ["SK_ID_PREV", "CNT_DRAWING_SUM", "AMT_DRAWING_SUM", "SK_DPD_RATIO"]
    a, b = (clean.derive_card_balance(t).selectExpr(*columns) for t in (wide, narrow))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


# Roll-ups --------------------------------------------------------------------


def test_presummed_months_equal_the_plain_join(tables):
    loans, months = tables["bureau"], tables["bureau_balance"]
    fast = {r[0]: r[1:] for r in history.rollup_bureau_balance(loans, months).collect()}
    joined = op.inner_join(loans, clean.clean_bureau_balance(months), d.BUREAU_LOAN)
    sums = {c: op.sum_of(joined, c) for c in history.BALANCE_COLUMNS}
    plain = {r[0]: r[1:] for r in op.aggregate_by(joined, d.CUSTOMER, sums).collect()}
    assert fast.keys() == plain.keys()
    for key, (months_, status, weight) in plain.items():
        assert fast[key][:2] == (months_, status)
        assert fast[key][2] == pytest.approx(weight, abs=1e-9)


def test_repeated_and_missing_loan_ids(spark):
    loans = spark.createDataFrame(
        [(1, 10), (1, 10), (2, 10), (3, None), (None, 10), (4, 99)], "SK_ID_CURR int, SK_ID_BUREAU int"
    )
    months = spark.createDataFrame(
        [(10, -1, "0"), (10, -2, "1"), (None, -5, "C"), (77, -1, "C")],
        "SK_ID_BUREAU int, MONTHS_BALANCE int, STATUS string",
    )
    got = {r[0]: tuple(r)[1:3] for r in history.rollup_bureau_balance(loans, months).collect()}
    assert got == {1: (6, 6), 2: (3, 3)}


def test_loan_types_from_categories_equal_distinct_counts(tables):
    found = op.fit_categories(tables["bureau"])
    fast = history.rollup_bureau(tables["bureau"], found, complete=True)
    slow = history.rollup_bureau(tables["bureau"], found, complete=False)
    assert fast.exceptAll(slow).count() == 0 and fast.count() == slow.count()
    assert plan_of(fast).count("Exchange") == 1
    assert plan_of(slow).count("Exchange") == 2


def test_categories_unseen_when_fitting_still_count(spark):
    df = spark.createDataFrame(
        [(1, 1, "old", 1.0, 1.0, 1.0), (1, 2, "new", 1.0, 1.0, 1.0)],
        "SK_ID_CURR int, SK_ID_BUREAU int, CREDIT_TYPE string, AMT_CREDIT_SUM double,"
        " AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_SUM_OVERDUE double",
    )
    got = history.rollup_bureau(df, {"CREDIT_TYPE": ["old"]}).head()
    assert (got["Bureau_old"], got["Bureau_LOAN_TYPES_BUREAU"]) == (0.5, 2)


@pytest.mark.parametrize("name", ["rollup_previous", "rollup_pos", "rollup_card_balance"])
def test_rollups_take_one_grouping_shuffle(spark, tables, params, name):
    table = {
        "rollup_previous": "previous_application",
        "rollup_pos": "POS_CASH_balance",
        "rollup_card_balance": "credit_card_balance",
    }[name]
    rolled = getattr(history, name)(tables[table], params.categories[table])
    text = plan_of(rolled)
    assert len(re.findall(r"Exchange hashpartitioning\(SK_ID_CURR", text)) == 1
    assert "Window" not in text and "Python" not in text


# The feature table -----------------------------------------------------------


def test_one_row_per_kept_customer(tables, features):
    kept = tables["application"].where("NOT (CODE_GENDER <=> 'XNA')").count()
    assert features.count() == kept
    assert features.select(d.CUSTOMER).distinct().count() == kept
    assert d.LABEL not in features.columns


def test_no_missing_values_and_scaled_range(features):
    history_prefixes = tuple(f"{p}_" for p in d.PREFIXES.values())
    main = [c for c in features.columns if not c.startswith(history_prefixes) and c != d.CUSTOMER]
    nulls = features.selectExpr(*[f"count_if(`{c}` IS NULL)" for c in features.columns]).head()
    assert set(nulls) == {0}
    ends = features.selectExpr(*[f"min(`{c}`)" for c in main], *[f"max(`{c}`)" for c in main]).head()
    assert min(ends) >= -1e-12 and max(ends) <= 1 + 1e-12


def test_customers_without_history_get_zeros(features):
    assert features.where("POS_SK_DPD_DEF = 0").count() > 0
    assert features.where("POS_SK_DPD_DEF = 0 AND INSTPAY_AMT_INSTALMENT <> 0").count() == 0


def test_feature_plan_is_declarative(spark, tables, params):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(build.build_features(tables, params))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"Window|CartesianProduct|NestedLoop|Python|Pandas", text)
    joins = len(re.findall(r"SortMergeJoin \[SK_ID_CURR\S*\], \[SK_ID_CURR\S*\], LeftOuter", text))
    assert joins == 6
    # Six roll-ups and the application: one shuffle by customer each.
    assert len(re.findall(r"Exchange hashpartitioning\(SK_ID_CURR#\d+L?, 8\)", text)) == 7


def test_requested_features_equal_the_full_table(spark, tables, params, features):
    asked = spark.range(0, 40).selectExpr(f"id AS {d.CUSTOMER}")
    some = build.build_features(tables, params, asked)
    full = features.where(f"{d.CUSTOMER} < 40")
    assert some.columns == full.columns
    a = {r[0]: r for r in some.collect()}
    b = {r[0]: r for r in full.collect()}
    assert a.keys() == b.keys() and len(a) > 5
    for key, row in b.items():
        assert tuple(a[key]) == pytest.approx(tuple(row), rel=1e-9, abs=1e-9)


def test_one_request_filters_every_scan(spark, tables, params):
    text = plan_of(build.build_features(tables, params, [5]))
    for column in ("c_custkey", "o_custkey", "user_id"):
        assert f"EqualTo({column},5)" in text


def test_requested_loans_are_a_plain_side_of_the_join(spark, tables):
    """Written before the join with the months, so that a loan with very many months can be split."""
    wanted = tables["application"].select(d.CUSTOMER).limit(20)
    months = build.restrict(tables, wanted)["bureau_balance"]
    plan = months._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "Aggregate" not in plan and plan.count("Relation [") == 2


def test_request_lists_and_tables_give_the_same_rows(spark, tables, params, features):
    asked = spark.range(0, 30).selectExpr(f"id AS {d.CUSTOMER}")
    sums = ["count(1)", "sum(Bureau_bal_STATUS)", "sum(Bureau_bal_MONTHS_BALANCE)", "sum(POS_SK_DPD_DEF)"]
    expected = tuple(features.where(f"{d.CUSTOMER} < 30").selectExpr(*sums).head())
    for requests in (asked, list(range(30))):
        got = build.build_features(tables, params, requests)
        assert tuple(got.selectExpr(*sums).head()) == pytest.approx(expected)


def test_a_text_column_of_very_many_values(spark, tables):
    """It becomes wide, or is left out and kept as rows of shares."""
    loans = tables["bureau"].withColumn("NOTE", F.expr("concat('n', SK_ID_BUREAU % 2500)"))
    many = {**tables, "bureau": loans}
    found = loans.select("NOTE").distinct().count()
    assert len(build.fit_params(many).categories["bureau"]["NOTE"]) == found
    chosen = {"bureau": ["CREDIT_TYPE", "CREDIT_ACTIVE"]}
    params = build.fit_params(many, chosen)
    assert "NOTE" not in params.categories["bureau"]
    assert build.build_features(many, params).count() > 0
    with pytest.raises(ValueError, match="more than 100 categories in: bureau.NOTE"):
        build.fit_params(many, max_categories=100)


def test_params_survive_storage(spark, params, tmp_path):
    params.selected = ["DIR", "AIR"]
    params.save(spark, str(tmp_path))
    assert FittedParams.load(spark, str(tmp_path)) == params


def test_unseen_category_and_stored_params(spark, tables, params):
    changed = tables["application"].selectExpr(
        *[c if c != "CODE_GENDER" else "'other' AS CODE_GENDER" for c in tables["application"].columns]
    )
    got = build.prepare_main(changed, params).selectExpr("max(CODE_GENDER_FURNITURE)").head()[0]
    assert got == 0.0


# Scoring ---------------------------------------------------------------------

WEIGHTS = {"DIR": 1.0, "POS_SK_DPD": 0.5}


def test_scorers_agree(spark, features, tables):
    some = features.selectExpr(d.CUSTOMER, *WEIGHTS)
    logistic = scoring.score_features(some, scoring.logistic_scorer(WEIGHTS, -0.75))

    def predict(batch):
        import numpy as np

        z = -0.75 + batch["DIR"] + 0.5 * batch["POS_SK_DPD"]
        return 1 / (1 + np.exp(-z))

    in_python = scoring.score_features(some, scoring.pandas_scorer(predict, list(WEIGHTS)))
    a = {r[0]: r for r in logistic.collect()}
    b = {r[0]: r for r in in_python.collect()}
    assert a.keys() == b.keys()
    assert all(a[k]["prob"] == pytest.approx(b[k]["prob"]) and a[k]["pred"] == b[k]["pred"] for k in a)
    assert {r["pred"] for r in a.values()} == {0, 1}


def test_ml_pipeline_scorer(spark, features, tables):
    labels = op.split_label(tables["application"], d.CUSTOMER, d.LABEL)[1]
    train = features.join(labels, d.CUSTOMER)
    stages = [
        VectorAssembler(inputCols=["DIR", "AIR", "AMT_INCOME_TOTAL"], outputCol="inputs"),
        LogisticRegression(featuresCol="inputs", labelCol=d.LABEL, maxIter=5),
    ]
    model = Pipeline(stages=stages).fit(train)
    scored = scoring.score_features(features, scoring.ml_scorer(model), ["DIR", "AIR", "AMT_INCOME_TOTAL"])
    table = scoring.prediction_table(scored, labels)
    assert table.columns == [d.CUSTOMER, "Actual", "Predicted", "prob"]
    assert table.count() == features.count()
    assert table.where("Predicted <> CASE WHEN prob > 0.5 THEN 1 ELSE 0 END").count() == 0


def test_selected_features_must_exist(features):
    with pytest.raises(ValueError, match="missing columns: nope"):
        scoring.score_features(features, scoring.logistic_scorer({}, 0.0), ["DIR", "nope"])


@pytest.mark.parametrize("repeat", [1, 400])
def test_answers(spark, tables, features, repeat):
    excluded = tables["application"].where("CODE_GENDER = 'XNA'").head()[d.CUSTOMER]
    known = features.head()[d.CUSTOMER]
    ids = [(known,)] * repeat + [(excluded,), (10**9,), (None,)]
    asked = spark.createDataFrame(ids, f"{d.CUSTOMER} long")
    answers = scoring.score_requests(
        asked, tables["application"], features, scoring.logistic_scorer(WEIGHTS, 0.0)
    ).collect()
    assert len(answers) == repeat + 3
    by_id = {a[d.CUSTOMER]: a for a in answers}
    assert by_id[known]["status"] == "ok" and by_id[known]["verdict"] == d.VERDICTS[by_id[known]["pred"]]
    assert by_id[excluded]["status"] == "filtered" and by_id[excluded]["prob"] is None
    assert by_id[10**9]["status"] == "not_found" and by_id[None]["status"] == "not_found"


def test_texts_become_answers(spark, tables, features):
    asked = spark.createDataFrame([("3", 1), ("03", 2), ("x", 3), ("99", 4), (None, 5)], "raw string, n int")
    got = scoring.answer_requests(
        asked, "raw", tables["application"], features, scoring.logistic_scorer(WEIGHTS, 0.0), ids=(0, 50)
    )
    status = {r["n"]: (r[d.CUSTOMER], r["status"]) for r in got.collect()}
    assert status[1] == status[2] and status[1][0] == 3
    assert [status[n] for n in (3, 4, 5)] == [(None, "rejected")] * 3
