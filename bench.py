"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every query is
run to the end and its rows are thrown away; the first, untimed round loads
classes and compiled code. ``*_as_written`` repeats the plan shape of one
grouping and one join per feature family, for comparison.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from functools import reduce
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from checks.queries import INTERCEPT, QUERIES, SELECTED, WEIGHTS  # noqa: E402
from checks.views import bundle, table, view  # noqa: E402
from rowloom import operators as op  # noqa: E402
from rowloom.plans import build, clean, scoring  # noqa: E402
from rowloom.plans import domain as d  # noqa: E402
from rowloom.session import configure, work_folder  # noqa: E402
from rowloom.sources import read_features, write_features  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = 2

HEADLINE = [
    "rollup_bureau",
    "rollup_bureau_balance",
    "rollup_prev_app",
    "rollup_pos",
    "rollup_instpay",
    "rollup_credit",
    "category_share_long",
    "agg_join_back",
    "exact_median_large",
    "prepared_applications",
    "customer_features",
    "requested_features",
]


def session() -> SparkSession:
    scratch = tempfile.mkdtemp(prefix="rowloom-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("rowloom-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", scratch)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def finish(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def bureau_as_written(spark: SparkSession, folder: str) -> DataFrame:
    """One grouping per total, each joined back to the loans, then averaged."""
    loans = view(spark, folder, "bureau")
    totals = clean.bureau_totals(loans)
    parts = [op.aggregate_by(loans, d.CUSTOMER, {name: e}) for name, e in totals.items()]
    detail = reduce(lambda left, part: left.join(part, d.CUSTOMER, "left"), parts, loans)
    return op.rollup_child(detail, d.CUSTOMER, "Bureau", drop=[d.BUREAU_LOAN])


def balance_as_written(spark: SparkSession, folder: str) -> DataFrame:
    """Every month joined to its loan before anything is summed."""
    return QUERIES["inner_join_sum"](spark, folder)


def main() -> None:
    spark = session()
    tables = bundle(spark, FOLDER)
    params = build.fit_params(tables)
    scorer = scoring.logistic_scorer(WEIGHTS, INTERCEPT)
    stored = work_folder(spark, "features")
    write_features(build.build_features(tables, params), stored, d.CUSTOMER)
    features = read_features(spark, stored)
    ids = table(spark, FOLDER, "customer").selectExpr(f"c_custkey AS {d.CUSTOMER}")

    def score(requests: DataFrame) -> DataFrame:
        return scoring.score_requests(requests, tables[build.MAIN], features, scorer, SELECTED)

    runs = {name: (lambda q=QUERIES[name]: q(spark, FOLDER)) for name in HEADLINE}
    runs["features_with_stored_params"] = lambda: build.build_features(tables, params)
    runs["features_of_one_customer"] = lambda: build.build_features(tables, params, ids.limit(1))
    runs["score_one_request"] = lambda: score(ids.limit(1))
    runs["score_hundred_requests"] = lambda: score(ids.limit(100))
    runs["score_all_requests"] = lambda: score(view(spark, FOLDER, "requests"))
    runs["bureau_as_written"] = lambda: bureau_as_written(spark, FOLDER)
    runs["balance_as_written"] = lambda: balance_as_written(spark, FOLDER)

    seconds: dict[str, float] = {}
    for round_ in range(ROUNDS):
        for name, run in runs.items():
            start = time.perf_counter()
            finish(run())
            if round_:
                seconds[name] = round(time.perf_counter() - start, 3)
    ours = [s for name, s in seconds.items() if not name.endswith("_as_written")]
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(ours), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(FOLDER).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
