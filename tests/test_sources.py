"""CSV scan, table bundle, sinks, bucketed tables, and the request stream."""

from __future__ import annotations

import pytest

from checks.views import BUNDLE, bundle
from rowloom.plans import build, history, scoring
from rowloom.plans import domain as d
from rowloom.session import work_folder
from rowloom.sources import (
    load_tables,
    read_csv,
    read_features,
    save_bucketed,
    store_tables,
    write_features,
)
from rowloom.streaming import score_request_stream


def test_csv_tokens_and_types(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "id,money,text,flag,empty,code\n"
        '1,2.5,"a ""quoted"", one",True,,0\n'
        "2,NA,XNA,False,NaN,C\n"
        "3,1e3,null,,n/a,1\n"
    )
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "boolean", "double", "string"]
    assert [tuple(r) for r in df.orderBy("id").collect()] == [
        (1, 2.5, 'a "quoted", one', True, None, "0"),
        (2, None, "XNA", False, None, "C"),
        (3, 1000.0, None, None, None, "1"),
    ]


def test_codes_stay_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("own_car,unit,level,limit\nY,1D,t,inf\nN,2F,f,-inf\n")
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert [t for _, t in df.dtypes] == ["string", "string", "string", "double"]
    assert sorted(r["limit"] for r in df.collect()) == [float("-inf"), float("inf")]


def test_declared_types_win_and_match_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("STATUS,n\n0,7\n1,x\n")
    df = read_csv(spark, str(tmp_path / "t.csv"), {"n": "int", "STATUS": "string", "other": "int"})
    assert df.dtypes == [("STATUS", "string"), ("n", "int")]
    assert [tuple(r) for r in df.collect()] == [("0", 7), ("1", None)]
    texts = read_csv(spark, str(tmp_path / "t.csv"), infer=False)
    assert [t for _, t in texts.dtypes] == ["string", "string"]


def test_headers_take_the_first_lines_only(spark, tmp_path):
    """Of files with many lines each task of the header search reads some hundred rows at most."""
    from rowloom.sources import csv

    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "a.csv").write_text("a,b\r\n" + "1,2\r\n" * 300_000)
    (folder / "b.csv").write_text("a,b\n" + "3,4\n" * 300_000)
    assert csv._headers(spark, str(folder)) == {}
    (folder / "c.csv").write_text("b,c\n5,6\n")
    found = csv._headers(spark, str(folder))
    assert {h: [f.rsplit("/", 1)[1] for f in files] for h, files in found.items()} == {
        "a,b": ["a.csv", "b.csv"],
        "b,c": ["c.csv"],
    }
    whole = read_csv(spark, str(folder), {"a": "bigint", "b": "bigint", "c": "bigint"})
    assert whole.selectExpr("count(a)", "sum(b)", "sum(c)").head() == (600_000, 2 * 300_000 + 4 * 300_000 + 5, 6)


def test_csv_scan_reads_only_the_wanted_columns(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b,c\n1,2,3\n")
    df = read_csv(spark, str(tmp_path / "t.csv"), dict.fromkeys("abc", "int")).select("b")
    assert "ReadSchema: struct<b:string>" in df._jdf.queryExecution().executedPlan().toString()


def test_bundle_from_csv_gives_the_same_features(spark, folder, tmp_path):
    tables = bundle(spark, folder)
    for name in BUNDLE:
        tables[name].write.option("header", True).csv(str(tmp_path / f"{name}.csv"))
    loaded = load_tables(spark, str(tmp_path), "csv")
    assert set(loaded) == set(BUNDLE)
    assert dict(loaded["bureau_balance"].dtypes)["STATUS"] == "string"
    a = history.rollup_bureau_balance(tables["bureau"], tables["bureau_balance"])
    b = history.rollup_bureau_balance(loaded["bureau"], loaded["bureau_balance"])
    keys = "Bureau_bal_MONTHS_BALANCE", "Bureau_bal_STATUS", d.CUSTOMER
    assert a.select(*keys).exceptAll(b.select(*keys)).count() == 0


def test_stored_tables_are_narrow(spark, folder, tmp_path):
    tables = bundle(spark, folder)
    store_tables(tables, str(tmp_path))
    loaded = load_tables(spark, str(tmp_path))
    assert dict(loaded["bureau_balance"].dtypes)["MONTHS_BALANCE"] == "tinyint"
    assert dict(loaded["application"].dtypes)["AMT_CREDIT"] == "double"
    store_tables({"application": tables["application"]}, str(tmp_path / "single"), single=True)
    small = spark.read.parquet(str(tmp_path / "single" / "application.parquet"))
    assert dict(small.dtypes)["AMT_CREDIT"] == "float"
    a = history.rollup_bureau_balance(tables["bureau"], tables["bureau_balance"])
    b = history.rollup_bureau_balance(loaded["bureau"], loaded["bureau_balance"])
    assert a.drop("Bureau_bal_WEIGHT_status").exceptAll(b.drop("Bureau_bal_WEIGHT_status")).count() == 0


def test_written_features_skip_row_groups(spark, tmp_path):
    df = spark.range(10_000).selectExpr(f"(id * 7919) % 10000 AS {d.CUSTOMER}", "id AS v")
    write_features(df, str(tmp_path / "f"), d.CUSTOMER, files=4)
    back = read_features(spark, str(tmp_path / "f"))
    assert back.exceptAll(df).count() == 0
    ranges = back.groupBy("_metadata.file_path").agg({d.CUSTOMER: "min"}).count()
    assert ranges == 4
    ends = sorted(
        (r["lo"], r["hi"])
        for r in back.selectExpr("_metadata.file_path AS f", d.CUSTOMER)
        .groupBy("f")
        .agg({d.CUSTOMER: "min"})
        .toDF("f", "lo")
        .join(
            back.selectExpr("_metadata.file_path AS f", d.CUSTOMER)
            .groupBy("f")
            .agg({d.CUSTOMER: "max"})
            .toDF("f", "hi"),
            "f",
        )
        .collect()
    )
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def test_bucketed_tables_need_no_shuffle(spark, folder):
    tables = bundle(spark, folder)
    save_bucketed(tables["application"], "app_b", d.CUSTOMER, 8)
    save_bucketed(tables["bureau"], "bureau_b", d.CUSTOMER, 8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from rowloom.operators import left_join_zero_fill

        categories = {"CREDIT_ACTIVE": ["F", "O", "P"], "CREDIT_TYPE": ["1-URGENT"]}
        rolled = history.rollup_bureau(spark.table("bureau_b"), categories, complete=True)
        out = left_join_zero_fill(spark.table("app_b").select(d.CUSTOMER), rolled, d.CUSTOMER)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.count() == tables["application"].count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_bucketing_reports_hot_keys(spark):
    hot = spark.range(900).selectExpr("CASE WHEN id % 3 = 0 THEN 5L ELSE id + 1000 END AS k")
    report = save_bucketed(hot, "hot_b", "k", 16)
    first = report.head()
    assert (first["k"], first["row_count"]) == (5, 300) and first["bucket_share"] > 5


def test_work_folders_are_fresh_and_shared(spark):
    a, b = work_folder(spark, "x"), work_folder(spark, "x")
    assert a != b and a.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_stream_answers_every_request_once(spark, folder, tmp_path):
    tables = bundle(spark, folder)
    params = build.fit_params(tables)
    write_features(build.build_features(tables, params), str(tmp_path / "f"), d.CUSTOMER)
    features = read_features(spark, str(tmp_path / "f"))
    scorer = scoring.logistic_scorer({"DIR": 1.0}, 0.0)
    inbox, out, progress = (str(tmp_path / n) for n in ("inbox", "out", "progress"))

    def arrive(ids):
        spark.createDataFrame([(i,) for i in ids], f"{d.CUSTOMER} long").coalesce(1).write.mode(
            "append"
        ).parquet(inbox)

    def answer():
        stream = spark.readStream.schema(f"{d.CUSTOMER} long").parquet(inbox)
        score_request_stream(
            stream, tables["application"], features, scorer, out, progress
        ).awaitTermination()
        return spark.read.parquet(out)

    arrive([1, 1, 2, 10**9])
    assert answer().count() == 4
    arrive([3, 2])
    got = answer()
    assert sorted(r[d.CUSTOMER] for r in got.collect()) == [1, 1, 2, 2, 3, 10**9]
    assert got.where("status = 'not_found'").count() == 1
    assert answer().count() == 6


def test_csv_columns_go_by_name_and_quotes_hold_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,a,b\n1,x,10\n2,"q\nr",20\n')
    (tmp_path / "b.csv").write_text("id,b,a\n3,40,w\n")
    got = read_csv(spark, str(tmp_path), multi_line=True)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "x", 10), (2, "q\nr", 20), (3, "w", 40)]
