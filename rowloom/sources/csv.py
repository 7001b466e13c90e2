"""CSV scan with a header, missing-value tokens and type inference."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import name_of, value_of

# Texts read as missing. 'XNA' is a category, not one of them.
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Texts read as true and false.
BOOLEANS = ("True", "TRUE", "true", "False", "FALSE", "false")

WHOLE_FILE = str(1 << 50)  # bytes of a split, so that each file is one


def _present(column: str) -> str:
    tokens = ", ".join(value_of(t) for t in NA_TOKENS)
    return f"CASE WHEN {name_of(column)} NOT IN ({tokens}) THEN {name_of(column)} END"


def _parsed(column: str, kind: str) -> str:
    """Typed value, NULL where the text does not have the type.

    The SQL cast also takes Y, N, 0 and 1 as booleans and a trailing D or F as
    part of a number; in a data file these are categories.
    """
    present = _present(column)
    if kind == "string":
        return present
    if kind == "boolean":
        words = ", ".join(value_of(w) for w in BOOLEANS)
        present = f"CASE WHEN {name_of(column)} IN ({words}) THEN {name_of(column)} END"
    elif kind in ("double", "float"):
        present = f"CASE WHEN NOT ({present}) RLIKE '[0-9.][dDfF]$' THEN {present} END"
    return f"try_cast({present} AS {kind})"


def infer_types(texts: DataFrame, declared: Mapping[str, str] | None = None) -> dict[str, str]:
    """Type of every text column from all its values. Runs one job.

    bigint if all present values are whole numbers, else double, else boolean,
    else string; a column with no present value is double. Declared types win.
    """
    types = dict(declared or {})
    unknown = [c for c in texts.columns if c not in types]
    if unknown:
        ladder = ("bigint", "double", "boolean")
        row = texts.selectExpr(
            *[f"count({_present(c)}) AS n{i}" for i, c in enumerate(unknown)],
            *[
                f"count({_parsed(c, kind)}) AS {kind}{i}"
                for i, c in enumerate(unknown)
                for kind in ladder
            ],
        ).head()
        for i, c in enumerate(unknown):
            n = row[f"n{i}"]
            fitting = [kind for kind in ladder if row[f"{kind}{i}"] == n]
            types[c] = "double" if not n else (fitting or ["string"])[0]
    return {c: types[c] for c in texts.columns}


def _headers(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files by their first line, if these differ; of each file the first block is read and no more."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", WHOLE_FILE)
    own.conf.set("spark.sql.files.openCostInBytes", WHOLE_FILE)
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    lines = own.read.text(path).selectExpr("_metadata.file_path AS file", "value AS header")
    found = lines.mapInArrow(first, "file string, header string")
    found = found.selectExpr("file", "rtrim('\\r', header) AS header")
    if len(found.select("header").distinct().limit(2).collect()) < 2:
        return {}
    grouped = found.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    return {r["header"]: r["files"] for r in sorted(grouped, key=lambda r: r["files"][0])}


def _texts(spark: SparkSession, path: str, multi_line: bool, one_header: bool) -> DataFrame:
    """All columns of all files as text."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    if one_header or len(spark.read.text(path).inputFiles()) < 2:
        return reader.csv(path)
    files = _headers(spark, path)
    if not files:
        return reader.csv(path)
    parts = [reader.csv(names) for names in files.values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(
    spark: SparkSession,
    path: str,
    types: Mapping[str, str] | None = None,
    infer: bool = True,
    multi_line: bool = False,
    one_header: bool = False,
) -> DataFrame:
    """CSV with a header row as a typed DataFrame; missing tokens become NULL.

    Columns are matched by header name: files with other columns, or the same
    in another order, are read by their own header. Finding the headers of more
    than one file takes a task and a read of the first block for each file, which
    ``one_header`` saves where all files are known to have the same. ``multi_line`` allows line breaks
    within quotes; a file is then read by one task. ``types`` declares columns;
    the others are inferred with one extra pass, or stay text when ``infer`` is
    off. Declare the types of large tables to save that pass.
    """
    texts = _texts(spark, path, multi_line, one_header)
    declared = {c: t for c, t in (types or {}).items() if c in texts.columns}
    if infer:
        kinds = infer_types(texts, declared)
    else:
        kinds = {c: declared.get(c, "string") for c in texts.columns}
    return texts.selectExpr(*[f"{_parsed(c, kinds[c])} AS {name_of(c)}" for c in texts.columns])
