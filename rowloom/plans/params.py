"""Fitted state as small tables instead of opaque files."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rowloom.operators.scale import ScaleParams

MAIN = "application"


@dataclass
class FittedParams:
    """Categories by table and column, scaling by column, selected features.

    Bounded by the number of columns and categories, never by rows.
    """

    categories: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    scale: dict[str, ScaleParams] = field(default_factory=dict)
    selected: list[str] = field(default_factory=list)

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        onehot = [
            (t, c, v, i)
            for t, columns in self.categories.items()
            for c, values in columns.items()
            for i, v in enumerate(values)
        ]
        scale = [(c, p.median, p.min, p.max) for c, p in self.scale.items()]
        return {
            "onehot": spark.createDataFrame(
                onehot, "table string, column string, category string, position int"
            ),
            "impute_scale": spark.createDataFrame(
                scale, "column string, median double, min double, max double"
            ),
            "selected_features": spark.createDataFrame(
                list(enumerate(self.selected)), "position int, column string"
            ),
        }

    def save(self, spark: SparkSession, folder: str) -> None:
        for name, df in self.tables(spark).items():
            df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> FittedParams:
        out = cls()
        onehot = spark.read.parquet(f"{folder}/onehot").orderBy("table", "column", "position")
        for r in onehot.collect():
            out.categories.setdefault(r["table"], {}).setdefault(r["column"], []).append(
                r["category"]
            )
        for r in spark.read.parquet(f"{folder}/impute_scale").collect():
            out.scale[r["column"]] = ScaleParams(r["median"], r["min"], r["max"])
        chosen = spark.read.parquet(f"{folder}/selected_features").orderBy("position")
        out.selected = [r["column"] for r in chosen.collect()]
        return out
