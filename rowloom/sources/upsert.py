"""A table with one row per key whose rows can be replaced without writing it anew."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rowloom.functions import name_of, value_of
from rowloom.session import folder_exists, remove_folder, work_folder, written

PART, NTH = "key_part", "nth_of_key"


class PartitionedTable:
    """Parquet in ``parts`` folders by a hash of the key, sorted by the key in each.

    An upsert reads and writes the folders that hold a changed key and no
    others; files of the rest stay as they are. A key has one row, so folders
    are even whatever the keys are. Take as many parts as give files of about
    100 MB. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, parts: int = 64):
        if parts < 1:
            raise ValueError("at least one part")
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.parts, self.schema = parts, None
        if folder_exists(spark, f"{self.path}/_layout"):
            row = spark.read.parquet(f"{self.path}/_layout").head()
            self.parts, self.schema = row["parts"], T.StructType.fromJson(json.loads(row["schema"]))

    def part_of(self, key: str) -> str:
        return f"CAST(pmod(xxhash64({key}), {self.parts}) AS INT)"

    def _placed(self, df: DataFrame, once: bool = False) -> DataFrame:
        by = name_of(self.key)
        placed = df.where(f"{by} IS NOT NULL").selectExpr("*", f"{self.part_of(by)} AS {PART}").repartition(PART)
        if once:  # one row of each key, found after the same shuffle and in the same order
            nth = f"row_number() OVER (PARTITION BY {PART}, {by} ORDER BY {by}) AS {NTH}"
            placed = placed.selectExpr("*", nth).where(f"{NTH} = 1").drop(NTH)
        return placed.sortWithinPartitions(PART, by)

    def write(self, df: DataFrame) -> None:
        """Replace the whole table; rows without a key are left out."""
        self._placed(df).write.mode("overwrite").partitionBy(PART).parquet(self.path)
        self._keep_layout(df.schema)

    def _keep_layout(self, schema: T.StructType) -> None:
        self.schema = schema
        row = self.spark.createDataFrame([(self.parts, schema.json())], "parts int, schema string")
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_layout")

    def _stored(self) -> DataFrame:
        if self.schema is None:
            raise ValueError(f"no table in {self.path}")
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField(PART, T.IntegerType())])).parquet(
            self.path
        )

    def read(self, keys: Iterable | None = None) -> DataFrame:
        """All rows, or those of some keys, for which only their folders are read."""
        df = self._stored()
        if keys is not None:
            kind = df.schema[self.key].dataType.simpleString()
            values = [f"CAST({value_of(k)} AS {kind})" for k in sorted({k for k in keys if k is not None})]
            if not values:
                return df.where("FALSE").drop(PART)
            folders = ", ".join(self.part_of(v) for v in values)
            df = df.where(f"{PART} IN ({folders}) AND {name_of(self.key)} IN ({', '.join(values)})")
        return df.drop(PART)

    def upsert(self, changes: DataFrame, removed: DataFrame | None = None) -> list[int]:
        """Replace or add the rows of the changed keys and drop the removed ones. Runs jobs.

        Returns the numbers of the folders that were written. Columns are
        matched by name and take the types of the table; a column that the
        changes lack, or that other rows lack, is null. A key in both stays. Of several rows with one key any may be kept, so
        give one. The changes are computed once, and what replaces a folder is
        complete beside the table before the first file is touched: Spark moves
        the folders of a dynamic overwrite when all of them are written.
        """
        by, spark, stored = name_of(self.key), self.spark, self._stored()
        place = work_folder(spark, "upsert")
        kinds = {f.name: f.dataType.simpleString() for f in self.schema.fields}
        typed = changes.selectExpr(
            *[f"CAST({name_of(c)} AS {kinds[c]}) AS {name_of(c)}" if c in kinds else name_of(c) for c in changes.columns]
        )
        new = written(self._placed(typed, once=True), "changes", f"{place}/new")
        gone = new.select(by, PART)
        filled = {r[PART] for r in gone.select(PART).distinct().collect()}
        touched = sorted(filled)
        if removed is not None:
            keys = removed.selectExpr(f"CAST({by} AS {kinds[self.key]}) AS {by}").where(f"{by} IS NOT NULL").distinct()
            gone = gone.union(keys.selectExpr(by, f"{self.part_of(by)} AS {PART}")).distinct()
            touched = sorted(r[PART] for r in gone.select(PART).distinct().collect())
        if touched:
            listed = ", ".join(map(str, touched))
            kept = stored.where(f"{PART} IN ({listed})").join(gone.select(by), self.key, "left_anti")
            rows = kept.unionByName(new, allowMissingColumns=True)
            only_removed = sorted(set(touched) - filled)
            if only_removed:
                left = kept.where(f"{PART} IN ({', '.join(map(str, only_removed))})").select(PART)
                filled |= {r[PART] for r in left.distinct().collect()}
            (
                rows.repartition(PART)
                .sortWithinPartitions(PART, by)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(PART)
                .parquet(self.path)
            )
            for part in set(touched) - filled:
                remove_folder(spark, f"{self.path}/{PART}={part}")
            if len(rows.columns) - 1 > len(self.schema.fields):
                self._keep_layout(rows.drop(PART).schema)
        remove_folder(spark, place)
        return touched
