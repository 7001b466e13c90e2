"""Tables that grow by batches, each added exactly once."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, Row, SparkSession

from rowloom.session import folder_exists

BATCH = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


LOG = "batch string, tables array<string>, replaces array<string>"


class BatchStore:
    """Parquet folders ``<path>/<table>/<batch>`` and a log of the batches that count.

    A batch, of one or more tables, is there as a whole once its line in the
    log is written. A batch that was stopped before is written again from the
    start; one that is in the log, also if it was merged into another since, is
    not added a second time. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _lines(self) -> list[Row]:
        if not folder_exists(self.spark, f"{self.path}/log"):
            return []
        return self.spark.read.schema(LOG).parquet(f"{self.path}/log").collect()

    def added(self) -> list[str]:
        """All batches ever added."""
        return sorted({r["batch"] for r in self._lines()})

    def live(self) -> dict[str, list[str]]:
        """The batches to read, and the tables that each has rows of."""
        lines = self._lines()
        replaced = {b for r in lines for b in r["replaces"]}
        return {r["batch"]: r["tables"] for r in lines if r["batch"] not in replaced}

    def add(self, batch: str, tables: Mapping[str, DataFrame], replaces: Iterable[str] = ()) -> bool:
        """Write a batch; False if it was added before."""
        if not BATCH.fullmatch(batch):
            raise ValueError(f"not a batch name: {batch}")
        if batch in self.added():
            return False
        for table, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.path}/{table}/{batch}")
        line = self.spark.createDataFrame([(batch, sorted(tables), sorted(replaces))], LOG)
        line.coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return True

    def read(self, table: str, batches: Iterable[str] | None = None) -> DataFrame:
        """The rows of the live batches, or of the given ones; columns are matched by name."""
        live = self.live()
        chosen = sorted(live if batches is None else set(batches))
        gone = [b for b in chosen if b not in live]
        folders = [f"{self.path}/{table}/{b}" for b in chosen if b in live and table in live[b]]
        if gone or not folders:
            raise ValueError(f"no rows of {table} in these batches: {', '.join(gone or chosen)}")
        return self.spark.read.option("mergeSchema", len(folders) > 1).parquet(*folders)

    def has(self, table: str) -> bool:
        return any(table in tables for tables in self.live().values())
