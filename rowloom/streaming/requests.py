"""A stream of request ids answered from a static feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rowloom.plans.scoring import Scorer, score_requests
from rowloom.session import remove_folder, work_folder, written


def score_request_stream(
    requests: DataFrame,
    application: DataFrame,
    features: DataFrame,
    scorer: Scorer,
    path: str,
    checkpoint: str,
    selected: list[str] | None = None,
    **trigger,
) -> StreamingQuery:
    """Start a query that writes the answers of every micro-batch as parquet.

    Each batch looks up its own few ids, so it reads the matching row groups
    of the feature table instead of joining the whole table per batch. A batch
    that is run again after a failure overwrites its own folder, which keeps
    every answer exactly once. By default the query answers what is there and
    stops.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = work_folder(spark, "batch")
        ids = written(batch, "batch", folder)
        score_requests(ids, application, features, scorer, selected).write.mode(
            "overwrite"
        ).parquet(f"{path}/batch={batch_id}")
        remove_folder(spark, folder)

    return (
        requests.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
