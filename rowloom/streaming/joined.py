"""Requests answered by a stream joined to stored answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rowloom.functions import name_of
from rowloom.operators.select import select_named
from rowloom.plans import domain as d
from rowloom.plans.scoring import Scorer, answers_of, finish_answers, score_features
from rowloom.session import written


def stored_answers(
    application: DataFrame, features: DataFrame, scorer: Scorer, selected: list[str] | None = None
) -> DataFrame:
    """The answer of every customer, scored once and written. Runs a job.

    One row per customer: the static side of `joined_answers`.
    """
    known = select_named(application, [d.CUSTOMER]).where(f"{name_of(d.CUSTOMER)} IS NOT NULL")
    return written(answers_of(known, score_features(features, scorer, selected)), "answers")


def joined_answers(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Every request with its answer: a left join with the stream on the left.

    It keeps no state, so requests are answered in the micro-batch they arrive
    in, there is no watermark, and nothing grows with the stream. Ids that the
    answers don't have are ``not_found``. The output can be written in append
    mode to any sink; a batch that is run again gives the same rows.
    """
    return finish_answers(requests.join(answers, d.CUSTOMER, "left"), requests.columns)


def score_requests_joined(
    requests: DataFrame,
    answers: DataFrame,
    path: str,
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Start a query that appends the answers to a parquet table.

    The sink's own log keeps every answer exactly once; read the folder with
    Spark. By default the query answers what is there and stops.
    """
    return (
        joined_answers(requests, answers)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
