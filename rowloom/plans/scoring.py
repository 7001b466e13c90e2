"""Scores, classes, verdicts, and answers to requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from rowloom.functions import class_of, map_values, name_of, require_columns, value_of
from rowloom.operators.filters import check_ids
from rowloom.operators.joins import Requested, lookup_join
from rowloom.operators.select import select_named
from rowloom.plans import domain as d

Scorer = Callable[[DataFrame], DataFrame]

OK, FILTERED, NOT_FOUND, REJECTED = "ok", "filtered", "not_found", "rejected"


def logistic_scorer(weights: Mapping[str, float], intercept: float) -> Scorer:
    """A logistic expression over feature columns, evaluated inside the JVM."""

    def score(df: DataFrame) -> DataFrame:
        require_columns(df, weights)
        terms = [
            f"{value_of(float(w))} * CAST({name_of(c)} AS DOUBLE)" for c, w in weights.items()
        ]
        z = " + ".join([value_of(float(intercept)), *terms])
        return df.selectExpr("*", f"1.0D / (1.0D + exp(-({z}))) AS prob")

    return score


def ml_scorer(model, output: str = "probability", index: int = 1) -> Scorer:
    """A fitted Spark ML model or pipeline that makes a probability vector."""

    def score(df: DataFrame) -> DataFrame:
        scored = model.transform(df)
        prob = vector_to_array(scored[output])[index].alias("prob")
        return scored.select(*[name_of(c) for c in df.columns], prob)

    return score


def pandas_scorer(predict: Callable[[pd.DataFrame], object], features: list[str]) -> Scorer:
    """Any Python model, called on Arrow batches of the selected features."""

    def score(df: DataFrame) -> DataFrame:
        require_columns(df, features)

        def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                yield part.assign(prob=predict(part[features]))

        schema = T.StructType([*df.schema.fields, T.StructField("prob", T.DoubleType())])
        return df.mapInPandas(batches, schema)

    return score


def score_features(
    features: DataFrame, scorer: Scorer, selected: list[str] | None = None
) -> DataFrame:
    """(customer, prob, pred): the selected features scored and thresholded."""
    if selected:
        names = [d.CUSTOMER, *[c for c in selected if c != d.CUSTOMER]]
        features = select_named(features, names)
    return scorer(features).selectExpr(
        name_of(d.CUSTOMER), "prob", f"{class_of('prob', d.THRESHOLD)} AS pred"
    )


def prediction_table(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """(customer, Actual, Predicted, prob) for customers with a label."""
    return scored.join(labels, d.CUSTOMER).selectExpr(
        name_of(d.CUSTOMER), f"{name_of(d.LABEL)} AS Actual", "pred AS Predicted", "prob"
    )


def verdict_of(pred: str) -> str:
    """The sentence shown for a class; NULL without a class."""
    return map_values(pred, d.VERDICTS)


def score_requests(
    requests: DataFrame,
    application: DataFrame,
    features: DataFrame,
    scorer: Scorer,
    selected: list[str] | None = None,
) -> DataFrame:
    """Every request row with its score, class, verdict and status. Runs small jobs.

    Only requested customers are read and scored, each once, however often
    they are requested. ``status`` tells a score (``ok``) from a customer left
    out by cleaning (``filtered``) and an unknown id (``not_found``).
    """
    wanted = Requested(requests, d.CUSTOMER)
    known = wanted.keep(select_named(application, [d.CUSTOMER]))
    answers = answers_of(known, score_features(wanted.keep(features), scorer, selected))
    return finish_answers(lookup_join(requests, answers, d.CUSTOMER), requests.columns)


def answers_of(known: DataFrame, scored: DataFrame) -> DataFrame:
    """Known customers with their scores, where they have one."""
    scored = scored.selectExpr("*", "TRUE AS scored")
    return known.selectExpr("*", "TRUE AS known").join(scored, d.CUSTOMER, "left")


def finish_answers(joined: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the requests, then score, class, verdict and status."""
    return joined.selectExpr(
        *[name_of(c) for c in columns],
        "prob",
        "pred",
        f"{verdict_of('pred')} AS verdict",
        f"CASE WHEN scored THEN {value_of(OK)} WHEN known THEN {value_of(FILTERED)}"
        f" ELSE {value_of(NOT_FOUND)} END AS status",
    )


def answer_requests(
    requests: DataFrame,
    raw: str,
    application: DataFrame,
    features: DataFrame,
    scorer: Scorer,
    selected: list[str] | None = None,
    ids: tuple[int, int] = d.REQUEST_IDS,
) -> DataFrame:
    """From request texts to answers; texts that are no valid id are ``rejected``."""
    accepted, rejected = check_ids(requests, raw, d.CUSTOMER, *ids)
    answers = score_requests(accepted, application, features, scorer, selected)
    refused = rejected.selectExpr("*", f"{value_of(REJECTED)} AS status")
    return answers.unionByName(refused, allowMissingColumns=True)
