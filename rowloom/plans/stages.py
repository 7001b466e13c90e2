"""The preparation of applications as stages of a Spark ML pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Estimator, Model
from pyspark.ml.util import (
    DefaultParamsReader,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession

from rowloom.functions import string_columns
from rowloom.operators.encode import fit_categories
from rowloom.operators.scale import fit_impute_scale
from rowloom.plans import build
from rowloom.plans import domain as d
from rowloom.plans.params import MAIN, FittedParams


class _StageWriter(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        spark = SparkSession.active()
        self.stage.save_fitted(spark, path)
        DefaultParamsWriter.saveMetadata(self.stage, path, spark, self.stage.kept())


class _StageReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        spark = SparkSession.active()
        found = DefaultParamsReader.loadMetadata(path, spark)
        stage = self.kind.from_kept(spark, path, found)
        stage._resetUid(found["uid"])
        return stage


class _Stage(MLWritable, MLReadable):
    """Saved as the metadata of an ML stage, beside it tables if it is fitted."""

    def write(self) -> MLWriter:
        return _StageWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _StageReader(cls)

    def kept(self) -> dict:
        return {}

    def save_fitted(self, spark: SparkSession, path: str) -> None:
        pass

    @classmethod
    def from_kept(cls, spark: SparkSession, path: str, found: dict):
        return cls()


class PreparedApplications(_Stage, Model):
    """Applications cleaned, encoded, imputed and scaled with fitted parameters.

    A transformer that leaves rows out: those whose gender code is unusable.
    """

    def __init__(self, params: FittedParams):
        super().__init__()
        self.fitted = params

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return build.prepare_main(dataset, self.fitted)

    def save_fitted(self, spark: SparkSession, path: str) -> None:
        self.fitted.save(spark, f"{path}/fitted")

    @classmethod
    def from_kept(cls, spark: SparkSession, path: str, found: dict) -> PreparedApplications:
        return cls(FittedParams.load(spark, f"{path}/fitted"))


class PrepareApplications(_Stage, Estimator):
    """Fits categories, medians and ranges of an application table.

    ``text_columns`` names the text columns that become wide, all of them if
    it is None; ``max_categories`` makes one with more an error.
    """

    def __init__(self, text_columns: Sequence[str] | None = None, max_categories: int | None = None):
        super().__init__()
        self.text_columns = None if text_columns is None else list(text_columns)
        self.max_categories = max_categories

    def _fit(self, dataset: DataFrame) -> PreparedApplications:
        cleaned = build.clean_main(dataset)
        texts = string_columns(cleaned, [d.CUSTOMER]) if self.text_columns is None else self.text_columns
        params = FittedParams(categories={MAIN: fit_categories(cleaned, texts, self.max_categories)})
        params.scale = fit_impute_scale(build.encode_main(cleaned, params), d.CUSTOMER)
        return PreparedApplications(params)

    def kept(self) -> dict:
        return {"text_columns": self.text_columns, "max_categories": self.max_categories}

    @classmethod
    def from_kept(cls, spark: SparkSession, path: str, found: dict) -> PrepareApplications:
        return cls(found["text_columns"], found["max_categories"])
