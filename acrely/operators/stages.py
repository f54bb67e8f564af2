"""The preparation of listings as stages of a `pyspark.ml` pipeline.

`ListingPreparation` is the estimator over `prep.ListingPreprocessor`, `ListingPreparationModel` what it learns. Both have
params, are stored and read back with the pipeline they are in, and can be searched by cross-validation. The model
keeps all columns of its input and appends `features`, `label` (where there is a price column) and `is_test`; input columns of
these names give way.

The fit reads the table several times: give it a written or persisted one. With `testFraction` 0 the scaling sees every
row, which is what cross-validation wants, as it sets rows aside by itself.

Defined cases: an empty table fits and transforms to no rows; missing feature columns read as 0; unseen categories as the
first one; rows without a price have a null label, and go with `handleInvalid="skip"` if the table has prices; without
`property_id` there is no `is_test`.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acrely.operators.prep import TARGET, ListingPreprocessor

APPENDED = ["features", "label", "is_test"]


class _Settings(Params):
    seed = Param(Params._dummy(), "seed", "of the hash that sets test rows aside", TypeConverters.toInt)
    testFraction = Param(Params._dummy(), "testFraction", "share of rows the scaling does not see", TypeConverters.toFloat)
    handleInvalid = Param(Params._dummy(), "handleInvalid", "rows without a price: keep or skip", TypeConverters.toString)

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(seed=42, testFraction=0.2, handleInvalid="keep")

    def _skips(self) -> bool:
        how = self.getOrDefault(self.handleInvalid)
        if how not in ("keep", "skip"):
            raise ValueError(f"handleInvalid is {how!r}, not keep or skip")
        return how == "skip"


class ListingPreparation(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """Imputation, category codes and scaling, learnt from a table of listings."""

    @keyword_only
    def __init__(self, *, seed: int | None = None, testFraction: float | None = None, handleInvalid: str | None = None) -> None:
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ListingPreparationModel":
        self._skips()
        known = dataset.drop(*APPENDED)
        fitted = ListingPreprocessor(self.getOrDefault(self.seed), self.getOrDefault(self.testFraction)).fit(known)
        return self._copyValues(ListingPreparationModel(fitted).setParent(self))


class ListingPreparationModel(Model, _Settings, MLReadable, MLWritable):
    """Appends what a price model reads."""

    def __init__(self, fitted: ListingPreprocessor | None = None) -> None:
        super().__init__()
        self.fitted = fitted

    def setParent(self, parent: ListingPreparation) -> "ListingPreparationModel":
        """The model goes by the name of its estimator, as those of the library do."""
        self._resetUid(parent.uid)
        return self

    @property
    def feature_columns(self) -> list[str]:
        return self.fitted.feature_columns

    def _transform(self, dataset: DataFrame) -> DataFrame:
        rows = dataset.drop(*APPENDED)
        if "property_id" in rows.columns:
            rows = self.fitted.split(rows)
        out = self.fitted.transform(rows, keep=rows.columns)
        return out.filter(F.col("label").isNotNull()) if self._skips() and TARGET in rows.columns else out

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: ListingPreparationModel) -> None:
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.fitted.save(self.sparkSession, f"{path}/data")


class _Reader(MLReader):
    def __init__(self, kind: type[ListingPreparationModel]) -> None:
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> ListingPreparationModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind(ListingPreprocessor.load(self.sparkSession, f"{path}/data"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
