"""Preprocessing as a Spark ML stage, so that one stored pipeline holds it together with a model.

    pipeline = Pipeline(stages=[DescriptorPreprocessor(inputCols=columns), LinearRegression(labelCol="y")])
    pipeline.fit(table).write().save(path)
    PipelineModel.load(path).transform(new_table)

Columns that a table to be scored does not have count as their fill value; all its other columns are kept.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import PCAModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

from residua.operators.preprocessing import FittedPreprocessor, PreprocessingConfig, fit_preprocessor


class DescriptorPreprocessor(Estimator, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Impute, drop flat and correlated columns, scale and, if asked, project; settings as in `PreprocessingConfig`."""

    imputeStrategy = Param(Params._dummy(), "imputeStrategy", "median, mean or most_frequent", TypeConverters.toString)
    scaler = Param(Params._dummy(), "scaler", "standard, minmax, robust or none", TypeConverters.toString)
    varianceThreshold = Param(Params._dummy(), "varianceThreshold", "columns must vary more", TypeConverters.toFloat)
    correlationThreshold = Param(Params._dummy(), "correlationThreshold", "columns must correlate less with earlier ones", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "principal components, 0 for none", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, inputCols=(), outputCol="features", imputeStrategy="median", scaler="standard", varianceThreshold=0.0, correlationThreshold=0.95, components=0,
    ):
        super().__init__()
        self._setDefault(outputCol="features", imputeStrategy="median", scaler="standard", varianceThreshold=0.0, correlationThreshold=0.95, components=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> DescriptorPreprocessorModel:
        get, components = self.getOrDefault, self.getOrDefault(self.components)
        config = PreprocessingConfig(
            get(self.imputeStrategy), get(self.scaler), get(self.varianceThreshold), get(self.correlationThreshold), components > 0, components or PreprocessingConfig.pca_components
        )
        return self._copyValues(DescriptorPreprocessorModel(fit_preprocessor(dataset, list(self.getInputCols()), config)))


class DescriptorPreprocessorModel(Model, HasInputCols, HasOutputCol, MLWritable, MLReadable):
    def __init__(self, fitted: FittedPreprocessor | None = None) -> None:
        super().__init__()
        self._setDefault(outputCol="features")
        self.fitted = fitted

    @property
    def featureNames(self) -> list[str]:
        return self.fitted.output_names

    def _transform(self, dataset: DataFrame) -> DataFrame:
        keep = [c for c in dataset.columns if c != self.getOutputCol()]
        return self.fitted.transform(dataset, keep, self.getOutputCol())

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: DescriptorPreprocessorModel) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        fitted = self.instance.fitted
        extra = {"state": fitted.state(), "projected": fitted.pca is not None}
        DefaultParamsWriter.saveMetadata(self.instance, path, SparkSession.active(), extraMetadata=extra)
        if fitted.pca is not None:
            fitted.pca.write().save(f"{path}/projection")


class _Reader(MLReader):
    def __init__(self, cls: type[DescriptorPreprocessorModel]) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> DescriptorPreprocessorModel:
        metadata = DefaultParamsReader.loadMetadata(path, SparkSession.active())
        pca = PCAModel.load(f"{path}/projection") if metadata["projected"] else None
        model = self.cls(FittedPreprocessor.from_state(metadata["state"], pca))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
