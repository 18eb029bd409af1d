"""A trained model with everything that scoring new peptides needs, as a folder."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCAModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from residua.functions.descriptors import DescriptorConfig
from residua.functions.naming import REGRESSION
from residua.operators.preprocessing import FittedPreprocessor
from residua.operators.validation import align_columns
from residua.plans.models import NeighborModel, StagesModel

KIND = "residua-model-bundle"


@dataclass
class ModelBundle:
    task: str
    model_name: str
    model: StagesModel | NeighborModel
    preprocessor: FittedPreprocessor
    descriptor_config: DescriptorConfig
    descriptor_columns: list[str]
    target_column: str
    labels: list[str] | None
    target_mean: float = 0.0
    target_scale: float = 1.0
    metrics: dict[str, float] = field(default_factory=dict)
    cv_summary: dict[str, float] = field(default_factory=dict)
    created_at: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat(timespec="seconds"))

    @property
    def feature_names(self) -> list[str]:
        names, chosen = self.preprocessor.output_names, self.model.selected
        return names if chosen is None else [names[i] for i in chosen]

    def features(self, descriptors: DataFrame, keep: list[str]) -> DataFrame:
        aligned = align_columns(descriptors, keep, self.descriptor_columns)
        return self.preprocessor.transform(aligned, keep)

    def predict_features(self, rows: DataFrame, id_col: str) -> DataFrame:
        """Predictions in target units, or decoded classes, as `Prediction`."""
        scored = self.model.predict(rows, id_col).drop("features")
        kept = [F.col(c) for c in scored.columns if c != "prediction"]
        return scored.select(*kept, self._decoded(F.col("prediction")).alias("Prediction"))

    def _decoded(self, prediction: Column) -> Column:
        if self.labels is None:
            return prediction * F.lit(self.target_scale) + F.lit(self.target_mean)
        return F.get(F.array(*[F.lit(label) for label in self.labels]), prediction.cast("int"))

    def apply(self, descriptors: DataFrame, keep: list[str], id_col: str) -> DataFrame:
        return self.predict_features(self.features(descriptors, keep), id_col)

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        plain = {
            "task": self.task, "model_name": self.model_name, "descriptor_config": asdict(self.descriptor_config),
            "descriptor_columns": self.descriptor_columns, "target_column": self.target_column, "labels": self.labels,
            "target_mean": self.target_mean, "target_scale": self.target_scale, "metrics": self.metrics,
            "cv_summary": self.cv_summary, "created_at": self.created_at, "preprocessor": self.preprocessor.state(),
            "projected": self.preprocessor.pca is not None,
            "neighbors": [self.model.classes, self.model.k] if isinstance(self.model, NeighborModel) else None,
        }
        spark.createDataFrame([(KIND, json.dumps(plain))], "kind string, content string").coalesce(1).write.mode(mode).parquet(f"{path}/metadata")
        if isinstance(self.model, NeighborModel):
            self.model.reference.write.mode(mode).parquet(f"{path}/reference")
        else:
            writer = self.model.pipeline.write()
            (writer.overwrite() if mode == "overwrite" else writer).save(f"{path}/model")
        if self.preprocessor.pca is not None:
            writer = self.preprocessor.pca.write()
            (writer.overwrite() if mode == "overwrite" else writer).save(f"{path}/projection")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ModelBundle:
        table = spark.read.parquet(f"{path}/metadata")
        row = table.first() if {"kind", "content"} <= set(table.columns) else None
        if row is None or row["kind"] != KIND:
            raise TypeError("The folder does not hold a model bundle.")
        plain: dict[str, Any] = json.loads(row["content"])
        pca = PCAModel.load(f"{path}/projection") if plain["projected"] else None
        if plain["neighbors"]:
            classes, k = plain["neighbors"]
            model = NeighborModel(spark.read.parquet(f"{path}/reference"), classes, k)
        else:
            model = StagesModel(PipelineModel.load(f"{path}/model"))
        return ModelBundle(
            plain["task"], plain["model_name"], model, FittedPreprocessor.from_state(plain["preprocessor"], pca),
            DescriptorConfig(**plain["descriptor_config"]), plain["descriptor_columns"], plain["target_column"], plain["labels"],
            plain["target_mean"], plain["target_scale"], plain["metrics"], plain["cv_summary"], plain["created_at"],
        )

    @property
    def is_regression(self) -> bool:
        return self.task == REGRESSION
