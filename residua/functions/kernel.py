"""Random Fourier features: a finite map whose dot products approach the RBF kernel."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType


class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Cosines of random projections (Rahimi and Recht 2007). The map follows from its parameters."""

    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    inputSize = Param(Params._dummy(), "inputSize", "number of input features", TypeConverters.toInt)
    dimensions = Param(Params._dummy(), "dimensions", "number of output features", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="kernel", gamma=1.0, inputSize=1, dimensions=256, seed=42):
        super().__init__()
        self._setDefault(gamma=1.0, inputSize=1, dimensions=256)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, width = self.getOrDefault(self.inputSize), self.getOrDefault(self.dimensions)
        random = np.random.default_rng(self.getOrDefault(self.seed))
        weights = random.normal(scale=np.sqrt(2.0 * self.getOrDefault(self.gamma)), size=(size, width))
        phases = random.uniform(0.0, 2.0 * np.pi, size=width)

        def project(vectors: pa.Array) -> pa.Array:
            rows = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), size)
            mapped = np.sqrt(2.0 / width) * np.cos(rows @ weights + phases)
            offsets = pa.array(np.arange(len(vectors) + 1) * width, pa.int32())
            return pa.ListArray.from_arrays(offsets, pa.array(mapped.ravel()))

        udf = F.arrow_udf(project, ArrayType(DoubleType()))
        mapped: Column = udf(vector_to_array(F.col(self.getInputCol())))
        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped))
