"""A second detector: how badly standardized features are reconstructed.

A linear autoencoder, that is a principal component projection, fitted by Spark's own
library on all rows; the score is the mean squared residual.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import DataFrame, functions as F


@dataclass
class Reconstruction:
    features: tuple[str, ...]
    means: list[float]
    scales: list[float]
    residual: list[list[float]]   # I - P Pᵀ

    def score(self, frame: DataFrame, name: str = "reconstruction_error") -> DataFrame:
        """Mean squared residual, as plain column arithmetic."""
        z = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(self.features, self.means, self.scales)]
        staged = frame.withColumns({f"_z{i}": v for i, v in enumerate(z)})
        total = F.lit(0.0)
        for row in self.residual:
            gap = F.lit(0.0)
            for i, weight in enumerate(row):
                gap = gap + F.lit(float(weight)) * F.col(f"_z{i}")
            total = total + gap * gap
        return staged.withColumn(name, total / len(self.features)).drop(*[f"_z{i}" for i in range(len(z))])


def fit_reconstruction(train: DataFrame, features, components: int | None = None) -> Reconstruction:
    features = tuple(features)
    components = components or max(1, len(features) // 2)
    vectors = VectorAssembler(inputCols=list(features), outputCol="_v").transform(train.select(*[F.col(c).cast("double").alias(c) for c in features]))
    scaler = StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True).fit(vectors)
    loadings = PCA(k=components, inputCol="_z", outputCol="_p").fit(scaler.transform(vectors)).pc.toArray()
    scales = [float(s) if s > 0 else 1.0 for s in scaler.std.toArray()]
    return Reconstruction(features, [float(m) for m in scaler.mean.toArray()], scales, (np.eye(len(features)) - loadings @ loadings.T).tolist())
