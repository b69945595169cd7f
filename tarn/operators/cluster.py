"""k-means with canonical labels and principal components from one correlation matrix."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .gram import columns_of, design, gram, var


def kmeans(df: DataFrame, cols: list[str], k: int, seed: int = 25, order_by: str | None = None, steps: int = 1000) -> DataFrame:
    """Cluster the complete cases on unscaled columns; ``cluster`` is 1..k by rising centre of ``order_by``.

    The complete cases are checkpointed: the search, its summary and the labels each read them, and ``df`` is worked out once.
    """
    src = cut_lineage(df.na.drop(subset=cols))
    features = VectorAssembler(inputCols=cols, outputCol="__f").transform(src)
    model = KMeans(k=k, seed=seed, featuresCol="__f", predictionCol="__c", maxIter=steps, tol=1e-6).fit(features)
    if model.summary.numIter >= steps:
        raise RuntimeError(f"the clusters have not settled after {steps} steps")
    at = cols.index(order_by or cols[0])
    order = np.argsort([c[at] for c in model.clusterCenters()], kind="stable")
    label = F.create_map(*[F.lit(int(v)) for pair in ((old, new + 1) for new, old in enumerate(order)) for v in pair])
    return model.transform(features).withColumn("cluster", label[F.col("__c")]).drop("__f", "__c")


@dataclass(frozen=True)
class Components:
    names: list[str]
    eigenvalues: np.ndarray
    loadings: np.ndarray
    mean: np.ndarray
    sd: np.ndarray

    @property
    def share(self) -> np.ndarray:
        return self.eigenvalues / self.eigenvalues.sum()

    def table(self, spark: SparkSession) -> DataFrame:
        """Eigenvalues and shares per component."""
        rows = [(i + 1, float(v), float(s)) for i, (v, s) in enumerate(zip(self.eigenvalues, self.share))]
        return spark.createDataFrame(rows, "component int, eigenvalue double, share double")

    def loading_table(self, spark: SparkSession) -> DataFrame:
        rows = [(n, i + 1, float(self.loadings[j, i])) for j, n in enumerate(self.names) for i in range(len(self.names))]
        return spark.createDataFrame(rows, "variable string, component int, loading double")

    def scores(self, df: DataFrame, keep: list[str], k: int = 2) -> DataFrame:
        """Component scores of the complete cases, as column expressions."""
        src = design(df, columns_of([var(n) for n in self.names]), keep)
        out = []
        for c in range(k):
            expr = F.lit(0.0)
            for n, m, s, w in zip(self.names, self.mean, self.sd, self.loadings[:, c]):
                expr = expr + (F.col(f"`{n}`") - F.lit(float(m))) * F.lit(float(w / s))
            out.append(expr.alias(f"pc{c + 1}"))
        return src.select(*keep, *out)


def pca(df: DataFrame, cols: list[str], scale: bool = True) -> Components:
    """Principal components of the correlation (or covariance) matrix; largest absolute loading positive."""
    g = gram(df, columns_of([var(c) for c in cols]))
    cov = g.m / (g.n - 1)
    sd = np.sqrt(np.diag(cov)) if scale else np.ones(len(cols))
    val, vec = np.linalg.eigh(cov / np.outer(sd, sd))
    order = np.argsort(val)[::-1]
    vec = vec[:, order]
    big = np.round(np.abs(vec), 12).argmax(axis=0)
    vec = vec * np.where(vec[big, range(len(cols))] < 0, -1.0, 1.0)
    return Components(list(cols), val[order], vec, g.mean, sd)
