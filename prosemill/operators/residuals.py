"""Features less what covariates explain of them, as a stage that is fitted once, saved, and applied to other rows."""

from __future__ import annotations

import numpy as np
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Columns(Params):
    featureCols = Param(Params._dummy(), "featureCols", "columns that become residuals", TypeConverters.toListString)
    covariateCols = Param(Params._dummy(), "covariateCols", "columns that they are explained by", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "names of the residuals; those of the features if not set", TypeConverters.toListString)

    def _outputs(self) -> list[str]:
        return self.getOrDefault("outputCols") if self.isSet("outputCols") else self.getOrDefault("featureCols")


class Residualizer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Least squares of each feature on the covariates and an intercept.

    Rows with a null in any of these columns don't teach; their residuals are
    null where the feature or a covariate is. One scan takes means and
    covariances; covariates that others explain share their weight. Of a table
    without rows all weights are 0.
    """

    @keyword_only
    def __init__(self, *, featureCols: list[str] | None = None, covariateCols: list[str] | None = None, outputCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> ResidualizerModel:
        feats, covs = self.getOrDefault("featureCols"), self.getOrDefault("covariateCols")
        d = dataset.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate([*covs, *feats])]).dropna()
        k, n = len(covs), len(covs) + len(feats)
        pairs = [(i, j) for i in range(k) for j in range(i, n)]
        r = d.agg(*[F.avg(f"c{i}").alias(f"m{i}") for i in range(n)], *[F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs]).first()
        mean = np.array([r[f"m{i}"] or 0.0 for i in range(n)])
        v = np.zeros((k, n))
        for i, j in pairs:
            v[i, j] = r[f"v{i}_{j}"] or 0.0
            if j < k:
                v[j, i] = v[i, j]
        scale = np.sqrt(np.where(np.diag(v[:, :k]) > 0, np.diag(v[:, :k]), 1)) if k else np.zeros(0)
        slope = np.linalg.lstsq(v[:, :k] / np.outer(scale, scale), v[:, k:] / scale[:, None], rcond=1e-12)[0] / scale[:, None] if k else np.zeros((0, len(feats)))
        start = mean[k:] - mean[:k] @ slope
        return ResidualizerModel(featureCols=feats, covariateCols=covs, outputCols=self._outputs(), weights=np.vstack([start, slope]).T.ravel().tolist())


class ResidualizerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """What Residualizer fits; adds or replaces outputCols."""

    weights = Param(Params._dummy(), "weights", "for each feature its intercept and the covariates' slopes", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, featureCols: list[str] | None = None, covariateCols: list[str] | None = None, outputCols: list[str] | None = None, weights: list[float] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        feats, covs, w = self.getOrDefault("featureCols"), self.getOrDefault("covariateCols"), self.getOrDefault("weights")
        k = len(covs) + 1
        explained = lambda i: sum((F.lit(b) * F.col(c) for b, c in zip(w[i * k + 1 : (i + 1) * k], covs, strict=True)), F.lit(w[i * k]))
        return dataset.withColumns({o: F.col(f) - explained(i) for i, (f, o) in enumerate(zip(feats, self._outputs(), strict=True))})
