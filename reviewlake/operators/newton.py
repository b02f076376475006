"""Logistic regression on a few numeric features by Newton steps.

A step is one aggregate over the rows: the gradient and the Hessian of the penalised
log-likelihood, d + d (d + 1) / 2 sums, which are all that reaches the driver; it
solves a d x d system and the next step's expressions carry the new coefficients.
Sums combine partially, so no key or group is hot, and the same steps can be written
in SQL.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INTERCEPT = "intercept"


def margin(features: Mapping[str, Column], coefficients: Mapping[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(float(coefficients[n])) * x for n, x in features.items()])


def fit_newton(rows: DataFrame, label: str, features: Mapping[str, Column], *, l2: float = 1.0,
               steps: int = 8) -> dict[str, float]:
    """Coefficients by feature name, with ``intercept``; all start at 0 and all are penalised by
    ``l2 / 2`` times their square, so that a separable set has a finite answer.

    Rows with a null label or feature do not count. Without rows all coefficients are 0.
    """
    every = {INTERCEPT: F.lit(1.0), **features}
    names = list(every)
    # Plain columns from here on: the features are computed once per step at most.
    known = rows.select(F.col(label).cast("double").alias("y"), *(x.cast("double").alias(f"x{i}")
                                                                 for i, x in enumerate(every.values()))).dropna()
    x = {n: F.col(f"x{i}") for i, n in enumerate(names)}
    beta = dict.fromkeys(names, 0.0)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    for _ in range(steps):
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin(x, beta)))
        row = known.withColumn("p", p).agg(
            *[F.sum((F.col("y") - F.col("p")) * x[n]).alias(f"g{i}") for i, n in enumerate(names)],
            *[F.sum(F.col("p") * (1 - F.col("p")) * x[names[i]] * x[names[j]]).alias(f"h{i}_{j}") for i, j in pairs]
        ).first()
        if row["g0"] is None:
            break
        old = np.array([beta[n] for n in names])
        gradient = np.array([row[f"g{i}"] for i in range(len(names))]) - l2 * old
        hessian = l2 * np.eye(len(names))
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"] + l2 * (i == j)
        beta = dict(zip(names, (old + np.linalg.solve(hessian, gradient)).tolist(), strict=True))
    return beta


def predict_newton(rows: DataFrame, features: Mapping[str, Column], coefficients: Mapping[str, float]) -> DataFrame:
    """``rows`` with ``score`` (probability of class 1)."""
    z = margin({INTERCEPT: F.lit(1.0), **features}, coefficients)
    return rows.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
