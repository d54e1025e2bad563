"""Maximum-likelihood logit / multinomial logit, many fits at once.

The fits (imputed copies, outcomes) are keys of one dataset. Every Newton pass is one Spark job: tasks reduce their rows
to one small gradient and Hessian per key, these are added up by key, and only the totals (a few hundred numbers per
key) reach the driver for the p x p step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from panelwright.sources.writers import settle


def _probabilities(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Class probabilities; class 0 is the base with a zero score."""
    scores = np.hstack([np.zeros((len(x), 1)), x @ beta.T])
    scores -= scores.max(axis=1, keepdims=True)
    e = np.exp(scores)
    return e / e.sum(axis=1, keepdims=True)


def _score(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Log-likelihood, gradient and Hessian of one block of rows, flattened into one vector."""
    p = _probabilities(x, beta)
    k, q = beta.shape
    loglik = (w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
    residual = (y[:, None] == np.arange(1, k + 1)) - p[:, 1:]
    gradient = (residual * w[:, None]).T @ x
    hessian = np.empty((k, q, k, q))
    for a in range(k):
        for b in range(k):
            v = w * p[:, a + 1] * ((a == b) - p[:, b + 1])
            hessian[a, :, b, :] = (x * v[:, None]).T @ x
    return np.concatenate([[loglik], gradient.ravel(), hessian.ravel()])


def fit_softmax(df: DataFrame, keys: Sequence[str], x: str, label: str, weight: str, n_classes: int,
                max_passes: int = 100, tolerance: float = 1e-9, ridge: float = 1e-8) -> DataFrame:
    """(keys, beta, passes, separable): beta flattens a (n_classes - 1) x p matrix against class 0.

    A fit that has not converged after ``max_passes`` passes is an error. ``separable``: the classes can be told apart
    without error, so the likelihood has no maximum and the coefficients are only where its growth stopped.
    ``x`` is an array<double> column with its own intercept, ``label`` an int in 0..n_classes-1.
    """
    spark = df.sparkSession
    keys = list(keys)
    rows = settle(df.select(*keys, x, label, weight), "fit")
    widths = rows.groupBy(*keys).agg(F.max(F.size(x)).alias("p")).collect()
    key_fields = [rows.schema[k] for k in keys]
    shape = {tuple(r[k] for k in keys): (n_classes - 1, r["p"]) for r in widths}
    beta = {k: np.zeros(s) for k, s in shape.items()}
    step = {k: np.zeros(s) for k, s in shape.items()}
    best = {k: -np.inf for k in shape}
    open_keys = set(shape)
    passes = dict.fromkeys(shape, 0)
    total_schema = StructType([*key_fields, StructField("i", IntegerType()), StructField("v", DoubleType())])

    for _ in range(max_passes):
        current = {k: beta[k] for k in open_keys}

        def partial(batches: Iterator[pd.DataFrame], current=current) -> Iterator[pd.DataFrame]:
            sums: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for key, part in pdf.groupby(keys, sort=False):
                    if key in current:
                        s = _score(np.stack(part[x].to_numpy()), part[label].to_numpy(), part[weight].to_numpy(float),
                                   current[key])
                        sums[key] = sums.get(key, 0) + s
            for key, s in sums.items():
                yield pd.DataFrame({**dict(zip(keys, key)), "i": np.arange(len(s), dtype="int32"), "v": s})

        totals = rows.mapInPandas(partial, total_schema).groupBy(*keys, "i").agg(F.sum("v").alias("v")).toPandas()
        for key, part in totals.sort_values("i").groupby(keys, sort=False):
            key = tuple(k.item() if hasattr(k, "item") else k for k in key)
            values = part["v"].to_numpy()
            k, q = shape[key]
            if values[0] < best[key] - 1e-9:      # overshoot: go back half of the last step
                step[key] = step[key] / 2
                beta[key] = beta[key] - step[key]
                continue
            gain = values[0] - best[key]
            best[key] = values[0]
            gradient, hessian = values[1:1 + k * q], values[1 + k * q:].reshape(k * q, k * q)
            scale = np.maximum(np.diag(hessian), 1e-12)
            step[key] = np.linalg.solve(hessian + ridge * np.diag(scale), gradient).reshape(k, q)
            passes[key] += 1
            if gain < tolerance * (1 + abs(best[key])):
                open_keys.discard(key)
            else:
                beta[key] = beta[key] + step[key]
        if not open_keys:
            break

    if open_keys:
        raise RuntimeError(f"{len(open_keys)} of {len(shape)} fits have not converged after {max_passes} passes")
    schema = StructType([*key_fields, StructField("beta", ArrayType(DoubleType())), StructField("passes", IntegerType()),
                         StructField("separable", BooleanType())])
    return spark.createDataFrame([(*k, [float(v) for v in b.ravel()], passes[k], bool(best[k] > -1e-6)) for k, b in beta.items()], schema)
