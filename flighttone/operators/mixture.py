"""Variational Gaussian mixture with a stick-breaking prior (Bishop 2006, ch. 10; Blei & Jordan 2006).

Every round is one pass: tasks turn their rows into responsibilities and add up
weights, sums and products per component.  Only these sums, whose size depends
on the number of columns and components alone, reach the driver.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.scale import tree_sum

# Fixed values.
SEED = 101557
TOLERANCE = 1e-3
ROUNDS = 100
RIDGE = 1e-6


def _digamma(x: np.ndarray) -> np.ndarray:
    x = np.array(x, float)
    shift = np.zeros_like(x)
    while (x < 6).any():
        low = x < 6
        shift[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return shift + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def _log_shares(x: np.ndarray, m: dict) -> np.ndarray:
    """Expected log weight of each component for each row, up to a common constant."""
    d = x.shape[1]
    out = np.empty((len(x), len(m["means"])))
    for k, (mean, chol) in enumerate(zip(m["means"], m["chol"])):
        y = np.linalg.solve(chol, (x - mean).T)
        out[:, k] = -0.5 * (y * y).sum(axis=0) - np.log(np.diag(chol)).sum() + m["constant"][k]
    return out - 0.5 * d * np.log(2 * np.pi)


def _update(sums: np.ndarray, k: int, d: int, prior: dict) -> dict:
    """Posterior of all components from the sums of one pass."""
    n = sums[:, 0] + 10 * np.finfo(float).eps
    mean = sums[:, 1 : 1 + d] / n[:, None]
    scatter = sums[:, 1 + d :].reshape(k, d, d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
    beta, dof = 1 + n, d + n
    centre = (prior["mean"] + n[:, None] * mean) / beta[:, None]
    off = mean - prior["mean"]
    cov = prior["cov"] + n[:, None, None] * (scatter + RIDGE * np.eye(d))
    cov += (n / beta)[:, None, None] * off[:, :, None] * off[:, None, :]
    first = 1 + n
    rest = 1 / k + np.concatenate([np.cumsum(n[::-1])[-2::-1], [0]])
    total = _digamma(first + rest)
    stick = _digamma(rest) - total
    weight = _digamma(first) - total + np.concatenate([[0], np.cumsum(stick)[:-1]])
    steps = np.arange(d)
    spread = d * np.log(2) + _digamma(0.5 * (dof[:, None] - steps)).sum(axis=1) - d * np.log(dof)
    return {
        "means": centre,
        "chol": np.linalg.cholesky(cov / dof[:, None, None]),
        "constant": weight + 0.5 * (spread - d / beta),
    }


def _pass(data: DataFrame, k: int, d: int, m: dict | None) -> tuple[np.ndarray, float]:
    """Sums per component, and the mean log evidence; without a model rows keep their ``label``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, evidence = np.zeros((k, 1 + d + d * d)), 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack(batch.column("features").to_pandas().to_numpy())
            if m is None:
                r = np.eye(k)[batch.column("label").to_numpy()]
            else:
                logs = _log_shares(x, m)
                top = logs.max(axis=1, keepdims=True)
                whole = top + np.log(np.exp(logs - top).sum(axis=1, keepdims=True))
                r, evidence = np.exp(logs - whole), evidence + whole.sum()
            sums[:, 0] += r.sum(axis=0)
            sums[:, 1 : 1 + d] += r.T @ x
            for c in range(k):
                sums[c, 1 + d :] += ((r[:, c, None] * x).T @ x).ravel()
        whole = np.append(sums.ravel(), evidence).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([whole])], names=["block", "sums"])

    narrow = data.select("features", "label")
    rows = tree_sum(narrow.mapInArrow(add, "block long, sums binary"), k * (1 + d + d * d) + 1, narrow.rdd.getNumPartitions())
    sums = rows[:-1].reshape(k, -1)
    return sums, rows[-1] / max(sums[:, 0].sum(), 1)


def fit_mixture(df: DataFrame, k: int, seed: int = SEED) -> dict:
    """Means, covariance factors and constants of the posterior, started from k-means."""
    vectors = df.select("features", array_to_vector("features").alias("v"))
    start = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="label").fit(vectors)
    data = start.transform(vectors).select("features", "label").persist()
    d = len(data.first()["features"])
    whole, _ = _pass(data.withColumn("label", F.lit(0)), 1, d, None)
    n, mean = whole[0, 0], whole[0, 1 : 1 + d] / whole[0, 0]
    cov = (whole[0, 1 + d :].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)
    prior = {"mean": mean, "cov": cov + RIDGE * np.eye(d)}
    sums, last = _pass(data, k, d, None)[0], -np.inf
    for _ in range(ROUNDS):
        model = _update(sums, k, d, prior)
        sums, evidence = _pass(data, k, d, model)
        if abs(evidence - last) < TOLERANCE:
            break
        last = evidence
    else:
        warnings.warn(f"the mixture has not settled in {ROUNDS} rounds", RuntimeWarning, stacklevel=2)
    data.unpersist()
    return model


def apply_mixture(df: DataFrame, m: dict) -> DataFrame:
    """Most likely component of each row as ``label``."""
    from flighttone.functions.batches import row_value

    best = row_value(lambda x: _log_shares(x, m).argmax(axis=1).astype(float))
    return df.withColumn("label", best("features").cast("int"))
