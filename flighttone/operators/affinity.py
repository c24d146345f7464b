"""Neighbour affinities of a feature table, the input of a neighbour embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.functions.batches import matrices
from flighttone.operators.neighbours import neighbour_lists


def _bandwidths(d2: np.ndarray, target: float) -> np.ndarray:
    """Precision per row whose Gaussian weights have entropy ``target``, by bisection."""
    d2 = d2 - d2.min(axis=1, keepdims=True)
    low = np.full(len(d2), -80.0)
    high = np.full(len(d2), 80.0)
    for _ in range(100):
        middle = (low + high) / 2
        with np.errstate(over="ignore", under="ignore"):
            scaled = d2 * np.exp(middle)[:, None]
            weight = np.exp(-scaled)
            share = weight / weight.sum(axis=1, keepdims=True)
            entropy = np.log(weight.sum(axis=1)) + np.where(weight > 0, share * scaled, 0).sum(axis=1)
        wide = entropy > target
        low, high = np.where(wide, middle, low), np.where(wide, high, middle)
    return np.exp((low + high) / 2)


#: Neighbours looked at for each unit of perplexity; affinities beyond them are 0.
NEIGHBOURS = 3.0


def conditional_affinity(df: DataFrame, perplexity: float = 50, neighbours: float = NEIGHBOURS) -> DataFrame:
    """``rec_id, other, p``: shares of the ``neighbours * perplexity`` nearest neighbours, all others having none.

    The neighbours of one recording are a short list, so each search stays in a row.
    """
    lists = neighbour_lists(df, int(neighbours * perplexity))

    @F.arrow_udf("double")
    def precision(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column))
        for rows, d in matrices(column):
            out[rows] = _bandwidths(d * d, np.log(min(perplexity, d.shape[1])))
        return pa.array(out)

    sized = lists.withColumn("beta", precision("distances"))
    weighed = sized.withColumn(
        "_w", F.expr("transform(distances, d -> exp(-beta * (d * d - distances[0] * distances[0])))")
    ).withColumn("_sum", F.expr("aggregate(_w, 0D, (a, w) -> a + w)"))
    return weighed.select("rec_id", "_sum", F.inline(F.arrays_zip(F.col("others").alias("other"), F.col("_w").alias("w")))).select(
        "rec_id", "other", (F.col("w") / F.col("_sum")).alias("p")
    )


def neighbour_affinity(df: DataFrame, perplexity: float = 50, neighbours: float = NEIGHBOURS) -> DataFrame:
    """Symmetric affinities ``rec_id, other, p`` that add up to 1."""
    one_way = conditional_affinity(df, perplexity, neighbours)
    # Both directions of a pair add up to the same, once.
    low, high = F.least("rec_id", "other"), F.greatest("rec_id", "other")
    summed = one_way.groupBy(low.alias("low"), high.alias("high")).agg(F.sum("p").alias("p"))
    total = df.agg(F.count(F.lit(1))).scalar()
    there = F.struct(F.col("low").alias("rec_id"), F.col("high").alias("other"))
    back = F.struct(F.col("high").alias("rec_id"), F.col("low").alias("other"))
    return summed.withColumn("p", F.col("p") / (2 * total)).select("p", F.inline(F.array(there, back))).select("rec_id", "other", "p")
