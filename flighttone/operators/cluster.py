"""Clusterings of a feature table: ``assignments(rec_id, label, is_core)``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flighttone.operators.joins import cycle_label, relabel
from flighttone.operators.mixture import SEED as MIXTURE_SEED
from flighttone.operators.mixture import apply_mixture, fit_mixture
from flighttone.operators.pairwise import density_clusters, silhouette
from flighttone.operators.spectral import spectral_labels
from flighttone.scale import materialize, small_side, with_running_totals

__all__ = [
    "CLUSTERERS", "ckmeans", "clustering_summary", "cycle_label", "dbscan", "dbscan_sweep",
    "eps_grid", "file_groups", "gaussian_mixture", "kmeans", "next_eps", "relabel", "spectral",
]

# Fixed seed.
KMEANS_SEED = 0


def _vectors(df: DataFrame) -> DataFrame:
    return df.select("rec_id", array_to_vector("features").alias("v"))


def _assigned(df: DataFrame) -> DataFrame:
    return df.select("rec_id", F.col("label").cast("int").alias("label"), F.lit(True).alias("is_core"))


def file_groups(df: DataFrame) -> DataFrame:
    """The groups the files came in."""
    return _assigned(df.withColumn("label", F.col("group_id")))


def kmeans(df: DataFrame, k: int, seed: int = KMEANS_SEED) -> DataFrame:
    """Nearest of ``k`` centres."""
    data = _vectors(df)
    model = KMeans(k=k, seed=seed, featuresCol="v", predictionCol="label", maxIter=300).fit(data)
    return _assigned(model.transform(data))


def gaussian_mixture(df: DataFrame, k: int, seed: int = MIXTURE_SEED) -> DataFrame:
    """Most likely of at most ``k`` normal components; unused ones leave no gap in the labels."""
    placed = apply_mixture(df.select("rec_id", "features"), fit_mixture(df, k, seed))
    used = placed.select("label").distinct().withColumn(
        "_new", F.dense_rank().over(Window.orderBy("label")) - 1  # at most k rows
    )
    return _assigned(
        placed.join(F.broadcast(used), "label").drop("label").withColumnRenamed("_new", "label")
    )


def spectral(df: DataFrame, k: int, neighbours: int = 4) -> DataFrame:
    """Slowest modes of a walk on the graph of nearest neighbours, clustered by k-means."""
    return _assigned(spectral_labels(df, k, neighbours))


# --- density -----------------------------------------------------------------


def dbscan(df: DataFrame, eps: float, min_pts: int = 5) -> DataFrame:
    return density_clusters(df, [eps], min_pts).select("rec_id", "label", "is_core")


def dbscan_sweep(df: DataFrame, eps_list: Sequence[float], min_pts: int = 5) -> DataFrame:
    """Labels for each radius; tiles and distances are shared by all."""
    found = density_clusters(df, eps_list, min_pts)
    radii = F.array(*[F.lit(float(e)) for e in eps_list])
    return found.select(F.element_at(radii, F.col("e") + 1).alias("eps"), "rec_id", "label", "is_core")


def eps_grid() -> list[float]:
    """Radii offered to users: one to nine times each range."""
    return [round(r * m, 2) for r in (0.01, 0.1, 1, 10) for m in range(1, 10)]


def next_eps(eps: float, range_: float, step: float) -> float:
    """Move a radius by ``step`` tenths of its range; it stays positive."""
    change = range_ / 10 * step
    return eps + change if eps + change > 0 else abs(change)


# --- least squares on a line ----------------------------------------------------

#: Most split points solved between two already solved neighbours in one pass.
FAN_OUT = 128
#: Positions of the value axis held by one row of the block table.
AXIS_BLOCK = 512


def _axis(df: DataFrame, column: str, shift: float) -> DataFrame:
    """Distinct values in order with running weight, sum and sum of squares."""
    values = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("w"))
    moved = F.col("v") - F.lit(shift)
    totals = with_running_totals(
        values, ["v"], {"i": F.lit(1), "sw": F.col("w"), "s1": F.col("w") * moved,
                        "s2": F.col("w") * moved * moved},
    )
    return totals.withColumn("i", F.col("i") - 1)


def _blocked(axis: DataFrame) -> DataFrame:
    """The axis as arrays of consecutive positions, one row per block."""
    packed = F.array_sort(F.collect_list(F.struct("i", "sw", "s1", "s2", "cost")))
    return axis.groupBy(F.floor(F.col("i") / AXIS_BLOCK).alias("block")).agg(packed.alias("points"))


def _best_split(tasks: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each task the split ``j`` in ``lo..hi`` with the least cost.

    The left part ends at ``j`` and costs ``cost[j]``; the right part is
    ``j+1..i``.  A task meets only the blocks its range touches.
    """
    span = F.sequence(F.floor(F.col("lo") / AXIS_BLOCK), F.floor(F.col("hi") / AXIS_BLOCK))
    met = tasks.withColumn("block", F.explode(span)).join(blocks, "block")
    cheapest = F.expr(
        "array_min(transform(filter(points, p -> p.i between lo and hi), p -> struct(p.cost"
        " + greatest(0D, s2 - p.s2 - (s1 - p.s1) * (s1 - p.s1) / (sw - p.sw)) as cost, p.i as split)))"
    )
    found = met.select("i", cheapest.alias("b"))
    return found.groupBy("i").agg(F.min("b").alias("b")).select("i", "b.cost", "b.split")


def _next_layer(axis: DataFrame, n: int, parts: int) -> DataFrame:
    """Least cost of cutting ``0..i`` into ``parts`` for every ``i``, with the last split.

    The best split never moves left as ``i`` grows, so solved points bound the
    search of those between them: each pass solves up to ``FAN_OUT`` more per gap.
    """
    blocks = materialize(_blocked(axis))
    sums = axis.select("i", "sw", "s1", "s2")
    passes = max(1, math.ceil(math.log(n) / math.log(FAN_OUT)))
    fan = max(2, math.ceil(n ** (1 / passes)))
    gap, solved = n, None
    while gap > 1:
        wide, gap = gap, max(1, -(-gap // fan))
        here = sums.filter((F.col("i") >= parts - 1) & (F.col("i") % gap == 0))
        if solved is None:
            tasks = here.withColumns({"lo": F.lit(parts - 2).cast("long"), "hi": F.col("i") - 1})
        else:
            place = F.floor(F.col("i") / wide)
            grid = solved.filter(F.col("i") % wide == 0)
            left = grid.select(place.alias("_g"), F.col("split").alias("_lo"))
            right = grid.select((place - 1).alias("_g"), F.col("split").alias("_hi"))
            fresh = here.join(solved.select("i"), "i", "left_anti").withColumn("_g", place)
            bounded = fresh.join(left, "_g", "left").join(right, "_g", "left")
            tasks = bounded.select(
                "i", "sw", "s1", "s2",
                F.coalesce("_lo", F.lit(parts - 2)).cast("long").alias("lo"),
                F.least(F.coalesce("_hi", F.col("i") - 1), F.col("i") - 1).alias("hi"),
            )
        found = _best_split(tasks, blocks)
        solved = materialize(found if solved is None else solved.unionByName(found))
    return solved


def ckmeans(df: DataFrame, column: str, k: int) -> DataFrame:
    """Optimal clusters of one number (Wang & Song 2011): labels 0..k-1 ascending.

    Equal values are one weighted point.  Only the last layer's single best
    split and ``k - 1`` look-ups reach the driver.
    """
    stats = df.agg(F.avg(column).alias("m"), F.count(F.lit(1)).alias("n")).first()
    if k < 1 or k > stats["n"]:
        raise ValueError("between one cluster and one per recording are possible")
    axis = materialize(_axis(df, column, stats["m"]))
    n = axis.count()
    first = F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / F.col("sw"))
    layers = [axis.withColumn("cost", first)]
    clusters = min(k, n)
    for parts in range(2, clusters):
        layer = _next_layer(layers[-1], n, parts)
        layers.append(materialize(axis.join(layer, "i")))
    cuts: list[float] = []
    right = n - 1
    for parts in range(clusters, 1, -1):
        layer = layers[parts - 2]
        if parts == clusters:
            end = axis.filter(F.col("i") == right).first()
            weight, total = F.lit(end["sw"]) - F.col("sw"), F.lit(end["s1"]) - F.col("s1")
            cost = F.col("cost") + F.greatest(
                F.lit(0.0), F.lit(end["s2"]) - F.col("s2") - total * total / weight
            )
            split = layer.filter(F.col("i").between(parts - 2, right - 1)).agg(
                F.min(F.struct(cost.alias("c"), F.col("i"), F.col("v"))).alias("b")
            ).first()["b"]
            cuts.append(split["v"])
            right = split["i"]
        else:
            at = layers[parts - 1].filter(F.col("i") == right).first()["split"]
            cuts.append(axis.filter(F.col("i") == at).first()["v"])
            right = at
    label = F.lit(0)
    for cut in cuts:
        label = label + (F.col(column) > F.lit(cut)).cast("int")
    return _assigned(df.withColumn("label", label))


# --- summary -------------------------------------------------------------------


def clustering_summary(features: DataFrame, assignments: DataFrame, method: str, parameter: float,
                       ignore_noise: bool = False, score: str = "euclidean") -> DataFrame:
    """One row: method, parameter, clusters without noise, silhouette."""
    joined = features.select("rec_id", "features").join(assignments.select("rec_id", "label"), "rec_id")
    found = assignments.filter("label >= 0").agg(F.countDistinct("label").cast("int"))
    return silhouette(joined, ignore_noise, score).select(
        F.lit(method).alias("method"),
        F.lit(float(parameter)).alias("parameter"),
        found.scalar().alias("n_clusters"),
        "silhouette",
    )


CLUSTERERS = {
    "kmeans": kmeans,
    "gaussian_mixture": gaussian_mixture,
    "spectral": spectral,
    "dbscan": dbscan,
}
