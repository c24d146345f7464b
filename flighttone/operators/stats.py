"""Group statistics, distributions and evaluation.

Every aggregate combines on the map side, so a label holding most rows costs no
more than a small one; exact percentiles go through ``scale.percentiles``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flighttone.params import DEFAULT, Params
from flighttone.scale import percentiles

# Fixed bin edges.
S2N_EDGES = (0, 10, 20, 50, 100, 200, 500, float("inf"))
POWER_EDGES = (-100, -50, -45, -40, -35, -30, -25, -20, -15, float("inf"))

HOURS = 24
#: Curves a task adds up before it passes them on.
HELD_CURVES = 2000


def _slope(y: str, x: str) -> Column:
    """Least-squares slope; 0 where ``x`` does not vary."""
    return F.coalesce(F.regr_slope(y, x), F.lit(0.0))


def _fit(y: str, x: str) -> Column:
    """R squared; where ``x`` does not vary 0, or 1 if ``y`` is constant as well."""
    flat = F.when(F.var_pop(y) == 0, 1.0).otherwise(0.0)
    return F.when(F.var_pop(x) == 0, flat).otherwise(F.coalesce(F.regr_r2(y, x), F.lit(0.0)))


def _with_median(df: DataFrame, by: Sequence[str], aggs: Sequence[Column], column: str,
                 name: str) -> DataFrame:
    """Aggregates of each group and, beside them, its median by rank."""
    # Groups without a value, and the group of null, have no row or no equal key on the right.
    left, right = df.groupBy(*by).agg(*aggs).alias("l"), percentiles(df, by, column, {name: 0.5}).alias("r")
    joined = left.join(right, [F.col(f"l.{b}").eqNullSafe(F.col(f"r.{b}")) for b in by], "left")
    return joined.select("l.*", f"r.{name}")


def summary(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """One row: count, f1 and duration statistics, and the limits charts are scaled to."""
    whole = df.withColumn("_all", F.lit(1))
    limits = []
    if "psd_min" in df.columns:
        limits.append(F.least(F.lit(0.0), F.min("psd_min")).alias("psd_min"))
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg("f1").alias("f1_mean"),
        F.stddev_pop("f1").alias("f1_std"),
        F.avg("dur_ms").alias("dur_mean"),
        F.stddev_pop("dur_ms").alias("dur_std"),
        *limits,
    ]
    return _with_median(whole, ["_all"], aggs, "f1", "f1_median").drop("_all")


def scale_limits(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Lowest level (never above 0 dB) and lowest top frequency (never above ``f_max``)."""
    return df.agg(
        F.least(F.lit(0.0), F.min("psd_min")).alias("psd_min"),
        F.least(F.lit(float(p.f_max)), F.min("f_top")).alias("f_top"),
    )


def temp_coefficient(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Slope and R squared of f1 over temperature."""
    return df.groupBy(*by).agg(
        _slope("f1", "temp").alias("slope"), _fit("f1", "temp").alias("r2")
    )


def group_summary(df: DataFrame, label: str = "label") -> DataFrame:
    """Count, mean, median, spread and temperature dependence of f1 per label."""
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.avg("f1").alias("f1_mean"),
        F.stddev_pop("f1").alias("f1_std"),
        _slope("f1", "temp").alias("slope"),
        _fit("f1", "temp").alias("r2"),
    ]
    return _with_median(df, [label], aggs, "f1", "f1_median")


def group_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def load_report(df: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Files per group and the total on every row; no rows means no data.

    ``groups``, a table of group names as ``order.group_dim`` gives it, adds those without a readable file, counted 0.
    """
    counts = df.groupBy("group_name").agg(F.count(F.lit(1)).alias("n"))
    if groups is not None:
        none = groups.select("group_name", F.lit(0).cast("long").alias("n"))
        counts = counts.unionByName(none).groupBy("group_name").agg(F.sum("n").alias("n"))
    return counts.withColumn("total", counts.agg(F.sum("n")).scalar())


def balance_report(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows per label and the largest over the smallest label."""
    counts = group_counts(df, label)
    extremes = counts.agg((F.max("n") / F.min("n")).alias("ratio"))
    return counts.withColumn("ratio", extremes.scalar())


def _filled(counts: DataFrame, label: str, bins: int) -> DataFrame:
    """A row for each label and bin.  ``counts`` is already one row per label and bin."""
    held = counts.groupBy(label).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_held")
    )
    every = held.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.withColumn("n", F.coalesce(F.expr("_held[bin]"), F.lit(0))).drop("_held")


def _binned(df: DataFrame, label: str, bin_: Column, bins: int) -> DataFrame:
    placed = df.select(label, bin_.cast("int").alias("bin")).groupBy(label, "bin").agg(
        F.count(F.lit(1)).alias("n")
    )
    # a label all of whose values are out of range still gets its zero rows
    inside = placed.withColumns(
        {"n": F.when(F.col("bin").isNull(), 0).otherwise(F.col("n")), "bin": F.coalesce("bin", F.lit(-1))}
    )
    return _filled(inside, label, bins)


def _edge_bin(column: str, edges: Sequence[float]) -> Column:
    """Half-open bins, the last one closed."""
    v, chain = F.col(column), None
    for i, (lo, hi) in enumerate(zip(edges, edges[1:])):
        inside = (v >= lo) & ((v < hi) if i < len(edges) - 2 else (v <= hi))
        chain = F.when(inside, i) if chain is None else chain.when(inside, i)
    return chain


def _distribution(df: DataFrame, column: str, edges: Sequence[float], label: str) -> DataFrame:
    counted = _binned(df, label, _edge_bin(column, edges), len(edges) - 1)
    total = F.sum("n").over(Window.partitionBy(label))
    return counted.withColumn("share", F.try_divide("n", total))


def s2n_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return _distribution(df, "s2n", S2N_EDGES, label)


def power_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return _distribution(df, "fd_power_db", POWER_EDGES, label)


def freq_histogram(df: DataFrame, label: str = "label", p: Params = DEFAULT) -> DataFrame:
    """Counts in bins of ``f1_step`` Hz; the top edge belongs to the last bin."""
    bins = round((p.f1_max - p.f1_min) / p.f1_step)
    f = F.col("f1")
    at = F.when(
        (f >= p.f1_min) & (f <= p.f1_max),
        F.least(F.floor((f - p.f1_min) / p.f1_step), F.lit(bins - 1)),
    )
    counted = _binned(df, label, at, bins)
    return counted.withColumn("f_low", F.lit(p.f1_min) + F.col("bin") * p.f1_step)


def freq_kde(df: DataFrame, label: str = "label", p: Params = DEFAULT) -> DataFrame:
    """Gaussian density of f1 per label on a grid of a fifth of the bandwidth.

    Both ends are 0 and the curve is scaled to the highest histogram bin.  Each
    task adds its own rows into one curve per label, so only curves are shuffled.
    """
    grid = np.arange(p.f1_min, p.f1_max, p.f1_step / 5)

    def out(sums: dict, kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums)).cast(kind),
                pa.array([c.tolist() for c, _ in sums.values()], pa.list_(pa.float64())),
                pa.array([n for _, n in sums.values()], pa.int64()),
            ],
            names=["label", "curve", "n"],
        )

    def curves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            kind = batch.schema.field(0).type
            labels = batch.column(0).to_pylist()
            f1 = batch.column(1).to_numpy(zero_copy_only=False)
            codes = {v: i for i, v in enumerate(dict.fromkeys(labels))}
            at = np.array([codes[v] for v in labels])
            for value, i in codes.items():
                curve, n = sums.get(value, (np.zeros(len(grid)), 0))
                mine = f1[at == i]
                for part in np.array_split(mine, -(-len(mine) // 2000)):
                    curve = curve + np.exp(-0.5 * ((grid - part[:, None]) / p.f1_step) ** 2).sum(axis=0)
                sums[value] = (curve, n + len(mine))
            if len(sums) > HELD_CURVES:
                yield out(sums, kind)
                sums = {}
        if sums:
            yield out(sums, kind)

    values = df.select(F.col(label).alias("label"), "f1").filter("f1 is not null")
    kind = values.schema["label"].dataType.simpleString()
    parts = values.mapInArrow(curves, f"label {kind}, curve array<double>, n bigint")
    points = parts.select("label", "n", F.posexplode("curve").alias("i", "v"))
    width = p.f1_step * float(np.sqrt(2 * np.pi))
    summed = points.groupBy("label", "i").agg((F.sum("v") / (F.sum("n") * width)).alias("v"))
    ended = summed.withColumn(
        "v", F.when(F.col("i").isin(0, len(grid) - 1), 0.0).otherwise(F.col("v"))
    )
    highest = freq_histogram(df, label, p).groupBy(F.col(label).alias("label")).agg(
        F.max("n").alias("_top")
    )
    scaled = ended.join(highest, "label").withColumn(
        "density", F.col("v") * F.col("_top") / F.max("v").over(Window.partitionBy("label"))
    )
    return scaled.select(
        F.col("label").alias(label),
        (F.lit(p.f1_min) + F.col("i") * (p.f1_step / 5)).alias("freq"),
        "density",
    )


def activity_by_hour(df: DataFrame, label: str = "label") -> DataFrame:
    """Recordings per hour of the day, all days folded into one."""
    counted = _binned(df, label, F.hour("dt"), HOURS)
    return counted.withColumnRenamed("bin", "hour")


# --- evaluation -----------------------------------------------------------------


def confusion(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    """Counts by true and predicted label, and the share of the true label."""
    counts = df.groupBy(F.col(true).alias("true"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("true")))


def accuracy(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    return df.agg(F.avg((F.col(true) == F.col(pred)).cast("int")).alias("accuracy"))


def _rates(of: Column, said: Column) -> dict[str, Column]:
    tp = F.sum((of & said).cast("int"))
    tn = F.sum((~of & ~said).cast("int"))
    fp = F.sum((~of & said).cast("int"))
    fn = F.sum((of & ~said).cast("int"))
    total = tp + tn + fp + fn
    return {
        "accuracy": F.try_divide(tp + tn, total),
        "tpr": F.try_divide(tp, fn + tp),
        "fpr": F.try_divide(fp, tn + fp),
        "fnr": F.try_divide(fn, fn + tp),
        "precision": F.try_divide(tp, fp + tp),
        "npv": F.try_divide(tn, tn + fn),
        "prevalence": F.try_divide(tp + fn, total),
    }


def binary_metrics(df: DataFrame, true: str = "label", pred: str = "prediction",
                   positive: int = 1) -> DataFrame:
    of, said = F.col(true) == positive, F.col(pred) == positive
    return df.agg(*[c.alias(n) for n, c in _rates(of, said).items()])


def class_metrics(df: DataFrame, true: str = "label", pred: str = "prediction") -> DataFrame:
    """The binary metrics of each class against the rest, from the confusion counts."""
    cells = df.groupBy(true, pred).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col(true).alias("class"), F.col("n").alias("of"), F.lit(0).cast("long").alias("said"),
                         F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0).alias("tp")),
                F.struct(F.col(pred).alias("class"), F.lit(0).cast("long").alias("of"), F.col("n").alias("said"),
                         F.lit(0).cast("long").alias("tp")),
            )
        ).alias("s")
    ).select("s.*")
    sums = sides.groupBy("class").agg(F.sum("of").alias("of"), F.sum("said").alias("said"), F.sum("tp").alias("tp"))
    t = sums.withColumn("n", df.agg(F.count(F.lit(1))).scalar())
    tp, fn, fp = F.col("tp"), F.col("of") - F.col("tp"), F.col("said") - F.col("tp")
    tn = F.col("n") - F.col("of") - F.col("said") + F.col("tp")
    return t.select(
        "class",
        F.try_divide(tp + tn, F.col("n")).alias("accuracy"),
        F.try_divide(tp, tp + fn).alias("tpr"),
        F.try_divide(fp, tn + fp).alias("fpr"),
        F.try_divide(fn, fn + tp).alias("fnr"),
        F.try_divide(tp, fp + tp).alias("precision"),
        F.try_divide(tn, tn + fn).alias("npv"),
        F.try_divide(tp + fn, F.col("n")).alias("prevalence"),
    )
