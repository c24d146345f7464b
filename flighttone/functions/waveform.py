"""Operators on the samples of one recording."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flighttone.functions.batches import row_map, row_value
from flighttone.params import DEFAULT, Params

#: Factors offered to users: -1 inverts, 0 normalises to the largest magnitude.
SCALE_FACTORS = (-1, 0, 1, 2, 5, 10, 20, 50, 100)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def scale_waveform(df: DataFrame, factor: float = -1, column: str = "waveform") -> DataFrame:
    """Multiply by ``factor``; 0 divides by the largest magnitude (silence stays silent).

    In Arrow batches, so that the kernels that follow share one result instead
    of each evaluating an expression over all samples.
    """

    def scaled(x: np.ndarray) -> np.ndarray:
        if factor != 0:
            return x * factor
        largest = np.abs(x).max(axis=1, keepdims=True)
        return x / np.where(largest > 0, largest, 1)

    return df.withColumn(column, F.coalesce(row_map(scaled)(column), F.col(column)))


def pad_waveform(df: DataFrame, n: int = 256, column: str = "waveform") -> DataFrame:
    """Zeros on both sides up to ``n`` samples; half widths round to even, as they always did."""
    width = F.bround((F.lit(n) - F.size(column)) / 2).cast("int")
    zeros = F.array_repeat(F.lit(0.0), width)
    return df.withColumn(
        column,
        F.when(F.size(column) < n, F.concat(zeros, F.col(column), zeros)).otherwise(F.col(column)),
    )


def time_axis(df: DataFrame, p: Params = DEFAULT, column: str = "waveform") -> DataFrame:
    """Sample times ``t_ms`` and total length ``t_max_ms``."""
    step = 1000.0 / p.sr
    return df.withColumns(
        {
            "t_ms": F.transform(F.sequence(F.lit(0), F.size(column) - 1), lambda i: i * step),
            "t_max_ms": F.size(column) * step,
        }
    )


def rms(df: DataFrame, column: str = "waveform") -> DataFrame:
    """Time-domain power and its root."""
    powered = df.withColumn(
        "td_power", _sum(F.transform(column, lambda x: x * x)) / F.size(column)
    )
    return powered.withColumn("rms", F.sqrt("td_power"))


def duration(df: DataFrame, p: Params = DEFAULT, column: str = "waveform") -> DataFrame:
    """Milliseconds in which the power within one millisecond either side is above the noise."""
    w, edge, per_ms = round(p.sr / 1000), p.half_window_ms * round(p.sr / 1000), p.sr / 1000

    def above(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        centres = np.arange(edge, n - edge + 1)
        if w == 0 or len(centres) == 0:
            return np.zeros(len(x))
        energy = np.pad(np.cumsum(x * x, axis=1), ((0, 0), (1, 0)))
        mean = (energy[:, centres + w] - energy[:, centres - w]) / (2 * w)
        limit = p.noise_floor / (n / per_ms) * p.duration_factor
        return (mean / (2 * p.half_window_ms) > limit).sum(axis=1) / per_ms

    return df.withColumn("dur_ms", row_value(above)(column))


def moving_power(samples: DataFrame, w: int) -> DataFrame:
    """Long form ``(rec_id, n, x)``: mean power over ``[n - w, n + w)``."""
    near = Window.partitionBy("rec_id").orderBy("n").rowsBetween(-w, w - 1)
    return samples.withColumn("power", F.avg(F.col("x") * F.col("x")).over(near))


def samples_long(df: DataFrame, column: str = "waveform") -> DataFrame:
    return df.select("rec_id", F.posexplode(column).alias("n", "x"))
