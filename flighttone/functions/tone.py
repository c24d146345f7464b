"""Fundamental frequency: harmonic analysis, autocorrelation, harmonic product."""

from __future__ import annotations

import dataclasses

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flighttone.functions.batches import row_map
from flighttone.functions.spectrum import find_peaks
from flighttone.params import DEFAULT, Params

# Grade and score by number of hits, from one to five and more.
GRADES = ("F", "D", "C", "B", "A")
SCORES = (0, 1, 2, 2, 2)


def harmonic_f1(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Fundamental from the pattern of the strongest peaks.

    Each hypothesis says the reference peak is harmonic ``i``; it scores a hit
    for every other strong peak that fits, and one more when the typical peak
    distance equals its estimate.  Most hits win, then the lowest ``i``.
    """
    low, high = 1 - p.ha_tolerance, 1 + p.ha_tolerance
    near = f"between {low!r}D and {high!r}D"
    ordered = F.expr(
        "reverse(array_sort(transform(filter(peaks, t -> t.freq >= "
        f"{float(p.f1_min)!r}D), t -> struct(t.psd_db, t.freq))))"
    )
    steps: dict[str, Column] = {
        "_ordered": ordered,
        "_fs": F.expr(
            f"coalesce(get(filter(_ordered, t -> t.freq <= {float(p.f1_max)!r}D), 0).freq,"
            " get(_ordered, 0).freq)"
        ),
        "_strong": F.expr(f"array_sort(slice(_ordered, 1, {p.ha_peaks}).freq)"),
        "_gaps": F.expr(
            "array_sort(transform(_strong, (f, i) -> f - if(i = 0, 0D, _strong[i - 1])))"
        ),
        "psd_delta": F.expr(
            "if(size(_gaps) = 0, 0D,"
            " (_gaps[int((size(_gaps) - 1) / 2)] + _gaps[int(size(_gaps) / 2)]) / 2)"
        ),
        "_fits": F.expr(
            f"transform(sequence(1, {p.ha_hypotheses}), i -> struct(i, flatten(transform("
            f"filter(sequence(1, {p.ha_peaks}), j -> j != i), j -> filter(transform("
            "filter(_strong, f -> f != _fs), f -> f * (i / j)),"
            f" g -> g / _fs {near}))) as fits))"
        ),
        "_guesses": F.expr(
            "transform(_fits, t -> struct(t.i, size(t.fits) + 1 as n,"
            " (aggregate(t.fits, 0D, (a, g) -> a + g) + _fs) / (size(t.fits) + 1) / t.i as f1))"
        ),
        "_best": F.expr(
            f"array_max(transform(_guesses, t -> struct(t.n + if(psd_delta / t.f1 {near}, 1, 0)"
            " as hits, -t.i as o, t.f1)))"
        ),
        "_series": F.expr(
            f"aggregate(sequence(1, {p.ha_peaks}), struct(0 as n, true as more), (s, n) -> if(s.more,"
            f" struct(s.n + size(filter(_strong, f -> f / (n * _best.f1) {near})) as n,"
            f" (n = 1 or exists(_strong, f -> f / (n * _best.f1) {near})) as more), s))"
        ),
    }
    work = df
    for name, column in steps.items():
        work = work.withColumn(name, column)
    found = F.size("_ordered") > 0
    grade = F.element_at(F.array(*[F.lit(g) for g in GRADES]), F.least(F.col("_best.hits"), F.lit(5)))
    score = F.element_at(F.array(*[F.lit(s) for s in SCORES]), F.least(F.col("_best.hits"), F.lit(5)))
    verbose = F.concat(grade, F.lit(" ("), -F.col("_best.o"), F.lit("/"), F.col("_best.hits"), F.lit(")"))
    return work.withColumns(
        {
            "ha_f1": F.when(found, F.col("_best.f1")).otherwise(0.0),
            "ha_score": F.when(found, score).otherwise(0),
            "ha_grade": F.when(found, grade).otherwise("F"),
            "ha_verbose": F.when(found, verbose).otherwise("F (0)"),
            "ha_count": F.when(found, F.col("_series.n")).otherwise(0),
        }
    ).drop(*[n for n in steps if n.startswith("_")])


def _lag_correlation(x: np.ndarray, stop: int) -> np.ndarray:
    """Pearson r of each row with itself shifted by 0..stop-1; 0 beyond and where undefined."""
    n = x.shape[1]
    x = x - x.mean(axis=1, keepdims=True)
    total, square = (np.pad(np.cumsum(v, axis=1), ((0, 0), (1, 0))) for v in (x, x * x))
    out = np.zeros((len(x), min(n, stop + 1)))
    out[:, 0] = 1
    for lag in range(1, min(n - 1, stop)):
        m = n - lag
        late, early = total[:, n] - total[:, lag], total[:, m]
        var_late = square[:, n] - square[:, lag] - late**2 / m
        var_early = square[:, m] - early**2 / m
        joint = np.einsum("ij,ij->i", x[:, lag:], x[:, :m]) - late * early / m
        spread = np.sqrt(np.maximum(var_late, 0) * np.maximum(var_early, 0))
        floor = 1e-12 * np.maximum(square[:, n], 1e-300)
        out[:, lag] = np.where(spread > floor, joint / np.maximum(spread, 1e-300), 0)
    return np.clip(out, -1, 1)


def autocorrelation_curve(df: DataFrame, p: Params = DEFAULT, column: str = "waveform") -> DataFrame:
    """Curve ``ac`` by lag and its peaks ``ac_peak_idx``.

    The curve ends with the first lag out of range, where it is 0 by definition.  With
    ``use_unbiased`` the smooth bias under the waveform is taken off first.
    """
    if p.use_unbiased:
        free = als_baseline(df, column=column).withColumn("_free", F.zip_with(column, "bias", lambda x, b: x - b))
        return autocorrelation_curve(free, dataclasses.replace(p, use_unbiased=False), "_free").drop("_free", "bias")
    curve = df.withColumn("ac", row_map(lambda x: _lag_correlation(x, p.lag_stop))(column))
    return find_peaks(curve, "ac", p.ac_threshold, name="ac_peak_idx")


def best_lag(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Refine the first ``ac_peaks`` peaks in range and keep the one with the larger r.

    r is compared to nine digits, so a strictly periodic signal gives its first
    peak; without a peak ``ac_f1`` and ``ac_coeff`` are 0.
    """
    vertex = F.expr(
        f"transform(slice(filter(ac_peak_idx, l -> l >= {p.lag_start}), 1, {p.ac_peaks}), l -> struct(l,"
        " ac[l] as b, coalesce(try_divide(0.5D * (ac[l - 1] - ac[l + 1]), ac[l - 1] - 2D * ac[l] + ac[l + 1]), 0D) as s,"
        " ac[l - 1] - ac[l + 1] as d))"
    )
    refined = df.withColumn("_vertex", vertex).withColumn(
        "_best",
        F.expr(
            "array_max(transform(_vertex, (t, i) -> struct(round(t.b - 0.25D * t.d * t.s, 9) as c, -i as o,"
            f" t.b - 0.25D * t.d * t.s as r, {float(p.sr)!r}D / (t.l + t.s) as f)))"
        ),
    )
    return refined.withColumns(
        {
            "ac_f1": F.coalesce("_best.f", F.lit(0.0)),
            "ac_coeff": F.coalesce("_best.r", F.lit(0.0)),
        }
    ).drop("_vertex", "_best")


def autocorrelation(df: DataFrame, p: Params = DEFAULT, column: str = "waveform") -> DataFrame:
    """Autocorrelation of each recording: curve, fundamental and its coefficient."""
    return best_lag(autocorrelation_curve(df, p, column), p)


def lag_pairs(samples: DataFrame, max_lag: int) -> DataFrame:
    """Long form ``(rec_id, n, x)``: each sample beside the one ``lag`` later, lag 1..max_lag."""
    early = samples.select("rec_id", "n", F.col("x").alias("early")).withColumn(
        "lag", F.explode(F.sequence(F.lit(1), F.lit(max_lag)))
    )
    early = early.withColumn("n", F.col("n") + F.col("lag"))
    return early.join(samples.select("rec_id", "n", F.col("x").alias("late")), ["rec_id", "n"])


def als_baseline(df: DataFrame, lam: float = 500, p: float = 0.002, rounds: int = 5,
                 column: str = "waveform") -> DataFrame:
    """Smooth bias under the waveform (Eilers & Boelens 2005): ``bias``."""

    def solve(weight: np.ndarray, target: np.ndarray) -> np.ndarray:
        # L D L' of the five-diagonal system, all rows at once
        m, n = target.shape
        main = np.full(n, 6.0)
        main[[0, -1]], main[[1, -2]] = 1, 5
        side = np.full(n - 1, -4.0)
        side[[0, -1]] = -2
        diag, low1, low2 = np.empty((n, m)), np.zeros((n, m)), np.zeros((n, m))
        z = np.empty((n, m))
        for i in range(n):
            diag[i] = weight[:, i] + lam * main[i]
            z[i] = target[:, i]
            if i > 1:
                low2[i] = lam / diag[i - 2]
                diag[i] -= low2[i] * lam
                z[i] -= low2[i] * z[i - 2]
            if i > 0:
                joint = lam * side[i - 1] - (low2[i] * low1[i - 1] * diag[i - 2] if i > 1 else 0)
                low1[i] = joint / diag[i - 1]
                diag[i] -= low1[i] * joint
                z[i] -= low1[i] * z[i - 1]
        z /= diag
        for i in range(n - 2, -1, -1):
            z[i] -= low1[i + 1] * z[i + 1]
            if i < n - 2:
                z[i] -= low2[i + 2] * z[i + 2]
        return z.T

    def bias(y: np.ndarray) -> np.ndarray:
        if y.shape[1] < 5:
            raise ValueError("a baseline needs at least five samples")
        weight = np.ones_like(y)
        for _ in range(rounds):
            z = solve(weight, weight * y)
            weight = p * (y > z) + (1 - p) * (y < z)
        return z

    return df.withColumn("bias", row_map(bias)(column))


def hps(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Harmonic product of the 1 Hz spectrum: ``hps_f1``, ``hps_n`` and the curve ``hps_y``.

    The curve starts at ``hps_start`` Hz and is 1 at its maximum.
    """
    tol, n = p.hps_tolerance, "size(psd_interp)"
    limit = F.greatest(
        F.lit(2.0 * p.f1_min), F.least(F.lit(float(p.f1_max)), (1 + tol) * F.col("f1_est"))
    )
    work = df.withColumn("_limit", limit)
    work = work.withColumn(
        "hps_n",
        F.expr(f"array_max(filter(sequence(1, {p.hps_harmonics}), h -> h = 1 or ceil({n} / h) >= _limit))"),
    )
    work = work.withColumn("_kept", F.expr(f"cast(ceil({n} / hps_n) as int)"))
    first = F.ceil((1 - tol) * F.col("f1_est") / 2).cast("int")
    work = work.withColumn("_first", F.greatest(first, F.lit(int(p.f1_min))))
    product = F.expr(
        "transform(sequence(0, _kept - 1), k -> aggregate(sequence(1, hps_n), 1D,"
        " (a, h) -> a * psd_interp[least(k * h, size(psd_interp) - 1)]))"
    )
    work = work.withColumn("_product", product)
    # a maximum on the first point is the flank of something lower: move past it
    work = work.withColumn(
        "hps_start",
        F.expr(
            "coalesce(get(filter(sequence(_first, greatest(_first, int(ceil(f1_est)) - 1)), s ->"
            " s < _kept - 1 and _product[s] < array_max(slice(_product, s + 2, _kept))), 0),"
            " greatest(_first + 1, int(ceil(f1_est))))"
        ),
    )
    work = work.withColumn("_curve", F.expr("slice(_product, hps_start + 1, greatest(_kept - hps_start, 1))"))
    return (
        work.withColumn("_top", F.array_max("_curve"))
        .withColumn("hps_f1", F.expr("cast(hps_start + array_position(_curve, _top) - 1 as double)"))
        .withColumn("hps_y", F.expr("transform(_curve, v -> v / _top)"))
        .drop("_limit", "_kept", "_first", "_product", "_curve", "_top")
    )


def select_f1(df: DataFrame, method: str = "harmonic") -> DataFrame:
    """Choose the estimate used everywhere else: ``harmonic`` or ``autocorrelation``."""
    columns = {"harmonic": "ha_f1", "autocorrelation": "ac_f1"}
    return df.withColumn("f1", F.col(columns[method]))
