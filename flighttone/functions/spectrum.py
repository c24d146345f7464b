"""Power spectrum of each recording and what is read from it.

Transforms by a fixed matrix run in Arrow batches; everything else is a column
expression, so unused attributes are pruned by Catalyst.  No operator shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flighttone.functions.batches import matrices, row_map
from flighttone.params import DEFAULT, Params

# Fixed values for a recording without a peak.
NO_PEAK_DB = -100.0

PEAK_TYPE = "array<struct<idx:int,freq:double,psd_db:double>>"


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


# --- Welch 1967 ------------------------------------------------------------


def welch_psd(df: DataFrame, p: Params = DEFAULT, column: str = "waveform") -> DataFrame:
    """One-sided density: periodic Hann window, mean removed per segment, mean over segments."""

    def density(x: np.ndarray) -> np.ndarray:
        length = min(p.nperseg, x.shape[1])
        view = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)
        segments = view[:, :: length - p.overlap]
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
        centred = (segments - segments.mean(axis=2, keepdims=True)) * window
        power = np.abs(np.fft.rfft(centred, n=p.nfft, axis=2)) ** 2
        power = power.mean(axis=1) / (p.sr * (window**2).sum())
        power[:, 1 : p.nfft - p.nfft // 2] *= 2
        return power[:, : p.n_bins] + p.epsilon

    return df.withColumn("psd", row_map(density)(column))


def to_db(column: Column | str) -> Column:
    """Decibels; no power at all is minus infinity."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c == 0, float("-inf")).otherwise(F.lit(10.0) * F.log10(c))


def psd_db(df: DataFrame) -> DataFrame:
    levels = df.withColumn("psd_db", F.transform("psd", lambda x: F.lit(10.0) * F.log10(x)))
    return levels.withColumn("psd_min", F.array_min("psd_db"))


# --- mel scale -------------------------------------------------------------


def _hz_to_mel(f: np.ndarray) -> np.ndarray:
    return np.where(f < 1000, 3 * f / 200, 15 + 27 * np.log(np.maximum(f, 1e-9) / 1000) / np.log(6.4))


def _mel_to_hz(m: np.ndarray) -> np.ndarray:
    return np.where(m < 15, 200 * m / 3, 1000 * np.exp(np.log(6.4) * (m - 15) / 27))


def mel_weights(p: Params) -> np.ndarray:
    """Triangles equally spaced in mel over 0..sr/2, each of unit area."""
    top = _hz_to_mel(np.array([p.sr / 2]))[0]
    corner = _mel_to_hz(np.linspace(0, top, p.n_mels + 2))[:, None]
    f = np.arange(p.n_bins) * p.df
    rise = (f - corner[:-2]) / (corner[1:-1] - corner[:-2])
    fall = (corner[2:] - f) / (corner[2:] - corner[1:-1])
    return np.maximum(0, np.minimum(rise, fall)) * 2 / (corner[2:] - corner[:-2])


def cosine_weights(p: Params) -> np.ndarray:
    """Orthonormal DCT-II of the mel levels."""
    k, m = np.arange(p.n_mfcc)[:, None], np.arange(p.n_mels)
    basis = np.cos(np.pi * k * (2 * m + 1) / (2 * p.n_mels))
    return basis * np.where(k == 0, np.sqrt(1 / p.n_mels), np.sqrt(2 / p.n_mels))


def mel_spectrum(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    weights = mel_weights(p).T
    return df.withColumn("melspec_db", row_map(lambda psd: 10 * np.log10(psd @ weights))("psd"))


def mfcc(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    weights = cosine_weights(p).T
    return df.withColumn("mfcc", row_map(lambda levels: levels @ weights)("melspec_db"))


# --- baseline and peaks ------------------------------------------------------


def _lower_envelope(y: np.ndarray, degree: int, rounds: int = 100, tolerance: float = 1e-3) -> np.ndarray:
    """Polynomials fitted again and again to the smaller of data and last fit.

    A row settles when its coefficients, on an axis 0..max|y|^(1/(degree+1)),
    change by less than ``tolerance``.
    """
    powers = np.vander(np.linspace(0, 1, y.shape[1]), degree + 1)
    to_fit = np.linalg.pinv(powers)
    width = np.abs(y).max(axis=1, keepdims=True) ** (1 / (degree + 1))
    unit = np.where(width > 0, width, 1.0) ** np.arange(degree, -1, -1)
    data, base = y.copy(), y.copy()
    last = np.ones((len(y), degree + 1))
    open_rows = np.arange(len(y))
    for _ in range(rounds):
        fitted = data[open_rows] @ to_fit.T
        scaled = fitted / unit[open_rows]
        moved = np.linalg.norm(scaled - last[open_rows], axis=1)
        keep = moved >= tolerance * np.linalg.norm(last[open_rows], axis=1)
        open_rows, fitted, scaled = open_rows[keep], fitted[keep], scaled[keep]
        if len(open_rows) == 0:
            break
        last[open_rows] = scaled
        base[open_rows] = fitted @ powers.T
        data[open_rows] = np.minimum(data[open_rows], base[open_rows])
    return base


def spectral_baseline(df: DataFrame, deg: int = 9) -> DataFrame:
    """Slow part of the spectrum below its peaks, in dB and linear."""

    def fit(levels: np.ndarray) -> np.ndarray:
        lowest = levels.min(axis=1, keepdims=True)
        return _lower_envelope(levels - lowest, deg) + lowest

    based = df.withColumn("psd_baseline_db", row_map(fit)("psd_db"))
    return based.withColumn(
        "psd_baseline", F.transform("psd_baseline_db", lambda x: F.pow(F.lit(10.0), x / 10))
    )


def _spaced(row: np.ndarray, found: np.ndarray, min_dist: int) -> np.ndarray:
    """Highest peak first, each clearing ``min_dist`` places on both sides."""
    taken, kept = np.zeros(len(row), bool), np.zeros(len(row), bool)
    for i in found[np.lexsort((found, row[found]))[::-1]]:
        if not taken[i]:
            kept[i] = True
            taken[max(0, i - min_dist) : i + min_dist + 1] = True
    return np.flatnonzero(kept).astype(found.dtype)


def _peak_lists(x: np.ndarray, thres: float, min_dist: int) -> list[np.ndarray]:
    low, high = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    steps = np.diff(x, axis=1)
    # Where the values change next, so that a flat top is followed to its end.
    places = np.where(steps != 0, np.arange(steps.shape[1]), steps.shape[1])
    end = np.minimum.accumulate(places[:, ::-1], axis=1)[:, ::-1]
    rows, cols = np.nonzero(steps[:, :-1] > 0)
    begin = cols + 1
    end = end[rows, begin]
    falls = (end < steps.shape[1]) & (steps[rows, np.minimum(end, steps.shape[1] - 1)] < 0)
    tall = (x[rows, begin] > low[rows, 0] + thres * (high - low)[rows, 0]) & falls
    rows, found = rows[tall], (begin + (end - begin) // 2)[tall]
    lists = np.split(found, np.searchsorted(rows, np.arange(1, len(x))))
    if min_dist > 1:
        lists = [_spaced(row, found, min_dist) for row, found in zip(x, lists)]
    return lists


def find_peaks(
    df: DataFrame,
    values: str,
    thres: float = 0.25,
    min_dist: int = 1,
    name: str = "peak_idx",
    below: str | None = None,
) -> DataFrame:
    """Indices of local maxima above ``min + thres * (max - min)``, ascending.

    A flat top is one peak, in its middle, the left one of two.
    With ``min_dist`` over 1 the highest peak goes first and clears that many
    places on both sides.  ``below`` names a column to take off the values first.
    """

    @F.arrow_udf("array<int>")
    def peaks(levels: pa.Array, base: pa.Array) -> pa.Array:
        out: list = [None] * len(levels)
        floors = {} if below is None else {rows.tobytes(): m for rows, m in matrices(base)}
        for rows, x in matrices(levels):
            flat = x - floors[rows.tobytes()] if floors else x
            found = _peak_lists(flat, thres, min_dist) if x.shape[1] > 2 else [[]] * len(x)
            for row, places in zip(rows, found):
                out[row] = places
        return pa.array(out, pa.list_(pa.int32()))

    return df.withColumn(name, peaks(values, below or values))


def psd_peaks(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Peak bins of the spectrum after its baseline is taken off."""
    return find_peaks(df, "psd_db", p.peak_threshold, p.peak_distance, below="psd_baseline_db")


def refine_peaks(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Vertex of the parabola through each peak and its neighbours; low peaks are dropped."""
    vertex = F.expr(
        "transform(transform(peak_idx, i -> struct(i, psd_db[i - 1] as a, psd_db[i] as b,"
        " psd_db[i + 1] as c)), t -> struct(t.i, t.a, t.b, t.c,"
        " coalesce(try_divide(0.5D * (t.a - t.c), t.a - 2D * t.b + t.c), 0D) as s))"  # the middle of a flat top
    )
    refined = F.expr(
        f"transform(_vertex, t -> struct(cast(t.i as int) as idx, (t.i + t.s) * {p.df!r}D as freq,"
        " t.b - 0.25D * (t.a - t.c) * t.s as psd_db))"
    )
    none = F.array(
        F.struct(
            F.lit(0).alias("idx"), F.lit(0.0).alias("freq"), F.lit(NO_PEAK_DB).alias("psd_db")
        )
    )
    return (
        df.withColumn("_vertex", vertex)
        .withColumn("_peaks", F.filter(refined, lambda t: t.freq >= p.f1_min))
        .withColumn(
            "peaks", F.when(F.size("_peaks") > 0, F.col("_peaks")).otherwise(none).cast(PEAK_TYPE)
        )
        .drop("_vertex", "_peaks")
    )


def _strongest(peaks: Column) -> Column:
    """First of the highest peaks of an ascending list."""
    return F.array_max(
        F.transform(
            peaks, lambda t: F.struct(t.psd_db.alias("psd_db"), (-t.idx).alias("o"), t.freq.alias("freq"))
        )
    )


def f1_estimate(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Strongest peak at or below ``f1_max``, else ``f1_max``."""
    low = F.filter("peaks", lambda t: t.freq <= p.f1_max)
    return df.withColumn("f1_est", F.coalesce(_strongest(low).freq, F.lit(float(p.f1_max))))


def top_peaks(df: DataFrame, n: int = 5, f_max: float | None = None) -> DataFrame:
    """The ``n`` strongest peaks, strongest first; ties go to the higher frequency."""
    peaks = F.col("peaks") if f_max is None else F.filter("peaks", lambda t: t.freq <= f_max)
    ordered = F.reverse(
        F.array_sort(F.transform(peaks, lambda t: F.struct(t.psd_db, t.freq, t.idx)))
    )
    return df.withColumn("top_peaks", F.slice(ordered, 1, n))


# --- power and signal to noise ----------------------------------------------


def band_power(df: DataFrame, p: Params = DEFAULT, lo: float | None = None, hi: float | None = None,
               column: str = "psd", name: str = "power") -> DataFrame:
    """Bin width times the sum over bins with ``lo <= f < hi``."""
    first = 0 if lo is None else int(np.ceil(lo / p.df))
    last = p.n_bins if hi is None else int(np.ceil(hi / p.df))
    bins = F.slice(column, first + 1, max(last - first, 0))
    return df.withColumn(name, _sum(bins) * p.df)


def signal_powers(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Signal, baseline and low-frequency power, the first two in dB as well."""
    powered = band_power(df, p, lo=p.f_min, name="fd_power")
    powered = band_power(powered, p, lo=p.f_min, column="psd_baseline", name="fd_power_baseline")
    powered = band_power(powered, p, hi=p.f_min, name="fd_power_lf")
    return powered.withColumns(
        {"fd_power_db": to_db("fd_power"), "fd_baseline_db": to_db("fd_power_baseline")}
    )


def signal_to_noise(df: DataFrame) -> DataFrame:
    """Strongest peak over the deepest level between its neighbours, or the baseline if higher."""
    best = F.expr(
        "array_max(transform(peaks, (t, i) -> struct(t.psd_db as level, -i as o, i as i)))"
    )
    ranged = df.withColumn("_at", best.i)
    ranged = ranged.withColumns(
        {
            "_from": F.expr("if(_at > 0, peaks[_at - 1].idx, 0)"),
            "_to": F.expr("if(_at < size(peaks) - 1, peaks[_at + 1].idx, size(psd_db))"),
        }
    )
    ground = F.expr(
        "greatest(array_min(slice(psd_db, _from + 1, _to - _from)), psd_baseline_db[peaks[_at].idx])"
    )
    return (
        ranged.withColumn("_ground", ground)
        .withColumn("s2n", F.expr("power(10D, (peaks[_at].psd_db - _ground) / 10)"))
        .withColumn("s2n_freq", F.expr("peaks[_at].freq"))
        .drop("_at", "_from", "_to", "_ground")
    )


# --- finer frequency axis -----------------------------------------------------


def spline_weights(n: int, width: float, at: np.ndarray) -> np.ndarray:
    """Matrix from ``n`` equally spaced values to a not-a-knot cubic spline at ``at``."""
    system, values = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):
        system[i, i - 1 : i + 2] = 1, 4, 1
        values[i, i - 1 : i + 2] = 6, -12, 6
    system[0, :3] = system[-1, -3:] = 1, -2, 1
    bend = np.linalg.solve(system, values)
    x = at / width
    left = np.minimum(x.astype(int), n - 2)
    b = (x - left)[:, None]
    a = 1 - b
    unit = np.eye(n)
    return (
        a * unit[left] + b * unit[left + 1]
        + ((a**3 - a) * bend[left] + (b**3 - b) * bend[left + 1]) / 6
    )


def interpolate_psd(df: DataFrame, p: Params = DEFAULT, step: float = 1.0) -> DataFrame:
    """Spectrum on a 1 Hz axis from 0 to the last bin: ``psd_interp``."""
    at = np.arange(0, 1 + min(p.f_max, int(p.top_frequency)), step)
    weights = spline_weights(p.n_bins, p.df, np.minimum(at, p.top_frequency)).T
    return df.withColumn("psd_interp", row_map(lambda psd: psd @ weights)("psd"))


def peak_spacing(peaks_long: DataFrame) -> DataFrame:
    """Long form ``(rec_id, freq)``: median gap of each recording's peaks, starting from 0."""
    from pyspark.sql import Window

    ascending = Window.partitionBy("rec_id").orderBy("freq")
    gaps = peaks_long.withColumn("gap", F.col("freq") - F.lag("freq", 1, 0.0).over(ascending))
    return gaps.groupBy("rec_id").agg(F.median("gap").alias("spacing"))
