"""Discrete wavelet bands with their statistics, and continuous wavelet power."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from flighttone.functions.batches import matrices, row_map
from flighttone.params import DEFAULT, Params

# Fixed order of the numbers kept for each band.
BAND_FEATURES = (
    "entropy", "zero_crossings", "mean_crossings",
    "p5", "p25", "p75", "p95", "median", "mean", "std", "var", "mean_abs",
)

# Fixed names of the continuous wavelets offered, the first is the default.
CONTINUOUS = (
    "fbsp10-0.5-1", "shan0.5-1", "morl", "mexh",
    "gaus1", "gaus2", "gaus3", "gaus4", "gaus5", "gaus6", "gaus7", "gaus8",
)

MAX_ORDER = 20
# Fixed orders (reconstruction, decomposition) of the biorthogonal pairs with a rule.
SPLINE_PAIRS = (
    (1, 1), (1, 3), (1, 5), (2, 2), (2, 4), (2, 6), (2, 8),
    (3, 1), (3, 3), (3, 5), (3, 7), (3, 9), (4, 4),
)
#: Recordings whose images a task holds at once.
CWT_ROWS = 8


# --- filters -----------------------------------------------------------------


def _half_band_roots(order: int) -> np.ndarray:
    """Roots inside the unit circle of the factor Daubechies filters are built from."""
    y = np.roots([math.comb(order - 1 + k, k) for k in range(order - 1, -1, -1)])
    half = 1 - 2 * y
    turn = np.sqrt(half * half - 1 + 0j)
    return np.where(np.abs(half + turn) < 1, half + turn, half - turn)


def _from_roots(roots: np.ndarray, order: int) -> np.ndarray:
    taps = np.real(np.poly(np.concatenate([roots, -np.ones(order)])))
    return taps / taps.sum() * np.sqrt(2)


def _bend(taps: np.ndarray) -> float:
    """How far the phase of a filter is from a straight line."""
    f = np.linspace(0.02, 0.9 * np.pi, 200)
    phase = np.unwrap(np.angle(np.exp(-1j * np.outer(f, np.arange(len(taps)))) @ taps))
    line = np.polynomial.polynomial.polyfit(f, phase, 1)
    return float(np.abs(phase - np.polynomial.polynomial.polyval(f, line)).max())


def scaling_filter(name: str) -> np.ndarray:
    """Low-pass reconstruction taps of ``haar``, ``db1``..``db20`` or ``sym2``..``sym20``."""
    family, order = ("db", 1) if name == "haar" else (name.rstrip("0123456789"), int("0" + name.lstrip("abcdefghijklmnopqrstuvwxyz")))
    if family not in ("db", "sym") or not 1 <= order <= MAX_ORDER:
        raise ValueError(f"no rule for wavelet {name!r}: pass its taps in `filters`")
    roots = _half_band_roots(order) if order > 1 else np.array([])
    if family == "db" or order < 2:
        return _from_roots(roots, order)
    upper = [r for r in roots if r.imag > 1e-9]
    lone = [r for r in roots if abs(r.imag) <= 1e-9]
    groups = [np.array([r, np.conj(r)]) for r in upper] + [np.array([r]) for r in lone]
    choices = []
    for mask in range(1 << max(len(groups) - 1, 0)):
        picked = [1 / g if mask >> i & 1 else g for i, g in enumerate(groups)]
        taps = _from_roots(np.concatenate(picked), order)
        choices.append((round(_bend(taps), 9), mask, taps))
    return min(choices, key=lambda c: c[:2])[2]


def _spline(order: int) -> np.ndarray:
    """Taps of ((1 + z) / 2) ** order."""
    return np.array([math.comb(order, k) for k in range(order + 1)]) / 2.0**order


def _in_y(coefficients: np.ndarray) -> np.ndarray:
    """Taps of a polynomial in y = (2 - z - 1/z) / 4, lowest power first."""
    y, power, size = np.array([-0.25, 0.5, -0.25]), np.array([1.0]), 2 * len(coefficients) - 1
    out = np.zeros(size)
    for c in coefficients:
        side = (size - len(power)) // 2
        out[side : size - side] += c * power
        power = np.convolve(power, y)
    return out


def _biorthogonal(rec: int, dec: int) -> tuple[np.ndarray, np.ndarray]:
    """Low-pass taps (decomposition, reconstruction) of a spline pair, of equal length."""
    if (rec, dec) not in SPLINE_PAIRS:
        raise ValueError(f"no rule for a pair of orders {rec}.{dec}: pass its taps in `filters`")
    half = (rec + dec) // 2
    whole = np.array([math.comb(half - 1 + k, k) for k in range(half)], float)
    mine, other = whole, np.array([1.0])
    if rec == dec == 4:
        # the real root goes to the reconstruction filter
        roots = np.roots(whole[::-1])
        real = roots[np.abs(roots.imag) < 1e-9].real
        mine = np.real(np.poly(roots[np.abs(roots.imag) >= 1e-9]))[::-1]
        mine, other = mine / mine[0], np.array([1.0, -1 / real[0]])
    low = np.convolve(_spline(dec), _in_y(mine)) * np.sqrt(2)
    back = np.convolve(_spline(rec), _in_y(other)) * np.sqrt(2)
    size = len(low) + len(low) % 2
    low = np.pad(low, (size - len(low), 0))
    left = (size - len(back)) // 2
    return low, np.pad(back, (left, size - len(back) - left))


def filter_pair(name: str, filters: Mapping[str, tuple] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Low- and high-pass decomposition taps; ``filters`` adds wavelets by name."""
    if filters and name in filters:
        low, high = filters[name]
        return np.asarray(low, float), np.asarray(high, float)
    if name[:4] in ("bior", "rbio"):
        low, taps = _biorthogonal(*(int(v) for v in name[4:].split(".")))
        if name.startswith("rbio"):
            low, taps = taps[::-1], low[::-1]
    else:
        taps = scaling_filter(name)
        low = taps[::-1]
    return low, taps * np.where(np.arange(len(taps)) % 2 == 0, -1.0, 1.0)


def level_count(length: float, taps: int) -> int:
    return max(int(math.floor(math.log2(length / (taps - 1)))), 0) if length >= taps - 1 else 0


def _split(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = len(low)
    around = np.pad(x, ((0, 0), (width - 1, width - 1)), mode="symmetric")
    views = np.lib.stride_tricks.sliding_window_view(around, width, axis=1)[:, 1::2]
    return views @ low[::-1], views @ high[::-1]


# --- discrete transform ---------------------------------------------------------


def dwt(df: DataFrame, wavelet: str = "sym9", p: Params = DEFAULT, level: int | None = None,
        filters: Mapping[str, tuple] | None = None, column: str = "waveform") -> DataFrame:
    """Bands ``bands array<array<double>>``: the smooth one first, then details from coarse to fine.

    The depth follows from the segment length in ``p`` unless ``level`` is given.
    """
    low, high = filter_pair(wavelet, filters)
    depth = level_count(p.sr * p.segment_ms / 1000, len(low)) if level is None else level

    @F.arrow_udf("array<array<double>>")
    def decompose(samples: pa.Array) -> pa.Array:
        out: list = [None] * len(samples)
        for rows, smooth in matrices(samples):
            details = []
            for _ in range(depth):
                smooth, fine = _split(smooth, low, high)
                details.append(fine)
            bands = [smooth, *reversed(details)]
            for at, row in enumerate(rows):
                out[row] = [band[at] for band in bands]
        return pa.array(out, pa.list_(pa.list_(pa.float64())))

    return df.withColumn("bands", decompose(column))


def bands_long(df: DataFrame) -> DataFrame:
    """One row per coefficient: ``rec_id, band, n, x``."""
    banded = df.select("rec_id", F.posexplode("bands").alias("band", "_values"))
    return banded.select("rec_id", "band", F.posexplode("_values").alias("n", "x"))


def band_entropy(bands: DataFrame) -> DataFrame:
    """Natural-log entropy of how often each exact value occurs (long form)."""
    counted = bands.groupBy("rec_id", "band", "x").agg(F.count(F.lit(1)).alias("c"))
    # -sum(c/n ln(c/n)) = ln n - sum(c ln c)/n needs one pass
    n = F.sum("c")
    return counted.groupBy("rec_id", "band").agg(
        (F.ln(n) - F.sum(F.col("c") * F.ln("c")) / n).alias("entropy")
    )


def band_stats(bands: DataFrame) -> DataFrame:
    """Percentiles, moments and mean absolute value of each band (long form)."""
    shares = {"p5": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95, "median": 0.5}
    return bands.groupBy("rec_id", "band").agg(
        *[F.percentile("x", F.lit(q)).alias(n) for n, q in shares.items()],
        F.avg("x").alias("mean"),
        F.stddev_pop("x").alias("std"),
        F.var_pop("x").alias("var"),
        F.avg(F.abs("x")).alias("mean_abs"),
    )


def crossings(samples: DataFrame, by: tuple[str, ...] = ("rec_id",)) -> DataFrame:
    """Sign changes around zero and around the mean (long form ``by.., n, x``)."""
    whole = Window.partitionBy(*by)
    ordered = whole.orderBy("n")
    above = samples.withColumn("_mean", F.avg("x").over(whole)).withColumns(
        {"_zero": F.col("x") > 0, "_over": F.col("x") > F.col("_mean")}
    )
    changed = above.withColumns(
        {
            "_z": (F.lag("_zero").over(ordered) != F.col("_zero")).cast("int"),
            "_m": (F.lag("_over").over(ordered) != F.col("_over")).cast("int"),
        }
    )
    return changed.groupBy(*by).agg(
        F.coalesce(F.sum("_z"), F.lit(0)).alias("zero_crossings"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("mean_crossings"),
    )


def _describe(x: np.ndarray) -> np.ndarray:
    """The numbers of ``BAND_FEATURES`` for rows of equal length."""
    n = x.shape[1]
    ordered = np.sort(x, axis=1)
    new = np.concatenate([np.ones((len(x), 1), bool), ordered[:, 1:] != ordered[:, :-1]], axis=1)
    at = np.arange(n)
    begins = np.maximum.accumulate(np.where(new, at, 0), axis=1)
    ends = np.concatenate([new[:, 1:], np.ones((len(x), 1), bool)], axis=1)
    run = np.where(ends, at - begins + 1, 1)
    mean = x.mean(axis=1)
    return np.column_stack(
        [
            np.log(n) - np.where(ends, run * np.log(run), 0).sum(axis=1) / n,
            (np.diff(x > 0, axis=1)).sum(axis=1),
            (np.diff(x > mean[:, None], axis=1)).sum(axis=1),
            *np.percentile(ordered, [5, 25, 75, 95, 50], axis=1),
            mean,
            x.std(axis=1),
            x.var(axis=1),
            np.abs(x).mean(axis=1),
        ]
    )


def dwt_features(df: DataFrame, wavelet: str = "sym9", p: Params = DEFAULT,
                 level: int | None = None, filters: Mapping[str, tuple] | None = None,
                 column: str = "waveform") -> DataFrame:
    """All band numbers of a recording in one array, without leaving its row."""
    low, high = filter_pair(wavelet, filters)
    depth = level_count(p.sr * p.segment_ms / 1000, len(low)) if level is None else level

    def numbers(x: np.ndarray) -> np.ndarray:
        blocks = []
        for _ in range(depth):
            x, fine = _split(x, low, high)
            blocks.insert(0, _describe(fine))
        return np.hstack([_describe(x), *blocks])

    return df.withColumn("dwt_features", row_map(numbers)(column))


# --- continuous transform ----------------------------------------------------------


def mother(name: str, t: np.ndarray) -> np.ndarray:
    """Closed form of a continuous wavelet at ``t``."""
    if name == "morl":
        return np.exp(-t * t / 2) * np.cos(5 * t)
    if name == "mexh":
        return 2 / (np.sqrt(3) * np.pi**0.25) * (1 - t * t) * np.exp(-t * t / 2)
    if name.startswith("gaus"):
        order = int(name[4:])
        hermite = np.polynomial.hermite.hermval(t, [0] * order + [1])
        odd = math.prod(range(1, 2 * order, 2))
        return hermite * np.exp(-t * t) / np.sqrt(odd * np.sqrt(np.pi / 2))
    if name.startswith("shan"):
        band, centre = (float(v) for v in name[4:].split("-"))
        return np.sqrt(band) * np.sinc(band * t) * np.exp(2j * np.pi * centre * t)
    if name.startswith("fbsp"):
        order, band, centre = (float(v) for v in name[4:].split("-"))
        return np.sqrt(band) * np.sinc(band * t / order) ** int(order) * np.exp(2j * np.pi * centre * t)
    raise ValueError(f"unknown continuous wavelet {name!r}")


def support(name: str) -> float:
    """Half width on which the wavelet is sampled."""
    return 5.0 if name.startswith("gaus") else 8.0 if name in ("morl", "mexh") else 20.0


def central_frequency(name: str) -> float:
    """Named centre, else the frequency of the largest Fourier coefficient over the support."""
    half = support(name)
    if name[:4] in ("shan", "fbsp"):
        return float(name.split("-")[-1])
    strength = np.abs(np.fft.fft(mother(name, np.linspace(-half, half, 1024))))
    k = int(np.argmax(strength[1:512])) + 1
    return k / (2 * half)


def cwt_frequencies(p: Params = DEFAULT) -> np.ndarray:
    n = int((p.f_max - p.f_min) / p.cwt_step + 1.5)
    return np.linspace(p.f_min, p.f_max, n)


def _log_power(x: np.ndarray, wavelet: str, scales: np.ndarray, half: float) -> np.ndarray:
    """log10 of the squared correlation with the wavelet, rows by scales by samples."""
    n = x.shape[1]
    out = np.empty((len(x), len(scales), n))
    for i, scale in enumerate(scales):
        reach = int(math.ceil(half * scale))
        t = np.arange(-reach, reach + 1) / scale
        psi = np.where(np.abs(t) <= half, mother(wavelet, t), 0)
        size = 1 << (n + 2 * reach).bit_length()
        full = np.fft.ifft(np.fft.fft(x, size) * np.fft.fft(np.conj(psi[::-1]), size))
        level = np.abs(full[:, reach : reach + n]) ** 2 / scale
        out[:, i] = np.log10(np.maximum(level, 1e-300))
    return out


def cwt_power(df: DataFrame, wavelet: str = CONTINUOUS[0], p: Params = DEFAULT,
              freqs: np.ndarray | None = None, column: str = "waveform") -> DataFrame:
    """log10 power ``cwt array<array<double>>``, one row per frequency, one value per sample."""
    wanted = cwt_frequencies(p) if freqs is None else np.asarray(freqs, float)
    scales = central_frequency(wavelet) * p.sr / wanted
    half = support(wavelet)

    # the image of one recording is large, so only a few leave a task at a time
    def images(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CWT_ROWS):
                part = batch.slice(start, CWT_ROWS)
                samples = part.column(part.schema.get_field_index(column))
                image: list = [None] * part.num_rows
                for rows, x in matrices(samples):
                    for row, cells in zip(rows, _log_power(x, wavelet, scales, half)):
                        image[row] = list(cells)
                made = pa.array(image, pa.list_(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, made], names=[*part.schema.names, "cwt"]
                )

    schema = StructType([*df.schema.fields, StructField("cwt", ArrayType(ArrayType(DoubleType())))])
    return df.mapInArrow(images, schema)


def cwt_long(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Cells as rows: ``rec_id, fi, freq, n, log_power``."""
    rows = df.select("rec_id", F.posexplode("cwt").alias("fi", "_row"))
    return rows.select(
        "rec_id", "fi", (F.lit(p.f_min) + F.col("fi") * p.cwt_step).alias("freq"),
        F.posexplode("_row").alias("n", "log_power"),
    )
