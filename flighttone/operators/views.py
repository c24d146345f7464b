"""The numbers behind the charts and the detail table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.functions.names import time_of_day
from flighttone.operators.joins import with_labels
from flighttone.operators.order import ORDERS, order_position

#: Charts offered to users: name, horizontal axis, vertical axis.
SCATTERS = {
    "power_vs_f1": ("f1", "fd_power_db"),
    "f1_vs_temp": ("temp", "f1"),
    "f1_vs_rh": ("rh", "f1"),
    "f1_vs_time": ("time_s", "f1"),
}


def scatter(df: DataFrame, assignments: DataFrame, view: str) -> DataFrame:
    x, y = SCATTERS[view]
    timed = df.withColumn("time_s", time_of_day("dt")) if x == "time_s" else df
    points = timed.select("rec_id", F.col(x).alias("x"), F.col(y).alias("y"))
    return with_labels(points, assignments.select("rec_id", "label", "is_core"))


def temp_along(df: DataFrame, key: str) -> DataFrame:
    """Temperature along the current order."""
    columns = dict.fromkeys(["rec_id", *ORDERS[key], "load_seq", "temp"])
    return order_position(df.select(*columns), key).select("position", "rec_id", "temp")


def recording_detail(df: DataFrame, rec_id: int | None = None) -> DataFrame:
    """The sixteen numbers shown for a recording; powers and RMS in thousandths."""
    shown = df if rec_id is None else df.filter(F.col("rec_id") == rec_id)
    have = set(df.columns)
    fields = {
        "f1": "f1", "ac_f1": "ac_f1", "ac_coeff": "ac_coeff", "ha_f1": "ha_f1",
        "ha_count": "ha_count", "ha_verbose": "ha_verbose", "first_peak": "peaks[0].freq",
        "psd_delta": "psd_delta", "dur_ms": "dur_ms", "rms_x1000": "1000 * rms",
        "s2n": "s2n", "s2n_freq": "s2n_freq", "power_x1000": "1000 * fd_power",
        "baseline_x1000": "1000 * fd_power_baseline", "lf_x1000": "1000 * fd_power_lf",
        "temp": "temp", "rh": "rh",
    }
    needs = {"first_peak": "peaks", "rms_x1000": "rms", "power_x1000": "fd_power",
             "baseline_x1000": "fd_power_baseline", "lf_x1000": "fd_power_lf"}
    return shown.select(
        "rec_id",
        *[F.expr(e).alias(n) for n, e in fields.items() if needs.get(n, n) in have],
    )


def recording_curves(df: DataFrame, sr: float, bin_width: float, rec_id: int | None = None) -> DataFrame:
    """Waveform, bias, autocorrelation, spectrum, baseline and peaks, long form; of one recording or all."""
    shown = df if rec_id is None else df.filter(F.col("rec_id") == rec_id)
    series = {
        "waveform": (f"i * {1000.0 / sr!r}D", "waveform"),
        "bias": (f"i * {1000.0 / sr!r}D", "bias"),
        "autocorrelation": (f"if(i = 0, 0D, {float(sr)!r}D / greatest(i, 1))", "ac"),
        "spectrum": (f"i * {float(bin_width)!r}D", "psd_db"),
        "baseline": (f"i * {float(bin_width)!r}D", "psd_baseline_db"),
    }
    parts = [
        f"transform({c}, (v, i) -> struct('{n}' as curve, i as i, {x} as x, v as y))"
        for n, (x, c) in series.items()
        if c in df.columns
    ]
    if "peaks" in df.columns:
        parts.append("transform(peaks, (t, i) -> struct('peak' as curve, i as i, t.freq as x, t.psd_db as y))")
    return shown.select("rec_id", F.expr(f"inline(concat({', '.join(parts)}))"))
