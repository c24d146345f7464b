"""Exports: CSV, feature tables, recordings by cluster, wavelet images."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flighttone.functions.wavelets import CONTINUOUS, cwt_power
from flighttone.operators.features import descriptor_of
from flighttone.params import DEFAULT, Params

# Fixed column names of the CSV export, in order; samples follow.
CSV_HEADER = (
    "DateTime", "Elapsed[s]", "Cluster", "Temperature[C]", "RH[%]", "AC Frequency[Hz]",
    "AC Coefficient", "HA Frequency[Hz]", "HA Peaks", "Duration[ms]", "S/N", "@Freq[Hz]",
    "Power", "Fs[Hz]", "Waveform",
)

#: Bytes of a part file, about, and of one value in it.
PART_BYTES, VALUE_BYTES = 128 << 20, 20


def _laid_out(df: DataFrame, key: str, compact: bool) -> DataFrame:
    """Rows as they are, so nothing is shuffled and a task writes a file per value of ``key``.

    ``compact`` brings the rows of a value together first - for many values,
    as of a density clustering - and splits values holding many rows.
    """
    return df.hint("rebalance", key) if compact else df


def csv_time(column: Column | str) -> Column:
    return F.date_format(column, "yyyy-MMM-dd HH:mm:ss")


def export_rows(df: DataFrame) -> DataFrame:
    """The exported values by name; needs ``elapsed_s`` and ``label``."""
    return df.select(
        "rec_id", csv_time("dt").alias("time"), "elapsed_s", F.col("label").alias("cluster"),
        "temp", "rh", "ac_f1", "ac_coeff", "ha_f1", "ha_count", "dur_ms", "s2n", "s2n_freq",
        "fd_power", "fs", "waveform",
    )


def write_results(df: DataFrame, path: str, rows: int | None = None) -> None:
    """CSV in load order, some ``rows`` to a part file; every part has the header.

    Parts are planned from the narrow ``load_seq`` alone, so waveforms are read and moved once,
    each straight to its part, and only the rows of one part are sorted.
    """
    first, last = df.agg(F.min("load_seq"), F.max("load_seq")).first()
    first, last = first or 0, last or 0
    one = df.select(F.size("waveform").alias("n")).first()
    rows = rows or max(1, PART_BYTES // (VALUE_BYTES * (len(CSV_HEADER) + max(one.n if one else 0, 0))))
    parts = -(-(last - first + 1) // rows)
    placed = df.repartitionById(parts, F.floor((F.col("load_seq") - first) / rows).cast("int")).sortWithinPartitions("load_seq")
    found = export_rows(placed).drop("rec_id")
    cells = [F.col(c).cast("string") for c in found.columns if c != "waveform"]
    samples = F.array_join(F.transform("waveform", lambda x: x.cast("string")), ",")
    line = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells], samples)
    head = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    lines = found.select(line.alias("value"), head.alias("first")).select(
        F.explode(
            F.when(F.col("first"), F.array(F.lit(",".join(CSV_HEADER)), F.col("value"))).otherwise(
                F.array("value")
            )
        ).alias("value")
    )
    lines.write.mode("overwrite").text(path)


def write_recordings(df: DataFrame, path: str, compact: bool = False) -> None:
    """Parquet by group, so that later reads of one group skip the others."""
    _laid_out(df, "group_name", compact).write.mode("overwrite").partitionBy("group_name").parquet(path)


def save_features(df: DataFrame, path: str) -> str:
    """``X_`` and, with labels, ``y_`` tables named by the descriptor."""
    name = descriptor_of(df)
    df.select("rec_id", "features").write.mode("overwrite").parquet(f"{path}/X_{name}")
    if "label" in df.columns:
        df.select("rec_id", "label").write.mode("overwrite").parquet(f"{path}/y_{name}")
    return name


def write_by_cluster(df: DataFrame, path: str, compact: bool = False) -> None:
    """One directory per label, replacing what was there; the sources are not touched."""
    labelled = _laid_out(df.withColumn("cluster", F.col("label")), "cluster", compact)
    labelled.write.mode("overwrite").partitionBy("cluster").parquet(path)


def scalogram_levels(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Wavelet power between its limits as whole numbers 0..255: ``image``."""
    low, high = math.log10(p.cwt_power_low), math.log10(p.cwt_power_high)
    slope = 255 / (high - low)

    def level(x: Column) -> Column:
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x - low) * slope)) + 0.5).cast("int")

    return df.withColumn("image", F.transform("cwt", lambda row: F.transform(row, level)))


def write_scalograms(df: DataFrame, path: str, wavelet: str = CONTINUOUS[0], p: Params = DEFAULT,
                     compact: bool = False) -> None:
    """One image row per recording in a directory per label."""
    # waveforms are far smaller than their images, so they move before the transform
    waves = _laid_out(df.select("rec_id", "label", "waveform"), "label", compact)
    images = scalogram_levels(cwt_power(waves, wavelet, p), p)
    images.select("rec_id", "image", F.col("label").alias("cluster")).write.mode(
        "overwrite"
    ).partitionBy("cluster").parquet(path)
