"""Quality filters.  Nothing is deleted: ``removed`` gives the rows a filter leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flighttone.scale import small_side

# Fixed thresholds offered to users.
S2N_CHOICES = (5, 10, 15, 20, 50, 100)
LF_CHOICES = (1, 1.5, 2, 2.5, 3)
HARMONIC_CHOICES = (1, 2, 3, 4, 5)


def good_s2n(t: float) -> Column:
    return F.col("s2n") >= t


def good_power(t: float) -> Column:
    """``t`` is in thousandths."""
    return F.col("fd_power") >= t / 1000


def good_lf(r: float) -> Column:
    return ~(F.col("fd_power_lf") * r > F.col("fd_power"))


def good_harmonics(n: int) -> Column:
    return F.col("ha_count") >= n


def split(df: DataFrame, good: Column) -> tuple[DataFrame, DataFrame]:
    """(kept, removed), together the input.

    The condition stays a plain comparison, so it is pushed into the scan;
    attributes are never null, and a row without the measure is removed.
    """
    return df.filter(good), df.filter(~F.coalesce(good, F.lit(False)))


def drop_low_s2n(df: DataFrame, t: float) -> DataFrame:
    return split(df, good_s2n(t))[0]


def drop_low_power(df: DataFrame, t: float) -> DataFrame:
    return split(df, good_power(t))[0]


def drop_lf(df: DataFrame, r: float) -> DataFrame:
    return split(df, good_lf(r))[0]


def drop_few_harmonics(df: DataFrame, n: int) -> DataFrame:
    return split(df, good_harmonics(n))[0]


def drop_recordings(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Leave out the recordings listed in ``ids(rec_id)``."""
    return df.join(small_side(ids.select("rec_id").distinct()), "rec_id", "left_anti")
