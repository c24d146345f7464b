"""File names: path parts and the facts encoded in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values for names that do not decode.
DEFAULT_TIME = "2019-01-01 00:00:00"
DEFAULT_TEMP = 25.0
DEFAULT_RH = 0.0

TITLE_CHARACTERS = 50

_FRACTION = "[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]"


def split_path(df: DataFrame, path: str = "path") -> DataFrame:
    """File name, name without extension, and the title shown on charts."""
    named = df.withColumn("filename", F.regexp_extract(path, r"([^/]*)$", 1))
    named = named.withColumn("display_name", F.regexp_replace("filename", r"(?<=.)\.[^.]*$", ""))
    return named.withColumn("title", F.right("display_name", F.lit(TITLE_CHARACTERS)))


def _time(text: Column) -> Column:
    numeric = F.try_to_timestamp(text, F.lit("yyyy-M-d H.m.s" + _FRACTION))
    named = F.try_to_timestamp(text, F.lit("yyyy-MMM-d H.m.s" + _FRACTION))
    return F.coalesce(numeric, named).cast("timestamp_ntz")


def decode_filename(df: DataFrame, filename: str = "filename") -> DataFrame:
    """Add ``dt``, ``temp``, ``rh`` and ``name_decoded`` from ``date_time_temp_rh_rest``.

    Exactly five parts are needed; one failing part sets all three defaults.
    """
    parts = F.split(F.regexp_replace(filename, r"(?<=.)\.[^.]*$", ""), "_")
    has_five = F.size(parts) == 5

    def part(i: int) -> Column:
        return F.when(has_five, parts[i])

    stamp = F.concat_ws(" ", part(0), part(1))
    stamp = F.when(part(1).rlike(r"^\d{1,2}\.\d{1,2}\.\d{1,2}\.\d{1,6}$"), stamp)
    read = df.withColumns(
        {
            "_dt": _time(stamp),
            "_temp": F.substring(part(2), 2, 4).try_cast("double"),
            "_rh": F.substring(part(3), 2, 4).try_cast("double"),
        }
    ).withColumn("name_decoded", F.expr("_dt is not null and _temp is not null and _rh is not null"))
    return read.withColumns(
        {
            "dt": F.when(F.col("name_decoded"), F.col("_dt")).otherwise(
                F.lit(DEFAULT_TIME).cast("timestamp_ntz")
            ),
            "temp": F.when(F.col("name_decoded"), F.col("_temp")).otherwise(F.lit(DEFAULT_TEMP)),
            "rh": F.when(F.col("name_decoded"), F.col("_rh")).otherwise(F.lit(DEFAULT_RH)),
        }
    ).drop("_dt", "_temp", "_rh")


def time_of_day(column: Column | str) -> Column:
    """Whole seconds since midnight."""
    c = F.col(column) if isinstance(column, str) else column
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def normalise_temp(column: Column | str, low: float = 5.0, high: float = 55.0) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return (c - low) / (high - low)
