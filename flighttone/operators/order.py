"""Load order, current order, and what depends on neighbours in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flighttone.params import DEFAULT, Params
from flighttone.scale import (
    is_small,
    materialize,
    small_side,
    with_position,
    with_previous,
    with_running_totals,
)

#: Orders offered to users; ties keep load order.
ORDERS: dict[str, tuple[str, ...]] = {
    "original": (),
    "s2n": ("s2n", "s2n_freq"),
    "f1": ("f1",),
    "cluster": ("label",),
}

#: The last character there is.
END = "\U0010ffff"


def group_dim(df: DataFrame) -> DataFrame:
    """Group names with their index in sorted order: one row per group."""
    names = materialize(df.select("group_name").distinct())
    if is_small(names):
        numbered = names.withColumn("group_id", F.row_number().over(Window.orderBy("group_name")) - 1)
    else:
        numbered = with_position(names, ["group_name"], "group_id")
    return numbered.select(F.col("group_id").cast("int").alias("group_id"), "group_name")


def root_path(spark: SparkSession, root: str) -> str:
    """Absolute path of a folder in its file system, without scheme and authority."""
    found = spark._jvm.org.apache.hadoop.fs.Path(root)
    system = found.getFileSystem(spark._jsc.hadoopConfiguration())
    return system.makeQualified(found).toUri().getPath().rstrip("/")


def below(path: Column, plain: str) -> Column:
    """What follows the folder ``plain`` in a path or URI; empty where the path does not begin with it."""
    local = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.when(local.startswith(plain + "/"), F.substr(local, F.lit(len(plain) + 2))).otherwise("")


def with_group(df: DataFrame, root: str, path: str = "path") -> DataFrame:
    """Group = first directory below ``root``; loose files only count when there is no directory.

    Without any directory the group is the name of ``root`` itself.
    """
    plain = root_path(df.sparkSession, root)
    placed = df.withColumn("_inside", below(F.col(path), plain)).withColumn(
        "_group", F.regexp_extract("_inside", r"^([^/]+)/", 1)
    )
    has_groups = placed.filter("_group <> ''").select("_group").limit(1).count() > 0
    if has_groups:
        named = placed.filter("_group <> ''").withColumn("group_name", F.col("_group"))
    else:
        named = placed.withColumn("group_name", F.lit(plain.rsplit("/", 1)[-1]))
    ids = small_side(group_dim(named))
    return named.join(ids, "group_name").drop("_group", "_inside")


def with_load_seq(df: DataFrame, path: str = "path") -> DataFrame:
    """Position in load order: groups sorted, and in each a directory after all that is below it.

    Directories side by side and files go in name order.  Call it on the narrow file
    list, before samples are decoded.
    """
    parts = F.split(path, "/")
    # The end mark sorts after any name, so what lies deeper comes first.
    folders = F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.lit(END)))
    listed = df.withColumns({"_dir": folders, "_name": F.element_at(parts, -1)})
    return with_position(listed, ["group_name", "_dir", "_name"], "load_seq").drop("_dir", "_name")


def _seconds(gap: Column) -> Column:
    """Length of a day-time interval; zoneless times subtract without a session time zone."""
    parts = {"DAY": 86400, "HOUR": 3600, "MINUTE": 60, "SECOND": 1}
    terms = [F.extract(F.lit(unit), gap).cast("double") * size for unit, size in parts.items()]
    return terms[0] + terms[1] + terms[2] + terms[3]


def interarrival(df: DataFrame, by: Sequence[str] = (), block: int = 100_000) -> DataFrame:
    """Seconds since the previous recording in load order; the first has none (null).

    Columns in ``by`` restart the count where their value changes.
    """
    columns = {"_before": "dt", **{f"_before_{c}": c for c in by}}
    seen = with_previous(df, "load_seq", columns, block)
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_before_{c}"))
    return seen.withColumn("td", F.when(same, _seconds(F.col("dt") - F.col("_before")))).drop(*columns)


def flag_close(df: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Too close to the previous recording; a negative difference counts as close."""
    return df.withColumn("close_to_prev", F.coalesce(F.col("td") < p.close_s, F.lit(False)))


def elapsed(df: DataFrame) -> DataFrame:
    """Whole seconds since the first recording in load order."""
    first = df.agg(F.min_by("dt", "load_seq")).scalar()
    return df.withColumn("elapsed_s", F.floor(_seconds(F.col("dt") - first)))


def order_keys(key: str) -> list[Column | str]:
    return [*ORDERS[key], "load_seq"]


def order_by(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(*order_keys(key))


def order_position(df: DataFrame, key: str) -> DataFrame:
    """Position 1..n under the order ``key``."""
    return with_position(df, order_keys(key), "position", start=1)


def neighbour(ordered: DataFrame, rec_id: int, step: int) -> DataFrame:
    """Row ``step`` places from ``rec_id`` in an ordered frame, held at both ends."""
    here = ordered.filter(F.col("rec_id") == rec_id).agg(F.max("position")).scalar()
    last = ordered.agg(F.max("position")).scalar()
    return ordered.filter(
        F.col("position") == F.greatest(F.lit(1), F.least(here + F.lit(step), last))
    )


def cluster_bounds(df: DataFrame, label: str = "label") -> DataFrame:
    """Where each label ends on the ordered axis."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return with_running_totals(counts, [label], {"upto": F.col("n")})


def psd_map(df: DataFrame, key: str) -> DataFrame:
    """Spectrum above its baseline for each recording, with its place in the order."""
    lifted = df.withColumn(
        "psd_above_db", F.zip_with("psd_db", "psd_baseline_db", lambda level, base: level - base)
    )
    columns = dict.fromkeys(["rec_id", *ORDERS[key], "load_seq", "psd_above_db"])
    return order_position(lifted.select(*columns), key).select("position", "rec_id", "psd_above_db")
