"""Recordings joined with labels, names and corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.scale import small_side

POOR_MATCH = "Poor Match"


def with_labels(df: DataFrame, assignments: DataFrame) -> DataFrame:
    """Both sides have one row per recording, so the key cannot be skewed."""
    return df.join(assignments, "rec_id")


def with_label_names(assignments: DataFrame, group_dim: DataFrame) -> DataFrame:
    """Group name of each label; labels without a group are a poor match."""
    names = group_dim.select(F.col("group_id").alias("label"), F.col("group_name").alias("label_name"))
    joined = assignments.join(small_side(names), "label", "left")
    return joined.withColumn("label_name", F.coalesce("label_name", F.lit(POOR_MATCH)))


def relabel(assignments: DataFrame, overrides: DataFrame) -> DataFrame:
    """Labels with manual corrections ``overrides(rec_id, label)`` applied."""
    new = small_side(overrides.select("rec_id", F.col("label").alias("_new")))
    joined = assignments.join(new, "rec_id", "left")
    return joined.withColumn("label", F.coalesce("_new", "label")).drop("_new")


def cycle_label(assignments: DataFrame, rec_id: int, n_labels: int) -> DataFrame:
    """Move one recording to the next label, wrapping round."""
    turned = (F.col("label") + 1) % n_labels
    return assignments.withColumn(
        "label", F.when(F.col("rec_id") == rec_id, turned).otherwise(F.col("label"))
    )
