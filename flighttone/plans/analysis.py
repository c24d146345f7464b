"""Complete analyses: a tree of files to a table, a table to clusters, a model to labels."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flighttone.operators import classify, cluster, features, joins, order, stats, views
from flighttone.operators.features import FeatureSpec
from flighttone.params import DEFAULT, Params
from flighttone.plans.pipeline import attributes
from flighttone.sources import sinks, wav


def build_table(spark: SparkSession, root: str, out: str, p: Params = DEFAULT) -> DataFrame:
    """Read ``root`` once and write three tables below ``out``; returns the recordings.

    ``recordings`` holds every attribute by group, ``order`` the load order with
    gaps and elapsed time, ``quarantine`` the files that could not be read.  The
    order table is narrow, so ordering never moves a waveform.
    """
    read = wav.read_recordings(spark, root, p)
    sinks.write_recordings(attributes(read, p), f"{out}/all")
    table = spark.read.parquet(f"{out}/all")
    wav.bad_records(table).write.mode("overwrite").parquet(f"{out}/quarantine")
    wav.check_ids(table.select("rec_id"))
    recordings = wav.good_records(table)
    placed = order.with_load_seq(recordings.select("rec_id", "dt", "path", "group_name"))
    gaps = order.flag_close(order.interarrival(placed), p)
    order.elapsed(gaps).select("rec_id", "load_seq", "td", "close_to_prev", "elapsed_s").write.mode(
        "overwrite"
    ).parquet(f"{out}/order")
    return recordings


def report(recordings: DataFrame, assignments: DataFrame, p: Params = DEFAULT) -> dict[str, DataFrame]:
    """Every group statistic of a labelling."""
    facts = recordings.select(
        "rec_id", "f1", "temp", "rh", "dt", "dur_ms", "psd_min", "s2n", "fd_power_db"
    )
    rows = joins.with_labels(facts, assignments.select("rec_id", "label", "is_core"))
    return {
        "collection": stats.summary(facts, p),
        "temperature": stats.temp_coefficient(facts),
        "groups": stats.group_summary(rows),
        "balance": stats.balance_report(rows),
        "s2n": stats.s2n_distribution(rows),
        "power": stats.power_distribution(rows),
        "histogram": stats.freq_histogram(rows, p=p),
        "density": stats.freq_kde(rows, p=p),
        "activity": stats.activity_by_hour(rows),
        **{name: views.scatter(facts, assignments, name) for name in views.SCATTERS},
    }


def cluster_table(recordings: DataFrame, spec: FeatureSpec, method: Callable[..., DataFrame], setting: float,
                  p: Params = DEFAULT, score: str = "euclidean") -> tuple[DataFrame, DataFrame]:
    """Assignments of a clustering of the recordings, and its one-row summary."""
    x, _ = features.build_features(recordings, spec, p)
    found = method(x, setting)
    return found, cluster.clustering_summary(x, found, method.__name__, setting, score=score)


def train_table(recordings: DataFrame, assignments: DataFrame, spec: FeatureSpec, kind: str = "boosted",
                p: Params = DEFAULT, **options) -> tuple[classify.Model, dict[str, DataFrame]]:
    """A classifier of the given labels with its hold-out evaluation."""
    x, fitted = features.build_features(recordings, spec, p)
    labels = assignments.select("rec_id", "label")
    rows = x.select("rec_id", "features").join(labels, "rec_id")
    rows = rows.withMetadata("features", {"descriptor": spec.descriptor})
    model, scored = classify.train(rows, kind, features=fitted, **options)
    return model, classify.evaluate(scored)
