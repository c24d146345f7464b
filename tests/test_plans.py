"""Plans: no row-wise Python, no products, nothing wide shuffled, filters pushed down."""

import re

import pytest
from pyspark.sql import functions as F

from checks import fixtures, signals, tables
from flighttone.operators import clean, joins, stats
from flighttone.plans.pipeline import attributes
from tests.conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


MAPS = ("psd", "mel", "mfcc", "harmonics", "s2n", "rms", "duration", "attributes", "dwt_features", "als_baseline")


@pytest.mark.parametrize("name", MAPS)
def test_attributes_do_not_shuffle(spark, name):
    text = plan(signals.QUERIES[name](spark, SMALL))
    assert "Exchange" not in text and "BatchEvalPython" not in text


AGGREGATES = ("group_summary", "group_counts", "s2n_dist", "freq_hist", "activity_by_hour", "confusion", "temp_regression")


@pytest.mark.parametrize("name", AGGREGATES)
def test_aggregates_combine_before_the_shuffle(spark, name):
    text = plan(tables.QUERIES[name](spark, SMALL))
    assert "partial_" in text
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", text)


def test_unused_kernels_are_pruned(spark):
    full = attributes(fixtures.sig(spark, SMALL), fixtures.SIG)
    assert plan(full.select("rec_id", "rms")).count("ArrowEvalPython") == 0
    one = plan(full.select("rec_id", "dur_ms"))
    assert one.count("ArrowEvalPython") == 1
    assert plan(full.select("rec_id", "mfcc")).count("label") == 0


def test_filters_and_columns_reach_the_scan(spark):
    rows = fixtures.table(spark, SMALL, "events").withColumnRenamed("value", "s2n")
    text = plan(clean.drop_low_s2n(rows, 20).select("event_id"))
    assert "GreaterThanOrEqual(value,20.0)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert schema == "event_id:bigint,value:double"


def test_large_side_is_not_broadcast_by_hand(spark):
    big = spark.range(200_001).withColumnRenamed("id", "rec_id")
    text = joins.small_side(big)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in text
    assert "broadcast" in joins.small_side(spark.range(5))._jdf.queryExecution().analyzed().toString()


def test_plan_stays_small(spark):
    """Column expressions are not copied into each other."""
    full = attributes(fixtures.sig(spark, SMALL), fixtures.SIG)
    assert len(full._jdf.queryExecution().optimizedPlan().toString()) < 60_000


def test_curves_are_all_a_density_shuffles(spark):
    rows = fixtures.ev(spark, SMALL)
    found = stats.freq_kde(rows, "group_name").agg(F.count(F.lit(1))).first()[0]
    assert found == 5 * 450
