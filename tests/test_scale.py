"""Distributed order, running totals and percentiles against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flighttone import scale
from flighttone.operators import order, stats


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(9)
    key = np.where(rng.random(5000) < 0.4, 0, rng.integers(1, 50, 5000))
    value = np.where(rng.random(5000) < 0.3, 1.5, np.round(rng.normal(0, 3, 5000), 2))
    rows = [(i, int(k), float(v)) for i, (k, v) in enumerate(zip(key, value))]
    return spark.createDataFrame(rows, "rec_id long, k int, v double").cache()


def test_position(skewed):
    found = scale.with_position(skewed, ["v", "rec_id"], "at", partitions=7).collect()
    want = {r["rec_id"]: i for i, r in enumerate(sorted(skewed.collect(), key=lambda r: (r["v"], r["rec_id"])))}
    assert {r["rec_id"]: r["at"] for r in found} == want


def test_running_totals(skewed):
    found = scale.with_running_totals(skewed, ["rec_id"], {"s": F.col("v"), "n": F.lit(1)}, partitions=5)
    rows = found.orderBy("rec_id").collect()
    np.testing.assert_allclose([r["s"] for r in rows], np.cumsum([r["v"] for r in rows]), atol=1e-8)
    assert [r["n"] for r in rows] == list(range(1, 5001))


@pytest.mark.parametrize("block", [1, 7, 100, 10_000])
def test_previous(skewed, block):
    rows = scale.with_previous(skewed, "rec_id", {"p": "v"}, block).orderBy("rec_id").collect()
    assert len(rows) == 5000 and rows[0]["p"] is None
    assert [r["p"] for r in rows[1:]] == [r["v"] for r in rows[:-1]]


def test_percentiles_by_rank_are_those_of_the_aggregate(skewed):
    shares = {"lo": 0.25, "mid": 0.5, "hi": 0.987}
    whole = skewed.groupBy("k").agg(*[F.percentile("v", F.lit(q)).alias(n) for n, q in shares.items()])
    held = {r["k"]: r for r in whole.collect()}
    ranked = scale.percentiles(skewed, ["k"], "v", shares).collect()
    assert len(ranked) == len(held)
    for r in ranked:
        for n in shares:
            assert r[n] == pytest.approx(held[r["k"]][n], abs=1e-12)
    whole = scale.percentiles(skewed, [], "v", {"mid": 0.5}).first()
    assert whole["mid"] == np.median([r["v"] for r in skewed.collect()])


@pytest.mark.parametrize("rows", [scale.BROADCAST_ROWS, 3])
def test_percentiles_of_awkward_values(spark, monkeypatch, rows):
    """All scales, signs, neighbours a bit apart, ties, infinities, NaN, null; also where the ranks are too many to hold."""
    monkeypatch.setattr(scale, "BROADCAST_ROWS", rows)
    rng = np.random.default_rng(4)
    inf, one = float("inf"), 1.0
    groups = {
        "scales": [float(s * 10.0**e) for s, e in zip(rng.choice([-1, 1], 301), rng.uniform(-320, 308, 301))],
        "near": [float(x) for x in np.nextafter(one, 2) * np.ones(5)] + [one] * 4 + [float(np.nextafter(one, 0))] * 4,
        "zero": [0.0, -0.0, 5e-324, -5e-324, 0.0], "ends": [inf, -inf, 1.0], "nan": [float("nan"), 1.0, 2.0, float("nan")],
        "ties": [7.25] * 50 + [8.0] * 50, "one": [3.5], "powers": [2.0**k for k in range(-20, 20)], None: [1e300, -1e300, 1.7e308], "none": [None],
    }
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    shares = {"lo": 0.0, "a": 0.3, "mid": 0.5, "b": 0.77, "hi": 1.0}
    found = {r["k"]: r for r in scale.percentiles(df, ["k"], "v", shares).collect()}
    assert set(found) == set(groups) - {"none"}
    for k, vs in groups.items():
        for name, q in shares.items() if k in found else ():
            ordered = sorted(vs, key=lambda v: (np.isnan(v), v))
            rank = q * (len(vs) - 1)
            lo, hi = ordered[int(np.floor(rank))], ordered[int(np.ceil(rank))]
            share = rank - np.floor(rank)
            want = lo if lo == hi or np.isnan(lo) else lo * (1 - share) + hi * share
            assert found[k][name] == want or np.isnan(found[k][name]) and np.isnan(want)


def test_hot_keys_join_on_their_own(skewed):
    sizes = skewed.groupBy("k").agg(F.count(F.lit(1)).alias("w"))
    plain = skewed.join(sizes, "k").orderBy("rec_id").select("rec_id", "k", "w").collect()
    split = scale.join_unique(skewed, sizes, ["k"], "w", hot_rows=500)
    assert split.orderBy("rec_id").select("rec_id", "k", "w").collect() == plain


def test_checkpoint_folder_comes_from_the_session(spark):
    scale.ensure_checkpoint_dir(spark)
    assert spark.sparkContext.getCheckpointDir()


def test_group_summary_of_a_hot_group(skewed):
    rows = skewed.select("rec_id", F.col("k").alias("label"), F.col("v").alias("f1"), (F.col("rec_id") % 7).cast("double").alias("temp"))
    plain = {r["label"]: r["m"] for r in rows.groupBy("label").agg(F.median("f1").alias("m")).collect()}
    found = stats.group_summary(rows).collect()
    assert len(found) == len(plain)
    for r in found:
        assert r["f1_median"] == pytest.approx(plain[r["label"]])


def test_constant_temperature(spark):
    rows = spark.createDataFrame(
        [(0, 1.0, 20.0), (0, 2.0, 20.0), (1, 3.0, 20.0), (1, 3.0, 20.0), (2, 1.0, 1.0), (2, 2.0, 2.0)],
        "label int, f1 double, temp double",
    )
    got = {r["label"]: (r["slope"], r["r2"]) for r in stats.temp_coefficient(rows, ["label"]).collect()}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[2] == pytest.approx((1, 1))


def test_bins_at_their_edges(spark):
    values = [0.0, 9.99, 10.0, 500.0, 1e9, float("inf"), -1.0]
    rows = spark.createDataFrame([(0, v) for v in values] + [(1, -5.0)], "label int, s2n double")
    got = {(r["label"], r["bin"]): r["n"] for r in stats.s2n_distribution(rows).collect()}
    assert [got[0, b] for b in range(7)] == [2, 1, 0, 0, 0, 0, 3]
    assert [got[1, b] for b in range(7)] == [0] * 7
    freq = spark.createDataFrame([(0, v) for v in (99.9, 100.0, 990.0, 1000.0, 1000.1)], "label int, f1 double")
    hist = {r["bin"]: r["n"] for r in stats.freq_histogram(freq).collect()}
    assert len(hist) == 90 and hist[0] == 1 and hist[89] == 2 and sum(hist.values()) == 3


def test_step_to_a_neighbour_stops_at_the_ends(spark):
    rows = spark.createDataFrame([(i, i, float(-i)) for i in range(5)], "rec_id long, load_seq long, f1 double")
    ranked = order.order_position(rows, "f1").cache()
    assert order.neighbour(ranked, 4, -1).first()["rec_id"] == 4
    assert order.neighbour(ranked, 4, 1).first()["rec_id"] == 3
    assert order.neighbour(ranked, 0, 3).first()["rec_id"] == 0


def test_medians_keep_every_group(spark):
    inf = float("inf")
    rows = [("a", 1.0, 1.0), ("a", 2.0, 2.0), ("b", inf, 1.0), ("b", inf, 1.0), ("c", None, 1.0), (None, 4.0, 1.0),
            ("d", -inf, 1.0), ("d", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "label string, f1 double, temp double")
    found = {r.label: (r.n, r.f1_median) for r in stats.group_summary(df).collect()}
    assert found == {"a": (2, 1.5), "b": (2, inf), "c": (1, None), None: (1, 4.0), "d": (2, -inf)}


def test_many_hot_keys_are_salted(spark, monkeypatch):
    monkeypatch.setattr(scale, "BROADCAST_ROWS", 3)
    left = spark.range(1000).selectExpr("id % 10 AS k", "id AS v")
    right = left.groupBy("k").count()
    joined = scale.join_unique(left, right, ["k"], "count", hot_rows=1)
    assert joined.count() == 1000 and joined.agg({"v": "sum", "count": "sum"}).first()[0] in (499500, 100000)
