"""Features, clusters and classifiers against brute force and separated blobs."""

import json
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from flighttone.operators import affinity, boosting, bridges, classify, cluster, features, graph, joins, neighbours, pairwise, spectral
from flighttone import scale
from flighttone.operators.features import FeatureSpec
from tests.conftest import blobs, matrix


def distances(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))


def brute_silhouette(x, labels):
    d = distances(x)
    out = []
    for i, c in enumerate(labels):
        own = labels == c
        if own.sum() == 1:
            out.append(0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == o].mean() for o in set(labels) - {c})
        out.append((b - a) / max(a, b))
    return np.mean(out)


def brute_dbscan(x, eps, min_pts):
    near = distances(x) <= eps
    core = near.sum(1) >= min_pts
    label = np.full(len(x), -1)
    c = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        stack, seen = [i], {i}
        while stack:
            u = stack.pop()
            if label[u] < 0:
                label[u] = c
            if core[u]:
                for v in np.flatnonzero(near[u]):
                    if v not in seen and label[v] < 0:
                        seen.add(v)
                        stack.append(v)
        c += 1
    return label, core


def labels_of(df):
    return np.array([r["label"] for r in df.orderBy("rec_id").collect()])


# --- distances ---------------------------------------------------------------------


@pytest.mark.parametrize("block_rows", [None, 37])
def test_silhouette(spark, block_rows):
    x, y = blobs(3, 40)
    y[0] = 7
    df = matrix(spark, x, y)
    assert pairwise.silhouette(df, block_rows=block_rows).first()[0] == pytest.approx(brute_silhouette(x, y))


def test_distance_sums_hold_few_distances():
    """Memory does not grow with the block that is met."""
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(1100, 3)), rng.normal(size=(30_000, 3))
    tracemalloc.start()
    sums = pairwise._distance_sums(x, y)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    np.testing.assert_allclose(sums[1090:], np.sqrt(((x[1090:, None] - y) ** 2).sum(-1)).sum(axis=1))


def test_silhouette_with_noise_and_too_few_labels(spark):
    x, y = blobs(2, 30)
    y[:5] = -1
    df = matrix(spark, x, y)
    assert pairwise.silhouette(df).first()[0] == pytest.approx(brute_silhouette(x, y))
    assert pairwise.silhouette(df, ignore_noise=True).first()[0] == pytest.approx(brute_silhouette(x[5:], y[5:]))
    assert np.isnan(pairwise.silhouette(matrix(spark, x)).first()[0])
    assert np.isnan(pairwise.silhouette(matrix(spark, x), method="squared").first()[0])


def test_relabelling_leaves_the_silhouette(spark):
    x, y = blobs(3, 30)
    a = pairwise.silhouette(matrix(spark, x, y)).first()[0]
    assert pairwise.silhouette(matrix(spark, x, (y + 1) % 3)).first()[0] == pytest.approx(a)


@pytest.mark.parametrize("block_rows", [None, 20])
def test_nearest(spark, block_rows):
    x, _ = blobs(2, 40)
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    found = neighbours.nearest(matrix(spark, x), 3, block_rows).collect()
    assert len(found) == 240
    for r in found:
        assert r["distance"] == pytest.approx(np.sort(d[r["rec_id"]])[r["place"] - 1])


def test_nearest_across_blocks(spark, monkeypatch):
    """Ties, copies, lone rows and groups of all sizes, the table of blocks cut as well; far blocks are never met."""
    monkeypatch.setattr(neighbours, "CHUNK", 3)
    x, _ = blobs(12, 40, d=6, apart=60)
    x = np.round(np.vstack([x, np.repeat(x[:1], 30, axis=0), np.full((1, 6), 500.0), x[5:9] + 1e-9]), 3)
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    df = matrix(spark, x)
    found = neighbours.nearest(df, 5, 16).orderBy("rec_id", "place").collect()
    assert [r["place"] for r in found] == [1, 2, 3, 4, 5] * len(x)
    np.testing.assert_allclose([r["distance"] for r in found], np.sort(d, axis=1)[:, :5].ravel(), atol=1e-5)
    row = neighbours.met_share(df, 5, 16).first()
    assert row["pairs"] == row["blocks"] * (row["blocks"] - 1) and 0 < row["share"] < 0.2


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_are_final_where_blocks_meet(spark):
    """No candidates go through a shuffle: a row comes out of its block's meetings once, with its list."""
    x, _ = blobs(3, 300)
    found = neighbours.neighbour_lists(matrix(spark, x), 20, 64)
    assert "Window" not in _plan(neighbours.nearest(matrix(spark, x), 20, 64)) and "Aggregate" not in _plan(found)
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    rows = found.collect()
    assert sorted(r["rec_id"] for r in rows) == list(range(len(x)))
    for r in rows:
        np.testing.assert_allclose(r["distances"], np.sort(d[r["rec_id"]])[:20])


@pytest.mark.parametrize("scale_", [1e-20, 1.0, 1e20])
def test_nearest_of_any_size_and_of_copies(spark, scale_):
    """Values beyond single precision, rows far from all others, and more copies than neighbours asked for: smallest ids come first."""
    x, _ = blobs(2, 150)
    x = np.vstack([x, np.repeat(x[:1], 40, axis=0), np.full((1, 5), 3e4)]) * scale_
    found = neighbours.nearest(matrix(spark, x), 4, 32).orderBy("rec_id", "place").collect()
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    np.testing.assert_allclose([r["distance"] for r in found], np.sort(d, axis=1)[:, :4].ravel())
    assert [r["other"] for r in found if r["rec_id"] == 320] == [0, 300, 301, 302]


def test_nearest_of_ids_that_repeat(spark):
    """Rows of one id share a list and are no neighbours of each other."""
    x = np.array([[0.0], [0.1], [1.0], [2.0]])
    df = matrix(spark, x).withColumn("rec_id", F.greatest("rec_id", F.lit(1)))
    got = {r["rec_id"]: (r["others"], [round(v, 6) for v in r["distances"]]) for r in neighbours.neighbour_lists(df, 2).collect()}
    assert got == {1: ([2, 2], [0.9, 1.0]), 2: ([1, 1], [0.9, 1.0]), 3: ([2, 1], [1.0, 1.9])}


def test_nearest_of_few(spark):
    found = neighbours.nearest(matrix(spark, np.arange(6.0).reshape(3, 2)), 5).collect()
    assert len(found) == 6 and max(r["place"] for r in found) == 2
    assert neighbours.nearest(matrix(spark, np.zeros((0, 2))), 2).count() == 0
    assert neighbours.nearest(matrix(spark, np.ones((1, 2))), 2).count() == 0


@pytest.mark.parametrize("held", [pairwise.LABEL_BYTES, 100_000])
def test_silhouette_of_many_labels(spark, monkeypatch, held):
    """Ten thousand labels, one of them with a third of all rows; means also in several pieces."""
    monkeypatch.setattr(pairwise, "LABEL_BYTES", held)
    rng = np.random.default_rng(8)
    centres = rng.uniform(0, 300, (10_000, 3))
    y = np.concatenate([np.arange(10_000), rng.integers(0, 10_000, 2000), np.full(6000, 17)])
    x = centres[y] + rng.normal(0, 1, (len(y), 3)) * np.where(y == 17, 40, 1)[:, None]
    order = np.argsort(y, kind="stable")
    x, y = x[order], y[order]
    first = np.searchsorted(y, np.arange(10_000))
    sizes = np.bincount(y)
    out = np.zeros(len(x))
    for i in range(0, len(x), 500):
        d = np.sqrt(((x[i : i + 500, None] - x[None]) ** 2).sum(-1))
        sums, rows = np.add.reduceat(d, first, axis=1), np.arange(len(d))
        own = y[i : i + 500]
        a = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
        means = sums / sizes
        means[rows, own] = np.inf
        b = means.min(axis=1)
        out[i : i + 500] = np.where(sizes[own] == 1, 0, (b - a) / np.maximum(a, b))
    assert pairwise.silhouette(matrix(spark, x, y), block_rows=1000).first()[0] == pytest.approx(out.mean())


@pytest.mark.parametrize("eps, block_rows", [(1.2, 4096), (1.8, 16), (2.6, 16), (50.0, 64)])
def test_dbscan_by_brute_force(spark, eps, block_rows, monkeypatch):
    monkeypatch.setattr(pairwise, "CELL_ROWS", 5)
    x, _ = blobs(3, 60, d=3, apart=6)
    x = np.vstack([x, np.repeat(x[:1], 80, axis=0), np.full((3, 3), 40.0)])  # copies, and a lone trio
    want, core = brute_dbscan(x, eps, 5)
    found = pairwise.density_clusters(matrix(spark, x), [eps], 5, block_rows).orderBy("rec_id").collect()
    assert len(found) == len(x)
    np.testing.assert_array_equal([r["label"] for r in found], want)
    np.testing.assert_array_equal([r["is_core"] for r in found], core)


def test_blocks_send_roots_not_points(spark, monkeypatch):
    """Points are linked inside their block; components are looked for among the roots of blocks, and blocks do not grow in number with the table."""
    seen = []
    whole = pairwise.components
    monkeypatch.setattr(pairwise, "components", lambda nodes, links: seen.append(nodes.count()) or whole(nodes, links))
    x, _ = blobs(2, 600, d=2, apart=30)
    want, core = brute_dbscan(x, 1.0, 5)
    found = pairwise.density_clusters(matrix(spark, x), [1.0], 5).orderBy("rec_id").collect()
    np.testing.assert_array_equal([r["label"] for r in found], want)
    np.testing.assert_array_equal([r["is_core"] for r in found], core)
    assert seen[0] < 100 < core.sum()


def test_sweep_equals_single_runs(spark):
    x, _ = blobs(2, 50, d=2, apart=5)
    df = matrix(spark, x)
    sweep = cluster.dbscan_sweep(df, [0.5, 1.0, 3.0]).collect()
    for eps in (0.5, 1.0, 3.0):
        mine = [r["label"] for r in sorted((r for r in sweep if r["eps"] == eps), key=lambda r: r["rec_id"])]
        np.testing.assert_array_equal(mine, brute_dbscan(x, eps, 5)[0])


def test_numbers_of_many_clusters(spark):
    roots = spark.createDataFrame([(e, 7 * i, 1) for e in (0, 1) for i in range(20)], "e int, root long, c long")
    few = pairwise._numbered(roots).select("e", "root", "label").collect()
    many = pairwise._numbered(roots, few=5).select("e", "root", "label").collect()
    assert sorted(few) == sorted(many) and {r["label"] for r in few} == set(range(20))


@pytest.mark.parametrize("few", [100_000, 0])
def test_long_chain_is_one_component(spark, few):
    links = spark.createDataFrame([(0, i, i + 1) for i in range(300)] + [(1, 5, 9)], "e int, u long, v long")
    nodes = spark.createDataFrame([(0, i) for i in range(301)] + [(1, 5), (1, 9), (1, 11)], "e int, id long")
    got = {(r["e"], r["id"]): r["root"] for r in pairwise.components(nodes, links, few).collect()}
    assert {got[0, i] for i in range(301)} == {0}
    assert (got[1, 5], got[1, 9], got[1, 11]) == (5, 5, 11)


def test_radius_steps():
    assert cluster.eps_grid()[:3] == [0.01, 0.02, 0.03] and len(cluster.eps_grid()) == 36
    assert cluster.next_eps(0.5, 0.1, 1) == pytest.approx(0.51)
    assert cluster.next_eps(0.01, 0.1, -1) == pytest.approx(0.01)


# --- clusterings ----------------------------------------------------------------------


@pytest.mark.parametrize(
    "method, k", [("kmeans", 2), ("kmeans", 3), ("gaussian_mixture", 2), ("gaussian_mixture", 3), ("spectral", 2)]
)
def test_blobs_are_found(spark, method, k):
    x, y = blobs(k, 60)
    df = matrix(spark, x, y)
    found = labels_of(cluster.CLUSTERERS[method](df, k))
    assert len(set(zip(found, y))) == k and set(found) == set(range(k))
    assert brute_silhouette(x, found) > 0.6


@pytest.mark.parametrize("k, coarse", [(2, 1500), (3, 1500), (5, 1500), (4, 40)])
def test_separated_groups_are_the_spectral_clusters(spark, monkeypatch, k, coarse):
    """Their graphs of few neighbours fall apart; also where the graph is made smaller first."""
    monkeypatch.setattr(spectral, "COARSE", coarse)
    rng = np.random.default_rng(k)
    y = rng.permutation(np.repeat(np.arange(k), 60))
    x = 10 * np.eye(5)[y] + rng.normal(0, 0.3, (len(y), 5))
    found = labels_of(cluster.spectral(matrix(spark, x), k))
    first = [int(np.flatnonzero(y == c)[0]) for c in y]
    np.testing.assert_array_equal(found, [sorted(set(first)).index(f) for f in first])


def test_shortest_tree_joins_the_parts(spark):
    """Copies, parts of one row, and the links a shortest tree has."""
    x = np.array([[0, 0], [0, 0], [0, 0], [1, 0], [1, 0], [1, 0], [9, 0], [9, 1], [9.5, 0], [30, 0], [31, 0], [30, 1]], float)
    held = spectral.joined_graph(matrix(spark, x), 3, block_rows=5).collect()
    across = {(r["src"], r["dst"]): r["w"] for r in held if r["src"] < r["dst"] and x[r["dst"], 0] - x[r["src"], 0] >= 1}
    assert sorted(x[b, 0] - x[a, 0] for a, b in across if x[b, 0] - x[a, 0] > 1.2) == [8, 20.5]
    assert len(across) == 3 or len(across) == 4
    assert all(r["w"] == 1 for r in held if r["src"] == r["dst"]) and len({r["src"] for r in held}) == len(x)
    modes = np.array([r["x"] for r in spectral.slowest_modes(spark.createDataFrame(held), 2).orderBy("id").collect()])
    assert np.ptp(modes[:, 0]) == pytest.approx(0, abs=1e-9) and (modes[:9, 1] * modes[9:, 1].mean() < 0).all()


@pytest.mark.parametrize("block_rows", [None, 40])
def test_shortest_links_out_of_parts(spark, block_rows):
    """Far and near groups, copies in different parts, parts that do not ask, and values of any size, as all pairs tell."""
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 1, (150, 20)) + 30 * np.eye(20)[3], rng.normal(0, 1, (150, 20)), rng.normal(0, 1e-3, (60, 20)) - 5000, np.ones((9, 20))])
    part = np.concatenate([np.zeros(150, int), rng.integers(1, 30, 150), np.full(60, 40), [50, 50, 50, 51, 51, 52, 52, 52, 52]])
    asks = part != 0
    rows = spark.createDataFrame([(i, int(p), bool(a), [float(v) for v in r]) for i, (r, p, a) in enumerate(zip(x, part, asks))], "id long, root long, asks boolean, features array<double>")
    found = {r["root"]: r for r in bridges.shortest_out(rows, block_rows).collect()}
    assert set(found) == set(part[asks])
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    for p in found:
        mine = np.flatnonzero(part == p)
        pairs = [(round(d[a, b], 9), min(a, b), max(a, b)) for a in mine for b in np.flatnonzero(part != p)]
        got = found[p]["src"], found[p]["dst"]
        assert (round(found[p]["distance"], 9), min(got), max(got)) == min(pairs) and part[got[0]] == p


def test_rows_proven_too_far_do_not_meet(spark, monkeypatch):
    """Of two groups apart only some rows have to be compared for the link between them."""
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.1, (4000, 16)) + 10 * np.eye(16)[np.arange(4000) % 2]
    rows = spark.createDataFrame([(i, i % 2, i % 2 == 1, [float(v) for v in r]) for i, r in enumerate(x)], "id long, root long, asks boolean, features array<double>")
    left, once = [], bridges._sifted
    monkeypatch.setattr(bridges, "_sifted", lambda *a: left.append(once(*a)) or left[-1])
    best = bridges.shortest_out(rows).first()
    assert left[-1].count() < 1000
    d = np.sqrt(((x[1::2, None] - x[::2]) ** 2).sum(axis=2))
    assert best["distance"] == pytest.approx(d.min()) and (best["src"], best["dst"]) == (2 * (d.argmin() // 2000) + 1, 2 * (d.argmin() % 2000))


def test_small_parts_ask_first(spark):
    parts = spark.createDataFrame([(i, 0 if i < 150 else 1 if i < 195 else i) for i in range(200)], "id long, root long")
    assert {r["id"] for r in spectral._asking(parts).filter("asks").collect()} == set(range(195, 200))
    assert {r["root"] for r in spectral._asking(parts.filter("id < 195")).filter("asks").collect()} == {1}


@pytest.mark.parametrize("held", [0, 1 << 30])
def test_levels_in_one_task_and_over_tables(spark, monkeypatch, held):
    """A graph that one task holds has the modes that the tables of its links have, and those of all links at once."""
    monkeypatch.setattr(spectral, "COARSE", 80)
    monkeypatch.setattr(spectral, "WHOLE_BYTES", held)
    links = spectral.joined_graph(matrix(spark, np.random.default_rng(2).normal(0, 1, (150, 3)) + 4 * np.eye(3)[np.arange(150) % 3]), 4)
    modes = spectral.slowest_modes(links, 3).orderBy("id").collect()
    assert [r["id"] for r in modes] == list(range(150))
    w = np.zeros((150, 150))
    for r in links.collect():
        w[r["src"], r["dst"]] += r["w"]
    x, d = np.array([r["x"] for r in modes]), w.sum(axis=1)
    values = np.linalg.eigvalsh(w / np.sqrt(np.outer(d, d)))[::-1][:3]
    got = [(v @ w @ v) / (v * d @ v) for v in x.T]
    np.testing.assert_allclose(1 - np.array(got), 1 - values, rtol=0.05, atol=1e-6)


def test_hash_of_pairs_is_that_of_columns(spark):
    a, b = [1, 0, -7, 2**40], [2, 0, 2**62, -(2**63)]
    rows = spark.createDataFrame(list(zip(a, b)), "a long, b long").selectExpr("xxhash64(a, b) AS h").collect()
    assert graph.pair_hash(np.array(a), np.array(b)).tolist() == [r["h"] for r in rows]


def test_loose_bounds_leave_the_neighbours(spark):
    """Many rows of one block within the first bound: a bound is taken from the block."""
    x = np.random.default_rng(8).normal(0, 1, (700, 6))
    found = neighbours._Nearest(x, np.arange(700), 3, np.full(700, 50.0))
    found.feed(x, np.arange(700))
    held = found._held
    first, others, _ = found.lists()
    d = ((x[:, None] - x) ** 2).sum(axis=2) + np.diag(np.full(700, np.inf))
    assert held < 20_000 and (others.reshape(700, 3) == np.argsort(d, axis=1, kind="stable")[:, :3]).all()


def test_mixture_drops_what_it_does_not_need(spark):
    x, y = blobs(2, 150, d=4, apart=15)
    found = labels_of(cluster.gaussian_mixture(matrix(spark, x), 5))
    assert set(found) == set(range(len(set(found))))
    assert all(len(set(y[found == c])) == 1 for c in set(found))


def test_summary(spark):
    x, y = blobs(2, 40)
    df = matrix(spark, x, y)
    r = cluster.clustering_summary(df, cluster.kmeans(df, 2), "kmeans", 2).first()
    assert (r["method"], r["parameter"], r["n_clusters"]) == ("kmeans", 2, 2)
    assert r["silhouette"] == pytest.approx(brute_silhouette(x, y))


def brute_line(v, k):
    v = np.sort(v)
    n = len(v)
    s = lambda a, b: ((v[a:b] - v[a:b].mean()) ** 2).sum()
    best = [[s(0, i) if i else 0 for i in range(n + 1)]]
    for _ in range(1, k):
        best.append([min((best[-1][j] + s(j, i) for j in range(1, i)), default=0) if i else 0 for i in range(n + 1)])
    return best[k - 1][n]


@pytest.mark.parametrize("k", [2, 3, 4, 5])
def test_optimal_line_clusters(spark, k, monkeypatch):
    monkeypatch.setattr(cluster, "FAN_OUT", 4)
    monkeypatch.setattr(cluster, "AXIS_BLOCK", 8)
    v = np.round(np.random.default_rng(k).gamma(2, 20, 70), 1)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "rec_id long, v double")
    label = labels_of(cluster.ckmeans(df, "v", k))
    assert set(label) == set(range(k))
    cost = sum(((v[label == c] - v[label == c].mean()) ** 2).sum() for c in range(k))
    assert cost == pytest.approx(brute_line(v, k))
    assert all(v[label == c].max() < v[label == c + 1].min() for c in range(k - 1))


def test_line_by_hand(spark):
    v = [1.0, 1.0, 1.0, 5.0, 5.0, 9.0, 9.0, 9.0, 9.0]
    df = spark.createDataFrame(list(enumerate(v)), "rec_id long, v double")
    assert list(labels_of(cluster.ckmeans(df, "v", 3))) == [0, 0, 0, 1, 1, 2, 2, 2, 2]
    same = spark.createDataFrame([(i, 4.0) for i in range(5)], "rec_id long, v double")
    assert list(labels_of(cluster.ckmeans(same, "v", 3))) == [0] * 5
    with pytest.raises(ValueError):
        cluster.ckmeans(df, "v", 10)


def test_poor_match_name(spark):
    got = joins.with_label_names(
        spark.createDataFrame([(1, 0), (2, -1)], "rec_id long, label int"),
        spark.createDataFrame([(0, "aedes")], "group_id int, group_name string"),
    )
    assert {r["rec_id"]: r["label_name"] for r in got.collect()} == {1: "aedes", 2: "Poor Match"}


# --- features ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def recordings(spark):
    x, y = blobs(2, 50, d=6)
    df = matrix(spark, x, y).withColumnRenamed("features", "rawdata")
    return x, df.withColumns({"temp_norm": F.col("rec_id") / 100, "fd_power": F.lit(0.25), "f1": F.col("rec_id") * 2.0})


def values(df):
    return np.array([r["features"] for r in df.orderBy("rec_id").collect()])


def test_descriptor_and_order_of_steps(recordings):
    x, df = recordings
    spec = FeatureSpec("RAW", "pca", temp=True, power=True, scaler="StandardScaler")
    assert spec.descriptor == "RAW_pca_temp_pwr_StandardScaler"
    assert FeatureSpec().descriptor == "MFCC_NoScaler"
    made, fitted = features.build_features(df, spec)
    got = values(made)
    assert got.shape == (100, 7) and features.descriptor_of(made) == spec.descriptor
    np.testing.assert_allclose(got.mean(0), 0, atol=1e-9)
    np.testing.assert_allclose(got[:, :6].std(0), 1, atol=1e-9)
    again = features.FittedFeatures.from_json(fitted.to_json()).transform(df)
    np.testing.assert_allclose(values(again), got)


def test_components(recordings):
    x, df = recordings
    fitted = features.fit_pca(df.withColumnRenamed("rawdata", "features"), 5)
    centred = x - x.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    np.testing.assert_allclose(fitted["explained"], (s**2 / (s**2).sum())[:5], atol=1e-9)
    np.testing.assert_allclose(np.abs(np.array(fitted["components"]).T), np.abs(vt[:5]), atol=1e-7)


def test_scalers(spark):
    x = np.array([[1.0, 5.0, 0.0], [2.0, 5.0, 0.0], [4.0, 5.0, 0.0], [9.0, 5.0, 0.0]])
    df = matrix(spark, x)
    got = values(features.scale(df, "StandardScaler"))
    np.testing.assert_allclose(got[:, 0], (x[:, 0] - 4) / x[:, 0].std())
    np.testing.assert_allclose(got[:, 1:], 0)
    got = values(features.scale(df, "RobustScaler"))
    lo, mid, hi = np.percentile(x[:, 0], [25, 50, 75])
    np.testing.assert_allclose(got[:, 0], (x[:, 0] - mid) / (hi - lo))
    got = values(features.scale(matrix(spark, np.array([[3.0, 4.0], [0.0, 0.0]])), "Normalizer"))
    np.testing.assert_allclose(got, [[0.6, 0.8], [0, 0]])
    with pytest.raises(ValueError):
        FeatureSpec(scaler="MinMax")


def test_unequal_lengths_are_refused(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "rec_id long, rawdata array<double>")
    with pytest.raises(ValueError, match="length"):
        features.build_features(df, FeatureSpec("RAW"))


def test_machine_learns(recordings):
    _, df = recordings
    x = features.scale(df.withColumnRenamed("rawdata", "features"), "Normalizer")
    x = x.withColumn("features", F.transform("features", lambda v: (v + 1) / 2))
    fitted = features.fit_rbm(x, 12, rounds=8)
    assert fitted["loss"][-1] < fitted["loss"][0]
    got = values(features.apply_rbm(x, fitted))
    assert got.shape == (100, 12) and ((got > 0) & (got < 1)).all()


def test_machine_does_not_hang_on_the_layout(spark, monkeypatch):
    """Any number of partitions and any order of rows gives the same weights, also from many blocks added up in steps."""
    monkeypatch.setattr(features, "RBM_ROWS", 16)
    monkeypatch.setattr(scale, "FAN", 3)
    rng = np.random.default_rng(2)
    x = np.where(np.arange(200)[:, None] % 2, rng.normal(5, 1, (200, 6)), rng.normal(-3, 1, (200, 6)))
    df = matrix(spark, x)
    fits = [features.fit_rbm(d, 4, rate=1.0, rounds=6, minmax=True) for d in (df.coalesce(1), df.repartition(4), df.orderBy(F.desc("rec_id")).repartition(8))]
    assert fits[0] == fits[1] == fits[2] and fits[0]["loss"][-1] < fits[0]["loss"][0]
    np.testing.assert_allclose(fits[0]["low"], x.min(axis=0))
    np.testing.assert_allclose(fits[0]["range"], np.ptp(x, axis=0))
    held = features._blocks_of(df)
    parts = held.select("block", "rows").withColumnRenamed("rows", "sums").collect()
    sums = spark.createDataFrame([(i, np.full(2, float(i)).tobytes()) for i in range(50)], "block long, sums binary")
    assert scale.tree_sum(sums, 2, 50).tolist() == [1225, 1225] and len(parts) == 13


def test_draws_are_uniform():
    u = features._draws(3, 5, np.arange(2000, dtype=np.int64), 50)
    assert abs(u.mean() - 0.5) < 0.005 and abs(u.var() - 1 / 12) < 0.002 and len(np.unique(u)) == u.size
    assert abs(np.corrcoef(u[:, 0], u[:, 1])[0, 1]) < 0.1 and abs(np.corrcoef(u[:-1, 0], u[1:, 0])[0, 1]) < 0.1
    assert (features._draws(3, 6, np.arange(2000, dtype=np.int64), 50) != u).all()


def test_cache_tells_taps_apart(recordings):
    _, df = recordings
    waves = df.withColumnRenamed("rawdata", "waveform")
    one, two = (FeatureSpec("DWT_own", filters={"own": ([a, a], [a, -a])}) for a in (0.7, 0.5))
    assert one != two and one.descriptor != two.descriptor and one == FeatureSpec("DWT_own", filters={"own": ((0.7, 0.7), (0.7, -0.7))})
    cache = features.FeatureCache()
    (a, fit), (b, _) = cache.get(waves, one), cache.get(waves, two)
    assert values(a).tolist() != values(b).tolist() and cache.get(waves, one)[0] is a
    assert features.FittedFeatures.from_json(fit.to_json()).spec == one
    cache.reset()


def test_cache_by_descriptor(recordings):
    _, df = recordings
    cache = features.FeatureCache()
    first, _ = cache.get(df, FeatureSpec("RAW"))
    assert cache.get(df, FeatureSpec("RAW"))[0] is first
    cache.reset()
    assert cache.get(df, FeatureSpec("RAW"))[0] is not first
    cache.reset()


def test_temperature_slots(spark):
    df = spark.createDataFrame([(t,) for t in (-3.0, 5.0, 5.5, 5.25, 5.75, 55.0, 80.0)], "temp double")
    rows = [r["temp_one_hot"] for r in features.temp_one_hot(df).collect()]
    assert all(len(r) == 101 and sum(r) == 1 for r in rows)
    assert [r.index(1) for r in rows] == [0, 0, 1, 0, 2, 100, 100]


def test_affinity(spark):
    x, _ = blobs(2, 60)
    df = matrix(spark, x)
    cond = affinity.conditional_affinity(df, 20).collect()
    rows: dict = {}
    for r in cond:
        rows.setdefault(r["rec_id"], []).append(r["p"])
    for p in rows.values():
        assert sum(p) == pytest.approx(1)
        assert np.exp(-sum(v * np.log(v) for v in p if v > 0)) == pytest.approx(20, abs=0.1)
    both = {(r["rec_id"], r["other"]): r["p"] for r in affinity.neighbour_affinity(df, 20).collect()}
    assert sum(both.values()) == pytest.approx(1)
    assert all(both[b, a] == pytest.approx(p) for (a, b), p in both.items())


def test_affinities_search_once(spark):
    """The two directions of a pair come from one search and one row of sums."""
    x, _ = blobs(2, 60)
    plan = _plan(affinity.neighbour_affinity(matrix(spark, x), 20))
    assert plan.count("MapInArrow") == 1 and "Union" not in plan.split("MapInArrow")[0]


# --- classifiers ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    x, y = blobs(3, 60)
    df = matrix(spark, x, y)
    made, fitted = features.build_features(df.withColumnRenamed("features", "rawdata"), FeatureSpec("RAW", scaler="StandardScaler"))
    return made, fitted


@pytest.mark.parametrize("kind, options", [("boosted", {"rounds": 5, "depth": 3}), ("mlp", {"rounds": 60})])
def test_blobs_are_learned(spark, labelled, kind, options, tmp_path):
    made, fitted = labelled
    model, scored = classify.train(made, kind, features=fitted, **options)
    assert scored.count() == 36
    result = classify.evaluate(scored)
    assert result["accuracy"].first()[0] > 0.9
    assert result["confusion"].agg(F.sum("n")).first()[0] == 36
    shares = classify.probabilities(model, made).collect()
    assert all(sum(r["probability"]) == pytest.approx(1) and len(r["probability"]) == 3 for r in shares)
    path = classify.save_model(spark, model, str(tmp_path))
    assert path.endswith(f"{kind}_RAW_StandardScaler")
    loaded = classify.load_model(spark, path)
    a = classify.predict(model, made, 0.6).orderBy("rec_id").collect()
    assert a == classify.predict(loaded, made, 0.6).orderBy("rec_id").collect()
    assert loaded.features.spec == fitted.spec and loaded.n_classes == 3


def test_two_classes_curves_and_importance(spark):
    x, y = blobs(2, 60)
    rows = classify.holdout_split(matrix(spark, x, y))
    model = classify.train_boosted(rows, rounds=4, depth=2)
    assert len(model.parts) == 1
    curves = classify.training_curves(model, rows).orderBy("is_test", "round").collect()
    train = [r for r in curves if not r["is_test"]]
    assert [r["round"] for r in train] == list(range(1, len(train) + 1))
    assert train[-1]["logloss"] <= train[0]["logloss"]
    share = [r["importance"] for r in classify.feature_importance(spark, model).collect()]
    assert len(share) == 5 and sum(share) == pytest.approx(1)
    fit = classify.probabilities(model, rows).select("rec_id", "label", (F.col("probability")[1] > 0.5).cast("int").alias("prediction"))
    last = {r["is_test"]: r["error"] for r in curves if r["round"] == len(train)}
    wrong = fit.join(rows.select("rec_id", "is_test"), "rec_id").groupBy("is_test").agg(
        F.avg((F.col("label") != F.col("prediction")).cast("int")).alias("e")
    )
    assert {r["is_test"]: r["e"] for r in wrong.collect()} == pytest.approx(last)


def marked(spark, x, y, share=0.25):
    test = np.arange(len(y)) % int(1 / share) == 0
    rows = [(i, [float(v) for v in r], int(c), bool(t)) for i, (r, c, t) in enumerate(zip(x, y, test))]
    return spark.createDataFrame(rows, "rec_id long, features array<double>, label int, is_test boolean"), test


def test_classes_share_one_loss(spark, monkeypatch):
    """Curves are those of the kept model's own probabilities, margins stored in between; any layout gives the same trees."""
    monkeypatch.setattr(boosting, "STORED", 2)
    monkeypatch.setattr(boosting, "FAN", 2)
    monkeypatch.setattr(boosting, "CHUNK_BYTES", 4000)
    rng = np.random.default_rng(6)
    x = np.hstack([rng.normal(0, 1, (300, 4)), np.full((300, 1), 2.0)])
    y = (x[:, 0] + rng.normal(0, 0.3, 300) > 0).astype(int) + (x[:, 1] * x[:, 2] > 0.2)
    x[::17, 3] = np.nan
    df, test = marked(spark, x, y)
    models = [classify.train_boosted(d, rounds=5, depth=3) for d in (df.coalesce(1), df.orderBy(F.desc("rec_id")).repartition(7))]
    one, two = (m.parts[0] for m in models)
    assert [vars(t) for r in one.trees for t in r] == [vars(t) for r in two.trees for t in r] and one.curves == two.curves
    assert {len(r) for r in one.trees} == {3}
    p = one.probabilities(x)
    np.testing.assert_allclose(p.sum(axis=1), 1)
    for part, at in ((~test, 0), (test, 2)):
        loss, error = one.curves[-1][at : at + 2]
        assert loss == pytest.approx(-np.log(p[part, y[part]]).mean(), abs=1e-4)
        assert error == pytest.approx((p[part].argmax(axis=1) != y[part]).mean())
    assert one.curves[-1][0] < one.curves[0][0] and one.split_counts()[4] == 0
    again = boosting.Booster.from_dict(json.loads(json.dumps(one.to_dict())))
    np.testing.assert_array_equal(again.probabilities(x), p)


def test_root_splits_are_the_best(spark):
    """Every cut of every feature tried by hand, with the leaves' values."""
    rng = np.random.default_rng(7)
    x, y = np.round(rng.normal(0, 1, (80, 3)), 1), rng.integers(0, 2, 80)
    df, test = marked(spark, x, y)
    tree = classify.train_boosted(df, rounds=1, depth=1).parts[0].trees[0][0]
    g, h, seen = 0.5 - y[~test], np.full((~test).sum(), 0.25), x[~test]
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    best = max(
        (round(score(seen[:, f] < c) + score(seen[:, f] >= c), 9), -f, -c)
        for f in range(3) for a, b in zip(np.unique(seen[:, f]), np.unique(seen[:, f])[1:]) for c in [(a + b) / 2]
        if min((seen[:, f] < c).sum(), (seen[:, f] >= c).sum()) >= 4
    )
    assert (tree.feature[0], tree.cut[0]) == (-best[1], pytest.approx(-best[2]))
    low = seen[:, tree.feature[0]] < tree.cut[0]
    want = [-0.3 * g[m].sum() / (h[m].sum() + 1) for m in (low, ~low)]
    assert tree.value[1:] == pytest.approx(want, abs=1e-4)


def test_training_ends_where_nothing_splits(spark):
    x = np.repeat(np.arange(3.0), 40)[:, None]
    df, _ = marked(spark, x, np.repeat(np.arange(3), 40))
    model = classify.train_boosted(df)
    assert 3 < len(model.parts[0].trees) < 60
    assert classify.predict(model, df).join(df.withColumnRenamed("label", "y"), "rec_id").filter("label <> y").count() == 0
    with pytest.raises(ValueError, match="learn"):
        classify.train_boosted(df.withColumn("is_test", F.lit(True)))


def test_boosting_stops_after_rounds_without_gain():
    losses = [5, 4, 4.5, 4.6, 3, 3.5, 3.4, 3.3, 2]
    assert classify._best_round(losses, 0.0, 10) == (9, False)
    assert classify._best_round(losses, 0.0, 3) == (5, True)
    assert classify._best_round(losses, 0.0, 2) == (2, True)
    assert classify._best_round(losses, 1.5, 10) == (5, False)  # 2 is not better than 3 by more than 1.5


def test_boosting_keeps_the_best_round(spark):
    x, y = blobs(2, 60)
    noisy = np.where(np.arange(len(y)) % 5 == 0, 1 - y, y)
    rows = classify.holdout_split(matrix(spark, x, noisy))
    model = classify.train_boosted(rows, rounds=40, depth=2, patience=4)
    curves = classify.training_curves(model, rows).filter("is_test").orderBy("round").collect()
    losses = [r["logloss"] for r in curves]
    assert len(model.parts[0].trees) == len(losses) < 40
    assert losses[-1] == min(losses)
    untested = classify.train_boosted(rows.withColumn("is_test", F.lit(False)), rounds=3, depth=2)
    assert len(untested.parts[0].trees) == 3


def test_noise_labels_and_other_features_are_refused(spark, labelled):
    made, _ = labelled
    with pytest.raises(ValueError, match="labels"):
        classify.train_boosted(classify.holdout_split(made.withColumn("label", F.lit(-1))), rounds=1)
    model = classify.Model("boosted", [], 2, 5, descriptor="MFCC_NoScaler")
    with pytest.raises(ValueError, match="MFCC"):
        classify.predict(model, made)


def test_minimum_probability(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.1, 0.9]), (3, [0.6, 0.4])], "rec_id long, probability array<double>")
    got = {r["rec_id"]: (r["label"], r["is_core"]) for r in classify.choose_label(df, 0.6).collect()}
    assert got == {1: (-1, False), 2: (1, True), 3: (0, True)}
    assert {r["label"] for r in classify.choose_label(df).collect()} == {0, 1}


def test_split_is_exact_and_stable(spark):
    df = spark.range(101).withColumnRenamed("id", "rec_id")
    marked = classify.holdout_split(df)
    assert marked.filter("is_test").count() == 21
    again = classify.holdout_split(df.repartition(3))
    assert {tuple(r) for r in marked.collect()} == {tuple(r) for r in again.collect()}


def test_spec_is_plain_json(labelled):
    assert json.loads(labelled[1].to_json())["spec"]["use"] == "RAW"
