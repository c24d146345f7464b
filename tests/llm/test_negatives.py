"""Hard negatives against brute force on whole numbers of any size."""

import collections
import math

import numpy as np
import pytest

from flighttone.llm import negatives
from tests.llm.test_operators import duck

SCHEMA = "vec_id long, embedding array<double>, label int, number long, score long, a int, r int, parts string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x") for r in rows], SCHEMA)


def brute(rows):
    held = []
    for i, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        held.append((i, [math.floor(256 * x) for x in vector], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    first = lambda found: sorted(found, key=lambda f: (-f[1], f[0] is None, f[0] or 0))
    for n, (i, a, label) in enumerate(held):
        if i is None or i % 100:
            continue
        scores = [(j, sum(x * y for x, y in zip(a, b)), same == label, m) for m, (j, b, same) in enumerate(held) if m != n]
        for j, positive, _, _ in first(s for s in scores if s[2])[:5]:
            near = first(s for s in scores if not s[2] and 30 * positive <= 100 * s[1] <= 90 * positive)[:10]
            yield from ((i, j, rank, k, positive, s) for rank, (k, s, _, _) in enumerate(near, 1))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    out = [(i, [float(x) for x in np.round(rng.normal(0.05, 0.1, 8), 2)], int(rng.integers(0, 3))) for i in range(420)]
    out += [out[100], out[100], out[205], (None, out[5][1], 1), (None, out[200][1], 2), (1000, [], 1), (1001, [0.5], 1), (1100, None, 1)]
    out += [(1200, [float("nan")] * 8, 1), (1300, [float("inf")] * 8, 1), (1400, [None] + [0.1] * 7, 1), (1500, [0.1] * 8, None)]
    out += [(1600, [-0.3] * 8, 1), (1700, [0.2] * 8, 9), (1701, [0.21] * 8, 9), (1800, [1000.25] * 8, 4), (1801, [0.001] * 8, 4)]
    return out


@pytest.mark.parametrize("size", [8192, 7])
def test_negatives(spark, rows, monkeypatch, size):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", size * 8)
    monkeypatch.setattr(negatives, "BLOCK_ANCHORS", size)
    found = negatives.mine(table(spark, rows).repartition(3))
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(brute(rows))


def test_negatives_as_in_sql(spark, rows):
    whole = [r for r in rows if r[0] is not None and r[1] and len(r[1]) == 8]
    columns = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score", "rank"]
    said = duck(negatives.sql(), [], {"embeddings": ("vec_id bigint, embedding double[], label int", whole)})
    assert collections.Counter(map(tuple, negatives.mine(table(spark, whole)).select(columns).collect())) == collections.Counter(said)


@pytest.mark.parametrize("top", [3, 300, 70_000, 1 << 24])
def test_products_are_exact(top):
    rng = np.random.default_rng(top)
    a, b = rng.integers(-top, top + 1, (2, 30, 200))
    a[0], b[0], b[1] = top, top, -top
    bound = 200 * top * top
    moduli = negatives.primes(bound)
    assert (negatives.products(a, b, moduli) == a @ b.T).all()
    assert 2 * bound < math.prod(moduli) < 1 << 63 and all(negatives.WIDTH * (p // 2) ** 2 < negatives.EXACT for p in moduli)


def test_negatives_edges(spark, rows):
    assert negatives.mine(table(spark, [])).count() == 0
    assert negatives.mine(table(spark, [r for r in rows if r[0] is not None and r[0] % 100])).count() == 0
    assert negatives.mine(table(spark, [(100, [0.5], 1), (101, [0.5], 1)])).count() == 0
    with pytest.raises(ValueError):
        negatives.mine(table(spark, [(100, [1e12], 1)]))
