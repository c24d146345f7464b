"""Spectral clusters of the graph of nearest neighbours.

Parts of the graph that are not connected are joined by their shortest links, which
weigh the less the longer they are.  The slowest modes of a walk on the graph are found on a
graph made smaller level by level, by merging each node with its strongest neighbour, until one
machine can solve it whole; on the way back each level's modes are smoothed by
steps of the walk and turned to the best ones in their span (Rayleigh and Ritz), from sums of products that
are as small as the number of modes.  Their rows are clustered by k-means from many starts, all of which share each pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flighttone.operators.blocks import stack
from flighttone.operators.bridges import shortest_out
from flighttone.operators.graph import Graph, dense_modes, refined, turned
from flighttone.operators.neighbours import nearest
from flighttone.operators.pairwise import components
from flighttone.scale import join_unique, materialize

#: Nodes of a graph that is solved whole.
COARSE = 1500
#: Modes beyond those asked for, which speed up the others.
SPARE = 4
#: Steps of the walk before modes are turned, and times this is done at most.
STEPS, TURNS = 6, 8
#: Links whose parts one task finds, and bytes of a graph and its modes that one task holds.
FEW_LINKS, WHOLE_BYTES = 4_000_000, 512 << 20
#: Bytes that take a link, and a node's value in a mode; rows of modes sent at once.
LINK_BYTES, MODE_BYTES, WHOLE_ROWS = 64, 32, 8192
#: Parts of more than this share of the rows ask only when there are no smaller ones.
ASKING = 64
#: Change of a mode's decay, relative to it, that is good enough.
SETTLED = 0.01
#: Rows from which k-means starts are drawn, and passes at most.
START_ROWS, PASSES = 4096, 100
# Starts and seed.
STARTS, SEED = 25, 101557


# --- the graph ---------------------------------------------------------------------


def neighbour_graph(df: DataFrame, neighbours: int) -> tuple[DataFrame, float]:
    """Links ``src, dst, w`` in both directions, and their mean distance.

    A recording counts among its own ``neighbours``; links in one direction only weigh half.
    """
    near = materialize(nearest(df, neighbours - 1).select("rec_id", "other", "distance"))
    one = near.select(F.col("rec_id").alias("src"), F.col("other").alias("dst"))
    both = one.unionByName(near.select(F.col("other").alias("src"), F.col("rec_id").alias("dst")))
    links = both.groupBy("src", "dst").agg((F.count(F.lit(1)) / 2).alias("w"))
    return links, near.agg(F.avg("distance")).first()[0] or 0.0


def _parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id, root`` of the connected parts."""
    found = components(
        nodes.select(F.lit(0).alias("e"), "id"),
        links.filter("src < dst").select(F.lit(0).alias("e"), F.col("src").alias("u"), F.col("dst").alias("v")),
        FEW_LINKS,
    )
    return found.select("id", "root")


def _asking(parts: DataFrame) -> DataFrame:
    """The parts with ``asks``, whether a part's shortest link is looked for: those of small ones, as long as there are any, else of all but the largest.

    The shortest link out of a part belongs to the tree, whether or not others ask.
    """
    sizes = materialize(parts.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    small = F.col("n") * ASKING < sizes.agg(F.sum("n")).first()[0]
    if sizes.filter(small).isEmpty():
        small = F.col("root") != sizes.orderBy(F.desc("n"), "root").first()["root"]
    return join_unique(parts, sizes.withColumn("asks", small), ["root"], "n").select("id", "root", "asks")


def joined_graph(df: DataFrame, neighbours: int, block_rows: int | None = None) -> DataFrame:
    """The neighbour graph, its parts joined as a shortest tree over them would, with a link from every node to itself."""
    nodes = df.select(F.col("rec_id").cast("long").alias("id"))
    links, scale = neighbour_graph(df, neighbours)
    links = materialize(links)
    parts = materialize(_parts(nodes.distinct(), links))
    rows = df.select(F.col("rec_id").cast("long").alias("id"), F.col("features").cast("array<double>"))
    bridges = []
    while parts.select("root").distinct().limit(2).count() > 1:
        found = materialize(shortest_out(materialize(rows.join(_asking(parts), "id")), block_rows))
        share = F.try_divide(F.lit(scale), "distance")
        weight = F.coalesce(F.least(F.lit(1.0), share * share), F.lit(1.0)) / 2
        bridge = found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), weight.alias("w"))
        bridges.append(materialize(bridge.dropDuplicates(["src", "dst"])))
        ends = bridges[-1].join(parts.select(F.col("id").alias("src"), F.col("root").alias("u")), "src").join(
            parts.select(F.col("id").alias("dst"), F.col("root").alias("v")), "dst")
        merged = _parts(parts.select(F.col("root").alias("id")).distinct(), ends.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")))
        sizes = parts.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
        moved = merged.select(F.col("id").alias("root"), F.col("root").alias("to")).join(sizes, "root")
        parts = materialize(join_unique(parts, materialize(moved), ["root"], "n").select("id", F.col("to").alias("root")))
    for bridge in bridges:
        links = links.unionByName(bridge).unionByName(bridge.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    own = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("w"))
    return materialize(links.unionByName(own))


# --- its slowest modes -------------------------------------------------------------


def _smaller(links: DataFrame) -> DataFrame:
    """``id, to``: each node and the group it is merged into with its strongest neighbour."""
    order = F.struct("w", F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")).alias("h"), "dst")
    picks = links.filter("src <> dst").groupBy("src").agg(F.max(order).alias("m")).select("src", F.col("m.dst").alias("dst"))
    nodes = links.select(F.col("src").alias("id")).distinct()
    pairs = picks.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return _parts(nodes, pairs).select("id", F.col("root").alias("to"))


def _merged(links: DataFrame, groups: DataFrame) -> DataFrame:
    half = links.join(groups.select(F.col("id").alias("src"), F.col("to").alias("a")), "src").groupBy("a", "dst").agg(F.sum("w").alias("w"))
    whole = half.join(groups.select(F.col("id").alias("dst"), F.col("to").alias("b")), "dst").groupBy("a", "b").agg(F.sum("w").alias("w"))
    return whole.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def _solved(links: DataFrame, modes: int) -> DataFrame:
    """Slowest modes of a graph of at most some ``COARSE`` nodes: ``id, d, x0, x1, ...``."""
    graph = Graph.of(*(c.to_numpy() for c in links.select("src", "dst", "w").toArrow().columns))
    x = dense_modes(graph, modes)
    columns = {"id": graph.ids, "d": graph.d} | {f"x{i}": x[:, i] for i in range(x.shape[1])}
    return links.sparkSession.createDataFrame(pa.table(columns))


def _whole(links: DataFrame, modes: int, wanted: int) -> DataFrame:
    """The same of a graph that one task holds, by the same levels."""
    coarse, steps, turns, settled = COARSE, STEPS, TURNS, SETTLED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not held:
            return
        graph = Graph.of(*(np.concatenate(c) for c in zip(*held)))
        del held
        levels = []
        while len(graph.ids) > coarse:
            small, groups = graph.smaller()
            levels.append((graph, groups))
            graph = small
        x = dense_modes(graph, modes)
        while levels:
            graph, groups = levels.pop()
            x = refined(graph, x[groups], wanted, steps, turns, settled)
        x = np.pad(x, ((0, 0), (0, modes - x.shape[1])))
        for i in range(0, len(x), WHOLE_ROWS):
            rows = slice(i, i + WHOLE_ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(graph.ids[rows]), pa.array(graph.d[rows]), *(pa.array(c) for c in x[rows].T)],
                                             names=["id", "d", *(f"x{i}" for i in range(modes))])

    schema = "id long, d double, " + ", ".join(f"x{i} double" for i in range(modes))
    return links.select("src", "dst", "w").repartition(1).mapInArrow(run, schema).repartition("id")


def _step(links: DataFrame, held: DataFrame, names: Sequence[str]) -> DataFrame:
    """One step of the walk: every node takes the mean of its neighbours."""
    met = links.join(held.select(F.col("id").alias("dst"), *names), "dst")
    sums = met.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"), *[F.sum(F.col("w") * F.col(n)).alias(n) for n in names])
    return sums.select("id", "d", *[(F.col(n) / F.col("d")).alias(n) for n in names])


def _turned(before: DataFrame, after: DataFrame, names: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
    """Best modes in the span of ``before``, whose step is ``after``, and their decays."""
    both = before.join(after.select("id", *[F.col(n).alias(f"p{n}") for n in names]), "id")
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    row = both.agg(*[F.sum(F.col("d") * F.col(a) * F.col(b)) for a, b in pairs],
                   *[F.sum(F.col("d") * (F.col(a) * F.col(f"p{b}") + F.col(b) * F.col(f"p{a}")) / 2) for a, b in pairs]).first()
    place = {n: i for i, n in enumerate(names)}
    gram, walk = np.zeros((len(names), len(names))), np.zeros((len(names), len(names)))
    for (a, b), g, h in zip(pairs, row[: len(pairs)], row[len(pairs) :]):
        gram[place[a], place[b]] = gram[place[b], place[a]] = g
        walk[place[a], place[b]] = walk[place[b], place[a]] = h
    turn, decays = turned(gram, walk)
    mixed = [sum((F.col(a) * float(turn[i, j]) for i, a in enumerate(names)), F.lit(0.0)).alias(f"x{j}") for j in range(turn.shape[1])]
    return before.select("id", "d", *mixed), decays


def _refined(links: DataFrame, held: DataFrame, modes: int, wanted: int) -> DataFrame:
    """Modes of a level, from the merged nodes' ones."""
    decays = np.full(modes, np.inf)
    for _ in range(TURNS):
        names = [c for c in held.columns if c.startswith("x")]
        for _ in range(STEPS):
            held = _step(links, held, names)
        held = materialize(held)
        held, now = _turned(held, _step(links, held, names), names)
        held = materialize(held)
        change = np.abs(now[:wanted] - decays[:wanted])
        if (change <= SETTLED * np.abs(now[:wanted]) + 1e-9).all():
            break
        decays = now
    return held


def slowest_modes(links: DataFrame, wanted: int) -> DataFrame:
    """``id, x`` with the first ``wanted`` right eigenvectors of the walk on a graph of links in both directions."""
    modes = wanted + SPARE
    levels = []
    while True:
        nodes, count = links.agg(F.countDistinct("src"), F.count(F.lit(1))).first()
        whole = nodes > COARSE and LINK_BYTES * count + MODE_BYTES * modes * nodes <= WHOLE_BYTES
        if whole or nodes <= COARSE:
            break
        groups = materialize(_smaller(links))
        levels.append((links, groups))
        links = materialize(_merged(links, groups))
    held = materialize(_whole(links, modes, wanted)) if whole else _solved(links, modes)
    for level, groups in reversed(levels):
        # A merged node's value goes to all its members; hot ones have many.
        sizes = groups.groupBy("to").agg(F.count(F.lit(1)).alias("n"))
        names = [c for c in held.columns if c.startswith("x")]
        coarse = materialize(held.withColumnRenamed("id", "to").join(sizes, "to"))
        spread = join_unique(groups, coarse, ["to"], "n").select("id", "d", *names)
        held = _refined(level, spread, modes, wanted)
    names = [f"x{i}" for i in range(wanted) if f"x{i}" in held.columns]
    return held.select("id", F.array(*names).alias("x"))


# --- their clusters ---------------------------------------------------------------


def _drawn(x: np.ndarray, k: int, starts: int, seed: int) -> np.ndarray:
    """Centres of every start, each drawn by its squared distance from those before it."""
    rng = np.random.default_rng(seed)
    out = np.empty((starts, k, x.shape[1]))
    for s in range(starts):
        far = None
        for c in range(k):
            weight = np.ones(len(x)) if far is None or far.sum() == 0 else far
            out[s, c] = x[rng.choice(len(x), p=weight / weight.sum())]
            d2 = ((x - out[s, c]) ** 2).sum(axis=1)
            far = d2 if far is None else np.minimum(far, d2)
    return out


def clustered_rows(rows: DataFrame, k: int, starts: int = STARTS, seed: int = SEED) -> DataFrame:
    """``id, label`` of the best of many k-means over ``id, x``; a pass adds up the sums of all starts."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(START_ROWS).toPandas()
    centres = _drawn(stack(sample["x"]), k, starts, seed)
    width = centres.shape[2]
    for _ in range(PASSES):
        sent = spark.sparkContext.broadcast(centres)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            centres = sent.value
            sums, counts, costs = np.zeros_like(centres), np.zeros(centres.shape[:2]), np.zeros(centres.shape[:2])
            for batch in batches:
                x = stack(batch.column("x").to_pandas()) if batch.num_rows else np.zeros((0, centres.shape[2]))
                for s in range(len(centres)) if len(x) else ():
                    d2 = ((x[:, None] - centres[s]) ** 2).sum(axis=2)
                    own = d2.argmin(axis=1)
                    counts[s] += np.bincount(own, minlength=counts.shape[1])
                    costs[s] += np.bincount(own, d2[np.arange(len(x)), own], counts.shape[1])
                    np.add.at(sums[s], own, x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(centres)), centres.shape[1])), pa.array(np.tile(np.arange(centres.shape[1]), len(centres))),
                 pa.array(counts.ravel()), pa.array(costs.ravel()), *(pa.array(sums[:, :, i].ravel()) for i in range(centres.shape[2]))],
                names=["s", "c", "n", "cost", *(f"x{i}" for i in range(centres.shape[2]))],
            )

        names = [f"x{i}" for i in range(width)]
        parts = rows.mapInArrow(run, "s long, c long, n double, cost double, " + ", ".join(f"{n} double" for n in names))
        found = parts.groupBy("s", "c").agg(*[F.sum(n).alias(n) for n in ("n", "cost", *names)]).toPandas().sort_values(["s", "c"])
        n = found["n"].to_numpy().reshape(starts, k)
        costs = found["cost"].to_numpy().reshape(starts, k).sum(axis=1)
        new = found[names].to_numpy().reshape(starts, k, width) / np.maximum(n, 1)[:, :, None]
        new = np.where(n[:, :, None] > 0, new, centres)  # an empty centre stays
        best, moved = int(costs.argmin()), np.abs(new - centres).max()
        if moved <= 1e-9 * np.abs(centres).max():
            break
        centres = new
    sent = spark.sparkContext.broadcast(centres[best])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = stack(batch.column("x").to_pandas()) if batch.num_rows else np.zeros((0, width))
            own = ((x[:, None] - sent.value) ** 2).sum(axis=2).argmin(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.astype(np.int32))], names=["id", "label"])

    return rows.mapInArrow(place, "id long, label int")


def spectral_labels(df: DataFrame, k: int, neighbours: int = 4) -> DataFrame:
    """``rec_id, label`` of ``(rec_id, features)``; labels from 0 on, in the order of their smallest ``rec_id``."""
    modes = materialize(slowest_modes(joined_graph(df, neighbours), k))
    placed = materialize(clustered_rows(modes, k))
    order = Window.orderBy("first")  # at most k rows
    names = placed.groupBy("label").agg(F.min("id").alias("first")).select("label", (F.row_number().over(order) - 1).alias("new"))
    return placed.join(F.broadcast(names), "label").select(F.col("id").alias("rec_id"), F.col("new").alias("label"))
