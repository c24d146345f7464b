"""Shortest links out of the parts of a table, exact, without comparing rows that are proven too far apart.

A row's place is given along the main directions of a sample, with its distance from the plane of
these: rows are never nearer than their places.  A part's distance to those of the sample that are in other parts is how far its
shortest link reaches at most.  Rows that are farther than that from the places of all cells of rows that ask, or
of rows that may answer, are left out before features are shuffled; the others meet in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.operators.blocks import MEET_ROWS, PACKED, STRIP, Block, Short, direct, meet, pack_rows, places, squared, stack
from flighttone.operators.neighbours import CELLS, SAMPLE_BYTES, SAMPLE_ROWS, SLACK, TILE_BYTES, TILE_ROWS, block_pairs, heads, matrix
from flighttone.scale import join_unique, materialize

#: Main directions of the sample, and times that rows are sifted by their places.
SIDES, SIFTS = 12, 3
#: Rows of the sample that directions are taken from.
DIRECTION_ROWS = 1024
#: Digits by which distances are told apart; equal ones go by their ids.
DIGITS = 9
#: Pairs of a strip for each row, above which a bound is taken from the strip first.
LOOSE = 16


class Frame(NamedTuple):
    """A sample of rows, their parts, and what places are taken from: centre, directions, centres of cells and the cell's group of each."""

    x: np.ndarray
    roots: np.ndarray
    centre: np.ndarray
    sides: np.ndarray
    groups: np.ndarray

    def places(self, x: np.ndarray) -> np.ndarray:
        moved = x - self.centre
        along = moved @ self.sides.T
        off = np.einsum("ij,ij->i", moved, moved) - np.einsum("ij,ij->i", along, along)
        return np.column_stack([along, np.sqrt(np.maximum(off, 0))])

    def cells(self, x: np.ndarray) -> np.ndarray:
        centres = self.x[: len(self.groups)]
        far = ((centres - self.centre) ** 2).sum(axis=1) - 2 * (x - self.centre) @ (centres - self.centre).T
        return far.argmin(axis=1)

    def reach(self, x: np.ndarray, roots: np.ndarray) -> np.ndarray:
        """How far the nearest row of the sample in another part is at most."""
        least = np.full(len(x), np.inf)
        for j in range(0, len(self.x), MEET_ROWS):
            short = Short(x, self.x[j : j + MEET_ROWS], self.centre)
            for i in range(0, len(x), STRIP):
                d2 = short.strip(i)
                d2[roots[i : i + STRIP, None] == self.roots[j : j + MEET_ROWS]] = np.inf
                least[i : i + STRIP] = np.minimum(least[i : i + STRIP], np.maximum(d2.min(axis=1), 0) + 2.0 * short.slack)
        return np.sqrt(least)


def _frame(rows: DataFrame, width: int, groups: int) -> Frame:
    most = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * width)))
    found = rows.orderBy(F.xxhash64("id"), "id").limit(most).select("root", "features").toPandas()
    x = stack(found["features"])
    centre = x.mean(axis=0)
    centres = x[:CELLS]
    near = squared(centres, centres[: max(1, min(groups, len(centres)))]).argmin(axis=1)
    return Frame(x, found["root"].to_numpy(), centre, _directions((x - centre)[:DIRECTION_ROWS]), near)


def _directions(x: np.ndarray) -> np.ndarray:
    """At most ``SIDES`` main directions, at right angles, from the smaller of both products."""
    if x.shape[1] <= len(x):
        return np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :SIDES].T)
    values, vectors = np.linalg.eigh(x @ x.T)
    along = x.T @ vectors[:, ::-1][:, : min(SIDES, int((values > 1e-9 * values[-1]).sum()))]
    return np.ascontiguousarray(np.linalg.qr(along)[0].T)


def _gap(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least distance of rows at ``places`` from rows between ``low`` and ``high``, by a little less."""
    out = np.maximum(np.maximum(low - places, places - high), 0)
    size = max(float(np.abs(places).max(initial=0)), float(np.abs(low).max(initial=0)), float(np.abs(high).max(initial=0)))
    return np.sqrt(np.einsum("ij,ij->i", out, out)) * (1 - SLACK) - SLACK * size


def _boxes(narrow: DataFrame, sides: int) -> list:
    """For each cell the ranges of places, and the parts if there is only one, of the rows that ask and of those that may answer; at most CELLS rows."""
    ranges = []
    for kind, chosen in (("ask", F.col("reach") >= 0), ("answer", F.col("answers"))):
        mine = lambda c, chosen=chosen: F.when(chosen, F.col(c))
        ranges += [F.array(*[F.min(mine(f"c{i}")) for i in range(sides)]).alias(f"{kind}_low"), F.array(*[F.max(mine(f"c{i}")) for i in range(sides)]).alias(f"{kind}_high"),
                   F.min(mine("root")).alias(f"{kind}_first"), F.max(mine("root")).alias(f"{kind}_last")]
    return narrow.groupBy("cell").agg(*ranges, F.max("reach").alias("most")).collect()


def _sifted(narrow: DataFrame, sides: int) -> DataFrame:
    """Rows that ask within reach of some that may answer, and rows that may answer within reach of some that ask."""
    sent = narrow.sparkSession.sparkContext.broadcast(_boxes(narrow, sides))
    names = [f"c{i}" for i in range(sides)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = np.column_stack([batch.column(n).to_numpy() for n in names])
            roots, reach = batch.column("root").to_numpy(), batch.column("reach").to_numpy().copy()
            answers = batch.column("answers").to_numpy(zero_copy_only=False)
            asks, asked = np.zeros(len(roots), bool), np.zeros(len(roots), bool)
            for box in sent.value:
                if box["answer_first"] is not None:
                    alone = box["answer_first"] == box["answer_last"]
                    at = np.flatnonzero((reach >= 0) & ~asks & ~(alone & (roots == box["answer_first"])))
                    asks[at] = _gap(spots[at], np.array(box["answer_low"]), np.array(box["answer_high"])) <= reach[at]
                if box["ask_first"] is not None:
                    alone = box["ask_first"] == box["ask_last"]
                    at = np.flatnonzero(answers & ~asked & ~(alone & (roots == box["ask_first"])))
                    asked[at] = _gap(spots[at], np.array(box["ask_low"]), np.array(box["ask_high"])) <= box["most"]
            reach[~asks] = -1
            keep = pa.array(asks | asked)
            columns = {n: batch.column(n) for n in batch.schema.names} | {"reach": pa.array(reach), "answers": pa.array(asked)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns)).filter(keep)

    return materialize(narrow.mapInArrow(run, narrow.schema))


class _Best:
    """The shortest link met so far of each part in ``names``, by distance, then the smaller and the larger id; ``most`` is what it has squared at most."""

    def __init__(self, names: np.ndarray, most: np.ndarray):
        self.names, self.most = names, most
        self.links = tuple(np.zeros(0, kind) for kind in (np.int64, np.float64, np.int64, np.int64))

    def add(self, part: np.ndarray, distance: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
        part, distance, src, dst = (np.concatenate(p) for p in zip(self.links, (part, distance, src, dst)))
        order = np.lexsort((dst, np.maximum(src, dst), np.minimum(src, dst), np.round(distance, DIGITS), part))
        order = order[np.unique(part[order], return_index=True)[1]]
        self.links = part[order], distance[order], src[order], dst[order]
        self.most[part[order]] = np.minimum(self.most[part[order]], (distance[order] + 10.0**-DIGITS) ** 2)


def _met(packs: DataFrame, pairs: DataFrame, width: int, frame) -> DataFrame:
    """``root, src, dst, distance`` of the shortest links that blocks find, one for each part of a block."""

    def run(mine: Block, theirs: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        reach = mine.facts["reach"]
        asks = reach >= 0
        x, ids, own, reach = mine.x[asks], mine.ids[asks], mine.facts["roots"].view(np.int64)[asks], reach[asks]
        names, first, part = np.unique(own, return_index=True, return_inverse=True)
        best = _Best(names, (reach[first] * (1 + SLACK)) ** 2)
        here_at = frame.value.places(x)
        for block in theirs:
            answers = block.facts["answers"] > 0
            y, those, other = block.x[answers], block.ids[answers], block.facts["roots"].view(np.int64)[answers]
            if not len(y) or not len(x):
                continue
            there = frame.value.places(y)
            rows = np.flatnonzero(_gap(here_at, there.min(axis=0), there.max(axis=0)) <= np.sqrt(best.most[part]))
            if not len(rows):
                continue
            shared = np.isin(names, other).any()
            cols = np.flatnonzero(_gap(there, here_at[rows].min(axis=0), here_at[rows].max(axis=0)) <= np.sqrt(best.most[part[rows]].max()))
            for j in range(0, len(cols), MEET_ROWS):
                at = cols[j : j + MEET_ROWS]
                short = Short(x[rows], y[at], frame.value.centre)
                for i in range(0, len(rows), STRIP):
                    here = rows[i : i + STRIP]
                    d2 = short.strip(i)
                    near = d2 <= (best.most[part[here]] * (1 + SLACK) + short.slack).astype(d2.dtype)[:, None]
                    if shared:
                        near &= own[here, None] != other[at]
                    if np.count_nonzero(near) > LOOSE * len(here):
                        d2[~near] = np.inf
                        least = np.maximum(d2.min(axis=1).astype(float), 0) + 2.0 * short.slack
                        np.minimum.at(best.most, part[here], (np.sqrt(least) + 10.0**-DIGITS) ** 2)
                        near = np.isfinite(d2) & (d2 <= (best.most[part[here]] * (1 + SLACK) + short.slack).astype(d2.dtype)[:, None])
                    u, v = places(near)
                    if len(u):
                        best.add(part[here[u]], np.sqrt(direct(x, y, here[u], at[v])), ids[here[u]], those[at[v]])
        found, distance, src, dst = best.links
        yield pa.RecordBatch.from_arrays([pa.array(names[found]), pa.array(src), pa.array(dst), pa.array(distance)], names=["root", "src", "dst", "distance"])

    return meet(packs, pairs, width, run, "root long, src long, dst long, distance double", mine=("reach", "roots", "answers"), theirs=("roots", "answers"))


def shortest_out(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """The shortest link out of each part that ``asks``: ``root, src, dst, distance``; rows are ``id, root, asks, features``."""
    spark = rows.sparkSession
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    busy = 2 * spark.sparkContext.defaultParallelism
    size = block_rows or min(TILE_ROWS, max(256, TILE_BYTES // (8 * width)), max(4096, math.ceil(n / busy)))
    frame = _frame(rows, width, math.ceil(n / size))
    sent = spark.sparkContext.broadcast(frame)  # bounded by SAMPLE_BYTES
    sides = len(frame.sides) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, roots = matrix(pa.chunked_array([batch.column("features")])), batch.column("root").to_numpy()
            cell, far, asks = sent.value.cells(x), np.full(len(x), -1.0), batch.column("asks").to_numpy(zero_copy_only=False)
            if asks.any():
                far[asks] = sent.value.reach(x[asks], roots[asks])
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("root"), pa.array(far), pa.array(cell), pa.array(sent.value.groups[cell]),
                 *(pa.array(c) for c in sent.value.places(x).T)], names=["id", "root", "far", "cell", "grp", *(f"c{i}" for i in range(sides))])

    schema = "id long, root long, far double, cell long, grp long, " + ", ".join(f"c{i} double" for i in range(sides))
    narrow = materialize(rows.select("id", "root", "asks", "features").mapInArrow(run, schema))
    reach = materialize(narrow.groupBy("root").agg(F.min("far").alias("reach"), F.count(F.lit(1)).alias("n")))
    narrow = materialize(join_unique(narrow.drop("far"), reach, ["root"], "n").select(*[c for c in narrow.columns if c != "far"], "reach", F.lit(True).alias("answers")))
    for _ in range(SIFTS):
        narrow = _sifted(narrow, sides)
    # A block is within one group of cells; there are at most CELLS of these.
    groups = narrow.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / size).cast("long").alias("blocks")).orderBy("grp").collect()
    if not groups:
        return spark.createDataFrame([], "root long, src long, dst long, distance double")
    before = np.cumsum([0, *(g["blocks"] for g in groups)])
    dealt = F.broadcast(spark.createDataFrame([(g["grp"], int(b), g["blocks"]) for g, b in zip(groups, before)], "grp long, first long, blocks long"))
    block = F.col("first") + F.pmod(F.xxhash64("id"), "blocks")
    # Rows of one id are kept or left out together.
    held = narrow.join(dealt, "grp").groupBy("id").agg(F.min("root").alias("root"), F.max("reach").alias("reach"), F.max("answers").alias("answers"), F.min(block).alias("block"))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        x, reach, answers, roots = matrix(table["features"]), table["reach"].to_numpy(), table["answers"].to_numpy().astype(float), table["root"].to_numpy()
        out = pack_rows(table["block"][0].as_py(), table["id"].to_numpy(), x, roots=roots, reach=reach, answers=answers)
        at, rest = sent.value.places(x), [None] * (len(out["block"]) - 1)
        out |= {"low": [at.min(axis=0), *rest], "high": [at.max(axis=0), *rest], "most": [reach.max()] * len(out["block"]),
                "alone": [roots[0] if (roots == roots[0]).all() else None] * len(out["block"])}
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})

    types = (pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 5, *[pa.list_(pa.float64())] * 2, pa.float64(), pa.int64())
    features = rows.select("id", "features").join(held, "id")
    schema = f"{PACKED}, roots binary, reach binary, answers binary, low array<double>, high array<double>, most double, alone long"
    packs = materialize(features.groupBy("block").applyInArrow(pack, schema))
    # A little more than the reach, as for rows.
    scale = F.greatest(*[F.array_max(F.transform(c, F.abs)) for c in ("low", "high")])
    first = heads(packs.withColumn("most", F.when(F.col("most") >= 0, F.col("most") * (1 + 2 * SLACK) + 2 * SLACK * scale).otherwise(-float("inf"))))
    every = block_pairs(first).unionByName(first.filter("most >= 0").select(F.col("block").alias("a"), F.col("block").alias("b")))
    alone = packs.filter("low is not null").select("block", "alone")
    pairs = every.join(alone.toDF("a", "_a"), "a").join(alone.toDF("b", "_b"), "b").filter("_a is null or _b is null or _a <> _b").select("a", "b")
    found = _met(packs, materialize(pairs), width, sent)
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    best = found.groupBy("root").agg(F.min(F.struct(F.round("distance", DIGITS).alias("d"), low.alias("a"), high.alias("b"), "src", "dst", "distance")).alias("best"))
    return best.select("root", "best.src", "best.dst", "best.distance")
