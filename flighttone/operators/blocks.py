"""Distances between rows of two blocks, and rows of blocks packed for a meeting with many others."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.scale import small_side

#: Bytes of features in one block.
BLOCK_BYTES = 8 << 20
#: Rows of a block compared at once inside a task.
STRIP = 1024
#: Bytes of features in one packed row, and rows of another block compared at once.
PACK_BYTES, MEET_ROWS = 8 << 10, 4096
#: Values up to this size are compared in single precision first.
SINGLE = 1e15
#: Pairs computed directly at once.
DIRECT = 1 << 15


def stack(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()) if len(values) else np.empty((0, 0))


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances; the common offset is taken off first to keep digits."""
    centre = x.mean(axis=0)
    x, y = x - centre, y - centre
    d2 = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * x @ y.T
    return np.maximum(d2, 0, out=d2)


# --- pairs that single precision leaves open -------------------------------------------


def direct(x: np.ndarray, y: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Squared distances of the pairs, the same in both directions."""
    out = np.empty(len(rows))
    for i in range(0, len(rows), DIRECT):
        apart = x[rows[i : i + DIRECT]] - y[cols[i : i + DIRECT]]
        out[i : i + DIRECT] = np.einsum("ij,ij->i", apart, apart)
    return out


def places(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs that are true; much faster than ``nonzero`` of a matrix where few are."""
    return np.divmod(np.flatnonzero(near), near.shape[1])


class Short:
    """Squared distances by one product in single precision, off by ``slack`` at most."""

    def __init__(self, x: np.ndarray, y: np.ndarray, centre: np.ndarray):
        x, y = x - centre, y - centre
        size = max(float(np.abs(x).max(initial=0)), float(np.abs(y).max(initial=0)))
        kind = np.float32 if size < SINGLE else np.float64
        xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        far = (np.sqrt(xx.max(initial=0)) + np.sqrt(yy.max(initial=0))) ** 2
        # Rounding of both sides, of products and of their sums.
        self.slack = 2 * (x.shape[1] + 16) * float(np.finfo(kind).eps) * far + 1e-30
        self._x = np.column_stack([-2 * x, xx, np.ones(len(x))]).astype(kind)
        self._y = np.ascontiguousarray(np.column_stack([y, np.ones(len(y)), yy]).astype(kind).T)

    def strip(self, i: int) -> np.ndarray:
        return self._x[i : i + STRIP] @ self._y


# --- blocks that meet many others ------------------------------------------------------


class Block(NamedTuple):
    """Rows of a block; ``facts`` are those of its first packed row."""

    block: int
    ids: np.ndarray
    x: np.ndarray
    facts: dict


def pack_rows(block: int, ids: np.ndarray, x: np.ndarray, **columns: np.ndarray) -> dict[str, list]:
    """Columns of packed rows: some rows' values as bytes; features in single precision where that is exact."""
    step = max(1, PACK_BYTES // (8 * x.shape[1]))
    cuts = range(0, len(x), step)
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    whole = (single == x).all()
    held = single if whole else x
    out = {"block": [block] * len(cuts), "part": list(range(len(cuts))), "single": [bool(whole)] * len(cuts)}
    for name, values in {"ids": ids, "x": held, **columns}.items():
        out[name] = [np.ascontiguousarray(values[i : i + step]).tobytes() for i in cuts]
    return out


PACKED = "block long, part int, single boolean, ids binary, x binary"


def _unpacked(rows: list[dict], width: int) -> Block:
    first = rows[0]
    x = np.frombuffer(b"".join(r["x"] for r in rows), np.float32 if first["single"] else np.float64)
    ids = np.frombuffer(b"".join(r["ids"] for r in rows), np.int64)
    facts = {k: v for k, v in first.items() if k not in ("ids", "x")}
    for name, value in first.items():
        if name not in ("ids", "x") and isinstance(value, bytes):
            facts[name] = np.frombuffer(b"".join(r[name] for r in rows))
    return Block(first["block"], ids, x.reshape(-1, width).astype(np.float64), facts)


def meet(packs: DataFrame, pairs: DataFrame, width: int, run: Callable[[Block, Iterator[Block]], Iterator[pa.RecordBatch]],
         schema: str, mine: tuple[str, ...] = (), theirs: tuple[str, ...] = ()) -> DataFrame:
    """``run`` for each block ``a`` of ``pairs``, with an iterator over its blocks ``b`` in order; one of these is held at a time.

    A block goes as often through the shuffle as there are blocks it meets, in packed rows.  Columns ``mine`` are those that only
    the block itself needs, ``theirs`` those that it needs of the others.
    """
    held = ["block", "part", "single", "ids", "x"]
    own = packs.select(F.col("block").alias("tile"), F.lit(0).alias("side"), *held, *mine, *[F.lit(None).cast(packs.schema[c].dataType).alias(c) for c in theirs if c not in mine])
    near = small_side(pairs.select(F.col("a").alias("tile"), F.col("b").alias("block")))
    others = packs.join(near, "block").select(
        "tile", F.lit(1).alias("side"), *held, *[(F.col(c) if c in theirs else F.lit(None).cast(packs.schema[c].dataType)).alias(c) for c in mine],
        *[c for c in theirs if c not in mine])
    tiles = packs.agg(F.max("block")).first()[0] + 1
    most = max(200, 4 * packs.sparkSession.sparkContext.defaultParallelism)
    dealt = own.unionByName(others).repartitionById(min(tiles, most), F.col("tile").cast("int")).sortWithinPartitions("tile", "side", "block", "part")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in itertools.groupby(rows(batches), lambda r: r["tile"]):
            blocks = (_unpacked(list(g), width) for _, g in itertools.groupby(group, lambda r: (r["side"], r["block"])))
            yield from run(next(blocks), blocks)

    return dealt.mapInArrow(each, schema)
