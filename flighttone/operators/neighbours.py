"""Nearest neighbours, exact, without looking at blocks that are proven too far away.

Rows are dealt to cells around randomly chosen rows and stored in the order of cell and
distance to its centre, in blocks of bounded size.  Of every row the distances to a few pivots
are kept.  By the triangle inequality two rows are at least as far apart as their
distances to any pivot differ, so the ranges of these distances in two blocks bound all distances between them.  Each
block first finds the neighbours of its rows among themselves; the distance of the last of
them is how far a row has to look at most, and blocks beyond that are never met.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flighttone.operators.blocks import MEET_ROWS, PACKED, STRIP, Block, Short, direct, meet, pack_rows, places, stack
from flighttone.scale import materialize, with_position

#: Pivots, cells, and rows and bytes of the sample they are taken from, at most.
PIVOTS, CELLS = 32, 256
SAMPLE_ROWS, SAMPLE_BYTES = 4096, 32 << 20
#: Rows of a block at most, and bytes of its features and neighbours.
TILE_ROWS, TILE_BYTES = 65536, 128 << 20
#: Pairs of a strip for each neighbour asked for, above which a bound is taken from the strip first.
LOOSE = 8
#: Rows of the table of blocks compared at once.
CHUNK = 2048
#: Distances are trusted up to this share of the largest one.
SLACK = 1e-6


def _sample(df: DataFrame, width: int) -> np.ndarray:
    """Features of the rows with the smallest hashes of their ids."""
    rows = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * width)))
    found = df.orderBy(F.xxhash64("rec_id"), "rec_id").limit(rows).select("features").toPandas()
    return stack(found["features"])


def _apart(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample, each the farthest from those before it."""
    far = ((sample - sample.mean(axis=0)) ** 2).sum(axis=1)
    chosen = []
    for _ in range(min(count, len(sample))):
        at = int(far.argmax())
        if chosen and far[at] == 0:
            break
        chosen.append(at)
        d2 = ((sample - sample[at]) ** 2).sum(axis=1)
        far = d2 if len(chosen) == 1 else np.minimum(far, d2)
    return sample[chosen]


def _sizes(df: DataFrame, k: int, block_rows: int | None) -> tuple[int, int, int]:
    """Rows, features of a row, and rows of a block."""
    n, width = df.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    width = max(width or 1, 1)
    most = min(TILE_ROWS, max(256, TILE_BYTES // (8 * width + 48 * k)))
    busy = 2 * df.sparkSession.sparkContext.defaultParallelism
    return n, width, block_rows or max(4 * k, 256, min(most, math.ceil(n / busy)))


def place_rows(df: DataFrame, width: int, n: int, block_rows: int, cells: int, k: int | None = None, extra: Sequence[str] = ()) -> DataFrame:
    """``rec_id, features, pivots, bound, block`` and the ``extra`` columns, written once.

    The centres of the cells are rows as well, so the ``k``-th neighbour is no farther than ``bound``, that of the centres.
    """
    sample = _sample(df, width)
    pivots, centres = _apart(sample, PIVOTS), sample[: min(CELLS, max(1, cells))]
    sent = df.sparkSession.sparkContext.broadcast((pivots, centres))  # bounded by SAMPLE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = stack(batch.column("features").to_pandas())
            to_pivots = np.sqrt([((x - p) ** 2).sum(axis=1) for p in pivots]).T
            to_cells = np.stack([((x - c) ** 2).sum(axis=1) for c in cells], axis=1)
            cell = to_cells.argmin(axis=1)
            bound = np.full(len(x), np.inf)
            if k is not None and len(cells) > k:
                # A centre is the nearest to itself, hence one place more.
                bound = np.sqrt(np.partition(to_cells, k, axis=1)[:, k])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(list(to_pivots), pa.list_(pa.float64())),
                 pa.array(bound), pa.array(cell.astype(np.int64)), pa.array(to_cells[np.arange(len(x)), cell])],
                names=[*batch.schema.names, "pivots", "bound", "cell", "far"],
            )

    narrow = df.select(F.col("rec_id").cast("long"), F.col("features").cast("array<double>"), *[F.col(c).cast("long") for c in extra])
    schema = "rec_id long, features array<double>, " + "".join(f"{c} long, " for c in extra) + "pivots array<double>, bound double, cell long, far double"
    placed = with_position(narrow.mapInArrow(run, schema), ["cell", "far", "rec_id"], "_at")
    # A block is within one cell; there are at most CELLS of these.
    starts = placed.groupBy("cell").agg(F.min("_at").alias("_start"), F.ceil(F.count(F.lit(1)) / block_rows).alias("_blocks"))
    before = F.sum("_blocks").over(Window.orderBy("cell")) - F.col("_blocks")
    starts = starts.select("cell", "_start", before.alias("_before"))
    block = F.col("_before") + F.floor((F.col("_at") - F.col("_start")) / block_rows)
    return placed.join(F.broadcast(starts), "cell").select("rec_id", "features", *extra, "pivots", "bound", block.alias("block"), "_at")


class _Nearest:
    """The ``k`` nearest rows met so far by each row of ``x``, by distance, then id; memory in proportion to ``k * len(x)``."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, k: int, reach: np.ndarray):
        self.x, self.ids, self.k = x, ids, k
        self.centre = x.mean(axis=0)
        #: Squared distances that a neighbour has at most, a little more than ``reach``, and the id of the last one held.
        self.most, self.last = reach * reach * (1 + 1e-12), np.full(len(x), np.iinfo(np.int64).max)
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._held = 0

    def feed(self, y: np.ndarray, others: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Compare the ``rows`` (all without) with ``y``."""
        rows = np.arange(len(self.x)) if rows is None else rows
        x, ids = (self.x, self.ids) if len(rows) == len(self.x) else (self.x[rows], self.ids[rows])
        for j in range(0, len(y), MEET_ROWS) if len(rows) else ():
            part, those = y[j : j + MEET_ROWS], others[j : j + MEET_ROWS]
            short = Short(x, part, self.centre)
            for i in range(0, len(x), STRIP):
                d2, at = short.strip(i), rows[i : i + STRIP]
                if np.isin(ids[i : i + STRIP], those).any():
                    d2[ids[i : i + STRIP, None] == those] = np.inf
                near = self._within(d2, at, short.slack)
                if len(those) >= self.k and np.count_nonzero(near) > LOOSE * self.k * len(at):
                    self.most[at] = np.minimum(self.most[at], np.partition(d2, self.k - 1, axis=1)[:, self.k - 1] + 2.0 * short.slack)
                    near = self._within(d2, at, short.slack)
                found, cols = places(near)
                exact, to, mine = direct(x, part, found + i, cols), those[cols], at[found]
                keep = (exact < self.most[mine]) | ((exact == self.most[mine]) & (to <= self.last[mine]))
                self._parts.append((mine[keep], to[keep], exact[keep]))
                self._held += int(keep.sum())
                if self._held > 2 * self.k * len(self.x) + MEET_ROWS:
                    self._trim()

    def _within(self, d2: np.ndarray, at: np.ndarray, slack: float) -> np.ndarray:
        # A finite limit, as distances of a row to itself are infinite.
        limit = np.minimum((self.most[at] + slack).astype(d2.dtype) * (1 + 1e-6), np.finfo(d2.dtype).max)
        return d2 <= limit[:, None]

    def _trim(self) -> None:
        rows, others, d2 = (np.concatenate(p) for p in zip(*self._parts)) if self._parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((others, d2, rows))
        rows, others, d2 = rows[order], others[order], d2[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < self.k
        end = place == self.k - 1
        self.most[rows[end]], self.last[rows[end]] = d2[end], others[end]
        self._parts, self._held = [(rows[keep], others[keep], d2[keep])], int(keep.sum())

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each row's neighbours start (and the last one's end), their ids and distances."""
        self._trim()
        rows, others, d2 = self._parts[0]
        return np.searchsorted(rows, np.arange(len(self.x) + 1)), others, np.sqrt(d2)


def _within_blocks(placed: DataFrame, k: int) -> DataFrame:
    """Packed rows with ``reach``, how far neighbours are at most by some in the block; its first one has the ranges of its pivot distances."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("_at", "ascending")])
        x, ids, pivots = matrix(table["features"]), table["rec_id"].to_numpy(), matrix(table["pivots"])
        reach = table["bound"].to_numpy().copy()
        # Some rows next to each other are enough for a bound; the block meets itself again later.
        step = max(MEET_ROWS, 4 * k)
        for i in range(0, len(x), step):
            part = reach[i : i + step]
            found = _Nearest(x[i : i + step], ids[i : i + step], k, part)
            found.feed(x[i : i + step], ids[i : i + step])
            first, _, distances = found.lists()
            full = np.diff(first) == k
            part[full] = np.minimum(part[full], distances[first[1:][full] - 1])
        out = pack_rows(table["block"][0].as_py(), ids, x, pivots=pivots, reach=reach)
        head = [None] * (len(out["block"]) - 1)
        out |= {"low": [pivots.min(axis=0), *head], "high": [pivots.max(axis=0), *head], "most": [reach.max()] * len(out["block"])}
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), PACK_TYPES)})

    return placed.groupBy("block").applyInArrow(run, f"{PACKED}, pivots binary, reach binary, low array<double>, high array<double>, most double")


PACK_TYPES = (pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2, pa.float64())


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def gap(low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
    """Least distance that ranges of pivot distances leave between each row of the first and each of the second."""
    out = np.zeros((len(low), len(other_low)))
    for p in range(low.shape[1]):
        np.maximum(out, other_low[None, :, p] - high[:, p, None], out=out)
        np.maximum(out, low[:, p, None] - other_high[None, :, p], out=out)
    return out


def slack(high: np.ndarray) -> float:
    return SLACK * float(high.max(initial=0))


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Of ``block, low, high, most`` the blocks ``a`` and others ``b`` that may have rows within ``most`` of a's."""
    chunks = F.sequence(F.lit(0).cast("long"), F.floor(blocks.agg(F.max("block")).scalar() / CHUNK))
    own = F.floor(F.col("block") / CHUNK)
    left = blocks.withColumns({"ca": own, "cb": F.explode(chunks)})
    right = blocks.select(*[F.col(c).alias(c) for c in blocks.columns], own.alias("cb"), F.explode(chunks).alias("ca"))

    def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        low, high, there = stack(mine["low"]), stack(mine["high"]), stack(theirs["high"])
        apart = gap(low, high, stack(theirs["low"]), there)
        near = apart <= mine["most"].to_numpy()[:, None] + max(slack(high), slack(there))
        a, b = mine["block"].to_numpy(), theirs["block"].to_numpy()
        i, j = np.nonzero(near & (a[:, None] != b))
        return pd.DataFrame({"a": a[i], "b": b[j]})

    return left.groupBy("ca", "cb").cogroup(right.groupBy("ca", "cb")).applyInPandas(run, "a long, b long")


def heads(rows: DataFrame) -> DataFrame:
    return rows.filter("low is not null").select("block", "low", "high", "most")


def _lists(packs: DataFrame, pairs: DataFrame, k: int, width: int) -> DataFrame:
    """``rec_id, others, distances`` of every row, nearest first, over the blocks its block has to look at."""

    def run(mine: Block, theirs: Iterator[Block]) -> Iterator[pa.RecordBatch]:
        reach = mine.facts["reach"]
        own = mine.facts["pivots"].reshape(len(reach), -1)
        found = _Nearest(mine.x, mine.ids, k, reach)
        for block in theirs:
            low, high = np.array(block.facts["low"])[None], np.array(block.facts["high"])[None]
            apart = gap(own, own, low, high)[:, 0]
            found.feed(block.x, block.ids, np.flatnonzero(apart <= np.sqrt(found.most) + max(slack(own), slack(high))))
        first, others, distances = found.lists()
        for i in range(0, len(reach), STRIP):
            cut = first[i : i + STRIP + 1]
            values = slice(cut[0], cut[-1])
            starts = pa.array((cut - cut[0]).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(mine.ids[i : i + STRIP]), pa.ListArray.from_arrays(starts, pa.array(others[values])),
                 pa.ListArray.from_arrays(starts, pa.array(distances[values]))], names=["rec_id", "others", "distances"])

    return meet(packs, pairs, width, run, "rec_id long, others array<long>, distances array<double>", mine=("pivots", "reach"), theirs=("low", "high"))


def neighbour_lists(df: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """The ``k`` nearest other recordings as one row: ``rec_id, others, distances``, nearest first, ties by id.

    A block's rows meet one block after the other and keep their ``k`` best, so only features go through a shuffle, as often as
    there are blocks to be met; that number does not grow with the table until blocks are ``TILE_ROWS`` or ``TILE_BYTES`` large.
    """
    used = df.select("rec_id", "features")
    n, width, size = _sizes(used, k, block_rows)
    if not n:
        return df.sparkSession.createDataFrame([], "rec_id long, others array<long>, distances array<double>")
    packs = materialize(_within_blocks(place_rows(used, width, n, size, math.ceil(n / size), k), k))
    first = heads(packs)
    pairs = materialize(block_pairs(first).unionByName(first.select(F.col("block").alias("a"), F.col("block").alias("b"))))
    found = _lists(packs, pairs, k, width).filter(F.size("others") > 0)
    if used.groupBy("rec_id").count().filter("count > 1").isEmpty():
        return found
    # Rows of one id share a list.
    every = F.flatten(F.collect_list(F.arrays_zip(F.col("distances").alias("distance"), F.col("others").alias("other"))))
    best = found.groupBy("rec_id").agg(F.slice(F.array_sort(every), 1, k).alias("o"))
    return best.select("rec_id", F.col("o.other").alias("others"), F.col("o.distance").alias("distances"))


def nearest(df: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """The ``k`` nearest other recordings: ``rec_id, other, distance, place`` (1 is nearest), ties by id."""
    found = neighbour_lists(df, k, block_rows).select("rec_id", F.posexplode(F.arrays_zip("others", "distances")).alias("at", "o"))
    return found.select("rec_id", F.col("o.others").alias("other"), F.col("o.distances").alias("distance"), (F.col("at") + 1).alias("place"))


def met_share(df: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """One row: ``blocks``, ``pairs`` of different blocks, ``met`` of them, and the ``share`` met in a search for ``k`` neighbours."""
    used = df.select("rec_id", "features")
    n, width, size = _sizes(used, k, block_rows)
    rows = materialize(_within_blocks(place_rows(used, width, n, size, math.ceil(n / size), k), k))
    blocks = rows.agg((F.max("block") + 1).alias("blocks")).scalar()
    met = block_pairs(heads(rows)).agg(F.count(F.lit(1)).alias("met")).select(blocks.alias("blocks"), "met")
    pairs = F.col("blocks") * (F.col("blocks") - 1)
    return met.select("blocks", pairs.alias("pairs"), "met", F.try_divide("met", pairs).alias("share"))
