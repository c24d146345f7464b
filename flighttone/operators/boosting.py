"""Boosted trees for all classes at once.

A round adds one tree for each class against the shared soft-max loss (one tree for two
classes), all grown level by level: a pass over the binned rows adds up first and second derivatives by
class, node, feature and bin, and the best split of each node is chosen where the sums of a few features meet.
Derivatives are rounded to whole numbers of a small unit, so sums are exact and a
model does not depend on how the rows are laid out.  The passes also tell the loss of the rounds before, so one run gives the
model, when to stop and the curves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.scale import materialize

#: Rows of a block, bins of a feature, and rows from which the cuts between bins are taken, at most.
BLOCK_ROWS, BINS, CUT_ROWS = 4096, 256, 20_000
#: Bytes of sums in one row, and rows of sums added up at once.
CHUNK_BYTES, FAN = 1 << 20, 32
#: Derivatives are counted in this unit.
UNIT = 2.0**-20
#: Rounds of trees that passes apply before the margins are stored.
STORED = 8
# Weight of a leaf's square, least second derivative of a leaf.
LAMBDA, LEAST = 1.0, 1.0


@dataclass
class Tree:
    """Nodes in lists; a leaf has itself as children."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [0])
    cut: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: int = 0

    def leaves(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """The leaf of every row, of bins or of the features themselves."""
        feature, left, right = (np.array(c) for c in (self.feature, self.left, self.right))
        limit = np.array(self.bin) if binned else np.array(self.cut)
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            values = x[rows, feature[node]]
            below = values <= limit[node] if binned else values < limit[node]
            node = np.where(below, left[node], right[node])
        return node

    def split(self, node: int, feature: int, bin_: int, cut: float) -> tuple[int, int]:
        children = len(self.value), len(self.value) + 1
        self.feature[node], self.bin[node], self.cut[node] = feature, bin_, cut
        self.left[node], self.right[node] = children
        for child in children:
            for column, value in ((self.feature, 0), (self.bin, 0), (self.cut, 0.0), (self.left, child), (self.right, child), (self.value, 0.0)):
                column.append(value)
        return children


@dataclass
class Booster:
    """Rounds of trees, one for each of ``outputs``, and the losses and errors after each round, of learned and of held-out rows."""

    outputs: int
    n_features: int
    trees: list[list[Tree]] = field(default_factory=list)
    curves: list[list[float]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.outputs))
        for trees in self.trees:
            out += _values(trees, x, binned=False)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _shares(self.margins(x))

    def split_counts(self) -> np.ndarray:
        out = np.zeros(self.n_features, np.int64)
        for trees in self.trees:
            for tree in trees:
                inner = np.array(tree.left) != np.arange(len(tree.left))
                out += np.bincount(np.array(tree.feature)[inner], minlength=self.n_features)
        return out

    def to_dict(self) -> dict:
        return {"outputs": self.outputs, "n_features": self.n_features, "curves": self.curves,
                "trees": [[vars(t) for t in trees] for trees in self.trees]}

    @staticmethod
    def from_dict(data: dict) -> Booster:
        trees = [[Tree(**t) for t in trees] for trees in data["trees"]]
        return Booster(data["outputs"], data["n_features"], trees, data["curves"])


def _values(trees: list[Tree], x: np.ndarray, binned: bool) -> np.ndarray:
    return np.stack([np.array(t.value)[t.leaves(x, binned)] for t in trees], axis=1)


def _shares(margins: np.ndarray) -> np.ndarray:
    """Class probabilities; a single margin is that of the second of two classes."""
    whole = np.hstack([np.zeros_like(margins), margins]) if margins.shape[1] == 1 else margins
    weights = np.exp(whole - whole.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


# --- rows -----------------------------------------------------------------------


def _cuts(df: DataFrame, bins: int) -> list[np.ndarray]:
    """Where bins of each feature end: between distinct values of a bounded sample, evenly by rank where there are many."""
    sample = df.filter("not is_test").orderBy(F.xxhash64("rec_id"), "rec_id").limit(CUT_ROWS).select("features").toPandas()
    x = np.stack(sample["features"].to_numpy())
    out = []
    for column in x.T:
        known = np.unique(column[np.isfinite(column)])
        if len(known) > bins:
            ordered = np.sort(column[np.isfinite(column)])
            known = np.unique(ordered[np.linspace(0, len(ordered) - 1, bins).astype(int)])
        out.append((known[:-1] + known[1:]) / 2)
    return out


def _blocks(df: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``bins, label, test, margin`` of some rows each, as bytes; a value beyond all cuts, and NaN, is in the last bin."""
    sent = df.sparkSession.sparkContext.broadcast(cuts)  # BINS numbers a feature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                x = np.stack(part.column("features").to_pandas().to_numpy())
                bins = np.stack([np.searchsorted(c, x[:, i], side="right") for i, c in enumerate(sent.value)], axis=1)
                columns = (bins.astype(np.uint8), part.column("label").to_numpy().astype(np.int32),
                           part.column("is_test").to_numpy(zero_copy_only=False).astype(bool))
                yield pa.RecordBatch.from_arrays([*(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([b""], pa.binary())],
                                                 names=["bins", "label", "test", "margin"])

    rows = df.select(F.col("features").cast("array<double>"), F.col("label").cast("int"), F.col("is_test").cast("boolean"))
    return materialize(rows.mapInArrow(run, "bins binary, label binary, test binary, margin binary"))


class _Block:
    def __init__(self, row: dict, width: int, outputs: int, pending: list[list[Tree]]):
        self.label = np.frombuffer(row["label"], np.int32)
        self.test = np.frombuffer(row["test"], bool)
        self.bins = np.frombuffer(row["bins"], np.uint8).reshape(-1, width)
        kept = np.frombuffer(row["margin"]).reshape(-1, outputs) if row["margin"] else np.zeros((len(self.label), outputs))
        self.margin = kept.copy()
        for trees in pending:
            self.margin += _values(trees, self.bins, binned=True)
        self.share = _shares(self.margin)

    def judged(self) -> np.ndarray:
        """Rows, sum of losses and wrong ones, of learned and of held-out rows."""
        loss = -np.log(np.maximum(self.share[np.arange(len(self.label)), self.label], 1e-300))
        wrong = self.share.argmax(axis=1) != self.label
        return np.array([f[self.test == t].sum() for t in (False, True) for f in (np.ones(len(loss)), np.rint(loss / UNIT), wrong)])

    def derivatives(self) -> tuple[np.ndarray, np.ndarray]:
        first = self.share[:, -self.margin.shape[1] :]
        true = self.label[:, None] == (np.arange(first.shape[1]) + (self.share.shape[1] - first.shape[1]))
        return np.rint((first - true) / UNIT), np.rint(np.maximum(first * (1 - first), 1e-16) / UNIT)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


# --- growing --------------------------------------------------------------------


def _best_splits(sums: np.ndarray, first: int, cuts: list[np.ndarray]) -> list[tuple]:
    """For sums by class, node, feature, bin and order of derivative: the best split of each class and node."""
    sums = sums * UNIT
    total = sums[:, :, 0].sum(axis=2)
    left = np.cumsum(sums, axis=3)[:, :, :, :-1]
    right = total[:, :, None, None] - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + LAMBDA)
    gain = score(left) + score(right) - score(total)[:, :, None, None]
    ends = np.array([len(c) for c in cuts])
    allowed = (left[..., 1] >= LEAST) & (right[..., 1] >= LEAST) & (np.arange(gain.shape[3]) < ends[:, None])
    gain = np.where(allowed, gain, -np.inf)
    out = []
    for c in range(gain.shape[0]):
        for n in range(gain.shape[1]):
            at = np.unravel_index(gain[c, n].argmax(), gain[c, n].shape) if gain[c, n].size else None
            best = float(gain[c, n][at]) if at else -np.inf
            side = left[(c, n, *at)] if at else np.zeros(2)
            f, b = (int(at[0]), int(at[1])) if at else (0, 0)
            out.append((c, n, best, first + f, b, *side.tolist(), *total[c, n].tolist()))
    return out


_SPLITS = ("class", "node", "gain", "feature", "bin", "gl", "hl", "g", "h")
_SCHEMA = "class int, node int, gain double, feature int, bin int, gl double, hl double, g double, h double"


def _pass(blocks: DataFrame, outputs: int, cuts: list[np.ndarray], pending: list[list[Tree]], grown: list[Tree],
          active: list[list[int]], parts: int) -> tuple[dict, np.ndarray]:
    """Best split of every active node, by class and node, and how the rows are judged before the trees being grown."""
    width, most = len(cuts), max(map(len, active))
    bins = max(len(c) for c in cuts) + 1
    wide = max(1, CHUNK_BYTES // (outputs * most * bins * 16))
    sent = blocks.sparkSession.sparkContext.broadcast((cuts, pending, grown, active))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, pending, grown, active = sent.value
        sums, judged = np.zeros((outputs, most, width, bins, 2)), np.zeros(6)
        for row in _rows(batches):
            block = _Block(row, width, outputs, pending)
            judged += block.judged()
            for c, derivative in enumerate(zip(*(d.T for d in block.derivatives()))):
                place = np.full(len(grown[c].value), -1)
                place[active[c]] = np.arange(len(active[c]))
                node = place[grown[c].leaves(block.bins, binned=True)]
                used = np.flatnonzero((node >= 0) & ~block.test)
                for f in range(width):
                    cell = node[used] * bins + block.bins[used, f]
                    for order in (0, 1):
                        sums[c, :, f, :, order] += np.bincount(cell, derivative[order][used], most * bins).reshape(most, bins)
        part = TaskContext.get().partitionId()
        chunks = [(-1, judged), *((i, sums[:, :, i * wide : (i + 1) * wide]) for i in range(-(-width // wide)))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in chunks], pa.int32()), pa.array([part] * len(chunks), pa.int32()),
             pa.array([s.tobytes() for _, s in chunks], pa.binary())], names=["chunk", "part", "sums"])

    def total(table: pa.Table) -> np.ndarray:
        return sum(np.frombuffer(s.as_py()) for s in table["sums"])

    def merge(table: pa.Table) -> pa.Table:
        return pa.table({"chunk": table["chunk"][:1], "part": pa.array([table["part"][0].as_py() // FAN], pa.int32()), "sums": [total(table).tobytes()]})

    def choose(table: pa.Table) -> pa.Table:
        chunk, whole = table["chunk"][0].as_py(), total(table)
        if chunk < 0:
            rows = [(-1, i, float(v), 0, 0, 0.0, 0.0, 0.0, 0.0) for i, v in enumerate(whole)]
        else:
            own = cuts[chunk * wide : (chunk + 1) * wide]
            rows = _best_splits(whole.reshape(outputs, most, len(own), bins, 2), chunk * wide, own)
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), *[pa.float64()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(_SPLITS))

    held = blocks.mapInArrow(add, "chunk int, part int, sums binary")
    while parts > FAN:
        held = held.groupBy("chunk", F.floor(F.col("part") / FAN).alias("_up")).applyInArrow(
            lambda _, table: merge(table), "chunk int, part int, sums binary")
        parts = -(-parts // FAN)
    rows = held.groupBy("chunk").applyInArrow(choose, _SCHEMA).collect()  # a row for each class, node and chunk of features
    sent.unpersist()
    best: dict = {}
    for r in sorted((r for r in rows if r["class"] >= 0), key=lambda r: (-r["gain"], r["feature"], r["bin"])):
        best.setdefault((r["class"], r["node"]), r)
    judged = np.array([r["gain"] for r in sorted((r for r in rows if r["class"] < 0), key=lambda r: r["node"])])
    return best, judged


def _curve(judged: np.ndarray) -> list[float]:
    """Loss and error of learned rows and of held-out ones, NaN where there are none."""
    n, loss, wrong = judged.reshape(2, 3).T
    with np.errstate(invalid="ignore", divide="ignore"):
        return [float(v) for pair in zip(loss * UNIT / n, wrong / n) for v in pair]


def boost(df: DataFrame, classes: int, width: int, rounds: int, depth: int, rate: float, stop, bins: int = BINS) -> Booster:
    """Train on ``features, label, is_test``; ``stop`` tells from held-out losses the best round and whether to end.

    A round in which no tree finds a split ends the training too: more of them would not tell any rows apart.
    """
    outputs = 1 if classes == 2 else classes
    model = Booster(outputs, width)
    if df.filter("not is_test").isEmpty():
        raise ValueError("no rows to learn from")
    cuts = _cuts(df, min(bins, BINS))
    blocks = _blocks(df, cuts)
    parts = blocks.rdd.getNumPartitions()
    stored = 0
    best = 0
    for turn in range(rounds + 1):
        pending = model.trees[stored:]
        grown, active = [Tree() for _ in range(outputs)], [[0] for _ in range(outputs)]
        splits = 0
        for level in range(depth if turn < rounds else 1):
            found, judged = _pass(blocks, outputs, cuts, pending, grown, active, parts)
            if level == 0 and turn:
                model.curves.append(_curve(judged))
                held = [c[2] for c in model.curves]
                best, ended = stop(held) if judged[3] else (turn, False)
                if ended or turn == rounds:
                    model.trees, model.curves = model.trees[:best], model.curves[:best]
                    return model
            for c in range(outputs):
                further = []
                for place, node in enumerate(active[c]):
                    r = found[c, place]
                    grown[c].value[node] = -rate * r["g"] / (r["h"] + LAMBDA)
                    if r["gain"] <= 1e-9:
                        continue
                    splits += 1
                    further += grown[c].split(node, r["feature"], r["bin"], float(cuts[r["feature"]][r["bin"]]))
                    grown[c].depth = level + 1
                    for child, g, h in zip(further[-2:], (r["gl"], r["g"] - r["gl"]), (r["hl"], r["h"] - r["hl"])):
                        grown[c].value[child] = -rate * g / (h + LAMBDA)
                active[c] = further
            if not any(active):
                break
            active = [a or [] for a in active]
        if not splits and turn:
            model.trees, model.curves = model.trees[: best or turn], model.curves[: best or turn]
            return model
        model.trees.append(grown)
        if len(model.trees) - stored >= STORED:
            blocks, stored = _stored(blocks, outputs, width, model.trees[stored:]), len(model.trees)
    return model


def _stored(blocks: DataFrame, outputs: int, width: int, pending: list[list[Tree]]) -> DataFrame:
    sent = blocks.sparkSession.sparkContext.broadcast(pending)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            row["margin"] = _Block(row, width, outputs, sent.value).margin.tobytes()
            yield pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.binary()) for c in ("bins", "label", "test", "margin")]))

    return materialize(blocks.mapInArrow(run, "bins binary, label binary, test binary, margin binary"))
