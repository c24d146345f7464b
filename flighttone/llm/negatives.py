"""Hard negatives by exact integer products in residue numbers.

Components become integers.  Matrices of anchors and of all rows are multiplied
modulo several small primes in float32, where every partial sum is an exact
integer, and the signed scores are put together again by Chinese remaindering.  As
many primes are taken as the largest possible score asks for.  Rows and anchors
are packed into blocks, and every block of anchors meets every block of rows
in a task of its own, once to find the positives, once for the negatives in the positives' windows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flighttone.scale import materialize

#: What components are multiplied with, every which row is an anchor, where labels move on, and of how many.
SCALE, ANCHORS, MOVED, LABELS = 256, 100, 7, 10
#: Positives of an anchor, negatives of a positive, and their window in per cent of the positive's score.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows of a block, anchors of a block.
BLOCK_ROWS, BLOCK_ANCHORS = 8192, 256
#: Sums up to here are exact in float32.
EXACT = 1 << 24
#: Components are multiplied so many at a time.
WIDTH = 64


def primes(bound: int, width: int = WIDTH) -> list[int]:
    """Largest primes whose centred residues have exact products of ``width`` parts, enough for scores of ``-bound`` to ``bound``."""
    most = 2 * int(((EXACT - 1) // width) ** 0.5) + 1
    found, product = [], 1
    for n in range(most, 1, -1):
        if product > 2 * bound:
            break
        if all(n % k for k in range(2, int(n**0.5) + 1)):
            found.append(n)
            product *= n
    if product <= 2 * bound or product >= 1 << 63:
        raise ValueError("scores do not fit into 64 bits")
    return found


def _centred(x: np.ndarray, prime: int) -> np.ndarray:
    r = np.mod(x, prime)
    return np.where(r > prime // 2, r - prime, r)


def products(left: np.ndarray, right: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Exact ``left @ right.T`` of integer matrices whose results lie under half the product of ``moduli``."""
    value, done = np.zeros((len(left), len(right)), np.int64), 1
    for prime in moduli:
        a, b = _centred(left, prime).astype(np.float32), _centred(right, prime).astype(np.float32)
        residue = np.zeros(value.shape, np.int64)
        for at in range(0, left.shape[1], WIDTH):
            residue += (a[:, at : at + WIDTH] @ b[:, at : at + WIDTH].T).astype(np.int64)
        # The next digit in mixed radix: what has to be added in multiples of the primes before.
        digit = np.mod(np.mod(residue - value, prime) * pow(done % prime, -1, prime), prime)
        value += digit * done
        done *= prime
    return np.where(value > done // 2, value - done, value)


@dataclass
class Block:
    """Rows in the order of their ids, nulls last."""

    number: np.ndarray
    vec_id: np.ndarray
    null: np.ndarray
    label: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Block:
        """The block stored in a table's first row."""
        row = {c: table[c][0].as_py() for c in ("number", "vec_id", "absent", "label", "parts", "kind")}
        number = np.frombuffer(row["number"], np.int64)
        parts = np.frombuffer(row["parts"], row["kind"]).reshape(len(number), -1).astype(np.int64)
        return cls(number, np.frombuffer(row["vec_id"], np.int64), np.frombuffer(row["absent"], bool),
                   np.frombuffer(row["label"], np.int64), parts)


_BLOCK = "number binary, vec_id binary, absent binary, label binary, parts binary, kind string"


def rows_of(embeddings: DataFrame) -> DataFrame:
    """Rows that take part: ``number, vec_id, label, parts``, labels moved on, components whole numbers."""
    vector = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    usable = embeddings.select("vec_id", "label", vector.alias("vector")).filter(
        F.col("label").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    )
    moved = F.col("vec_id") % MOVED == 0
    label = F.when(moved, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return usable.select(
        F.monotonically_increasing_id().alias("number"), F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"), F.transform("vector", lambda x: F.floor(x * SCALE)).alias("parts"),
    )


def _packed(rows: DataFrame, blocks: int, width: int, name: str) -> DataFrame:
    """Rows dealt evenly to blocks, each packed into one row: ``name`` and the columns of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        absent = table["vec_id"].is_null().to_numpy()
        vec_id = table["vec_id"].fill_null(0).to_numpy()
        number = table["number"].to_numpy()
        order = np.lexsort((number, vec_id, absent))
        parts = np.zeros((len(order), width), np.int64)
        column = table["parts"].combine_chunks()
        sizes = column.value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        parts[row, place] = column.flatten().to_numpy(zero_copy_only=False)
        kind = next(k for k in ("int16", "int32", "int64") if not len(row) or np.abs(parts).max() <= np.iinfo(k).max)
        columns = [number[order], vec_id[order], absent[order], table["label"].to_numpy()[order], parts[order].astype(kind)]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([c.tobytes()], pa.binary()) for c in columns), pa.array([kind])],
            names=["number", "vec_id", "absent", "label", "parts", "kind"],
        )

    dealt = rows.repartition(blocks).mapInArrow(run, _BLOCK)
    return materialize(dealt.withColumn(name, F.monotonically_increasing_id()))


def _firsts(scores: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Allowed columns, highest scores first and ties in their order."""
    at = np.flatnonzero(allowed)
    return at[np.argsort(-scores[at], kind="stable")]


def _long(columns: dict[str, list]) -> pa.Table:
    flat = {c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in columns.items()}
    return pa.table({c: pa.array(v.astype(np.int64), mask=flat["absent"].astype(bool) if c == "vec_id" else None)
                     for c, v in flat.items() if c != "absent"})


def _meet(anchors: DataFrame, rows: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on every block of anchors with every block of rows, each pair in a group of its own."""
    names = [r.r for r in rows.select("r").collect()], [r.a for r in anchors.select("a").collect()]  # ids of blocks
    if not all(names):
        return rows.sparkSession.createDataFrame([], schema)
    # Both sides need keys of one type.
    left = anchors.withColumn("r", F.explode(F.array(*[F.lit(x).cast("long") for x in names[0]])))
    right = rows.withColumn("a", F.explode(F.array(*[F.lit(x).cast("long") for x in names[1]])))
    return left.groupBy("a", "r").cogroup(right.groupBy("a", "r")).applyInArrow(run, schema)


def _top(found: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each group, highest score first, then smallest id, with their ``place``; cut before the shuffle too."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "number")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def positives(anchors: DataFrame, rows: DataFrame, moduli: list[int], most: int = POSITIVES) -> DataFrame:
    """First rows of each anchor's label but itself: ``anchor, vec_id, number, score, place``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = Block.of(left), Block.of(right)
        out = {c: [] for c in ("anchor", "vec_id", "absent", "number", "score")}
        scores = products(a.parts, b.parts, moduli)
        for i, number in enumerate(a.number):
            first = _firsts(scores[i], (b.label == a.label[i]) & (b.number != number))[:most]
            values = (np.full(len(first), number), b.vec_id[first], b.null[first], b.number[first], scores[i, first])
            for held, value in zip(out.values(), values):
                held.append(value)
        return _long(out)

    return _top(_meet(anchors, rows, run, "anchor long, vec_id long, number long, score long"), ["anchor"], most)


def negatives(anchors: DataFrame, rows: DataFrame, found: DataFrame, moduli: list[int], most: int = NEGATIVES) -> DataFrame:
    """First rows of other labels in the window of each positive: ``anchor, positive, vec_id, number, score, place``."""
    wanted = found.groupBy("anchor").agg(F.collect_list(F.struct("number", "score")).alias("pairs"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, number = batch.column("a").to_pylist(), batch.column("number").to_pylist()
            own = [np.frombuffer(n, np.int64) for n in number]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(block, [len(o) for o in own]), pa.int64()), pa.array(np.concatenate(own))], names=["a", "anchor"])

    places = anchors.select("a", "number").mapInArrow(unpack, "a long, anchor long")
    windows = places.join(wanted, "anchor").groupBy("a").agg(F.collect_list(F.struct("anchor", "pairs")).alias("windows"))
    asked = anchors.join(windows, "a")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = Block.of(left), Block.of(right)
        pairs = {w["anchor"]: w["pairs"] for w in left["windows"][0].as_py()}
        out = {c: [] for c in ("anchor", "positive", "vec_id", "absent", "number", "score")}
        scores = products(a.parts, b.parts, moduli)
        for i, number in enumerate(a.number):
            if int(number) not in pairs:
                continue
            order = _firsts(scores[i], b.label != a.label[i])
            falling = -scores[i, order]
            for pair in pairs[int(number)]:
                # -(-x // y) rounds up, in whole numbers of any size.
                low, high = -(-LOW * pair["score"] // 100), HIGH * pair["score"] // 100
                start, stop = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
                first = order[start : min(stop, start + most)]
                values = (np.full(len(first), number), np.full(len(first), pair["number"]), b.vec_id[first], b.null[first],
                          b.number[first], scores[i, first])
                for held, value in zip(out.values(), values):
                    held.append(value)
        return _long(out)

    met = _meet(asked, rows, run, "anchor long, positive long, vec_id long, number long, score long")
    return _top(met, ["anchor", "positive"], most)


def mine(embeddings: DataFrame) -> DataFrame:
    """Negatives of every anchor and positive: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Rows without a label or a vector, or with a null or non-finite component, take no part; a
    vector without components has score 0 with all, and missing components of shorter
    vectors count 0.  Repeated rows are rows of their own, so a row may be
    the positive or negative of its copy.  Rows with a null id are no anchors and come last among ties.  An empty table
    gives no rows; other columns are not read.  Scores that 64 bits may not hold raise a ``ValueError``.
    """
    rows = materialize(rows_of(embeddings))
    # By Cauchy and Schwarz no score is larger than the largest square of a norm.
    squares = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    size = rows.agg(
        F.count(F.lit(1)), F.max(squares), F.max(F.size("parts")), F.count(F.when(F.col("vec_id") % ANCHORS == 0, 1))
    ).first()
    count, bound, width, anchors = int(size[0]), float(size[1] or 0), max(1, int(size[2] or 0)), int(size[3])
    if bound >= 2.0**61:
        raise ValueError("scores do not fit into 64 bits")
    moduli = primes(int(bound * (1 + 1e-9)) + 1)
    packed = _packed(rows, max(1, -(-count // BLOCK_ROWS)), width, "r")
    asking = _packed(rows.filter(F.col("vec_id") % ANCHORS == 0), max(1, -(-anchors // BLOCK_ANCHORS)), width, "a")
    near = materialize(positives(asking, packed, moduli))
    found = negatives(asking, packed, near, moduli)
    names = rows.filter(F.col("vec_id") % ANCHORS == 0).select(F.col("number").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    good = near.select("anchor", F.col("number").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(good, ["anchor", "positive"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )


def sql() -> str:
    """The same as DuckDB SQL, rows told apart by number."""
    return f"""
    WITH e AS (SELECT row_number() OVER () AS number, vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
                      list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS parts
               FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.number AS anchor, a.vec_id AS anchor_id, b.number, b.vec_id, a.label = b.label AS same,
                 CAST(list_dot_product(CAST(a.parts AS DOUBLE[]), CAST(b.parts AS DOUBLE[])) AS BIGINT) AS score
          FROM e a JOIN e b ON a.number <> b.number AND a.vec_id % {ANCHORS} = 0),
    p AS (SELECT anchor, number AS positive, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, number) <= {POSITIVES})
    SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
           CAST(row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, vec_id, number) AS INTEGER) AS rank
    FROM s JOIN p USING (anchor) WHERE NOT same
      AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
    QUALIFY row_number() OVER (PARTITION BY anchor, positive ORDER BY score DESC, vec_id, number) <= {NEGATIVES}"""
