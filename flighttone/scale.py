"""Building blocks that keep globally ordered work spread over all tasks.

A window without a partition clause, or one partitioned by a column in which a
single key may hold a third of all rows, ends in one task.  The functions here
sort by range instead, write the sorted rows to the checkpoint folder, and
combine one small total per range.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast, checked by counting.
BROADCAST_ROWS = 100_000

_SLOT = "_slot"
_RANGE = "_range"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; make one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="flighttone-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(rows + 1).count() <= rows


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when it is proven small, else leave the join to AQE."""
    return F.broadcast(df) if is_small(df, rows) else df


def _ranges(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sorted_ranges(df: DataFrame, keys: Sequence[Column | str], partitions: int | None) -> DataFrame:
    """Range-partitioned, sorted, written rows with their range and slot."""
    placed = (
        df.repartitionByRange(_ranges(df, partitions), *keys)
        .sortWithinPartitions(*keys)
        .withColumn(_SLOT, F.monotonically_increasing_id())
        .withColumn(_RANGE, F.shiftright(_SLOT, 33))
        .withColumn(_SLOT, F.col(_SLOT).bitwiseAND(F.lit((1 << 33) - 1)))
    )
    return materialize(placed)


def _range_offsets(placed: DataFrame, totals: Mapping[str, Column]) -> DataFrame:
    """What all earlier ranges add up to: one row per range, so always small."""
    before = Window.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    per_range = placed.groupBy(_RANGE).agg(*[c.alias(n) for n, c in totals.items()])
    return F.broadcast(
        per_range.select(
            _RANGE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals]
        )
    )


def with_position(
    df: DataFrame,
    keys: Sequence[Column | str],
    name: str = "position",
    start: int = 0,
    partitions: int | None = None,
) -> DataFrame:
    """Dense global position under ``keys``; end the keys with a unique one."""
    placed = _sorted_ranges(df, keys, partitions)
    offsets = _range_offsets(placed, {"_before": F.count(F.lit(1))})
    return (
        placed.join(offsets, _RANGE)
        .withColumn(name, F.col("_before") + F.col(_SLOT) + F.lit(start))
        .drop(_SLOT, _RANGE, "_before")
    )


def with_running_totals(
    df: DataFrame,
    keys: Sequence[Column | str],
    sums: Mapping[str, Column | str],
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive global running sums of ``sums`` under the order ``keys``."""
    valued = df.withColumns({n: F.expr(c) if isinstance(c, str) else c for n, c in sums.items()})
    placed = _sorted_ranges(valued, keys, partitions)
    offsets = _range_offsets(placed, {f"_before_{n}": F.sum(n) for n in sums})
    upto = Window.partitionBy(_RANGE).orderBy(_SLOT).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumns({n: F.sum(n).over(upto) for n in sums})
    return (
        running.join(offsets, _RANGE)
        .withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums})
        .drop(_SLOT, _RANGE, *[f"_before_{n}" for n in sums])
    )


def with_previous(
    df: DataFrame,
    position: str,
    columns: Mapping[str, str],
    block: int = 100_000,
) -> DataFrame:
    """Add the previous row's values under a dense ``position``.

    Rows are windowed in blocks of consecutive positions; the last row of each
    block travels to the next block as well, so no window spans the data.
    """
    here = F.floor(F.col(position) / block)
    last = F.col(position) % block == block - 1
    spread = df.withColumn(
        "_block", F.explode(F.when(last, F.array(here, here + 1)).otherwise(F.array(here)))
    )
    order = Window.partitionBy("_block").orderBy(position)
    return (
        spread.withColumns({new: F.lag(old).over(order) for new, old in columns.items()})
        .filter(F.col("_block") == here)
        .drop("_block")
    )


#: Intervals an octave and an interval are cut into, in the first and in later passes of a selection.
OCTAVE, FINER = 64, 1 << 16


def _first_cut(value: Column) -> Column:
    """Numbers of intervals in the order of the values: parts of octaves, one for each infinity and for NaN."""
    size = F.abs(value)
    part = F.floor(F.log2(size) * OCTAVE) + OCTAVE * 1100  # the smallest double is 2 ** -1074
    part = F.when(F.isnan(value), OCTAVE * 4000).when(size == float("inf"), OCTAVE * 3000).when(size > 0, part).otherwise(0)
    return F.when(value < 0, -part).otherwise(part).cast("long")


def percentiles(
    df: DataFrame,
    by: Sequence[str],
    column: str,
    shares: Mapping[str, float],
) -> DataFrame:
    """Exact percentiles with linear interpolation for each group in ``by``.

    Values are selected as by radix: a pass counts, on the map side, the values in
    intervals, the wanted ranks choose theirs, and the next pass cuts only these, until each
    holds one value.  Nothing is sorted and no group is collected; a task sends as many counts for a group as there
    are intervals, at most.  ``df`` is read in each pass, of which there are two to five, so store what is dear to
    compute.  The group of null is one; groups without a value have no row.
    """
    spark = df.sparkSession
    wanted = {f"{n}_{part}": (q, part) for n, q in shares.items() for part in ("lo", "hi")}
    # A field that is never null, so that the group of null joins like any other.
    rows = df.select(F.struct(F.lit(0).alias("_"), *by).alias("_g"), F.col(column).cast("double").alias("_v")).filter("_v is not null")
    rows = rows.withColumn("_f", _first_cut(F.col("_v")))

    def counted(values: DataFrame, keys: list[str], cut: Column) -> DataFrame:
        counts = values.groupBy(*keys, cut.alias("_d")).agg(
            F.count(F.lit(1)).alias("_w"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        return counts.withColumn("_upto", F.sum("_w").over(Window.partitionBy(*keys).orderBy("_d")))

    def chosen(counts: DataFrame) -> tuple[DataFrame, bool]:
        """Intervals with the ranks that fall into them, counted from their start: at most BROADCAST_ROWS rows, or a table."""
        start = F.col("_upto") - F.col("_w")
        inside = F.filter("_ranks", lambda x: (start <= x["rank"]) & (x["rank"] < F.col("_upto")))
        moved = F.transform(inside, lambda x: F.struct(x["t"].alias("t"), (x["rank"] - start).alias("rank")))
        found = counts.select("_g", "_f", "_n", "_lo", "_hi", moved.alias("_ranks")).filter(F.size("_ranks") > 0)
        some = found.coalesce(1).limit(BROADCAST_ROWS + 1).toArrow()
        if some.num_rows > BROADCAST_ROWS:
            return materialize(found), False
        return spark.createDataFrame(some, found.schema), True

    counts = counted(rows, ["_g"], F.col("_f")).withColumnRenamed("_d", "_f")
    counts = counts.withColumn("_n", F.sum("_w").over(Window.partitionBy("_g")))
    ranks = []
    for name, (q, part) in wanted.items():
        rank = F.lit(q) * (F.col("_n") - 1)
        ranks.append(F.struct(F.lit(name).alias("t"), (F.floor(rank) if part == "lo" else F.ceil(rank)).alias("rank")))
    targets, few = chosen(counts.withColumn("_ranks", F.array(*ranks)))
    settled = targets.filter("_lo = _hi")
    targets = targets.filter("_lo < _hi")
    while not targets.isEmpty():
        asked = targets.select("_g", "_f", F.col("_lo").alias("_a"), F.col("_hi").alias("_b"), "_ranks", "_n")
        known = asked.select("_g", "_f", "_a", "_b")
        near = rows.join(F.broadcast(known) if few else known, ["_g", "_f"]).filter("_v between _a and _b")
        cut = F.floor((F.col("_v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * (FINER - 1))
        counts = counted(near, ["_g", "_f", "_a"], cut)
        targets, few = chosen(counts.join(F.broadcast(asked) if few else asked, ["_g", "_f", "_a"]))
        settled = settled.unionByName(targets.filter("_lo = _hi"))
        targets = targets.filter("_lo < _hi")
    settled = settled.withColumn("_r", F.explode("_ranks")).withColumn("_t", F.col("_r.t"))
    ends = settled.groupBy("_g").agg(
        F.max("_n").alias("_n"), *[F.max(F.when(F.col("_t") == name, F.col("_lo"))).alias(f"_{name}") for name in wanted]
    )
    between = {}
    for name, q in shares.items():
        lo, hi, rank = F.col(f"_{name}_lo"), F.col(f"_{name}_hi"), F.lit(q) * (F.col("_n") - 1)
        share = rank - F.floor(rank)
        # Equal neighbours are the value itself, so infinities do not cancel out.
        between[name] = F.when(lo == hi, lo).otherwise(lo * (1 - share) + hi * share)
    return ends.select(*[F.col("_g")[b].alias(b) for b in by], *[c.alias(n) for n, c in between.items()])


#: Rows of one join key above which it is joined on its own.
HOT_ROWS = 200_000
#: Copies of each key where hot keys are too many to be broadcast.
SALTS = 16


def join_unique(left: DataFrame, right: DataFrame, keys: Sequence[str], weight: str,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join to a side with one row per key and the ``weight`` that key has on the left.

    Keys holding many rows are broadcast, when they are proven few, so their
    rows stay where they are; all others are shuffled as usual.  Where hot keys
    are too many for that, every key is copied ``SALTS`` times and the rows are
    dealt to the copies.
    """
    hot = right.filter(F.col(weight) > hot_rows)
    found = hot.limit(BROADCAST_ROWS + 1).count()
    if found == 0:
        return left.join(right, list(keys))
    if found > BROADCAST_ROWS:
        dealt = left.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return dealt.join(copies, [*keys, "_salt"]).drop("_salt")
    names = hot.select(*keys)
    rest = left.join(F.broadcast(names), list(keys), "left_anti")
    cold = right.filter(F.col(weight) <= hot_rows)
    return left.join(F.broadcast(hot), list(keys)).unionByName(rest.join(cold, list(keys)))


#: Rows of sums added up at once.
FAN = 32


def tree_sum(parts: DataFrame, size: int, blocks: int) -> np.ndarray:
    """Sum of ``sums`` (bytes of ``size`` doubles), in an order that hangs on ``block`` alone."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        total = np.zeros(size)
        for part in table["sums"].to_pylist():
            total = total + np.frombuffer(part)
        return pa.table({"block": pa.array([table["block"][0].as_py() // FAN], pa.int64()), "sums": [total.tobytes()]})

    for _ in range(math.ceil(math.log(max(blocks, 1), FAN)) - 1):
        parts = parts.groupBy(F.floor(F.col("block") / FAN).alias("_up")).applyInArrow(
            lambda _, table: run(table.select(["block", "sums"])), "block long, sums binary")
    total = np.zeros(size)
    for row in sorted(parts.collect(), key=lambda r: r.block):  # at most FAN rows
        total = total + np.frombuffer(row.sums)
    return total
