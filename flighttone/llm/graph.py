"""Connected components by alternating large and small stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flighttone.scale import HOT_ROWS, join_unique, materialize


def _met(links: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """``links`` with the least neighbour ``m`` of ``u``; a hub is taken out of the shuffle, where there can be one."""
    if count <= HOT_ROWS:
        return links.join(least, "u")
    return join_unique(links, materialize(least), ["u"], "c")


def _large(links: DataFrame, count: int) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("c"))
    return _met(both, least, 2 * count).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame, count: int) -> DataFrame:
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("c"))
    moved = _met(links, least, count).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _print(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """Smallest node that each linked node can reach: ``u, v``, without the smallest ones themselves.

    ``links`` has two columns of one ordered type, ``u`` and ``v``, in any direction.  Links move
    towards the smallest neighbour until nothing changes; every round is
    written to the checkpoint folder.
    """
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    links = materialize(down.filter("u <> v").distinct())
    before = _print(links)
    while True:
        large = _large(links, before[0]).distinct()
        links = materialize(_small(large, 2 * before[0]).filter("u <> v").distinct())
        now = _print(links)
        if now == before:
            return links
        before = now
