"""Connected components of links between ids, as min-label stars.

Rounds of large-star and small-star (each node hands its larger, then its smaller neighbours to the
smallest of them) until the links are stars. Links stay in tables: every round is written to the
shared folder and read back, and only counts reach the driver. Links of at most ONE_TASK rows are
joined by one task instead, which saves the rounds' many small stages; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import runtime


#: Links that one task may join, at 16 bytes each.
ONE_TASK = 500_000
#: Links of a node from which on its rows aren't dealt by it; there are at most the number of links over HOT such nodes.
HOT = 500_000


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """rows (a, b) with the m of least (a, m, n): rows of nodes with many links get it by broadcast, the rest by a shuffled join."""
    hot = least.where(F.col("n") > HOT).select("a", F.col("m").alias("_m"))
    marked = rows.join(F.broadcast(hot), "a", "left")
    cold = marked.where("_m is null").drop("_m").join(least.where(F.col("n") <= HOT).select("a", "m"), "a")
    return cold.unionByName(marked.where("_m is not null").withColumnRenamed("_m", "m"))


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
    return _with_least(both, least).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = _with_least(down, least).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _is_stars(e: DataFrame) -> bool:
    twice = e.groupBy("a").count().where("count > 1").limit(1)
    chain = e.select("a").join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1)
    return not twice.count() and not chain.count()


def _in_one_task(links: DataFrame) -> DataFrame:
    """(id, component) by hooking each root to the smallest root that a link leads to, and halving paths, until links lead nowhere else."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        a, b = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 2
        ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = at[: len(a)], at[len(a) :]
        root = np.arange(len(ids))
        while True:
            low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root[root] != root).any():
                root = root[root]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "component"])

    return links.coalesce(1).mapInArrow(run, "id bigint, component bigint")


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of bigint ids -> (id, component) for every id in a link; component is its smallest id.

    links is a stored table. No links give no rows; a link from an id to itself or with a null says nothing.
    """
    e = links.select("a", "b").where("a <> b")
    if e.count() <= ONE_TASK:
        return _in_one_task(e)
    e = runtime.store(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _is_stars(e):
        after = runtime.store(_small_star(_large_star(e)), "links")
        runtime.discard(e)
        e = after
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b"), F.col("b")).distinct())
