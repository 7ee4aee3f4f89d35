"""Consolidating pairwise matches into groups: connected components on a two-dimensional grid of edge partitions.

Vertices are hashed into blocks; an edge belongs to the cell (block of one end, block of the other). The grid has at least
as many cells as the cluster runs tasks, and more where cells would hold too many edges. Every cell runs a local
union-find over its edges - a cell may be split over several tasks, because union-find on any part of the edges is sound -
and reports a representative for each vertex it saw. A vertex then exchanges the representatives it got along its row and
its column: the smallest becomes its parent, parents of parents are taken until they are roots, and roots that a vertex's
representatives have in different places are tied. Those ties are the edges of the next, much smaller round. Rounds end
when nothing is left to tie; the parents of all rounds are composed afterwards. No link, component or vertex set ever
reaches the driver; only row counts do. Parents are looked up among the distinct parents alone, so a component that holds
a third of all vertices is one row of the looked-up side.

Defined cases: null ends and self loops tie nothing (a self loop alone makes no group); repeated and mirrored edges
count once; the representative is the smallest vertex in string order; an empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import written

#: Edges that one cell should hold; the grid grows with the edges so that a local union-find stays small.
EDGES_PER_CELL = 1_000_000
#: Arrow rows that a task joins to its union-find at once.
CHUNK = 200_000


def _smallest_reps(left: np.ndarray, right: np.ndarray, n: int, parent: np.ndarray) -> np.ndarray:
    """Union-find in arrays: hook the larger root under the smaller one, then halve paths, until edges agree."""
    while True:
        a, b = parent[left], parent[right]
        off = a != b
        if not off.any():
            return parent
        low, high = np.minimum(a[off], b[off]), np.maximum(a[off], b[off])
        np.minimum.at(parent, high, low)
        while True:
            jumped = parent[parent]
            if np.array_equal(jumped, parent):
                break
            parent = jumped


def _local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Representatives of the vertices of one task's edges. Chunks are reduced to (vertex, representative) stars as
    they come, so memory follows the distinct vertices of the task and not its edges."""

    def reduce(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, codes = np.unique(np.concatenate([a, b]), return_inverse=True)  # sorted: smaller code, smaller vertex
        parent = _smallest_reps(codes[: len(a)], codes[len(a) :], len(names), np.arange(len(names)))
        return names, names[parent]

    kept: tuple[np.ndarray, np.ndarray] | None = None
    waiting: list[pd.DataFrame] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += len(batch)
        if size >= CHUNK:
            part = pd.concat(waiting)
            a, b = part["u"].to_numpy(dtype=object), part["v"].to_numpy(dtype=object)
            kept = reduce(np.concatenate([a, kept[0]]), np.concatenate([b, kept[1]])) if kept else reduce(a, b)
            waiting, size = [], 0
    if waiting:
        part = pd.concat(waiting)
        a, b = part["u"].to_numpy(dtype=object), part["v"].to_numpy(dtype=object)
        kept = reduce(np.concatenate([a, kept[0]]), np.concatenate([b, kept[1]])) if kept else reduce(a, b)
    if kept:
        for at in range(0, len(kept[0]), 50_000):
            yield pd.DataFrame({"v": kept[0][at : at + 50_000], "rep": kept[1][at : at + 50_000]})


def _looked_up(rows: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """``rows`` with ``column`` exchanged for its parent where it has one. Only the distinct values are looked up."""
    asked = rows.select(F.col(column).alias("v")).distinct().join(parents.select("v", F.col("parent").alias("_above")), "v").withColumnRenamed("v", "_of")
    others = [c for c in rows.columns if c != column]
    return rows.join(asked, rows[column] == asked["_of"], "left").select(*others, F.coalesce("_above", column).alias(column))


def connected_components(edges: DataFrame, u: str, v: str, blocks: int | None = None) -> DataFrame:
    """(vertex, component) for every vertex that has an edge to another one; component is its smallest vertex."""
    spark = edges.sparkSession
    low, high = F.least(F.col(u), F.col(v)), F.greatest(F.col(u), F.col(v))
    current = written(
        edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
        .select(low.alias("u"), high.alias("v"))
        .distinct()
    )
    total = current.count()
    rounds: list[DataFrame] = []
    least_side = int(np.ceil(np.sqrt(spark.sparkContext.defaultParallelism)))
    while total:
        side = blocks or max(least_side, int(np.ceil(np.sqrt(total / EDGES_PER_CELL))))
        cells = current.select(
            "u", "v",
            F.pmod(F.xxhash64("u"), F.lit(side)).alias("row"), F.pmod(F.xxhash64("v"), F.lit(side)).alias("column"),
        )
        stars = written(cells.repartition(side * side, "row", "column").select("u", "v").mapInPandas(_local, "v string, rep string"))
        parents = stars.groupBy("v").agg(F.min("rep").alias("parent"))
        while True:  # parents of parents until every vertex points at the root of its tree: paths halve each time
            jumped = written(_looked_up(parents.select("v", F.col("parent").alias("before"), "parent"), "parent", parents))
            parents = jumped.select("v", "parent")
            if not jumped.where("before != parent").limit(1).count():
                break
        rounds.append(parents)
        # what a vertex was told by its row and its column is tied, by the parents of both ends
        told = stars.join(parents.withColumnRenamed("parent", "p"), "v").select("rep", "p").distinct()
        ends = _looked_up(told, "rep", parents).withColumnRenamed("rep", "q")
        current = written(ends.where("p != q").select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v")).distinct())
        total = current.count()
    if not rounds:
        return spark.createDataFrame([], "vertex string, component string")
    found = rounds[-1]
    for parents in reversed(rounds[:-1]):
        found = _looked_up(parents, "parent", found)
    return found.select(F.col("v").alias("vertex"), F.col("parent").alias("component"))
