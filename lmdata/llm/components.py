"""Connected components: edges that a task can hold are contracted there, more by alternating star contraction.

Each task first replaces its edges by a spanning forest.  If all fit one task, that is the result, in one pass without a shuffle: rounds
over small tables would cost as many tasks and files each as over large ones.  Else each round is a table in the shared folder.  A node that very many edges meet gets its smallest neighbour by broadcast, so that its edges stay where they are; minima are
taken in two steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lmdata.llm.common import shipped, staged

#: Edges that a task holds at once: 16 MB.
WHOLE = 1 << 20

#: A node with more edges than this, and than one in MOST_HOT of all, is hot: there are at most 2 * MOST_HOT of them.
HOT, MOST_HOT = 64, 10_000
SALTS = 16


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a checksum: the same twice in a row when nothing changes any more."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r["n"], r["s"]


def _least(rows: DataFrame) -> DataFrame:
    """(c, m, n): the smallest v and the number of rows of each u."""
    salted = rows.groupBy("u", F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("salt")).agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    return salted.groupBy(F.col("u").alias("c")).agg(F.min("m").alias("m"), F.sum("n").alias("n"))


def _with_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """(u, v, m): rows with their u's entry in ``least``."""
    hot = F.broadcast(least.filter(F.col("n") > max(HOT, n_edges // MOST_HOT)).select("c", "m"))  # at most 2 * MOST_HOT rows
    many = rows.join(hot, F.col("u") == F.col("c")).select("u", "v", "m")
    few = rows.join(hot, F.col("u") == F.col("c"), "left_anti").join(least, F.col("u") == F.col("c")).select("u", "v", "m")
    return many.union(few)


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour, or itself."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    handed = _with_least(both.filter("v > u"), _least(both), n)
    return handed.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).filter("u != v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    handed = _with_least(down, least, n).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return handed.filter("u != v").distinct()


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges but the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root, x, y = np.arange(len(nodes)), at[: len(u)], at[len(u) :]
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # both are roots: the larger goes under the smaller
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    away = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[away], nodes[root[away]]


def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v), u != v, to a forest (u, v) that connects the same nodes; of up to WHOLE rows, v is the smallest node that u reaches."""
    sent = lambda x: pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1])], names=["u", "v"])
    parts, held = [], 0
    for b in batches:
        parts.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        held += b.num_rows
        if held > WHOLE:
            stars = _stars(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            parts, held = [stars], len(stars[0])
            if held > WHOLE // 2:
                yield sent(stars)
                parts, held = [], 0
    if held:
        yield sent(_stars(*(np.concatenate(c) for c in zip(*parts, strict=True))))


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) to (node, root): root is the smallest node reachable.  Nodes without an edge have no row."""
    shipped(edges.sparkSession)
    at = staged(edges.filter("u != v").select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(contracted, "u long, v long"), "edges")
    if at.count() <= WHOLE:
        at = staged(at.coalesce(1).mapInArrow(contracted, "u long, v long"), "stars")
        return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
    mark = _mark(at)
    while True:
        large = staged(_large_star(at, mark[0]), "large")
        at = staged(_small_star(large, mark[0]), "stars")
        new = _mark(at)
        if new == mark:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = new
