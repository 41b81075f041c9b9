"""Connected components as rounds of grouped minima and joins over edges that each partition has contracted."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, discard


#: A node with more than a share of 1 / SHARES of all edges is a hub; there are at most 4 * SHARES hubs.
SHARES, LEAST_HUB = 1024, 256
MOST_HELD = 1 << 20  #: edges that a task contracts at a time
FEW = 1 << 16  #: so many contracted edges (1 MB) are settled by one more contraction, in one task; more of them by rounds of joins


def _stars(edges: pa.Table) -> pa.RecordBatch:
    """Edges (node, least node) that connect what these connect."""
    both = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks], edges.schema.field("a").type)
    nodes = both.unique().sort()
    at = pc.index_in(both, nodes).to_numpy()
    a, b = at[: edges.num_rows], at[edges.num_rows :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[a], up[b]
        off = x != y
        if not off.any():
            break
        a, b, x, y = a[off], b[off], x[off], y[off]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != (further := up[up])).any():
            up = further
    low = np.flatnonzero(up != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([nodes.take(pa.array(low)), nodes.take(pa.array(up[low]))], names=["a", "b"])


def _contract(batches):
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= MOST_HELD:
            yield _stars(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield _stars(pa.Table.from_batches(held))


def _contracted(edges: DataFrame) -> DataFrame:
    """edges, those of a partition replaced by stars around the least node of what they connect; loses no connection."""
    return edges.mapInArrow(_contract, edges.schema)


def _star(edges: DataFrame, large: bool, hub: int) -> DataFrame:
    """Hang neighbours on the least node seen: the larger ones (large) or the smaller ones.

    Each node's least neighbour comes from an aggregation that is begun where the edges are. Edges of hubs, nodes of more
    than `hub` edges, meet it by a broadcast of at most 4 * SHARES rows and are not gathered; the others by a merge.
    """
    flip = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))) if large else F.array(F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    both = edges.select(F.inline(flip))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")).select("u", F.least("u", "m").alias("m"), "d")
    hubs = F.broadcast(least.filter(F.col("d") > hub).select("u", "m"))
    rest = both.join(hubs.select("u"), "u", "left_anti").join(least.filter(F.col("d") <= hub).select("u", "m").hint("merge"), "u")
    joined = both.join(hubs, "u").unionByName(rest)
    hung = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.inline(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))))
    return hung.filter("a <> b").distinct()


def _unsettled(edges: DataFrame):
    """The number of edges, and that of nodes with several smaller neighbours, or with a smaller and a larger one: none in a forest of stars."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return nodes.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.count_if((F.col("ups") > 1) | (F.col("ups") > F.col("least")))).first()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of undirected edges (a, b): the least node that it reaches.

    Each partition contracts its edges, before and after equal ones meet, so that few rounds are left; large-star and small-star rounds alternate until
    each node has one edge, to the least that it reaches, or until the edges left are few: a round's dozen exchanges take
    as many tasks for thousands of edges as for millions, so up to `FEW` edges are contracted together instead. A round's
    edges are written to the shared folder, and those of the round before deleted. Nodes are of any type that has an
    order. Loops and null ends are left out, an empty input gives no rows.
    """
    edges = cut(_contracted(_contracted(edges.filter("a <> b").select("a", "b")).distinct()), "edges")
    n, left = _unsettled(edges)
    hub = max(LEAST_HUB, n // SHARES)
    while left and n > FEW and rounds:
        before, rounds = edges, rounds - 1
        edges = cut(_contracted(_star(_star(edges, True, hub), False, hub)), "edges")
        discard(before)
        n, left = _unsettled(edges)
    if left and n <= FEW:
        before, left = edges, 0
        edges = cut(_contracted(edges.coalesce(1)), "edges")
        discard(before)
    if left:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


class Forest:
    """Union by least index over 0..n-1, for the pairs of one block."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
