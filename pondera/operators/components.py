"""Connected components of an edge table by alternating star contraction.

Every round joins each node's edges to its smallest neighbour (large star), then
hangs each node's smaller neighbours on the smallest of them (small star).  The
edge set turns into one star per component in a logarithmic number of rounds.
Before the rounds, partitions of ``PART_EDGES`` edges are each reduced to their
own stars, as a combiner would.
Minima are aggregated before the shuffle; a hub's edges are joined to one row,
which adaptive execution can split.  Nothing but two numbers per round, the
edge count and a hash sum, comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondera.plans.scratch import Scratch

PART_EDGES = 1 << 19


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's edges as stars around the smallest node of each part that they connect.

    ``PART_EDGES`` edges at most are held: more are reduced as they come.
    """
    parts: list[pa.RecordBatch] = []
    held = 0
    for batch in batches:
        parts.append(batch)
        held += batch.num_rows
        if held > PART_EDGES:
            yield from _reduced(parts)
            parts, held = [], 0
    if parts:
        yield from _reduced(parts)


def _reduced(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = pa.Table.from_batches(parts).combine_chunks()
    both = pa.concat_arrays([edges.column(c).chunk(0) for c in (0, 1)]) if edges.num_rows else pa.array([], edges.schema.field(0).type)
    names, codes = np.unique(both.to_numpy(zero_copy_only=False), return_inverse=True)
    root = list(range(len(names)))
    for a, b in codes.reshape(2, -1).T.tolist():
        while root[a] != a:
            root[a] = a = root[root[a]]
        while root[b] != b:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    for i, r in enumerate(root):  # a root is smaller than what hangs on it, so it is final already
        root[i] = root[r]
    top = np.array(root, np.int64)
    off = np.flatnonzero(top != np.arange(len(top)))
    yield pa.RecordBatch.from_arrays([pa.array(names[off], both.type), pa.array(names[top[off]], both.type)], edges.schema.names)


def _round(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    # the restated key gives this side of the join an exchange of its own: adaptive execution
    # splits a hub's edges only between plain exchanges
    low = low.select(F.when(F.col("u").isNotNull(), F.col("u")).alias("u"), F.least("u", "m").alias("m"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u")
    hung = small.where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return hung.union(low.toDF("a", "b")).distinct()


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of an edge (columns ``a, b``); a component is its smallest node.

    Self-loops, repeated edges and edges with a null end are ignored; a node with
    no other edge is not returned.  An empty table gives an empty one.
    """
    scratch = Scratch(edges.sparkSession, "components")
    at = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "round0")
    n = at.count()
    at = scratch.keep(at.repartition(max(1, -(-n // PART_EDGES))).mapInArrow(stars, at.schema), "stars")
    scratch.drop("round0")
    whole = n <= PART_EDGES  # one partition held all edges, so its stars are the components
    state = _state(at) if not whole else (0, 0)
    for i in range(1, max_rounds + 1):
        if state[0] == 0:
            break
        at, before = scratch.keep(_round(at), f"round{i}"), state
        scratch.drop(f"round{i - 1}" if i > 1 else "stars")
        state = _state(at)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(at.select("b", "b").distinct())


def _state(edges: DataFrame) -> tuple[int, int]:
    n, h = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, int(h or 0)
