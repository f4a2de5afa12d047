"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a group-by with a minimum (combined before the shuffle) and an equi-join of edges with those minima. A node may have very many
edges: these are dealt out by a salt, to each of which the node's minimum is sent, and since both sides then have exchanges of their own
AQE splits what is still too large. Every round is written to the shared folder, so a lost executor costs one round. No edge or label
reaches the driver. Rounds go on until nothing changes, whatever the length of the longest chain (about its logarithm).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop_table, write_table

#: Edges that a task contracts at a time.
_EDGES = 200_000


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star forest (node, smallest node of its component) with the components of the given edges."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while (label[label] != label).any():
        label = label[label]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def _contract(batches):
    held, size = [], 0

    def spanning():
        u, v = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
            size += b.num_rows
            if size >= _EDGES:
                yield spanning()
                held, size = [], 0
    if held:
        yield spanning()


def _with_least(edges: DataFrame, least: DataFrame, salts: int) -> DataFrame:
    """edges (u, v) with the minimum m of their u."""
    dealt = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int"))
    return dealt.join(least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["u", "_s"]).drop("_s")


def connected_components(edges: DataFrame, salts: int = 16) -> DataFrame:
    """edges: two columns of node ids (long; rows with a null, and loops, are ignored). Returns (node, component): the smallest node reachable, for each node that has an edge to another."""
    a, b = edges.columns[:2]
    cur = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u is not null and v is not null and u != v")
    cur = write_table(cur.mapInArrow(_contract, "u long, v long"), "edges")
    last = None
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _with_least(both.filter("v > u"), least, salts).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        large = write_table(large, "large")
        small = _with_least(large, large.groupBy("u").agg(F.min("v").alias("m")), salts).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        nxt = write_table(small.select("e.u", "e.v").filter("u != v").distinct(), "small")
        drop_table(large)
        drop_table(cur)
        cur = nxt
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
