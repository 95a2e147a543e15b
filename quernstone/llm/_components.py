"""Connected components of an undirected graph, distributed: alternating large-star and small-star rounds.

Every round is two minima per node and two joins; a node with very many
neighbours is pre-aggregated before the minima, and its rows are dealt over SALTS
tasks in the joins.  No part of the graph is collected.  Each round is
written to the shared folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.llm._env import removed, written


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node reachable over the edges (a, b); for graphs that fit a task."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        root = root[root]
        open_ = root[a] != root[b]
        if not open_.any() and (root == before).all():
            break
        if (root == before).all():
            break
    while (root != root[root]).any():
        root = root[root]
    return root


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest id of its component: as connected as (a, b), one edge a node at most."""
    ids, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = roots(len(ids), flat[: len(a)], flat[len(a) :])
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[own], ids[root[own]]


SALTS = 16


def _with_least(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """pairs (u, v) with the m of u in least (u, m), dealt by u and a hash of v."""
    salt = F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")
    every = least.select("u", "m", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    # A merge join: Spark would judge the copies by the size of the one they come from and broadcast them.
    return pairs.withColumn("salt", salt).join(every.hint("merge"), ["u", "salt"]).drop("salt")


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v), u > v.  One large-star and one small-star."""
    both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    large = _with_least(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = _with_least(large, least).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return small.filter("u > v").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """edges (a, b) of ids to (id, component): each id that has an edge with the smallest id reachable from it."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    while state[0]:
        then = written(_star(now), name)
        new = then.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        removed(edges.sparkSession, now)
        now, same = then, new == state
        state = new
        if same:
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct()
