"""Iterative and graph queries as loops of joins; each round is checkpointed to reliable storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Checkpoint where the session has a folder for it; else the plan just grows (small graphs, tests)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.persist()


def iterate(start: DataFrame, step, keys: list[str], rounds: int = 50) -> DataFrame:
    """Feedback until nothing new comes: step(new rows) gives rows, of which those whose keys are not yet held go round again, each with its round in ``iteration``."""
    held = _cut(start.dropDuplicates(keys).withColumn("iteration", F.lit(0)))
    front = held
    for r in range(1, rounds + 1):
        front = _cut(step(front.drop("iteration")).dropDuplicates(keys).join(held.select(*keys), keys, "left_anti").withColumn("iteration", F.lit(r)))
        if front.isEmpty():
            break
        held = held.unionByName(front)
    return held


def pagerank(edges: DataFrame, iterations: int = 20, damping: float = 0.85, tolerance: float = 1e-4, dangling: str = "drop", weight: str | None = None) -> DataFrame:
    """id, rank; without edges no rows.  dangling: drop the rank of nodes without successors, or redistribute it.  weight: a column; rank then flows in proportion."""
    w = F.sum(weight) if weight else F.lit(1.0)
    e = _cut(edges.groupBy("src", "dst").agg(w.cast("double").alias("w")))  # else each round makes the edges anew
    out = e.join(e.groupBy("src").agg(F.sum("w").alias("deg")), "src")
    nodes = e.select(F.col("src").alias("id")).unionAll(e.select(F.col("dst").alias("id"))).distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(iterations):
        share = out.join(ranks, out["src"] == ranks["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("w") / F.col("deg")).alias("in"))
        lost = 0.0
        if dangling == "redistribute":
            lost = ranks.join(e, ranks["id"] == e["src"], "left_anti").agg(F.sum("rank")).first()[0] or 0.0
        new = ranks.withColumnRenamed("rank", "old").join(share, "id", "left").select("id", "old", ((1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + lost / n)).alias("rank"))
        new = _cut(new)
        moved = new.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
        ranks = new.select("id", "rank")
        if moved < tolerance:
            break
    return ranks


def simple_cycles(edges: DataFrame, shortest: int = 3, longest: int = 5, least: float = 0.0) -> DataFrame:
    """Directed simple cycles of bounded length, each once from its smallest node, whose smallest exposure is at least ``least``: path (array), exposure."""
    e = _cut(edges.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.sum("weight").alias("w")).filter(F.col("w") >= least))
    paths = e.select(F.array("src", "dst").alias("path"), F.col("w").alias("exposure")).filter(F.col("path")[1] > F.col("path")[0])
    found = None
    for length in range(2, longest + 1):
        last, first = F.element_at("path", -1), F.element_at("path", 1)
        step = paths.withColumn("_last", last).withColumn("_first", first).join(e, F.col("_last") == e["src"])
        if length >= shortest:
            closed = step.filter(F.col("dst") == F.col("_first")).select("path", F.least("exposure", "w").alias("exposure"))
            found = closed if found is None else found.unionAll(closed)
        if length < longest:
            paths = step.filter((F.col("dst") > F.col("_first")) & ~F.array_contains("path", F.col("dst"))).select(F.concat("path", F.array("dst")).alias("path"), F.least("exposure", "w").alias("exposure"))
    return found


def contagion(edges: DataFrame, seeds: list, threshold: float, rounds: int = 20) -> DataFrame:
    """id, round in which it fails: a node fails if one failed debtor owes at least ``threshold`` of all it is owed.  Edge: src owes dst weight."""
    e = edges.groupBy("src", "dst").agg(F.sum("weight").alias("w"))
    e = e.join(e.groupBy("dst").agg(F.sum("w").alias("total")), "dst").filter(F.col("w") / F.col("total") >= threshold).select("src", "dst")
    spark = edges.sparkSession
    failed = spark.createDataFrame([(s, 0) for s in seeds], f"id {edges.schema['src'].dataType.simpleString()}, round int")
    front = failed
    for r in range(1, rounds + 1):
        front = _cut(front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id")).distinct().join(failed.select("id"), "id", "left_anti").withColumn("round", F.lit(r)))
        if front.isEmpty():
            break
        failed = failed.unionAll(front)
    return failed


def belief_propagation(edges: DataFrame, priors: DataFrame, coupling: float = 0.2, rounds: int = 10) -> DataFrame:
    """id, belief: log-odds passed over undirected edges, damped by ``coupling``, added to the prior log-odds."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    belief = priors.select("id", F.ln(F.col("p") / (1 - F.col("p"))).alias("prior")).withColumn("b", F.col("prior"))
    for _ in range(rounds):
        got = both.join(belief, both["src"] == belief["id"]).groupBy(F.col("dst").alias("id")).agg(F.sum(coupling * F.tanh(F.col("b") / 2)).alias("m"))
        belief = _cut(belief.select("id", "prior").join(got, "id", "left").withColumn("b", F.col("prior") + F.coalesce("m", F.lit(0.0))).drop("m"))
    return belief.select("id", (1 / (1 + F.exp(-F.col("b")))).alias("belief"))


def betweenness(edges: DataFrame, most_edges: int = 200_000, tasks: int = 64) -> DataFrame:
    """id, betweenness of the directed, unweighted graph, exactly.

    The edges go to every task, so only graphs of at most ``most_edges`` edges (else
    an error); the source nodes are dealt over the tasks, whose sums are added up.
    """
    e = edges.select("src", "dst").distinct()
    got = [(r.src, r.dst) for r in e.limit(most_edges + 1).collect()]  # bounded, checked next
    if len(got) > most_edges:
        raise ValueError(f"more than {most_edges} edges")
    held = edges.sparkSession.sparkContext.broadcast(got)
    nodes = e.select(F.col("src").alias("id")).unionAll(e.select("dst")).distinct()

    def run(frames):
        from collections import deque

        import pandas as pd

        out: dict = {}
        for a, b in held.value:
            out.setdefault(a, []).append(b)
            out.setdefault(b, [])
        for pdf in frames:
            total = dict.fromkeys(out, 0.0)
            for s in pdf.id.tolist():
                dist, paths, before, order = {s: 0}, {s: 1.0}, {s: []}, []
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for t in out[v]:
                        if t not in dist:
                            dist[t], paths[t], before[t] = dist[v] + 1, 0.0, []
                            queue.append(t)
                        if dist[t] == dist[v] + 1:
                            paths[t] += paths[v]
                            before[t].append(v)
                share = dict.fromkeys(order, 0.0)
                for t in reversed(order):
                    for v in before[t]:
                        share[v] += paths[v] / paths[t] * (1 + share[t])
                    if t != s:
                        total[t] += share[t]
            yield pd.DataFrame(list(total.items()), columns=["id", "betweenness"])

    kind = edges.schema["src"].dataType.simpleString()
    return nodes.repartition(tasks, "id").mapInPandas(run, f"id {kind}, betweenness double").groupBy("id").agg(F.sum("betweenness").alias("betweenness"))
