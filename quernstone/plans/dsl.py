"""A small pipeline language: named nodes with inputs, compiled to one lazy DataFrame plan per sink.

Nodes are dicts (so a YAML file may hold them) or functions marked by decorators.
Kinds: source, table, select, map, filter, join, aggregate, union, window, distinct, sort, limit, sql, sink.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.sources.readers import dsl_sink, dsl_source

AGGREGATES = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "first": F.first, "last": F.last, "collect_list": F.collect_list, "count_distinct": F.count_distinct, "any_value": F.any_value, "median": F.median}


class Pipeline:
    """Nodes by name; compile(name) gives its DataFrame, run() writes every sink."""

    def __init__(self, spark: SparkSession, nodes: list[dict] | None = None):
        self.spark, self.nodes, self.made = spark, {}, {}
        for n in nodes or []:
            self.add(**n)

    def add(self, name: str, kind: str, inputs: list[str] | None = None, **spec) -> Pipeline:
        if name in self.nodes:
            raise ValueError(f"node {name} is defined twice")
        self.nodes[name] = (kind, inputs or [], spec)
        return self

    def source(self, name: str) -> Callable:
        return lambda f: self.add(name, "call", [], function=f) and f

    def transform(self, name: str, inputs: list[str]) -> Callable:
        return lambda f: self.add(name, "call", inputs, function=f) and f

    def order(self) -> list[str]:
        """Names so that inputs come first; a cycle or an unknown input is an error."""
        done: list[str] = []
        open_: set[str] = set()

        def visit(n: str) -> None:
            if n in done:
                return
            if n not in self.nodes:
                raise ValueError(f"unknown node {n}")
            if n in open_:
                raise ValueError(f"cycle through {n}")
            open_.add(n)
            for i in self.nodes[n][1]:
                visit(i)
            done.append(n)

        for n in self.nodes:
            visit(n)
        return done

    def compile(self, name: str) -> DataFrame:
        if name not in self.made:
            self.order()
            kind, inputs, spec = self.nodes[name]
            self.made[name] = self._node(kind, [self.compile(i) for i in inputs], dict(spec))
        return self.made[name]

    def _node(self, kind: str, inputs: list[DataFrame], s: dict) -> DataFrame:
        one = inputs[0] if inputs else None
        if kind == "call":
            return s["function"](*inputs) if inputs else s["function"](self.spark)
        if kind == "source":
            return dsl_source(self.spark, s["format"], s["location"], s.get("options"), s.get("schema"))
        if kind == "table":
            return self.spark.table(s["table"])
        if kind in ("select", "map"):
            cols = s.get("columns") or ["*"]
            out = one.select(*cols) if kind == "select" else one
            return out.withColumns({c: F.expr(e) for c, e in s.get("expressions", {}).items()}) if s.get("expressions") else out
        if kind == "filter":
            return one.filter(s["condition"])
        if kind == "join":
            return inputs[0].join(inputs[1], s["on"], s.get("how", "inner"))
        if kind in ("aggregate", "window"):
            aggs = [AGGREGATES[f](c).alias(n) for n, (f, c) in s["aggregates"].items()]
            keys = list(s.get("by", []))
            if kind == "aggregate":
                return one.groupBy(*keys).agg(*aggs)
            w = F.window(s["time"], s["size"], s.get("slide"))
            return one.groupBy(w.alias("_w"), *keys).agg(*aggs).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *keys, *s["aggregates"])
        if kind == "union":
            return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=bool(s.get("allow_missing"))), inputs)
        if kind == "distinct":
            return one.dropDuplicates(s["columns"]) if s.get("columns") else one.distinct()
        if kind == "sort":
            return one.orderBy(*[F.expr(c) if isinstance(c, str) else F.expr(c[0]).desc() for c in s["by"]])
        if kind == "limit":
            return one.limit(s["n"])
        if kind == "sql":
            from quernstone.plans.sqlpair import guarded

            return self.spark.sql(guarded(s["query"]), **{f"t{k}": d for k, d in enumerate(inputs)})
        if kind == "sink":
            return one
        raise ValueError(f"no node kind {kind}")

    def run(self) -> list[str]:
        """Write every sink; their names."""
        sinks = [n for n in self.order() if self.nodes[n][0] == "sink"]
        for n in sinks:
            s = self.nodes[n][2]
            dsl_sink(self.compile(n), s["format"], s["location"], s.get("options"), s.get("mode", "overwrite"))
        return sinks


class Metrics:
    """Measures over dimensions: simple (an aggregate), ratio, derived (an expression over metrics) and cumulative."""

    def __init__(self, **definitions: dict):
        self.definitions = definitions

    def _simple(self, name: str) -> dict[str, str]:
        d = self.definitions[name]
        if d["kind"] in ("simple", "cumulative"):
            return {name: d["measure"]}
        parts = [d["numerator"], d["denominator"]] if d["kind"] == "ratio" else d["inputs"]
        return {k: v for p in parts for k, v in self._simple(p).items()}

    def _over(self, name: str):
        d = self.definitions[name]
        if d["kind"] in ("simple", "cumulative"):
            return F.col(name)
        if d["kind"] == "ratio":
            return F.try_divide(self._over(d["numerator"]), self._over(d["denominator"]))
        return F.expr(d["expression"])

    def compute(self, df: DataFrame, names: list[str], dimensions: list[str], time: str | None = None, grain: str = "month") -> DataFrame:
        from pyspark.sql import Window

        keys = list(dimensions)
        if time:
            df, keys = df.withColumn("period", F.date_trunc(grain, time)), [*keys, "period"]
        simple = {k: v for n in names for k, v in self._simple(n).items()}
        out = df.groupBy(*keys).agg(*[F.expr(e).alias(n) for n, e in simple.items()])
        for n in names:
            if self.definitions[n]["kind"] == "cumulative":
                w = Window.partitionBy(*dimensions).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
                out = out.withColumn(n, F.sum(n).over(w))
        for n in names:
            out = out.withColumn(n, self._over(n))
        return out.select(*keys, *names)


class Features:
    """Named feature functions, the same for batch and stream."""

    def __init__(self):
        self.functions: dict[str, Callable] = {}

    def feature(self, name: str) -> Callable:
        return lambda f: self.functions.setdefault(name, f)

    def compute(self, df: DataFrame, names: list[str] | None = None) -> DataFrame:
        return df.withColumns({n: self.functions[n](df) for n in names or list(self.functions)})


def fingerprint(df: DataFrame) -> int:
    """Equal for plans that differ in names of intermediate results only."""
    return df.semanticHash()


def is_deterministic(make: Callable[[], DataFrame]) -> bool:
    """Whether two runs give the same multiset of rows."""

    def digest(df: DataFrame):
        h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
        return df.agg(F.count("*"), F.sum(h)).first()

    return digest(make()) == digest(make())


def lineage(df: DataFrame) -> list[tuple[str, list[str]]]:
    """Each output column and the source columns that its analysed expression refers to."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = {}
    for i in range(plan.collectLeaves().size()):
        out = plan.collectLeaves().apply(i).output()
        for k in range(out.size()):
            leaves[out.apply(k).exprId().id()] = out.apply(k).name()
    defined: dict[int, list[int]] = {}

    def refs(e) -> list[int]:
        r = e.references().toSeq()
        return [r.apply(k).exprId().id() for k in range(r.size())]

    def walk(p) -> None:
        for k in range(p.children().size()):
            walk(p.children().apply(k))
        e = p.expressions()
        for k in range(e.size()):
            x = e.apply(k)
            if x.getClass().getSimpleName() == "Alias":
                defined[x.exprId().id()] = refs(x.child())

    walk(plan)

    def roots(i: int, seen: frozenset = frozenset()) -> set[str]:
        if i in leaves and i not in defined:
            return {leaves[i]}
        if i in seen:
            return set()
        return {n for j in defined.get(i, []) for n in roots(j, seen | {i})}

    out = plan.output()
    return [(out.apply(k).name(), sorted(roots(out.apply(k).exprId().id()))) for k in range(out.size())]
