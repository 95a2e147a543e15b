"""Joins that Spark has no single operator for: as-of, interval, cyclic, versioned and fuzzy joins."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CROWD = 500_000  # rows of a few days that fuzzy_match cuts by amount


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, right_cols: list[str], lookback: str | None = None, allow_exact: bool = True, tie: str | None = None, ranges: bool | None = None) -> DataFrame:
    """Each left row with the latest right row of the same keys at or before its time.

    One union and one window, so one shuffle and no row explosion.  lookback: an
    interval; older matches count as none.  allow_exact: whether an equal time
    matches.  tie: a right column; of equal times the highest wins.  ranges: for keys
    that hold very many rows (and, unless said otherwise, where there is no key): rows
    are dealt by ranges of key and time, and the last right row of the ranges before
    is carried over, so no key needs to fit a task.
    """
    ranges = not by if ranges is None else ranges
    payload = F.struct(F.col(right_ts).alias("ts"), *[F.col(c).alias(c) for c in right_cols])
    lcols = F.struct(*[F.col(c) for c in left.columns])
    order = F.col(tie) if tie else F.lit(0)
    a = left.select(*by, F.col(left_ts).alias("_ts"), F.lit(1 if allow_exact else 0).alias("_side"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("_tie"), lcols.alias("_l"))
    b = right.select(*by, F.col(right_ts).alias("_ts"), F.lit(0 if allow_exact else 1).alias("_side"), order.alias("_tie"), payload.alias("_r"))
    every = a.unionByName(b, allowMissingColumns=True)
    order = ["_ts", "_side", "_tie"]
    w = Window.partitionBy(*by, *(["_part"] if ranges else [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if ranges:
        every = every.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()).persist()  # both uses must see the same ranges
        ends = every.filter("_r IS NOT NULL").groupBy(*by, "_part").agg(F.max_by("_r", F.struct(*order)).alias("_end"))
        parts = every.select(*by, "_part").distinct().join(ends, [*by, "_part"], "left")  # one row a key and range
        carry = parts.withColumn("_carry", F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
        every = every.join(carry, [*by, "_part"])
    found = F.last("_r", ignorenulls=True).over(w)
    out = every.withColumn("_m", F.coalesce(found, F.col("_carry")) if ranges else found).filter("_l IS NOT NULL")
    fresh = F.col("_m").isNotNull() if lookback is None else F.col("_m.ts") >= F.col("_ts") - F.expr(f"INTERVAL {lookback}")
    named = [F.when(fresh, F.col(f"_m.{c}")).alias(f"right_{c}" if c in left.columns else c) for c in right_cols]
    return out.select("_l.*", F.when(fresh, F.col("_m.ts")).alias(f"matched_{right_ts}"), *named)


def asof_forward(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, right_cols: list[str], **options) -> DataFrame:
    """Each left row with the earliest right row of the same keys at or after its time: an as-of join over negated time."""
    back = lambda c: -F.unix_micros(F.col(c).cast("timestamp"))
    out = asof_join(left.withColumn("_to", back(left_ts)), right.withColumn("_from", back(right_ts)), by, "_to", "_from", [right_ts, *right_cols], **options)
    return out.drop("_to", "matched__from")


class Timeline:
    """Keyed points in time under inserts and deletes, as a signed multiset; all questions are joins over what stands."""

    def __init__(self, rows: DataFrame, by: list[str], ts: str):
        from quernstone.operators import ivm

        self.ivm, self.by, self.ts, self.rows = ivm, by, ts, ivm.signed(rows)

    def insert(self, rows: DataFrame) -> Timeline:
        self.rows = self.rows.unionByName(self.ivm.signed(rows))
        return self

    def delete(self, rows: DataFrame) -> Timeline:
        """Each row given takes away one equal row, if there is one."""
        self.rows = self.rows.unionByName(self.ivm.signed(rows, -1))
        return self

    def standing(self) -> DataFrame:
        return self.ivm.visible(self.ivm.consolidate(self.rows).filter(F.col(self.ivm.DIFF) > 0))

    def predecessor(self, asked: DataFrame, ts: str, columns: list[str], **options) -> DataFrame:
        return asof_join(asked, self.standing(), self.by, ts, self.ts, columns, **options)

    def successor(self, asked: DataFrame, ts: str, columns: list[str], **options) -> DataFrame:
        return asof_forward(asked, self.standing(), self.by, ts, self.ts, columns, **options)

    def range_query(self, asked: DataFrame, ts: str, before: int, after: int) -> DataFrame:
        return interval_join(asked, self.standing(), self.by, ts, self.ts, before, after)


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, before: int, after: int) -> DataFrame:
    """Pairs of equal keys whose right time lies from ``before`` seconds before to ``after`` seconds after the left time.

    Times fall into bins as wide as the range, so each left row meets the bins it
    reaches into by an equi-join; the exact condition follows.
    """
    width = max(1, before + after)
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    l = left.withColumn("_bin", F.explode(F.sequence(F.floor((seconds(left_ts) - before) / width), F.floor((seconds(left_ts) + after) / width))))
    r = right.withColumn("_bin", F.floor(seconds(right_ts) / width))
    gap = F.col(right_ts).cast("timestamp").cast("double") - F.col(left_ts).cast("timestamp").cast("double")
    return l.join(r, [*by, "_bin"]).filter((gap >= -before) & (gap <= after)).drop("_bin")


def natural_join(relations: list[DataFrame]) -> DataFrame:
    """Left-deep natural join of set relations on shared column names; relations that share none multiply."""

    def two(a: DataFrame, b: DataFrame) -> DataFrame:
        shared = [c for c in a.columns if c in b.columns]
        return a.join(b, shared) if shared else a.crossJoin(b)

    return reduce(two, [r.distinct() for r in relations])


def generic_join(relations: list[DataFrame], cells: int = 64, by: list[str] | None = None) -> DataFrame:
    """Natural join of any set relations, cyclic or not, without intermediate results: one shuffle, then a worst-case optimal join in each cell.

    The attributes span a cube of about ``cells`` cells, each attribute cut by its hash
    in equally many slices.  A row goes to the cells that agree with its attributes, so
    every result meets in exactly one.  A cell binds one attribute after the other: the
    candidates are the intersection of what all relations that have it still allow
    (the smallest probed in the others), so no more than the largest possible output is
    ever looked at.  Relations without rows or attributes make the result empty.

    by: return only how many results (``n``) each combination of these attributes is
    in.  They are bound first; of the rest, parts that no relation ties together are
    counted apart and multiplied, and the last attribute of a part is counted as the
    size of an intersection, so the results themselves are never made.
    """
    names = sorted({c for r in relations for c in r.columns}, key=lambda c: (c not in (by or []), -sum(c in r.columns for r in relations), c))
    kinds = {c: r.schema[c].dataType.simpleString() for r in relations for c in r.columns}
    slices = max(1, round(cells ** (1 / max(1, len(names)))))
    dealt = None
    for k, r in enumerate(relations):
        at = [F.array(F.pmod(F.xxhash64(F.lit(c), F.col(c).cast(kinds[c])), F.lit(slices))) if c in r.columns else F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")) for c in names]
        rows = r.distinct().filter(" AND ".join(f"`{c}` IS NOT NULL" for c in r.columns))
        cell = F.lit(0).cast("long")
        for i, options in enumerate(at):
            rows = rows.withColumn(f"_c{i}", F.explode(options))
            cell = cell * slices + F.col(f"_c{i}")
        one = rows.select(cell.alias("_cell"), F.lit(k).alias("_rel"), *[(F.col(c) if c in r.columns else F.lit(None).cast(kinds[c])).alias(c) for c in names])
        dealt = one if dealt is None else dealt.unionByName(one)

    places = [[names.index(c) for c in names if c in r.columns] for r in relations]
    last = len(names) if by is None else len(set(by))

    def run(table):
        import pyarrow as pa

        columns = [table[c].to_pylist() for c in names]
        tries: list[dict] = [{} for _ in places]
        for n, rel in enumerate(table["_rel"].to_pylist()):
            node = tries[rel]
            for i in places[rel]:
                node = node.setdefault(columns[i][n], {})
        out: list[tuple] = []

        def ways(open_: list[int], nodes: list[dict]) -> int:
            """Results over the attributes still open; a relation's next attribute is the first open one that it has."""
            total, rest = 1, list(open_)
            while rest and total:
                part, grown = {rest[0]}, True
                while grown:
                    tied = {i for p in places for i in p if i in rest and part & set(p)}
                    grown, part = not tied <= part, part | tied
                rest = [i for i in rest if i not in part]
                first, later = min(part), sorted(part)[1:]
                having = [k for k, p in enumerate(places) if first in p]
                least = min(having, key=lambda k: len(nodes[k]))
                both = nodes[least].keys()
                for k in having:
                    if k != least:
                        both = both & nodes[k].keys()
                total *= sum(ways(later, [n[v] if k in having else n for k, n in enumerate(nodes)]) for v in both) if later else len(both)
            return total

        def bind(depth: int, bound: tuple, nodes: list[dict]) -> None:
            if depth == last:
                n = 1 if by is None else ways(list(range(last, len(names))), nodes)
                if n:
                    out.append(bound if by is None else (*bound, n))
                return
            having = [k for k, p in enumerate(places) if depth in p]
            least = min(having, key=lambda k: len(nodes[k]))
            others = [nodes[k] for k in having if k != least]
            for v in nodes[least]:
                if all(v in o for o in others):
                    bind(depth + 1, (*bound, v), [n[v] if k in having else n for k, n in enumerate(nodes)])

        bind(0, (), tries)
        found = {c: pa.array([t[i] for t in out], table.schema.field(c).type) for i, c in enumerate(names[:last])}
        return pa.table(found if by is None else found | {"n": pa.array([t[last] for t in out], pa.int64())})

    rows = dealt.groupBy("_cell").applyInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in names[:last]] + ["n bigint"] * (by is not None)))
    return rows if by is None else rows.groupBy(*by).agg(F.sum("n").alias("n"))


def is_acyclic(schemas: list[set[str]]) -> bool:
    """Whether a natural join of these column sets is acyclic: ears go until none is left."""
    left = [set(s) for s in schemas]
    moved = True
    while moved and len(left) > 1:
        moved = False
        for i, s in enumerate(left):
            rest = left[:i] + left[i + 1 :]
            shared = {c for c in s if any(c in t for t in rest)}
            if any(shared <= t for t in rest):
                left, moved = rest, True
                break
    return len(left) <= 1


def semi_join_reduced(relations: list[DataFrame]) -> list[DataFrame]:
    """Each relation without rows that its neighbour in the list does not match: one pass forth and one back."""
    out = [r.distinct() for r in relations]
    forth = [(i, i - 1) for i in range(1, len(out))]
    for i, j in forth + [(j, i) for i, j in reversed(forth)]:
        shared = [c for c in out[i].columns if c in out[j].columns]
        if shared:
            out[i] = out[i].join(out[j].select(*shared).distinct(), shared, "left_semi")
    return out


def oriented(edges: DataFrame) -> DataFrame:
    """Undirected edges (src, dst) once each, from the node of smaller (degree, id): no node has more than sqrt(2m) successors."""
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    deg = e.select("u").unionAll(e.select(F.col("v").alias("u"))).groupBy("u").agg(F.count("*").alias("d"))
    e = e.join(deg.withColumnRenamed("d", "du"), "u").join(deg.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    first = F.struct("du", "u") < F.struct("dv", "v")
    return e.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("b"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles (x < y < z): wedges from low-degree nodes, closed by a semi-join; O(m^1.5) rows in between."""
    e = oriented(edges)
    wedge = e.alias("p").join(e.alias("q"), "a").filter("p.b < q.b").select("a", F.col("p.b").alias("b"), F.col("q.b").alias("c"))
    closing = e.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("c"))
    found = wedge.join(closing, ["b", "c"], "left_semi")
    return found.select(F.array_sort(F.array("a", "b", "c")).alias("t")).select(F.col("t")[0].alias("x"), F.col("t")[1].alias("y"), F.col("t")[2].alias("z"))


def four_cycles(edges: DataFrame) -> DataFrame:
    """Number of 4-cycles through each pair of opposite nodes (u < v).

    Each cycle is made once, from its last node in the order of (degree, id), out of
    two wedges whose middles come before it: O(m^1.5) wedges, so a hub of degree d
    does not make d^2 of them.  Both pairs of opposite nodes are credited.
    """
    e = edges.filter("src <> dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    deg = both.groupBy("u").agg(F.count("*").alias("d"))
    both = both.join(deg, "u").join(deg.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    down = both.filter(F.struct("dv", "v") < F.struct("d", "u")).select(F.col("u").alias("top"), F.col("v").alias("mid"), F.struct("d", "u").alias("rank"))
    step = both.select(F.col("u").alias("mid"), F.col("v").alias("low"), F.struct("dv", "v").alias("low_rank"))
    wedge = down.join(step, "mid").filter(F.col("low_rank") < F.col("rank")).select("top", "low", "mid")
    pairs = wedge.groupBy("top", "low").agg(F.count("*").alias("w")).filter("w > 1")
    opposite = pairs.select(F.least("top", "low").alias("u"), F.greatest("top", "low").alias("v"), (F.col("w") * (F.col("w") - 1) / 2).cast("long").alias("cycles"))
    # The other pair of each cycle: two middles of one (top, low).
    mids = wedge.join(pairs.select("top", "low"), ["top", "low"])
    cross = mids.alias("p").join(mids.alias("q"), ["top", "low"]).filter("p.mid < q.mid").select(F.col("p.mid").alias("u"), F.col("q.mid").alias("v"), F.lit(1).cast("long").alias("cycles"))
    return opposite.unionAll(cross).groupBy("u", "v").agg(F.sum("cycles").alias("cycles"))


def paths3(edges: DataFrame) -> DataFrame:
    """Directed paths of three edges (a, b, c, d)."""
    e = edges.select("src", "dst").distinct()
    one, two, three = (e.toDF(x, y) for x, y in (("a", "b"), ("b", "c"), ("c", "d")))
    return one.join(two, "b").join(three, "c").select("a", "b", "c", "d")


def causal_latest(versions: DataFrame, entity: DataFrame, by: list[str], clock: str, value: str, wall: str) -> DataFrame:
    """For each entity row the latest version whose vector clock (a map) is at most the entity's in every entry."""
    v = versions.select(*by, F.col(clock).alias("_vc"), F.col(value).alias("_value"), F.col(wall).alias("_wall"))
    e = entity.withColumn("_row", F.monotonically_increasing_id())
    seen = F.forall(F.map_entries("_vc"), lambda x: x["value"] <= F.coalesce(F.try_element_at(F.col(clock), x["key"]), F.lit(0)))
    best = e.join(v, by).filter(seen).groupBy("_row").agg(F.max_by("_value", F.struct("_wall", "_value")).alias(value))
    return e.join(best, "_row", "left").drop("_row")


def _sorted_tokens(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda x: x != "")), " ")


def _text_ratio(x: Column, y: Column) -> Column:
    longer = F.greatest(F.length(x), F.length(y))
    return F.when(longer == 0, 100.0).otherwise(100.0 * (1 - F.levenshtein(x, y) / longer))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """0 to 100: similarity of the sorted lower-case tokens by edit distance over the longer one's length."""
    return _text_ratio(_sorted_tokens(a), _sorted_tokens(b))


def _tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda x: x != ""))


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: shared distinct tokens over all distinct tokens."""
    x, y = _tokens(a), _tokens(b)
    every = F.size(F.array_union(x, y))
    return F.when(every == 0, 100.0).otherwise(100.0 * F.size(F.array_intersect(x, y)) / every)


def fuzzy_match(left: DataFrame, right: DataFrame, key: str, reference: str, amount: str, day: str, weights: tuple[float, ...] = (0.5, 0.3, 0.2), threshold: float = 80.0, days: int = 2, description: str | None = None, rounds: int = 20) -> DataFrame:
    """Partners of rows by a weighted score of reference, amount and date (and description, a fourth weight), one to one, the best pair first.

    No pair that reaches the threshold is lost.  Greedy: each round takes the pairs
    that are best for both ends (ties by the keys), which are those that a pass over
    all pairs in descending order would take; up to ``rounds`` rounds, until none is
    left.  No list of pairs is formed: each side searches its own best partners.

    A task holds both sides' rows of a few days and of the days around them, and finds
    the best partners of the former (see operators.partners); days of very many rows
    are cut by amount, if the threshold bounds how far amounts can lie apart.  A null
    or NaN amount agrees with none.
    """
    from pyspark import cloudpickle

    from quernstone.operators import partners
    from quernstone.operators.graph import _cut

    cloudpickle.register_pickle_by_value(partners)  # executors need not have this package
    match = partners.Match
    full = 100.0 * sum(weights[:4] if description else weights[:3])
    least = (threshold - full + 100.0 * weights[1]) / (100.0 * weights[1]) if weights[1] > 0 else 0.0  # of the amounts' quotient
    span, width = max(8, 4 * days), 0.3  # days together; of a cut, in ln(amount)
    kinds = [df.schema[key].dataType for df in (left, right)]

    def prepared(df: DataFrame) -> DataFrame:
        text = F.array_join(F.array_sort(_tokens(F.col(description))), " ") if description else F.lit(None).cast("string")
        out = df.select(F.col(key).alias("k"), _sorted_tokens(F.col(reference)).alias("x"), F.col(amount).cast("double").alias("a"), F.col(day).cast("date").alias("d"), text.alias("t")).filter("d IS NOT NULL")
        return out.filter("a IS NOT NULL AND NOT isnan(a)") if least > 0 else out

    def best_of(table):
        return match(table, weights, threshold, days, description is not None).found()

    def search(one: DataFrame, other: DataFrame) -> DataFrame:
        """lk, rk, score, s: the best partner of each key, found from side s."""
        every = one.withColumn("s", F.lit(0)).unionByName(other.withColumn("s", F.lit(1)))
        kind = every.schema["k"].dataType.simpleString()
        block = lambda n: F.floor(n / span)
        n = F.unix_date("d")
        if least > 0:
            size, reach = F.ln(F.greatest(F.abs("a"), F.lit(0.01))), -math.log(least) + 1e-9
            crowded = _cut(every.groupBy(block(n).alias("_block")).count().filter(F.col("count") > CROWD).select("_block", F.lit(True).alias("_crowd")))
        every = every.withColumn("_block", F.explode(F.sequence(block(n - days), block(n + days)))).withColumn("home", F.col("_block") == block(n)).withColumn("_cell", F.lit(0).cast("long"))
        if least > 0:
            cell = lambda x: F.floor(x / width)
            every = every.join(F.broadcast(crowded), "_block", "left").withColumn("_cell", F.explode(F.when(F.col("_crowd"), F.sequence(cell(size - reach), cell(size + reach))).otherwise(F.array(F.lit(0).cast("long")))))
            every = every.withColumn("home", F.col("home") & (F.col("_crowd").isNull() | (F.col("_cell") == cell(size)))).drop("_crowd")
        found = every.groupBy("_block", "_cell").applyInArrow(best_of, f"s int, k {kind}, p {kind}, score double")
        best = found.groupBy("s", "k").agg(F.min(F.struct((-F.col("score")).alias("s"), "p")).alias("_m"))
        ours = F.col("s") == 0
        return best.select(F.when(ours, F.col("k")).otherwise(F.col("_m.p")).cast(kinds[0]).alias("lk"), F.when(ours, F.col("_m.p")).otherwise(F.col("k")).cast(kinds[1]).alias("rk"), (-F.col("_m.s")).alias("score"), "s")

    l, r, found = prepared(left), prepared(right), None
    if rounds > 1:
        l, r = _cut(l), _cut(r)
    for n in range(rounds):
        each = search(l, r)
        if n + 1 < rounds:
            each = _cut(each)
        best = each.groupBy("lk", "rk").agg(F.max("score").alias("score"), F.min("s").alias("_from"), F.max("s").alias("_to")).filter("_from < _to").drop("_from", "_to")
        if n + 1 < rounds:
            best = _cut(best)
        found = best if found is None else found.unionAll(best)
        if n + 1 == rounds or best.isEmpty():
            break
        # Rows that found no partner now find none later.
        l = _cut(l.join(each.filter("s = 0").select(F.col("lk").alias("k")), "k", "left_semi").join(best.select(F.col("lk").alias("k")), "k", "left_anti"))
        r = _cut(r.join(each.filter("s = 1").select(F.col("rk").alias("k")), "k", "left_semi").join(best.select(F.col("rk").alias("k")), "k", "left_anti"))
    return found
