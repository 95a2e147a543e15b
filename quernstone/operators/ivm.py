"""Incremental views over signed multisets: rows carry ``_diff``, +n or -n copies.

Filters, projections and unions act on deltas as they are.  A join delta is three
joins.  Everything else recomputes the keys that a delta touches, and nothing
else, and states the change as rows to retract and rows to add.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIFF = "_diff"


def signed(df: DataFrame, diff: int = 1) -> DataFrame:
    return df.withColumn(DIFF, F.lit(diff).cast("long"))


def consolidate(delta: DataFrame) -> DataFrame:
    """Equal rows once, with their net count; rows that cancel go."""
    return delta.groupBy(*[c for c in delta.columns if c != DIFF]).agg(F.sum(DIFF).alias(DIFF)).filter(F.col(DIFF) != 0)


def apply_delta(view: DataFrame, delta: DataFrame) -> DataFrame:
    """The view after the delta.  Net counts stay signed, so a retraction may come before its insertion."""
    return consolidate(view.unionByName(delta))


def visible(view: DataFrame) -> DataFrame:
    """The view's rows, as many times as they count."""
    return view.filter(F.col(DIFF) > 0).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col(DIFF).cast("int")))).drop("_n", DIFF)


def delta_filter(delta: DataFrame, predicate: Column | str) -> DataFrame:
    return delta.filter(predicate)


def delta_project(delta: DataFrame, *columns: Column | str) -> DataFrame:
    return delta.select(*columns, DIFF)


def _renamed(right: DataFrame, left: DataFrame, on: list[str]) -> DataFrame:
    """Right columns that the left has, too, are called right_<name>."""
    return right.select(*[F.col(c).alias(f"right_{c}") if c in left.columns and c not in on and c != DIFF else F.col(c) for c in right.columns])


def join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    r = _renamed(right, left, on).withColumnRenamed(DIFF, "_r")
    return left.join(r, on).withColumn(DIFF, F.col(DIFF) * F.col("_r")).drop("_r")


def delta_join(left: DataFrame, d_left: DataFrame, right: DataFrame, d_right: DataFrame, on: list[str]) -> DataFrame:
    """Change of left JOIN right: dL x R, L x dR and dL x dR."""
    return consolidate(join(d_left, right, on).unionByName(join(left, d_right, on)).unionByName(join(d_left, d_right, on)))


def _touched(table: DataFrame, keys: list[str], *deltas: DataFrame) -> DataFrame:
    """Rows of the table whose keys a delta has; null keys match null keys."""
    k = deltas[0].select(*keys)
    for d in deltas[1:]:
        k = k.unionByName(d.select(*keys))
    k = k.distinct().select(*[F.col(c).alias(f"_k_{c}") for c in keys])
    cond = None
    for c in keys:
        one = table[c].eqNullSafe(k[f"_k_{c}"])
        cond = one if cond is None else cond & one
    return table.join(k, cond, "left_semi")


def recompute(view: Callable[..., DataFrame], keys: list[str], inputs: list[DataFrame], deltas: list[DataFrame]) -> DataFrame:
    """The delta of any view that works key by key: old and new rows of the touched keys, one against the other.

    view takes the inputs' visible rows and returns plain rows.
    """
    old = [_touched(t, keys, *deltas) for t in inputs]
    new = [apply_delta(t, d) for t, d in zip(old, deltas)]
    before, after = view(*map(visible, old)), view(*map(visible, new))
    return consolidate(signed(before, -1).unionByName(signed(after)))


def delta_left_join(left: DataFrame, d_left: DataFrame, right: DataFrame, d_right: DataFrame, on: list[str]) -> DataFrame:
    """Change of left LEFT JOIN right; rows with nulls come and go with the last and the first match."""
    return recompute(lambda l, r: l.join(_renamed(r, l, on), on, "left"), on, [left, right], [d_left, d_right])


def delta_group_by(table: DataFrame, delta: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Change of a GROUP BY: -1 for the old row of a group, +1 for the new; groups that are empty have none."""
    return recompute(lambda t: t.groupBy(*keys).agg(*aggregates), keys, [table], [delta])


def delta_window(table: DataFrame, delta: DataFrame, partition: list[str], columns: dict[str, Column]) -> DataFrame:
    """Change of window columns: the touched partitions whole."""
    return recompute(lambda t: t.withColumns(columns), partition, [table], [delta])


def linear_aggregates(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, sum and avg straight from signed rows; no row is expanded."""
    d, v = F.col(DIFF), F.col(value)
    n = F.sum(F.when(v.isNotNull(), d))
    total = F.sum(d * v)
    return table.groupBy(*keys).agg(F.sum(d).alias("count"), total.alias("sum"), (total / F.nullif(n, F.lit(0))).alias("avg")).filter(F.col("count") > 0)


def retractable_extremes(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, max and count of distinct values of signed rows: net count per value first."""
    net = table.groupBy(*keys, value).agg(F.sum(DIFF).alias("_n")).filter("_n > 0")
    return net.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("distinct"))


def max_of_sums(table: DataFrame, key: str, value: str) -> DataFrame:
    sums = table.groupBy(key).agg(F.sum(F.col(DIFF) * F.col(value)).alias("s"), F.sum(DIFF).alias("n")).filter("n > 0")
    return sums.agg(F.max("s").alias("max_sum"), F.max_by(key, F.struct("s", key)).alias("key"))


def sum_of_maxes(table: DataFrame, key: str, value: str) -> DataFrame:
    return retractable_extremes(table, [key], value).agg(F.sum("max").alias("sum_max"))


def above_average(table: DataFrame, key: str, value: str) -> DataFrame:
    """Visible rows whose value exceeds the average of their key."""
    rows = visible(table)
    return rows.join(rows.groupBy(key).agg(F.avg(value).alias("_avg")), key).filter(F.col(value) > F.col("_avg")).drop("_avg")


def strategy(delta_rows: int, table_rows: int, delta_ms: float | None = None, full_ms: float | None = None, low: float = 0.3, smooth: float = 0.5, last: float | None = None) -> tuple[str, float]:
    """delta or full: by the smoothed ratio of their costs (or of the row counts before any run)."""
    ratio = delta_ms / full_ms if delta_ms is not None and full_ms else delta_rows / max(table_rows, 1)
    ratio = ratio if last is None else smooth * ratio + (1 - smooth) * last
    return ("full" if ratio > low and delta_ms is None or ratio > 1 else "delta"), ratio


# True deltas: a view's state is a table of its own, and a change reads the change and the state of the keys it touches, never the base.
def linear_state(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """State of count, sum and avg: per key the signed counts of rows and of values, and the sum."""
    d, v = F.col(DIFF), F.col(value)
    return table.groupBy(*keys).agg(F.sum(d).alias("_rows"), F.sum(F.when(v.isNotNull(), d).otherwise(0)).alias("_n"), F.sum(F.coalesce(d * v, F.lit(0.0))).alias("_s"))


def linear_apply(state: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The state after a change: what the change adds, summed up first; work in the size of state and change."""
    both = state.unionByName(linear_state(delta, keys, value))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_rows", "_n", "_s")]).filter("_rows <> 0")


def linear_view(state: DataFrame, keys: list[str]) -> DataFrame:
    """keys, count, sum, avg of the keys that have rows."""
    return state.filter("_rows > 0").select(*keys, F.col("_rows").alias("count"), F.col("_s").alias("sum"), (F.col("_s") / F.nullif("_n", F.lit(0))).alias("avg"))


def values_state(table: DataFrame, keys: list[str], value: str) -> DataFrame:
    """State of min, max and distinct count under retraction: per key and value the net count."""
    return table.groupBy(*keys, value).agg(F.sum(DIFF).alias("_n"))


def values_apply(state: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    both = state.unionByName(values_state(delta, keys, value))
    return both.groupBy(*keys, value).agg(F.sum("_n").alias("_n")).filter("_n <> 0")


def extremes(state: DataFrame, keys: list[str], value: str) -> DataFrame:
    return state.filter("_n > 0").groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("distinct"))


def extremes_apply(view: DataFrame, state: DataFrame, delta: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The view of extremes after a change, from the state after it: only touched keys are read and made anew."""
    touched = delta.select(*keys).distinct()
    return view.join(touched, keys, "left_anti").unionByName(extremes(state.join(touched, keys, "left_semi"), keys, value))
