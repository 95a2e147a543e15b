"""Aggregations beyond GROUP BY: sketches, mergeable rollups, concentration, estimates, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.windows import global_row_number


def vwap(price: str, volume: str) -> Column:
    """Volume-weighted average price; the plain average without volume."""
    return F.when(F.sum(volume) > 0, F.sum(F.col(price) * F.col(volume)) / F.sum(volume)).otherwise(F.avg(price))


def hll_count(column: str, bits: int = 12) -> Column:
    return F.hll_sketch_estimate(F.hll_sketch_agg(column, F.lit(bits)))


def hll_rollup(df: DataFrame, keys: list[str], column: str, bits: int = 12) -> DataFrame:
    """keys and a binary sketch that merges over any coarser keys."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(column, F.lit(bits)).alias("sketch"))


def hll_merge(rollup: DataFrame, keys: list[str]) -> DataFrame:
    return rollup.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct"))


def kll_quantiles(df: DataFrame, keys: list[str], column: str, ranks: list[float]) -> DataFrame:
    """Quantiles by a KLL sketch: one pass, bounded state."""
    names = {f"q{int(r * 1000)}": F.expr(f"kll_sketch_get_quantile_double(kll_sketch_agg_double(CAST({column} AS DOUBLE)), {r}D)") for r in ranks}
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in names.items()])


def minute_rollup(df: DataFrame, ts: str, keys: list[str], value: str) -> DataFrame:
    """Per minute: count, sum, minimum, maximum and a KLL sketch, all of which merge."""
    return df.groupBy(F.date_trunc("minute", ts).alias("minute"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"), F.expr(f"kll_sketch_agg_double(CAST({value} AS DOUBLE))").alias("kll"))


def merge_rollup(rollup: DataFrame, keys: list[str | Column], rank: float = 0.95) -> DataFrame:
    return rollup.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"), F.expr(f"kll_sketch_get_quantile_double(kll_merge_agg_double(kll), {rank}D)").alias("quantile"))


def concentration(df: DataFrame, key: str, value: str, top: int = 3) -> DataFrame:
    """One row: Herfindahl index, Gini coefficient and share of the top keys, of the keys' totals."""
    t = df.groupBy(key).agg(F.sum(value).alias("v"))
    total = t.agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    r = global_row_number(t, ["v", key], "i").crossJoin(F.broadcast(total))  # one row
    r = r.withColumn("back", F.col("n") - F.col("i") + 1)
    gini = 2 * F.sum(F.col("i") * F.col("v")) / (F.max("n") * F.max("s")) - (F.max("n") + 1) / F.max("n")
    return r.agg(F.sum((F.col("v") / F.col("s")) ** 2).alias("hhi"), gini.alias("gini"), F.sum(F.when(F.col("back") <= top, F.col("v") / F.col("s")).otherwise(0.0)).alias("top_share"))


def frequency_skew(df: DataFrame, column: str, top: int = 3) -> DataFrame:
    """Coefficient of variation of the values' counts, and the share of the most frequent ones."""
    c = df.groupBy(column).agg(F.count("*").alias("n"))
    heavy = c.orderBy(F.desc("n"), column).limit(top).agg(F.sum("n").alias("h"))
    return c.agg((F.stddev_pop("n") / F.avg("n")).alias("cv"), F.sum("n").alias("rows"), F.count("*").alias("distinct")).crossJoin(F.broadcast(heavy)).select("cv", "distinct", (F.col("h") / F.col("rows")).alias("top_share"))


def chao1(df: DataFrame, column: str) -> DataFrame:
    """Estimated number of distinct values from those seen once and twice."""
    c = df.groupBy(column).agg(F.count("*").alias("n"))
    one, two = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    return c.agg(F.count("*").alias("seen"), (F.count("*") + F.when(two > 0, one * one / (2 * two)).otherwise(one * (one - 1) / 2)).cast("double").alias("chao1"))


def geometric_inflation(df: DataFrame, period: str, product: str, price: str) -> DataFrame:
    """Per period the geometric mean, over products, of the change of their median prices."""
    m = df.groupBy(product, period).agg(F.median(price).alias("p"))
    w = Window.partitionBy(product).orderBy(period)
    r = m.withColumn("r", F.ln(F.col("p") / F.lag("p").over(w))).filter("r IS NOT NULL")
    return r.groupBy(period).agg((F.exp(F.avg("r")) - 1).alias("inflation"), F.count("*").alias("products"))


def equi_depth(df: DataFrame, column: str, buckets: int = 20, accuracy: int = 10_000) -> DataFrame:
    """Histogram of about equal counts: bucket, lo, hi, n, ndv.  Boundaries are approximate quantiles."""
    cuts = df.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], accuracy).alias("c"))
    b = df.select(F.col(column).alias("v")).filter("v IS NOT NULL").crossJoin(F.broadcast(cuts))  # one row
    b = b.withColumn("bucket", F.size(F.filter("c", lambda x: x < F.col("v"))))
    return b.groupBy("bucket").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"), F.countDistinct("v").alias("ndv"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass over the table: column, rows, nulls, distinct (approximate), min, max, as text."""
    aggs = []
    for c in columns:
        aggs += [F.struct(F.lit(c).alias("column"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("min"), F.max(c).cast("string").alias("max"))]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def g_counter(df: DataFrame, node: str, value: str) -> DataFrame:
    """Grow-only counter: each node's maximum, summed."""
    return df.groupBy(node).agg(F.max(value).alias("v")).agg(F.sum("v").alias("total"))


def pn_counter(df: DataFrame, node: str, up: str, down: str) -> DataFrame:
    return df.groupBy(node).agg(F.max(up).alias("u"), F.max(down).alias("d")).agg((F.sum("u") - F.sum("d")).alias("total"))


def or_set(adds: DataFrame, removes: DataFrame, element: str, tag: str) -> DataFrame:
    """Elements with a tag that no tombstone names."""
    return adds.join(removes.select(tag), tag, "left_anti").select(element).distinct()
