"""Row numbers over a whole table without putting it in one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def global_row_number(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Rows numbered from 1 in a total order: ranges of the order are numbered apart, and each adds the rows of those before it.

    The ranges are persisted, so both passes see the same ones; the only window
    over everything has one row a range.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).persist()
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long"))
    size = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = size.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return own.join(before, "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def global_ntile(df: DataFrame, order: list[str], tiles: int, name: str = "tile") -> DataFrame:
    """Tiles 1 to ``tiles`` of a total order, the first ones one row larger, from global row numbers."""
    numbered = global_row_number(df, order, "_rn")
    total = df.agg(F.count("*").alias("_total"))  # one row
    size, extra = F.floor(F.col("_total") / tiles), F.col("_total") % tiles
    tile = F.when(F.col("_rn") <= extra * (size + 1), F.ceil(F.col("_rn") / (size + 1))).otherwise(extra + F.ceil((F.col("_rn") - extra * (size + 1)) / size))
    return numbered.crossJoin(F.broadcast(total)).withColumn(name, tile.cast("long")).drop("_rn", "_total")


def global_rank(df: DataFrame, column: str, name: str = "rk") -> DataFrame:
    """Rank (with gaps) by a column, ascending: distinct values are counted first, and ranges of these are summed up apart."""
    step = df.groupBy(column).agg(F.count("*").alias("_n"))
    ranged = step.repartitionByRange(column).withColumn("_part", F.spark_partition_id()).persist()
    own = ranged.withColumn("_own", F.sum("_n").over(Window.partitionBy("_part").orderBy(column)) - F.col("_n"))
    size = ranged.groupBy("_part").agg(F.sum("_n").alias("_m"))
    before = size.select("_part", (F.sum("_m").over(Window.orderBy("_part")) - F.col("_m")).alias("_before"))
    ranks = own.join(before, "_part").select(F.col(column).alias("_v"), (F.col("_own") + F.col("_before") + 1).alias(name))
    return df.join(ranks, df[column].eqNullSafe(F.col("_v"))).drop("_v")


def first_numbered(df: DataFrame, order: list, n: int, name: str = "rn") -> DataFrame:
    """The first n rows of an order with their numbers: each task passes on n rows, and only n are numbered."""
    return df.orderBy(*order).limit(n).withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def exact_quantiles(df: DataFrame, column: str, ranks: list[float]) -> list[float | None]:
    """Quantiles with linear interpolation, exact at any size: ranges of the distinct values are summed up apart, and only the values at the ranks come back."""
    step = df.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("_n"))
    ranged = step.repartitionByRange("v").withColumn("_part", F.spark_partition_id()).persist()
    sizes = {r["_part"]: r["n"] for r in ranged.groupBy("_part").agg(F.sum("_n").alias("n")).collect()}  # one row a range
    total = sum(sizes.values())
    if not total:
        ranged.unpersist()
        return [None] * len(ranks)
    before, base = {}, 0
    for part in sorted(sizes):
        before[part], base = base, base + sizes[part]
    wanted = sorted({p for r in ranks for p in (math.floor(r * (total - 1)), math.ceil(r * (total - 1)))})
    start = F.try_element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part"))
    last = start + F.sum("_n").over(Window.partitionBy("_part").orderBy("v"))
    held = ranged.withColumn("_hi", last).withColumn("_lo", F.col("_hi") - F.col("_n"))
    at = F.filter(F.array(*[F.lit(p) for p in wanted]), lambda p: (p >= F.col("_lo")) & (p < F.col("_hi")))
    value = {r.p: r.v for r in held.select("v", F.explode(at).alias("p")).collect()}  # two values a rank
    ranged.unpersist()
    out = []
    for r in ranks:
        x = r * (total - 1)
        a, b = value[math.floor(x)], value[math.ceil(x)]
        out.append(a + (b - a) * (x - math.floor(x)))
    return out
