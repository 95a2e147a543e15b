"""Relational algebra over annotated tuples, for any semiring given as Column builders.

Relations carry an annotation column ``_k``.  How-provenance is kept as rows
(tuple, monomial, coefficient), so a polynomial may be of any size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = "_k"


@dataclass(frozen=True)
class Semiring:
    """plus is an aggregate over the column named _k; times takes two columns."""

    plus: Callable[[], Column]
    times: Callable[[Column, Column], Column]
    base: Callable[[Column], Column]


BAG = Semiring(lambda: F.sum(K), lambda a, b: a * b, lambda t: F.lit(1).cast("long"))
BOOLEAN = Semiring(lambda: F.bool_or(K), lambda a, b: a & b, lambda t: F.lit(True))
_tidy = lambda a: F.array_sort(F.array_distinct(a))
WHY = Semiring(
    lambda: _tidy(F.flatten(F.collect_list(K))),
    lambda a, b: _tidy(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.array_sort(F.array_union(x, y)))))),
    lambda t: F.array(F.array(t)),
)
#: 1 - product(1 - p) and product; exact only where the tuples are independent.
PROBABILITY = Semiring(lambda: F.when(F.max(K) >= 1, 1.0).otherwise(1 - F.exp(F.sum(F.log1p(-F.when(F.col(K) < 1, F.col(K)).otherwise(0.0))))), lambda a, b: a * b, lambda p: p)


def annotate(df: DataFrame, ring: Semiring, token: Column) -> DataFrame:
    return df.withColumn(K, ring.base(token))


def select(df: DataFrame, predicate: Column | str) -> DataFrame:
    return df.filter(predicate)


def project(df: DataFrame, ring: Semiring, columns: list[str]) -> DataFrame:
    """Equal projections are one tuple, their annotations added."""
    return df.groupBy(*columns).agg(ring.plus().alias(K))


def union(a: DataFrame, b: DataFrame, ring: Semiring) -> DataFrame:
    return project(a.unionByName(b), ring, [c for c in a.columns if c != K])


def join(a: DataFrame, b: DataFrame, ring: Semiring, on: list[str]) -> DataFrame:
    other = b.withColumnRenamed(K, "_k2")
    out = a.join(other, on).withColumn(K, ring.times(F.col(K), F.col("_k2"))).drop("_k2")
    return project(out, ring, [c for c in out.columns if c != K])


def how(df: DataFrame, token: Column) -> DataFrame:
    """Rows of a polynomial: the monomial as a sorted array of tokens, and its coefficient."""
    return df.withColumn("_m", F.array(token)).withColumn("_c", F.lit(1).cast("long"))


def how_project(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns, "_m").agg(F.sum("_c").alias("_c"))


def how_join(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    other = b.withColumnRenamed("_m", "_m2").withColumnRenamed("_c", "_c2")
    out = a.join(other, on).withColumn("_m", F.array_sort(F.concat("_m", "_m2"))).withColumn("_c", F.col("_c") * F.col("_c2")).drop("_m2", "_c2")
    return how_project(out, [c for c in out.columns if c not in ("_m", "_c")])


def lineage(why: DataFrame) -> DataFrame:
    """All tokens of a tuple's witnesses."""
    return why.withColumn("lineage", _tidy(F.flatten(K))).drop(K)


def multiplicity(polynomial: DataFrame, columns: list[str]) -> DataFrame:
    return polynomial.groupBy(*columns).agg(F.sum("_c").alias("multiplicity"))


def exact_probability(witnesses: list[list[str]], p: dict[str, float], most: int = 18) -> float:
    """Probability that one witness is whole, by the truth table of at most ``most`` independent tokens."""
    tokens = sorted({t for w in witnesses for t in w})
    if len(tokens) > most:
        raise ValueError(f"more than {most} tokens")
    total = 0.0
    for bits in range(1 << len(tokens)):
        on = {t for i, t in enumerate(tokens) if bits >> i & 1}
        if any(set(w) <= on for w in witnesses):
            chance = 1.0
            for t in tokens:
                chance *= p[t] if t in on else 1 - p[t]
            total += chance
    return total
