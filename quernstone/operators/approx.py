"""Approximate answers with error bounds from weighted samples, and private ones.

Randomness is a hash of a row's key and a seed, so a sample is the same whatever
the partitioning.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEIGHT = "_weight"


def uniform01(*keys: str | Column, seed: int = 0) -> Column:
    """A uniform number in (0, 1) from the keys."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(k) if isinstance(k, str) else k for k in keys]), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def uniform_coreset(df: DataFrame, key: str, m: int, seed: int = 0) -> DataFrame:
    """m rows without replacement, each of weight n / m."""
    n = df.agg(F.count("*").cast("double").alias("_n"))
    return df.withColumn("_u", uniform01(key, seed=seed)).orderBy("_u", key).limit(m).crossJoin(F.broadcast(n)).withColumn(WEIGHT, F.greatest(F.col("_n") / m, F.lit(1.0))).drop("_u", "_n")  # one row is broadcast


def sensitivity_coreset(df: DataFrame, key: str, value: str, m: int, seed: int = 0) -> DataFrame:
    """Poisson sampling with probability min(1, m |v| / sum |v|): about m rows, of weight 1 / probability."""
    total = df.agg(F.sum(F.abs(F.col(value))).alias("_s"))
    p = F.least(F.lit(1.0), m * F.abs(F.col(value)) / F.col("_s"))
    return df.crossJoin(F.broadcast(total)).withColumn("_p", p).filter(uniform01(key, seed=seed) < F.col("_p")).withColumn(WEIGHT, 1 / F.col("_p")).drop("_s", "_p")


def merge_coresets(parts: list[DataFrame], key: str, m: int, seed: int = 0) -> DataFrame:
    """Union of weighted samples, reduced to about m rows by their weight; estimates stay unbiased."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    total = every.agg(F.sum(WEIGHT).alias("_s"))
    p = F.least(F.lit(1.0), m * F.col(WEIGHT) / F.col("_s"))
    return every.crossJoin(F.broadcast(total)).withColumn("_p", p).filter(uniform01(key, seed=seed + 7) < F.col("_p")).withColumn(WEIGHT, F.col(WEIGHT) / F.col("_p")).drop("_s", "_p")


def estimate(sample: DataFrame, value: str, predicate: Column | None = None, confidence: float = 0.95) -> DataFrame:
    """count, sum and avg with the half widths of their intervals."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    on = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))
    w = F.when(on, F.col(WEIGHT)).otherwise(0.0)
    v = w * F.col(value)
    spread = lambda c: z * F.sqrt(F.sum(c * c * (1 - 1 / F.greatest(F.col(WEIGHT), F.lit(1.0)))))
    return sample.agg(F.sum(w).alias("count"), spread(w).alias("count_ci"), F.sum(v).alias("sum"), spread(v).alias("sum_ci"), (F.sum(v) / F.nullif(F.sum(w), F.lit(0.0))).alias("avg"))


def coverage(df: DataFrame, key: str, value: str, m: int, seeds: range, confidence: float = 0.95, kind: str = "sensitivity") -> float:
    """Share of the samples' intervals that hold the true sum: one sample a seed, all in one job."""
    truth = df.agg(F.sum(value).alias("_t"))
    every = None
    for seed in seeds:
        sample = sensitivity_coreset(df, key, value, m, seed) if kind == "sensitivity" else uniform_coreset(df, key, m, seed)
        one = estimate(sample, value, confidence=confidence).select("sum", "sum_ci")
        every = one if every is None else every.unionAll(one)
    return every.crossJoin(F.broadcast(truth)).agg(F.avg((F.abs(F.col("sum") - F.col("_t")) <= F.col("sum_ci")).cast("double"))).first()[0]


def coreset_size(epsilon: float, delta: float, vc: int = 1) -> int:
    return math.ceil((vc + math.log(1 / delta)) / epsilon**2)


def hoeffding_size(epsilon: float, delta: float) -> int:
    return math.ceil(math.log(2 / delta) / (2 * epsilon**2))


def laplace_noise(scale: float | Column, *keys: str | Column, seed: int) -> Column:
    """Laplace noise by the inverse of its distribution; for a release the seed must be secret."""
    u = uniform01(*keys, seed=seed) - 0.5
    return -scale * F.signum(u) * F.log1p(-2 * F.abs(u))


def gaussian_noise(sigma: float | Column, *keys: str | Column, seed: int) -> Column:
    return sigma * F.sqrt(-2 * F.ln(uniform01(*keys, seed=seed))) * F.cos(2 * math.pi * uniform01(*keys, seed=seed + 1))


def gaussian_sigma(sensitivity: float, epsilon: float, delta: float) -> float:
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def private_counts(df: DataFrame, keys: list[str], epsilon: float, seed: int) -> DataFrame:
    """Histogram with Laplace noise of scale 1 / epsilon on every count."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("noisy", F.col("n") + laplace_noise(1 / epsilon, *keys, seed=seed))


def private_mean(df: DataFrame, value: str, low: float, high: float, epsilon: float, seed: int) -> DataFrame:
    v = F.least(F.greatest(F.col(value), F.lit(low)), F.lit(high))
    return df.agg(F.avg(v).alias("mean"), F.count(value).alias("n")).withColumn("noisy", F.col("mean") + laplace_noise(F.lit(high - low) / (F.col("n") * epsilon), F.col("n"), seed=seed))


def randomized_response_histogram(df: DataFrame, key: str, value: str, domain: list[str], epsilon: float, seed: int) -> DataFrame:
    """k-ary randomized response, de-biased, clipped at 0 and normalised: value, share."""
    k = len(domain)
    p = math.exp(epsilon) / (math.exp(epsilon) + k - 1)
    names = F.array(*[F.lit(d) for d in domain])
    other = F.element_at(F.array_except(names, F.array(F.col(value))), (F.floor(uniform01(key, seed=seed + 1) * (k - 1)) + 1).cast("int"))
    said = df.filter(F.col(value).isin(domain)).select(F.when(uniform01(key, seed=seed) < p, F.col(value)).otherwise(other).alias("value"))
    q = (1 - p) / (k - 1)
    counts = said.groupBy("value").agg(F.count("*").alias("c"))
    total = said.agg(F.count("*").alias("n"))
    raw = counts.crossJoin(F.broadcast(total)).withColumn("s", F.greatest(F.lit(0.0), (F.col("c") / F.col("n") - q) / (p - q)))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("s").alias("t")))).select("value", (F.col("s") / F.col("t")).alias("share"))


class PrivacyLedger:
    """Accepts or rejects queries against an epsilon budget; Gaussian releases compose by zCDP."""

    def __init__(self, epsilon: float, delta: float = 1e-6):
        self.epsilon, self.delta, self.pure, self.rho = epsilon, delta, 0.0, 0.0

    def spent(self, pure: float = 0.0, rho: float = 0.0) -> float:
        r = self.rho + rho
        return self.pure + pure + (r + 2 * math.sqrt(r * math.log(1 / self.delta)) if r else 0.0)

    def plan(self, epsilon: float = 0.0, sigma: float | None = None, sensitivity: float = 1.0) -> tuple[str, float]:
        """("accept", spent), ("rewrite", the largest epsilon that fits) or ("reject", spent so far)."""
        rho = (sensitivity / sigma) ** 2 / 2 if sigma else 0.0
        if self.spent(epsilon, rho) <= self.epsilon + 1e-12:
            return "accept", self.spent(epsilon, rho)
        left = self.epsilon - self.spent()
        return ("rewrite", left) if left > 0 and epsilon > 0 and not sigma else ("reject", self.spent())

    def charge(self, epsilon: float = 0.0, sigma: float | None = None, sensitivity: float = 1.0) -> None:
        if self.plan(epsilon, sigma, sensitivity)[0] != "accept":
            raise ValueError("the budget does not allow this query")
        self.pure += epsilon
        self.rho += (sensitivity / sigma) ** 2 / 2 if sigma else 0.0
