"""Watermark strategies replayed over a recorded stream: what each would have emitted, dropped and delayed.

A recorded stream has event and processing times in seconds.  Strategies are
window functions over processing order, so a replay is one shuffle by key (fixed
and percentile strategies run over the whole stream in order, so they replay
recorded samples; per-key ones scale with the keys).
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fixed(event: str, arrival: str, key: str | None, lag: float) -> Column:
    """Largest event time so far less a fixed lag."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(arrival, event).rowsBetween(Window.unboundedPreceding, 0)
    return F.max(event).over(w) - lag


def percentile(event: str, arrival: str, key: str | None, q: float, last: int = 100, low: float = 0.0, high: float = 1e9) -> Column:
    """Largest event time less the q-quantile of the last latencies, clamped; never falls (see monotone)."""
    p = Window.partitionBy(key) if key else Window.partitionBy()
    o = p.orderBy(arrival, event)
    lag = F.percentile(F.greatest(F.col(arrival) - F.col(event), F.lit(0.0)), F.lit(q)).over(o.rowsBetween(-(last - 1), 0))
    return F.max(event).over(o.rowsBetween(Window.unboundedPreceding, 0)) - F.least(F.greatest(lag, F.lit(low)), F.lit(high))


def global_watermark(df: DataFrame, column: str, key: str) -> DataFrame:
    """One row: the least of the keys' largest watermarks, for a batch (use it in foreachBatch and feed it back)."""
    return df.groupBy(key).agg(F.max(column).alias("_m")).agg(F.min("_m").alias(column))


def monotone(df: DataFrame, column: str, arrival: str, event: str, key: str | None = None) -> DataFrame:
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(arrival, event).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(column, F.max(column).over(w))


def violations(df: DataFrame, column: str, arrival: str, event: str, key: str | None = None) -> DataFrame:
    """Rows at which the watermark falls."""
    w = (Window.partitionBy(key) if key else Window.partitionBy()).orderBy(arrival, event)
    return df.withColumn("_b", F.lag(column).over(w)).filter(F.col(column) < F.col("_b")).drop("_b")


def replay(df: DataFrame, event: str, arrival: str, watermark: str, size: float, key: str | None = None, strict: bool = False) -> DataFrame:
    """Each row with its tumbling window, whether it is late, and how long after the window's end the window closes.

    Late: the window had closed before the row came (strict: the row is older
    than the watermark before it).
    """
    p = Window.partitionBy(key) if key else Window.partitionBy()
    before = F.lag(watermark).over(p.orderBy(arrival, event))
    end = (F.floor(F.col(event) / size) + 1) * size
    out = df.withColumn("window_end", end).withColumn("_before", before)
    late = F.col("_before") > F.col(event) if strict else F.col("_before") >= F.col("window_end")
    return out.withColumn("late", F.coalesce(late, F.lit(False))).drop("_before")


def outcome(replayed: DataFrame, watermark: str, arrival: str, keys: list[str], value: str) -> DataFrame:
    """Per window: rows and sum in time, late rows, and the restated result that counts late rows, too."""
    on = ~F.col("late")
    return replayed.groupBy(*keys, "window_end").agg(F.count_if(on).alias("n"), F.sum(F.when(on, F.col(value))).alias("total"), F.count_if(F.col("late")).alias("late_n"), F.count("*").alias("restated_n"), F.sum(value).alias("restated_total"))


def completeness(replayed: DataFrame) -> DataFrame:
    return replayed.agg((F.count_if(~F.col("late")) / F.count("*")).alias("completeness"), F.count_if(F.col("late")).alias("late"))


def pareto(results: list[tuple[str, float, float]]) -> list[str]:
    """Strategies (name, completeness, latency) that no other beats on both."""
    return [n for n, c, l in results if not any(c2 >= c and l2 <= l and (c2 > c or l2 < l) for _, c2, l2 in results)]


def lognormal_delay(df: DataFrame, event: str, arrival: str, keys: list[str], delta: float) -> DataFrame:
    """Per key the delay that all but a share delta of rows stay below, under a lognormal fit."""
    d = F.ln(F.greatest(F.col(arrival) - F.col(event), F.lit(1e-9)))
    z = NormalDist().inv_cdf(1 - delta)
    return df.groupBy(*keys).agg(F.exp(F.avg(d) + z * F.coalesce(F.stddev_samp(d), F.lit(0.0))).alias("safe_delay"), F.count("*").alias("n"))


def tail_delay(df: DataFrame, event: str, arrival: str, keys: list[str], delta: float, threshold: float = 0.9) -> DataFrame:
    """The same under a generalised Pareto tail over the ``threshold`` quantile, fitted by moments."""
    d = df.withColumn("_d", F.greatest(F.col(arrival) - F.col(event), F.lit(0.0)))
    t = d.groupBy(*keys).agg(F.percentile_approx("_d", threshold, 10_000).alias("u"), F.count("*").alias("n"))
    x = d.join(t, keys).filter("_d > u").groupBy(*keys).agg(F.max("u").alias("u"), F.max("n").alias("n"), F.count("*").alias("k"), F.avg(F.col("_d") - F.col("u")).alias("m"), F.var_samp(F.col("_d") - F.col("u")).alias("v"))
    r = F.col("m") * F.col("m") / F.nullif(F.col("v"), F.lit(0.0))
    xi, sigma = F.coalesce(0.5 * (1 - r), F.lit(0.0)), F.coalesce(0.5 * F.col("m") * (1 + r), F.col("m"))
    q = F.col("n") * delta / F.col("k")
    quantile = F.when(F.abs(xi) < 1e-6, F.col("u") - sigma * F.ln(q)).otherwise(F.col("u") + sigma / xi * (F.pow(q, -xi) - 1))
    return x.select(*keys, quantile.alias("safe_delay"))


def advance(now: float, delays: dict[str, float], last: float = -math.inf) -> float:
    """min over keys of now less the safe delay, never falling."""
    return max(last, min((now - max(0.0, d) for d in delays.values()), default=last))


class Pid:
    """Next batch interval from the error of a latency target, with a clamped integral."""

    def __init__(self, target: float, low: float, high: float, kp: float = 0.4, ki: float = 0.05, kd: float = 0.1, bound: float = 10.0):
        self.target, self.low, self.high, self.k, self.bound = target, low, high, (kp, ki, kd), bound
        self.total, self.before, self.value = 0.0, None, low

    def update(self, latency: float, pressure: float = 0.0) -> float:
        error = (self.target - latency) / self.target - pressure
        self.total = max(-self.bound, min(self.bound, self.total + error))
        slope = 0.0 if self.before is None else error - self.before
        self.before = error
        kp, ki, kd = self.k
        self.value = max(self.low, min(self.high, self.value * (1 + kp * error + ki * self.total + kd * slope)))
        return self.value


class TokenBucket:
    """How many rows may pass: ``rate`` tokens a second, ``burst`` at most held; take() gives what there is, of what is wanted."""

    def __init__(self, rate: float, burst: float, now: float = 0.0):
        self.rate, self.burst, self.held, self.at = rate, burst, burst, now

    def take(self, wanted: float, now: float) -> float:
        self.held = min(self.burst, self.held + self.rate * max(0.0, now - self.at))
        self.at = max(self.at, now)
        given = min(wanted, self.held)
        self.held -= given
        return given
