"""Data quality, contracts, drift, reconciliation and rule-based risk."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators.windows import exact_quantiles


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """One pass: column, completeness, uniqueness (distinct over non-null)."""
    one = [F.struct(F.lit(c).alias("column"), (F.count(c) / F.count("*")).alias("completeness"), (F.countDistinct(c) / F.greatest(F.count(c), F.lit(1))).alias("uniqueness")) for c in columns]
    return df.agg(F.array(*one).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def table_score(df: DataFrame, columns: list[str], key: str, valid: Column) -> DataFrame:
    """0.4 completeness + 0.4 uniqueness of the key + 0.2 validity."""
    full = sum((F.count(c) for c in columns[1:]), F.count(columns[0])) / (F.count("*") * len(columns))
    return df.agg((0.4 * full + 0.4 * F.countDistinct(key) / F.count("*") + 0.2 * F.count_if(valid) / F.count("*")).alias("score"))


def expect_all_or_drop(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet every rule, and a row of failures per rule; a null verdict fails."""
    ok = None
    for c in rules.values():
        c = F.coalesce(c, F.lit(False))
        ok = c if ok is None else ok & c
    failures = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return df.filter(ok), failures


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows that break a rule, with the rules that they break."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn("_broken", broken).filter(F.size("_broken") > 0)


def contract_violations(df: DataFrame, contract: dict[str, dict]) -> DataFrame:
    """field, rule, violations; rules: required, type, min, max, allowed, unique, pattern.  Missing columns break required."""
    checks: list[tuple[str, str, Column]] = []
    for name, rule in contract.items():
        if name not in df.columns:
            if rule.get("required"):
                checks.append((name, "required", F.count("*")))
            continue
        c = F.col(name)
        if rule.get("required"):
            checks.append((name, "required", F.count_if(c.isNull())))
        if "type" in rule:
            checks.append((name, "type", F.count_if(c.isNotNull() & F.expr(f"try_cast(`{name}` AS {rule['type']})").isNull())))
        if "min" in rule:
            checks.append((name, "min", F.count_if(c < rule["min"])))
        if "max" in rule:
            checks.append((name, "max", F.count_if(c > rule["max"])))
        if "allowed" in rule:
            checks.append((name, "allowed", F.count_if(~c.isin(rule["allowed"]))))
        if "pattern" in rule:
            checks.append((name, "pattern", F.count_if(~c.rlike(rule["pattern"]))))
        if rule.get("unique"):
            checks.append((name, "unique", F.count(name) - F.countDistinct(name)))
    rows = [F.struct(F.lit(n).alias("field"), F.lit(r).alias("rule"), v.cast("long").alias("violations")) for n, r, v in checks]
    return df.agg(F.array(*rows).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def beta_posterior(success: int, failure: int, threshold: float, alpha: float = 1.0, beta: float = 1.0) -> tuple[float, float]:
    """Mean of the posterior rate, and the probability that the rate exceeds the threshold."""
    a, b = alpha + success, beta + failure
    return a / (a + b), 1 - incomplete_beta(a, b, threshold)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 300):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + t * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + t / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-13:
            break
    return front * h


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square > x): the regularised upper incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return max(0.0, 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a)))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _shares(df: DataFrame, bucket: Column, name: str) -> DataFrame:
    n = df.filter(bucket.isNotNull()).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("b", (F.col("n") / F.col("t")).alias(name))


def psi(reference: DataFrame, current: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Population stability index over the reference's quantile bins; values beyond its range are left out."""
    edge = sorted({float(x) for x in exact_quantiles(reference, column, [i / bins for i in range(bins + 1)]) if x is not None})
    if len(edge) < 2:
        return reference.sparkSession.createDataFrame([(0.0,)], "psi double")
    bucket = F.when((F.col(column) >= edge[0]) & (F.col(column) <= edge[-1]), F.least(F.size(F.filter(F.array(*map(F.lit, edge)), lambda e: e <= F.col(column))), F.lit(len(edge) - 1)))
    every = reference.sparkSession.range(1, len(edge)).withColumnRenamed("id", "b")
    j = every.join(_shares(reference, bucket, "p"), "b", "left").join(_shares(current, bucket, "q"), "b", "left")
    p, q = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(1e-6)) for c in ("p", "q"))
    return j.agg(F.sum((q - p) * F.ln(q / p)).alias("psi"))


def js_divergence(reference: DataFrame, current: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Jensen-Shannon divergence (natural logarithm) over equal bins of the common range."""
    lo, hi = reference.select(column).unionAll(current.select(column)).agg(F.min(column), F.max(column)).first()
    if lo is None or lo == hi:
        return reference.sparkSession.createDataFrame([(0.0,)], "js double")
    bucket = F.least(F.floor((F.col(column) - lo) / ((hi - lo) / bins)), F.lit(bins - 1))
    j = _shares(reference, bucket, "p").join(_shares(current, bucket, "q"), "b", "full").select(F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / m)).otherwise(0.0)
    return j.agg((0.5 * F.sum(part("p")) + 0.5 * F.sum(part("q"))).alias("js"))


def ks_statistic(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Kolmogorov-Smirnov statistic, exact at any size: ranges of the distinct values are summed up apart, and each adds the counts of those before it.

    The ranges are persisted, so both passes see the same ones; the only window
    over everything has one row a range.
    """
    both = reference.select(F.col(column).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(current.select(F.col(column).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))).filter("v IS NOT NULL")
    step = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    ranged = step.repartitionByRange("v").withColumn("_part", F.spark_partition_id()).persist()
    w, ahead = Window.partitionBy("_part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0), Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.select("_part", F.sum("a").over(w).alias("a"), F.sum("b").over(w).alias("b"))
    size = ranged.groupBy("_part").agg(F.sum("a").alias("pa"), F.sum("b").alias("pb"))
    before = size.select("_part", *[(F.sum(c).over(ahead) - F.col(c)).alias(f"{c}_before") for c in ("pa", "pb")], *[F.sum(c).over(Window.partitionBy()).alias(f"{c}_all") for c in ("pa", "pb")])
    share = lambda c: (F.col(c) + F.col(f"p{c}_before")) / F.col(f"p{c}_all")
    return own.join(before, "_part").select(F.abs(share("a") - share("b")).alias("d")).agg(F.max("d").alias("ks"))


def ks_p_value(d: float, n: int, m: int) -> float:
    t = d * math.sqrt(n * m / (n + m))
    return 1.0 if t < 1e-3 else min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def chi_square(reference: DataFrame, current: DataFrame, column: str) -> tuple[float, float, int]:
    """Statistic, p-value and degrees of freedom of the current counts against the reference's shares; cells that expect under 5 are left out."""
    a = reference.groupBy(column).agg(F.count("*").alias("e"))
    b = current.groupBy(column).agg(F.count("*").alias("o"))
    j = a.join(b, a[column].eqNullSafe(b[column]), "full").select(F.coalesce("e", F.lit(0)).alias("e"), F.coalesce("o", F.lit(0)).alias("o"))
    s = j.crossJoin(F.broadcast(j.agg(F.sum("e").alias("te"), F.sum("o").alias("to")))).withColumn("x", F.col("e") * F.col("to") / F.col("te")).filter("x >= 5")
    stat, cells = s.agg(F.sum((F.col("o") - F.col("x")) ** 2 / F.col("x")), F.count("*")).first()
    dof = max(0, (cells or 0) - 1)
    return float(stat or 0.0), chi2_tail(float(stat or 0.0), dof) if dof else 1.0, dof


def compare_views(left: DataFrame, right: DataFrame, key: str, exact: list[str], relative: list[str], tolerance: float = 1e-4) -> DataFrame:
    """key, status: missing_left, missing_right, match, within_tolerance or mismatch."""
    j = left.alias("l").join(right.alias("r"), F.col(f"l.{key}") == F.col(f"r.{key}"), "full")
    same = lambda c: F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    near = lambda c: same(c) | (F.abs(F.col(f"l.{c}") - F.col(f"r.{c}")) <= tolerance * F.greatest(F.abs(F.col(f"l.{c}")), F.abs(F.col(f"r.{c}"))))
    allof = lambda cs: F.forall(F.array(F.lit(True), *[F.coalesce(c, F.lit(False)) for c in cs]), lambda x: x)
    status = F.when(F.col(f"l.{key}").isNull(), "missing_left").when(F.col(f"r.{key}").isNull(), "missing_right").when(allof([same(c) for c in exact + relative]), "match").when(allof([same(c) for c in exact] + [near(c) for c in relative]), "within_tolerance").otherwise("mismatch")
    return j.select(F.coalesce(f"l.{key}", f"r.{key}").alias(key), status.alias("status"))


def reconciliation(raw: DataFrame, out: DataFrame, key: str, amount: str, group: str, branch: str | None = None) -> DataFrame:
    """check, raw, transformed: counts, totals, per-group (and per-branch) totals that differ, ids missing and extra."""
    totals = lambda d, n: d.agg(F.count("*").cast("double").alias(f"{n}_n"), F.sum(amount).alias(f"{n}_s"))

    def off(by: str, name: str) -> DataFrame:
        a, b = (d.groupBy(by).agg(F.round(F.sum(amount), 2).alias(n)) for d, n in ((raw, "a"), (out, "b")))
        return a.join(b, a[by].eqNullSafe(b[by]), "full").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).cast("double").alias(name))

    missing = raw.join(out, key, "left_anti").agg(F.count("*").cast("double").alias("missing"))
    extra = out.join(raw, key, "left_anti").agg(F.count("*").cast("double").alias("extra"))
    row = totals(raw, "r").crossJoin(totals(out, "o")).crossJoin(off(group, "g_off")).crossJoin(missing).crossJoin(extra)  # one row each
    s = lambda n, a, b: F.struct(F.lit(n).alias("check"), F.round(a, 2).alias("raw"), F.round(b, 2).alias("transformed"))
    zero = F.lit(0.0)
    checks = [s("count", F.col("r_n"), F.col("o_n")), s("total", F.col("r_s"), F.col("o_s")), s("groups_off", zero, F.col("g_off")), s("missing", zero, F.col("missing")), s("extra", zero, F.col("extra"))]
    if branch:
        row = row.crossJoin(off(branch, "b_off"))
        checks.append(s("branches_off", zero, F.col("b_off")))
    return row.select(F.explode(F.array(*checks)).alias("x")).select("x.*")


def invariants(before: DataFrame, after: DataFrame, total: str, not_null: list[str], bounds: dict[str, tuple[float, float]], distinct: str, ordered: tuple[str, str] | None = None, by: list[str] | None = None) -> DataFrame:
    """invariant, holds: row_count and sum of ``total`` kept, no nulls, values within bounds, distinct values kept, and ``ordered`` = (order, column): the column never falls in that order within ``by``."""
    shape = lambda d, n: d.agg(F.count("*").alias(f"{n}_n"), F.sum(total).alias(f"{n}_s"), F.countDistinct(distinct).alias(f"{n}_d"))
    inside = [F.count_if((F.col(c) < lo) | (F.col(c) > hi)) for c, (lo, hi) in bounds.items()]
    now = after.agg(sum((F.count_if(F.col(c).isNull()) for c in not_null), F.lit(0)).alias("nulls"), sum(inside, F.lit(0)).alias("out"))
    row = shape(before, "b").crossJoin(shape(after, "a")).crossJoin(now)  # one row each
    close = F.abs(F.col("b_s") - F.col("a_s")) <= 1e-9 * F.greatest(F.abs("b_s"), F.lit(1.0))
    held = [("row_count", F.col("b_n") == F.col("a_n")), ("sum", close), ("no_nulls", F.col("nulls") == 0), ("range", F.col("out") == 0), ("distinct_preserved", F.col("b_d") == F.col("a_d"))]
    if ordered:
        order, column = ordered
        fell = after.withColumn("_b", F.lag(column).over(Window.partitionBy(*(by or [])).orderBy(order))).agg(F.count_if(F.col(column) < F.col("_b")).alias("falls"))
        row = row.crossJoin(fell)
        held.append(("monotone", F.col("falls") == 0))
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("invariant"), c.alias("holds")) for n, c in held])).alias("x")).select("x.*")


def training_serving_skew(training: DataFrame, serving: DataFrame, columns: list[str], most_shift: float = 0.5, most_nulls: float = 0.05) -> DataFrame:
    """feature, shift (of the means, in training deviations), null_gap, skewed: one pass over each side."""
    def side(d: DataFrame, n: str) -> DataFrame:
        return d.agg(*[x for c in columns for x in (F.avg(c).alias(f"{n}_m_{c}"), F.stddev_pop(c).alias(f"{n}_s_{c}"), F.avg(F.col(c).isNull().cast("int")).alias(f"{n}_z_{c}"))])

    row = side(training, "t").crossJoin(side(serving, "v"))  # one row each
    made = []
    for c in columns:
        shift = F.abs(F.col(f"v_m_{c}") - F.col(f"t_m_{c}")) / F.nullif(F.col(f"t_s_{c}"), F.lit(0.0))
        gap = F.abs(F.col(f"v_z_{c}") - F.col(f"t_z_{c}"))
        made.append(F.struct(F.lit(c).alias("feature"), F.coalesce(shift, F.lit(0.0)).alias("shift"), gap.alias("null_gap"), ((F.coalesce(shift, F.lit(0.0)) > most_shift) | (gap > most_nulls)).alias("skewed")))
    return row.select(F.explode(F.array(*made)).alias("x")).select("x.*")


def flag_rules(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, rule: every rule that a row breaks, each pair of key and rule once; one pass, not one a rule."""
    fired = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(key, F.explode(fired).alias("rule")).dropDuplicates([key, "rule"])


def impossible_travel(df: DataFrame, account: str, ts: str, lat: str, lon: str, seconds: float, km: float, order: str | None = None) -> DataFrame:
    """Rows whose account was at least ``km`` away at its last event, at most ``seconds`` before: with km_moved and seconds_since."""
    from quernstone.functions.scalar import haversine

    w = Window.partitionBy(account).orderBy(ts, *([order] if order else []))
    at = F.col(ts).cast("timestamp").cast("double")
    out = df.withColumns({"_t": F.lag(at).over(w), "_lat": F.lag(lat).over(w), "_lon": F.lag(lon).over(w)})
    out = out.withColumns({"seconds_since": at - F.col("_t"), "km_moved": haversine(F.col("_lat"), F.col("_lon"), F.col(lat), F.col(lon))})
    return out.filter((F.col("seconds_since") <= seconds) & (F.col("km_moved") >= km)).drop("_t", "_lat", "_lon")


def classify_discrepancy(amount_a: str, amount_b: str, day_a: str, day_b: str, rounding: float = 1.0, timing: int = 2) -> Column:
    gap, days = F.abs(F.col(amount_a) - F.col(amount_b)), F.abs(F.datediff(day_a, day_b))
    return F.when(F.col(amount_a).isNull() | F.col(amount_b).isNull(), "missing").when((gap == 0) & (days == 0), "none").when((gap > rounding) & (days > timing), "multiple").when(gap > rounding, "amount").when((gap > 0) & (days == 0), "rounding").when(days > timing, "date").otherwise("timing")


def risk_score(rules: dict[str, tuple[Column, int]]) -> tuple[Column, Column, Column]:
    """Signals (array of rule names), score (sum of points, at most 100) and severity (bands at 35, 60 and 80)."""
    fired = {n: F.coalesce(c, F.lit(False)) for n, (c, _) in rules.items()}
    signals = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in fired.items()]), lambda x: x.isNotNull())
    score = F.lit(0)
    for n, (_, points) in rules.items():
        score = score + F.when(fired[n], points).otherwise(0)
    score = F.least(score, F.lit(100))
    return signals, score, F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 35, "medium").otherwise("low")


def interrupted_series(df: DataFrame, group: str, t: str, y: str, start: float) -> DataFrame:
    """Per group the level and slope change at ``start`` from a least-squares fit of 1, t, D and D (t - start)."""

    def fit(pdf):
        import pandas as pd

        x, v = pdf[t].to_numpy(float), pdf[y].to_numpy(float)
        d = (x >= start).astype(float)
        coef = np.linalg.lstsq(np.stack((np.ones_like(x), x, d, d * (x - start)), axis=1), v, rcond=None)[0]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "level": [coef[2]], "slope": [coef[3]]})

    return df.select(group, t, y).groupBy(group).applyInPandas(fit, f"{group} {df.schema[group].dataType.simpleString()}, level double, slope double")


def schema_drift(before: DataFrame, after: DataFrame) -> dict[str, list]:
    a, b = ({f.name: f.dataType.simpleString() for f in d.schema} for d in (before, after))
    return {"added": sorted(b.keys() - a.keys()), "removed": sorted(a.keys() - b.keys()), "changed": sorted((n, a[n], b[n]) for n in a.keys() & b.keys() if a[n] != b[n])}


def heal(df: DataFrame, target: DataFrame | list[tuple[str, str]], most_loss: float = 0.05) -> DataFrame:
    """The frame in the target's schema: missing columns null, extra ones dropped, types by try_cast if at most ``most_loss`` of the values get lost."""
    fields = target if isinstance(target, list) else [(f.name, f.dataType.simpleString()) for f in target.schema]
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    cast = {n: F.expr(f"try_cast(`{n}` AS {t})") for n, t in fields if n in have and have[n] != t}
    if cast:
        lost = df.agg(*[(F.count(n) - F.count(c)).alias(n) for n, c in cast.items()], *[F.count(n).alias(f"{n}#") for n in cast]).first()
        for n in cast:
            if lost[n] > most_loss * max(1, lost[f"{n}#"]):
                raise ValueError(f"a cast of {n} would lose {lost[n]} of {lost[f'{n}#']} values")
    return df.select(*[cast.get(n, F.col(n)).alias(n) if n in have else F.lit(None).cast(t).alias(n) for n, t in fields])


def compatible(old: dict[str, tuple[str, bool]], new: dict[str, tuple[str, bool]], mode: str) -> list[str]:
    """Problems between two versions of a schema, name -> (type, required); mode: backward, forward, full or none."""
    wider = {("int", "bigint"), ("float", "double"), ("int", "double"), ("bigint", "double")}

    def reads(writer, reader):
        out = []
        for name, (kind, required) in reader.items():
            if name not in writer:
                out += [f"{name} is required and not written"] if required else []
            elif writer[name][0] != kind and (writer[name][0], kind) not in wider:
                out.append(f"{name}: {writer[name][0]} is not readable as {kind}")
        return out

    base = mode.removesuffix("_transitive")
    return {"none": lambda: [], "backward": lambda: reads(old, new), "forward": lambda: reads(new, old), "full": lambda: reads(old, new) + reads(new, old)}[base]()


def fit_transforms(df: DataFrame, spec: dict[str, str]) -> dict[str, tuple]:
    """One aggregate for all, and exact quantiles where a kind needs them: per column (kind, parameters); kinds: minmax, standard, mean_fill, median_fill, clip."""
    aggs = [x for c in spec for x in (F.min(c), F.max(c), F.avg(c), F.stddev_pop(c))]
    row = df.agg(*aggs).first()
    rest = {c: exact_quantiles(df, c, [0.5, 0.01, 0.99]) if kind in ("median_fill", "clip") else [None] * 3 for c, kind in spec.items()}
    return {c: (kind, (*row[4 * i : 4 * i + 4], *rest[c])) for i, (c, kind) in enumerate(spec.items())}


def transform_columns(df: DataFrame, fitted: dict[str, tuple]) -> DataFrame:
    out = {}
    for c, (kind, (lo, hi, mean, sd, med, p1, p99)) in fitted.items():
        x = F.col(c)
        out[c] = {"minmax": lambda: (x - lo) / (hi - lo) if hi != lo else x * 0, "standard": lambda: (x - mean) / sd if sd else x * 0, "mean_fill": lambda: F.coalesce(x, F.lit(mean)), "median_fill": lambda: F.coalesce(x, F.lit(med)), "clip": lambda: F.least(F.greatest(x, F.lit(p1)), F.lit(p99))}[kind]()
    return df.withColumns(out)
