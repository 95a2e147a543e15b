"""Queries that show the engine's own operators at work, with SQL that must agree where SQL can."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import scalar
from quernstone.operators import aggs, approx, graph, ivm, joins, lake, provenance, quality
from quernstone.plans.registry import query
from quernstone.sources.tables import table


def _events(spark, sf, kind=None):
    e = table(spark, sf, "events")
    return e.filter(F.col("event_type") == kind) if kind else e


def _edges(spark, sf):
    """Customer nation to supplier nation, with the revenue of every order line."""
    li = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = li.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.sum("l_extendedprice").alias("weight"))


def _large(spark, sf):
    """Those of the edges that carry more than 1.2 times the mean."""
    e = _edges(spark, sf)
    return e.crossJoin(F.broadcast(e.agg((1.2 * F.avg("weight")).alias("least")))).filter("weight > least").drop("least")  # one row


EDGES = """e AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, sum(l_extendedprice) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), g AS (SELECT * FROM e WHERE weight > (SELECT 1.2 * avg(weight) FROM e)),
u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM g WHERE src <> dst), d AS (SELECT DISTINCT src, dst FROM g)"""


# Joins.
def _asof(name, sql, **options):
    @query(name, sql)
    def run(spark, sf):
        left = _events(spark, sf, "purchase").select("event_id", "user_id", "ts")
        right = _events(spark, sf, "click").select(F.col("user_id"), F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
        return joins.asof_join(left, right, ["user_id"], "ts", "click_ts", ["click_id"], tie="click_id", **options).select("event_id", F.coalesce("click_id", F.lit(-1).cast("long")).alias("click_id"))


_asof("asof_backward", "SELECT p.event_id, coalesce(c.event_id, -1) AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts")
_asof("asof_strict", "SELECT p.event_id, coalesce(c.event_id, -1) AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts > c.ts", allow_exact=False)
_asof("asof_lookback", "SELECT p.event_id, CASE WHEN c.ts >= p.ts - INTERVAL 6 HOURS THEN c.event_id ELSE -1 END AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts", lookback="6 HOURS")


@query("interval_join", "SELECT p.event_id AS purchase, c.event_id AS click FROM events p JOIN events c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'click' AND c.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts")
def interval(spark, sf):
    p = _events(spark, sf, "purchase").select(F.col("event_id").alias("purchase"), "user_id", "ts")
    c = _events(spark, sf, "click").select(F.col("event_id").alias("click"), "user_id", F.col("ts").alias("cts"))
    return joins.interval_join(p, c, ["user_id"], "ts", "cts", 3600, 0).select("purchase", "click")


@query("triangles", f"WITH {EDGES} SELECT x.a AS x, x.b AS y, y.b AS z FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b")
def triangles(spark, sf):
    return joins.triangles(_large(spark, sf))


@query("four_cycles", f"WITH {EDGES}, s AS (SELECT a, b FROM u UNION SELECT b, a FROM u), w AS (SELECT p.b AS u, q.b AS v, count(*) AS w FROM s p JOIN s q ON p.a = q.a AND p.b < q.b GROUP BY ALL) SELECT u, v, CAST(w * (w - 1) // 2 AS BIGINT) AS cycles FROM w WHERE w > 1")
def four_cycles(spark, sf):
    return joins.four_cycles(_large(spark, sf))


@query("paths3", f"WITH {EDGES} SELECT x.src AS a, CAST(count(*) AS BIGINT) AS n FROM d x JOIN d y ON x.dst = y.src JOIN d z ON y.dst = z.src GROUP BY x.src")
def paths3(spark, sf):
    return joins.paths3(_large(spark, sf)).groupBy("a").agg(F.count("*").alias("n"))


@query("natural_join_reduced", "SELECT CAST(count(*) AS BIGINT) AS n FROM nation JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def natural(spark, sf):
    parts = [table(spark, sf, "region").select(F.col("r_regionkey").alias("r")), table(spark, sf, "nation").select(F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("n")), table(spark, sf, "customer").select(F.col("c_nationkey").alias("n"), "c_custkey")]
    return joins.natural_join(joins.semi_join_reduced(parts)).agg(F.count("*").alias("n"))


@query("fuzzy_match", """WITH o AS (SELECT o_orderkey AS k, 'ref ' || o_orderkey || ' ' || o_orderpriority AS t, o_totalprice AS v, CAST(o_orderdate AS DATE) AS d FROM orders), n AS (SELECT *, array_to_string(list_sort(list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: x <> '')), ' ') AS w FROM o),
p AS (SELECT a.k AS lk, b.k AS rk, round(50 * (1 - levenshtein(a.w, b.w) / greatest(length(a.w), length(b.w))) + 30 * greatest(0, 1 - abs(a.v - b.v * 0.9) / greatest(a.v, b.v * 0.9)) + 20 * (1 - abs(date_diff('day', b.d, a.d) - 1) / 3.0), 6) AS score FROM n a JOIN n b ON abs(date_diff('day', b.d, a.d) - 1) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lk ORDER BY score DESC, rk) AS x, row_number() OVER (PARTITION BY rk ORDER BY score DESC, lk) AS y FROM p WHERE score >= 80) SELECT lk, rk, score FROM r WHERE x = 1 AND y = 1""")
def fuzzy(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("Ref "), F.col("o_orderkey"), F.lit(" "), F.col("o_orderpriority")).alias("reference"), "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    other = o.select(F.col("o_orderkey"), F.regexp_replace("reference", "Ref", "ref.").alias("reference"), (F.col("o_totalprice") * 0.9).alias("o_totalprice"), F.date_add("day", 1).alias("day"))
    return joins.fuzzy_match(o, other, "o_orderkey", "reference", "o_totalprice", "day", rounds=1)


# Incremental views: the delta applied to the old view is the view of the new table.
def _halves(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    old = ivm.signed(o.filter("o_orderkey % 7 <> 0"))
    delta = ivm.signed(o.filter("o_orderkey % 7 = 0")).unionByName(ivm.signed(o.filter("o_orderkey % 7 = 1"), -1))
    return old, delta


@query("ivm_group_by", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS s FROM orders WHERE o_orderkey % 7 <> 1 GROUP BY o_custkey")
def ivm_group(spark, sf):
    old, delta = _halves(spark, sf)
    agg = [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s")]
    view = ivm.signed(ivm.visible(old).groupBy("o_custkey").agg(*agg))
    return ivm.visible(ivm.apply_delta(view, ivm.delta_group_by(old, delta, ["o_custkey"], agg)))


@query("ivm_linear", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a FROM orders WHERE o_orderkey % 7 <> 1 GROUP BY o_orderstatus")
def ivm_linear(spark, sf):
    old, delta = _halves(spark, sf)
    return ivm.linear_aggregates(old.unionByName(delta), ["o_orderstatus"], "o_totalprice").select("o_orderstatus", F.col("count").alias("n"), F.round("sum", 2).alias("s"), F.round("avg", 4).alias("a"))


@query("ivm_min_max_distinct", "SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(count(DISTINCT o_totalprice) AS BIGINT) AS nd FROM orders WHERE o_orderkey % 7 <> 1 GROUP BY o_custkey")
def ivm_extremes(spark, sf):
    old, delta = _halves(spark, sf)
    return ivm.retractable_extremes(old.unionByName(delta), ["o_custkey"], "o_totalprice").select("o_custkey", F.col("min").alias("lo"), F.col("max").alias("hi"), F.col("distinct").alias("nd"))


@query("ivm_join", "SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 1 AND c_custkey % 5 <> 1")
def ivm_join(spark, sf):
    old, delta = (x.select("o_orderkey", "o_custkey", ivm.DIFF) for x in _halves(spark, sf))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    c_old, c_delta = ivm.signed(c.filter("o_custkey % 5 <> 0")), ivm.signed(c.filter("o_custkey % 5 = 0")).unionByName(ivm.signed(c.filter("o_custkey % 5 = 1"), -1))
    view = ivm.join(old, c_old, ["o_custkey"])
    return ivm.visible(ivm.apply_delta(view, ivm.delta_join(old, delta, c_old, c_delta, ["o_custkey"]))).select("o_orderkey", "c_nationkey")


@query("ivm_left_join", "SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 7 <> 1 AND o_orderstatus = 'P') o ON c_custkey = o_custkey")
def ivm_left(spark, sf):
    old, delta = (x.filter("o_orderstatus = 'P'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), ivm.DIFF) for x in _halves(spark, sf))
    c = ivm.signed(table(spark, sf, "customer").select("c_custkey"))
    view = ivm.signed(ivm.visible(c).join(ivm.visible(old), "c_custkey", "left"))
    d = ivm.delta_left_join(c, c.limit(0), old, delta, ["c_custkey"])
    return ivm.visible(ivm.apply_delta(view, d)).select("c_custkey", F.coalesce("o_orderkey", F.lit(-1).cast("long")).alias("o_orderkey"))


@query("ivm_window", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders WHERE o_orderkey % 7 <> 1")
def ivm_window(spark, sf):
    old, delta = _halves(spark, sf)
    cols = {"rn": F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long")}
    view = ivm.signed(ivm.visible(old).withColumns(cols))
    return ivm.visible(ivm.apply_delta(view, ivm.delta_window(old, delta, ["o_custkey"], cols))).select("o_orderkey", "rn")


@query("ivm_nested", "SELECT round(max(s), 2) AS max_sum FROM (SELECT sum(o_totalprice) AS s FROM orders WHERE o_orderkey % 7 <> 1 GROUP BY o_custkey) t")
def ivm_nested(spark, sf):
    old, delta = _halves(spark, sf)
    return ivm.max_of_sums(old.unionByName(delta), "o_custkey", "o_totalprice").select(F.round("max_sum", 2).alias("max_sum"))


@query("ivm_above_average", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS a FROM orders WHERE o_orderkey % 7 <> 1) t WHERE o_totalprice > a")
def ivm_above(spark, sf):
    old, delta = _halves(spark, sf)
    return ivm.above_average(ivm.apply_delta(old, delta), "o_custkey", "o_totalprice").select("o_orderkey")


# Aggregates.
@query("agg_hhi_gini", """WITH t AS (SELECT c_nationkey AS k, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY k), r AS (SELECT v, row_number() OVER (ORDER BY v, k) AS i, row_number() OVER (ORDER BY v DESC, k) AS b, sum(v) OVER () AS s, count(*) OVER () AS n FROM t)
SELECT round(sum((v / s) ** 2), 6) AS hhi, round(2 * sum(i * v) / (max(n) * max(s)) - (max(n) + 1) / max(n), 6) AS gini, round(sum(CASE WHEN b <= 3 THEN v / s ELSE 0 END), 6) AS top_share FROM r""")
def hhi(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return aggs.concentration(j, "c_nationkey", "o_totalprice").select(*[F.round(c, 6).alias(c) for c in ("hhi", "gini", "top_share")])


@query("agg_chao1", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT CAST(count(*) AS BIGINT) AS seen, round(count(*) + CASE WHEN count(*) FILTER (n = 2) > 0 THEN (count(*) FILTER (n = 1)) ** 2 / (2 * count(*) FILTER (n = 2)) ELSE 0 END, 4) AS chao1 FROM c")
def chao1(spark, sf):
    return aggs.chao1(table(spark, sf, "orders"), "o_custkey").select("seen", F.round("chao1", 4).alias("chao1"))


@query("agg_frequency_skew", "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id), h AS (SELECT sum(n) AS h FROM (SELECT n FROM c ORDER BY n DESC, user_id LIMIT 3) t) SELECT round(stddev_pop(n) / avg(n), 6) AS cv, CAST(count(*) AS BIGINT) AS \"distinct\", round((SELECT h FROM h) / sum(n), 6) AS top_share FROM c")
def skew(spark, sf):
    return aggs.frequency_skew(_events(spark, sf), "user_id").select(F.round("cv", 6).alias("cv"), "distinct", F.round("top_share", 6).alias("top_share"))


@query("agg_hll_within_bound", "SELECT 'HLL' AS sketch, CAST(count(DISTINCT l_partkey) AS BIGINT) AS exact, true AS ok FROM lineitem")
def hll_ok(spark, sf):
    li = table(spark, sf, "lineitem")
    exact = li.agg(F.countDistinct("l_partkey").alias("e"))
    est = aggs.hll_merge(aggs.hll_rollup(li, ["l_returnflag"], "l_partkey"), [])
    return est.crossJoin(exact).select(F.lit("HLL").alias("sketch"), F.col("e").alias("exact"), (F.abs(F.col("distinct") - F.col("e")) / F.col("e") <= 0.05).alias("ok"))


@query("agg_kll_within_bound", "SELECT 'KLL' AS sketch, CAST(count(*) AS BIGINT) AS n, true AS low, true AS mid, true AS high FROM lineitem")
def kll_ok(spark, sf):
    li = table(spark, sf, "lineitem")
    est = aggs.kll_quantiles(li, [], "l_extendedprice", [0.1, 0.5, 0.9])
    near = lambda c, r: F.abs(F.count_if(F.col("l_extendedprice") <= F.col(c)) / F.count("*") - r) <= 0.02
    return li.crossJoin(F.broadcast(est)).agg(F.lit("KLL").alias("sketch"), F.count("*").alias("n"), near("q100", 0.1).alias("low"), near("q500", 0.5).alias("mid"), near("q900", 0.9).alias("high"))  # one row


@query("agg_mergeable_rollup", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
def rollup(spark, sf):
    r = aggs.minute_rollup(_events(spark, sf), "ts", ["event_type"], "value")
    return aggs.merge_rollup(r, ["event_type"]).select("event_type", "n", F.round("total", 2).alias("total"), "low", "high")


@query("agg_geometric_inflation", """WITH m AS (SELECT event_type, CAST(ts AS DATE) AS d, median(value) AS p FROM events GROUP BY ALL), r AS (SELECT d, ln(p / lag(p) OVER (PARTITION BY event_type ORDER BY d)) AS r FROM m)
SELECT CAST(d AS VARCHAR) AS day, round(exp(avg(r)) - 1, 6) AS inflation FROM r WHERE r IS NOT NULL GROUP BY d""")
def inflation(spark, sf):
    e = _events(spark, sf).withColumn("d", F.col("ts").cast("date"))
    return aggs.geometric_inflation(e, "d", "event_type", "value").select(F.col("d").cast("string").alias("day"), F.round("inflation", 6).alias("inflation"))


@query("agg_column_profile", "SELECT 'event_type' AS \"column\", CAST(count(*) AS BIGINT) AS rows, CAST(count(*) - count(event_type) AS BIGINT) AS nulls, min(event_type) AS lo, max(event_type) AS hi, true AS near FROM events UNION ALL SELECT 'user_id', CAST(count(*) AS BIGINT), CAST(count(*) - count(user_id) AS BIGINT), CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR), true FROM events")
def profile(spark, sf):
    e = _events(spark, sf)
    true = e.agg(F.countDistinct("event_type").alias("event_type"), F.countDistinct("user_id").alias("user_id"))  # one row
    p = aggs.profile(e, ["event_type", "user_id"]).crossJoin(F.broadcast(true))
    exact = F.when(F.col("column") == "user_id", F.col("user_id")).otherwise(F.col("event_type"))
    return p.select("column", "rows", "nulls", F.col("min").alias("lo"), F.col("max").alias("hi"), (F.abs(F.col("distinct") - exact) <= 0.1 * exact).alias("near"))


@query("agg_crdt_counters", "SELECT CAST(sum(m) AS BIGINT) AS total FROM (SELECT user_id % 5 AS node, max(event_id) AS m FROM events GROUP BY node) t")
def crdt(spark, sf):
    return aggs.g_counter(_events(spark, sf).withColumn("node", F.col("user_id") % 5), "node", "event_id")


@query("agg_equi_depth_histogram", "SELECT CAST(count(*) AS BIGINT) AS rows_in, CAST(20 AS BIGINT) AS buckets, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, true AS even, true AS apart FROM lineitem")
def histogram(spark, sf):
    h = aggs.equi_depth(table(spark, sf, "lineitem"), "l_extendedprice")
    h = h.withColumn("next", F.lead("lo").over(Window.orderBy("bucket")))  # one row a bucket
    return h.agg(F.sum("n").alias("rows_in"), F.count("*").alias("buckets"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.max("n") <= 1.05 * F.min("n")).alias("even"), F.bool_and(F.coalesce(F.col("hi") < F.col("next"), F.lit(True))).alias("apart"))


# Provenance.
def _nation_tokens(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("r"), F.concat(F.lit("n"), F.col("n_nationkey")).alias("t"))


@query("prov_bag", "SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(count(*) AS BIGINT) AS k FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY n_regionkey")
def prov_bag(spark, sf):
    n = provenance.annotate(_nation_tokens(spark, sf), provenance.BAG, F.col("t"))
    r = provenance.annotate(table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("r")), provenance.BAG, F.lit("x"))
    return provenance.project(provenance.join(n, r, provenance.BAG, ["r"]), provenance.BAG, ["r"]).select("r", F.col("_k").alias("k"))


@query("prov_why", "SELECT CAST(n_regionkey AS BIGINT) AS r, array_to_string(list_sort(list('n' || n_nationkey || '&r' || n_regionkey)), ' ') AS witnesses FROM nation GROUP BY n_regionkey")
def prov_why(spark, sf):
    w = provenance.WHY
    n = provenance.annotate(_nation_tokens(spark, sf), w, F.col("t"))
    r = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("r"))
    r = provenance.annotate(r, w, F.concat(F.lit("r"), F.col("r")))
    out = provenance.project(provenance.join(n, r, w, ["r"]), w, ["r"])
    return out.select("r", F.array_join(F.array_sort(F.transform("_k", lambda x: F.array_join(x, "&"))), " ").alias("witnesses"))


@query("prov_how", "SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(count(*) AS BIGINT) AS monomials, CAST(count(*) AS BIGINT) AS multiplicity FROM nation GROUP BY n_regionkey")
def prov_how(spark, sf):
    p = provenance.how_project(provenance.how(_nation_tokens(spark, sf), F.col("t")).drop("t"), ["r"])
    return p.groupBy("r").agg(F.count("*").alias("monomials"), F.sum("_c").alias("multiplicity"))


@query("prov_probability", "SELECT CAST(n_regionkey AS BIGINT) AS r, round(1 - exp(sum(ln(1 - (0.1 + (n_nationkey % 5) / 10.0)))), 6) AS p FROM nation GROUP BY n_regionkey")
def prov_prob(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("r"), "n_nationkey")
    a = provenance.annotate(n, provenance.PROBABILITY, 0.1 + (F.col("n_nationkey") % 5) / 10.0)
    return provenance.project(a, provenance.PROBABILITY, ["r"]).select("r", F.round("_k", 6).alias("p"))


# Approximate and private answers, checked by their bounds.
@query("coreset_interval_holds", "SELECT unnest(['uniform', 'sensitivity', 'merged']) AS kind, round(sum(l_extendedprice), 2) AS exact, true AS ok FROM lineitem WHERE l_quantity > 25")
def coreset(spark, sf):
    li = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), "l_extendedprice", "l_quantity")
    on = F.col("l_quantity") > 25
    exact = li.filter(on).agg(F.sum("l_extendedprice").alias("x"))
    u, s = approx.uniform_coreset(li, "id", 3000, 1), approx.sensitivity_coreset(li, "id", "l_extendedprice", 3000, 2)
    out = None
    for kind, sample in (("uniform", u), ("sensitivity", s), ("merged", approx.merge_coresets([approx.uniform_coreset(li.filter("l_quantity > 20"), "id", 2000, 3), approx.uniform_coreset(li.filter("l_quantity <= 20"), "id", 2000, 4)], "id", 3000))):
        e = approx.estimate(sample, "l_extendedprice", on, 0.9999).crossJoin(exact).select(F.lit(kind).alias("kind"), F.round("x", 2).alias("exact"), (F.abs(F.col("sum") - F.col("x")) <= F.col("sum_ci")).alias("ok"))
        out = e if out is None else out.unionAll(e)
    return out


@query("private_histogram_close", "SELECT 'laplace' AS kind, true AS ok UNION ALL SELECT 'response', true UNION ALL SELECT 'mean', true")
def private(spark, sf):
    e = _events(spark, sf)
    lap = approx.private_counts(e, ["event_type"], 1.0, 11).agg(F.lit("laplace").alias("kind"), (F.max(F.abs(F.col("noisy") - F.col("n"))) < 60).alias("ok"))
    kinds = ["view", "click", "error", "purchase", "signup"]
    share = e.groupBy("event_type").agg((F.count("*") / F.lit(e.count())).alias("x"))
    rr = approx.randomized_response_histogram(e, "event_id", "event_type", kinds, 3.0, 5).join(share, F.col("value") == F.col("event_type")).agg(F.lit("response").alias("kind"), (F.max(F.abs(F.col("share") - F.col("x"))) < 0.05).alias("ok"))
    mean = approx.private_mean(e, "value", 0.0, 100.0, 1.0, 3).select(F.lit("mean").alias("kind"), (F.abs(F.col("noisy") - F.col("mean")) < 1.0).alias("ok"))
    return lap.unionAll(rr).unionAll(mean)


# Quality, drift, reconciliation, risk.
@query("dq_completeness", "SELECT 'c_mktsegment' AS \"column\", CAST(1 AS DOUBLE) AS completeness, round(count(DISTINCT c_mktsegment) / count(c_mktsegment), 6) AS uniqueness FROM customer UNION ALL SELECT 'c_custkey', CAST(1 AS DOUBLE), round(count(DISTINCT c_custkey) / count(c_custkey), 6) FROM customer")
def dq(spark, sf):
    return quality.completeness(table(spark, sf, "customer"), ["c_mktsegment", "c_custkey"]).select("column", F.col("completeness").cast("double").alias("completeness"), F.round("uniqueness", 6).alias("uniqueness"))


@query("dq_contract", """SELECT 'c_acctbal' AS field, 'min' AS rule, CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS violations FROM customer UNION ALL SELECT 'c_mktsegment', 'allowed', CAST(count(*) FILTER (c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS BIGINT) FROM customer
UNION ALL SELECT 'c_custkey', 'unique', 0 UNION ALL SELECT 'c_phone', 'required', CAST(count(*) AS BIGINT) FROM customer""")
def contract(spark, sf):
    return quality.contract_violations(table(spark, sf, "customer"), {"c_acctbal": {"min": 0}, "c_mktsegment": {"allowed": ["BUILDING", "MACHINERY"]}, "c_custkey": {"unique": True}, "c_phone": {"required": True}})


@query("dq_expect_or_drop", "SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_mktsegment <> 'BUILDING'")
def expect(spark, sf):
    kept, _ = quality.expect_all_or_drop(table(spark, sf, "customer"), {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "BUILDING"})
    return kept.select("c_custkey")


def _two(spark, sf):
    e = _events(spark, sf)
    return e.filter("ts < DATE '2024-01-16'"), e.filter("ts >= DATE '2024-01-16'").withColumn("value", F.col("value") * 1.1)


@query("drift_js", """WITH r AS (SELECT value AS v FROM events WHERE ts < DATE '2024-01-16'), c AS (SELECT value * 1.1 AS v FROM events WHERE ts >= DATE '2024-01-16'), x AS (SELECT min(v) AS lo, max(v) AS hi FROM (SELECT v FROM r UNION ALL SELECT v FROM c) t),
p AS (SELECT least(floor((v - lo) / ((hi - lo) / 20)), 19) AS b, count(*) / (SELECT count(*) FROM r) AS p FROM r, x GROUP BY b), q AS (SELECT least(floor((v - lo) / ((hi - lo) / 20)), 19) AS b, count(*) / (SELECT count(*) FROM c) AS q FROM c, x GROUP BY b),
j AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q FROM p FULL JOIN q ON p.b = q.b) SELECT round(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 6) AS js FROM j""")
def js(spark, sf):
    return quality.js_divergence(*_two(spark, sf), "value").select(F.round("js", 6).alias("js"))


@query("drift_ks", """WITH t AS (SELECT value AS v, 1 AS a, 0 AS b FROM events WHERE ts < DATE '2024-01-16' UNION ALL SELECT value * 1.1, 0, 1 FROM events WHERE ts >= DATE '2024-01-16'), s AS (SELECT v, sum(a) AS a, sum(b) AS b FROM t GROUP BY v)
SELECT round(max(d), 6) AS ks FROM (SELECT abs(sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER ()) AS d FROM s) x""")
def ks(spark, sf):
    return quality.ks_statistic(*_two(spark, sf), "value").select(F.round("ks", 6).alias("ks"))


@query("drift_psi", """WITH r AS (SELECT value AS v FROM events WHERE ts < DATE '2024-01-16'), c AS (SELECT value * 1.1 AS v FROM events WHERE ts >= DATE '2024-01-16'), q AS (SELECT list_sort(list_distinct(quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e FROM r),
b AS (SELECT s, least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) AS b FROM (SELECT 'r' AS s, v FROM r UNION ALL SELECT 'c', v FROM c) t, q WHERE v BETWEEN e[1] AND e[len(e)]),
n AS (SELECT b, count(*) FILTER (s = 'r') AS r, count(*) FILTER (s = 'c') AS c FROM b GROUP BY b), p AS (SELECT greatest(r / sum(r) OVER (), 1e-6) AS p, greatest(c / sum(c) OVER (), 1e-6) AS q FROM n) SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM p""")
def psi(spark, sf):
    return quality.psi(*_two(spark, sf), "value").select(F.round("psi", 6).alias("psi"))


@query("compare_views", "SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'missing_right' WHEN o_orderkey % 5 = 0 THEN 'mismatch' ELSE 'match' END AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY status")
def compare(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    r = o.filter("o_orderkey % 11 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") * 1.01).otherwise(F.col("o_totalprice")))
    return quality.compare_views(o, r, "o_orderkey", ["o_custkey"], ["o_totalprice"]).groupBy("status").agg(F.count("*").alias("n"))


@query("reconciliation", """SELECT 'count' AS "check", CAST(count(*) AS DOUBLE) AS raw, CAST(count(*) FILTER (o_orderkey % 13 <> 0) AS DOUBLE) AS transformed FROM orders UNION ALL SELECT 'total', round(sum(o_totalprice), 2), round(sum(o_totalprice) FILTER (o_orderkey % 13 <> 0), 2) FROM orders
UNION ALL SELECT 'groups_off', 0.0, CAST(count(DISTINCT o_orderstatus) FILTER (o_orderkey % 13 = 0) AS DOUBLE) FROM orders UNION ALL SELECT 'missing', 0.0, CAST(count(*) FILTER (o_orderkey % 13 = 0) AS DOUBLE) FROM orders UNION ALL SELECT 'extra', 0.0, 0.0""")
def recon(spark, sf):
    o = table(spark, sf, "orders")
    return quality.reconciliation(o, o.filter("o_orderkey % 13 <> 0"), "o_orderkey", "o_totalprice", "o_orderstatus")


@query("risk_rules", """WITH s AS (SELECT event_id, least(100, CASE WHEN value > 95 THEN 50 ELSE 0 END + CASE WHEN event_type = 'error' THEN 30 ELSE 0 END + CASE WHEN hour(ts) < 5 THEN 25 ELSE 0 END) AS score FROM events)
SELECT CASE WHEN score >= 80 THEN 'critical' WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS severity, CAST(count(*) AS BIGINT) AS n, CAST(sum(score) AS BIGINT) AS points FROM s GROUP BY severity""")
def risk(spark, sf):
    _, score, severity = quality.risk_score({"amount": (F.col("value") > 95, 50), "kind": (F.col("event_type") == "error", 30), "night": (F.hour("ts") < 5, 25)})
    return _events(spark, sf).select(severity.alias("severity"), score.alias("s")).groupBy("severity").agg(F.count("*").alias("n"), F.sum("s").cast("long").alias("points"))


@query("interrupted_series", """WITH d AS (SELECT event_type, CAST(dayofyear(ts) AS DOUBLE) AS t, avg(value) AS y FROM events GROUP BY ALL), f AS (SELECT event_type, regr_intercept(y, t) FILTER (t < 15) AS a0, regr_slope(y, t) FILTER (t < 15) AS b0, regr_intercept(y, t) FILTER (t >= 15) AS a1, regr_slope(y, t) FILTER (t >= 15) AS b1 FROM d GROUP BY event_type)
SELECT event_type, round(a1 + b1 * 15 - a0 - b0 * 15, 6) AS level, round(b1 - b0, 6) AS slope FROM f""")
def series(spark, sf):
    d = _events(spark, sf).groupBy("event_type", F.dayofyear("ts").cast("double").alias("t")).agg(F.avg("value").alias("y"))
    return quality.interrupted_series(d, "event_type", "t", "y", 15.0).select("event_type", F.round("level", 6).alias("level"), F.round("slope", 6).alias("slope"))


# Table maintenance.
@query("scd1_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def scd1(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.lit(1).alias("seq"))
    up = o.filter("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X")).withColumn("seq", F.lit(2))
    return lake.merge_scd1(o, up, ["o_orderkey"], "seq").drop("seq")


@query("scd2_history", """WITH h AS (SELECT user_id, ts, event_type, event_id, lag(event_type) OVER w AS b, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT * FROM h WHERE n = 1 OR b IS DISTINCT FROM event_type)
SELECT user_id, event_type, event_id AS valid_from, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), -1) AS valid_to FROM r""")
def scd2(spark, sf):
    return lake.scd2(_events(spark, sf).select("user_id", "event_type", "event_id"), ["user_id"], ["event_type"], "event_id").select("user_id", "event_type", "valid_from", F.coalesce("valid_to", F.lit(-1).cast("long")).alias("valid_to"))


@query("merge_on_read", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 0.0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 4 <> 0")
def mor(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    log = o.filter("o_orderkey % 4 = 0").withColumn("o", F.lit(1)).withColumn("op", F.lit("delete")).unionByName(o.filter("o_orderkey % 4 = 1").withColumn("o_totalprice", F.lit(0.0)).withColumn("o", F.lit(2)).withColumn("op", F.lit("update")))
    return lake.merge_on_read(o, log, ["o_orderkey"], "o", "op")


@query("cdc_fold", "SELECT user_id, max(event_id) AS lsn FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def cdc(spark, sf):
    e = _events(spark, sf).select("user_id", F.col("event_id").alias("lsn"), F.when(F.col("event_type") == "error", "d").otherwise("u").alias("op"))
    return lake.cdc_fold(e, ["user_id"], "lsn", "op").select("user_id", "lsn")


@query("copy_on_write", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def cow(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return lake.copy_on_write(o, o.filter("o_orderkey % 9 = 0").withColumn("o_totalprice", F.lit(1.0)), ["o_orderkey"])


@query("z_order_rows", "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS s, true AS narrower, true AS sorted FROM lineitem")
def zorder(spark, sf):
    """Rows kept, places of one order side by side, and the boxes of the eight parts smaller than those of the table as it stands."""
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice")
    z = lake.z_order(li, ["l_partkey", "l_suppkey"], 8).withColumn("p", F.spark_partition_id())
    part = z.groupBy("p").agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("s"), (F.max("l_partkey") - F.min("l_partkey")).alias("w"), (F.max("l_suppkey") - F.min("l_suppkey")).alias("h"), F.min("l_partkey").alias("lo"))
    whole = li.agg(((F.max("l_partkey") - F.min("l_partkey")) * (F.max("l_suppkey") - F.min("l_suppkey"))).alias("area"))  # one row
    return part.crossJoin(F.broadcast(whole)).agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("s"), (F.sum(F.col("w") * F.col("h")) < 4 * F.max("area")).alias("narrower"), (F.count("*") >= 4).alias("sorted"))


@query("layout_pages", """WITH k AS (SELECT l_partkey, (row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1) // 256 AS a, (row_number() OVER (ORDER BY l_partkey, l_orderkey, l_linenumber) - 1) // 256 AS b FROM lineitem), x AS (SELECT count(*) FILTER (hi >= 100 AND lo <= 150) AS n, count(*) AS p FROM (SELECT a, min(l_partkey) AS lo, max(l_partkey) AS hi FROM k GROUP BY a) t),
y AS (SELECT count(*) FILTER (hi >= 100 AND lo <= 150) AS n FROM (SELECT b, min(l_partkey) AS lo, max(l_partkey) AS hi FROM k GROUP BY b) t) SELECT CAST(x.p AS BIGINT) AS pages, CAST(x.n AS BIGINT) AS by_order, CAST(y.n AS BIGINT) AS by_part FROM x, y""")
def pages(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    box = {"l_partkey": (100.0, 150.0)}
    # Order and line number repeat, and the SQL leaves the order of such rows open: by the part, one result whatever the files and tasks.
    a, b = lake.pages_scanned(li, ["l_orderkey", "l_linenumber", "l_partkey"], 256, box), lake.pages_scanned(li, ["l_partkey", "l_orderkey", "l_linenumber"], 256, box)
    return a.select("pages", F.col("scanned").alias("by_order")).crossJoin(b.select(F.col("scanned").alias("by_part")))  # one row each


# Graphs.
_RANKS = ", ".join(f"r{k + 1} AS (SELECT n.id, 0.15 / c.n + 0.85 * coalesce(x.s, 0) AS rank FROM c, n LEFT JOIN (SELECT o.dst, sum(r{k}.rank * o.w) AS s FROM o JOIN r{k} ON o.src = r{k}.id GROUP BY o.dst) x ON x.dst = n.id)" for k in range(10))


@query("pagerank", f"WITH {EDGES}, o AS (SELECT src, dst, 1.0 / count(*) OVER (PARTITION BY src) AS w FROM d), n AS (SELECT src AS id FROM d UNION SELECT dst FROM d), c AS (SELECT count(*) AS n FROM n), r0 AS (SELECT id, 1.0 / n AS rank FROM n, c), {_RANKS} SELECT id, round(rank, 8) AS rank FROM r10")
def pagerank(spark, sf):
    return graph.pagerank(_large(spark, sf), iterations=10, tolerance=0.0).select("id", F.round("rank", 8).alias("rank"))


@query("simple_cycles", f"WITH RECURSIVE {EDGES}, f AS (SELECT src, dst FROM g WHERE src <> dst), p AS (SELECT [src, dst] AS path, dst AS last FROM f WHERE dst > src UNION ALL SELECT list_append(path, f.dst), f.dst FROM p JOIN f ON f.src = p.last WHERE len(path) < 5 AND f.dst > path[1] AND NOT list_contains(path, f.dst)) SELECT CAST(len(path) AS INT) AS length, CAST(count(*) AS BIGINT) AS n FROM p JOIN f ON f.src = p.last AND f.dst = path[1] WHERE len(path) >= 3 GROUP BY 1")
def cycles(spark, sf):
    return graph.simple_cycles(_large(spark, sf), 3, 5).groupBy(F.size("path").alias("length")).agg(F.count("*").alias("n"))


@query("contagion", f"WITH RECURSIVE {EDGES}, t AS (SELECT dst, sum(weight) AS t FROM e GROUP BY dst), f AS (SELECT src, e.dst FROM e JOIN t ON e.dst = t.dst WHERE weight / t >= 0.045), r(id, n) AS (SELECT CAST(unnest([1, 2]) AS BIGINT), 0 UNION SELECT f.dst, n + 1 FROM r JOIN f ON r.id = f.src WHERE n < 20) SELECT id, CAST(min(n) AS INT) AS round FROM r GROUP BY id")
def contagion(spark, sf):
    return graph.contagion(_edges(spark, sf), [1, 2], 0.045)


_BELIEFS = ", ".join(f"b{k + 1} AS (SELECT p.id, p.prior, p.prior + coalesce(x.m, 0) AS b FROM b0 p LEFT JOIN (SELECT s.dst, sum(0.2 * tanh(b{k}.b / 2)) AS m FROM s JOIN b{k} ON s.src = b{k}.id GROUP BY s.dst) x ON x.dst = p.id)" for k in range(3))


@query("belief_propagation", f"WITH {EDGES}, s AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), n AS (SELECT src AS id FROM g UNION SELECT dst FROM g), b0 AS (SELECT id, ln(p / (1 - p)) AS prior, ln(p / (1 - p)) AS b FROM (SELECT id, CASE WHEN id % 7 = 0 THEN 0.9 ELSE 0.5 END AS p FROM n) t), {_BELIEFS} SELECT id, round(1 / (1 + exp(-b)), 8) AS belief FROM b3")
def belief(spark, sf):
    e = _large(spark, sf)
    nodes = e.select(F.col("src").alias("id")).unionAll(e.select("dst")).distinct().withColumn("p", F.when(F.col("id") % 7 == 0, 0.9).otherwise(0.5))
    return graph.belief_propagation(e, nodes, rounds=3).select("id", F.round("belief", 8).alias("belief"))


# Scalar functions.
@query("fn_haversine", "SELECT n_nationkey, round(6371 * 2 * atan2(sqrt(h), sqrt(1 - h)), 4) AS km FROM (SELECT n_nationkey, sin(radians(n_nationkey - 10) / 2) ** 2 + cos(radians(10)) * cos(radians(n_nationkey)) * sin(radians(n_nationkey * 3 - 20) / 2) ** 2 AS h FROM nation) t")
def haversine(spark, sf):
    n = F.col("n_nationkey").cast("double")
    return table(spark, sf, "nation").select("n_nationkey", F.round(scalar.haversine(F.lit(10.0), F.lit(20.0), n, n * 3), 4).alias("km"))


@query("fn_z_key", "SELECT p_partkey, CAST(list_sum([((p_size >> b) & 1) << (2 * b) for b in range(8)]) + list_sum([(((p_partkey % 256) >> b) & 1) << (2 * b + 1) for b in range(8)]) AS BIGINT) AS z FROM part")
def zkey(spark, sf):
    return table(spark, sf, "part").select("p_partkey", scalar.z_key([F.col("p_size"), F.col("p_partkey") % 256], 8).alias("z"))


@query("fn_hilbert_bijective", "SELECT CAST(256 AS BIGINT) AS n, CAST(0 AS BIGINT) AS lo, CAST(255 AS BIGINT) AS hi, CAST(255 AS BIGINT) AS neighbours")
def hilbert(spark, sf):
    g = spark.range(256).select((F.col("id") % 16).alias("x"), (F.col("id") / 16).cast("long").alias("y"))
    k = g.withColumn("d", scalar.hilbert_key(F.col("x"), F.col("y"), 4))
    w = Window.orderBy("d")
    step = k.withColumn("s", F.abs(F.col("x") - F.lag("x").over(w)) + F.abs(F.col("y") - F.lag("y").over(w)))
    return step.agg(F.countDistinct("d").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.count_if(F.col("s") == 1).alias("neighbours"))


@query("fn_pii_scan", r"SELECT CAST(count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]{2,}')) AS BIGINT) AS with_email FROM documents")
def pii(spark, sf):
    return table(spark, sf, "documents").agg(F.count_if(F.col("text").rlike(scalar.EMAIL)).alias("with_email"))


@query("fn_pii_mask", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]{2,}')) AS INT) AS emails, CAST(len(regexp_extract_all(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]{2,}', '<email>', 'g'), '\b(?:\d{1,3}\.){3}\d{1,3}\b')) AS INT) AS ips, false AS left_over FROM documents")
def mask(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", scalar.mask_pii(F.col("text")).alias("t"))
    return t.select("doc_id", F.regexp_count("t", F.lit("<email>")).alias("emails"), F.regexp_count("t", F.lit("<ip>")).alias("ips"), F.col("t").rlike(scalar.EMAIL).alias("left_over"))


@query("fn_reshape", "SELECT c_custkey AS id, split_part(c_name, '#', 1) AS kind, split_part(c_name, '#', 2) AS number, c_acctbal * 2 AS doubled, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def reshape(spark, sf):
    steps = [{"op": "rename", "field": "c_custkey", "to": "id"}, {"op": "split", "field": "c_name", "by": "#", "to": ["kind", "number"]}, {"op": "compute", "field": "doubled", "expr": "c_acctbal * 2"}, {"op": "map_value", "field": "c_mktsegment", "values": {"BUILDING": "B"}}, *[{"op": "remove", "field": f} for f in ("c_name", "c_acctbal", "c_nationkey")]]
    return scalar.reshape(table(spark, sf, "customer"), steps)


@query("fn_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def from_json(spark, sf):
    return _events(spark, sf).select("event_id", F.from_json("props", "k BIGINT").getField("k").alias("k"))


@query("fn_surrogate_key", "SELECT c_custkey, sha256(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name)) AS k FROM customer")
def surrogate(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.sha2(F.concat_ws("|", F.col("c_custkey").cast("string"), "c_name"), 256).alias("k"))


@query("fn_string_date_math", "SELECT o_orderkey, lower(trim(o_orderpriority)) || '-' || o_orderstatus AS s, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS ym, round(ln(1 + o_totalprice), 6) AS l, round(sqrt(o_totalprice), 6) AS r FROM orders")
def scalars(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", "lower(trim(o_orderpriority)) || '-' || o_orderstatus AS s", "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS ym", "round(log1p(o_totalprice), 6) AS l", "round(sqrt(o_totalprice), 6) AS r")
