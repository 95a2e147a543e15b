"""Queries over operators of the inventory that the other families do not reach, each with SQL that must agree."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernstone.functions import scalar
from quernstone.operators import aggs, graph, ivm, joins, lake, provenance, quality
from quernstone.plans.dsl import Features, Metrics, Pipeline
from quernstone.plans.registry import query
from quernstone.plans.sqlpair import sql_query
from quernstone.plans.streams import _folder
from quernstone.sources import readers
from quernstone.sources.tables import table
from quernstone.streaming import cdc, watermarks, windows


def _new(spark, name):
    return f"{_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Sources and sinks: what is written must be read back.
@query("io_tbl", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def io_tbl(spark, sf):
    path = _new(spark, "tbl")
    table(spark, sf, "nation").select(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey", F.lit("")).alias("line")).write.text(path)
    return readers.read_tbl(spark, path, "n_nationkey INT, n_name STRING, n_regionkey INT, _end STRING").drop("_end")


@query("io_jsonl_bad_records", "SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type UNION ALL SELECT '_bad', 2")
def io_jsonl(spark, sf):
    path = _new(spark, "jsonl")
    lines = table(spark, sf, "events").select(F.to_json(F.struct("event_id", "event_type")).alias("line"))
    lines.unionAll(spark.createDataFrame([('{"event_id": 1, "event_ty',), ("no json",)], "line string")).write.text(path)
    good, bad = readers.read_jsonl(spark, path, "event_id BIGINT, event_type STRING")
    return good.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n")).unionAll(bad.agg(F.lit("_bad").alias("kind"), F.count("*").alias("n")))


@query("io_csv", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def io_csv(spark, sf):
    path = _new(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.option("header", True).csv(path)
    return readers.read_csv(spark, path, "c_custkey BIGINT, c_name STRING, c_acctbal DOUBLE")


@query("io_formats", " UNION ALL ".join(f"SELECT '{f}' AS format, CAST(count(*) AS BIGINT) AS n, round(sum(p_retailprice), 2) AS s, CAST(sum(length(p_name)) AS BIGINT) AS chars FROM part" for f in ("parquet", "orc", "json", "csv")))
def io_formats(spark, sf):
    part, out = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice"), None
    for f in ("parquet", "orc", "json", "csv"):
        path = _new(spark, f)
        readers.dsl_sink(part, f, path)
        back = readers.dsl_source(spark, f, path, schema="p_partkey BIGINT, p_name STRING, p_retailprice DOUBLE")
        one = back.agg(F.lit(f).alias("format"), F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("s"), F.sum(F.length("p_name")).alias("chars"))
        out = one if out is None else out.unionAll(one)
    return out


@query("io_partitioned_features", "SELECT CAST(ts AS DATE) AS day, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS s FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND user_id IN (1, 2, 3) GROUP BY 1")
def io_features(spark, sf):
    path = _new(spark, "features")
    readers.write_features(table(spark, sf, "events"), path, "clicks", "ts")
    got = readers.read_features(spark, path, "clicks", "2024-01-05", "2024-01-20", ("user_id", [1, 2, 3]), ["date", "value"])
    return got.groupBy(F.col("date").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))


@query("io_stream_csv", "SELECT s_suppkey, s_name, true AS stamped FROM supplier")
def io_stream_csv(spark, sf):
    path = _new(spark, "in")
    table(spark, sf, "supplier").select("s_suppkey", "s_name").write.option("header", True).csv(path)
    got = windows.finished(readers.auto_load_csv(spark, path, "s_suppkey BIGINT, s_name STRING"), _folder(spark))
    return got.select("s_suppkey", "s_name", (F.col("_source_file").isNotNull() & F.col("_ingest_ts").isNotNull()).alias("stamped"))


@query("io_incremental", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderstatus = 'P')")
def io_incremental(spark, sf):
    o = table(spark, sf, "orders")
    return readers.incremental(o, "o_orderkey", readers.high_water(o.filter("o_orderstatus = 'P'"), "o_orderkey")).select("o_orderkey", "o_orderstatus")


@query("io_time_range", "SELECT event_id, value FROM events WHERE event_type = 'click' AND user_id % 4 = 1 AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-09'")
def io_time_range(spark, sf):
    e = table(spark, sf, "events").withColumn("metric", F.col("event_type")).withColumn("tags", F.create_map(F.lit("shard"), (F.col("user_id") % 4).cast("string"), F.lit("id"), F.col("event_id").cast("string")))
    import datetime as dt

    return readers.time_range(e, "click", {"shard": "1"}, dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 9)).select("event_id", "value")


@query("io_new_files", "SELECT CAST(3 AS BIGINT) AS before, CAST(2 AS BIGINT) AS after")
def io_new_files(spark, sf):
    path = _new(spark, "files")
    table(spark, sf, "nation").select("n_name").repartition(3).write.parquet(path)
    none = spark.createDataFrame([], "path string, length long")
    first = readers.new_files(spark, path, none).filter("path LIKE '%.parquet'").select("path", "length")
    count = first.count()
    seen = spark.createDataFrame(first.orderBy("path").limit(count - 2).collect(), "path string, length long")
    later = readers.new_files(spark, path, seen).filter("path LIKE '%.parquet'")
    return later.agg(F.lit(count).cast("long").alias("before"), F.count("*").alias("after"))


@query("io_federated", "SELECT n_name, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def io_federated(spark, sf):
    path = _new(spark, "lake")
    table(spark, sf, "nation").write.format("orc").save(path)
    c = readers.Catalog(spark).add("fed_nation", "orc", path).add_frame("fed_customer", table(spark, sf, "customer"))
    return c.sql("SELECT n_name, count(*) AS customers FROM fed_customer JOIN fed_nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")


@query("io_external_table_repair", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY n_regionkey")
def io_repair(spark, sf):
    path, name = _new(spark, "ext"), f"ext_{uuid.uuid4().hex}"
    table(spark, sf, "nation").write.partitionBy("n_regionkey").parquet(path)
    spark.sql(f"CREATE TABLE {name} (n_nationkey INT, n_name STRING, n_regionkey INT) USING parquet PARTITIONED BY (n_regionkey) LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")
    return spark.sql(f"SELECT n_regionkey, count(*) AS n FROM {name} GROUP BY n_regionkey")


@query("io_ctas", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_orderstatus")
def io_ctas(spark, sf):
    path, name = _new(spark, "ctas"), f"ctas_{uuid.uuid4().hex}"
    table(spark, sf, "orders").createOrReplaceTempView(f"{name}_src")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}' AS SELECT o_orderstatus, count(*) AS n FROM {name}_src GROUP BY o_orderstatus")
    return spark.table(name)


# Semirings.
@query("prov_select_union", "SELECT CAST(n_regionkey AS BIGINT) AS r, CAST(count(*) FILTER (n_nationkey < 15) + count(*) FILTER (n_nationkey >= 10) AS BIGINT) AS k FROM nation GROUP BY n_regionkey")
def prov_union(spark, sf):
    n = provenance.annotate(table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("r"), "n_nationkey"), provenance.BAG, F.lit("x"))
    a, b = (provenance.project(provenance.select(n, p), provenance.BAG, ["r"]) for p in ("n_nationkey < 15", "n_nationkey >= 10"))
    return provenance.union(a, b, provenance.BAG).select("r", F.col("_k").alias("k"))


@query("prov_lineage", "SELECT CAST(n_regionkey AS BIGINT) AS r, array_to_string(list_sort(list('n' || n_nationkey)), ' ') AS tokens FROM nation GROUP BY n_regionkey")
def prov_lineage(spark, sf):
    n = provenance.annotate(table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("r"), F.concat(F.lit("n"), "n_nationkey").alias("t")), provenance.WHY, F.col("t"))
    return provenance.lineage(provenance.project(n, provenance.WHY, ["r"])).select("r", F.array_join("lineage", " ").alias("tokens"))


# Sets and flags.
@query("rule_flags", """SELECT DISTINCT o_custkey, rule FROM (SELECT o_custkey, unnest(list_filter([CASE WHEN o_totalprice > 400000 THEN 'R1' END, CASE WHEN o_orderstatus = 'P' THEN 'R2' END, CASE WHEN month(o_orderdate) = 12 THEN 'R3' END, CASE WHEN o_orderpriority LIKE '1%' AND o_totalprice < 5000 THEN 'R4' END], lambda x: x IS NOT NULL)) AS rule FROM orders) t""")
def rule_flags(spark, sf):
    c = F.col
    return quality.flag_rules(table(spark, sf, "orders"), "o_custkey", {"R1": c("o_totalprice") > 400000, "R2": c("o_orderstatus") == "P", "R3": F.month("o_orderdate") == 12, "R4": c("o_orderpriority").like("1%") & (c("o_totalprice") < 5000)})


@query("distinct_history", "SELECT DISTINCT user_id, event_type, value FROM events")
def distinct_history(spark, sf):
    return table(spark, sf, "events").select("user_id", "event_type", "value").distinct()


@query("multiset_difference", "SELECT o_custkey, CAST(count(*) FILTER (o_orderstatus <> 'P') - count(*) FILTER (o_totalprice > 100000) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus <> 'P') <> count(*) FILTER (o_totalprice > 100000)")
def multiset_difference(spark, sf):
    o = table(spark, sf, "orders")
    both = ivm.signed(o.filter("o_orderstatus <> 'P'").select("o_custkey")).unionByName(ivm.signed(o.filter("o_totalprice > 100000").select("o_custkey"), -1))
    return ivm.consolidate(both).select("o_custkey", F.col(ivm.DIFF).cast("long").alias("n"))


@query("or_set", "SELECT DISTINCT user_id FROM events WHERE event_type <> 'error'")
def or_set(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return aggs.or_set(e, e.filter("event_type = 'error'"), "user_id", "event_id")


@query("agg_pn_counter", "SELECT CAST(sum(u) - sum(d) AS BIGINT) AS total FROM (SELECT user_id % 7 AS node, max(event_id) AS u, max(user_id) AS d FROM events GROUP BY node) t")
def pn(spark, sf):
    return aggs.pn_counter(table(spark, sf, "events").withColumn("node", F.col("user_id") % 7), "node", "event_id", "user_id")


# Quality, drift and reconciliation.
@query("dq_table_score", "SELECT round(0.4 * (count(c_name) + count(c_acctbal)) / (2.0 * count(*)) + 0.4 * count(DISTINCT c_nationkey) / count(*) + 0.2 * count(*) FILTER (c_acctbal > 0) / count(*), 9) AS score FROM customer")
def table_score(spark, sf):
    return quality.table_score(table(spark, sf, "customer"), ["c_name", "c_acctbal"], "c_nationkey", F.col("c_acctbal") > 0).select(F.round("score", 9).alias("score"))


@query("dq_quarantine", "SELECT c_custkey, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 'balance,segment' WHEN c_acctbal < 0 THEN 'balance' ELSE 'segment' END AS broken FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def quarantine(spark, sf):
    q = quality.quarantine(table(spark, sf, "customer"), {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "BUILDING"})
    return q.select("c_custkey", F.array_join("_broken", ",").alias("broken"))


@query("dq_heal", "SELECT c_custkey, CAST(c_acctbal AS BIGINT) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_phone FROM (SELECT c_custkey, trunc(c_acctbal) AS c_acctbal FROM customer) t")
def heal(spark, sf):
    drifted = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("c_custkey"), F.expr("CAST(CAST(c_acctbal AS BIGINT) AS STRING)").alias("c_acctbal"), "c_name")
    return quality.heal(drifted, [("c_custkey", "bigint"), ("c_acctbal", "bigint"), ("c_phone", "string")])


@query("dq_invariants", "SELECT 'row_count' AS invariant, false AS holds UNION ALL SELECT 'sum', sum(o_totalprice) = sum(o_totalprice) FILTER (o_orderkey % 50 <> 0) FROM orders UNION ALL SELECT 'no_nulls', count(*) FILTER (o_custkey IS NULL AND o_orderkey % 50 <> 0) = 0 FROM orders UNION ALL SELECT 'range', max(o_totalprice) FILTER (o_orderkey % 50 <> 0) <= 300000 FROM orders UNION ALL SELECT 'distinct_preserved', count(DISTINCT o_custkey) = count(DISTINCT o_custkey) FILTER (o_orderkey % 50 <> 0) FROM orders UNION ALL SELECT 'monotone', count(*) = 0 FROM (SELECT o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders WHERE o_orderkey % 50 <> 0) t WHERE o_orderdate < b")
def invariants(spark, sf):
    o = table(spark, sf, "orders")
    return quality.invariants(o, o.filter("o_orderkey % 50 <> 0"), "o_totalprice", ["o_custkey"], {"o_totalprice": (0.0, 300000.0)}, "o_custkey", ("o_orderkey", "o_orderdate"), ["o_custkey"])


@query("drift_training_serving", """WITH t AS (SELECT value AS v, user_id AS u FROM events WHERE ts < DATE '2024-01-16'), s AS (SELECT CASE WHEN event_id % 10 <> 0 THEN value * 2 END AS v, user_id AS u FROM events WHERE ts >= DATE '2024-01-16'),
x AS (SELECT 'value' AS feature, abs((SELECT avg(v) FROM s) - (SELECT avg(v) FROM t)) / (SELECT stddev_pop(v) FROM t) AS shift, (SELECT count(*) FILTER (v IS NULL) / count(*) FROM s) AS null_gap UNION ALL SELECT 'user_id', abs((SELECT avg(u) FROM s) - (SELECT avg(u) FROM t)) / (SELECT stddev_pop(u) FROM t), 0.0)
SELECT feature, round(shift, 8) AS shift, round(null_gap, 8) AS null_gap, shift > 0.5 OR null_gap > 0.05 AS skewed FROM x""")
def training_serving(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "value", "user_id")
    serving = e.filter("ts >= DATE '2024-01-16'").withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value") * 2))
    out = quality.training_serving_skew(e.filter("ts < DATE '2024-01-16'"), serving, ["value", "user_id"])
    return out.select("feature", F.round("shift", 8).alias("shift"), F.round("null_gap", 8).alias("null_gap"), "skewed")


@query("drift_chi_square", """WITH e AS (SELECT event_type AS k, count(*) AS e FROM events WHERE ts < DATE '2024-01-16' GROUP BY k), o AS (SELECT event_type AS k, count(*) AS o FROM events WHERE ts >= DATE '2024-01-16' AND user_id % 3 <> 0 GROUP BY k),
j AS (SELECT coalesce(e, 0) AS e, coalesce(o, 0) AS o FROM e FULL JOIN o USING (k)), x AS (SELECT o, e * (sum(o) OVER ()) / (sum(e) OVER ()) AS x FROM j) SELECT round(sum((o - x) ** 2 / x), 6) AS statistic, CAST(count(*) - 1 AS BIGINT) AS dof FROM x WHERE x >= 5""")
def chi_square(spark, sf):
    e = table(spark, sf, "events")
    stat, _, dof = quality.chi_square(e.filter("ts < DATE '2024-01-16'"), e.filter("ts >= DATE '2024-01-16' AND user_id % 3 <> 0"), "event_type")
    return spark.createDataFrame([(round(stat, 6), dof)], "statistic double, dof long")


@query("reconciliation_branches", """SELECT 'count' AS "check", CAST(count(*) AS DOUBLE) AS raw, CAST(count(*) FILTER (o_orderkey % 13 <> 0) AS DOUBLE) AS transformed FROM orders UNION ALL SELECT 'total', round(sum(o_totalprice), 2), round(sum(o_totalprice) FILTER (o_orderkey % 13 <> 0), 2) FROM orders
UNION ALL SELECT 'groups_off', 0.0, CAST(count(DISTINCT o_orderstatus) FILTER (o_orderkey % 13 = 0) AS DOUBLE) FROM orders UNION ALL SELECT 'branches_off', 0.0, CAST(count(DISTINCT o_custkey % 29) FILTER (o_orderkey % 13 = 0) AS DOUBLE) FROM orders UNION ALL SELECT 'missing', 0.0, CAST(count(*) FILTER (o_orderkey % 13 = 0) AS DOUBLE) FROM orders UNION ALL SELECT 'extra', 0.0, 0.0""")
def reconciliation_branches(spark, sf):
    o = table(spark, sf, "orders").withColumn("branch", F.col("o_custkey") % 29)
    return quality.reconciliation(o, o.filter("o_orderkey % 13 <> 0"), "o_orderkey", "o_totalprice", "o_orderstatus", "branch")


@query("impossible_travel", """WITH p AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, (event_id * 37 % 120) - 60.0 AS lat, (event_id * 91 % 300) - 150.0 AS lon FROM events), l AS (SELECT *, lag(t) OVER w AS t0, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
d AS (SELECT event_id, t - t0 AS gap, sin(radians(lat - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat)) * sin(radians(lon - lon0) / 2) ** 2 AS h FROM l WHERE t0 IS NOT NULL) SELECT event_id, round(6371 * 2 * atan2(sqrt(h), sqrt(1 - h)), 3) AS km FROM d WHERE gap <= 86400 AND 6371 * 2 * atan2(sqrt(h), sqrt(1 - h)) >= 5000""")
def travel(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("event_id") * 37 % 120 - 60.0).alias("lat"), (F.col("event_id") * 91 % 300 - 150.0).alias("lon"))
    return quality.impossible_travel(e, "user_id", "ts", "lat", "lon", 86400, 5000.0, "event_id").select("event_id", F.round("km_moved", 3).alias("km"))


@query("discrepancy_classes", """WITH x AS (SELECT o_orderkey, o_totalprice AS a, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_totalprice + 0.5 WHEN o_orderkey % 3 = 0 THEN o_totalprice + 20 ELSE o_totalprice END AS b FROM orders)
SELECT CASE WHEN b IS NULL THEN 'missing' WHEN abs(a - b) = 0 THEN 'none' WHEN abs(a - b) > 1 THEN 'amount' ELSE 'rounding' END AS kind, CAST(count(*) AS BIGINT) AS n FROM x GROUP BY kind""")
def discrepancies(spark, sf):
    k, a = F.col("o_orderkey"), F.col("o_totalprice")
    x = table(spark, sf, "orders").select(a.alias("a"), F.when(k % 7 == 0, None).when(k % 5 == 0, a + 0.5).when(k % 3 == 0, a + 20).otherwise(a).alias("b"), F.col("o_orderdate").cast("date").alias("d"))
    return x.groupBy(quality.classify_discrepancy("a", "b", "d", "d").alias("kind")).agg(F.count("*").alias("n"))


@query("transform_fit", """SELECT p_partkey, round((p_retailprice - lo) / (hi - lo), 8) AS p_retailprice, round((p_size - m) / s, 8) AS p_size FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi, avg(p_size) AS m, stddev_pop(p_size) AS s FROM part) t""")
def transform_fit(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    out = quality.transform_columns(p, quality.fit_transforms(p, {"p_retailprice": "minmax", "p_size": "standard"}))
    return out.select("p_partkey", F.round("p_retailprice", 8).alias("p_retailprice"), F.round("p_size", 8).alias("p_size"))


# Incremental views by their state tables.
def _change(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    old = ivm.signed(o.filter("o_orderkey % 7 <> 0"))
    return old, ivm.signed(o.filter("o_orderkey % 7 = 0")).unionByName(ivm.signed(o.filter("o_orderkey % 7 = 1"), -1))


@query("ivm_state_linear", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a FROM orders WHERE o_orderkey % 7 <> 1 GROUP BY o_custkey")
def ivm_state_linear(spark, sf):
    old, delta = _change(spark, sf)
    state = ivm.linear_apply(ivm.linear_state(old, ["o_custkey"], "o_totalprice"), delta, ["o_custkey"], "o_totalprice")
    return ivm.linear_view(state, ["o_custkey"]).select("o_custkey", F.col("count").alias("n"), F.round("sum", 2).alias("s"), F.round("avg", 4).alias("a"))


@query("ivm_state_extremes", "SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi, CAST(count(DISTINCT o_totalprice) AS BIGINT) AS nd FROM orders WHERE o_orderkey % 7 <> 1 GROUP BY o_custkey")
def ivm_state_extremes(spark, sf):
    old, delta = _change(spark, sf)
    before = ivm.values_state(old, ["o_custkey"], "o_totalprice")
    after = ivm.values_apply(before, delta, ["o_custkey"], "o_totalprice")
    view = ivm.extremes_apply(ivm.extremes(before, ["o_custkey"], "o_totalprice"), after, delta, ["o_custkey"], "o_totalprice")
    return view.select("o_custkey", F.col("min").alias("lo"), F.col("max").alias("hi"), F.col("distinct").alias("nd"))


@query("ivm_sum_of_max", "SELECT round(sum(m), 2) AS sum_max FROM (SELECT max(o_totalprice) AS m FROM orders WHERE o_orderkey % 7 <> 1 GROUP BY o_custkey) t")
def ivm_sum_of_max(spark, sf):
    old, delta = _change(spark, sf)
    return ivm.sum_of_maxes(old.unionByName(delta), "o_custkey", "o_totalprice").select(F.round("sum_max", 2).alias("sum_max"))


def _window_view(name, columns, sql):
    @query(name, sql)
    def run(spark, sf):
        old, delta = _change(spark, sf)
        cols = columns()
        view = ivm.signed(ivm.visible(old).withColumns(cols))
        return ivm.visible(ivm.apply_delta(view, ivm.delta_window(old, delta, ["o_custkey"], cols))).select("o_orderkey", *[F.coalesce(c, F.lit(-1)).alias(c) for c in cols])


def _by(*order):
    return Window.partitionBy("o_custkey").orderBy(*order)


_window_view("ivm_rank", lambda: {"r": F.rank().over(_by("o_orderstatus")).cast("long"), "d": F.dense_rank().over(_by("o_orderstatus")).cast("long")}, "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d FROM orders WHERE o_orderkey % 7 <> 1 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
_window_view("ivm_lag_lead", lambda: {"b": F.lag("o_orderkey", 2).over(_by("o_orderdate", "o_orderkey")), "a": F.lead("o_orderkey").over(_by("o_orderdate", "o_orderkey"))}, "SELECT o_orderkey, coalesce(lag(o_orderkey, 2) OVER w, -1) AS b, coalesce(lead(o_orderkey) OVER w, -1) AS a FROM orders WHERE o_orderkey % 7 <> 1 WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")


@query("ivm_tumbling_sliding", """WITH o AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 1) SELECT 'tumbling' AS kind, date_trunc('month', o_orderdate) AS w, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS s FROM o GROUP BY w
UNION ALL SELECT 'sliding', w, CAST(count(*) AS BIGINT), round(sum(o_totalprice), 2) FROM (SELECT o_totalprice, unnest([date_trunc('month', o_orderdate), date_trunc('month', o_orderdate) - INTERVAL 1 MONTH]) AS w FROM o) t GROUP BY w""")
def ivm_windows(spark, sf):
    old, delta = _change(spark, sf)
    agg = [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("s")]
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).cast("timestamp_ntz")
    two = F.explode(F.array(month, (month - F.expr("INTERVAL 1 MONTH"))))
    out = None
    for kind, w in (("tumbling", month), ("sliding", two)):
        a, d = old.withColumn("w", w), delta.withColumn("w", w)
        view = ivm.signed(ivm.visible(a).groupBy("w").agg(*agg))
        one = ivm.visible(ivm.apply_delta(view, ivm.delta_group_by(a, d, ["w"], agg))).select(F.lit(kind).alias("kind"), "w", "n", "s")
        out = one if out is None else out.unionAll(one)
    return out


# Change streams and late data.
@query("causal_latest", "SELECT p.event_id, coalesce((SELECT max(c.event_id) FROM events c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND c.event_id <= p.event_id), -1) AS seen FROM events p WHERE p.event_type = 'purchase'")
def causal(spark, sf):
    e = table(spark, sf, "events").withColumn("clock", F.create_map(F.lit("n"), F.col("event_id")))
    v = e.filter("event_type = 'click'").select("user_id", "clock", F.col("event_id").alias("seen"), F.col("event_id").alias("wall"))
    out = joins.causal_latest(v, e.filter("event_type = 'purchase'").select("event_id", "user_id", "clock"), ["user_id"], "clock", "seen", "wall")
    return out.select("event_id", F.coalesce("seen", F.lit(-1).cast("long")).alias("seen"))


@query("causal_sort", "SELECT user_id AS \"group\", event_type AS producer, CAST(seq AS BIGINT) AS seq, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type, seq) - 1 AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS seq FROM events) t")
def causal_sort(spark, sf):
    seq = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")).cast("long")
    e = table(spark, sf, "events").select("user_id", F.col("event_type").alias("producer"), seq.alias("seq")).withColumn("clock", F.create_map("producer", "seq"))
    return cdc.causal_sort(e, "user_id", "producer", "seq", "clock")


@query("cdc_reorder_buffer", "SELECT event_id FROM events WHERE event_id <= (SELECT min(m) FROM (SELECT max(event_id) AS m FROM events GROUP BY user_id % 16) t)")
def reorder(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 16).alias("p"))
    return cdc.releasable(e, "p", "event_id").select("event_id")


@query("cdc_envelopes", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'd' ELSE 'u' END AS op, o_orderkey * 10 AS lsn, o_orderkey % 3 = 0 AS deleted, sha2 FROM (SELECT *, sha256(o_orderstatus) AS sha2 FROM orders) t WHERE o_orderkey % 10 <> 4 UNION ALL SELECT -1, 'dead', count(*), false, '' FROM orders WHERE o_orderkey % 10 = 4")
def envelopes(spark, sf):
    k = F.col("o_orderkey")
    image = F.struct(k.alias("o_orderkey"), F.col("o_orderstatus"))
    e = table(spark, sf, "orders").select(F.when(k % 10 == 4, F.lit("{broken")).otherwise(F.to_json(F.struct(F.when(k % 3 == 0, image).alias("before"), F.when(k % 3 != 0, image).alias("after"), F.when(k % 3 == 0, "d").otherwise("u").alias("op"), F.lit(1).alias("ts_ms"), F.struct((k * 10).alias("lsn")).alias("source")))).alias("value"))
    good, dead = cdc.dead_letters(cdc.flatten_envelope(e, "value", "o_orderkey: BIGINT, o_orderstatus: STRING"))
    good = good.select("o_orderkey", "op", "lsn", "deleted", scalar.hash_pii(F.col("o_orderstatus")).alias("sha2"))
    return good.unionAll(dead.agg(F.lit(-1).cast("long"), F.lit("dead"), F.count("*"), F.lit(False), F.lit("")))


@query("late_side_output", "SELECT 'late' AS side, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS s FROM events WHERE ts < TIMESTAMP '2024-01-10' UNION ALL SELECT 'on time', CAST(count(*) AS BIGINT), round(sum(value), 2) FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def late(spark, sf):
    import datetime as dt

    on, off = windows.split_late(table(spark, sf, "events"), "ts", dt.datetime(2024, 1, 10))
    one = lambda d, n: d.agg(F.lit(n).alias("side"), F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))
    return one(on, "on time").unionAll(one(off, "late"))


@query("watermark_global", "SELECT min(m) AS wm FROM (SELECT max(event_id) AS m FROM events GROUP BY user_id % 32) t")
def watermark_global(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_id").alias("wm"), (F.col("user_id") % 32).alias("k"))
    return watermarks.global_watermark(e, "wm", "k")


@query("watermark_lognormal_delay", "SELECT event_type, round(exp(avg(ln(d)) + 1.6448536269514722 * stddev_samp(ln(d))), 6) AS safe_delay, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type, 1.0 + (event_id * 7919) % 600 AS d FROM events) t GROUP BY event_type")
def lognormal(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.lit(0.0).alias("e"), (1.0 + (F.col("event_id") * 7919) % 600).alias("a"))
    return watermarks.lognormal_delay(e, "e", "a", ["event_type"], 0.05).select("event_type", F.round("safe_delay", 6).alias("safe_delay"), "n")


@query("watermark_windows_restated", """WITH r AS (SELECT event_id, user_id, value, epoch_us(ts) / 1e6 AS ev, epoch_us(ts) / 1e6 + (event_id * 7919) % 7200 AS ar FROM events), w AS (SELECT *, max(ev) OVER (PARTITION BY user_id ORDER BY ar, ev ROWS UNBOUNDED PRECEDING) - 1800 AS wm FROM r),
l AS (SELECT *, (floor(ev / 3600) + 1) * 3600 AS e, lag(wm) OVER (PARTITION BY user_id ORDER BY ar, ev) AS b FROM w) SELECT user_id, CAST(sum(CASE WHEN b >= e THEN 1 ELSE 0 END) AS BIGINT) AS late, CAST(count(*) AS BIGINT) AS restated FROM l GROUP BY user_id""")
def restated(spark, sf):
    ev = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    e = table(spark, sf, "events").select("event_id", "user_id", "value", ev.alias("ev")).withColumn("ar", F.col("ev") + (F.col("event_id") * 7919) % 7200)
    r = watermarks.replay(e.withColumn("wm", watermarks.fixed("ev", "ar", "user_id", 1800.0)), "ev", "ar", "wm", 3600.0, "user_id")
    o = watermarks.outcome(r, "wm", "ar", ["user_id"], "value")
    return o.groupBy("user_id").agg(F.sum("late_n").alias("late"), F.sum("restated_n").alias("restated"))


# Loops, comparisons, polling.
@query("iterate_reach", "WITH RECURSIVE e AS (SELECT DISTINCT user_id % 40 AS a, (user_id * 7 + 3) % 40 AS b FROM events WHERE user_id % 40 < 30), r(id, n) AS (SELECT CAST(1 AS BIGINT), 0 UNION SELECT b, n + 1 FROM r JOIN e ON r.id = e.a WHERE n < 45) SELECT id, CAST(min(n) AS INT) AS iteration FROM r GROUP BY id")
def iterate(spark, sf):
    e = table(spark, sf, "events").filter("user_id % 40 < 30").select((F.col("user_id") % 40).alias("a"), ((F.col("user_id") * 7 + 3) % 40).alias("b")).distinct()
    return graph.iterate(spark.range(1, 2), lambda front: front.join(e, F.col("id") == F.col("a")).select(F.col("b").alias("id")), ["id"])


@query("shadow_run", "SELECT CASE WHEN o_totalprice > 200000 AND o_orderstatus = 'F' THEN 'mismatch' ELSE 'match' END AS status, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY status")
def shadow(spark, sf):
    o = table(spark, sf, "orders")
    v1 = lambda d: d.select("o_orderkey", (F.col("o_totalprice") * 1.1).alias("due"))
    v2 = lambda d: d.select("o_orderkey", F.when((F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F"), F.col("o_totalprice")).otherwise(F.col("o_totalprice") * 1.1).alias("due"))
    return quality.compare_views(v1(o), v2(o), "o_orderkey", [], ["due"]).groupBy("status").agg(F.count("*").alias("n"))


@query("outbox_poll", "SELECT event_id, event_type FROM events WHERE event_id % 3 <> 0 ORDER BY event_id LIMIT 100")
def outbox(spark, sf):
    return table(spark, sf, "events").withColumn("sent", F.col("event_id") % 3 == 0).filter(~F.col("sent")).orderBy("event_id").limit(100).select("event_id", "event_type")


# The pipeline language, metrics and features.
@query("dsl_pipeline", """WITH j AS (SELECT o_orderstatus AS s, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 UNION ALL SELECT 'Z', c_acctbal FROM customer) SELECT s, CAST(count(*) AS BIGINT) AS n, round(sum(v), 2) AS total, max(v) AS top FROM j GROUP BY s""")
def dsl_pipeline(spark, sf):
    p = Pipeline(spark)
    for t in ("orders", "customer"):
        p.add(t, "source", format="parquet", location=f"{sf.rstrip('/')}/{t}.parquet")
    p.add("rich", "filter", ["customer"], condition="c_acctbal > 0").add("keyed", "select", ["rich"], columns=["c_custkey"], expressions={"o_custkey": "c_custkey"})
    p.add("joined", "join", ["orders", "keyed"], on="o_custkey")
    p.add("a", "sql", ["joined"], query="SELECT o_orderstatus AS s, o_totalprice AS v FROM {t0}").add("b", "sql", ["customer"], query="SELECT 'Z' AS s, c_acctbal AS v FROM {t0}")
    p.add("all", "union", ["a", "b"]).add("out", "aggregate", ["all"], by=["s"], aggregates={"n": ("count", "v"), "total": ("sum", "v"), "top": ("max", "v")})
    return p.compile("out").withColumn("total", F.round("total", 2))


@query("dsl_window", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def dsl_window(spark, sf):
    p = Pipeline(spark).add("events", "source", format="parquet", location=f"{sf.rstrip('/')}/events.parquet")
    p.add("out", "window", ["events"], time="ts", size="1 day", by=["event_type"], aggregates={"n": ("count", "value"), "total": ("sum", "value")})
    return p.compile("out").select(F.col("window_start").cast("timestamp_ntz").alias("w"), "event_type", "n", F.round("total", 2).alias("total"))


@query("semantic_metrics", """WITH m AS (SELECT o_orderstatus, date_trunc('month', o_orderdate) AS period, round(sum(o_totalprice), 2) AS revenue, CAST(count(*) AS BIGINT) AS orders FROM orders GROUP BY ALL) SELECT o_orderstatus, CAST(period AS VARCHAR) AS period, revenue, round(revenue / orders, 4) AS per_order, round(sum(revenue) OVER (PARTITION BY o_orderstatus ORDER BY period), 2) AS running FROM m""")
def semantic(spark, sf):
    m = Metrics(revenue={"kind": "simple", "measure": "sum(o_totalprice)"}, orders={"kind": "simple", "measure": "count(*)"}, per_order={"kind": "ratio", "numerator": "revenue", "denominator": "orders"}, running={"kind": "cumulative", "measure": "sum(o_totalprice)"})
    out = m.compute(table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), ["revenue", "per_order", "running"], ["o_orderstatus"], "o_orderdate")
    return out.select("o_orderstatus", F.date_format("period", "yyyy-MM-dd HH:mm:ss").alias("period"), F.round("revenue", 2).alias("revenue"), F.round("per_order", 4).alias("per_order"), F.round("running", 2).alias("running"))


@query("feature_registry", "SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS weekday, isodow(ts) >= 6 AS is_weekend, CASE WHEN value < 10 THEN 'micro' WHEN value < 100 THEN 'small' ELSE 'medium' END AS bucket FROM events")
def features(spark, sf):
    f = Features()
    for name, column in scalar.time_features(F.col("ts")).items():
        f.feature(name)(lambda df, column=column: column)
    f.feature("bucket")(lambda df: scalar.amount_bucket(F.col("value")))
    return f.compute(table(spark, sf, "events").select("event_id", "ts", "value")).drop("ts", "value")


@query("fn_business_days", "SELECT o_orderkey, CAST(round(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) * 5 / 7.0) AS INT) AS days FROM orders")
def business(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalar.business_days(F.lit("1992-01-01").cast("date"), F.col("o_orderdate").cast("date")).alias("days"))


@query("fn_term_days", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_size * 30 WHEN 1 THEN p_size * 365 WHEN 2 THEN p_size * 7 ELSE p_size END AS days FROM part")
def terms(spark, sf):
    unit = F.element_at(F.array(F.lit(" tháng"), F.lit(" years"), F.lit(" Weeks"), F.lit(" ngày")), F.col("p_size") % 4 + 1)
    return table(spark, sf, "part").select("p_partkey", scalar.term_days(F.concat("p_size", unit)).alias("days"))


@query("fn_token_ratios", """WITH t AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x <> '') AS b FROM part), s AS (SELECT p_partkey, array_to_string(list_sort(a), ' ') AS x, array_to_string(list_sort(b), ' ') AS y, list_distinct(a) AS da, list_distinct(b) AS db FROM t)
SELECT p_partkey, round(100.0 * (1 - levenshtein(x, y) / greatest(length(x), length(y))), 6) AS sort_ratio, round(100.0 * len(list_intersect(da, db)) / len(list_distinct(list_concat(da, db))), 6) AS set_ratio FROM s""")
def ratios(spark, sf):
    a, b = F.col("p_name"), F.col("p_type")
    return table(spark, sf, "part").select("p_partkey", F.round(joins.token_sort_ratio(a, b), 6).alias("sort_ratio"), F.round(joins.token_set_ratio(a, b), 6).alias("set_ratio"))


# Tables with a history.
@query("table_time_travel", "SELECT 'v0' AS what, CAST(count(*) AS BIGINT) AS n FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'v1', count(*) FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT 'v2', count(*) FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'insert', count(*) FROM customer WHERE c_acctbal > 0 AND c_custkey % 3 = 2 UNION ALL SELECT 'delete', count(*) FROM customer WHERE c_acctbal <= 0 AND c_custkey % 3 < 2 UNION ALL SELECT 'folders vacuumed', 2")
def time_travel(spark, sf):
    t, c = lake.SnapshotTable(spark, _new(spark, "versions")), table(spark, sf, "customer")
    t.write(c.filter("c_custkey % 3 = 0"))
    t.write(c.filter("c_custkey % 3 = 1"), "append")
    t.write(c.filter("c_acctbal > 0"))
    rows = [(f"v{v}", t.read(v).count()) for v in range(3)]
    rows += [(r["_change"], r["n"]) for r in t.changes(1, 2).groupBy("_change").agg(F.count("*").alias("n")).collect()]
    rows.append(("folders vacuumed", len(t.vacuum(1))))
    return spark.createDataFrame(rows, "what string, n long")


@query("table_partition_overwrite", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN n_regionkey = 2 THEN 1000 ELSE n_nationkey END) AS BIGINT) AS s FROM nation GROUP BY n_regionkey")
def partition_overwrite(spark, sf):
    path, n = _new(spark, "parts"), table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    lake.overwrite_partitions(n, path, ["n_regionkey"])
    lake.overwrite_partitions(n.filter("n_regionkey = 2").withColumn("n_nationkey", F.lit(1000)), path, ["n_regionkey"])
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("s"))


@query("table_compaction", "SELECT CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS s, true AS fewer, true AS sorted FROM lineitem")
def compaction(spark, sf):
    small, tidy = _new(spark, "small"), _new(spark, "tidy")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    li.repartition(24).write.parquet(small)
    before = spark.read.parquet(small)
    lake.compact(before, before.count(), 1 + before.count() // 4, ["l_orderkey"]).write.parquet(tidy)
    after = spark.read.parquet(tidy)
    ranges = after.groupBy(F.input_file_name().alias("f")).agg(F.min("l_orderkey").alias("lo"), F.max("l_orderkey").alias("hi"))
    apart = ranges.alias("a").join(ranges.alias("b"), F.col("a.f") < F.col("b.f")).filter("a.lo < b.hi AND b.lo < a.hi").isEmpty()  # one row a file
    return after.agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("s")).withColumn("fewer", F.lit(len(after.inputFiles()) < len(before.inputFiles()))).withColumn("sorted", F.lit(apart))


@query("table_snapshot_hard_deletes", """SELECT c_custkey, CAST(1 AS BIGINT) AS valid_from, CASE WHEN c_custkey % 5 = 0 THEN 2 WHEN c_custkey % 4 = 0 THEN 2 ELSE -1 END AS valid_to FROM customer WHERE c_custkey % 7 <> 0 UNION ALL SELECT c_custkey, 2, -1 FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 4 = 0 UNION ALL SELECT c_custkey, 2, -1 FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 5 <> 0""")
def snapshot(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    first = c.filter(k % 7 != 0).withColumn("u", F.lit(1).cast("long")).withColumn("valid_from", F.col("u")).withColumn("valid_to", F.lit(None).cast("long"))
    now = c.filter(k % 5 != 0).withColumn("u", F.when((k % 4 == 0) | (k % 7 == 0), 2).otherwise(1).cast("long"))
    return lake.snapshot(first, now, ["c_custkey"], "u").select("c_custkey", "valid_from", F.coalesce("valid_to", F.lit(-1).cast("long")).alias("valid_to"))


@query("table_raw_silver_gold", "SELECT CAST(ts AS DATE) AS day, upper(event_type) AS kind, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS s FROM events WHERE value > 1 GROUP BY ALL")
def raw_silver_gold(spark, sf):
    raw, silver = _new(spark, "raw"), _new(spark, "silver")
    table(spark, sf, "events").select(F.col("ts").cast("string").alias("ts"), F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")).alias("event_type"), F.when(F.col("value") > 1, F.col("value")).cast("string").alias("value")).write.option("header", True).csv(raw)
    tidy = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).csv(raw).select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.lower(F.trim("event_type")).alias("event_type"), F.col("value").cast("double").alias("value"))
    tidy.filter("value IS NOT NULL").write.parquet(silver)
    return spark.read.parquet(silver).groupBy(F.col("ts").cast("date").alias("day"), F.upper("event_type").alias("kind")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("s"))


@query("table_fact_daily_revenue", "SELECT CAST(o_orderdate AS DATE) AS day, CAST(count(*) AS BIGINT) AS orders, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, round(sum(o_totalprice), 2) AS revenue FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY day")
def fact_daily(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal > 0")
    fact = table(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return fact.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("orders"), F.countDistinct("c_custkey").alias("customers"), F.round(F.sum("o_totalprice"), 2).alias("revenue"))


@query("conflicts_last_writer", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def conflicts(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "event_type", F.concat(F.lit("r"), F.col("event_id") % 3).alias("region"))
    return lake.conflicts_lww(e, ["user_id"], "event_id", "region").select("user_id", "event_id", "event_type")


@query("rate_trends", """WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS y FROM events GROUP BY 1) SELECT day, """ + ", ".join(f"round(y - avg(y) OVER (ORDER BY day ROWS BETWEEN {n} PRECEDING AND CURRENT ROW), 6) AS t{n}" for n in (7, 30, 90)) + " FROM d")
def rate_trends(spark, sf):
    d = table(spark, sf, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("y"))
    w = Window.orderBy("day")  # one row a day
    return d.select("day", *[F.round(F.col("y") - F.avg("y").over(w.rowsBetween(-n, 0)), 6).alias(f"t{n}") for n in (7, 30, 90)])


# Joins: any cyclic query in one shuffle, and an as-of join without a key.
_G = "g AS (SELECT DISTINCT user_id % 60 AS a, event_id % 61 AS b FROM events WHERE value > 95)"


def _cyclic(name, shape, sql):
    """How many results each x is in."""

    @query(name, f"WITH {_G}, j AS ({sql}) SELECT x, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY x")
    def run(spark, sf):
        g = table(spark, sf, "events").filter("value > 95").select((F.col("user_id") % 60).alias("a"), (F.col("event_id") % 61).alias("b")).distinct()
        return joins.generic_join([g.toDF(*pair) for pair in shape], by=["x"])


_cyclic("generic_join_triangle", [("x", "y"), ("y", "z"), ("z", "x")], "SELECT p.a AS x, p.b AS y, q.b AS z FROM g p JOIN g q ON p.b = q.a JOIN g r ON q.b = r.a AND r.b = p.a")
_cyclic("generic_join_bowtie", [("x", "y"), ("y", "z"), ("z", "x"), ("x", "u"), ("u", "v"), ("v", "x")], "SELECT p.a AS x, p.b AS y, q.b AS z, s.b AS u, t.b AS v FROM g p JOIN g q ON p.b = q.a JOIN g r ON q.b = r.a AND r.b = p.a JOIN g s ON s.a = p.a JOIN g t ON t.a = s.b JOIN g w ON w.a = t.b AND w.b = p.a")
_cyclic("generic_join_four_cycle", [("x", "y"), ("y", "z"), ("z", "w"), ("w", "x")], "SELECT p.a AS x, p.b AS y, q.b AS z, r.b AS w FROM g p JOIN g q ON p.b = q.a JOIN g r ON q.b = r.a JOIN g s ON r.b = s.a AND s.b = p.a")


@query("asof_without_key", "SELECT p.event_id, coalesce(c.event_id, -1) AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.ts >= c.ts")
def asof_without_key(spark, sf):
    e = table(spark, sf, "events")
    right = e.filter("event_type = 'click'").select(F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    out = joins.asof_join(e.filter("event_type = 'purchase'").select("event_id", "ts"), right, [], "ts", "click_ts", ["click_id"], tie="click_id")
    return out.select("event_id", F.coalesce("click_id", F.lit(-1).cast("long")).alias("click_id"))


@query("asof_hot_keys", "SELECT p.event_id, coalesce(c.event_id, -1) AS click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id % 3 = c.user_id % 3 AND p.ts >= c.ts")
def asof_hot_keys(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.col("user_id") % 3)
    right = e.filter("event_type = 'click'").select("k", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    out = joins.asof_join(e.filter("event_type = 'purchase'").select("event_id", "k", "ts"), right, ["k"], "ts", "click_ts", ["click_id"], tie="click_id", ranges=True)
    return out.select("event_id", F.coalesce("click_id", F.lit(-1).cast("long")).alias("click_id"))


# Shapes of join-order benchmarks over the star schema: chains, stars, snowflakes, self-joins and cycles of up to nine tables, least values out.
_SHAPES = {
    "chain": "SELECT min(r_name) AS a, min(c_name) AS b, min(o_totalprice) AS c FROM region, nation, customer, orders WHERE r_regionkey = n_regionkey AND n_nationkey = c_nationkey AND c_custkey = o_custkey AND o_orderpriority LIKE '1%' AND c_mktsegment = 'BUILDING'",
    "star": "SELECT min(p_name) AS a, min(s_name) AS b, min(o_orderdate) AS c FROM lineitem, part, supplier, orders WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND l_orderkey = o_orderkey AND p_size IN (1, 5, 9) AND s_acctbal > 0 AND o_orderstatus = 'F'",
    "snowflake": "SELECT min(p_type) AS a, min(n1.n_name) AS b, min(n2.n_name) AS c, min(l_extendedprice) AS d FROM lineitem, part, supplier, orders, customer, nation n1, nation n2 WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND p_brand LIKE 'Brand#1%' AND l_quantity > 40",
    "two_snowflakes": "SELECT min(r1.r_name) AS a, min(r2.r_name) AS b, min(p_name) AS c FROM lineitem, part, supplier, orders, customer, nation n1, nation n2, region r1, region r2 WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_regionkey = r1.r_regionkey AND n2.n_regionkey = r2.r_regionkey AND r1.r_name <> r2.r_name AND p_size < 10",
    "same_nation_cycle": "SELECT min(c_name) AS a, min(s_name) AS b, min(l_extendedprice) AS c FROM customer, orders, lineitem, supplier, nation WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND l_returnflag = 'R'",
    "self_join": "SELECT min(a.o_orderkey) AS a, min(b.o_orderkey) AS b, CAST(count(*) AS BIGINT) AS n FROM orders a, orders b, customer WHERE a.o_custkey = c_custkey AND b.o_custkey = c_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderstatus = 'P' AND b.o_orderpriority LIKE '2%' AND c_acctbal > 5000",
    "part_pairs": "SELECT min(p1.p_name) AS a, min(p2.p_name) AS b, CAST(count(*) AS BIGINT) AS n FROM lineitem l1, lineitem l2, part p1, part p2 WHERE l1.l_orderkey = l2.l_orderkey AND l1.l_linenumber < l2.l_linenumber AND l1.l_partkey = p1.p_partkey AND l2.l_partkey = p2.p_partkey AND p1.p_size = 1 AND p2.p_size = 2",
    "or_and_in": "SELECT min(n_name) AS a, min(s_name) AS b, CAST(count(*) AS BIGINT) AS n FROM supplier, nation, lineitem, part WHERE s_nationkey = n_nationkey AND l_suppkey = s_suppkey AND l_partkey = p_partkey AND (p_type LIKE 'PROMO%' OR p_size > 45) AND n_name IN (SELECT n_name FROM nation WHERE n_regionkey IN (1, 2))",
    "exists_chain": "SELECT min(c_name) AS a, CAST(count(*) AS BIGINT) AS n FROM customer, nation WHERE c_nationkey = n_nationkey AND EXISTS (SELECT 1 FROM orders, lineitem WHERE o_custkey = c_custkey AND l_orderkey = o_orderkey AND l_discount > 0.09) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "date_bands": "SELECT min(c_name) AS a, min(o_totalprice) AS b, max(l_shipdate) AS c FROM customer, orders, lineitem, supplier, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' AND l_shipdate > o_orderdate AND n_name LIKE '%A%'",
}
for _name, _sql in _SHAPES.items():
    sql_query(f"join_order_{_name}", _sql)


@query("timeline_ops", """WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type IN ('click', 'view') AND event_id % 5 <> 0), p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
b AS (SELECT p.event_id, coalesce(c.event_id, -1) AS before FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts), a AS (SELECT p.event_id, coalesce(c.event_id, -1) AS after FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts <= c.ts),
n AS (SELECT p.event_id, count(c.event_id) AS n FROM p LEFT JOIN c ON p.user_id = c.user_id AND c.ts BETWEEN p.ts - INTERVAL 2 HOURS AND p.ts + INTERVAL 1 HOUR GROUP BY p.event_id) SELECT event_id, before, after, CAST(n AS BIGINT) AS near FROM b JOIN a USING (event_id) JOIN n USING (event_id)""")
def timeline_ops(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "user_id", "ts")
    points = lambda p: e.filter(p).select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("at"))
    line = joins.Timeline(points("event_type = 'click'"), ["user_id"], "at").insert(points("event_type = 'view'")).delete(points("event_type IN ('click', 'view') AND event_id % 5 = 0"))
    asked, none = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), F.lit(-1).cast("long")
    before = line.predecessor(asked, "ts", ["id"]).select("event_id", F.coalesce("id", none).alias("before"))
    after = line.successor(asked, "ts", ["id"]).select("event_id", F.coalesce("id", none).alias("after"))
    near = line.range_query(asked, "ts", 7200, 3600).groupBy("event_id").agg(F.count("*").alias("near"))
    return before.join(after, "event_id").join(near, "event_id", "left").select("event_id", "before", "after", F.coalesce("near", F.lit(0)).cast("long").alias("near"))


@query("fn_hilbert_nd", " UNION ALL ".join(f"SELECT {d} AS dimensions, CAST({2 ** (d * b)} AS BIGINT) AS n, CAST(0 AS BIGINT) AS lo, CAST({2 ** (d * b) - 1} AS BIGINT) AS hi, CAST({2 ** (d * b) - 1} AS BIGINT) AS neighbours" for d, b in ((2, 4), (3, 3), (4, 2))))
def hilbert_nd(spark, sf):
    out = None
    for d, b in ((2, 4), (3, 3), (4, 2)):
        axes = [F.shiftright("id", b * i).bitwiseAND(F.lit((1 << b) - 1)).alias(f"x{i}") for i in range(d)]
        k = spark.range(1 << d * b).select(*axes).withColumn("d", scalar.hilbert_key_nd([F.col(f"x{i}") for i in range(d)], b))
        w = Window.orderBy("d")  # a few hundred rows
        step = sum((F.abs(F.col(f"x{i}") - F.lag(f"x{i}").over(w)) for i in range(d)), F.lit(0))
        one = k.withColumn("s", step).agg(F.lit(d).alias("dimensions"), F.countDistinct("d").alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.count_if(F.col("s") == 1).alias("neighbours"))
        out = one if out is None else out.unionAll(one)
    return out


@query("stream_alerts", "SELECT CAST(user_id AS VARCHAR) AS key, event_id, value AS amount FROM events WHERE event_type = 'purchase' AND value > 60")
def stream_alerts(spark, sf):
    out = _new(spark, "alerts")
    e = windows.parquet_stream(spark, f"{sf.rstrip('/')}/events.parquet").filter("event_type = 'purchase' AND value > 60").select("user_id", "event_id", "value")
    cdc.write_alerts(e, "user_id", "json", _new(spark, "alerts-at"), {"path": out}).awaitTermination()
    got = spark.read.schema("key STRING, value STRING").json(out).withColumn("v", F.from_json("value", "event_id BIGINT, value DOUBLE"))
    return got.select("key", F.col("v.event_id").alias("event_id"), F.col("v.value").alias("amount"))
