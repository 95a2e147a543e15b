"""Relational queries: projection, filters, joins, aggregates, windows, sorting, sets and subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.operators.windows import first_numbered, global_ntile, global_rank
from quernstone.plans.registry import query
from quernstone.plans.sqlpair import sql_query as q
from quernstone.sources.tables import table

# Decision support over the star schema (q1 is in tpch.py).
q("tpch_q3", """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, CAST(CAST(o_orderdate AS DATE) AS STRING) AS o_date
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, CAST(o_orderdate AS DATE) ORDER BY revenue DESC, l_orderkey LIMIT 10""")
q("tpch_q4", """SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS order_count FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate) GROUP BY o_orderpriority""")
q("tpch_q5", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
AND r_name = 'ASIA' GROUP BY n_name""")
q("tpch_q6", """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
q("tpch_q10", """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-04-01'
GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
q("tpch_q12", """SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_count,
CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_returnflag""")
q("tpch_q14", """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""")
q("tpch_q19", """SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)""")
q("tpch_q18", """SELECT c_name, o_orderkey, round(o_totalprice, 2) AS total, round(sum(l_quantity), 2) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) GROUP BY c_name, o_orderkey, o_totalprice ORDER BY total DESC, o_orderkey LIMIT 100""")

# Projection, filters and expressions.
q("project_expressions", """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax - 0.5, 4) AS net, -l_quantity AS neg, l_quantity / 7 AS ratio,
CAST(l_quantity AS BIGINT) AS qty, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS band FROM lineitem""")
q("filter_kleene", """SELECT l_orderkey, l_linenumber FROM lineitem WHERE (NULLIF(l_returnflag, 'A') = 'R' OR l_quantity > 45) AND NOT (l_linestatus = 'F' AND NULLIF(l_discount, 0) IS NULL)""")
q("filter_in_between_like", """SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (1, 5, 9, 13) AND p_retailprice BETWEEN 900 AND 1800 AND p_name LIKE '%e%' AND p_brand NOT IN ('Brand#1', 'Brand#2') AND p_name NOT LIKE 'red%'""")
q("predicate_null_tests", """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(NULLIF(l_discount, 0)) AS BIGINT) AS nonzero, CAST(sum(CASE WHEN NULLIF(l_tax, 0) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS notax FROM lineitem""")
q("safe_divide", """SELECT o_orderkey, round(coalesce(o_totalprice / NULLIF(o_custkey % 5, 0), -1), 4) AS per FROM orders""")
q("amount_buckets", """SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN value < 1 THEN 'micro' WHEN value < 10 THEN 'small' WHEN value < 50 THEN 'medium' WHEN value < 100 THEN 'large' ELSE 'whale' END AS bucket FROM events) t GROUP BY bucket""")
q("price_bands", """SELECT CASE WHEN o_totalprice < 50000 THEN '<50k' WHEN o_totalprice < 100000 THEN '50k-100k' WHEN o_totalprice < 250000 THEN '100k-250k' ELSE '250k+' END AS band, CAST(count(*) AS BIGINT) AS n, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1""")
q("greatest_coalesce", """SELECT c_custkey, greatest(c_acctbal, 0) AS floor0, least(c_acctbal, 5000) AS cap, coalesce(NULLIF(c_mktsegment, 'BUILDING'), 'B') AS seg FROM customer""")

# Joins.
q("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 400000")
q("join_left", "SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F' GROUP BY c_custkey")
q("join_right", "SELECT n_name, CAST(count(s_suppkey) AS BIGINT) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000 GROUP BY n_name")
q("join_full", "SELECT coalesce(CAST(a.k AS BIGINT), -1) AS ak, coalesce(CAST(b.k AS BIGINT), -1) AS bk FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9990) a FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier) b ON a.k = b.k")
q("join_semi", "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 450000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 450000)")
q("join_anti", "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)")
q("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
q("join_theta", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey < b.n_regionkey AND a.n_nationkey > b.n_nationkey + 3")
q("join_using", "SELECT CAST(count(*) AS BIGINT) AS n FROM lineitem l LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY l_orderkey) m USING (l_orderkey) WHERE last IS NOT NULL")
q("join_star", """SELECT n_name, p_brand, CAST(count(*) AS BIGINT) AS n, round(sum(l_extendedprice), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey
LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN part ON l_partkey = p_partkey GROUP BY n_name, p_brand""")
q("join_order_benchmark_shape", """SELECT min(c_name) AS first_customer, min(p_name) AS first_part, min(s_name) AS first_supplier FROM customer, orders, lineitem, part, supplier, nation, region
WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND p_type = 'PROMO' AND r_name IN ('ASIA', 'EUROPE') AND o_totalprice > 200000""")
q("join_null_keys", "SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT NULLIF(c_nationkey, 3) AS k FROM customer) a JOIN (SELECT NULLIF(n_nationkey, 3) AS k FROM nation) b ON a.k = b.k")

# Aggregates.
q("agg_basic", "SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_tax), 6) AS a, min(l_discount) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag")
q("agg_global_empty", "SELECT CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS s FROM lineitem WHERE l_quantity < 0")
q("agg_having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15 AND sum(o_totalprice) > 1000000")
q("agg_distinct", "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS priorities FROM orders GROUP BY o_orderstatus")
q("agg_filter", "SELECT event_type, CAST(count(*) FILTER (WHERE value > 50) AS BIGINT) AS high, round(sum(value) FILTER (WHERE user_id % 2 = 0), 2) AS even_sum FROM events GROUP BY event_type")
q("agg_expression_of_aggregates", "SELECT l_linestatus, round(sum(l_extendedprice) / sum(l_quantity), 4) AS unit, round(max(l_tax) - min(l_tax), 4) AS spread FROM lineitem GROUP BY l_linestatus")
q("agg_grouping_sets", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
q("agg_cube", "SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
q("agg_rollup", "SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
q("agg_median_stddev", "SELECT event_type, round(median(value), 4) AS med, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS vp FROM events GROUP BY event_type")
q("agg_percentile", "SELECT l_returnflag, round(percentile(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag")
q("agg_any_first_last", "SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order, max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_order FROM orders GROUP BY o_custkey")
q("agg_collect", "SELECT o_custkey, array_join(sort_array(collect_list(CAST(o_orderkey AS STRING))), ',') AS orders_of FROM orders GROUP BY o_custkey", "SELECT o_custkey, array_to_string(list_sort(list(CAST(o_orderkey AS VARCHAR))), ',') AS orders_of FROM orders GROUP BY o_custkey")
q("agg_vwap", "SELECT event_type, round(CASE WHEN sum(k) > 0 THEN sum(value * k) / sum(k) ELSE avg(value) END, 6) AS vwap FROM (SELECT event_type, value, CAST(get_json_object(props, '$.k') AS DOUBLE) AS k FROM events) t GROUP BY event_type", "SELECT event_type, round(CASE WHEN sum(k) > 0 THEN sum(value * k) / sum(k) ELSE avg(value) END, 6) AS vwap FROM (SELECT event_type, value, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events) t GROUP BY event_type")
q("agg_nested_max_of_sum", "SELECT max(s) AS top, max_by(o_custkey, struct(s, o_custkey)) AS who FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey) t", "SELECT max(s) AS top, arg_max(o_custkey, (s, o_custkey)) AS who FROM (SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey) t")
q("agg_nested_sum_of_max", "SELECT round(sum(m), 2) AS total FROM (SELECT max(o_totalprice) AS m FROM orders GROUP BY o_custkey) t")
q("agg_cohort_latency", "SELECT event_type, CAST(hour(ts) AS BIGINT) AS h, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN value > 90 THEN 1 END) AS BIGINT) AS errors, round(percentile(value, 0.95), 4) AS p95 FROM events GROUP BY event_type, hour(ts)", "SELECT event_type, hour(ts) AS h, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN value > 90 THEN 1 END) AS BIGINT) AS errors, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY event_type, hour(ts)")
q("agg_batch_plus_speed", """WITH batch AS (SELECT user_id, count(*) AS n, sum(value) AS s FROM events WHERE ts < DATE '2024-01-20' GROUP BY user_id),
speed AS (SELECT user_id, count(*) AS n, sum(value) AS s FROM events WHERE ts >= DATE '2024-01-20' GROUP BY user_id)
SELECT user_id, CAST(sum(n) AS BIGINT) AS n, round(sum(s), 2) AS total, round(sum(s) / sum(n), 4) AS mean FROM (SELECT * FROM batch UNION ALL SELECT * FROM speed) t GROUP BY user_id""")

# Windows.
q("win_rank_family", """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr,
CAST(ntile(4) OVER w AS BIGINT) AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
q("win_lag_lead", "SELECT event_id, lag(value, 1) OVER w AS before, lead(value, 2) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
q("win_rows_sum_avg", "SELECT event_id, round(sum(value) OVER w, 4) AS s, round(avg(value) OVER w, 4) AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
q("win_running_total", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS running, round(sum(o_totalprice) OVER (PARTITION BY o_custkey), 2) AS total FROM orders")
@query("win_rank_over_aggregate", "SELECT o_custkey, CAST(rank() OVER (ORDER BY round(sum(o_totalprice), 2) DESC) AS BIGINT) AS rk FROM orders GROUP BY o_custkey")
def rank_over_aggregate(spark, sf):
    sums = table(spark, sf, "orders").groupBy("o_custkey").agg((-F.round(F.sum("o_totalprice"), 2)).alias("s"))
    return global_rank(sums, "s", "rk").select("o_custkey", F.col("rk").cast("long").alias("rk"))


q("win_topn_per_group", "SELECT * FROM (SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rn FROM customer) t WHERE rn <= 2")
q("win_range_24h", "SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM events")
q("win_ytd", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS ytd FROM orders")
@query("rfm", """WITH c AS (SELECT o_custkey, datediff('day', CAST(max(o_orderdate) AS DATE), DATE '2002-01-01') AS recency, count(*) AS frequency, round(sum(o_totalprice), 2) AS monetary FROM orders GROUP BY o_custkey)
SELECT o_custkey, concat(CAST(ntile(5) OVER (ORDER BY recency DESC, o_custkey) AS VARCHAR), CAST(ntile(5) OVER (ORDER BY frequency, o_custkey) AS VARCHAR), CAST(ntile(5) OVER (ORDER BY monetary, o_custkey) AS VARCHAR)) AS rfm FROM c""")
def rfm(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey").agg((-F.datediff(F.lit("2002-01-01").cast("date"), F.max("o_orderdate").cast("date"))).alias("recency"), F.count("*").alias("frequency"), F.round(F.sum("o_totalprice"), 2).alias("monetary"))
    for c in ("recency", "frequency", "monetary"):
        o = global_ntile(o, [c, "o_custkey"], 5, f"_{c}")
    return o.select("o_custkey", F.concat(*[F.col(f"_{c}").cast("string") for c in ("recency", "frequency", "monetary")]).alias("rfm"))


q("mom_yoy", """WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY 1)
SELECT CAST(month AS STRING) AS month, revenue, round(revenue / NULLIF(lag(revenue) OVER (ORDER BY month), 0) - 1, 6) AS mom, round(revenue / NULLIF(lag(revenue, 12) OVER (ORDER BY month), 0) - 1, 6) AS yoy FROM m""")
q("cohort_ltv", """WITH f AS (SELECT o_custkey, year(min(o_orderdate)) AS cohort FROM orders GROUP BY o_custkey), s AS (SELECT cohort, count(*) AS size FROM f GROUP BY cohort),
m AS (SELECT cohort, year(o_orderdate) - cohort AS age, sum(o_totalprice) AS revenue FROM orders JOIN f USING (o_custkey) GROUP BY cohort, year(o_orderdate) - cohort)
SELECT CAST(m.cohort AS BIGINT) AS cohort, CAST(age AS BIGINT) AS age, round(sum(revenue) OVER (PARTITION BY m.cohort ORDER BY age) / size, 4) AS ltv FROM m JOIN s ON m.cohort = s.cohort""")
q("dedup_latest", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) t WHERE rn = 1")
q("log_return", "SELECT event_id, round(ln(value / lag(value) OVER (PARTITION BY event_type ORDER BY ts, event_id)), 6) AS r FROM events WHERE value > 0")
q("velocity_rule", "SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS n FROM events WHERE event_type = 'purchase') t WHERE n > 2")
q("rate_trend", "SELECT event_type, max_by(value, struct(ts, event_id)) FILTER (WHERE ts <= DATE '2024-01-23') AS d7, max_by(value, struct(ts, event_id)) AS now FROM events GROUP BY event_type", "SELECT event_type, arg_max(value, (ts, event_id)) FILTER (WHERE ts <= DATE '2024-01-23') AS d7, arg_max(value, (ts, event_id)) AS now FROM events GROUP BY event_type")

# Sorting, limits and sets.
q("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 10")
q("sort_multi_key", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand, p_size DESC, p_partkey LIMIT 50")
q("topk_group_count", "SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 10")
@query("topn_rank_column", "SELECT CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS BIGINT) AS place, s_suppkey FROM supplier ORDER BY place LIMIT 10")
def topn_rank_column(spark, sf):
    return first_numbered(table(spark, sf, "supplier"), [F.desc("s_acctbal"), "s_suppkey"], 10, "place").select("place", "s_suppkey")


q("set_union_all", "SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
q("set_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
q("set_intersect", "SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size < 10")
q("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
q("select_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
q("recursive_spine", "WITH RECURSIVE d(n) AS (SELECT 0 UNION ALL SELECT n + 1 FROM d WHERE n < 6) SELECT CAST(n AS BIGINT) AS n, CAST(count(event_id) AS BIGINT) AS events_of FROM d LEFT JOIN events ON day(ts) = n + 1 GROUP BY n")

# Subqueries and spines.
q("sub_from", "SELECT status, CAST(max(n) AS BIGINT) AS most FROM (SELECT o_orderstatus AS status, o_custkey, count(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) t GROUP BY status")
q("sub_correlated_avg", "SELECT o_orderkey FROM orders o WHERE o_totalprice > 1.8 * (SELECT avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
q("sub_scalar_having", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > (SELECT avg(s) * 1.5 FROM (SELECT sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) t)")
q("sub_correlated_count", "SELECT n_name, (SELECT CAST(count(*) AS BIGINT) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation")
q("sub_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
q("sub_max_relative", "SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 3 DAYS")
q("cte_chain", """WITH a AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), b AS (SELECT c_nationkey, round(sum(s), 2) AS t FROM a JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey)
SELECT c_nationkey, t, CAST(rank() OVER (ORDER BY t DESC) AS BIGINT) AS rk FROM b""")
q("date_dimension", "SELECT CAST(d AS STRING) AS day, CAST(year(d) AS BIGINT) AS y, CAST(quarter(d) AS BIGINT) AS qtr, CAST(month(d) AS BIGINT) AS m, CAST(dayofweek(d) - 1 AS BIGINT) AS dow, CAST(dayofyear(d) AS BIGINT) AS doy FROM (SELECT explode(sequence(DATE '1997-01-01', DATE '1997-12-31', INTERVAL 1 DAY)) AS d) t", "SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, year(d) AS y, quarter(d) AS qtr, month(d) AS m, dayofweek(d) AS dow, dayofyear(d) AS doy FROM range(DATE '1997-01-01', DATE '1998-01-01', INTERVAL 1 DAY) t(d)")
q("cohort_retention", """WITH f AS (SELECT user_id, CAST(min(ts) AS DATE) AS first_day FROM events GROUP BY user_id)
SELECT CAST(first_day AS STRING) AS first_day, CAST(datediff(CAST(ts AS DATE), first_day) AS BIGINT) AS age, CAST(count(DISTINCT e.user_id) AS BIGINT) AS users FROM events e JOIN f ON e.user_id = f.user_id GROUP BY first_day, datediff(CAST(ts AS DATE), first_day)""", """WITH f AS (SELECT user_id, CAST(min(ts) AS DATE) AS first_day FROM events GROUP BY user_id)
SELECT CAST(first_day AS STRING) AS first_day, CAST(datediff('day', first_day, CAST(ts AS DATE)) AS BIGINT) AS age, CAST(count(DISTINCT e.user_id) AS BIGINT) AS users FROM events e JOIN f ON e.user_id = f.user_id GROUP BY first_day, datediff('day', first_day, CAST(ts AS DATE))""")

# Streaming windows as batch twins; the streaming forms are in quernstone.streaming.
q("window_tumbling", "SELECT window(ts, '1 hour').start AS w, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS s FROM events GROUP BY window(ts, '1 hour'), event_type", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS s FROM events GROUP BY ALL")
q("window_sliding", "SELECT window(ts, '2 hours', '1 hour').start AS w, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY window(ts, '2 hours', '1 hour')", "SELECT w, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) t GROUP BY w")
q("window_session", "SELECT user_id, session_window(ts, '30 minutes').start AS s, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id, session_window(ts, '30 minutes')", """SELECT user_id, min(ts) AS s, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events) a) b GROUP BY user_id, g""")
q("window_ohlc", """SELECT window(ts, '6 hours').start AS w, event_type, min_by(value, struct(ts, event_id)) AS o, max(value) AS h, min(value) AS l, max_by(value, struct(ts, event_id)) AS c FROM events GROUP BY window(ts, '6 hours'), event_type""", """SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS w, event_type, arg_min(value, (ts, event_id)) AS o, max(value) AS h, min(value) AS l, arg_max(value, (ts, event_id)) AS c FROM events GROUP BY ALL""")
