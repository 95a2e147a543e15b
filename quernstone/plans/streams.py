"""Structured Streaming queries, each run over the events table to its end, with the batch SQL that must agree."""

from __future__ import annotations

import tempfile

from pyspark.sql import functions as F

from quernstone.plans.registry import query
from quernstone.sources import products
from quernstone.sources.tables import table
from quernstone.streaming import asof, cdc, cep, watermarks, windows


def _folder(spark) -> str:
    """The shared folder for checkpoints; in local mode (tests), where none is set, a local one; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{base.rstrip('/')}/streams" if base else tempfile.mkdtemp(prefix="streams")


def _stream(spark, sf):
    return windows.parquet_stream(spark, f"{sf.rstrip('/')}/events.parquet")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS s FROM events GROUP BY ALL")
def tumbling(spark, sf):
    s = windows.tumbling(_stream(spark, sf), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.sum("value").alias("s")])
    return windows.finished(s, _folder(spark), "complete").select(F.col("window_start").cast("timestamp_ntz").alias("w"), "event_type", "n", F.round("s", 2).alias("s"))


@query("stream_sliding", "SELECT w, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS w FROM events) t GROUP BY w")
def sliding(spark, sf):
    s = windows.sliding(_stream(spark, sf), "ts", "2 hours", "1 hour", [], [F.count("*").alias("n")])
    return windows.finished(s, _folder(spark), "complete").select(F.col("window_start").cast("timestamp_ntz").alias("w"), "n")


@query("stream_session", "SELECT user_id, min(ts) AS s, CAST(count(*) AS BIGINT) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL THEN 1 ELSE 0 END AS new FROM events) a) b GROUP BY user_id, g")
def session(spark, sf):
    s = windows.sessions(_stream(spark, sf), "ts", "30 minutes", ["user_id"], [F.count("*").alias("n")])
    return windows.finished(s, _folder(spark), "complete").select("user_id", F.col("window_start").cast("timestamp_ntz").alias("s"), "n")


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def dedupe(spark, sf):
    s = windows.distinct_within(_stream(spark, sf).select("user_id", "event_type", "ts"), ["user_id", "event_type"], "ts", "60 days")
    return windows.finished(s, _folder(spark)).select("user_id", "event_type")


@query("stream_join", "SELECT p.event_id AS purchase, c.event_id AS click FROM events p JOIN events c ON p.user_id = c.user_id AND p.event_type = 'purchase' AND c.event_type = 'click' AND c.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts")
def join(spark, sf):
    p = _stream(spark, sf).filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    c = _stream(spark, sf).filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return windows.finished(windows.stream_join(p, c, "user_id", "ts", "ts", "1 HOUR"), _folder(spark)).select(F.col("event_id").alias("purchase"), F.col("right_event_id").alias("click"))


@query("stream_ohlc_twin", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, event_type, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL")
def ohlc(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return windows.ohlc(e, "ts", "1 day", ["event_type"], "value", "k", "event_id").select(F.col("window_start").cast("timestamp_ntz").alias("w"), "event_type", "open", "high", "low", "close")


@query("cep_batch")
def cep_batch(spark, sf):
    p = cep.Pattern("view-click-buy").begin("view").then("click", gap=36000).then("purchase", gap=36000).within(86400)
    return cep.match(table(spark, sf, "events"), [p], "user_id", "ts", "event_type", "value", order="event_id")


@query("cep_stream")
def cep_stream(spark, sf):
    p = cep.Pattern("view-click-buy").begin("view").then("click", gap=36000).then("purchase", gap=36000).within(86400)
    return windows.finished(cep.match_stream(_stream(spark, sf), p, "user_id", "ts", "event_type", "value"), _folder(spark))


def _recorded(spark, sf):
    """Events with an arrival up to two hours after, by a number that their id gives."""
    e = table(spark, sf, "events").withColumn("event", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.withColumn("arrival", F.col("event") + (F.col("event_id") * 7919) % 7200)


@query("asof_corrections_stand", "SELECT p.event_id AS left_id, coalesce(c.event_id, -1) AS right_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') c ON p.user_id = c.user_id AND p.ts >= c.ts")
def corrections(spark, sf):
    e = _recorded(spark, sf).filter("event_type IN ('purchase', 'click')").select("user_id", "event", "arrival", F.when(F.col("event_type") == "purchase", "left").otherwise("right").alias("side"), F.col("event_id").cast("double").alias("v"))

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values("arrival")
        out = [(str(pdf.user_id.iloc[0]), *r) for r in asof.fold(zip(pdf.event, pdf.side, pdf.v), asof.fresh(), 1e12, 1e12)]
        return pd.DataFrame(out, columns=["key", "left_ts", "left_value", "right_ts", "right_value", "op"])

    standing = asof.net(e.groupBy("user_id").applyInPandas(run, asof.SCHEMA))
    return standing.select(F.col("left_value").cast("long").alias("left_id"), F.coalesce(F.nanvl("right_value", F.lit(None)), F.lit(-1.0)).cast("long").alias("right_id"))


_REPLAY = """{name} AS (SELECT '{text}' AS strategy, round(count(*) FILTER (NOT coalesce(b >= e, false)) / count(*), 6) AS completeness, CAST(count(*) FILTER (coalesce(b >= e, false)) AS BIGINT) AS late FROM (SELECT *, (floor(ev / 600) + 1) * 600 AS e, lag(wm) OVER (PARTITION BY user_id ORDER BY ar, ev) AS b FROM (SELECT *, max(raw) OVER (PARTITION BY user_id ORDER BY ar, ev ROWS UNBOUNDED PRECEDING) AS wm FROM
(SELECT *, max(ev) OVER (PARTITION BY user_id ORDER BY ar, ev ROWS UNBOUNDED PRECEDING) - {lag} AS raw FROM r) q) w) l)"""


@query("watermark_replay", "WITH r AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS ev, epoch_us(ts) / 1e6 + (event_id * 7919) % 7200 AS ar FROM events), " + _REPLAY.format(name="a", text="fixed_1h", lag="3600") + ", " + _REPLAY.format(name="b", text="p95", lag="quantile_cont(greatest(ar - ev, 0), 0.95) OVER (PARTITION BY user_id ORDER BY ar, ev ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)") + " SELECT * FROM a UNION ALL SELECT * FROM b")
def replay(spark, sf):
    e = _recorded(spark, sf)
    out = None
    for name, wm in (("fixed_1h", watermarks.fixed("event", "arrival", "user_id", 3600.0)), ("p95", watermarks.percentile("event", "arrival", "user_id", 0.95))):
        r = watermarks.replay(watermarks.monotone(e.withColumn("wm", wm), "wm", "arrival", "event", "user_id"), "event", "arrival", "wm", 600.0, "user_id")
        c = watermarks.completeness(r).select(F.lit(name).alias("strategy"), F.round("completeness", 6).alias("completeness"), "late")
        out = c if out is None else out.unionAll(c)
    return out


@query("exactly_once_checks", "SELECT 'duplicate' AS kind, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_id % 10 = 0 UNION ALL SELECT 'gap', CAST(count(*) AS BIGINT) AS n FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS b FROM events) t WHERE b IS NOT NULL AND event_id <> b + 1")
def exactly_once(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("user_id") % 3).alias("producer"))
    log = e.withColumn("id", F.col("event_id")).withColumn("position", F.col("event_id") * 2)
    again = log.filter("id % 10 = 0").withColumn("position", F.lit(1 << 40) + F.col("id")).withColumn("producer", F.col("id") + 1000)  # sent once more, by others
    return cdc.exactly_once_violations(log.unionAll(again), "id", "producer", "event_id", "position").groupBy("kind").agg(F.count("*").alias("n"))


@query("cdc_soft_delete", "SELECT user_id, max(event_id) AS lsn, arg_max(event_type, event_id) = 'error' AS deleted FROM events GROUP BY user_id")
def soft_delete(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.col("event_id").alias("lsn"), (F.col("event_type") == "error").alias("deleted"))
    return cdc.upsert_soft_delete(e.filter("lsn < 100"), e.filter("lsn >= 100"), ["user_id"])


@query("page_products")
def page_products(spark, sf):
    return products.extract_products(table(spark, sf, "pages"))
