from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quernstone.sources import products, readers
from quernstone.sources.rest import PagedSource, SegmentLog
from quernstone.sources.tables import table
from quernstone.streaming import windows


class Handler(BaseHTTPRequestHandler):
    asked: list[dict] = []

    def do_GET(self):
        q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        Handler.asked.append(q)
        rows = [{"id": int(q["page"]) * 10 + k, "kind": "a" if k % 2 else "b"} for k in range(int(q["size"]))]
        if "kind" in q:
            rows = [r for r in rows if r["kind"] == q["kind"]]
        body = json.dumps({"data": {"items": rows}}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_paged_source_pushes_filters(spark, server):
    spark.dataSource.register(PagedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("paged").option("url", server).option("pages", 3).option("page_size", 4).option("records", "data.items").option("params", "kind").schema("id int, kind string").load()
    assert df.count() == 12
    Handler.asked.clear()
    assert sorted(r.id for r in df.filter("kind = 'a' AND id > 10").collect()) == [11, 13, 21, 23]
    assert all(q.get("kind") == "a" for q in Handler.asked)


def test_segment_log(spark, tmp_path):
    log = SegmentLog(spark, str(tmp_path / "log"))
    assert log.append(spark.createDataFrame([(3, "x"), (1, "y")], "t int, v string"), "t") == 0
    assert log.append(spark.createDataFrame([(9, "z")], "t int, v string"), "t") == 2
    assert [r.v for r in log.read(1).orderBy("offset").collect()] == ["x", "z"]


def test_features_replace_only_their_days(spark, tmp_path):
    path = str(tmp_path / "f")
    readers.write_features(spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "e int, d string"), path, "g", "d")
    readers.write_features(spark.createDataFrame([(3, "2024-01-02")], "e int, d string"), path, "g", "d")
    got = readers.read_features(spark, path, "g", "2024-01-01", "2024-01-31", columns=["e"])
    assert sorted(r.e for r in got.collect()) == [1, 3]
    assert "PartitionFilters" in got._jdf.queryExecution().executedPlan().toString()


def test_tbl_and_incremental(spark, tmp_path):
    (tmp_path / "x.tbl").write_text("1|a|\n2|b|\n")
    df = readers.read_tbl(spark, str(tmp_path / "x.tbl"), "id int, v string")
    assert [tuple(r) for r in readers.incremental(df, "id", 1).collect()] == [(2, "b")] and readers.high_water(df, "id") == 2


def test_products(spark):
    pages = [
        (1, '<script type="application/ld+json">{"name": "Tea", "offers": {"price": "12.50", "priceCurrency": "EUR"}}</script>'),
        (2, '<span itemprop="name">Cup</span><meta itemprop="price" content="1.234,50"><meta itemprop="priceCurrency" content="EUR">'),
        (3, '<meta property="og:title" content="Pot"><meta property="product:price:amount" content="9">'),
        (4, "<title>Pan</title><p>only $1,200.00 now</p>"),
        (5, None),
    ]
    got = {r.page_id: (r.name, r.price, r.currency, r.method) for r in products.extract_products(spark.createDataFrame(pages, "page_id int, html string")).collect()}
    assert got == {1: ("Tea", 12.5, "EUR", "json-ld"), 2: ("Cup", 1234.5, "EUR", "microdata"), 3: ("Pot", 9.0, None, "opengraph"), 4: ("Pan", 1200.0, "USD", "heuristic"), 5: (None, None, None, None)}


def test_scan_prunes_and_pushes(spark, sf):
    plan = table(spark, sf, "lineitem").filter("l_quantity > 45").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in plan and "l_extendedprice" not in plan


def test_unknown_table(spark, sf):
    with pytest.raises(KeyError):
        table(spark, sf, "nothing")


def test_stream_equals_batch(spark, sf, tmp_path):
    aggs = [F.count("*").alias("n")]
    stream = windows.tumbling(windows.parquet_stream(spark, f"{sf}/events.parquet"), "ts", "1 day", ["event_type"], aggs)
    got = windows.finished(stream, str(tmp_path), "complete")
    want = windows.tumbling(table(spark, sf, "events"), "ts", "1 day", ["event_type"], aggs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_pushdown_report(spark, sf):
    from pyspark.sql import functions as F

    from quernstone.sources.readers import pushdown

    o = spark.read.parquet(f"{sf}/orders.parquet")
    got = pushdown(o.filter((F.col("o_orderkey") > 5) & (F.length("o_orderstatus") > F.col("o_custkey"))).select("o_orderkey"))
    assert any("GreaterThan(o_orderkey,5)" in x for x in got["pushed"]) and not any("length" in x for x in got["pushed"])
    assert len(got["residual"]) == 1 and "length" in got["residual"][0]


def test_token_bucket():
    from quernstone.streaming.watermarks import TokenBucket

    b = TokenBucket(rate=10, burst=20)
    assert [b.take(15, 0.0), b.take(15, 0.0), b.take(100, 1.0), b.take(100, 100.0), b.take(1, 50.0)] == [15, 5, 10, 20, 0]
