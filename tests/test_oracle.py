from __future__ import annotations

import pytest
from oracle import connection, same

from quernstone.plans import registry

PAIRS, ALL = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(PAIRS))
def test_agrees_with_sql(spark, sf, con, name):
    same(ALL[name](spark, sf), con, PAIRS[name])


def test_queries_without_sql_are_few():
    assert set(ALL) - set(PAIRS) == {"cep_batch", "cep_stream", "page_products"}


def test_cep_by_a_plain_walk(spark, sf):
    """view, then click and purchase within ten hours each, within a day, per user: one open match at a time."""
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("user_id", "ts", "event_id").collect()
    want, user, seen = [], None, []
    for r in rows:
        if r.user_id != user:
            user, seen = r.user_id, []
        t = r.ts.timestamp()
        if seen and (t - seen[0] > 86400 or t - seen[-1] > 36000):
            seen = []  # run out; this event is spent
            continue
        if r.event_type == ("view", "click", "purchase")[len(seen)]:
            seen.append(t)
            if len(seen) == 3:
                want.append((user, seen[0], seen[2]))
                seen = []
    # The session's zone is UTC, the driver's may not be: compare the lengths of time, and counts by user.
    shape = lambda found: sorted((u, e - s) for u, s, e in found)
    for name in ("cep_batch", "cep_stream"):
        got = shape((r.entity, r.start, r.end) for r in ALL[name](spark, sf).collect())
        assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 0.01 for a, b in zip(got, shape(want))), name


def test_page_products_by_plain_search(spark, sf):
    import re

    got = {r.page_id: r for r in ALL["page_products"](spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert set(got) == {p.page_id for p in pages}
    for p in pages:
        if not re.search(r"ld\+json|itemprop|og:title", p.html or "", re.I):
            body = re.sub(r"(?is)<(script|style)[^>]*>.*?</\1>", " ", p.html or "")
            price, title = re.search(r"[$€£₫]\s?\d[\d.,]*", body), re.search(r"(?is)<title[^>]*>(.*?)</title>", p.html or "")
            assert (got[p.page_id].name is not None) == bool(price and title and title.group(1).strip())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries())
