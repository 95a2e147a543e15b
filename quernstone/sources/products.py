"""Product name, price and currency from web pages: JSON-LD, then microdata, then OpenGraph, then the title and the first price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CURRENCY = {"$": "USD", "€": "EUR", "£": "GBP", "₫": "VND"}


def _group(text: Column, pattern: str) -> Column:
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def _number(text: Column) -> Column:
    """1,234.50 and 1.234,50 alike."""
    t = F.regexp_replace(text, r"[^0-9.,]", "")
    plain = F.when(t.rlike(r",\d{1,2}$"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def extract_products(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """page_id, name, price, currency, method; pages without a product have a null method."""
    h = F.coalesce(F.col(html_col), F.lit(""))
    ld = _group(h, r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>')
    ld_name, ld_price, ld_cur = (F.get_json_object(ld, p) for p in ("$.name", "$.offers.price", "$.offers.priceCurrency"))
    micro = lambda p: F.coalesce(_group(h, rf'(?is)itemprop="{p}"[^>]*content="([^"]*)"'), _group(h, rf'(?is)itemprop="{p}"[^>]*>([^<]*)<'))
    og = lambda p: _group(h, rf'(?is)<meta[^>]*property="{p}"[^>]*content="([^"]*)"')
    title = F.trim(_group(h, r"(?is)<title[^>]*>(.*?)</title>"))
    body = F.regexp_replace(h, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    seen = _group(body, r"([$€£₫]\s?\d[\d.,]*)")
    sign = F.try_element_at(F.create_map(*[F.lit(x) for kv in CURRENCY.items() for x in kv]), F.substring(seen, 1, 1))
    rows = [("json-ld", ld_name, _number(ld_price), ld_cur), ("microdata", micro("name"), _number(micro("price")), micro("priceCurrency")), ("opengraph", og("og:title"), _number(og("product:price:amount")), og("product:price:currency")), ("heuristic", title, _number(seen), sign)]
    best = F.coalesce(*[F.when(n.isNotNull() & p.isNotNull(), F.struct(F.lit(m).alias("method"), n.alias("name"), p.alias("price"), c.alias("currency"))) for m, n, p, c in rows])
    return pages.select(F.col(id_col).alias("page_id"), best.alias("p")).select("page_id", "p.name", "p.price", "p.currency", "p.method")
