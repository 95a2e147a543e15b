"""Scalar functions as Column builders; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_divide(a: Column, b: Column, default: float | None = None) -> Column:
    out = F.try_divide(a, b)
    return out if default is None else F.coalesce(out, F.lit(default))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere of radius 6371."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.sin((b - a) / 2) ** 2 + F.cos(a) * F.cos(b) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 6371.0 * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def z_key(columns: list[Column], bits: int = 16) -> Column:
    """Bits of non-negative integers interleaved, most significant first dimension lowest."""
    out = F.lit(0).cast("long")
    for b in range(bits):
        for d, c in enumerate(columns):
            if b * len(columns) + d < 63:
                out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1)), b * len(columns) + d))
    return out


def hilbert_key(x: Column, y: Column, bits: int = 8) -> Column:
    """Place of (x, y) on the Hilbert curve of order ``bits``: a fold over the bits, rotating the quadrant."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(s: Column, b: Column) -> Column:
        side = F.call_function("shiftleft", F.lit(1).cast("long"), b)
        rx = (s["x"].bitwiseAND(side) > 0).cast("long")
        ry = (s["y"].bitwiseAND(side) > 0).cast("long")
        d = s["d"] + side * side * ((3 * rx).bitwiseXOR(ry))
        flip = (ry == 0) & (rx == 1)
        all_ = F.lit((1 << bits) - 1).cast("long")
        px, py = F.when(flip, all_ - s["x"]).otherwise(s["x"]), F.when(flip, all_ - s["y"]).otherwise(s["y"])
        return F.struct(F.when(ry == 0, py).otherwise(px).alias("x"), F.when(ry == 0, px).otherwise(py).alias("y"), d.alias("d"))

    return F.aggregate(F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)]), start, step)["d"]


def hilbert_key_nd(columns: list[Column], bits: int = 8) -> Column:
    """Place of a point on the Hilbert curve in any number of dimensions (at most 62 bits in all), by Skilling's transform.

    One fold undoes the rotations from the highest bit down, one axis after the other;
    a Gray code of the axes and a last parity follow, and the bits are interleaved.
    """
    n = len(columns)
    lit = lambda v: F.lit(v).cast("long")
    steps = F.array(*[F.struct(lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turn(x: Column, s: Column) -> Column:
        first, own, low = F.get(x, F.lit(0)), F.get(x, s["i"]), s["q"] - 1
        hit = own.bitwiseAND(s["q"]) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        return F.transform(x, lambda v, k: F.when(k == 0, F.when(hit, v.bitwiseXOR(low)).otherwise(v.bitwiseXOR(swap))).when(k == s["i"], F.when(hit, v).otherwise(v.bitwiseXOR(swap))).otherwise(v))

    x = F.array(*[c.cast("long") for c in columns])
    x = F.aggregate(steps, x, turn) if bits > 1 else x
    gray = F.aggregate(x, F.struct(F.array().cast("array<bigint>").alias("a"), lit(0).alias("b")), lambda s, v: F.struct(F.concat(s["a"], F.array(v.bitwiseXOR(s["b"]))).alias("a"), v.bitwiseXOR(s["b"]).alias("b")))["a"]
    marks = F.array(*[lit(1 << b) for b in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")

    def interleaved(g: Column) -> Column:
        parity = F.aggregate(marks, lit(0), lambda t, q: F.when(F.get(g, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        axes = F.transform(g, lambda v: v.bitwiseXOR(parity))
        order = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
        bit = lambda s: F.call_function("shiftright", F.get(axes, s["i"]), s["b"]).bitwiseAND(lit(1))
        return F.aggregate(order, lit(0), lambda d, s: d * 2 + bit(s))

    return F.aggregate(F.array(gray), lit(0), lambda _, g: interleaved(g))


def amount_bucket(c: Column) -> Column:
    return F.when(c < 10, "micro").when(c < 100, "small").when(c < 1000, "medium").when(c < 10000, "large").otherwise("whale")


def business_days(a: Column, b: Column) -> Column:
    """About five sevenths of the days between."""
    return F.round(F.datediff(b, a) * 5 / 7).cast("int")


def time_features(ts: Column) -> dict[str, Column]:
    return {"hour": F.hour(ts), "weekday": F.weekday(ts), "is_weekend": F.weekday(ts) >= 5}


def term_days(text: Column) -> Column:
    """Days of a savings term such as "12 months", "12 tháng", "2 weeks", "1 năm" or "30 days"."""
    n = F.try_to_number(F.regexp_extract(text, r"(\d+)", 1), F.lit("9999")).cast("int")
    t = F.lower(text)
    return F.when(t.rlike("month|tháng|thang"), n * 30).when(t.rlike("year|năm|nam"), n * 365).when(t.rlike("week|tuần|tuan"), n * 7).when(t.rlike("day|ngày|ngay"), n)


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z]{2,}"
PHONE = r"\+?\d[\d\-. ()]{7,}\d"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"


def pii_counts(text: Column) -> dict[str, Column]:
    return {n: F.regexp_count(F.coalesce(text, F.lit("")), F.lit(p)) for n, p in (("emails", EMAIL), ("phones", PHONE), ("ips", IP))}


def mask_pii(text: Column) -> Column:
    for pattern, name in ((EMAIL, "<email>"), (IP, "<ip>"), (PHONE, "<phone>")):
        text = F.regexp_replace(text, pattern, name)
    return text


def hash_pii(c: Column, salt: str = "") -> Column:
    return F.sha2(F.concat(F.lit(salt), c.cast("string")), 256)


def reshape(df: DataFrame, steps: list[dict]) -> DataFrame:
    """A record migration: rename, remove, add, default, cast, map_value, split, merge, copy, compute, flatten or wrap."""
    for s in steps:
        op, f = s["op"], s.get("field")
        if op == "rename":
            df = df.withColumnRenamed(f, s["to"])
        elif op == "remove":
            df = df.drop(f)
        elif op == "add":
            df = df.withColumn(f, F.lit(s.get("value")))
        elif op == "default":
            df = df.withColumn(f, F.coalesce(F.col(f), F.lit(s["value"])))
        elif op == "cast":
            df = df.withColumn(f, F.expr(f"try_cast(`{f}` AS {s['type']})"))
        elif op == "map_value":
            m = F.create_map(*[F.lit(x) for kv in s["values"].items() for x in kv])
            df = df.withColumn(f, F.coalesce(F.try_element_at(m, F.col(f)), F.col(f)))
        elif op == "split":
            parts = F.split(F.col(f), s["by"], len(s["to"]))
            df = df.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(s["to"])})
        elif op == "merge":
            df = df.withColumn(s["to"], F.concat_ws(s.get("by", " "), *s["fields"]))
        elif op == "copy":
            df = df.withColumn(s["to"], F.col(f))
        elif op == "compute":
            df = df.withColumn(f, F.expr(s["expr"]))
        elif op == "flatten":
            df = df.select("*", *[F.col(f"{f}.{n}").alias(f"{f}_{n}") for n in df.schema[f].dataType.names]).drop(f)
        elif op == "wrap":
            df = df.withColumn(s["to"], F.struct(*s["fields"])).drop(*s["fields"])
        else:
            raise ValueError(f"no migration step {op}")
    return df
