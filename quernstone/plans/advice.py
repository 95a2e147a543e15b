"""Advice from statistics: which views to materialise, how to partition, which merge strategy, which tier."""

from __future__ import annotations


def select_views(candidates: list[dict], budget: float) -> list[str]:
    """Names of views (name, cost, benefit) within a storage budget, by benefit per cost."""
    chosen, left = [], budget
    for c in sorted(candidates, key=lambda c: (-c["benefit"] / max(c["cost"], 1e-9), c["name"])):
        if c["benefit"] > 0 and c["cost"] <= left:
            chosen.append(c["name"])
            left -= c["cost"]
    return chosen


def partitioning(columns: dict[str, dict], rows: int, target_rows: int = 5_000_000) -> dict:
    """columns: name -> filters (queries that filter on it), joins, distinct, top_share.  A partition column is filtered, not skewed, and has few values; a bucket column is joined."""
    fit = [(s["filters"], n) for n, s in columns.items() if s["filters"] and s["distinct"] <= 10_000 and s.get("top_share", 0) < 0.5 and rows / max(s["distinct"], 1) >= target_rows / 100]
    join = [(s["joins"], n) for n, s in columns.items() if s.get("joins") and s["distinct"] > 100]
    out = {"partition_by": max(fit)[1] if fit else None, "bucket_by": max(join)[1] if join else None}
    out["buckets"] = max(1, 1 << max(0, (rows // target_rows).bit_length())) if out["bucket_by"] else None
    return out


def merge_strategy(reads: int, writes: int, changed_share: float) -> str:
    """copy_on_write for reads and wide changes, merge_on_read for many small changes."""
    return "merge_on_read" if writes > reads and changed_share < 0.1 else "copy_on_write"


def tier(days_since_access: float, accesses_per_day: float) -> str:
    return "hot" if days_since_access < 7 or accesses_per_day > 1 else "warm" if days_since_access < 60 else "cold"


def batch_plan(rows: int, row_bytes: int, executors: int, cores: int, target_mb: int = 128) -> int:
    """Shuffle partitions: about ``target_mb`` each, and a multiple of the cores."""
    need = max(1, -(-rows * row_bytes // (target_mb << 20)))
    slots = executors * cores
    return -(-need // slots) * slots
