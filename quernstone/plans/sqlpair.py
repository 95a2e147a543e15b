"""Queries stated as SQL: one text for Spark, and one for the oracle where the dialects differ."""

from __future__ import annotations

import re

from quernstone.plans.registry import query
from quernstone.sources.tables import TABLES, register

_NAMES = re.compile(r"\b(" + "|".join(TABLES) + r")\b")
_ASOF = re.compile(r"\bASOF\s+(LEFT\s+)?JOIN\b", re.I)


def guarded(sql: str) -> str:
    """Spark reads ASOF JOIN as a table alias and an inner join: refuse it."""
    if _ASOF.search(sql):
        raise ValueError("ASOF JOIN is not Spark SQL; use quernstone.operators.joins.asof_join")
    return sql


def sql_query(name: str, sql: str, duck: str | None = None) -> None:
    """Register a query given as SQL over the standard tables; only the tables it names become views."""

    def run(spark, sf_dir, sql=guarded(sql)):
        register(spark, sf_dir, *sorted(set(_NAMES.findall(sql))))
        return spark.sql(sql)

    run.__name__ = name
    query(name, duck or sql)(run)
