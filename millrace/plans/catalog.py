"""The registered queries over the test tables and the SQL each is compared with."""

from __future__ import annotations

import importlib

from millrace.plans.registry import QUERIES, SQL, Query

MODULES = ("text_queries", "dedup_queries", "mixture_queries", "sequence_queries", "metric_queries", "source_queries")


def queries() -> dict[str, Query]:
    for m in MODULES:
        importlib.import_module(f"millrace.plans.{m}")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
