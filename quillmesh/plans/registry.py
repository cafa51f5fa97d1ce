"""All registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code, integrity, packages, provenance, retrieval, telemetry, wiki

FLAGSHIP = "search_topk"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for _module in (retrieval, integrity, wiki, provenance, telemetry, code, packages):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
