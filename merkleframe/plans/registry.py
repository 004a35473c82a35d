"""Query name -> function(spark, sf_dir), and query name -> oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Each module has QUERIES and ORACLE.
MODULES: tuple[str, ...] = ("closures", "storage", "bench", "metadata", "trees")


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for key, value in getattr(importlib.import_module(f"merkleframe.plans.{name}"), what).items():
            if key in out:
                raise ValueError(f"two queries are named {key}")
            out[key] = value
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLE")
