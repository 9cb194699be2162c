"""Every registered query outside the llm subpackage, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES: list[str] = ["tabular", "texts", "search", "learning", "places", "tools"]


def _all(kind: str) -> dict:
    out: dict = {}
    for name in MODULES:
        new = getattr(importlib.import_module(f"loomspark.plans.{name}"), kind)
        if clash := out.keys() & new.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= new
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLE_SQL")
