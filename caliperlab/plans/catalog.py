"""Names every query of the library and its checking SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["cohorts", "texts", "changes", "lineage", "labelling", "evaluation", "shaping", "files", "provenance", "reconcile"]


def _modules():
    return [importlib.import_module(f"caliperlab.plans.{m}") for m in MODULES]


def queries() -> dict[str, Query]:
    return {f.__name__: f for m in _modules() for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}
