"""Registered queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FOUND: dict[str, tuple[Callable, str | None]] = {}
_MODULES = ("cleaning", "preference", "chat", "selection", "streams", "evaluation", "numeric", "files", "reports")


def query(name: str, sql: str | None = None):
    def add(f: Callable) -> Callable:
        _FOUND[name] = f, sql
        return f

    return add


def _load() -> dict[str, tuple[Callable, str | None]]:
    for m in _MODULES:
        importlib.import_module(f"lmdata.plans.{m}")
    return _FOUND


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: f for n, (f, _) in _load().items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _load().items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["h2_select_rs_both"](spark, sf_dir)
