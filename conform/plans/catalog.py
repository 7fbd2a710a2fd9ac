"""Registry of the runnable queries and of the SQL each one is checked against."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from conform.plans.bindings import Tables
from conform.plans.oracle import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

AREAS = ("projections", "filters", "joins", "scoring", "aggregates", "layout", "onboarding",
         "grids", "functions", "checks", "assist", "sinks")


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def with_views(sql: str) -> str:
    """Prefix the statement with the shared views it uses (and those they use)."""
    sql = sql.strip()
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                wanted.append(name)

    visit(sql)
    if not wanted:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in wanted)
    if re.match(r"WITH\s+RECURSIVE\b", sql, re.I):
        return f"WITH RECURSIVE {head}, " + re.sub(r"^WITH\s+RECURSIVE\s+", "", sql, flags=re.I)
    if re.match(r"WITH\b", sql, re.I):
        return f"WITH {head}, " + re.sub(r"^WITH\s+", "", sql, flags=re.I)
    return f"WITH {head} {sql}"


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"conform.plans.{area}")
