"""Register a query next to the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import session
from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` may use the derived views by name."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(views.Tables(session.configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def with_views(body: str) -> str:
    """Put the derived views that ``body`` names in front of it as CTEs."""
    body = body.strip()
    ctes = [f"{name} AS (\n{views.VIEWS[name]})" for name in _needed(body)]
    if not ctes:
        return body
    own = re.match(r"with\s+(recursive\s+)?", body, re.I)
    tail = ",\n" + body[own.end():] if own else "\n" + body
    return "WITH RECURSIVE " + ",\n".join(ctes) + tail


def _needed(text: str) -> list[str]:
    found: list[str] = []

    def visit(part: str) -> None:
        for name, sql in views.VIEWS.items():
            if name not in found and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", part, re.I):
                visit(sql)
                if name not in found:
                    found.append(name)

    visit(text)
    return found
