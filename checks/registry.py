"""Collects queries and the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.inputs import SQL_VIEWS, Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_views(body: str) -> str:
    """Put the derived inputs that ``body`` names in front of it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, view in SQL_VIEWS.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                visit(view)
                needed.append(name)

    visit(body)
    ctes = ",\n".join(f"{n} AS ({SQL_VIEWS[n].strip()})" for n in needed)
    body = body.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {ctes},\n{body[len('WITH'):].strip()}"
    return f"WITH {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Inputs` under ``name``."""

    def add(fn: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add
