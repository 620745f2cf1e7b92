"""Register of queries and of the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from fleetlens.plans.standins import VIEWS, Tables

QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
CHECKS: dict[str, str] = {}
RELATIONS: dict[str, str] = dict(VIEWS)  # named steps a check may build on


def relation(name: str, sql: str) -> None:
    RELATIONS[name] = sql


def check_sql(body: str) -> str:
    """Prefix ``body`` with the WITH clause of all relations it reads, in order of use."""
    order: list[str] = []
    seen: set[str] = set()  # a recursive relation names itself

    def visit(text: str) -> None:
        for name in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", text):
            if name in RELATIONS and name not in seen:
                seen.add(name)
                visit(RELATIONS[name])
                order.append(name)

    visit(body)
    if not order:
        return body
    steps = ",\n".join(f"{n} AS ({RELATIONS[n].strip()})" for n in order)
    own_name = any(re.search(rf"\b{n}\b", RELATIONS[n]) for n in order)
    word = "WITH RECURSIVE" if own_name or "RECURSIVE" in body[:20] else "WITH"
    body = body.replace("WITH RECURSIVE", "WITH", 1)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"{word} {steps},\n{body[5:]}"
    return f"{word} {steps}\n{body}"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return register


MODULES = ["sources", "sinks", "scalars", "joins", "aggregations", "rankings", "algorithms", "pixels", "tables", "documents"]


def load() -> None:
    for module in MODULES:
        import_module(f"fleetlens.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bound(fn):
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bound(fn) for name, fn in QUERIES.items()}


def checks() -> dict[str, str]:
    load()
    return {name: check_sql(sql) for name, sql in CHECKS.items()}
