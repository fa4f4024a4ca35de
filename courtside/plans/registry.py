"""Query registry and the shared pieces of oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None, using: tuple[str, ...] = ()):
    """Register `fn(fx) -> DataFrame` under `name`; `using` lists the CTEs its oracle needs."""

    def add(fn):
        from courtside.plans.fixtures import Fixtures

        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_ctes(sql, using)
        return fn

    return add


def cte(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = (needs, body)


def with_ctes(body: str, names: tuple[str, ...]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in CTES[n][0]:
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    recursive = "RECURSIVE " if "WITH RECURSIVE" in body else ""
    body = body.replace("WITH RECURSIVE", ",", 1) if recursive and order else body
    head = ", ".join(f"{n} AS ({CTES[n][1]})" for n in order)
    if not order:
        return body
    if body.lstrip().startswith(","):
        return f"WITH {recursive}{head} {body}"
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {head}, {body.lstrip()[5:]}"
    return f"WITH {head} {body}"
