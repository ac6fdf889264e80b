"""Where queries and their SQL are registered, and SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession

from tonelake.functions.numbers import stable_round
from tonelake.rules import default_rulebook
from workload import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """The views and given tables of one folder: ``t.songs``, ``t.orders``."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return views.view(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None):
    """Register a function of :class:`Tables` and, where SQL can say it, the equivalent."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = partial(_run, fn)
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _run(fn, spark: SparkSession, sf_dir: str) -> DataFrame:
    return fn(Tables(spark, sf_dir))


def r(c: Column, digits: int = 4) -> Column:
    return stable_round(c, digits)


def q(x: str, digits: int = 4) -> str:
    """The same rounding in SQL."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def text(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def rule(table: str) -> str:
    """A rule table as a CTE."""
    rows, schema = default_rulebook().rows(table)
    names = ", ".join(c.strip().split(" ")[0] for c in schema.split(","))
    cell = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else (f"{v!r}::DOUBLE" if isinstance(v, float) else str(v))
    body = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    return f"{table}({names}) AS (VALUES {body})"
