"""Query registry: name -> (Spark callable, SQL text or None)."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from doorlens.plans.fixtures import Tables, check_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of ``Tables``; ``sql`` is the same query for the check engine."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            CHECKS[name] = check_sql(sql)
        return fn

    return add


# SQL spellings shared by several checks.


def digest(seed, *cols: str) -> str:
    parts = [seed if str(seed).startswith("$") else f"'{seed}'", *[f"CAST({x} AS VARCHAR)" for x in cols]]
    return f"md5(concat_ws('|', {', '.join(p.lstrip('$') for p in parts)}))"


def u01(d: str) -> str:
    return f"(CAST(('0x' || substr({d}, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


def fields(line: str) -> str:
    return rf"string_split(trim(regexp_replace({line}, '\s+', ' ', 'g')), ' ')"


IS_INT = "regexp_full_match({0}, '[+-]?[0-9]+')"
