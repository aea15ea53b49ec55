"""Registered queries and, where SQL can say the same, their counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketry.plans.derive import Inputs, with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, inputs: tuple[str, ...] = ()):
    """Register ``build(spark, tables)``; ``inputs`` names the derived tables the SQL selects from."""
    def register(build: Callable[[SparkSession, Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(spark, Inputs(spark, folder))
        if sql is not None:
            body = sql.strip()
            if inputs:
                head = "WITH " + with_inputs(*inputs)
                body = head + (",\n" + body[5:] if body.startswith("WITH ") else "\n" + body)
            ORACLES[name] = body
        return build
    return register


def sql_list(items) -> str:
    return "[" + ", ".join("'" + item.replace("'", "''") + "'" for item in items) + "]"


def sql_case(key: str, table: dict, other: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"CASE {key} {whens} ELSE {other} END"
