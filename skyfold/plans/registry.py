"""Named queries, each with the SQL that states the same result for the check."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from skyfold.plans import derive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Keeps values such as k/128 off the rounding border, where the last bit would decide.
OFF_HALF = 1.234e-9


def query(name: str, sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register ``fn(tables) -> DataFrame``; ``doubles`` names the columns rounded for comparison."""
    cols = doubles.split()

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(derive.Tables(spark, sf_dir))
            return df.select(
                *[(F.round(F.col(c).cast("double") + F.lit(OFF_HALF), digits) + F.lit(0.0)).alias(c) if c in cols else F.col(c) for c in df.columns]
            )

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql:
            SQL[name] = full_sql(sql, cols, digits)
        return fn

    return register


def full_sql(sql: str, cols: list[str], digits: int = 6) -> str:
    """The query with the derived tables it names put in front as common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for t in derive.SQL_TABLES:
            if t not in needed and re.search(rf"\b{t}\b", text):
                need(derive.SQL_TABLES[t])
                needed.append(t)

    need(sql)
    body = sql.strip().rstrip(";")
    if cols:
        rounded = ", ".join(f"round(CAST({c} AS DOUBLE) + {OFF_HALF!r}, {digits}) + 0.0e0 AS {c}" for c in cols)
        body = f"SELECT * REPLACE ({rounded}) FROM (\n{body}\n) AS _result"
    elif needed:
        body = f"SELECT * FROM (\n{body}\n) AS _result"
    ctes = ",\n".join(f"{t} AS ({derive.SQL_TABLES[t].strip()})" for t in needed)
    return f"WITH {ctes}\n{body}" if ctes else body
