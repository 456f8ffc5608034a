"""Inputs given alike to Spark (``frame``) and to the SQL side (``cte``): small typed ones, and those made from whole tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lakequill.plans.registry import tbl

_SQL = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_literal, v)) + "]"
    if isinstance(v, str):
        return "'" + v.replace("'", "''") + "'"
    return str(v)


def _type(t: str) -> str:
    return _type(t[6:-1]) + "[]" if t.startswith("array<") else _SQL[t]


class Fixture:
    """``Fixture("name", "a long, b array<string>", rows)``."""

    def __init__(self, name: str, schema: str, rows: list[tuple]) -> None:
        self.name, self.schema, self.rows = name, schema, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def cte(self) -> str:
        cols = [c.strip().split(" ", 1) for c in self.schema.split(",")]
        casts = ", ".join(f"CAST({n} AS {_type(t)}) AS {n}" for n, t in cols)
        rows = ",\n ".join("(" + ", ".join(map(_literal, r)) + ")" for r in self.rows)
        return f"{self.name} AS (SELECT {casts} FROM (VALUES {rows}) v({', '.join(n for n, _ in cols)}))"


class Derived:
    """A relation made from supplied tables by SQL that both engines read alike; ``{table}`` names a table, ``ARR(...)`` makes an array."""

    def __init__(self, name: str, sql: str) -> None:
        self.name, self.sql, self.tables = name, sql, sorted(set(re.findall(r"{(\w+)}", sql)))

    def frame(self, spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(self.sql.replace("ARR(", "array("), **{t: tbl(spark, d, t) for t in self.tables})

    @property
    def cte(self) -> str:
        return f"{self.name} AS ({self.sql.replace('ARR(', 'list_value(').format(**{t: t for t in self.tables})})"
