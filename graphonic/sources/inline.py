"""Small tables of the library, usable as DataFrames and as SQL VALUES."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_sql, value)) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return str(value)


@dataclass(frozen=True)
class Inline:
    """A fixed table: its schema as DDL and its rows."""

    name: str
    schema: str
    rows: tuple[tuple, ...]

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def sql(self) -> str:
        """``name(columns) AS (VALUES ...)`` for a WITH clause."""
        columns = ", ".join(part.split()[0] for part in self.schema.split(", "))
        return f"{self.name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in self.rows) + ")"


def with_tables(*tables: Inline) -> str:
    """The WITH clause that defines tables."""
    return "WITH RECURSIVE " + ", ".join(t.sql() for t in tables)
