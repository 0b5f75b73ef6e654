"""Queries over the driver's tables, one for each operator, with their SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Run = Callable[[SparkSession, str], DataFrame]


def six_decimals(x: Column) -> Column:
    """``x`` to six decimals as SQL's engine rounds: the millionfold, itself a double, is rounded. Spark's own rounding goes by the decimal form, which may stand just below a half that the millionfold meets."""
    return F.when(F.abs(x) < 1e300, F.round(x * 1e6) / 1e6).otherwise(x)


@dataclass
class Query:
    """A query, its columns ("a bigint, b string"), and DuckDB's form; both sides give these types, doubles to six decimals."""

    run: Run
    columns: str
    sql: str | None

    def fields(self) -> list[list[str]]:
        return [c.split() for c in self.columns.split(", ")]

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(spark, sf_dir)
        return df.select(*((six_decimals(F.col(c).cast(t)) if t == "double" else F.col(c).cast(t)).alias(c) for c, t in self.fields()))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        shown = ", ".join(f"round({c}::DOUBLE, 6) AS {c}" if t == "double" else f"{c}::{t} AS {c}" for c, t in self.fields())
        return f"SELECT {shown} FROM ({self.sql})"


class Catalogue(dict[str, Query]):
    def add(self, name: str, columns: str, sql: str | None = None) -> Callable[[Run], Run]:
        def keep(run: Run) -> Run:
            self[name] = Query(run, columns, sql)
            return run

        return keep
