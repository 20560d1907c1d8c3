"""Registry of runnable queries and of the SQL that must give the same rows."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .testbed_sql import BASE_CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NUDGE = 1e-9


def query(name: str, sql: str | None = None):
    """Register a query. ``sql`` is a SELECT, or CTEs followed by a SELECT, that
    may use the base CTEs describing the bound tables."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark, sf_dir):
            return tidy(fn(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_base(sql)
        return fn
    return register


def with_base(sql: str) -> str:
    body = sql.strip()
    joiner = "\n" if body[:6].upper() == "SELECT" else ",\n"
    return f"WITH {BASE_CTES}{joiner}{body}"


def tidy(df: DataFrame) -> DataFrame:
    """Presentation form: doubles to six places, whole numbers as long, dates as text.

    The nudge sends values lying exactly between two results the same way in every
    engine, whatever its rounding of halves.
    """
    cols = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double") + F.lit(NUDGE), 6) + F.lit(0.0)
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(kind, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(field.name))
    return df.select(*cols)


def r6(expr: str, alias: str | None = None) -> str:
    """SQL text of a double rounded as ``tidy`` rounds it."""
    out = f"(round(CAST({expr} AS DOUBLE) + 1e-9::DOUBLE, 6) + 0.0)"
    return f"{out} AS {alias}" if alias else out
