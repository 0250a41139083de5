"""Registry of named queries (one per operator) and their DuckDB oracle SQL.

``__spark_entry__`` exposes :data:`QUERIES` and :data:`ORACLE`.  Every query
takes ``(spark, sf_dir)``, reads the driver tables under ``sf_dir`` and returns
a lazy DataFrame whose columns follow the shared output convention
(:func:`normalize`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .session import apply_runtime_conf

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def normalize(df: DataFrame) -> DataFrame:
    """Integers to BIGINT, floating values rounded to 1e-6 (and -0.0 to 0.0)."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            cols.append(c.cast("bigint").alias(f.name))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            cols.append((F.round(c.cast("double") * F.lit(1e6)) / F.lit(1e6) + F.lit(0.0)).alias(f.name))
        else:
            cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            apply_runtime_conf(spark)
            return normalize(fn(spark, sf_dir))

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the query modules (they register on import)."""
    from .plans import catalogue_queries, incident_queries, io_queries, portal_queries, profile_queries, web_queries  # noqa: F401
