"""Query registry: one Spark callable per operator id and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import use_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(use_utc(spark), sf_dir))
        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable output: rounded doubles without negative zero, zone-free times, plain integers."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.DecimalType):
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def r(*names: str) -> str:
    """SQL for rounded doubles under their own names."""
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def rexp(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def big(expr: str, name: str | None = None) -> str:
    return f"CAST({expr} AS BIGINT) AS {name or expr}"


def select_round(rel: str, keys: Sequence[str], doubles: Sequence[str], bigs: Sequence[str] = (), where: str = "") -> str:
    cols = [*keys, *[big(b) for b in bigs]]
    if doubles:
        cols.append(r(*doubles))
    return f"SELECT {', '.join(cols)} FROM {rel} {where}"
