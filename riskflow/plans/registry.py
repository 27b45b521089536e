"""Registry of named queries: each is a Spark job over the driver tables plus,
where SQL can express it, an independent DuckDB oracle text.

Outputs are normalised the same way on the Spark side for every query:
doubles (and arrays of doubles) rounded to 9 then 6 digits, small integers
widened to long.  The oracle SQL applies the same rounding explicitly.

Rounding is plain IEEE arithmetic, ``floor(x * 10^d + 0.5) / 10^d``, written
identically in both engines: Spark's ``round`` rounds the shortest decimal
text of a double while DuckDB rounds its binary value, so the two disagree on
values such as 64.0827035.  The first stage (9 digits) absorbs
summation-order noise, the second gives the compared value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


@dataclass
class Entry:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: tuple


REGISTRY: dict[str, Entry] = {}


def round_col(c, digits: int = DIGITS):
    """Two-stage IEEE half-up rounding; magnitudes beyond long range pass through."""
    a = F.abs(c)
    s1, s2 = 10.0 ** (digits + 3), 10.0 ** digits
    two = F.floor(F.floor(c * s1 + 0.5) / s1 * s2 + 0.5) / s2
    one = F.floor(c * s2 + 0.5) / s2
    return F.when(a < 1e9, two).when(a < 9e12, one).otherwise(c)


def normalise(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        dt = f.dataType
        if isinstance(dt, (T.DoubleType, T.FloatType)):
            c = round_col(c.cast("double"), digits)
        elif isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(dt, T.BooleanType):
            c = c.cast("long")
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.DoubleType, T.FloatType)):
            c = F.transform(c, lambda x: round_col(x.cast("double"), digits))
        elif isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.IntegerType, T.ShortType)):
            c = c.cast("array<bigint>")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def register(name: str, sql: str | None = None, ops: tuple = ()):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return normalise(fn(spark, sf_dir))
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, run, sql, ops)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    """Import every query module so their decorators run."""
    from riskflow.plans import (  # noqa: F401
        aggregate_queries,
        check_queries,
        rule_queries,
        stream_queries,
        vector_queries,
        feature_queries,
        library_queries,
        model_queries,
        case_queries,
    )
    return REGISTRY
