"""Registration of queries beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions.columns import ref

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def expand(sql: str) -> str:
    """Replace ``pyround(x, d)`` by SQL for the correctly rounded decimal.

    Profile values are rounded as Python's ``round`` does it, which differs
    from SQL's half-up on ties.
    """
    name = "pyround("
    while (start := sql.rfind(name)) >= 0:
        depth, end, comma = 1, start + len(name), None
        while depth:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            comma = end if ch == "," and depth == 1 else comma
            end += 1
        value, digits = sql[start + len(name) : comma], sql[comma + 1 : end - 1].strip()
        text = f"CAST(format('{{:.{digits}f}}', CAST({value} AS DOUBLE)) AS DOUBLE)"
        sql = sql[:start] + text + sql[end:]
    return sql


def query(sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = expand(sql)
        return fn

    return register


def shaped(df: DataFrame, digits: int = 4) -> DataFrame:
    """Integers as BIGINT, doubles rounded: what the SQL side returns."""

    def shape(f: T.StructField):
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            return ref(f.name).cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            return F.round(ref(f.name), digits).alias(f.name)
        return ref(f.name)

    return df.select(*[shape(f) for f in df.schema.fields])
