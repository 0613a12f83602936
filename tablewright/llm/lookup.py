"""Joins with a table of unique keys in which some keys hold a large part of all rows.

Keys of more than one row in ``HOT`` are found by a count; there are fewer than ``HOT`` of them,
which bounds what is broadcast. Their rows are dealt to ``SALTS`` parts, and their entries in the
table are repeated once for each part. Null keys match nothing and are dealt the same way.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1024
SALTS = 64


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], row_number: str) -> DataFrame:
    """``rows`` with the columns of ``table``, null where it has no such key (a left join).

    ``rows`` is read twice, so it should be a written table; ``row_number`` is a column that tells
    its rows apart and stays the same when a task is run again. ``table`` has each key once.
    """
    total = rows.agg(F.count("*").alias("n"))
    often = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") * HOT > total.first().n)
    hot = F.broadcast(often.select(*keys, F.lit(True).alias("__hot")))
    missing = reduce(or_, [F.col(k).isNull() for k in keys])
    salt = F.pmod(F.xxhash64(row_number), F.lit(SALTS)).cast("int")
    everywhere = F.sequence(F.lit(0), F.lit(SALTS - 1))
    left = rows.join(hot, keys, "left").withColumn("__salt", F.when(F.col("__hot") | missing, salt).otherwise(0))
    right = table.join(hot, keys, "left").withColumn("__salt", F.explode(F.when(F.col("__hot"), everywhere).otherwise(F.array(F.lit(0)))))
    return left.drop("__hot").join(right.drop("__hot"), [*keys, "__salt"], "left").drop("__salt")
