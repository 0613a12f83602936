"""Input tables and the dirty view, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DIRTY_COLUMNS = [
    "event_id", "ts", "user_id", "event_type", "amount", "sparse_value", "label_text",
    "flag_text", "int_text", "money_text", "date_text", "whole_float", "constant_text",
]

_DIRT = [
    "event_id",
    "ts",
    "user_id",
    "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type",
    """CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -value
       ELSE value END AS amount""",
    "CASE WHEN event_id % 3 <> 0 THEN NULL ELSE value END AS sparse_value",
    """CASE WHEN event_id % 5 = 0 THEN concat('  ', event_type, '  x ')
       ELSE event_type END AS label_text""",
    """CASE WHEN event_id % 2 = 0 THEN 'Yes' WHEN event_id % 3 = 0 THEN 'no'
       ELSE 'true' END AS flag_text""",
    "CAST(user_id AS STRING) AS int_text",
    "concat('$', CAST(CAST(floor(value * 100) AS BIGINT) AS STRING), '.50') AS money_text",
    "CASE WHEN event_id % 2 = 0 THEN '2024-01-15' ELSE '05/12/2023' END AS date_text",
    "CAST(user_id AS DOUBLE) AS whole_float",
    "'const' AS constant_text",
]

# Common table expression for the SQL side: planted dirt, some rows twice.
DIRTY = f"""WITH d0 AS (SELECT {", ".join(_DIRT)} FROM events),
d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE event_id % 50 = 0)
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """All events with planted dirt; the copies are made in the same scan."""
    copies = "explode(sequence(1, CASE WHEN event_id % 50 = 0 THEN 2 ELSE 1 END)) AS copy"
    return table(spark, sf, "events").selectExpr("*", copies).selectExpr(*_DIRT)
