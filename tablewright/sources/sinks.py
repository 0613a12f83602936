"""Writers and the choice of the current table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.sources.delimited import read_csv


def write_clean(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a cleaned table; Parquet keeps the types, CSV gets a header."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_audit(audit: DataFrame, path: str, dataset_id: str) -> None:
    """Replace one dataset's audit rows; other datasets' rows stay."""
    (
        audit.withColumn("dataset_id", F.lit(dataset_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id")
        .parquet(path)
    )


def read_audit(spark: SparkSession, path: str, dataset_id: str) -> DataFrame:
    log = spark.read.parquet(path).where(F.col("dataset_id") == dataset_id)
    return log.drop("dataset_id").orderBy("step_number")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet and ORC by extension; everything else is read as CSV."""
    trimmed = path.rstrip("/").lower()
    for fmt in ("parquet", "orc"):
        if trimmed.endswith(f".{fmt}"):
            return spark.read.format(fmt).load(path)
    return read_csv(spark, path)


def current_table(spark: SparkSession, raw_path: str, cleaned_path: str | None = None) -> DataFrame:
    """The cleaned table if it has been written, else the raw one."""
    if cleaned_path:
        try:
            return read_table(spark, cleaned_path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return read_table(spark, raw_path)
