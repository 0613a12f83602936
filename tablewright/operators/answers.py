"""Analytic answers: group, rank, aggregate, summarise one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import (
    analytic_class,
    clean_value,
    columns_of,
    number,
    ref,
    small_frame,
)
from tablewright.operators import correlation, frequencies, quantiles

AGGREGATIONS = ("sum", "mean", "count", "max", "min", "median")


def _aggregate(agg: str, v: Column) -> Column:
    return {
        # A group whose values are all missing still totals 0.
        "sum": lambda: F.coalesce(F.sum(v), F.lit(0.0)),
        "mean": lambda: F.avg(v),
        "count": lambda: F.count(v),
        "max": lambda: F.max(v),
        "min": lambda: F.min(v),
    }[agg]()


def grouped(df: DataFrame, by: str, value: str, agg: str = "sum") -> DataFrame:
    """(by, value): one row per non-null key; undefined aggregates are left out."""
    if agg not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {agg!r}")
    if agg == "median":
        return quantiles.group_medians(df, by, value)
    return (
        df.select(clean_value(df, by).alias(by), number(df, value).alias("__v"))
        .where(ref(by).isNotNull())
        .groupBy(ref(by))
        .agg(_aggregate(agg, F.col("__v")).alias("value"))
        .where(F.col("value").isNotNull())
    )


def group(
    df: DataFrame,
    by: str,
    value: str,
    agg: str = "sum",
    top: int | None = None,
    bottom: int | None = None,
) -> DataFrame:
    """Groups ranked by the aggregate; ``bottom`` wins when both limits are given."""
    out = grouped(df, by, value, agg)
    if bottom:
        return out.orderBy(F.asc("value"), ref(by)).limit(bottom)
    out = out.orderBy(F.desc("value"), ref(by))
    return out.limit(top) if top else out


def leader_share(df: DataFrame, by: str, value: str) -> DataFrame:
    """The leading group and its share of the grand total.

    The total also covers rows whose key is missing. No row comes back unless
    there are two groups and the leader and the total are positive.
    """
    sums = (
        df.select(clean_value(df, by).alias("k"), number(df, value).alias("v"))
        .groupBy("k")
        .agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("value"))
    )
    # The key filter comes after the limit: below it, the grouped rows could
    # not be shared with the total.
    leader = sums.orderBy(F.col("k").isNull(), F.desc("value"), F.asc("k")).limit(1)
    facts = sums.agg(
        F.struct(F.sum("value").alias("total"), F.count("k").alias("groups"))
    ).scalar()
    return (
        leader.withColumn("__whole", facts)
        .where("k is not null and __whole.groups > 1 and value > 0 and __whole.total > 0")
        .select(
            F.col("k").alias(by),
            F.col("value"),
            F.col("__whole.total").alias("total"),
            (F.col("value") / F.col("__whole.total") * 100).alias("share_percent"),
        )
    )


def value_counts(
    df: DataFrame, column: str, top: int | None = None, tail: int | None = None
) -> DataFrame:
    """(value, n, share_percent of all rows); ``top`` wins over ``tail``.

    ``tail`` keeps the last entries of the descending ranking, shown in that order.
    """
    counted = _with_share(df, column)
    ranked = [F.desc("n"), F.asc("value")]
    if top:
        return counted.orderBy(*ranked).limit(top)
    if tail:
        last = counted.orderBy(F.asc("n"), F.desc("value")).limit(tail)
        return last.orderBy(*ranked)
    return counted.orderBy(*ranked)


def _with_share(df: DataFrame, column: str) -> DataFrame:
    # Counting rows needs no column; Parquet answers it from its footers.
    total = df.agg(F.count("*")).scalar()
    counted = frequencies.value_counts(df, column)
    return counted.select("value", "n", (F.col("n") / total * 100).alias("share_percent"))


def distinct_values(df: DataFrame, column: str, show: int = 50) -> DataFrame:
    """(value, unique_count): the first ``show`` distinct values and how many exist."""
    values = (
        df.select(clean_value(df, column).alias("value")).where(F.col("value").isNotNull()).distinct()
    )
    count = values.agg(F.count("*")).scalar()
    return values.orderBy("value").limit(show).select("value", count.alias("unique_count"))


def extreme(
    df: DataFrame, column: str, highest: bool = True, order_by: list[str] | None = None
) -> DataFrame:
    """The extreme value with mean, median and three context columns of its first row."""
    v = number(df, column)
    context = [c for c in df.columns if c != column][:3]
    tie = [ref(c) for c in (order_by or context)]
    pick = df.where(v.isNotNull()).select(
        v.alias("__v"), *[ref(c).cast("string").alias(f"context_{i}") for i, c in enumerate(context)],
        *[t.alias(f"__t{i}") for i, t in enumerate(tie)],
    )
    first = pick.orderBy(
        F.desc("__v") if highest else F.asc("__v"), *[F.asc(f"__t{i}") for i in range(len(tie))]
    ).limit(1)
    median = quantiles.quantiles(df, [column], [0.5])[column][0]
    mean = df.agg(F.avg(v)).scalar()
    return first.select(
        F.lit(column).alias("column"),
        F.lit("max" if highest else "min").alias("metric"),
        F.col("__v").alias("value"),
        mean.alias("mean_comparison"),
        F.lit(median).cast("double").alias("median_comparison"),
        *[F.col(f"context_{i}") for i in range(len(context))],
    )


def column_total(df: DataFrame, column: str) -> DataFrame:
    v = number(df, column)
    return df.agg(
        F.lit(column).alias("column"),
        F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"),
        F.count(v).alias("count"),
    )


def column_average(df: DataFrame, column: str) -> DataFrame:
    v = number(df, column)
    median = quantiles.quantiles(df, [column], [0.5])[column][0]
    return df.agg(
        F.lit(column).alias("column"),
        F.avg(v).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.stddev_samp(v).alias("std"),
    )


def column_median(df: DataFrame, column: str) -> DataFrame:
    median = quantiles.quantiles(df, [column], [0.5])[column][0]
    return small_frame(df.sparkSession, [(column, median)], "column string, median double")


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    v = number(df, column)
    median = quantiles.quantiles(df, [column], [0.5])[column][0]
    return df.agg(
        F.lit(column).alias("column"),
        F.avg(v).alias("mean"),
        F.lit(median).cast("double").alias("median"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_if(v.isNull()).alias("null_count"),
    )


def text_summary(df: DataFrame, column: str, top: int = 5) -> DataFrame:
    """Top values with counts and shares, beside distinct and null counts."""
    counted = (
        df.select(clean_value(df, column).alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    )
    facts = counted.agg(
        F.struct(
            F.count("value").alias("unique_values"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.sum("n").alias("rows"),
        )
    ).scalar()
    return (
        # The null group sorts last and goes after the limit, so that the
        # grouped rows are shared with the facts.
        counted.orderBy(F.col("value").isNull(), F.desc("n"), F.asc("value"))
        .limit(top)
        .where(F.col("value").isNotNull())
        .withColumn("__f", facts)
        .select(
            F.lit(column).alias("column"),
            F.col("value").cast("string").alias("value"),
            "n",
            (F.col("n") / F.col("__f.rows") * 100).alias("share_percent"),
            F.col("__f.unique_values").alias("unique_values"),
            F.col("__f.null_count").alias("null_count"),
        )
    )


def summary(df: DataFrame, column: str) -> DataFrame:
    if analytic_class(df.schema[column].dataType) == "numeric":
        return numeric_summary(df, column)
    return text_summary(df, column)


def correlation_pairs(df: DataFrame, top: int = 5) -> DataFrame:
    names = columns_of(df, "numeric", classify=analytic_class)
    return correlation.ranked_pairs(df, names, top).select(
        F.col("column_a").alias("feature_1"),
        F.col("column_b").alias("feature_2"),
        F.col("r").alias("correlation"),
    )


def table_size(df: DataFrame) -> DataFrame:
    width = len(df.columns)
    return df.agg(F.count("*").alias("total_rows")).select(
        "total_rows",
        F.lit(width).cast("bigint").alias("total_columns"),
        (F.col("total_rows") * width).alias("total_cells"),
    )


def missing_ranked(df: DataFrame) -> DataFrame:
    """Columns that have missing values, most first."""
    return missing_by_column(df).where("null_count > 0").orderBy(F.desc("null_count"), "column_index")


def missing_by_column(df: DataFrame) -> DataFrame:
    """(column_index, column, non_null_count, null_count, null_percentage): one scan."""
    aggs = [F.count(clean_value(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    cells = [
        F.struct(
            F.lit(i).alias("column_index"),
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("non_null_count"),
            (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
            F.round(
                F.coalesce(
                    F.try_divide(F.col("rows") - F.col(f"n{i}"), F.col("rows")) * 100, F.lit(0.0)
                ),
                2,
            ).alias("null_percentage"),
        )
        for i, c in enumerate(df.columns)
    ]
    return (
        df.agg(F.count("*").alias("rows"), *aggs)
        .select(F.explode(F.array(*cells)).alias("c"))
        .select("c.*")
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    copies = frequencies.duplicate_count(df)
    return df.agg(F.count("*").alias("rows")).select(
        F.lit(copies).cast("bigint").alias("duplicate_rows_count"),
        F.round(
            F.coalesce(F.try_divide(F.lit(copies), F.col("rows")) * 100, F.lit(0.0)), 2
        ).alias("duplicate_rows_percentage"),
    )


def columns_by_class(df: DataFrame) -> DataFrame:
    rows = [
        (i, f.name, f.dataType.simpleString(), analytic_class(f.dataType))
        for i, f in enumerate(df.schema.fields)
    ]
    return small_frame(
        df.sparkSession, rows, "column_index int, column string, data_type string, class string"
    )
