"""Tables of the quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed_values as V
from tablewright.functions.columns import small_frame
from tablewright.plans.profile import TableProfile, percent


# Positions of outlier rows, behind those of any other issue.
OUTLIERS_FROM = 1_000_000


def summary(profile: TableProfile) -> DataFrame:
    """Eight labelled values."""
    s = profile.scores()
    values = [
        f"{s['overall']} / 100",
        f"{profile.rows:,}",
        f"{s['completeness']}%",
        str(len(profile.columns)),
        f"{s['uniqueness']}%",
        f"{profile.missing:,} ({percent(profile.missing, profile.cells)}%)",
        f"{s['consistency']}% / {s['validity']}%",
        f"{profile.duplicates:,}",
    ]
    rows = zip(V.SUMMARY_LABELS, values)
    return small_frame(
        profile.spark,
        [(i + 1, *r) for i, r in enumerate(rows)],
        "position int, metric string, value string",
    )


def issues(profile: TableProfile) -> DataFrame:
    """All inconsistencies, then all columns with outliers."""
    found = (
        profile.inconsistencies()
        .select(
            F.col("issue_number").alias("position"),
            "column",
            F.col("issue_type").alias("issue"),
            F.col("affected_count").cast("string").alias("affected"),
            "description",
        )
    )
    tails = [
        (
            OUTLIERS_FROM + i,
            r["column"],
            V.OUTLIER_ISSUE,
            f"{r['outlier_count']} ({r['outlier_percentage']}%)",
            V.OUTLIER_RANGE % (r["lower_bound"], r["upper_bound"]),
        )
        for i, r in enumerate(profile.outliers().collect())
    ]
    schema = "position int, column string, issue string, affected string, description string"
    return found.unionByName(small_frame(profile.spark, tails, schema))


def audit(log: DataFrame) -> DataFrame:
    return log.select(
        F.col("step_number").alias("step"),
        F.col("target_column").alias("column"),
        F.upper("action_type").alias("action"),
        F.concat_ws(" ", "decision_details", "rationale").alias("details"),
    ).orderBy("step")


def next_steps(profile: TableProfile) -> DataFrame:
    steps = profile.next_steps() or [V.NEXT_DEFAULT]
    return small_frame(
        profile.spark, [(i + 1, s) for i, s in enumerate(steps)], "step int, recommendation string"
    )
