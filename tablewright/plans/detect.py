"""Detection of columns stored under the wrong type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablewright.functions import fixed_values as V
from tablewright.functions.columns import (
    as_text,
    is_decimal,
    ref,
    small_frame,
    to_datetime,
    trimmed,
    unrolled,
)
from tablewright.operators import frequencies, ordered
from tablewright.plans.profile import TableProfile

# Rows read once in the hope that they hold enough values for every column.
HEAD_ROWS = 200


def first_values(profile: TableProfile, columns: list[str], k: int) -> DataFrame:
    """(column_index, column, position, value): the first ``k`` non-null values in key order.

    The head of the table usually has enough values for all columns at once.
    Only sparse columns need a top-k of their own, over two columns each.
    """
    df, order_by = profile.df, profile._ordering()
    schema = "column_index int, column string, position int, value string"
    if not columns:
        return small_frame(df.sparkSession, [], schema)
    head = (
        ordered.preview(df, max(HEAD_ROWS, k), order_by)
        .select(*[as_text(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
        .collect()
    )
    available = {c["column"]: c["non_null_count"] for c in profile.columns}
    rows, sparse = [], []
    for i, c in enumerate(columns):
        seen = [r[i] for r in head if r[i] is not None][:k]
        if len(seen) < min(k, available[c]):
            sparse.append((i, c))
        else:
            rows += [(i, c, p + 1, v) for p, v in enumerate(seen)]
    out = small_frame(df.sparkSession, rows, schema)
    keys = [f"k{j}" for j in range(len(order_by))]
    for i, c in sparse:
        values = df.select(
            as_text(df, c).alias("value"), *[ref(o).alias(n) for o, n in zip(order_by, keys)]
        ).where(F.col("value").isNotNull())
        top = ordered.preview(values, k, keys)
        # Numbers at most k rows.
        numbered = top.select(
            F.lit(i).alias("column_index"),
            F.lit(c).alias("column"),
            F.row_number().over(Window.partitionBy(F.lit(i)).orderBy(*keys)).alias("position"),
            "value",
        )
        out = out.unionByName(numbered)
    return out


def sample_values(profile: TableProfile, k: int = 5) -> DataFrame:
    """First ``k`` non-null values per column as text."""
    values = first_values(profile, profile.df.columns, k)
    return values.groupBy("column_index", "column").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("position", "value"))), lambda s: s["value"]
        ).alias("sample_values")
    )


def _candidates(profile: TableProfile) -> list[str]:
    return [
        c["column"]
        for c in profile.columns
        if c["class"] == "categorical" and c["non_null_count"] >= 3
    ]


def value_shares(profile: TableProfile) -> list[dict]:
    """Per text column: how many of all its values read as each type, and its first three values.

    One aggregate over the table, whatever the number of columns.
    """
    columns = _candidates(profile)
    if not columns:
        return []
    # One row per value: the code that reads a value is then the same, and small, for any number of
    # columns; wide aggregates of it would no longer be compiled.
    words = F.array(*[trimmed(as_text(profile.df, c)) for c in columns])
    values = unrolled(profile.df.select(words.alias("words")), F.col("words"), "column_index", "word")
    word = F.col("word")
    counted = values.select("column_index", "word").groupBy("column_index").agg(
        F.count(word).alias("values"),
        F.bool_and(F.lower(word).isin(V.BOOLEAN_WORDS)).alias("all_boolean"),
        F.count_if(word.rlike(r"(?U)^-?\d+$")).alias("integers"),
        F.count_if(is_decimal(word)).alias("decimals"),
        F.count_if(to_datetime(word).isNotNull()).alias("datetimes"),
        F.avg(F.length(word)).alias("mean_length"),
    )
    found = {r["column_index"]: r for r in counted.collect()}
    shown: dict[str, list[str]] = {c: [] for c in columns}
    for r in first_values(profile, columns, 3).orderBy("column_index", "position").collect():
        shown[r["column"]].append(r["value"])
    names = ("values", "all_boolean", "integers", "decimals", "datetimes", "mean_length")
    return [
        {"column": c, "first_three": ", ".join(shown[c]), **{n: found[i][n] for n in names}}
        for i, c in enumerate(columns)
    ]


def type_issues(profile: TableProfile) -> DataFrame:
    """(column, current_type, suggested_type, confidence, reason), one row per flagged column."""
    shares = value_shares(profile)
    flagged = [r["column"] for r in shares if r["all_boolean"]]
    few = set()
    if flagged:
        counted = frequencies.distinct_counts(profile.df, flagged)
        few = {r["column"] for r in counted.where("unique_count <= 4").collect()}
    order = {c["column"]: c["column_index"] for c in profile.columns}
    issues = []
    for r in shares:
        found = _text_issue(r, r["column"] in few)
        if found:
            issues.append((order[r["column"]], r["column"], "text/string", *found))
    for c in profile.columns:
        if c["whole_numbers"] and c["non_null_count"] >= 3:
            issues.append(
                (c["column_index"], c["column"], "decimal/float", "integer", 0.99, V.REASON_WHOLE)
            )
    return small_frame(
        profile.spark,
        sorted(issues),
        """column_index int, column string, current_type string, suggested_type string,
        confidence double, reason string""",
    )


def _text_issue(r, few_values: bool) -> tuple | None:
    if r["all_boolean"] and few_values:
        return ("boolean", 0.95, V.REASON_BOOLEAN % r["first_three"])
    tests = [
        ("integer", r["integers"], V.REASON_INTEGER),
        ("decimal", r["decimals"], V.REASON_DECIMAL),
        ("datetime", r["datetimes"] if r["mean_length"] >= 6 else 0, V.REASON_DATETIME),
    ]
    for kind, matches, reason in tests:
        share = matches / r["values"]
        if share >= V.DETECTION_SHARE:
            return (kind, round(share, 2), reason % round(share * 100))
    return None
