"""Table profile: one scan for the moments, a second for fence-dependent counts.

What reaches the driver is one row of statistics per column; every table
returned below is derived from those rows.
"""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablewright.functions import fixed_values as V
from tablewright.functions.columns import (
    as_text,
    clean_value,
    has_irregular_space,
    is_text,
    number,
    profile_class,
    ref,
    small_frame,
)
from tablewright.operators import correlation, frequencies, quantiles

COLUMNS_PER_SCAN = 100

def percent(part: float, whole: float, digits: int = 2) -> float:
    return round(part / whole * 100, digits) if whole else 0.0


def name_has_irregular_space(name: str) -> bool:
    return name != name.strip() or "  " in name


class TableProfile:
    """Profile of one table. ``order_by`` is needed only for sampled rows."""

    def __init__(self, df: DataFrame, order_by: list[str] | None = None, exact: bool = True):
        self.df = df
        self.spark = df.sparkSession
        self.order_by = order_by
        self.exact = exact

    # --- scans -------------------------------------------------------------

    @cached_property
    def columns(self) -> list[dict]:
        """One dict of statistics per column."""
        fields = self.df.schema.fields
        out = []
        for start in range(0, max(len(fields), 1), COLUMNS_PER_SCAN):
            out += self._scan(list(enumerate(fields))[start : start + COLUMNS_PER_SCAN])
        return out

    def _scan(self, fields) -> list[dict]:
        # Values are read in one projection; the aggregates only refer to them.
        values = self.df.select(*[self._value(f).alias(f"x{i}") for i, f in fields])
        aggs = [F.count("*").alias("rows")]
        for i, f in fields:
            aggs += [a.alias(f"{name}{i}") for name, a in self._column_aggs(f, F.col(f"x{i}")).items()]
        row = values.agg(*aggs).first()
        self.__dict__["rows"] = row["rows"]
        stats = [self._column_stats(i, f, row) for i, f in fields]
        self._confirm_constants(values, stats)
        return stats

    @staticmethod
    def _confirm_constants(values: DataFrame, stats: list[dict]) -> None:
        """Put the value itself where one hash suggests a single value."""
        suspects = [c for c in stats if c["constant_value"]]
        if not suspects:
            return
        extremes = values.agg(
            *[
                agg(f"x{c['column_index']}").alias(f"{agg.__name__}{c['column_index']}")
                for c in suspects
                for agg in (F.min, F.max)
            ]
        ).first()
        for c in suspects:
            low, high = (extremes[f"{k}{c['column_index']}"] for k in ("min", "max"))
            c["constant_value"] = low if low == high else None

    def _value(self, f: T.StructField) -> Column:
        kind = profile_class(f.dataType)
        if kind == "numeric":
            return number(self.df, f.name)
        return as_text(self.df, f.name) if kind == "categorical" else clean_value(self.df, f.name)

    @staticmethod
    def _column_aggs(f: T.StructField, v: Column) -> dict[str, Column]:
        kind = profile_class(f.dataType)
        aggs = {"n": F.count(v)}
        if kind == "numeric":
            aggs |= {
                "min": F.min(v),
                "max": F.max(v),
                "avg": F.avg(v),
                "var": F.var_samp(v),
            }
            if any(w in f.name.lower() for w in V.NON_NEGATIVE_WORDS):
                aggs["neg"] = F.count_if(v < 0)
            if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
                aggs["whole"] = F.bool_and((v == F.rint(v)) & (F.abs(v) < float("inf")))
        elif kind == "categorical":
            # Text extremes would force a sort-based aggregate; a hash tells
            # columns with several values apart from possibly constant ones.
            mark = F.when(v.isNotNull(), F.xxhash64(v))
            aggs |= {"min": F.min(mark), "max": F.max(mark)}
            if is_text(f.dataType):
                aggs["space"] = F.count_if(has_irregular_space(v))
        return aggs

    @staticmethod
    def _column_stats(i: int, f: T.StructField, row) -> dict:
        values = row.asDict()
        get = lambda name: values.get(f"{name}{i}")
        kind = profile_class(f.dataType)
        n, rows = get("n"), values["rows"]
        one_hash = kind == "categorical" and n > 0 and get("min") == get("max")
        numeric = kind == "numeric"
        return {
            "column_index": i,
            "column": f.name,
            "class": kind,
            "data_type": f.dataType.simpleString(),
            "non_null_count": n,
            "null_count": rows - n,
            "null_percentage": percent(rows - n, rows),
            "min_value": get("min") if numeric else None,
            "max_value": get("max") if numeric else None,
            "mean_value": get("avg"),
            "std_value": (get("var") or 0.0) ** 0.5 if numeric and n else None,
            "variance": get("var"),
            "negative_count": get("neg"),
            "whole_numbers": get("whole"),
            "constant_value": one_hash or None,
            "space_count": get("space") or 0,
            "name_has_space": name_has_irregular_space(f.name),
        }

    @cached_property
    def rows(self) -> int:
        self.columns  # noqa: B018  (the scan sets the row count)
        return self.__dict__["rows"]

    @cached_property
    def numeric(self) -> list[dict]:
        """Numeric columns that hold at least one value."""
        return [c for c in self.columns if c["class"] == "numeric" and c["non_null_count"]]

    @cached_property
    def duplicates(self) -> int:
        return frequencies.duplicate_count(self.df)

    @cached_property
    def fence_values(self) -> dict[str, dict]:
        names = [c["column"] for c in self.numeric]
        sizes = {c["column"]: c["non_null_count"] for c in self.numeric}
        found = quantiles.quantiles(self.df, names, [0.25, 0.75], self.exact, sizes)
        return {
            c: {
                "q1": q1,
                "q3": q3,
                "iqr": q3 - q1,
                "lower": q1 - V.FENCE_FACTOR * (q3 - q1),
                "upper": q3 + V.FENCE_FACTOR * (q3 - q1),
            }
            for c, (q1, q3) in found.items()
        }

    @cached_property
    def outlier_counts(self) -> dict[str, int]:
        fenced = [c for c, f in self.fence_values.items() if f["iqr"] > 0]
        if not fenced:
            return {}
        row = self.df.agg(
            *[F.count_if(self.outside(c)).alias(f"o{i}") for i, c in enumerate(fenced)]
        ).first()
        return {c: row[f"o{i}"] for i, c in enumerate(fenced) if row[f"o{i}"]}

    def outside(self, column: str) -> Column:
        fence = self.fence_values[column]
        v = number(self.df, column)
        return (v < fence["lower"]) | (v > fence["upper"])

    @cached_property
    def unique_counts(self) -> dict[str, int]:
        counted = frequencies.distinct_counts(self.df, self.df.columns, self.exact)
        return {r["column"]: r["unique_count"] for r in counted.collect()}

    @cached_property
    def correlations(self) -> dict[tuple[str, str], float]:
        """Unrounded r of every pair of numeric columns, in column order."""
        names = [c["column"] for c in self.numeric]
        if len(names) < 2:
            return {}
        return correlation.coefficients(self.df, names, self.correlation_facts)

    @property
    def correlation_facts(self) -> dict[str, dict]:
        return {
            c["column"]: {
                "rows": self.rows,
                "n": c["non_null_count"],
                "avg": c["mean_value"],
                "min": c["min_value"],
                "max": c["max_value"],
            }
            for c in self.numeric
        }

    @cached_property
    def skews(self) -> dict[str, float]:
        """Bias-corrected skewness of all numeric columns; constant columns give 0."""
        sizes = {c["column"]: c["non_null_count"] for c in self.numeric}
        long = [c for c, n in sizes.items() if n >= 10]
        if not long:
            return {}
        row = self.df.agg(
            *[F.skewness(number(self.df, c)).alias(f"s{i}") for i, c in enumerate(long)]
        ).first()
        out = {}
        for i, c in enumerate(long):
            n = sizes[c]
            out[c] = (row[f"s{i}"] or 0.0) * (n * (n - 1)) ** 0.5 / (n - 2)
        return out

    # --- table level -------------------------------------------------------

    @property
    def missing(self) -> int:
        return sum(c["null_count"] for c in self.columns)

    @property
    def cells(self) -> int:
        return self.rows * len(self.columns)

    def table_metrics(self) -> DataFrame:
        row = (
            self.rows,
            len(self.columns),
            self.cells,
            self.missing,
            percent(self.missing, self.cells),
            self.duplicates,
            percent(self.duplicates, self.rows),
        )
        return small_frame(
            self.spark,
            [row],
            """total_rows bigint, total_columns bigint, total_cells bigint,
            total_missing_cells bigint, missing_cells_percentage double,
            duplicate_rows_count bigint, duplicate_rows_percentage double""",
        )

    def scores(self) -> dict[str, float]:
        """Quality scores 0–100, each rounded before it enters the next."""
        missing = percent(self.missing, self.cells)
        repeated = percent(self.duplicates, self.rows)
        outliers = percent(sum(self.outlier_counts.values()), self.rows * len(self.numeric))
        issues = len(self.inconsistency_rows())
        parts = {
            "completeness": max(0.0, round(100.0 - missing * V.COMPLETENESS_PENALTY, 1)),
            "uniqueness": max(0.0, round(100.0 - repeated * V.UNIQUENESS_PENALTY, 1)),
            "consistency": max(0.0, round(100.0 - issues * V.CONSISTENCY_PENALTY, 1)),
            "validity": max(0.0, round(100.0 - outliers * V.VALIDITY_PENALTY, 1)),
        }
        total = sum(parts[k] * w for k, w in V.SCORE_WEIGHTS.items())
        return {"overall": round(total, 1), **parts}

    def quality_scores(self) -> DataFrame:
        s = self.scores()
        return small_frame(
            self.spark,
            [(s["overall"], s["completeness"], s["uniqueness"], s["consistency"], s["validity"])],
            """overall_quality_score double, completeness_score double, uniqueness_score double,
            consistency_score double, validity_score double""",
        )

    # --- column level ------------------------------------------------------

    def column_metrics(self) -> DataFrame:
        """The column summary: counts, distinct values and rounded statistics."""
        rows = []
        for c in self.columns:
            stats = [c[k] for k in ("min_value", "max_value", "mean_value", "std_value")]
            rows.append(
                (
                    c["column_index"],
                    c["column"],
                    c["data_type"],
                    c["non_null_count"],
                    c["null_count"],
                    c["null_percentage"],
                    self.unique_counts[c["column"]],
                    c["class"] == "numeric",
                    c["class"] in ("categorical", "boolean"),
                    c["class"] == "datetime",
                    *[None if v is None else round(v, 2) for v in stats],
                )
            )
        return small_frame(
            self.spark,
            rows,
            """column_index int, column string, data_type string, non_null_count bigint,
            null_count bigint, null_percentage double, unique_count bigint, is_numeric boolean,
            is_categorical boolean, is_datetime boolean, min_value double, max_value double,
            mean_value double, std_value double""",
        )

    def numeric_stats(self) -> DataFrame:
        rows = [
            (
                c["column"],
                *[round(c[k], 2) for k in ("min_value", "max_value", "mean_value", "std_value")],
            )
            for c in self.numeric
        ]
        return small_frame(
            self.spark,
            rows,
            "column string, min_value double, max_value double, mean_value double, std_value double",
        )

    def fences(self) -> DataFrame:
        rows = [(c, *f.values()) for c, f in self.fence_values.items()]
        return small_frame(
            self.spark,
            rows,
            "column string, q1 double, q3 double, iqr double, lower_bound double, upper_bound double",
        )

    def outliers(self) -> DataFrame:
        sizes = {c["column"]: c["non_null_count"] for c in self.numeric}
        rows = [
            (
                c,
                n,
                percent(n, sizes[c]),
                round(self.fence_values[c]["lower"], 2),
                round(self.fence_values[c]["upper"], 2),
                V.FENCE_METHOD,
            )
            for c, n in self.outlier_counts.items()
        ]
        return small_frame(
            self.spark,
            rows,
            """column string, outlier_count bigint, outlier_percentage double,
            lower_bound double, upper_bound double, method string""",
        )

    def outlier_samples(self, k: int = 6) -> DataFrame:
        """First ``k`` outliers per column in key order.

        One scan; each task keeps at most ``k`` rows per column before the
        shuffle, so a column full of outliers moves no more than a clean one.
        """
        fenced = list(self.outlier_counts)
        if not fenced:
            return small_frame(
                self.spark, [], "column string, position int, sample_outlier double"
            )
        keys = [ref(c) for c in self._ordering()]
        cells = [
            F.when(
                self.outside(c),
                F.struct(
                    F.lit(c).alias("column"),
                    number(self.df, c).alias("sample_outlier"),
                ),
            )
            for c in fenced
        ]
        found = (
            self.df.select(
                *[k_.alias(f"__k{i}") for i, k_ in enumerate(keys)],
                F.explode(F.array_compact(F.array(*cells))).alias("c"),
            )
            .select("c.*", *[f"__k{i}" for i in range(len(keys))])
        )
        w = Window.partitionBy("column").orderBy(*[f"__k{i}" for i in range(len(keys))])
        return (
            found.withColumn("position", F.row_number().over(w))
            .where(F.col("position") <= k)
            .select("column", "position", F.round("sample_outlier", 2).alias("sample_outlier"))
        )

    def _ordering(self) -> list[str]:
        if not self.order_by:
            raise ValueError("order_by is required: rows have no order of their own")
        return self.order_by

    def inconsistency_rows(self) -> list[tuple]:
        issues = []
        for c in self.columns:
            name, nulls = c["column"], c["null_count"]
            negative = c["negative_count"] or 0
            if negative:
                text = V.NEGATIVE_DESCRIPTION % (negative, name)
                severity = "high" if negative > 5 else "medium"
                issues.append((name, V.ISSUE_NEGATIVE, text, negative, severity))
            if c["constant_value"] is not None:
                text = V.CONSTANT_DESCRIPTION % (name, c["constant_value"])
                issues.append((name, V.ISSUE_CONSTANT, text, self.rows, "medium"))
            if c["null_percentage"] >= V.CRITICAL_MISSING_PERCENT:
                text = V.MISSING_DESCRIPTION % (name, c["null_percentage"], nulls, self.rows)
                issues.append((name, V.ISSUE_MISSING, text, nulls, "high"))
        return issues

    def inconsistencies(self) -> DataFrame:
        rows = [(i + 1, *r) for i, r in enumerate(self.inconsistency_rows())]
        return small_frame(
            self.spark,
            rows,
            """issue_number int, column string, issue_type string, description string,
            affected_count bigint, severity string""",
        )

    def whitespace(self) -> DataFrame:
        rows = [
            (c["column"], c["name_has_space"], c["space_count"])
            for c in self.columns
            if c["space_count"] or c["name_has_space"]
        ]
        return small_frame(
            self.spark,
            rows,
            "column string, name_has_space boolean, values_with_space_count bigint",
        )

    def whitespace_totals(self) -> DataFrame:
        return (
            self.whitespace()
            .agg(
                F.count("*").alias("affected_columns_count"),
                F.coalesce(
                    F.sum(F.col("values_with_space_count") + F.col("name_has_space").cast("int")),
                    F.lit(0),
                ).alias("total_irregular_occurrences"),
            )
            .withColumn("has_issues", F.col("affected_columns_count") > 0)
        )

    # --- relations between columns ------------------------------------------

    def correlation_matrix(self) -> DataFrame:
        names = [c["column"] for c in self.numeric]
        if len(names) < 2:
            return small_frame(
                self.spark,
                [],
                "index_a int, index_b int, column_a string, column_b string, r double",
            )
        return correlation.matrix(self.df, names, facts=self.correlation_facts)

    def _spreads(self) -> list[tuple[dict, float]]:
        """Columns with more than one value and their coefficient of variation."""
        return [
            (c, abs(c["std_value"] / (c["mean_value"] or 1.0)))
            for c in self.numeric
            if c["non_null_count"] > 1
        ]

    def variance_cv(self) -> DataFrame:
        rows = [(c["column"], round(c["variance"], 2), round(cv, 2)) for c, cv in self._spreads()]
        return small_frame(
            self.spark, rows, "column string, variance double, coefficient_of_variation double"
        )

    @cached_property
    def partners(self) -> dict[str, tuple[str | None, float]]:
        """Strongest partner per column; earliest column on ties, none when every r is 0."""
        names = [c["column"] for c in self.numeric]
        found = {}
        if len(names) > correlation.WIDE:
            best = correlation.strongest(self.correlation_matrix()).collect()  # a row per column
            by_name = {r["column_a"]: (r["column_b"], r["r"]) for r in best}
            return {c: by_name[c] for c in names}
        for c in names:
            best, strength = None, 0.0
            for other in names:
                if other == c:
                    continue
                pair = (c, other) if (c, other) in self.correlations else (other, c)
                r = round(self.correlations[pair], 3)
                if abs(r) > abs(strength):
                    best, strength = other, r
            found[c] = (best, strength)
        return found

    def top_partner(self) -> DataFrame:
        return small_frame(
            self.spark,
            [(c, *p) for c, p in self.partners.items()],
            "column string, partner_column string, correlation_coefficient double",
        )

    def important_variables(self, n: int = 6) -> DataFrame:
        rows = []
        for c, cv in self._spreads():
            partner, r = self.partners[c["column"]]
            score = round(min(100.0, cv * 20.0 + abs(r) * 40.0), 1)
            shown = r if partner else None
            rows.append((c["column"], round(c["variance"], 2), round(cv, 2), partner, shown, score))
        rows.sort(key=lambda row: -row[-1])
        return small_frame(
            self.spark,
            rows[:n],
            """column string, variance double, coefficient_of_variation double,
            partner_column string, correlation_coefficient double, importance_score double""",
        )

    def skew_patterns(self) -> DataFrame:
        rows = []
        for column, skew in self.skews.items():
            label = V.SKEW_NONE
            if skew > 1.0:
                label = V.SKEW_RIGHT
            elif skew < -1.0:
                label = V.SKEW_LEFT
            rows.append((column, V.SKEW_PATTERN, round(skew, 2), label))
        return small_frame(
            self.spark,
            rows,
            "variable string, pattern_type string, metric_value double, interpretation string",
        )

    def next_steps(self) -> list[str]:
        steps = [f"{kind} in '{c}': {text}" for c, kind, text, *_ in self.inconsistency_rows()]
        for column, n in self.outlier_counts.items():
            steps.append(V.NEXT_OUTLIERS % (column, n))
        if self.missing:
            worst = max(self.columns, key=lambda c: (c["null_count"], -c["column_index"]))
            steps.append(V.NEXT_MISSING % (f"{worst['null_count']:,}", worst["column"]))
        if self.duplicates:
            steps.append(V.NEXT_DUPLICATES % f"{self.duplicates:,}")
        return steps

    def next_investigations(self) -> DataFrame:
        rows = [(i + 1, text) for i, text in enumerate(self.next_steps())]
        return small_frame(self.spark, rows, "step int, recommendation string")

    # --- document ----------------------------------------------------------

    def document(self) -> dict:
        """The whole profile as one nested value."""
        rows = lambda frame: [r.asDict(recursive=True) for r in frame.collect()]
        doc = {**rows(self.quality_scores())[0], **rows(self.table_metrics())[0]}
        doc["columns_summary"] = rows(self.column_metrics().orderBy("column_index"))
        doc["outliers"] = rows(self.outliers())
        doc["inconsistencies"] = rows(self.inconsistencies())
        matrix: dict[str, dict[str, float]] = {}
        for (a, b), r in self.correlations.items():
            matrix.setdefault(a, {})[b] = round(r, 3)
            matrix.setdefault(b, {})[a] = round(r, 3)
        doc["correlations"] = matrix
        doc["important_variables"] = rows(self.important_variables())
        doc["trends_and_patterns"] = rows(self.skew_patterns())
        doc["next_investigations"] = self.next_steps()
        doc["trim_spaces_issues"] = {
            **rows(self.whitespace_totals())[0],
            "details": rows(self.whitespace()),
        }
        if self.order_by:
            from tablewright.plans import detect

            samples = {r["column"]: r["sample_values"] for r in detect.sample_values(self).collect()}
            issues = {r["column"]: r.asDict() for r in detect.type_issues(self).collect()}
            for c in doc["columns_summary"]:
                c["sample_values"] = samples.get(c["column"], [])
                c["data_type_issue"] = issues.get(c["column"])
        return doc

    def to_json(self) -> DataFrame:
        return small_frame(self.spark, [(json.dumps(self.document(), default=str),)], "profile string")
