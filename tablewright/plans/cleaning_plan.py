"""User-written cleaning plans: validated first, then run as one lazy lineage.

Statistics are gathered in batches. Editing one column cannot change another
column's statistics, so decisions share their aggregates until one of them
removes rows; only there a new batch starts.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed_values as V
from tablewright.functions.columns import clean_value, is_text, number, profile_class, small_frame
from tablewright.operators import cleaning, frequencies, ordered, quantiles
from tablewright.plans.profile import TableProfile
from tablewright.session import cut_lineage

ACTIONS = ("keep", "fill", "remove_column", "remove_rows")
OUTLIER_ACTIONS = ("keep", "clip", "remove_rows")
AUDIT_SCHEMA = """step_number int, action_type string, target_column string,
    decision_details string, rationale string,
    before_metrics map<string,string>, after_metrics map<string,string>"""
METRIC_SCHEMA = """rows_before bigint, rows_after bigint, columns_before bigint,
    columns_after bigint, missing_cells_before bigint, missing_cells_after bigint,
    duplicates_before bigint, duplicates_after bigint"""


@dataclass(frozen=True)
class ColumnDecision:
    column: str
    action: str = "keep"
    fill_method: str | None = None
    fill_value: object = None
    outlier_action: str = "keep"
    convert_type: str | None = None
    rationale: str | None = None


@dataclass(frozen=True)
class CleaningPlan:
    decisions: tuple[ColumnDecision, ...] = ()
    remove_duplicates: bool = False
    trim_spaces: bool = False
    drop_note_columns: bool = True
    order_by: tuple[str, ...] = ()
    custom_notes: str | None = None


class CleanResult:
    """The cleaned table, its audit trail, and metrics computed when asked for."""

    def __init__(self, df: DataFrame, audit: DataFrame, before: DataFrame):
        self.df, self.audit, self.before = df, audit, before

    @cached_property
    def metrics(self) -> dict[str, int]:
        before, after = table_counts(self.before), table_counts(self.df)
        return {
            f"{name}_{when}": counts[name]
            for name in ("rows", "columns", "missing_cells", "duplicates")
            for when, counts in (("before", before), ("after", after))
        }

    def diff(self) -> DataFrame:
        return small_frame(self.df.sparkSession, [tuple(self.metrics.values())], METRIC_SCHEMA)

    def quality_diff(self) -> DataFrame:
        """Overall quality score before and after."""
        # A profile reads its table many times: the planned steps should not run in each.
        tables = [cut_lineage(d) for d in (self.before, self.df)]
        scores = [TableProfile(d).scores()["overall"] for d in tables]
        return small_frame(
            self.df.sparkSession,
            [tuple(scores)],
            "quality_score_before double, quality_score_after double",
        )


def validate(df: DataFrame, plan: CleaningPlan) -> None:
    """Reject decisions that could not run, before anything runs."""
    kinds = {f.name: profile_class(f.dataType) for f in df.schema.fields}
    if plan.trim_spaces:
        kinds = {cleaning.squeeze_name(c): k for c, k in kinds.items()}
    for d in plan.decisions:
        if d.action not in ACTIONS:
            raise ValueError(f"unknown action {d.action!r} for {d.column!r}")
        if (d.outlier_action or "keep") not in OUTLIER_ACTIONS:
            raise ValueError(f"unknown outlier action {d.outlier_action!r} for {d.column!r}")
        if d.convert_type:
            cleaning.target_type(d.convert_type)
        if d.action != "fill" or d.column not in kinds:
            continue
        if d.fill_method is not None and d.fill_method not in cleaning.FILL_METHODS:
            raise ValueError(f"unknown fill method {d.fill_method!r} for {d.column!r}")
        if d.fill_method in ("mean", "median") and kinds[d.column] != "numeric":
            raise ValueError(f"{d.fill_method} fill needs a numeric column: {d.column!r}")
        if d.fill_method in ("ffill", "bfill") and not plan.order_by:
            raise ValueError(f"{d.fill_method} fill of {d.column!r} needs the plan's order_by")


def segments(decisions) -> list[list[ColumnDecision]]:
    """Runs of decisions whose statistics do not depend on one another."""
    out: list[list[ColumnDecision]] = []
    closed = True
    for d in decisions:
        repeats = bool(out) and any(e.column == d.column for e in out[-1])
        if closed or d.action == "remove_rows" or repeats:
            out.append([])
        out[-1].append(d)
        closed = d.action == "remove_rows" or d.outlier_action == "remove_rows"
    return out


def run(df: DataFrame, plan: CleaningPlan) -> CleanResult:
    """Apply a plan: notes, trimming, duplicates, decisions in order, column drops."""
    validate(df, plan)
    return _Run(df, plan).result()


class _Run:
    def __init__(self, df: DataFrame, plan: CleaningPlan):
        self.raw, self.plan = df, plan
        self.df = df
        self.audit: list[tuple] = []

    def log(self, action, column, details, rationale, before, after):
        text = lambda m: {k: str(v) for k, v in m.items()}
        self.audit.append(
            (len(self.audit) + 1, action, column, details, rationale, text(before), text(after))
        )

    def result(self) -> CleanResult:
        plan = self.plan
        if plan.drop_note_columns:
            self.df = cleaning.drop_columns(self.df, cleaning.note_columns(self.df))
        if plan.trim_spaces:
            self.trim()
        if plan.remove_duplicates:
            self.deduplicate()
        for segment in segments(plan.decisions):
            self.decide(segment)
        dropped = [d.column for d in plan.decisions if d.action == "remove_column"]
        self.df = cleaning.drop_columns(self.df, dropped)
        if plan.drop_note_columns:
            self.df = cleaning.drop_columns(self.df, cleaning.note_like_columns(self.df))
        audit = small_frame(
            self.raw.sparkSession,
            [(*r[:5], list(r[5].items()), list(r[6].items())) for r in self.audit],
            AUDIT_SCHEMA,
        )
        return CleanResult(self.df, audit, self.raw)

    def trim(self):
        renamed = [c for c in self.df.columns if cleaning.squeeze_name(c) != c]
        texts = [f.name for f in self.df.schema.fields if is_text(f.dataType)]
        self.df = cleaning.trim_values(cleaning.trim_names(self.df))
        self.log(
            "trim_spaces",
            "ALL_COLUMNS",
            V.AUDIT_TRIM % (len(renamed), len(texts)),
            "Only spacing changed; values and missing cells are as they were.",
            {"columns_renamed": len(renamed)},
            {"text_columns_sanitized": len(texts)},
        )

    def deduplicate(self):
        distinct = frequencies.drop_duplicates(self.df)
        if distinct is self.df:
            return
        # Later statistics would repeat the shuffle.
        rows, distinct = self.df.count(), cut_lineage(distinct)
        left = distinct.count()
        copies = rows - left
        if not copies:
            return
        self.df = distinct
        self.log(
            "remove_duplicates",
            "ALL_COLUMNS",
            V.AUDIT_DUPLICATES % copies,
            "The plan asks for one copy of every row.",
            {"duplicate_count": copies, "row_count": rows},
            {"duplicate_count": 0, "row_count": left},
        )

    def decide(self, segment: list[ColumnDecision]):
        known = [d for d in segment if d.column in self.df.columns]
        fields = {d.column: self.df.schema[d.column].dataType for d in known}
        facts = self.statistics(known, fields)
        notes: dict[str, list[tuple]] = {d.column: [] for d in segment}
        self.fill_in_order(known, fields, facts)
        for d in segment:
            if d in known:
                self.act(d, fields[d.column], facts, notes[d.column])
            else:
                notes[d.column].append(
                    (
                        "skipped",
                        f"Column '{d.column}' is not in the table.",
                        "Nothing to apply the decision to.",
                        {},
                        {},
                    )
                )
        self.handle_outliers(known, fields, notes)
        for d in known:
            if d.convert_type:
                self.convert(d, notes[d.column])
        for d in segment:
            for action, *rest in notes[d.column]:
                self.log(action, d.column, *rest)

    # --- statistics of one segment -------------------------------------------

    def method_of(self, d, dtype) -> str:
        return d.fill_method or ("median" if profile_class(dtype) == "numeric" else "mode")

    def statistics(self, known, fields) -> dict:
        """Null counts and means in one aggregate, medians in one, modes in one."""
        if not known:
            return {}
        names = [d.column for d in known]
        means = [
            d.column
            for d in known
            if d.action == "fill" and self.method_of(d, fields[d.column]) == "mean"
        ]
        row = self.df.agg(
            F.count("*").alias("rows"),
            *[F.count(clean_value(self.df, c)).alias(f"n{i}") for i, c in enumerate(names)],
            *[F.avg(number(self.df, c)).alias(f"m{i}") for i, c in enumerate(means)],
        ).first()
        facts = {
            "rows": row["rows"],
            "nulls": {c: row["rows"] - row[f"n{i}"] for i, c in enumerate(names)},
            "mean": {c: row[f"m{i}"] for i, c in enumerate(means)},
        }
        filled = [d for d in known if d.action == "fill" and facts["nulls"][d.column]]
        medians = [d.column for d in filled if self.needs_median(d, fields[d.column])]
        sizes = {c: row["rows"] - facts["nulls"][c] for c in medians}
        facts["median"] = {
            c: q[0] for c, q in quantiles.quantiles(self.df, medians, [0.5], sizes=sizes).items()
        }
        facts["mode"] = cleaning.mode_fills(
            self.df, [d.column for d in filled if self.method_of(d, fields[d.column]) == "mode"]
        )
        return facts

    def needs_median(self, d, dtype) -> bool:
        method = self.method_of(d, dtype)
        if method == "median":
            return True
        if method != "constant" or profile_class(dtype) != "numeric" or d.fill_value is None:
            return False
        try:
            float(d.fill_value)
        except (TypeError, ValueError):
            return True
        return False

    # --- steps of one decision -------------------------------------------------

    def act(self, d, dtype, facts, notes):
        c, nulls, rows = d.column, facts["nulls"][d.column], facts["rows"]
        if d.action == "keep":
            same = {"missing_count": nulls, "total_count": rows}
            notes.append(
                (
                    "keep",
                    V.AUDIT_KEEP % nulls,
                    "The plan keeps this column as it is.",
                    same,
                    same,
                )
            )
        elif d.action == "remove_column":
            notes.append(
                (
                    "remove_column",
                    V.AUDIT_REMOVE_COLUMN % c,
                    "The plan leaves this column out of the result.",
                    {"column_present": True, "missing_in_col": nulls},
                    {"column_present": False},
                )
            )
        elif d.action == "remove_rows" and nulls:
            self.df = cleaning.drop_null_rows(self.df, c)
            notes.append(
                (
                    "remove_rows",
                    V.AUDIT_REMOVE_ROWS % (nulls, c),
                    "The plan needs a value in this column.",
                    {"row_count": rows, "missing_in_col": nulls},
                    {"row_count": rows - nulls, "missing_in_col": 0},
                )
            )
        elif d.action == "fill" and nulls:
            self.fill(d, dtype, facts, nulls, notes)

    def fill_in_order(self, known, fields, facts):
        """All forward fills of a segment in one pass, then all backward fills."""
        before = self.df
        for method, step in (("ffill", ordered.fill_forward), ("bfill", ordered.fill_backward)):
            columns = [
                d.column
                for d in known
                if d.action == "fill"
                and facts["nulls"][d.column]
                and self.method_of(d, fields[d.column]) == method
            ]
            if columns:
                self.df = step(self.df, columns, list(self.plan.order_by))
        if self.df is not before:
            # Later statistics would repeat the sort.
            self.df = cut_lineage(self.df)

    def fill(self, d, dtype, facts, nulls, notes):
        c, method = d.column, self.method_of(d, dtype)
        left = 0
        if method in ("ffill", "bfill"):
            # The cells are filled already, see ``fill_in_order``.
            value, details = method, V.AUDIT_FILL[method] % nulls
            left = nulls if nulls == facts["rows"] else 0
        else:
            value = self.value_for(d, method, dtype, facts)
            if value is None:
                left = nulls
            else:
                self.df = cleaning.fill_value(self.df, c, value)
            details = V.AUDIT_FILL[method] % (nulls, value)
        notes.append(
            (
                "fill",
                details,
                f"The plan fills missing cells by {method}.",
                {"missing_count": nulls},
                {"missing_count": left, "imputed_value": value},
            )
        )

    def value_for(self, d, method, dtype, facts):
        c = d.column
        if method in ("mean", "median"):
            found = facts[method][c]
            return None if found is None else round(float(found), 2)
        if method == "mode":
            return facts["mode"][c]
        if profile_class(dtype) == "numeric" and c in facts["median"]:
            median = facts["median"][c]
            return float(median) if median is not None else 0.0
        return cleaning.constant_value(self.df, c, d.fill_value)

    def handle_outliers(self, known, fields, notes):
        asked = [
            d
            for d in known
            if d.outlier_action in ("clip", "remove_rows")
            and profile_class(fields[d.column]) == "numeric"
        ]
        if not asked:
            return
        fences = cleaning.fences(self.df, [d.column for d in asked])
        fenced = [d for d in asked if d.column in fences]
        if not fenced:
            return
        row = self.df.agg(
            F.count("*").alias("rows"),
            *[
                F.count_if(cleaning.outside(self.df, d.column, fences[d.column])).alias(f"o{i}")
                for i, d in enumerate(fenced)
            ],
        ).first()
        for i, d in enumerate(fenced):
            found, c = row[f"o{i}"], d.column
            if not found:
                continue
            low, high = (round(x, 2) for x in fences[c])
            if d.outlier_action == "clip":
                self.df = cleaning.clip_to(self.df, c, fences[c])
                notes[c].append(
                    (
                        "handle_outliers",
                        V.AUDIT_CLIP % (found, low, high),
                        "The plan keeps these rows with their values at the fences.",
                        {"outlier_count": found, "bounds": [low, high]},
                        {"outlier_count": 0},
                    )
                )
            else:
                self.df = self.df.where(~cleaning.outside(self.df, c, fences[c]))
                notes[c].append(
                    (
                        "remove_outliers_rows",
                        V.AUDIT_OUTLIER_ROWS % (found, c),
                        "The plan drops rows beyond the fences.",
                        {"rows_prior": row["rows"]},
                        {"rows_remaining": row["rows"] - found},
                    )
                )

    def convert(self, d, notes):
        c = d.column
        old = self.df.schema[c].dataType.simpleString()
        self.df = cleaning.convert(self.df, c, d.convert_type)
        new = self.df.schema[c].dataType.simpleString()
        notes.append(
            (
                "convert_data_type",
                V.AUDIT_CONVERT % (old, d.convert_type.lower(), new),
                "The plan sets this column's type; cells that do not fit are missing.",
                {"previous_type": old},
                {"converted_type": new},
            )
        )


def table_counts(df: DataFrame) -> dict[str, int]:
    """Rows, columns, missing cells and duplicate rows."""
    row = df.agg(
        F.count("*").alias("rows"),
        *[F.count(clean_value(df, c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
    ).first()
    width = len(df.columns)
    filled = sum(row[f"n{i}"] for i in range(width))
    return {
        "rows": row["rows"],
        "columns": width,
        "missing_cells": row["rows"] * width - filled,
        "duplicates": frequencies.duplicate_count(df),
    }
