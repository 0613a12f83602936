from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.operators import cleaning
from tablewright.plans.cleaning_plan import CleaningPlan, ColumnDecision, run, segments

from tests.helpers import rows


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def converted(frame, to, *texts):
    df = frame("id int, v string", *enumerate(texts))
    return column(cleaning.convert(df, "v", to), "v")


def test_integer_rounds_half_to_even_and_parses_money(frame):
    found = converted(frame, "integer", "2.5", "3.5", "$1,200", "45%", "abc", " 7 ", None, "1e3", "5d")
    assert found == [2, 4, 1200, None, None, 7, None, 1000, None]


def test_decimal_strips_percent_without_dividing(frame):
    found = converted(frame, "decimal", "45%", "$1,200.50", "NaN", "x", None, "-.5")
    assert found == [45.0, 1200.5, None, None, None, -0.5]


def test_datetime_layouts_month_first(frame):
    found = converted(
        frame, "datetime", "2024-01-05", "05/12/2023", "25/12/2023", "Jan 5, 2024",
        "2024-01-05 10:20:30", "2024-01-05T10:20:30", "nope", None, "2024-02-30",
    )
    assert found == [
        datetime(2024, 1, 5), datetime(2023, 5, 12), datetime(2023, 12, 25), datetime(2024, 1, 5),
        datetime(2024, 1, 5, 10, 20, 30), datetime(2024, 1, 5, 10, 20, 30), None, None, None,
    ]


def test_boolean_words(frame):
    found = converted(frame, "boolean", "Yes", " t ", "1", "N", "f", "0", "maybe", None)
    assert found == [True, True, True, False, False, False, None, None]


def test_string_keeps_nulls(frame):
    df = frame("id int, v int", (0, 5), (1, None))
    assert column(cleaning.convert(df, "v", "string"), "v") == ["5", None]


def test_trim_covers_unicode_space_and_keeps_nulls(frame):
    df = frame("id int, v string", (0, "  a \t\n b  "), (1, None), (2, "ok"))
    assert column(cleaning.trim_values(df), "v") == ["a b", None, "ok"]


def test_trimmed_names_must_not_collide(frame):
    assert cleaning.trim_names(frame("` a  b` int", (1,))).columns == ["a b"]
    with pytest.raises(ValueError):
        cleaning.trim_names(frame("`a ` int, a int", (1, 2)))


def test_note_columns_exact_and_by_fragment(frame):
    df = frame("a int, `Analyst Notes` string, `old analyst_note x` string", (1, "n", "m"))
    assert cleaning.note_columns(df) == ["Analyst Notes"]
    assert cleaning.drop_notes(df).columns == ["a"]


def spread(frame):
    values = [10.0, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0, 17.0, 18.0, 19.0, 500.0, None]
    return frame("id int, v double", *enumerate(values))


def test_clip_and_drop_keep_missing_cells(frame):
    df = spread(frame)
    clipped = column(cleaning.clip_outliers(df, "v"), "v")
    assert clipped[-1] is None and clipped[-2] == 25.0 and clipped[0] == 10.0
    kept = column(cleaning.drop_outlier_rows(df, "v"), "v")
    assert kept[-1] is None and 500.0 not in kept and len(kept) == 11


def test_fences_need_more_than_ten_values(frame):
    df = spread(frame).where("id > 0")
    assert cleaning.clip_outliers(df, "v") is df


def test_fill_values(frame):
    df = frame("id int, n int, t string", (0, 1, "b"), (1, 2, None), (2, None, "a"), (3, 2, "b"))
    assert column(cleaning.fill(df, "n", "mean"), "n") == [1.0, 2.0, 1.67, 2.0]
    assert column(cleaning.fill(df, "n", "median"), "n")[2] == 2.0
    assert column(cleaning.fill(df, "n", "mode"), "n") == [1, 2, 2, 2]
    assert column(cleaning.fill(df, "n", "constant", "9"), "n")[2] == 9
    assert column(cleaning.fill(df, "n", "constant"), "n")[2] == 0
    assert column(cleaning.fill(df, "n", "constant", "oops"), "n")[2] == 2.0
    assert column(cleaning.fill(df, "t", "mode"), "t")[1] == "b"
    assert column(cleaning.fill(df, "t", "constant"), "t")[1] == "Not Specified"
    assert column(cleaning.fill(df, "n", "ffill", order_by=["id"]), "n") == [1, 2, 2, 2]
    assert column(cleaning.fill(df, "t", "bfill", order_by=["id"]), "t") == ["b", "a", "a", "b"]


def test_empty_mode_falls_back(frame):
    df = frame("id int, n int, t string", (0, None, None))
    assert column(cleaning.fill(df, "n", "mode"), "n") == [0]
    assert column(cleaning.fill(df, "t", "mode"), "t") == ["Unknown"]


def test_nan_counts_as_missing(frame):
    df = frame("id int, v double", (0, float("nan")), (1, 3.0))
    assert column(cleaning.fill(df, "v", "mean"), "v") == [3.0, 3.0]
    assert cleaning.drop_null_rows(df, "v").count() == 1


@pytest.mark.parametrize(
    "decision",
    [
        ColumnDecision("t", "fill", "mean"),
        ColumnDecision("n", "fill", "guess"),
        ColumnDecision("n", "fill", "ffill"),
        ColumnDecision("n", "explode"),
        ColumnDecision("n", convert_type="complex"),
        ColumnDecision("n", outlier_action="hide"),
    ],
)
def test_bad_plans_are_rejected_before_running(frame, decision):
    with pytest.raises(ValueError):
        run(frame("n int, t string", (1, "a")), CleaningPlan((decision,)))


def test_segments_break_at_row_removal_and_repeats():
    keep, rows_ = ColumnDecision("a"), ColumnDecision("b", "remove_rows")
    tail = ColumnDecision("c", outlier_action="remove_rows")
    names = [[d.column for d in s] for s in segments([keep, rows_, ColumnDecision("d"), tail, keep])]
    assert names == [["a"], ["b"], ["d", "c"], ["a"]]
    assert len(segments([keep, keep])) == 2


def test_statistics_follow_removed_rows(frame):
    """The mean filled into ``b`` is that of the rows that kept their ``a``."""
    df = frame("a int, b double", (1, 10.0), (2, None), (None, 100.0))
    plan = CleaningPlan((ColumnDecision("a", "remove_rows"), ColumnDecision("b", "fill", "mean")))
    assert rows(run(df, plan).df) == [(1, 10.0), (2, 10.0)]


def test_removed_column_is_still_cleaned_first(frame):
    """Outliers of a column that is dropped at the end still remove their rows."""
    values = [float(v) for v in range(10, 22)] + [900.0]
    df = frame("id int, v double", *enumerate(values))
    plan = CleaningPlan((ColumnDecision("v", "remove_column", outlier_action="remove_rows"),))
    result = run(df, plan)
    assert result.df.columns == ["id"] and result.df.count() == 12
    assert [r["action_type"] for r in result.audit.orderBy("step_number").collect()] == [
        "remove_column", "remove_outliers_rows",
    ]


def test_plan_with_audit_and_metrics(frame):
    df = frame(
        "` id ` int, `the  name` string, v double, analyst_note string",
        (1, " a ", 1.0, "x"), (1, "a", 1.0, "y"), (2, "b  c", None, "z"), (3, None, 5.0, None),
    )
    plan = CleaningPlan(
        (
            ColumnDecision("v", "fill", "mean"),
            ColumnDecision("the name", "keep", convert_type="string"),
            ColumnDecision("absent", "fill"),
        ),
        remove_duplicates=True,
        trim_spaces=True,
    )
    result = run(df, plan)
    assert rows(result.df) == [(1, "a", 1.0), (2, "b c", 3.0), (3, None, 5.0)]
    assert result.metrics == {
        "rows_before": 4, "rows_after": 3, "columns_before": 4, "columns_after": 3,
        "missing_cells_before": 3, "missing_cells_after": 1,
        "duplicates_before": 0, "duplicates_after": 0,
    }
    audit = result.audit.orderBy("step_number").collect()
    assert [(a["step_number"], a["action_type"], a["target_column"]) for a in audit] == [
        (1, "trim_spaces", "ALL_COLUMNS"), (2, "remove_duplicates", "ALL_COLUMNS"), (3, "fill", "v"),
        (4, "keep", "the name"), (5, "convert_data_type", "the name"), (6, "skipped", "absent"),
    ]
    assert audit[2]["after_metrics"] == {"missing_count": "0", "imputed_value": "3.0"}


def test_columns_without_missing_cells_are_not_logged(frame):
    plan = CleaningPlan((ColumnDecision("a", "fill", "mean"), ColumnDecision("b", "remove_rows")))
    assert run(frame("a int, b int", (1, 2)), plan).audit.count() == 0


def test_ordered_fill_in_a_plan(spark):
    df = spark.range(20).select("id", F.when(F.col("id") % 4 == 1, F.col("id")).alias("v"))
    df = df.withColumn("w", F.col("v"))
    decisions = (ColumnDecision("v", "fill", "ffill"), ColumnDecision("w", "fill", "bfill"))
    result = run(df, CleaningPlan(decisions, order_by=("id",)))
    assert column(result.df, "v")[:7] == [1, 1, 1, 1, 1, 5, 5]
    assert column(result.df, "w")[:7] == [1, 1, 5, 5, 5, 5, 9]
    assert result.audit.first()["after_metrics"]["imputed_value"] == "ffill"


def test_cleaned_tables_do_not_use_local_checkpoints():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "tablewright"
    assert not [p for p in root.rglob("*.py") if "localCheckpoint" in p.read_text()]


@pytest.mark.parametrize("text", ["1/2/2024", "25/12/2023", "2024/3/4 5:06", "2024/3/4 5:06:07", "3-4-2024", "25-3-2024 1:02", "Jan 5, 2024", "january 5, 2024", "5 MAY 2024", "5 June 2024", "5-Mar-2024"])
def test_every_layout_matches_its_own_shape(frame, text):
    """What a shape lets through is what the layouts alone would read."""
    from tablewright.functions import columns, fixed_values

    df = frame("t string", (text,))
    alone = F.coalesce(*[F.try_to_timestamp("t", F.lit(x)).cast("timestamp_ntz") for x in fixed_values.DATE_LAYOUTS])
    r = df.select(columns.to_datetime(F.col("t")).alias("a"), alone.alias("b")).first()
    assert r.a is not None and r.a == r.b


def test_profiles_of_a_quality_diff_read_written_tables(spark, plan_text, monkeypatch):
    from tablewright.plans import cleaning_plan

    df = spark.range(60).selectExpr("id", "if(id % 7 = 0, null, id * 1.5) as v", "concat('$', id % 9) as t")
    plan = cleaning_plan.CleaningPlan(
        (cleaning_plan.ColumnDecision("v", "fill", "median"), cleaning_plan.ColumnDecision("t", convert_type="integer")),
        order_by=("id",),
    )
    result = cleaning_plan.run(df, plan)
    own, read = cleaning_plan.TableProfile, []
    wanted = [own(d).scores()["overall"] for d in (result.before, result.df)]
    monkeypatch.setattr(cleaning_plan, "TableProfile", lambda d: (read.append(plan_text(d)), own(d))[1])
    assert [*result.quality_diff().first()] == wanted
    assert len(read) == 2 and all("Scan parquet" in p and "Project" not in p for p in read)
