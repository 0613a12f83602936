import math
import random

import numpy as np
import pandas as pd
import pytest

from catalogue.views import dirty
from tablewright.operators import answers, correlation, frequencies
from tablewright.plans import detect
from tablewright.plans.profile import TableProfile

from tests.helpers import rows


def test_duplicates_treat_nulls_as_equal(frame):
    df = frame(
        "a int, b string", (1, None), (1, None), (1, None), (2, "x"), (2, "y"), (None, None)
    )
    assert frequencies.duplicate_count(df) == 2
    assert frequencies.drop_duplicates(df).count() == 4


def test_duplicates_compare_nulls_inside_arrays_and_structs(frame):
    schema = "a array<int>, b array<int>, s struct<x:int,y:int>, n array<struct<x:int,v:array<string>>>"
    different = [
        ([1, None], None, None, None), ([None, 1], None, None, None), ([1], None, None, None), (None, [1], None, None), ([], [1], None, None),
        ([1], [2, 3], None, None), ([1, 2], [3], None, None), (None, None, (None, 1), None), (None, None, (1, None), None), (None, None, (None, None), None),
        (None, None, None, None), (None, None, None, []), (None, None, None, [None]), (None, None, None, [(None, None)]), (None, None, None, [(None, [])]),
        (None, None, None, [(None, [None])]), (None, None, None, [(1, ["a"]), (2, ["b"])]), (None, None, None, [(1, ["a", None]), (2, ["b"])]),
        (None, None, None, [(1, ["a"]), (2, [None, "b"])]),
    ]
    df = frame(schema, *different, *different[:7], different[-1])
    assert frequencies.duplicate_count(df) == df.count() - df.distinct().count() == 8
    assert frequencies.drop_duplicates(df).count() == len(different)


def test_no_duplicates_need_no_second_pass(spark):
    assert frequencies.duplicate_count(spark.range(100)) == 0


def test_single_value_has_zero_std(frame):
    profile = TableProfile(frame("v double, w double", (3.0, None), (None, None)))
    assert rows(profile.numeric_stats()) == [("v", 3.0, 3.0, 3.0, 0.0)]


def test_statistics_equal_pandas(spark):
    rng = random.Random(2)
    data = pd.DataFrame(
        {"a": [rng.gauss(0, 1) ** 3 for _ in range(500)], "b": [rng.random() for _ in range(500)]}
    )
    data.loc[::7, "a"] = math.nan
    profile = TableProfile(spark.createDataFrame(data))
    stats = {c["column"]: c for c in profile.columns}
    assert stats["a"]["variance"] == pytest.approx(data["a"].var())
    assert stats["a"]["null_count"] == data["a"].isna().sum()
    assert profile.skews["a"] == pytest.approx(data["a"].skew())
    assert profile.correlations["a", "b"] == pytest.approx(data["a"].corr(data["b"]))


def test_constant_column_has_no_skew_and_no_correlation(frame):
    df = frame("c double, v double", *[(0.1, float(i)) for i in range(12)])
    profile = TableProfile(df)
    assert profile.skews["c"] == 0.0
    assert profile.correlations["c", "c"] == 0.0 and profile.correlations["c", "v"] == 0.0
    assert profile.correlations["v", "v"] == pytest.approx(1.0)


def test_column_constant_on_the_common_rows(frame):
    table = [(7.0, float(i), None) for i in range(5)] + [(float(i), None, float(i)) for i in range(5)]
    df = frame("x double, y double, z double", *table)
    found = correlation.coefficients(df, ["x", "y", "z"])
    assert found["x", "y"] == 0.0
    assert found["x", "z"] == pytest.approx(1.0)
    assert found["y", "z"] == 0.0


@pytest.mark.parametrize("shift", [0.0, 1e9])
def test_both_correlation_routes_agree(spark, shift, monkeypatch):
    rng = random.Random(4)
    data = pd.DataFrame({f"c{i}": [shift + rng.gauss(0, 1) for _ in range(300)] for i in range(4)})
    data["c3"] = data["c0"] * 2 + data["c1"]
    df = spark.createDataFrame(data)
    expected = data.corr()
    for narrow in (12, 0):
        monkeypatch.setattr(correlation, "NARROW", narrow)
        found = correlation.coefficients(df, list(data.columns))
        for (a, b), r in found.items():
            assert r == pytest.approx(expected.loc[a, b], abs=1e-6)


def test_negative_values_and_severity(frame):
    df = frame("unit_price double, other double", *[(-1.0, -1.0)] * 5, (2.0, 3.0))
    assert rows(TableProfile(df).inconsistencies().select("column", "affected_count", "severity")) == [
        ("unit_price", 5, "medium")
    ]


def test_missing_issue_starts_at_half(frame):
    df = frame("a int, b int", (1, None), (None, 2), (3, 3), (None, 4))
    found = TableProfile(df).inconsistencies().select("column", "severity", "description")
    assert rows(found) == [("a", "high", "Column 'a' is missing 50.0% of entries (2/4).")]


def test_constant_text_is_confirmed_by_value(frame):
    df = frame("t string, u string", ("a", "x"), ("a", "y"), (None, None))
    found = TableProfile(df).inconsistencies().select("column", "issue_type", "affected_count")
    assert rows(found) == [("t", "Zero Variance / Constant Column", 3)]


def test_whitespace_in_values_and_names(frame):
    df = frame("`a  b` string, c string", (" x", "ok"), ("y  z", "o k"), (None, "t "))
    assert rows(TableProfile(df).whitespace()) == [("a  b", True, 2), ("c", False, 1)]
    totals = TableProfile(df).whitespace_totals().first()
    assert totals["total_irregular_occurrences"] == 4 and totals["has_issues"]


def test_scores_of_a_clean_table(frame):
    df = frame("a int, b string", (1, "x"), (2, "y"), (3, "z"))
    assert TableProfile(df).scores() == {
        "overall": 100.0,
        "completeness": 100.0,
        "uniqueness": 100.0,
        "consistency": 100.0,
        "validity": 100.0,
    }


def test_scores_of_an_empty_table(frame):
    scores = TableProfile(frame("a int, b string")).scores()
    assert scores["completeness"] == 100.0 and scores["uniqueness"] == 100.0


def test_unique_counts_ignore_negative_zero(frame):
    df = frame("v double, t string", (0.0, "a"), (-0.0, None), (1.5, "a"))
    found = frequencies.distinct_counts(df, ["v", "t"])
    assert {r["column"]: r["unique_count"] for r in found.collect()} == {"v": 2, "t": 1}


def test_modes_of_all_columns_at_once(frame):
    nan = float("nan")
    df = frame(
        "a int, b string, c double, d boolean, e string, f int",
        (10, "x", 2.5, True, None, 3), (9, "X", -0.0, False, None, 2), (9, "x", 0.0, None, None, 3), (10, "X", nan, True, None, 2),
        (None, None, nan, None, None, 2),
    )
    found = frequencies.modes(df, df.columns)
    assert found == {c: frequencies.mode(df, c) for c in df.columns}
    assert found == {"a": 9, "b": "X", "c": 0.0, "d": True, "e": None, "f": 2}
    assert frequencies.modes(df, []) == {} and frequencies.modes(df.limit(0), ["a"]) == {"a": None}


def test_mode_takes_the_smallest_on_ties(frame):
    assert frequencies.mode(frame("v int", (10,), (9,), (9,), (10,), (None,)), "v") == 9


def test_booleans_are_not_numeric_in_profiles(frame):
    df = frame("b boolean, n int", (True, 1), (False, 2))
    profile = TableProfile(df)
    assert [c["column"] for c in profile.numeric] == ["n"]
    assert {r["class"] for r in answers.columns_by_class(df).collect()} == {"numeric"}


def test_type_detection_order(frame):
    table = [
        (i, "yes" if i % 2 else "no", str(i), f"${i}.5", "2024-01-15" if i % 2 else "05/12/2023", "ab")
        for i in range(60)
    ]
    df = frame("id int, b string, i string, d string, t string, x string", *table)
    found = detect.type_issues(TableProfile(df, ["id"]))
    assert rows(found.select("column", "suggested_type", "confidence")) == [
        ("b", "boolean", 0.95),
        ("d", "decimal", 1.0),
        ("i", "integer", 1.0),
        ("t", "datetime", 1.0),
    ]


def test_whole_floats_are_flagged_and_sparse_columns_sampled(frame):
    table = [(i, float(i), None if i < 500 else str(i)) for i in range(560)]
    df = frame("id int, f double, late string", *table)
    profile = TableProfile(df, ["id"])
    found = {r["column"]: r["suggested_type"] for r in detect.type_issues(profile).collect()}
    assert found == {"f": "integer", "late": "integer"}
    samples = {r["column"]: r["sample_values"] for r in detect.sample_values(profile).collect()}
    assert samples["late"] == ["500", "501", "502", "503", "504"]


def test_infinite_values_are_not_whole_numbers(frame):
    df = frame("v double", (1.0,), (2.0,), (3.0,), (float("inf"),))
    assert not TableProfile(df).columns[0]["whole_numbers"]


def test_estimates_instead_of_exact_statistics(spark):
    profile = TableProfile(spark.range(1000), exact=False)
    assert profile.fence_values["id"]["q1"] == pytest.approx(249.75, abs=2)
    assert profile.unique_counts["id"] == pytest.approx(1000, rel=0.1)


def test_outlier_samples_are_limited_before_the_shuffle(spark, small, plan_text):
    profile = TableProfile(dirty(spark, small), ["event_id"])
    assert "WindowGroupLimit" in plan_text(profile.outlier_samples())


def test_frequencies_are_counted_before_the_shuffle(spark, small, plan_text):
    text = plan_text(frequencies.frequencies(dirty(spark, small), ["event_type", "amount"]))
    assert text.count("HashAggregate") == 2 and text.count("Exchange") == 1


def test_statistics_read_only_their_columns(spark, small, plan_text):
    from catalogue.views import table

    lines = table(spark, small, "lineitem")
    text = plan_text(answers.group(lines, "l_returnflag", "l_quantity"))
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in text


def wide_frame(spark, columns, rows=300):
    rng = np.random.default_rng(9)
    data = pd.DataFrame(rng.normal(size=(rows, columns)), columns=[f"c{i}" for i in range(columns)])
    data["c1"] = data["c0"] * 3 + rng.normal(size=rows) / 10
    data["c2"] = 7.0
    data["c3"] = 1e9 + data["c4"]
    data.loc[rng.random(rows) < 0.3, "c5"] = np.nan
    data.loc[1:, "c6"] = np.nan
    return data, spark.createDataFrame(data.astype(object).where(data.notna(), None), ", ".join(f"c{i} double" for i in range(columns)))


def test_tiles_give_the_matrix(spark):
    data, df = wide_frame(spark, 11)
    names = list(data.columns)
    for block in (3, 4, 100):
        rows = correlation.tiled(df, names, block=block).collect()
        assert len({(r.index_a, r.index_b) for r in rows}) == len(rows) == 66
        for r in rows:
            truth = 0.0 if {r.column_a, r.column_b} & {"c2", "c6"} else data[r.column_a].corr(data[r.column_b])
            assert r.r == pytest.approx(truth, abs=1e-6), (r.column_a, r.column_b)
    empty = correlation.tiled(df.limit(0), names).collect()
    assert len(empty) == 66 and all(r.r == 0.0 for r in empty)


def test_wide_tables_take_the_tiled_route(spark, monkeypatch):
    data, df = wide_frame(spark, 11)
    plain = TableProfile(df)
    narrow = sorted(map(tuple, plain.correlation_matrix().collect()))
    partners = plain.partners
    ranked = [tuple(r)[:4] for r in correlation.ranked_pairs(df, list(data.columns)).collect()]
    monkeypatch.setattr(correlation, "WIDE", 4)
    wide = TableProfile(df)
    assert sorted(map(tuple, wide.correlation_matrix().collect())) == narrow
    assert wide.partners == partners
    assert [tuple(r)[:4] for r in correlation.ranked_pairs(df, list(data.columns)).collect()] == ranked
    assert wide.correlations == pytest.approx(plain.correlations, abs=1e-9)


def test_six_hundred_columns(spark):
    data, df = wide_frame(spark, 600, rows=40)
    found = correlation.ranked_pairs(df, list(data.columns), top=2).collect()
    truth = data.drop(columns=["c2", "c6"]).corr()
    assert {(r.column_a, r.column_b) for r in found} == {("c0", "c1"), ("c3", "c4")}
    assert all(r.r == pytest.approx(truth.loc[r.column_a, r.column_b], abs=1e-6) for r in found)
