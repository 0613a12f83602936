import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.operators import ordered


def gappy(n=400):
    rng = random.Random(5)
    values = [None if rng.random() < 0.7 else float(i) for i in range(n)]
    values[:30] = [None] * 30
    values[100:220] = [None] * 120  # covers whole buckets
    values[-25:] = [None] * 25
    return values


@pytest.mark.parametrize("rows_per_bucket", [1_000_000, 37])
def test_fills_equal_pandas(spark, rows_per_bucket):
    values = gappy()
    rows = list(enumerate(values))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "id bigint, v double").repartition(5)
    series = pd.Series(values, dtype="float64")
    forward = ordered.fill_forward(df, ["v"], ["id"], rows_per_bucket).orderBy("id").toPandas()
    backward = ordered.fill_backward(df, ["v"], ["id"], rows_per_bucket).orderBy("id").toPandas()
    assert forward["v"].tolist() == series.ffill().bfill().tolist()
    assert backward["v"].tolist() == series.bfill().ffill().tolist()


@pytest.mark.parametrize("kind", ["string", "timestamp", "two columns"])
def test_fill_by_other_keys(spark, kind):
    values = gappy(200)
    if kind == "string":
        rows = [(f"ACCT-{i:05d}", v) for i, v in enumerate(values)]
        df, keys = spark.createDataFrame(rows, "k string, v double"), ["k"]
    elif kind == "timestamp":
        start = datetime(2024, 1, 1)
        rows = [(start + timedelta(minutes=i), v) for i, v in enumerate(values)]
        df, keys = spark.createDataFrame(rows, "k timestamp_ntz, v double"), ["k"]
    else:
        rows = [(f"file{i // 50}", i % 50, v) for i, v in enumerate(values)]
        df, keys = spark.createDataFrame(rows, "f string, line int, v double"), ["f", "line"]
    found = ordered.fill_forward(df, ["v"], keys, 23).orderBy(*keys).toPandas()["v"]
    assert found.tolist() == pd.Series(values, dtype="float64").ffill().bfill().tolist()


def test_fill_of_a_column_without_values(frame):
    df = frame("id int, v string", (1, None), (2, None))
    assert [r["v"] for r in ordered.fill_forward(df, ["v"], ["id"]).collect()] == [None, None]


def test_no_window_over_the_whole_table(spark, plan_text):
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, id, null) as v")
    text = plan_text(ordered.fill_forward(df, ["v"], ["id"], 100))
    assert "Window" in text and "SinglePartition" not in text


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(5000)
    first = {r["id"] for r in ordered.sample_k(df, 800, ["id"]).collect()}
    again = {r["id"] for r in ordered.sample_k(df.repartition(7), 800, ["id"]).collect()}
    assert len(first) == 800 and first == again
    assert ordered.sample_k(df.limit(10), 800, ["id"]).count() == 10


def test_preview_is_a_distributed_top_k(spark, plan_text):
    assert "TakeOrderedAndProject" in plan_text(ordered.preview(spark.range(100), 5, ["id"]))


@pytest.mark.parametrize("direct_rows", [10, 1_000_000])
def test_first_rows_of_a_narrowed_table(spark, direct_rows):
    df = spark.range(20_000).selectExpr("if(id % 50 = 0, null, id * 7919 % 20011) as k", "id")
    keys = [F.col("k"), F.col("id")]
    found = [tuple(r) for r in ordered.first_rows(df, 450, keys, direct_rows).collect()]
    expected = sorted(
        ((None if i % 50 == 0 else i * 7919 % 20011, i) for i in range(20_000)),
        key=lambda t: (t[0] is not None, t[0] or 0, t[1]),
    )
    assert found == expected[:450]


def test_first_rows_with_a_hot_first_key(spark):
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 0, id) as k", "id")
    found = ordered.first_rows(df, 5, [F.col("k"), F.col("id")], direct_rows=10).collect()
    assert [r["id"] for r in found] == [0, 3, 6, 9, 12]


def test_a_key_held_by_many_rows_is_many_buckets(spark):
    df = spark.range(3000).selectExpr("if(id < 1200, 7, id) as k", "id", "if(id % 3 = 0, id, null) as v")
    bucketed = ordered.with_bucket(df, ["k"], 100)
    sizes = [r["n"] for r in bucketed.groupBy("bucket").agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 400 and len(sizes) > 15
    hot = bucketed.where("k = 7").select("bucket").distinct().count()
    assert hot >= 6
    # Ranges follow the order of keys, then ties.
    last, first = F.max(F.struct("k", ordered.TIE)), F.min(F.struct("k", ordered.TIE))
    ends = bucketed.groupBy("bucket").agg(first.alias("a"), last.alias("b")).orderBy("bucket").collect()
    assert all(tuple(x["b"]) < tuple(y["a"]) for x, y in zip(ends, ends[1:]))
    numbered = ordered.numbered(df, ["k"], 100).orderBy("__position").collect()
    assert [r["__position"] for r in numbered] == list(range(3000))
    assert [r["k"] for r in numbered] == sorted(r["k"] for r in numbered)
    one = ordered.fill_forward(df, ["v"], ["k"], 1_000_000).orderBy("id").collect()
    assert ordered.fill_forward(df, ["v"], ["k"], 100).orderBy("id").collect() == one


def test_many_null_keys_are_many_buckets(spark):
    df = spark.range(1500).selectExpr("if(id < 700, null, id) as k", "id", "cast(id as string) as v")
    bucketed = ordered.with_bucket(df, ["k"], 100)
    assert bucketed.where("k is null").select("bucket").distinct().count() >= 4
    assert [r["k"] for r in ordered.numbered(df, ["k"], 100).orderBy("__position").collect()][:700] == [None] * 700


def test_positions_are_sorted_once_and_shapes_need_no_sort(spark, plan_text):
    from tablewright.plans import charts

    df = spark.range(1000).selectExpr("id * 7 % 1000 as k", "concat('t', id) as t", "cast(id as double) as v")
    numbered = ordered.numbered(df, ["k"], 90)
    assert "Window" not in plan_text(numbered) and "Sort" not in plan_text(numbered)
    series = numbered.selectExpr("__position as position", "t as x", "if(k < 300, null, v % 50) as y")
    shape = charts.keep_shape(series, 40)
    assert "SortAggregate" not in plan_text(shape)
    found, points = shape.collect(), series.orderBy("position").collect()
    want = set()
    for c in range(10):
        own = points[100 * c : 100 * c + 100]
        known = [p for p in own if p["y"] is not None]
        want |= {own[0], own[-1]}
        want |= {min(known, key=lambda p: p["y"]), max(known, key=lambda p: p["y"])} if known else set()
    assert len(found) == len(want) and set(found) == want
