import random

import pytest

from tablewright.operators import answers
from tablewright.plans import questions

from tests.helpers import rows


@pytest.fixture
def sales(frame):
    return frame(
        "region string, revenue double, units int, returned boolean",
        ("north", 10.0, 1, True), ("north", 30.0, 2, False), ("south", None, 3, True),
        (None, 60.0, 4, None), ("east", 5.0, None, False), ("east", 5.0, 5, True),
    )


def test_null_keys_drop_and_empty_groups_total_zero(sales):
    found = [tuple(r) for r in answers.group(sales, "region", "revenue").collect()]
    assert found == [("north", 40.0), ("east", 10.0), ("south", 0.0)]


def test_empty_groups_have_no_mean(sales):
    assert rows(answers.group(sales, "region", "revenue", "mean")) == [("east", 5.0), ("north", 20.0)]
    assert rows(answers.group(sales, "region", "revenue", "median")) == [("east", 5.0), ("north", 20.0)]


@pytest.mark.parametrize("agg", ["sum", "median"])
def test_nan_keys_drop_too(frame, agg):
    df = frame("k double, v double", (float("nan"), 1.0), (2.0, 3.0))
    assert rows(answers.group(df, "k", "v", agg)) == [(2.0, 3.0)]


def test_booleans_are_summed(sales):
    assert rows(answers.group(sales, "region", "returned"))[1] == ("north", 1.0)


def test_bottom_wins_over_top(sales):
    found = answers.group(sales, "region", "revenue", top=1, bottom=2).collect()
    assert [r["region"] for r in found] == ["south", "east"]


def test_share_counts_rows_without_key(sales):
    row = answers.leader_share(sales, "region", "revenue").first()
    assert (row["region"], row["total"]) == ("north", 110.0)
    assert row["share_percent"] == pytest.approx(40 / 110 * 100)


def test_value_counts_order_and_limits(sales):
    full = [r["value"] for r in answers.value_counts(sales, "region").collect()]
    assert full == ["east", "north", "south"]
    both = answers.value_counts(sales, "region", top=1, tail=2).collect()
    assert [r["value"] for r in both] == ["east"]
    tail = answers.value_counts(sales, "region", tail=2).collect()
    assert [r["value"] for r in tail] == ["north", "south"]


def test_distinct_values_show_and_count(spark):
    found = answers.distinct_values(spark.range(80), "id", show=3).collect()
    assert [tuple(r) for r in found] == [(0, 80), (1, 80), (2, 80)]


def test_extreme_takes_the_first_matching_row(frame):
    df = frame("id int, a string, v double", (3, "z", 9.0), (1, "x", 9.0), (2, "y", 1.0))
    row = answers.extreme(df, "v", True, ["id"]).first()
    assert (row["value"], row["context_0"], row["median_comparison"]) == (9.0, "1", 9.0)


def test_text_summary(sales):
    row = answers.summary(sales, "region").first()
    assert (row["value"], row["n"], row["unique_values"], row["null_count"]) == ("east", 2, 3, 1)


def test_missing_and_duplicates(sales):
    found = [(r["column"], r["null_count"]) for r in answers.missing_ranked(sales).collect()]
    assert found == [("region", 1), ("revenue", 1), ("units", 1), ("returned", 1)]
    assert answers.duplicate_rows(sales.unionByName(sales)).first()["duplicate_rows_count"] == 6


@pytest.mark.parametrize("answer", ["leader", "summary", "distinct"])
def test_totals_reuse_the_grouped_rows(spark, small, plan_text, answer):
    parts = spark.read.parquet(f"{small}/part.parquet")
    found = {
        "leader": lambda: answers.leader_share(parts, "p_brand", "p_size"),
        "summary": lambda: answers.text_summary(parts, "p_brand"),
        "distinct": lambda: answers.distinct_values(parts, "p_brand"),
    }[answer]()
    found.collect()
    assert "ReusedExchange" in plan_text(found).split("Initial Plan")[0]


# --- routing -------------------------------------------------------------------------------

CATALOGUE = [
    ("region", "categorical"), ("Unit_Price", "numeric"), ("order date", "datetime"),
    ("net sales total", "numeric"), ("éé", "categorical"),
]


def matched(frame, text):
    df = frame("question_id int, question string", (1, text))
    return [tuple(r)[2:4] for r in questions.match_columns(df, CATALOGUE).orderBy("rank").collect()]


def test_matching_scores(frame):
    assert matched(frame, "what about REGION?") == [("region", 106)]
    assert matched(frame, "the unit price") == [("Unit_Price", 110)]
    assert matched(frame, "the unitprice") == [("Unit_Price", 99)]
    assert matched(frame, "price per unit") == [("Unit_Price", 82)]
    assert matched(frame, "total of net things") == [("net sales total", 60)]
    assert matched(frame, "nothing here") == []


def test_names_without_ascii_letters_need_a_quote(frame):
    assert matched(frame, "show éé") == [("éé", 100)]


ROUTES = [
    ("how to fill region", "procedure", None, None),
    ("how many rows", "rows", None, None),
    ("column names please", "columns", None, None),
    ("any null in region", "missing", None, None),
    ("duplicate entries?", "duplicates", None, None),
    ("average unit price for region", "grouped", "region", "mean"),
    ("breakdown of region", "value_counts", "region", None),
    ("distinct order date", "distinct", "order date", None),
    ("worst unit price", "extreme", "Unit_Price", None),
    ("sum of unit price", "total", "Unit_Price", None),
    ("middle of unit price", "median", "Unit_Price", None),
    ("unit price", "summary", "Unit_Price", None),
    ("correlation of unit price", "summary", "Unit_Price", None),
    ("what is correlated", "correlation", None, None),
    ("weather tomorrow", "unanswerable", None, None),
]


@pytest.mark.parametrize("text,route,target,aggregation", ROUTES)
def test_routes(frame, text, route, target, aggregation):
    df = frame("question_id int, question string", (1, text))
    row = questions.routes(df, CATALOGUE).first()
    assert (row["route"], row["target"], row["aggregation"]) == (route, target, aggregation)


def test_long_catalogues_give_the_same_matches(frame, monkeypatch):
    rng = random.Random(5)
    words = ["net", "sales", "to", "of", "unit", "price", "q1", "tax", "a", "b", "é", "rate", "id"]
    names = {rng.choice([" ", "_", "-", ""]).join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(400)}
    catalogue = [(n, rng.choice(["numeric", "categorical"])) for n in sorted(names | {"éé", "??", "x", "Ünit Prices"})]
    asked = [(i, " ".join(rng.choices([*words, "What?", "NET-SALES", "éé", "taxes", "unitprice"], k=rng.randint(0, 7)))) for i in range(300)]
    asked += [(7, asked[7][1]), (8, "other text"), (None, "net sales"), (400, None), (401, "??"), (402, "")]
    df = frame("key int, question string", *asked)
    found = {}
    for most in (0, 10_000):
        monkeypatch.setattr(questions, "EXPRESSION_COLUMNS", most)
        found[most] = [
            sorted(map(str, f(df, catalogue, "key").collect())) for f in (questions.match_columns, questions.routes)
        ]
    assert found[0] == found[10_000] and len(found[0][1]) == len(asked)


def test_thousands_of_columns(frame):
    catalogue = [(f"metric {k} of region {k % 97}", "numeric") for k in range(5000)]
    df = frame("question_id int, question string", (1, "show metric 4321 of region 53 now"))
    best = questions.match_columns(df, catalogue).where("rank = 1").first()
    assert (best["column"], best["score"]) == (catalogue[4321][0], 100 + len(catalogue[4321][0]))


def test_limits_are_read_from_the_question(frame):
    df = frame("question_id int, question string", (1, "top 5 region by unit price, last 3"))
    row = questions.routes(df, CATALOGUE).first()
    assert (row["top_n"], row["bottom_n"]) == (5, 3)


def test_ask(sales, spark):
    best = questions.ask(sales, "total revenue by region").first()
    assert (best["region"], best["value"]) == ("north", 40.0)
    assert questions.ask(sales, "maximum units").first()["value"] == 5.0
    assert questions.ask(sales, "who won?").first()["route"] == "unanswerable"
    assert questions.ask(sales.limit(0), "total revenue").first()["total_rows"] == 0


def test_questions_are_scored_without_a_shuffle(spark, small, plan_text):
    asked = spark.read.parquet(f"{small}/conversations.parquet").selectExpr(
        "conv_id as question_id", "text as question"
    )
    text = plan_text(questions.routes(asked, CATALOGUE))
    assert "Exchange" not in text and "Join" not in text
