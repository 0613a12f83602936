"""Groups, rankings, value counts and column answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import query, shaped
from catalogue.views import DIRTY, dirty, table
from tablewright.operators import answers, ordered, quantiles
from tablewright.plans import questions


def lines(spark, sf):
    return table(spark, sf, "lineitem")


def orders(spark, sf):
    return table(spark, sf, "orders")


@query(
    DIRTY
    + """SELECT event_type, round(coalesce(sum(amount), 0), 2) AS value FROM d
    WHERE event_type IS NOT NULL GROUP BY event_type"""
)
def group_sum(spark, sf):
    return shaped(answers.group(dirty(spark, sf), "event_type", "amount", "sum"), 2)


def _group_query(agg, sql_agg):
    sql = DIRTY + f"""SELECT event_type, value FROM (SELECT event_type,
        {sql_agg} AS value FROM d WHERE event_type IS NOT NULL GROUP BY event_type)
        WHERE value IS NOT NULL"""

    @query(sql, name=f"group_{agg}")
    def group_query(spark, sf):
        return shaped(answers.group(dirty(spark, sf), "event_type", "amount", agg))


for _agg, _sql in [
    ("mean", "round(avg(amount), 4)"),
    ("count", "count(amount)"),
    ("max", "round(max(amount), 4)"),
    ("min", "round(min(amount), 4)"),
    ("median", "round(median(amount), 4)"),
]:
    _group_query(_agg, _sql)


@query(
    """SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.5), 4) AS value
    FROM lineitem GROUP BY l_suppkey"""
)
def group_median_spread(spark, sf):
    """Medians by the bucketed route that serves groups of any size."""
    data = lines(spark, sf).select(
        F.col("l_suppkey").alias("k"), F.col("l_extendedprice").alias("v")
    )
    found = quantiles._spread_medians(data, "value", buffer_values=max(1, data.count() // 6))
    return shaped(found.withColumnRenamed("k", "l_suppkey"))


@query(
    """SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem
    GROUP BY l_partkey ORDER BY sum(l_extendedprice) DESC, l_partkey LIMIT 10"""
)
def group_top_n(spark, sf):
    return shaped(answers.group(lines(spark, sf), "l_partkey", "l_extendedprice", top=10), 2)


@query(
    """SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem
    GROUP BY l_partkey ORDER BY sum(l_extendedprice), l_partkey LIMIT 10"""
)
def group_bottom_n(spark, sf):
    return shaped(answers.group(lines(spark, sf), "l_partkey", "l_extendedprice", bottom=10), 2)


@query(
    DIRTY
    + """, s AS (SELECT event_type, coalesce(sum(amount), 0) AS v FROM d GROUP BY event_type)
    SELECT event_type, round(v, 2) AS value, round((SELECT sum(v) FROM s), 2) AS total,
    round(v * 100 / (SELECT sum(v) FROM s), 2) AS share_percent FROM s
    WHERE event_type IS NOT NULL ORDER BY v DESC, event_type LIMIT 1"""
)
def group_share(spark, sf):
    return shaped(answers.leader_share(dirty(spark, sf), "event_type", "amount"), 2)


_COUNTS = """SELECT event_type AS value, count(*) AS n,
    round(count(*) * 100.0 / (SELECT count(*) FROM d), 4) AS share_percent FROM d
    WHERE event_type IS NOT NULL GROUP BY event_type"""


@query(DIRTY + _COUNTS)
def value_counts(spark, sf):
    return shaped(answers.value_counts(dirty(spark, sf), "event_type"))


@query(DIRTY + _COUNTS + " ORDER BY n DESC, value LIMIT 3")
def value_counts_top(spark, sf):
    return shaped(answers.value_counts(dirty(spark, sf), "event_type", top=3))


@query(DIRTY + _COUNTS + " ORDER BY n, value DESC LIMIT 2")
def value_counts_tail(spark, sf):
    return shaped(answers.value_counts(dirty(spark, sf), "event_type", tail=2))


@query(
    """SELECT l_partkey AS value, (SELECT count(DISTINCT l_partkey) FROM lineitem) AS unique_count
    FROM lineitem GROUP BY l_partkey ORDER BY l_partkey LIMIT 50"""
)
def distinct_values(spark, sf):
    return shaped(answers.distinct_values(lines(spark, sf), "l_partkey"))


def _extreme_query(key, agg, direction):
    sql = f"""SELECT 'o_totalprice' AS "column", '{agg}' AS metric,
      round(o_totalprice, 4) AS value,
      (SELECT round(avg(o_totalprice), 2) FROM orders) AS mean_comparison,
      (SELECT round(median(o_totalprice), 4) FROM orders) AS median_comparison,
      CAST(o_orderkey AS VARCHAR) AS context_0, CAST(o_custkey AS VARCHAR) AS context_1,
      o_orderstatus AS context_2
      FROM orders ORDER BY o_totalprice {direction}, o_orderkey LIMIT 1"""

    @query(sql, name=key)
    def extreme_query(spark, sf):
        found = answers.extreme(orders(spark, sf), "o_totalprice", agg == "max", ["o_orderkey"])
        return shaped(found.withColumn("mean_comparison", F.round("mean_comparison", 2)))


_extreme_query("extreme_max", "max", "DESC")
_extreme_query("extreme_min", "min", "ASC")


@query(
    DIRTY
    + """SELECT 'amount' AS "column", round(sum(amount), 2) AS sum, count(amount) AS count FROM d"""
)
def column_total(spark, sf):
    return shaped(answers.column_total(dirty(spark, sf), "amount"), 2)


@query(
    DIRTY
    + """SELECT 'amount' AS "column", round(avg(amount), 4) AS mean,
    round(median(amount), 4) AS median, round(stddev_samp(amount), 4) AS std FROM d"""
)
def column_average(spark, sf):
    return shaped(answers.column_average(dirty(spark, sf), "amount"))


@query(DIRTY + "SELECT 'amount' AS \"column\", round(median(amount), 4) AS median FROM d")
def column_median(spark, sf):
    return shaped(answers.column_median(dirty(spark, sf), "amount"))


@query(
    DIRTY
    + """SELECT 'amount' AS "column", round(avg(amount), 4) AS mean,
    round(median(amount), 4) AS median, round(min(amount), 4) AS min, round(max(amount), 4) AS max,
    count(*) - count(amount) AS null_count FROM d"""
)
def column_summary_num(spark, sf):
    return shaped(answers.summary(dirty(spark, sf), "amount"))


@query(
    DIRTY
    + """SELECT 'event_type' AS "column", event_type AS value, count(*) AS n,
    round(count(*) * 100.0 / (SELECT count(*) FROM d), 4) AS share_percent,
    (SELECT count(DISTINCT event_type) FROM d) AS unique_values,
    (SELECT count(*) - count(event_type) FROM d) AS null_count
    FROM d WHERE event_type IS NOT NULL GROUP BY event_type ORDER BY n DESC, value LIMIT 5"""
)
def column_summary_text(spark, sf):
    return shaped(answers.summary(dirty(spark, sf), "event_type"))


_PAIR_COLUMNS = ["event_id", "user_id", "amount", "sparse_value", "whole_float"]
_PAIRS = " UNION ALL ".join(
    f"""SELECT {i} AS i, {j} AS j, '{a}' AS feature_1, '{b}' AS feature_2,
    (SELECT corr({a}, {b}) FROM d) AS r"""
    for i, a in enumerate(_PAIR_COLUMNS)
    for j, b in enumerate(_PAIR_COLUMNS)
    if i < j
)


@query(
    DIRTY
    + f"""SELECT feature_1, feature_2, round(r, 4) AS correlation FROM ({_PAIRS})
    ORDER BY abs(r) DESC, i, j LIMIT 5"""
)
def correlation_pairs(spark, sf):
    return shaped(answers.correlation_pairs(dirty(spark, sf)))


@query(
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
    FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25"""
)
def preview(spark, sf):
    return ordered.preview(orders(spark, sf), 25, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query()
def sample_rows(spark, sf):
    return ordered.sample_k(orders(spark, sf), 800, ["o_orderkey"])


@query(
    """SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer
    UNION ALL SELECT s_name, s_nationkey, s_acctbal FROM supplier"""
)
def append_rows(spark, sf):
    def named(name, prefix):
        return table(spark, sf, name).select(
            *[F.col(f"{prefix}_{c}").alias(c) for c in ("name", "nationkey", "acctbal")]
        )

    return shaped(named("customer", "c").unionByName(named("supplier", "s")))


def _ask_query(key, sql, question, source):
    @query(sql, name=key)
    def ask_query(spark, sf):
        return shaped(questions.ask(table(spark, sf, source), question), 2)


for _key, _sql, _question, _source in [
    (
        "ask_group_sum",
        """SELECT l_returnflag, round(sum(l_quantity), 2) AS value FROM lineitem
        GROUP BY l_returnflag""",
        "total l_quantity by l_returnflag",
        "lineitem",
    ),
    (
        "ask_top_n",
        """SELECT o_orderpriority, round(avg(o_totalprice), 2) AS value FROM orders
        GROUP BY o_orderpriority ORDER BY avg(o_totalprice) DESC LIMIT 3""",
        "What are the top 3 o_orderpriority by average o_totalprice?",
        "orders",
    ),
    (
        "ask_rows",
        """SELECT count(*) AS total_rows, CAST(6 AS BIGINT) AS total_columns,
        6 * count(*) AS total_cells FROM orders""",
        "How many rows are there?",
        "orders",
    ),
    (
        "ask_summary",
        """SELECT 'p_retailprice' AS "column", round(avg(p_retailprice), 2) AS mean,
        round(median(p_retailprice), 2) AS median, round(min(p_retailprice), 2) AS min,
        round(max(p_retailprice), 2) AS max, CAST(0 AS BIGINT) AS null_count FROM part""",
        "Describe p_retailprice",
        "part",
    ),
]:
    _ask_query(_key, _sql, _question, _source)
