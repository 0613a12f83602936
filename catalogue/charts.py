"""Chart data."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import query, shaped
from catalogue.views import DIRTY, dirty, table
from tablewright.plans import charts
from tablewright.plans.charts import ChartRequest


def lines(spark, sf):
    return table(spark, sf, "lineitem")


def orders(spark, sf):
    return table(spark, sf, "orders")


ORDER = ["o_orderdate", "o_orderkey"]
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


# --- column choice -------------------------------------------------------------------

_LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]


@query(
    "SELECT column_name FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS column_name, var_samp({c}) AS v, count(DISTINCT {c}) AS n FROM lineitem"
        for i, c in enumerate(_LINE_NUMBERS)
    )
    + ") WHERE n > 1 ORDER BY v DESC, i LIMIT 6"
)
def pick_numeric(spark, sf):
    names = charts.ColumnFacts(lines(spark, sf)).pick_numeric(6)
    return _names(spark, names)


_TEXTS = ["event_type", "label_text", "flag_text", "int_text", "money_text", "date_text", "constant_text"]


@query(
    DIRTY
    + "SELECT column_name FROM ("
    + " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS column_name, count(DISTINCT {c}) AS n FROM d"
        for i, c in enumerate(_TEXTS)
    )
    + ") WHERE n BETWEEN 2 AND 30 ORDER BY abs(n - 10), i LIMIT 1"
)
def pick_category(spark, sf):
    return _names(spark, [charts.ColumnFacts(dirty(spark, sf)).pick_category()])


@query()
def pick_time(spark, sf):
    return _names(spark, [charts.pick_time(orders(spark, sf))])


def _names(spark, names):
    from tablewright.functions.columns import small_frame

    return small_frame(spark, [(n,) for n in names], "column_name string")


# --- recommended charts -----------------------------------------------------------------

_PRIORITY = """SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS value
    FROM orders GROUP BY o_orderpriority"""


@query(_PRIORITY + " ORDER BY value DESC, label LIMIT 15")
def chart_bar(spark, sf):
    return charts.bar(orders(spark, sf), "o_orderpriority", "o_totalprice")


@query(
    f"""WITH p AS ({_PRIORITY} ORDER BY value DESC, label LIMIT 10)
    SELECT label, value, round(value / (SELECT sum(value) FROM p) * 100, 2) AS share_percent FROM p"""
)
def chart_pie(spark, sf):
    return charts.pie(orders(spark, sf), "o_orderpriority", "o_totalprice")


@query(
    """SELECT p_brand AS label, count(*) AS value FROM part GROUP BY p_brand
    ORDER BY count(*) DESC, p_brand LIMIT 15"""
)
def chart_frequency(spark, sf):
    return shaped(charts.frequency(table(spark, sf, "part"), "p_brand"))


def _histogram_sql(column, source, prefix=""):
    return f"""{prefix or 'WITH'} x AS (SELECT {column} AS v FROM {source} WHERE {column} IS NOT NULL),
    s AS (SELECT min(v) AS low, max(v) AS high,
      least(30, greatest(10, count(DISTINCT v) // 3)) AS bins FROM x),
    w AS (SELECT low, bins, (high - low) / bins AS width FROM s),
    c AS (SELECT least(CAST(floor((v - low) / width) AS BIGINT), bins - 1) AS bin, count(*) AS n
      FROM x, w GROUP BY 1),
    b AS (SELECT unnest(range(0, bins)) AS bin, low, width FROM w)
    SELECT b.bin, round(low + width * b.bin, 4) AS bin_start, round(low + width * (b.bin + 1), 4)
      AS bin_end, coalesce(n, 0) AS n FROM b LEFT JOIN c ON b.bin = c.bin"""


@query(_histogram_sql("value", "events"))
def chart_histogram(spark, sf):
    return shaped(charts.histogram(table(spark, sf, "events"), "value"))


@query(_histogram_sql("amount", "d", DIRTY + ","))
def custom_histogram(spark, sf):
    request = ChartRequest("histogram", x_column="amount")
    return shaped(charts.custom(dirty(spark, sf), request, ["event_id"]))


@query(_histogram_sql("l_quantity", "lineitem"))
def custom_histogram_few_values(spark, sf):
    request = ChartRequest("histogram", x_column="l_quantity")
    return shaped(charts.custom(lines(spark, sf), request, LINE_KEY))


def _box_sql(columns, source):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", n, round(low, 6) AS min, round(q1, 6) AS q1,
        round(q2, 6) AS median, round(q3, 6) AS q3, round(high, 6) AS max,
        round(q1 - 1.5 * (q3 - q1), 6) AS lower_fence, round(q3 + 1.5 * (q3 - q1), 6) AS upper_fence,
        (SELECT count(*) FROM {source} WHERE {c} < q1 - 1.5 * (q3 - q1)
          OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count
        FROM (SELECT count({c}) AS n, CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high,
          quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2, quantile_cont({c}, 0.75) AS q3
          FROM {source})"""
        for c in columns
    )


@query(DIRTY + _box_sql(["amount", "sparse_value", "user_id"], "d"))
def chart_box(spark, sf):
    return shaped(charts.box(dirty(spark, sf), ["amount", "sparse_value", "user_id"]), 6)


@query(_box_sql(["l_extendedprice"], "lineitem"))
def custom_box(spark, sf):
    return shaped(
        charts.custom(lines(spark, sf), ChartRequest("box", y_column="l_extendedprice"), LINE_KEY), 6
    )


_HEAT = ["event_id", "user_id", "amount", "sparse_value", "whole_float"]


def _heat_sql(columns, source):
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS column_a, '{b}' AS column_b,
        (SELECT pyround(CASE WHEN corr({a}, {b}) IS NULL OR isnan(corr({a}, {b})) THEN 0
          ELSE corr({a}, {b}) END, 2) FROM {source}) AS r"""
        for a in columns
        for b in columns
    )


@query(
    DIRTY
    + f""", h AS ({_heat_sql(_HEAT, 'd')})
    SELECT * FROM h WHERE (SELECT max(abs(r)) FROM h WHERE column_a <> column_b) >= 0.2"""
)
def chart_heatmap(spark, sf):
    return charts.heatmap(dirty(spark, sf), _HEAT)


@query(_heat_sql(["c_custkey", "c_nationkey", "c_acctbal"], "customer"))
def custom_heatmap(spark, sf):
    return charts.custom(table(spark, sf, "customer"), ChartRequest("heatmap"), ["c_custkey"])


@query(
    """WITH m AS (SELECT last_day(o_orderdate) AS month, sum(o_totalprice) AS v FROM orders
      WHERE o_totalprice IS NOT NULL GROUP BY 1),
    c AS (SELECT last_day(t) AS month FROM (SELECT unnest(generate_series(
      CAST(date_trunc('month', min(month)) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP),
      INTERVAL 1 MONTH)) AS t FROM m))
    SELECT strftime(c.month, '%Y-%m-%d') AS time, round(coalesce(v, 0), 2) AS value
    FROM c LEFT JOIN m ON c.month = m.month"""
)
def chart_line(spark, sf):
    found = charts.line(orders(spark, sf), "o_orderdate", "o_totalprice")
    return found.withColumn("time", F.date_format("time", "yyyy-MM-dd"))


@query()
def chart_scatter(spark, sf):
    return charts.scatter(
        dirty(spark, sf), "amount", "user_id", ["event_id"], color="event_type"
    )


@query()
def custom_scatter(spark, sf):
    request = ChartRequest("scatter", "l_quantity", "l_extendedprice", "l_returnflag")
    return charts.custom(lines(spark, sf), request, LINE_KEY)


@query()
def recommend_charts(spark, sf):
    """One row per recommended chart with its number of marks."""
    from tablewright.functions.columns import small_frame

    found = charts.recommend(orders(spark, sf), ["o_orderkey"])
    rows = [(i + 1, c.id, c.type, c.title, c.data.count()) for i, c in enumerate(found)]
    return small_frame(
        spark, rows, "position int, id string, type string, title string, marks bigint"
    )


# --- custom charts ----------------------------------------------------------------------


def _custom_bar_query(agg, sql_agg):
    sql = f"""SELECT p_type AS x, round({sql_agg}, 2) AS y FROM part GROUP BY p_type
        ORDER BY {sql_agg} DESC, p_type LIMIT 20"""

    @query(sql, name="custom_bar" if agg == "sum" else f"custom_bar_{agg}")
    def custom_bar_query(spark, sf):
        request = ChartRequest("bar", "p_type", "p_retailprice", aggregation=agg)
        return charts.custom(table(spark, sf, "part"), request, ["p_partkey"])


for _agg, _sql in [
    ("sum", "sum(p_retailprice)"),
    ("mean", "avg(p_retailprice)"),
    ("count", "CAST(count(p_retailprice) AS DOUBLE)"),
    ("median", "median(p_retailprice)"),
]:
    _custom_bar_query(_agg, _sql)


@query(
    """SELECT p_brand AS x, CAST(count(*) AS DOUBLE) AS y FROM part GROUP BY p_brand
    ORDER BY count(*) DESC, p_brand LIMIT 20"""
)
def custom_bar_counts(spark, sf):
    return charts.custom(table(spark, sf, "part"), ChartRequest("bar", "p_brand"), ["p_partkey"])


@query(
    """SELECT o_orderstatus AS x, o_orderpriority AS color, round(sum(o_totalprice), 2) AS y
    FROM orders GROUP BY 1, 2 ORDER BY sum(o_totalprice) DESC LIMIT 20"""
)
def custom_bar_color(spark, sf):
    request = ChartRequest("bar", "o_orderstatus", "o_totalprice", "o_orderpriority", "sum")
    return charts.custom(orders(spark, sf), request, ORDER)


@query(
    """SELECT o_orderstatus AS x, round(o_totalprice, 4) AS y FROM orders
    WHERE o_totalprice IS NOT NULL"""
)
def custom_bar_raw(spark, sf):
    request = ChartRequest("bar", "o_orderstatus", "o_totalprice")
    return shaped(charts.custom(orders(spark, sf), request, ORDER))


_SERIES = """SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position,
    CAST(o_orderkey AS VARCHAR) AS x, round(o_totalprice, 4) AS y FROM orders
"""


def _series_query(kind):
    @query(_SERIES, name=f"custom_{kind}")
    def series_query(spark, sf):
        request = ChartRequest(kind, "o_orderkey", "o_totalprice")
        return shaped(charts.custom(orders(spark, sf), request, ORDER))


for _kind in ("line", "area"):
    _series_query(_kind)


_SHAPE = 800


def _shape_query(kind):
    @query(
        f"""WITH s AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1
      AS position, CAST(l_orderkey AS VARCHAR) AS x, l_extendedprice AS y FROM lineitem
      WHERE l_orderkey IS NOT NULL AND l_extendedprice IS NOT NULL),
    c AS (SELECT *, CASE WHEN (SELECT count(*) FROM s) <= {_SHAPE} THEN position
      ELSE position * {_SHAPE // 4} // (SELECT count(*) FROM s) END AS col FROM s),
    r AS (SELECT *, min(position) OVER w AS first_one, max(position) OVER w AS last_one,
      row_number() OVER (PARTITION BY col ORDER BY y, position) AS from_low,
      row_number() OVER (PARTITION BY col ORDER BY y DESC, position) AS from_high
      FROM c WINDOW w AS (PARTITION BY col))
    SELECT position, x, round(y, 4) AS y FROM r
    WHERE position IN (first_one, last_one) OR from_low = 1 OR from_high = 1""",
        name=f"custom_{kind}_shape",
    )
    def shape_query(spark, sf):
        request = ChartRequest(kind, "l_orderkey", "l_extendedprice", shape_points=_SHAPE)
        return shaped(charts.custom(lines(spark, sf), request, LINE_KEY))


for _kind in ("line", "area"):
    _shape_query(_kind)


@query(
    """SELECT c_mktsegment AS label, round(sum(c_acctbal), 2) AS value FROM customer
    GROUP BY c_mktsegment ORDER BY sum(c_acctbal) DESC LIMIT 10"""
)
def custom_pie(spark, sf):
    request = ChartRequest("pie", "c_mktsegment", "c_acctbal")
    return shaped(charts.custom(table(spark, sf, "customer"), request, ["c_custkey"]), 2)


@query(
    """SELECT c_mktsegment AS label, CAST(count(*) AS DOUBLE) AS value FROM customer
    GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 10"""
)
def custom_pie_counts(spark, sf):
    request = ChartRequest("pie", "c_mktsegment")
    return charts.custom(table(spark, sf, "customer"), request, ["c_custkey"])
