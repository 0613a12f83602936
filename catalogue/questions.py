"""Question routing over every conversation turn."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import query, shaped
from catalogue.views import table
from tablewright.functions import fixed_values as V
from tablewright.plans import questions

# A question in front of each turn's own text, so that every route is taken.
_TEMPLATES = [
    "What is the total l_quantity by l_returnflag?",
    "top 5 l_linestatus by average l extendedprice",
    "How many rows are there in the table?",
    "maximum l_tax please",
    "What is the median of L_DISCOUNT",
    "distinct l_shipmode or l_linestatus",
    "Is anything missing?",
    "how to clean l_tax",
    "the ship date",
    "which numbers are correlated",
    "",
]
_QUESTION = (
    "concat(CASE (conv_id + turn) % 11 "
    + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEMPLATES))
    + " END, ' ', text)"
)
_ID = "concat(conv_id, '/', turn)"
_KINDS = {
    "l_orderkey": "numeric", "l_partkey": "numeric", "l_suppkey": "numeric",
    "l_linenumber": "numeric", "l_quantity": "numeric", "l_extendedprice": "numeric",
    "l_discount": "numeric", "l_tax": "numeric", "l_returnflag": "categorical",
    "l_linestatus": "categorical", "l_shipdate": "datetime",
}


def _asked(spark, sf):
    return table(spark, sf, "conversations").selectExpr(
        f"{_ID} AS question_id", f"{_QUESTION} AS question"
    )


def _catalogue(spark, sf):
    return questions.catalogue_of(table(spark, sf, "lineitem"))


_MATCHES = f"""q AS (SELECT {_ID} AS question_id, {_QUESTION} AS question FROM conversations),
  t AS (SELECT question_id, lower(question) AS said,
    regexp_replace(lower(question), '[^a-z0-9]', '', 'g') AS joined,
    regexp_extract_all(lower(question), '[a-z0-9]+') AS tokens FROM q),
  c AS (SELECT *, regexp_replace(spaced, ' ', '', 'g') AS packed,
    list_distinct(list_filter(string_split(spaced, ' '), lambda x: x <> '')) AS parts FROM
    (SELECT i, name, kind, trim(regexp_replace(lower(name), '[^a-z0-9]', ' ', 'g')) AS spaced
      FROM (VALUES {", ".join(f"({i}, '{n}', '{k}')" for i, (n, k) in enumerate(_KINDS.items()))})
        AS v(i, name, kind))),
  s AS (SELECT question_id, i, name, kind, CASE
    WHEN contains(said, lower(name)) OR contains(said, spaced) THEN 100 + length(spaced)
    WHEN contains(joined, packed) THEN 90 + length(packed)
    WHEN len(list_intersect(parts, tokens)) = len(parts) THEN 80 + len(parts)
    WHEN len(list_filter(list_intersect(parts, tokens), lambda x: length(x) > 2)) > 0
      THEN 40 + 10 * len(list_filter(list_intersect(parts, tokens), lambda x: length(x) > 2))
    ELSE 0 END AS score FROM t, c),
  m AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, i) AS rank
    FROM s WHERE score > 0)"""


@query(
    f"""WITH {_MATCHES} SELECT question_id, rank, name AS "column", CAST(score AS BIGINT) AS score, kind
    FROM m"""
)
def match_columns(spark, sf):
    return shaped(questions.match_columns(_asked(spark, sf), _catalogue(spark, sf)))


# Columns of a wide table: every measure of a line by year and statistic.
_WIDE = [
    (f"{name} {year} {stat}", kind)
    for name, kind in _KINDS.items()
    for year in range(1992, 1999)
    for stat in ("sum", "mean", "low", "high", "n")
]
_WIDE_MATCHES = _MATCHES.replace(
    ", ".join(f"({i}, '{n}', '{k}')" for i, (n, k) in enumerate(_KINDS.items())),
    ", ".join(f"({i}, '{n}', '{k}')" for i, (n, k) in enumerate(_WIDE)),
)


@query(
    f"""WITH {_WIDE_MATCHES} SELECT question_id, rank, name AS "column", CAST(score AS BIGINT) AS score, kind
    FROM m"""
)
def match_columns_wide(spark, sf):
    return shaped(questions.match_columns(_asked(spark, sf), _WIDE))


def _says(words):
    return "(" + " OR ".join(f"contains(said, '{w}')" for w in words) + ")"


@query(
    f"""WITH {_MATCHES},
  f AS (SELECT q.question_id, trim(lower(question)) AS said,
    (SELECT name FROM m WHERE m.question_id = q.question_id AND rank = 1) AS named,
    (SELECT arg_min(name, rank) FROM m WHERE m.question_id = q.question_id AND kind = 'categorical') AS txt,
    (SELECT arg_min(name, rank) FROM m WHERE m.question_id = q.question_id AND kind = 'numeric') AS num
    FROM q),
  r AS (SELECT *, CASE WHEN {_says(V.PROCEDURE_WORDS)} THEN 'procedure'
    WHEN {_says(V.ROWS_WORDS)} THEN 'rows' WHEN {_says(V.COLUMNS_WORDS)} THEN 'columns'
    WHEN {_says(V.MISSING_WORDS)} THEN 'missing' WHEN {_says(V.DUPLICATE_WORDS)} THEN 'duplicates'
    WHEN txt IS NOT NULL AND num IS NOT NULL THEN 'grouped'
    WHEN txt IS NOT NULL AND {_says(V.GROUP_WORDS)} THEN 'value_counts'
    WHEN {_says(V.DISTINCT_WORDS)} AND named IS NOT NULL THEN 'distinct'
    WHEN {_says(V.EXTREME_WORDS)} AND num IS NOT NULL THEN 'extreme'
    WHEN num IS NOT NULL AND {_says(V.TOTAL_WORDS)} THEN 'total'
    WHEN num IS NOT NULL AND {_says(V.MEAN_WORDS)} THEN 'average'
    WHEN num IS NOT NULL AND {_says(V.MEDIAN_WORDS)} THEN 'median'
    WHEN named IS NOT NULL THEN 'summary'
    WHEN {_says(V.CORRELATION_WORDS)} THEN 'correlation' ELSE 'unanswerable' END AS route FROM f)
  SELECT question_id, route,
    CASE WHEN route IN ('grouped', 'value_counts') THEN txt
      WHEN route IN ('extreme', 'total', 'average', 'median') THEN num
      WHEN route IN ('distinct', 'summary') THEN named END AS target,
    CASE WHEN route = 'grouped' THEN num END AS metric,
    CASE WHEN route = 'grouped' THEN CASE WHEN {_says(V.MEAN_WORDS)} THEN 'mean'
      WHEN {_says(V.COUNT_WORDS)} THEN 'count' WHEN {_says(V.MAX_WORDS)} THEN 'max'
      WHEN {_says(V.MIN_WORDS)} THEN 'min' ELSE 'sum' END END AS aggregation,
    CASE WHEN route = 'extreme' THEN CASE WHEN {_says(V.EXTREME_HIGH_WORDS)} THEN 'max' ELSE 'min' END
      END AS extreme,
    CASE WHEN route IN ('grouped', 'value_counts') THEN
      coalesce(nullif(regexp_extract(said, '(?:top|first|highest)\\s*(\\d+)', 1), ''), '-') END AS top_n
  ,
    CASE WHEN route IN ('grouped', 'value_counts') THEN
      coalesce(nullif(regexp_extract(said, '(?:bottom|lowest|last)\\s*(\\d+)', 1), ''), '-') END AS bottom_n
  FROM r"""
)
def route_questions(spark, sf):
    found = questions.routes(_asked(spark, sf), _catalogue(spark, sf))
    return found.select(
        "question_id",
        "route",
        "target",
        "metric",
        "aggregation",
        F.when(F.col("highest"), "max").when(~F.col("highest"), "min").alias("extreme"),
        F.when(
            F.col("route").isin("grouped", "value_counts"),
            F.coalesce(F.col("top_n").cast("string"), F.lit("-")),
        ).alias("top_n"),
        F.when(
            F.col("route").isin("grouped", "value_counts"),
            F.coalesce(F.col("bottom_n").cast("string"), F.lit("-")),
        ).alias("bottom_n"),
    )
