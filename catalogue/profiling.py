"""Profile, quality scores, type detection, correlation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import query, shaped
from catalogue.views import DIRTY, DIRTY_COLUMNS, dirty, table
from tablewright.functions import fixed_values as V
from tablewright.operators import answers, correlation, frequencies
from tablewright.plans import detect, report
from tablewright.plans.profile import TableProfile
from tablewright.sources.delimited import inferred_types

ORDER = ["event_id"]
DIRTY_NUMBERS = ["event_id", "user_id", "amount", "sparse_value", "whole_float"]
DIRTY_TEXTS = [
    "event_type", "label_text", "flag_text", "int_text", "money_text", "date_text",
    "constant_text",
]
LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]
PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union(columns, template: str) -> str:
    return " UNION ALL ".join(template.format(i=i, c=c) for i, c in enumerate(columns))


def prices(spark, sf):
    return table(spark, sf, "lineitem").select(*PRICES)


# --- sizes, missing, duplicates ------------------------------------------------


@query(
    DIRTY
    + """SELECT count(*) AS total_rows, CAST(13 AS BIGINT) AS total_columns,
    13 * count(*) AS total_cells FROM d"""
)
def table_size(spark, sf):
    return answers.table_size(dirty(spark, sf))


_FILLED = " + ".join(f"count({c})" for c in DIRTY_COLUMNS)


@query(
    DIRTY
    + f"""SELECT CAST(13 * count(*) - ({_FILLED}) AS BIGINT) AS total_missing_cells,
    round((13 * count(*) - ({_FILLED})) / (13 * count(*)) * 100, 2) AS missing_cells_percentage
    FROM d"""
)
def missing_total(spark, sf):
    found = answers.missing_by_column(dirty(spark, sf))
    cells = F.sum(F.col("null_count") + F.col("non_null_count"))
    return found.agg(
        F.sum("null_count").alias("total_missing_cells"),
        F.round(F.sum("null_count") / cells * 100, 2).cast("double").alias("missing_cells_percentage"),
    )


_MISSING = union(
    DIRTY_COLUMNS,
    """SELECT CAST({i} AS BIGINT) AS column_index, '{c}' AS "column", count({c}) AS non_null_count,
    count(*) - count({c}) AS null_count,
    round((count(*) - count({c})) / count(*) * 100, 2) AS null_percentage FROM d""",
)


@query(DIRTY + _MISSING)
def missing_by_column(spark, sf):
    return shaped(answers.missing_by_column(dirty(spark, sf)))


@query(DIRTY + f"SELECT * FROM ({_MISSING}) WHERE null_count > 0")
def missing_ranked(spark, sf):
    return shaped(answers.missing_ranked(dirty(spark, sf)))


_COPIES = f"""SELECT CAST(sum(n - 1) AS BIGINT) FROM
    (SELECT count(*) AS n FROM d GROUP BY {", ".join(DIRTY_COLUMNS)})"""


@query(
    DIRTY
    + f"""SELECT ({_COPIES}) AS duplicate_rows_count,
    round(({_COPIES}) / count(*) * 100, 2) AS duplicate_rows_percentage FROM d"""
)
def duplicate_rows(spark, sf):
    return answers.duplicate_rows(dirty(spark, sf))


@query(
    DIRTY
    + union(
        DIRTY_COLUMNS,
        """SELECT CAST({i} AS BIGINT) AS column_index, '{c}' AS "column",
        count(DISTINCT {c}) AS unique_count FROM d""",
    )
)
def unique_counts(spark, sf):
    return shaped(frequencies.distinct_counts(dirty(spark, sf), DIRTY_COLUMNS))


@query(
    DIRTY
    + union(
        DIRTY_COLUMNS,
        """SELECT '{c}' AS "column", position, value FROM (SELECT CAST({c} AS VARCHAR) AS value,
        row_number() OVER (ORDER BY event_id) AS position FROM d WHERE {c} IS NOT NULL)
        WHERE position <= 5""",
    )
)
def sample_values(spark, sf):
    profile = TableProfile(dirty(spark, sf), ORDER)
    found = detect.sample_values(profile).select(
        "column", F.posexplode("sample_values").alias("p", "value")
    )
    return found.select("column", (F.col("p") + 1).cast("bigint").alias("position"), "value")


# --- statistics, fences, outliers --------------------------------------------------


@query(
    DIRTY
    + union(
        DIRTY_NUMBERS,
        """SELECT '{c}' AS "column", pyround(CAST(min({c}) AS DOUBLE), 2) AS min_value,
        pyround(CAST(max({c}) AS DOUBLE), 2) AS max_value, pyround(avg({c}), 2) AS mean_value,
        pyround(stddev_samp({c}), 2) AS std_value FROM d""",
    )
)
def numeric_stats(spark, sf):
    return TableProfile(dirty(spark, sf)).numeric_stats()


def _fence_sql(columns, source):
    """(column, q1, q3, lower, upper, outliers, values) per numeric column."""
    return " UNION ALL ".join(
        f"""SELECT {i} AS i, '{c}' AS "column", q1, q3, q1 - 1.5 * (q3 - q1) AS lb,
        q3 + 1.5 * (q3 - q1) AS ub,
        (SELECT count(*) FROM {source} WHERE {c} < q1 - 1.5 * (q3 - q1)
            OR {c} > q3 + 1.5 * (q3 - q1)) AS outside,
        (SELECT count({c}) FROM {source}) AS filled
        FROM (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {source})"""
        for i, c in enumerate(columns)
    )


@query(
    DIRTY
    + f"""SELECT "column", round(q1, 6) AS q1, round(q3, 6) AS q3, round(q3 - q1, 6) AS iqr,
    round(lb, 6) AS lower_bound, round(ub, 6) AS upper_bound FROM ({_fence_sql(DIRTY_NUMBERS, 'd')})"""
)
def iqr_fences(spark, sf):
    return shaped(TableProfile(dirty(spark, sf)).fences(), 6)


_OUTLIERS = f"""SELECT "column", outside AS outlier_count,
    pyround(outside / filled * 100, 2) AS outlier_percentage, pyround(lb, 2) AS lower_bound,
    pyround(ub, 2) AS upper_bound, '{V.FENCE_METHOD}' AS method
    FROM ({_fence_sql(DIRTY_NUMBERS, 'd')}) WHERE q3 > q1 AND outside > 0"""


@query(DIRTY + _OUTLIERS)
def outliers(spark, sf):
    return TableProfile(dirty(spark, sf)).outliers()


@query(
    f"""SELECT "column", outside AS outlier_count,
    pyround(outside / filled * 100, 2) AS outlier_percentage, pyround(lb, 2) AS lower_bound,
    pyround(ub, 2) AS upper_bound, '{V.FENCE_METHOD}' AS method
    FROM ({_fence_sql(PRICES, 'lineitem')}) WHERE q3 > q1 AND outside > 0"""
)
def outliers_lineitem(spark, sf):
    return TableProfile(prices(spark, sf)).outliers()


@query(
    DIRTY
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", position, round({c}, 2) AS sample_outlier FROM
        (SELECT {c}, row_number() OVER (ORDER BY event_id) AS position FROM d,
          (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM d)
          WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) WHERE position <= 6"""
        for c in DIRTY_NUMBERS
    )
)
def outlier_samples(spark, sf):
    return shaped(TableProfile(dirty(spark, sf), ORDER).outlier_samples())


@query(DIRTY + "SELECT 'amount' AS \"column\", count(*) AS negative_count FROM d WHERE amount < 0")
def negative_values(spark, sf):
    profile = TableProfile(dirty(spark, sf))
    return (
        profile.inconsistencies()
        .where(F.col("issue_type") == V.ISSUE_NEGATIVE)
        .select("column", F.col("affected_count").alias("negative_count"))
    )


_ISSUES = f"""
    SELECT 'amount' AS "column", '{V.ISSUE_NEGATIVE}' AS issue_type,
      concat('Found ', count(*), ' negative entries in ''amount'', which is conventionally non-negative.')
        AS description,
      count(*) AS affected_count, CASE WHEN count(*) > 5 THEN 'high' ELSE 'medium' END AS severity
      FROM d WHERE amount < 0 HAVING count(*) > 0
    UNION ALL """ + " UNION ALL ".join(
    f"""SELECT '{c}', '{V.ISSUE_CONSTANT}',
      concat('Column ''{c}'' has only 1 distinct value (''', min({c}), ''') across all records.'),
      count(*), 'medium' FROM d HAVING count(DISTINCT {c}) = 1"""
    for c in DIRTY_TEXTS
) + " UNION ALL " + " UNION ALL ".join(
    f"""SELECT '{c}', '{V.ISSUE_MISSING}',
      concat('Column ''{c}'' is missing ',
        CAST(pyround((count(*) - count({c})) / count(*) * 100, 2) AS DOUBLE),
        '% of entries (', count(*) - count({c}), '/', count(*), ').'),
      count(*) - count({c}), 'high' FROM d
      HAVING pyround((count(*) - count({c})) / count(*) * 100, 2) >= 50"""
    for c in DIRTY_COLUMNS
)


@query(DIRTY + _ISSUES)
def inconsistencies(spark, sf):
    return TableProfile(dirty(spark, sf)).inconsistencies().drop("issue_number")


_SPACES = union(
    DIRTY_TEXTS,
    r"""SELECT '{c}' AS "column", FALSE AS name_has_space,
    count(*) FILTER (regexp_matches({c}, '^\s+|\s+$|\s\s+')) AS values_with_space_count FROM d""",
)


@query(DIRTY + f"SELECT * FROM ({_SPACES}) WHERE values_with_space_count > 0")
def whitespace_issues(spark, sf):
    return TableProfile(dirty(spark, sf)).whitespace()


@query(
    DIRTY
    + f"""SELECT count(*) AS affected_columns_count,
    CAST(sum(values_with_space_count) AS BIGINT) AS total_irregular_occurrences,
    count(*) > 0 AS has_issues FROM ({_SPACES}) WHERE values_with_space_count > 0"""
)
def whitespace_totals(spark, sf):
    return TableProfile(dirty(spark, sf)).whitespace_totals()


_SCORES = f"""
  parts AS (SELECT
    greatest(0, pyround(100 - 2.5 * pyround((13 * count(*) - ({_FILLED})) / (13 * count(*)) * 100, 2), 1))
      AS completeness_score,
    greatest(0, pyround(100 - 4 * pyround(({_COPIES}) / count(*) * 100, 2), 1)) AS uniqueness_score,
    greatest(0, pyround(100 - 8 * (SELECT count(*) FROM ({_ISSUES})), 1)) AS consistency_score,
    greatest(0, pyround(100 - 3 * pyround((SELECT sum(outlier_count) FROM ({_OUTLIERS})) 
      / (count(*) * {len(DIRTY_NUMBERS)}) * 100, 2), 1)) AS validity_score
    FROM d)"""


@query(
    DIRTY
    + f""", {_SCORES}
    SELECT CAST(pyround(0.35 * completeness_score + 0.25 * uniqueness_score
        + 0.2 * consistency_score + 0.2 * validity_score, 1) AS DOUBLE) AS overall_quality_score,
      CAST(completeness_score AS DOUBLE) AS completeness_score,
      CAST(uniqueness_score AS DOUBLE) AS uniqueness_score,
      CAST(consistency_score AS DOUBLE) AS consistency_score,
      CAST(validity_score AS DOUBLE) AS validity_score FROM parts"""
)
def quality_scores(spark, sf):
    return TableProfile(dirty(spark, sf)).quality_scores()


@query(
    DIRTY
    + union(
        DIRTY_COLUMNS,
        """SELECT CAST({i} AS BIGINT) AS column_index, '{c}' AS "column",
        count({c}) AS non_null_count, count(*) - count({c}) AS null_count,
        pyround((count(*) - count({c})) / count(*) * 100, 2) AS null_percentage,
        count(DISTINCT {c}) AS unique_count FROM d""",
    )
)
def column_summary(spark, sf):
    found = TableProfile(dirty(spark, sf)).column_metrics()
    return shaped(
        found.select(
            "column_index", "column", "non_null_count", "null_count", "null_percentage",
            "unique_count",
        )
    )


# --- correlation and importance ----------------------------------------------------


def _r(a, b, source="lineitem"):
    return f"""(SELECT CASE WHEN corr({a}, {b}) IS NULL OR isnan(corr({a}, {b})) THEN 0
        ELSE corr({a}, {b}) END FROM {source})"""


_MATRIX = " UNION ALL ".join(
    f"""SELECT '{a}' AS column_a, '{b}' AS column_b, {i} AS i, {j} AS j,
    pyround({_r(a, b)}, 3) AS r"""
    for i, a in enumerate(LINE_NUMBERS)
    for j, b in enumerate(LINE_NUMBERS)
)


@query(f"SELECT column_a, column_b, r FROM ({_MATRIX})")
def correlation_matrix(spark, sf):
    found = TableProfile(table(spark, sf, "lineitem")).correlation_matrix()
    return found.select("column_a", "column_b", "r")


@query(
    DIRTY
    + " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, pyround({_r(a, b, 'd')}, 3) AS r"
        for a in DIRTY_NUMBERS
        for b in DIRTY_NUMBERS
    )
)
def correlation_with_gaps(spark, sf):
    """Pairwise-complete rows: both columns have missing cells of their own."""
    found = TableProfile(dirty(spark, sf)).correlation_matrix()
    return found.select("column_a", "column_b", "r")


_GAPS = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, {j} AS j, pyround({_r(a, b, 'd')}, 3) AS r"
    for a in DIRTY_NUMBERS
    for j, b in enumerate(DIRTY_NUMBERS)
)


@query(DIRTY + f"SELECT column_a, column_b, r FROM ({_GAPS})")
def correlation_tiled(spark, sf):
    """The matrix by pairs of column blocks, as for tables of thousands of columns."""
    half = correlation.tiled(dirty(spark, sf), DIRTY_NUMBERS, block=2)
    return correlation.mirrored(half, 3).select("column_a", "column_b", "r")


@query(
    DIRTY
    + f"""SELECT "column", CASE WHEN r <> 0 THEN partner END AS partner_column, r FROM (
      SELECT column_a AS "column", column_b AS partner, r,
        row_number() OVER (PARTITION BY column_a ORDER BY abs(r) DESC, j) AS k
      FROM ({_GAPS}) WHERE column_a <> column_b) WHERE k = 1"""
)
def correlation_tiled_partner(spark, sf):
    """Strongest partners out of the tiled matrix, ranked where it lies."""
    half = correlation.tiled(dirty(spark, sf), DIRTY_NUMBERS, block=2)
    found = correlation.strongest(correlation.mirrored(half, 3))
    return found.select(F.col("column_a").alias("column"), F.col("column_b").alias("partner_column"), "r")


_CV = union(
    LINE_NUMBERS,
    """SELECT {i} AS i, '{c}' AS "column", var_samp({c}) AS variance,
    abs(stddev_samp({c}) / CASE WHEN avg({c}) <> 0 THEN avg({c}) ELSE 1 END) AS cv FROM lineitem""",
)


@query(
    f"""SELECT "column", pyround(variance, 2) AS variance, pyround(cv, 2) AS coefficient_of_variation
    FROM ({_CV})"""
)
def variance_cv(spark, sf):
    return TableProfile(table(spark, sf, "lineitem")).variance_cv()


_PARTNER = f"""SELECT "column", CASE WHEN r <> 0 THEN partner END AS partner_column,
    r AS correlation_coefficient FROM (
      SELECT column_a AS "column", column_b AS partner, r,
        row_number() OVER (PARTITION BY column_a ORDER BY abs(r) DESC, j) AS k
      FROM ({_MATRIX}) WHERE column_a <> column_b) WHERE k = 1"""


@query(_PARTNER)
def top_partner(spark, sf):
    return TableProfile(table(spark, sf, "lineitem")).top_partner()


@query(
    f"""SELECT c."column", pyround(variance, 2) AS variance, pyround(cv, 2) AS coefficient_of_variation,
    partner_column, CASE WHEN partner_column IS NOT NULL THEN correlation_coefficient END
      AS correlation_coefficient,
    pyround(least(100, cv * 20 + abs(correlation_coefficient) * 40), 1) AS importance_score
    FROM ({_CV}) c JOIN ({_PARTNER}) p ON c."column" = p."column"
    ORDER BY importance_score DESC, i LIMIT 6"""
)
def important_variables(spark, sf):
    return TableProfile(table(spark, sf, "lineitem")).important_variables()


@query(
    f"""SELECT variable, '{V.SKEW_PATTERN}' AS pattern_type, pyround(s, 2) AS metric_value,
    CASE WHEN s > 1 THEN '{V.SKEW_RIGHT}' WHEN s < -1 THEN '{V.SKEW_LEFT}'
      ELSE '{V.SKEW_NONE}' END AS interpretation FROM ("""
    + union(
        ["event_id", "user_id", "value"],
        "SELECT '{c}' AS variable, coalesce(skewness({c}), 0) AS s FROM events",
    )
    + ")"
)
def skew_patterns(spark, sf):
    return TableProfile(table(spark, sf, "events")).skew_patterns()


# --- documents ---------------------------------------------------------------------


@query(
    DIRTY
    + f""", issues AS (SELECT row_number() OVER () AS n, * FROM ({_ISSUES})),
    ranked AS (SELECT *, CASE issue_type WHEN '{V.ISSUE_NEGATIVE}' THEN 1 WHEN '{V.ISSUE_MISSING}'
      THEN 2 ELSE 3 END AS k FROM issues)
    SELECT row_number() OVER (ORDER BY part, k, i) AS step, recommendation FROM (
      SELECT 1 AS part, k, n AS i, concat(issue_type, ' in ''', "column", ''': ', description)
        AS recommendation FROM ranked
      UNION ALL (SELECT 2, 0, i, concat('Investigate outliers in ''', "column", ''' (', outside,
        ' values outside IQR bounds).') FROM ({_fence_sql(DIRTY_NUMBERS, 'd')})
        WHERE q3 > q1 AND outside > 0)
      UNION ALL (SELECT 3, 0, 0, concat('Address ', format('{{:,}}', null_count),
        ' missing values in ''', "column", ''' before analysis.') FROM ({_MISSING})
        WHERE null_count > 0 ORDER BY null_count DESC, column_index LIMIT 1)
      UNION ALL SELECT 4, 0, 0, concat('Remove ', format('{{:,}}', ({_COPIES})),
        ' duplicate rows to ensure analysis accuracy.'))"""
)
def next_investigations(spark, sf):
    return shaped(TableProfile(dirty(spark, sf)).next_investigations())


@query()
def profile_json(spark, sf):
    return TableProfile(dirty(spark, sf), ORDER).to_json()


@query()
def column_types(spark, sf):
    return shaped(answers.columns_by_class(dirty(spark, sf)))


# --- types ---------------------------------------------------------------------------

_LINE_COLUMNS = LINE_NUMBERS + ["l_returnflag", "l_linestatus"]


@query(
    union(
        _LINE_COLUMNS,
        r"""SELECT '{c}' AS "column", CASE
        WHEN bool_and(regexp_full_match(CAST({c} AS VARCHAR), '[+-]?\d+')) THEN 'bigint'
        WHEN bool_and(regexp_full_match(CAST({c} AS VARCHAR), '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?'))
          THEN 'double'
        WHEN bool_and(lower(CAST({c} AS VARCHAR)) IN ('true', 'false')) THEN 'boolean'
        ELSE 'string' END AS data_type FROM lineitem""",
    )
)
def infer_types(spark, sf):
    from tablewright.functions.columns import small_frame

    lines = table(spark, sf, "lineitem")
    text = lines.select(*[F.col(c).cast("string").alias(c) for c in _LINE_COLUMNS])
    return small_frame(spark, list(inferred_types(text).items()), "column string, data_type string")


def _type_sql(c: str) -> str:
    sample = f"""SELECT {c} AS v, trim({c}) AS w, row_number() OVER (ORDER BY event_id) AS p
        FROM d WHERE {c} IS NOT NULL"""
    number = r"'[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?'"
    return f"""SELECT '{c}' AS "column", count(*) AS n,
      (SELECT count(DISTINCT {c}) FROM d) AS uniques,
      bool_and(lower(w) IN ('true','false','yes','no','y','n','1','0')) AS b,
      count(*) FILTER (regexp_full_match(w, '-?\\d+')) / count(*) AS i,
      count(*) FILTER (regexp_full_match(regexp_replace(w, '[$,%]', '', 'g'), {number})) / count(*) AS f,
      count(*) FILTER (coalesce(try_cast(w AS TIMESTAMP), try_strptime(w, '%m/%d/%Y')) IS NOT NULL)
        / count(*) AS t,
      avg(length(w)) AS len, string_agg(v, ', ' ORDER BY p) FILTER (p <= 3) AS three
      FROM ({sample})"""


_TYPES = f"""SELECT "column", 'text/string' AS current_type, kind AS suggested_type,
      CASE kind WHEN 'boolean' THEN 0.95 WHEN 'integer' THEN pyround(i, 2) WHEN 'decimal' THEN pyround(f, 2)
        ELSE pyround(t, 2) END AS confidence,
      CASE kind WHEN 'boolean' THEN concat('Column values are exclusively boolean indicators (', three, ').')
        WHEN 'integer' THEN concat(CAST(round(i * 100) AS BIGINT), '{V.REASON_INTEGER[2:]}')
        WHEN 'decimal' THEN concat(CAST(round(f * 100) AS BIGINT), '{V.REASON_DECIMAL[2:]}')
        ELSE concat(CAST(round(t * 100) AS BIGINT), '{V.REASON_DATETIME[2:]}') END AS reason
    FROM (SELECT *, CASE WHEN b AND uniques <= 4 THEN 'boolean' WHEN i >= 0.85 THEN 'integer'
        WHEN f >= 0.85 THEN 'decimal' WHEN len >= 6 AND t >= 0.85 THEN 'datetime' END AS kind
      FROM ({" UNION ALL ".join(_type_sql(c) for c in DIRTY_TEXTS)}) WHERE n >= 3)
    WHERE kind IS NOT NULL
    UNION ALL """ + " UNION ALL ".join(
    f"""SELECT '{c}', 'decimal/float', 'integer', 0.99, '{V.REASON_WHOLE}' FROM d
      HAVING count({c}) >= 3 AND bool_and({c} % 1 = 0)"""
    for c in ("amount", "sparse_value", "whole_float")
)
_TYPES = _TYPES.replace("'%% of values", "'% of values")


def _typed(spark, sf):
    found = detect.type_issues(TableProfile(dirty(spark, sf), ORDER))
    return found.drop("column_index")


@query(DIRTY + f"SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM ({_TYPES})")
def type_issues(spark, sf):
    return _typed(spark, sf)


def _register_kind(key, current, suggested):
    sql = DIRTY + f"""SELECT * REPLACE (CAST(confidence AS DOUBLE) AS confidence) FROM ({_TYPES})
        WHERE current_type = '{current}' AND suggested_type = '{suggested}'"""

    @query(sql, name=key)
    def one_kind(spark, sf):
        return _typed(spark, sf).where(
            (F.col("current_type") == current) & (F.col("suggested_type") == suggested)
        )


for _key, _current, _suggested in [
    ("type_issue_boolean", "text/string", "boolean"),
    ("type_issue_integer", "text/string", "integer"),
    ("type_issue_decimal", "text/string", "decimal"),
    ("type_issue_datetime", "text/string", "datetime"),
    ("type_issue_whole_float", "decimal/float", "integer"),
]:
    _register_kind(_key, _current, _suggested)


# Numbers in the first sixty rows only: a column is judged by all its values.
_LATE = """SELECT event_id, CASE WHEN event_id < 60 THEN CAST(user_id AS VARCHAR) ELSE event_type END AS turns_to_text,
    CASE WHEN event_id < 60 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS turns_to_number FROM events"""


@query(
    f"""SELECT 'turns_to_number' AS "column", 'text/string' AS current_type, 'integer' AS suggested_type,
    pyround(share, 2) AS confidence, concat(CAST(round(share * 100) AS BIGINT), '{V.REASON_INTEGER[2:].replace("%%", "%")}') AS reason
    FROM (SELECT count(*) FILTER (regexp_full_match(turns_to_number, '-?\\d+')) / count(*) AS share FROM ({_LATE}))"""
)
def type_issues_of_all_values(spark, sf):
    events = table(spark, sf, "events")
    early = F.col("event_id") < 60
    number = F.col("user_id").cast("string")
    late = events.select(
        "event_id",
        F.when(early, number).otherwise(F.col("event_type")).alias("turns_to_text"),
        F.when(early, F.col("event_type")).otherwise(number).alias("turns_to_number"),
    )
    return detect.type_issues(TableProfile(late, ORDER)).drop("column_index")


_SUMMARY_VALUES = [
    "concat(overall, ' / 100')",
    "format('{:,}', n)",
    "concat(completeness_score, '%')",
    "'13'",
    "concat(uniqueness_score, '%')",
    "concat(format('{:,}', missing), ' (', missing_share, '%)')",
    "concat(consistency_score, '% / ', validity_score, '%')",
    "format('{:,}', copies)",
]


@query(
    DIRTY
    + f""", {_SCORES}, sizes AS (SELECT count(*) AS n, CAST(13 * count(*) - ({_FILLED}) AS BIGINT) AS missing,
      pyround((13 * count(*) - ({_FILLED})) / (13 * count(*)) * 100, 2) AS missing_share,
      ({_COPIES}) AS copies FROM d),
    facts AS (SELECT *, pyround(0.35 * completeness_score + 0.25 * uniqueness_score
      + 0.2 * consistency_score + 0.2 * validity_score, 1) AS overall FROM parts, sizes)
    """
    + " UNION ALL ".join(
        f"SELECT CAST({i + 1} AS INTEGER) AS position, '{label}' AS metric, {value} AS value FROM facts"
        for i, (label, value) in enumerate(zip(V.SUMMARY_LABELS, _SUMMARY_VALUES))
    )
)
def report_summary(spark, sf):
    return report.summary(TableProfile(dirty(spark, sf), ORDER))


@query()
def report_issues(spark, sf):
    return report.issues(TableProfile(dirty(spark, sf), ORDER))
