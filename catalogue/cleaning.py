"""Cleaning operators and the plan runner on the dirty view."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import query, shaped
from catalogue.views import DIRTY, DIRTY_COLUMNS, dirty
from tablewright.operators import cleaning, frequencies, ordered
from tablewright.plans.cleaning_plan import CleaningPlan, ColumnDecision, run
from tablewright.session import scratch_path
from tablewright.sources import sinks

ORDER = ["event_id"]
_ALL = ", ".join(DIRTY_COLUMNS)
_FENCES = """(SELECT q1 - 1.5 * (q3 - q1) AS lb, q3 + 1.5 * (q3 - q1) AS ub FROM
    (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}))"""


# --- conversions -----------------------------------------------------------------


def _convert_query(to, column, sql, as_text=False):
    @query(DIRTY + f"SELECT event_id, {sql} AS {column} FROM d", name=f"convert_{to}")
    def convert_query(spark, sf):
        found = cleaning.convert(dirty(spark, sf), column, to).select("event_id", column)
        if as_text:
            found = found.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))
        return shaped(found)


for _to, _column, _sql, _text in [
    (
        "integer",
        "money_text",
        "CAST(round_even(CAST(regexp_replace(money_text, '[$,]', '', 'g') AS DOUBLE), 0) AS BIGINT)",
        False,
    ),
    ("decimal", "money_text", "CAST(regexp_replace(money_text, '[$,%]', '', 'g') AS DOUBLE)", False),
    (
        "datetime",
        "date_text",
        """strftime(coalesce(try_cast(date_text AS TIMESTAMP), try_strptime(date_text, '%m/%d/%Y')),
        '%Y-%m-%d %H:%M:%S')""",
        True,
    ),
    (
        "boolean",
        "flag_text",
        """CASE WHEN lower(flag_text) IN ('true','1','yes','y','t') THEN TRUE
        WHEN lower(flag_text) IN ('false','0','no','n','f') THEN FALSE END""",
        False,
    ),
    ("string", "user_id", "CAST(user_id AS VARCHAR)", False),
]:
    _convert_query(_to, _column, _sql, _text)


# --- names, spaces, columns, rows ----------------------------------------------------


@query(DIRTY + 'SELECT event_id AS "event id", amount AS "the amount", flag_text FROM d')
def trim_names(spark, sf):
    messy = dirty(spark, sf).select(
        F.col("event_id").alias("  event  id"), F.col("amount").alias("the\tamount "), "flag_text"
    )
    return shaped(cleaning.trim_names(messy))


_SQUEEZE = r"trim(regexp_replace({c}, '\s+', ' ', 'g'))"


@query(
    DIRTY
    + f"""SELECT event_id, {_SQUEEZE.format(c='label_text')} AS label_text,
    {_SQUEEZE.format(c='event_type')} AS event_type FROM d"""
)
def trim_values(spark, sf):
    return cleaning.trim_values(dirty(spark, sf)).select("event_id", "label_text", "event_type")


@query(DIRTY + "SELECT event_id, amount, event_type FROM d")
def drop_column(spark, sf):
    kept = dirty(spark, sf).select("event_id", "amount", "event_type", "ts", "constant_text")
    return shaped(cleaning.drop_columns(kept, ["ts", "constant_text"]))


@query(DIRTY + "SELECT event_id, flag_text FROM d")
def drop_notes(spark, sf):
    noted = dirty(spark, sf).select(
        "event_id",
        "flag_text",
        F.col("label_text").alias("Analyst Notes"),
        F.col("label_text").alias("my analyst_note 2"),
    )
    return cleaning.drop_notes(noted)


@query(DIRTY + "SELECT event_id, amount FROM d WHERE amount IS NOT NULL")
def drop_null_rows(spark, sf):
    return shaped(cleaning.drop_null_rows(dirty(spark, sf), "amount").select("event_id", "amount"))


@query(
    DIRTY
    + f"""SELECT event_id, amount FROM d, {_FENCES.format(c='amount', t='d')}
    WHERE amount IS NULL OR (amount >= lb AND amount <= ub)"""
)
def drop_outlier_rows(spark, sf):
    return shaped(
        cleaning.drop_outlier_rows(dirty(spark, sf), "amount").select("event_id", "amount")
    )


@query(
    DIRTY
    + f"""SELECT event_id, round(CASE WHEN amount IS NOT NULL THEN greatest(least(amount, ub), lb) END,
    4) AS amount FROM d, {_FENCES.format(c='amount', t='d')}"""
)
def clip_outliers(spark, sf):
    return shaped(cleaning.clip_outliers(dirty(spark, sf), "amount").select("event_id", "amount"))


@query(DIRTY + f"SELECT {_ALL.replace('ts,', '')} FROM (SELECT DISTINCT {_ALL} FROM d)")
def dedup_rows(spark, sf):
    return shaped(frequencies.drop_duplicates(dirty(spark, sf)).drop("ts"))


# --- fills ------------------------------------------------------------------------------


def _fill_query(key, column, method, sql, value=None):
    @query(DIRTY + f"SELECT event_id, {sql} AS {column} FROM d", name=key)
    def fill_query(spark, sf):
        found = cleaning.fill(dirty(spark, sf), column, method, value, ORDER)
        return shaped(found.select("event_id", column))


_MODE = """(SELECT event_type FROM d WHERE event_type IS NOT NULL GROUP BY event_type
    ORDER BY count(*) DESC, event_type LIMIT 1)"""
for _key, _column, _method, _sql, _value in [
    (
        "fill_mean",
        "amount",
        "mean",
        "coalesce(amount, (SELECT pyround(avg(amount), 2) FROM d))",
        None,
    ),
    (
        "fill_median",
        "amount",
        "median",
        "coalesce(amount, (SELECT pyround(median(amount), 2) FROM d))",
        None,
    ),
    ("fill_mode", "event_type", "mode", f"coalesce(event_type, {_MODE})", None),
    ("fill_constant", "amount", "constant", "coalesce(amount, 7.5)", "7.5"),
    (
        "fill_constant_recovered",
        "amount",
        "constant",
        "coalesce(amount, (SELECT median(amount) FROM d))",
        "not a number",
    ),
    (
        "fill_constant_text",
        "event_type",
        "constant",
        "coalesce(event_type, 'Not Specified')",
        None,
    ),
]:
    _fill_query(_key, _column, _method, _sql, _value)

_UPTO = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_ONWARD = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
_PREVIOUS = f"last_value(amount IGNORE NULLS) OVER (ORDER BY event_id {_UPTO})"
_FOLLOWING = f"first_value(amount IGNORE NULLS) OVER (ORDER BY event_id {_ONWARD})"


def _spread(df):
    """Row count of one bucket, so that several buckets are always in play."""
    return max(1, df.count() // 7)


@query(DIRTY + f"SELECT event_id, coalesce({_PREVIOUS}, {_FOLLOWING}) AS amount FROM d")
def fill_forward(spark, sf):
    df = dirty(spark, sf).select("event_id", "amount")
    return shaped(ordered.fill_forward(df, ["amount"], ORDER, _spread(df)))


@query(DIRTY + f"SELECT event_id, coalesce({_FOLLOWING}, {_PREVIOUS}) AS amount FROM d")
def fill_backward(spark, sf):
    df = dirty(spark, sf).select("event_id", "amount")
    return shaped(ordered.fill_backward(df, ["amount"], ORDER, _spread(df)))


# --- plans --------------------------------------------------------------------------------

PLAN = CleaningPlan(
    decisions=(
        ColumnDecision("amount", "fill", "median", outlier_action="clip"),
        ColumnDecision("event_type", "fill", "mode"),
        ColumnDecision("flag_text", "keep", convert_type="boolean"),
        ColumnDecision("money_text", "keep", convert_type="integer"),
        ColumnDecision("sparse_value", "remove_column"),
        ColumnDecision("no_such_column", "keep"),
        ColumnDecision("whole_float", "keep", outlier_action="remove_rows", convert_type="integer"),
    ),
    remove_duplicates=True,
    trim_spaces=True,
    order_by=("event_id",),
)

# Fences of whole_float are computed after deduplication.
_CLEANED = f"""{DIRTY}, t AS (SELECT DISTINCT event_id, ts, user_id, event_type, amount, sparse_value,
      {_SQUEEZE.format(c='label_text')} AS label_text, flag_text, int_text, money_text, date_text,
      whole_float, constant_text FROM d),
    f AS (SELECT * REPLACE (coalesce(amount, (SELECT pyround(median(amount), 2) FROM t)) AS amount,
      coalesce(event_type, (SELECT event_type FROM t WHERE event_type IS NOT NULL
        GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1)) AS event_type) FROM t),
    cleaned AS (SELECT event_id, user_id, event_type,
      round(greatest(least(amount, a.ub), a.lb), 4) AS amount, label_text,
      flag_text IN ('Yes', 'true') AS flag_text, int_text,
      CAST(round_even(CAST(regexp_replace(money_text, '[$,]', '', 'g') AS DOUBLE), 0) AS BIGINT)
        AS money_text, date_text, CAST(whole_float AS BIGINT) AS whole_float, constant_text
      FROM f, {_FENCES.format(c='amount', t='f')} a, {_FENCES.format(c='whole_float', t='f')} w
      WHERE whole_float >= w.lb AND whole_float <= w.ub)
"""


@query(_CLEANED + "SELECT * FROM cleaned")
def clean_plan(spark, sf):
    return shaped(run(dirty(spark, sf), PLAN).df.drop("ts"))


_NULLS = " + ".join(f"count({c})" for c in DIRTY_COLUMNS)


@query(
    _CLEANED
    + f"""SELECT (SELECT count(*) FROM d) AS rows_before, count(*) AS rows_after,
    CAST(13 AS BIGINT) AS columns_before, CAST(12 AS BIGINT) AS columns_after,
    (SELECT 13 * count(*) - ({_NULLS}) FROM d) AS missing_cells_before,
    CAST(0 AS BIGINT) AS missing_cells_after,
    (SELECT count(*) FROM d) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d)) AS duplicates_before,
    CAST(0 AS BIGINT) AS duplicates_after FROM cleaned"""
)
def clean_diff(spark, sf):
    return run(dirty(spark, sf), PLAN).diff()


@query()
def clean_quality_diff(spark, sf):
    return run(dirty(spark, sf), PLAN).quality_diff()


@query()
def audit_log(spark, sf):
    """The audit written twice under one dataset and once under another, then read back."""
    audit = run(dirty(spark, sf), PLAN).audit
    path = scratch_path(spark, "audit-")
    for dataset in ("events", "other", "events"):
        sinks.write_audit(audit, path, dataset)
    log = sinks.read_audit(spark, path, "events")
    return log.select(
        "step_number",
        "action_type",
        "target_column",
        "decision_details",
        "rationale",
        F.to_json("before_metrics").alias("before_metrics"),
        F.to_json("after_metrics").alias("after_metrics"),
    )


@query()
def report_audit(spark, sf):
    from tablewright.plans import report

    return report.audit(run(dirty(spark, sf), PLAN).audit)


@query(DIRTY + "SELECT event_id, event_type, amount, label_text, flag_text FROM d")
def sink_clean(spark, sf):
    """Write Parquet and read it back as the current table."""
    path = scratch_path(spark, "clean-") + ".parquet"
    kept = dirty(spark, sf).select("event_id", "event_type", "amount", "label_text", "flag_text")
    sinks.write_clean(kept, path)
    return shaped(sinks.current_table(spark, f"{path}-absent", path))
