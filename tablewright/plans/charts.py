"""Chart data: DataFrames of marks at plot resolution.

Distributions are binned or summarised over the whole table; only point
charts, whose point count is the feature, keep a bounded number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed_values as V
from tablewright.functions.columns import (
    analytic_class,
    clean_value,
    columns_of,
    number,
    profile_class,
    ref,
    small_frame,
    to_datetime,
)
from tablewright.operators import answers, correlation, frequencies, ordered, quantiles

BIN_SCHEMA = "bin int, bin_start double, bin_end double, n bigint"
BOX_SCHEMA = """column string, n bigint, min double, q1 double, median double, q3 double,
    max double, lower_fence double, upper_fence double, outlier_count bigint"""
PAIR_SCHEMA = "column_a string, column_b string, r double"
# Beyond this many estimated distinct values the bin count is settled.
SURELY_MANY = 200


@dataclass(frozen=True)
class ChartRequest:
    chart_type: str
    x_column: str | None = None
    y_column: str | None = None
    color_column: str | None = None
    aggregation: str = "none"
    title: str | None = None
    # Groups shown by bars and slices; the rest of a pie is one slice of its own.
    top: int = 20
    # Points of a line, an area or raw bars (None shows all), or of a scatter (None shows 1,000).
    points: int | None = None
    # Points of a line or an area that is drawn as all its points would be, four per column of pixels.
    shape_points: int | None = None


@dataclass
class Chart:
    id: str
    type: str
    title: str
    data: DataFrame


# --- column choice -----------------------------------------------------------


class ColumnFacts:
    """Distinct counts and variances, read once and shared by all chart rules."""

    def __init__(self, df: DataFrame):
        self.df = df
        self.numeric = columns_of(df, "numeric", classify=analytic_class)
        self.text = columns_of(df, "categorical")
        names = self.numeric + self.text
        row = df.agg(
            F.count("*").alias("rows"),
            *[F.count(clean_value(df, c)).alias(f"n{i}") for i, c in enumerate(names)],
            *[
                F.approx_count_distinct(clean_value(df, c)).alias(f"d{i}")
                for i, c in enumerate(names)
            ],
            *[F.var_samp(number(df, c)).alias(f"v{i}") for i, c in enumerate(self.numeric)],
        ).first()
        self.rows = row["rows"]
        self.values = {c: row[f"n{i}"] for i, c in enumerate(names)}
        self.variance = {c: row[f"v{i}"] or 0.0 for i, c in enumerate(self.numeric)}
        self.unique = {c: row[f"d{i}"] for i, c in enumerate(names)}
        # The rules only compare with small limits: estimates far above them
        # stand, the others are counted exactly.
        near = [c for c in names if self.unique[c] <= SURELY_MANY]
        if near:
            counted = frequencies.distinct_counts(df, near).collect()
            self.unique |= {r["column"]: r["unique_count"] for r in counted}

    def pick_numeric(self, n: int = 4) -> list[str]:
        """Numeric columns with more than one value, widest variance first."""
        varied = [c for c in self.numeric if self.unique[c] > 1]
        return sorted(varied, key=lambda c: -self.variance[c])[:n]

    def pick_category(self, most: int = 30) -> str | None:
        """Text column with 2 to ``most`` values, nearest to ten of them."""
        fit = [c for c in self.text if 2 <= self.unique[c] <= most]
        return min(fit, key=lambda c: abs(self.unique[c] - 10)) if fit else None


def pick_time(df: DataFrame) -> str | None:
    """First datetime column, else the first whose name hints at time."""
    found = columns_of(df, "datetime")
    if found:
        return found[0]
    for c in df.columns:
        if any(word in c.lower() for word in V.TIME_NAME_WORDS):
            return c
    return None


# --- chart data ----------------------------------------------------------------


def bar(df: DataFrame, by: str, metric: str, top: int = 15) -> DataFrame:
    """Total of ``metric`` per category; no rows unless two bars exist."""
    return _labelled(_at_least(answers.group(df, by, metric, "sum", top=top), 2), by)


def pie(df: DataFrame, by: str, metric: str, top: int = 10) -> DataFrame:
    """Largest totals, all others as one slice, and shares of the whole; at least three slices."""
    slices = _labelled(_at_least(answers.group(df, by, metric, "sum", top=top), 3), by)
    slices = slices.unionByName(_others(_pie_marks(answers.grouped(df, by, metric, "sum"), by, "value"), slices))
    whole = slices.agg(F.sum("value")).scalar()
    return slices.withColumn(
        "share_percent", F.round(F.try_divide(F.col("value"), whole) * 100, 2)
    )


def _others(groups: DataFrame, shown: DataFrame) -> DataFrame:
    """The total of the groups (``label``, ``value``) that no slice shows; no row if it is nothing.

    It is summed from those groups alone: the whole less the slices would leave their rounding.
    """
    # One label per slice reaches the driver.
    labels = [r["label"] for r in shown.select("label").collect()]
    rest = groups.where(~F.col("label").isin(labels)) if labels else groups.limit(0)
    total = rest.agg(F.round(F.sum("value"), 2).alias("value"))
    return total.where("abs(value) >= 0.01").select(F.lit(V.OTHER_SLICE).alias("label"), "value")


def frequency(df: DataFrame, column: str, top: int = 15) -> DataFrame:
    """Most frequent values; no rows unless two exist."""
    counted = _at_least(answers.value_counts(df, column, top=top), 2)
    return counted.select(F.col("value").cast("string").alias("label"), F.col("n").alias("value"))


def _labelled(groups: DataFrame, by: str) -> DataFrame:
    return groups.select(
        ref(by).cast("string").alias("label"), F.round("value", 2).alias("value")
    )


def _settled(marks: DataFrame) -> DataFrame:
    """Compute marks once. Their number is set by the chart, never by the table."""
    return marks.sparkSession.createDataFrame(marks.toArrow(), schema=marks.schema)


def _at_least(marks: DataFrame, k: int) -> DataFrame:
    """Empty result when fewer than ``k`` marks exist."""
    kept = _settled(marks)
    return kept if len(kept.take(k)) == k else kept.limit(0)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width bins counted over every value, empty bins included.

    10 to 30 bins, a third of the distinct values; at least five values needed.
    """
    values = df.select(number(df, column).alias("v")).where("v is not null")
    facts = values.agg(
        F.count("v").alias("n"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
        F.approx_count_distinct("v").alias("distinct"),
    ).first()
    if facts["n"] < 5:
        return small_frame(df.sparkSession, [], BIN_SCHEMA)
    distinct = facts["distinct"]
    if distinct <= SURELY_MANY:
        distinct = values.distinct().count()
    bins = min(30, max(10, distinct // 3))
    low, width = facts["low"], (facts["high"] - facts["low"]) / bins
    frame = small_frame(
        df.sparkSession,
        [(i, low + width * i, low + width * (i + 1)) for i in range(bins)],
        "bin int, bin_start double, bin_end double",
    )
    place = (
        F.least(F.floor((F.col("v") - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        if width > 0
        else F.lit(0)
    )
    counted = values.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    # Both sides hold one row per bin.
    return frame.join(counted, "bin", "left").select(
        "bin", "bin_start", "bin_end", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def heatmap(
    df: DataFrame, columns: list[str], found: dict[tuple[str, str], float] | None = None
) -> DataFrame:
    """Correlations of three or more columns, if any pair reaches 0.2."""
    if len(columns) < 3:
        return small_frame(df.sparkSession, [], PAIR_SCHEMA)
    if found is None:
        found = correlation.coefficients(df, columns)
    shown = {pair: round(r, 2) for pair, r in found.items()}
    if max(abs(r) for (a, b), r in shown.items() if a != b) < 0.2:
        return small_frame(df.sparkSession, [], PAIR_SCHEMA)
    rows = [(a, b, r) for (a, b), r in shown.items()]
    rows += [(b, a, r) for (a, b), r in shown.items() if a != b]
    return small_frame(df.sparkSession, rows, PAIR_SCHEMA)


def scatter_pair(numeric: list[str], found: dict[tuple[str, str], float]) -> tuple[str, str]:
    """Most correlated pair when it reaches 0.1, else the two most variable columns."""
    pairs = [(a, b) for a, b in found if a != b]
    if pairs:
        best = max(pairs, key=lambda pair: abs(found[pair]))
        if abs(found[best]) >= 0.1:
            return best
    return numeric[0], numeric[1]


def scatter(
    df: DataFrame, x: str, y: str, key: list[str], points: int = 800, color: str | None = None
) -> DataFrame:
    """A fixed-size sample of complete pairs."""
    complete = df.where(clean_value(df, x).isNotNull() & clean_value(df, y).isNotNull())
    kept = ordered.sample_k(complete, points, key)
    marks = [ref(x).alias("x"), ref(y).alias("y")]
    if color:
        marks.append(F.coalesce(ref(color).cast("string"), F.lit("Unknown")).alias("color"))
    return kept.select(*marks)


def box(df: DataFrame, columns: list[str]) -> DataFrame:
    """Five-number summary, fences and outlier count per column, over all values."""
    aggs = []
    for i, c in enumerate(columns):
        v = number(df, c)
        aggs += [F.count(v).alias(f"n{i}"), F.min(v).alias(f"l{i}"), F.max(v).alias(f"h{i}")]
    row = df.agg(*aggs).first() if aggs else {}
    kept = [(i, c) for i, c in enumerate(columns) if row[f"n{i}"] >= 5]
    if not kept:
        return small_frame(df.sparkSession, [], BOX_SCHEMA)
    sizes = {c: row[f"n{i}"] for i, c in kept}
    found = quantiles.quantiles(df, list(sizes), [0.25, 0.5, 0.75], sizes=sizes)
    fences = {
        c: (q1 - V.FENCE_FACTOR * (q3 - q1), q3 + V.FENCE_FACTOR * (q3 - q1))
        for c, (q1, _, q3) in found.items()
    }
    beyond = df.agg(
        *[
            F.count_if((number(df, c) < fences[c][0]) | (number(df, c) > fences[c][1])).alias(f"o{i}")
            for i, c in kept
        ]
    ).first()
    rows = [
        (c, sizes[c], row[f"l{i}"], *found[c], row[f"h{i}"], *fences[c], beyond[f"o{i}"])
        for i, c in kept
    ]
    return small_frame(df.sparkSession, rows, BOX_SCHEMA)


def line(df: DataFrame, time: str, metric: str, by_month: bool = True) -> DataFrame:
    """``metric`` over time: month-end totals with empty months as 0, or every point."""
    kind = profile_class(df.schema[time].dataType)
    when = ref(time).cast("timestamp_ntz") if kind == "datetime" else to_datetime(ref(time))
    points = df.select(when.alias("t"), number(df, metric).alias("v")).where(
        "t is not null and v is not null"
    )
    if not by_month:
        return points.select(F.col("t").alias("time"), F.round("v", 2).alias("value")).orderBy("time", "value")
    monthly = points.groupBy(F.last_day("t").alias("month")).agg(F.sum("v").alias("v"))
    months = monthly.agg(
        F.explode(
            F.sequence(
                F.trunc(F.min("month"), "month"), F.max("month"), F.expr("interval 1 month")
            )
        ).alias("first_day")
    ).select(F.last_day("first_day").alias("month"))
    # Both sides hold one row per calendar month.
    return (
        months.join(monthly, "month", "left")
        .select(
            F.col("month").cast("timestamp_ntz").alias("time"),
            F.round(F.coalesce("v", F.lit(0.0)), 2).alias("value"),
        )
        .orderBy("time")
    )


def recommend(df: DataFrame, key: list[str]) -> list[Chart]:
    """Up to six charts: bar, histogram, heatmap, scatter, box, then line and pie or frequency."""
    facts = ColumnFacts(df)
    numeric = facts.pick_numeric(6)
    category = facts.pick_category()
    time = pick_time(df)
    charts: list[Chart] = []

    def add(chart, names, data, least=1):
        if len(charts) == 6:
            return
        marks = _settled(data)
        if len(marks.take(least)) == least:
            id_, kind, title = chart
            charts.append(Chart(id_, kind, title % names if names else title, marks))

    top = numeric[0] if numeric else None
    if category and top:
        add(V.CHART_BAR, (top, category), bar(df, category, top))
    if top:
        add(V.CHART_HISTOGRAM, (top,), histogram(df, top))
    varied = [c for c in facts.numeric if facts.unique[c] > 5]
    related = correlation.coefficients(df, varied) if len(varied) >= 2 else {}
    add(V.CHART_HEATMAP, (), heatmap(df, varied, related))
    if len(numeric) >= 2:
        x, y = scatter_pair(numeric, related)
        color = category if category and facts.unique[category] <= 15 else None
        marks = scatter(df, x, y, key, color=color)
        add(V.CHART_SCATTER, (x, y), marks, least=5)
    if numeric:
        add(V.CHART_BOX, (), box(df, facts.pick_numeric(len(facts.numeric))))
    if time and top and len(charts) < 6:
        add(V.CHART_LINE, (top,), line(df, time, top))
    if category and top and len(charts) < 6:
        add(V.CHART_PIE, (top, category), pie(df, category, top))
    elif not category:
        texts = [c for c in facts.text if facts.unique[c] >= 2]
        if texts:
            add(V.CHART_FREQUENCY, (texts[0],), frequency(df, texts[0]))
    return charts


def custom(df: DataFrame, request: ChartRequest, order_by: list[str]) -> DataFrame:
    """Marks of one user-specified chart."""
    build = {
        "bar": _custom_bar,
        "line": _custom_series,
        "area": _custom_series,
        "scatter": _custom_scatter,
        "histogram": lambda d, r, o: histogram(d, r.x_column or r.y_column or _first_numeric(d)),
        "box": lambda d, r, o: box(d, [r.y_column or r.x_column or _first_numeric(d)]),
        "pie": _custom_pie,
        "heatmap": lambda d, r, o: correlation.matrix(
            d, columns_of(d, "numeric", classify=analytic_class), digits=2
        ).select("column_a", "column_b", "r"),
    }.get(request.chart_type)
    if build is None:
        return small_frame(df.sparkSession, [], "x string, y double")
    return build(df, request, order_by)


def _first_numeric(df: DataFrame) -> str:
    found = columns_of(df, "numeric", classify=analytic_class)
    return found[0] if found else df.columns[0]


def _custom_bar(df, request, order_by):
    x = request.x_column or df.columns[0]
    y = request.y_column
    if y and request.aggregation != "none":
        agg = request.aggregation if request.aggregation in ("sum", "count", "median") else "mean"
        value = F.round(F.col("value").cast("double"), 2).alias("y")
        if not request.color_column:
            groups = answers.group(df, x, y, agg, top=request.top)
            return groups.select(ref(x).cast("string").alias("x"), value)
        # Colour is a second grouping key.
        color = F.coalesce(ref(request.color_column).cast("string"), F.lit("Unknown"))
        pair = F.struct(ref(x).cast("string").alias("x"), color.alias("color"))
        keyed = df.withColumn("__group", F.when(ref(x).isNotNull(), pair))
        groups = answers.group(keyed, "__group", y, agg, top=request.top)
        return groups.select("__group.x", "__group.color", value)
    if y:
        complete = df.where(clean_value(df, x).isNotNull() & clean_value(df, y).isNotNull())
        shown = complete if request.points is None else ordered.preview(complete, request.points, order_by)
        return shown.select(
            ref(x).cast("string").alias("x"), F.coalesce(number(df, y), F.lit(0.0)).alias("y")
        )
    return answers.value_counts(df, x, top=request.top).select(
        F.col("value").cast("string").alias("x"), F.col("n").cast("double").alias("y")
    )


def keep_shape(series: DataFrame, points: int) -> DataFrame:
    """Of a series (position from 0, x, y) at most ``points`` points that draw the same line.

    Positions are cut into ``points // 4`` columns, and each keeps its first, last, smallest and
    largest point (the earliest on ties): at that width, lines between these cover the same pixels.
    A series that is no longer than ``points`` stays whole; null y never is an extreme.
    """
    if points < 4:
        raise ValueError("a column of a line needs four points")
    columns = points // 4
    n = series.agg(F.max("position").alias("last")).first()["last"]
    if n is None or n < points:
        return series
    spread = series.withColumn("__column", F.expr(f"position * {columns} div {n + 1}"))
    # Aggregates of numbers alone, which are hashed: points with their texts would be sorted by column.
    ends = spread.groupBy("__column").agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.min("y").alias("low"), F.max("y").alias("high")
    )
    # Bounded sides: one row per column here, four below.
    found = spread.join(F.broadcast(ends), "__column").groupBy("__column", "first", "last").agg(
        F.min(F.when(F.col("y") == F.col("low"), F.col("position"))).alias("low"),
        F.min(F.when(F.col("y") == F.col("high"), F.col("position"))).alias("high"),
    )
    kept = found.select(F.explode(F.array_distinct(F.array_compact(F.array("first", "last", "low", "high")))).alias("position"))
    return series.join(F.broadcast(kept), "position", "left_semi")


def _custom_series(df, request, order_by):
    used = [c for c in (request.x_column, request.y_column) if c]
    complete = df
    for c in used:
        complete = complete.where(clean_value(df, c).isNotNull())
    if request.points is not None:
        complete = ordered.preview(complete, request.points, order_by)
    wanted = {c.lower() for c in [*used, *order_by]}
    complete = complete.select(*[ref(c) for c in df.columns if c.lower() in wanted])
    numbered, position = ordered.numbered(complete, order_by), F.col("__position")
    series = numbered.select(
        position.alias("position"),
        (ref(request.x_column).cast("string") if request.x_column else position.cast("string")).alias("x"),
        (
            F.coalesce(number(df, request.y_column), F.lit(0.0))
            if request.y_column
            else position.cast("double")
        ).alias("y"),
    )
    return series if request.shape_points is None else keep_shape(series, request.shape_points)


def _custom_scatter(df, request, order_by):
    if not request.x_column or not request.y_column:
        return small_frame(df.sparkSession, [], "x double, y double")
    return scatter(
        df, request.x_column, request.y_column, order_by, request.points or V.SCATTER_POINTS, color=request.color_column
    )


def _custom_pie(df, request, order_by):
    texts = [f.name for f in df.schema.fields if analytic_class(f.dataType) != "numeric"]
    by = request.x_column or request.y_column or (texts[0] if texts else df.columns[0])
    y = request.y_column
    if y and y != by and analytic_class(df.schema[y].dataType) == "numeric":
        groups = answers.grouped(df, by, y, "sum")
        marks = _settled(_pie_marks(answers.group(df, by, y, "sum", top=request.top), by, "value"))
        return marks.unionByName(_others(_pie_marks(groups, by, "value"), marks))
    marks = _settled(_pie_marks(answers.value_counts(df, by, top=request.top), "value", "n"))
    return marks.unionByName(_others(_pie_marks(frequencies.value_counts(df, by), "value", "n"), marks))


def _pie_marks(groups: DataFrame, label: str, value: str) -> DataFrame:
    return groups.select(ref(label).cast("string").alias("label"), F.col(value).cast("double").alias("value"))
