"""Single cleaning operators. Each takes and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import fixed_values as V
from tablewright.functions.columns import (
    clean_value,
    is_text,
    number,
    profile_class,
    ref,
    squeezed,
    to_boolean,
    to_datetime,
    to_decimal,
    to_integer,
)
from tablewright.operators import frequencies, ordered, quantiles

FILL_METHODS = ("mean", "median", "mode", "constant", "ffill", "bfill")
CONVERT_TYPES = {
    "integer": ("integer", "int", "int64"),
    "decimal": ("decimal", "float", "float64"),
    "datetime": ("datetime", "date"),
    "boolean": ("boolean", "bool"),
    "string": ("string", "text", "str"),
}


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select(*[value.alias(c) if c == name else ref(c) for c in df.columns])


def target_type(name: str) -> str:
    for kind, spellings in CONVERT_TYPES.items():
        if name.lower() in spellings:
            return kind
    raise ValueError(f"unknown conversion type {name!r}")


def convert_value(c: Column, dtype: T.DataType, to: str) -> Column:
    kind = target_type(to)
    if kind == "integer":
        return to_integer(c)
    if kind == "decimal":
        return to_decimal(c)
    if kind == "datetime":
        if profile_class(dtype) == "datetime":
            return c.cast("timestamp_ntz")
        return to_datetime(c)
    if kind == "boolean":
        return c if isinstance(dtype, T.BooleanType) else to_boolean(c)
    return c.cast("string")


def convert(df: DataFrame, name: str, to: str) -> DataFrame:
    """Convert one column; cells that do not fit the type become null."""
    dtype = df.schema[name].dataType
    return replace_column(df, name, convert_value(clean_value(df, name), dtype, to))


def squeeze_name(name: str) -> str:
    return " ".join(name.split())


def trim_names(df: DataFrame) -> DataFrame:
    """Strip and collapse whitespace in column names."""
    names = [squeeze_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError("trimmed column names collide")
    return df.toDF(*names)


def trim_values(df: DataFrame) -> DataFrame:
    """Strip and collapse whitespace in every text column; nulls stay null."""
    return df.select(
        *[
            squeezed(ref(f.name)).alias(f.name) if is_text(f.dataType) else ref(f.name)
            for f in df.schema.fields
        ]
    )


def note_columns(df: DataFrame) -> list[str]:
    """Columns named exactly as an analyst note."""
    return [c for c in df.columns if c.strip().lower() in V.NOTE_NAMES]


def note_like_columns(df: DataFrame) -> list[str]:
    """Columns whose name contains an analyst-note fragment."""
    return [c for c in df.columns if any(part in c.lower() for part in V.NOTE_FRAGMENTS)]


def drop_notes(df: DataFrame) -> DataFrame:
    return drop_columns(df, note_columns(df) + note_like_columns(df))


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[ref(c) for c in df.columns if c not in names])


def drop_null_rows(df: DataFrame, name: str) -> DataFrame:
    return df.where(clean_value(df, name).isNotNull())


def fill_value(df: DataFrame, name: str, value) -> DataFrame:
    """Replace missing cells by one value.

    A fractional value turns an integer column into DOUBLE; everything else
    keeps the column's type.
    """
    dtype = df.schema[name].dataType
    current = clean_value(df, name)
    if profile_class(dtype) == "numeric":
        whole = float(value).is_integer() and not isinstance(value, float)
        if whole or isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
            return replace_column(df, name, F.coalesce(current, F.lit(value).cast(dtype)))
        return replace_column(
            df, name, F.coalesce(current.cast("double"), F.lit(float(value)))
        )
    return replace_column(df, name, F.coalesce(current, F.lit(value).cast(dtype)))


def fill_statistic(df: DataFrame, name: str, method: str):
    """The value ``mean``, ``median`` or ``mode`` filling puts in; None without values."""
    kind = profile_class(df.schema[name].dataType)
    if method in ("mean", "median"):
        if kind != "numeric":
            raise ValueError(f"{method} fill needs a numeric column: {name!r}")
        if method == "mean":
            found = df.agg(F.avg(number(df, name)).alias("v")).first()["v"]
        else:
            found = quantiles.quantiles(df, [name], [0.5])[name][0]
        return None if found is None else round(float(found), 2)
    return mode_fills(df, [name])[name]


def mode_fills(df: DataFrame, names: list[str]) -> dict:
    """The value that ``mode`` filling puts into each column, from one count of all their values."""
    found = frequencies.modes(df, names)
    for name in names:
        kind = profile_class(df.schema[name].dataType)
        if found[name] is None and kind in ("numeric", "categorical"):
            found[name] = 0 if kind == "numeric" else V.EMPTY_MODE_TEXT
    return found


def constant_value(df: DataFrame, name: str, value):
    """The constant that fits the column; a bad numeric constant becomes the median."""
    kind = profile_class(df.schema[name].dataType)
    if kind == "numeric":
        raw = "0" if value is None else value
        try:
            parsed = float(raw)
        except (TypeError, ValueError):
            median = quantiles.quantiles(df, [name], [0.5])[name][0]
            return float(median) if median is not None else 0.0
        return int(parsed) if parsed.is_integer() else parsed
    return V.DEFAULT_CONSTANT_TEXT if value is None else str(value)


def fill(
    df: DataFrame, name: str, method: str, value=None, order_by: list[str] | None = None
) -> DataFrame:
    """Fill the missing cells of one column."""
    if method not in FILL_METHODS:
        raise ValueError(f"unknown fill method {method!r}")
    if method in ("ffill", "bfill"):
        if not order_by:
            raise ValueError(f"{method} needs order_by")
        step = ordered.fill_forward if method == "ffill" else ordered.fill_backward
        return step(df, [name], order_by)
    if method == "constant":
        return fill_value(df, name, constant_value(df, name, value))
    found = fill_statistic(df, name, method)
    return df if found is None else fill_value(df, name, found)


def fences(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Lower and upper fence of columns with enough values and a positive spread."""
    sizes = quantiles.counts(df, names) if names else {}
    eligible = [c for c in names if sizes[c] > V.FENCE_MIN_VALUES]
    found = quantiles.quantiles(df, eligible, [0.25, 0.75], sizes=sizes)
    out = {}
    for c, (q1, q3) in found.items():
        spread = q3 - q1
        if spread > 0:
            out[c] = (q1 - V.FENCE_FACTOR * spread, q3 + V.FENCE_FACTOR * spread)
    return out


def outside(df: DataFrame, name: str, fence: tuple[float, float]) -> Column:
    v = number(df, name)
    return F.coalesce((v < fence[0]) | (v > fence[1]), F.lit(False))


def clip_to(df: DataFrame, name: str, fence: tuple[float, float]) -> DataFrame:
    v = number(df, name)
    clipped = F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(fence[1])), F.lit(fence[0])))
    return replace_column(df, name, clipped)


def clip_outliers(df: DataFrame, name: str) -> DataFrame:
    """Pull values beyond the fences onto them; missing cells stay missing."""
    found = fences(df, [name])
    return clip_to(df, name, found[name]) if found else df


def drop_outlier_rows(df: DataFrame, name: str) -> DataFrame:
    """Drop rows beyond the fences; rows without a value stay."""
    found = fences(df, [name])
    return df.where(~outside(df, name, found[name])) if found else df
