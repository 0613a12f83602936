"""Column classes, null handling, text and number parsing expressions."""

from __future__ import annotations

import re
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tablewright.functions import fixed_values as V

NUMBER_TEXT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
ISO_DATE_START = r"^\d{4}-\d{1,2}-\d{1,2}"


def ref(name: str) -> Column:
    """Column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def profile_class(dtype: T.DataType) -> str:
    """boolean, numeric, datetime or categorical (booleans are not numbers)."""
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "categorical"


def analytic_class(dtype: T.DataType) -> str:
    """Class used by answers and charts, where booleans count as numbers."""
    kind = profile_class(dtype)
    return "numeric" if kind == "boolean" else kind


def is_text(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StringType, T.CharType, T.VarcharType))


def columns_of(df: DataFrame, *kinds: str, classify=profile_class) -> list[str]:
    return [f.name for f in df.schema.fields if classify(f.dataType) in kinds]


def clean_value(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    dtype = df.schema[name].dataType
    c = ref(name)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def number(df: DataFrame, name: str) -> Column:
    """The column as DOUBLE: booleans become 0/1, NaN becomes null, text is parsed."""
    dtype = df.schema[name].dataType
    if is_text(dtype):
        return parse_number(ref(name))
    if isinstance(dtype, T.BooleanType):
        return ref(name).cast("int").cast("double")
    if not isinstance(dtype, T.NumericType):
        return F.lit(None).cast("double")
    return clean_value(df, name).cast("double")


def comparable(c: Column) -> Column:
    """Number as written text; −0.0 and 0.0 are one value."""
    return (c + F.lit(0.0)).cast("string")


def as_text(df: DataFrame, name: str) -> Column:
    """The column as text for a common (column, value) shape."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return comparable(clean_value(df, name))
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(ref(name))
    return ref(name).cast("string")


def trimmed(c: Column) -> Column:
    """Strip Unicode whitespace from both ends."""
    return F.btrim(c, F.lit(V.WHITESPACE))


def squeezed(c: Column) -> Column:
    """Strip the ends and collapse inner whitespace runs to one space."""
    # A run that is not already one plain space.
    return F.regexp_replace(trimmed(c), r"(?U)[^\S ]\s*+| \s++", " ")


def has_irregular_space(c: Column) -> Column:
    return c.rlike(r"(?U)^\s+|\s+$|\s{2,}")


def parse_number(c: Column) -> Column:
    """Text to DOUBLE; anything that is not wholly a number becomes null."""
    text = trimmed(c.cast("string"))
    return F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))


def to_integer(c: Column) -> Column:
    """Drop ``$`` and ``,``, parse, round half to even."""
    parsed = parse_number(F.translate(c.cast("string"), "$,", ""))
    return F.bround(parsed, 0).try_cast("bigint")


def to_decimal(c: Column) -> Column:
    """Drop ``$``, ``,`` and ``%`` and parse; percentages are not divided."""
    return parse_number(F.translate(c.cast("string"), "$,%", ""))


def is_decimal(c: Column) -> Column:
    """Whether ``to_decimal`` gives a number: all such text can be cast."""
    return trimmed(F.translate(c.cast("string"), "$,%", "")).rlike(NUMBER_TEXT)


def to_datetime(c: Column) -> Column:
    """Mixed-layout date text to TIMESTAMP_NTZ, month first, bad text null."""
    # No date of any layout is shorter than 1/1/2024.
    text = trimmed(F.when(F.length(c.cast("string")) >= 8, c.cast("string")))
    iso = F.when(text.rlike(ISO_DATE_START), text.try_cast("timestamp_ntz"))
    # A failed parse costs far more than a look at the value's shape, which most layouts share
    # with another one. Layouts of one shape stand next to each other, so their order stays.
    tried = []
    for shape, layouts in groupby(V.DATE_LAYOUTS, layout_shape):
        parsed = [F.try_to_timestamp(text, F.lit(layout)) for layout in layouts]
        tried.append(F.when(text.rlike(shape), F.coalesce(*parsed).cast("timestamp_ntz")))
    return F.coalesce(iso, *tried)


def layout_shape(layout: str) -> str:
    """A pattern that all texts of a date layout match: kinds of characters and punctuation alone."""
    out = []
    for letter, run in groupby(layout):
        n = len(list(run))
        if letter in "[]":
            out.append(("(?:" if letter == "[" else ")?") * n)
        elif letter.isalpha():
            out.append(r"\p{L}+" if letter == "M" and n > 2 else r"[+-]?\d+")
        else:
            out.append(re.escape(letter * n))
    return f"^{''.join(out)}$"


def to_boolean(c: Column) -> Column:
    word = F.lower(trimmed(c.cast("string")))
    return F.when(word.isin(V.TRUE_WORDS), True).when(word.isin(V.FALSE_WORDS), False)


def unrolled(df: DataFrame, items: Column, position: str, value: str) -> DataFrame:
    """One row per array element, with its position from 0.

    The outer form with a null check: for the inner form the optimizer adds a
    size filter below it, which computes ``items`` a second time.
    """
    others = [ref(c) for c in df.columns]
    rows = df.select(*others, F.posexplode_outer(items).alias(position, value))
    return rows.where(ref(position).isNotNull())


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Driver-side rows (bounded by the schema, never by the data) as a local relation."""
    import pyarrow as pa

    parsed = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(parsed)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    table = pa.table(
        [pa.array(list(values), type=f.type) for values, f in zip(columns, arrow)], schema=arrow
    )
    return spark.createDataFrame(table, schema=parsed)
