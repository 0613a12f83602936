"""CSV reading: text first, then the library's own type inference."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import fixed_values as V
from tablewright.functions.columns import NUMBER_TEXT, is_text, ref
from tablewright.session import cut_lineage
from tablewright.sources import quoted

RAW = "__raw_line"
SURPLUS = "__surplus_field"
INTEGER_TEXT = r"^[+-]?\d+$"


def read_csv(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    multi_line: bool | None = None,
    infer: bool = True,
) -> DataFrame:
    """Read CSV with a header row.

    Rows with too many fields are skipped, short rows are padded with nulls.
    Encoding and quoted line breaks are found out file by file in one pass over
    the lines, unless given. Files with quoted line breaks are read by byte
    ranges like all others; their records are written to the shared folder
    once. So are headers: every file is read with its own, and columns that
    only some files have are null elsewhere.
    """
    kinds = _kinds(spark, path, encoding, multi_line)
    parts = [
        _read_alike(spark, files, charset, lines)
        for (charset, lines, _), files in sorted(kinds.items(), key=lambda k: (k[0][:2], k[1]))
    ]
    text = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return infer_types(text) if infer else text


def _kinds(spark, path, encoding, multi_line) -> dict[tuple[str, bool, str], list[str]]:
    """Files by encoding, by whether a record may go over several lines, and by header."""
    quotes = lambda c: F.octet_length(c) - F.octet_length(F.replace(c, F.lit('"'), F.lit("")))
    with quoted.held_ranges(spark):
        lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
        lines = lines.withColumn("id", F.monotonically_increasing_id())
        # Numbers and truth values alone are hashed; with the headers' texts, lines would be sorted by file.
        ranges = lines.groupBy("file", "start").agg(
            F.bool_and(F.is_valid_utf8("value")).alias("utf8"),
            F.bool_or(quotes("value") % 2 == 1).alias("open_quote"),
            F.min(F.when(F.trim("value") != "", F.col("id"))).alias("id"),
        )
        place = F.when(F.col("id").isNotNull(), F.struct("start", "id"))
        facts = ranges.groupBy("file").agg(F.bool_and("utf8").alias("utf8"), F.bool_or("open_quote").alias("open_quote"), F.min(place)["id"].alias("id"))
        facts = cut_lineage(facts.where("id IS NOT NULL"))
        # One row per file is broadcast and reaches the driver, as every listing of files does.
        headers = lines.select("file", "id", "value").join(F.broadcast(facts), ["file", "id"])
        found = headers.select(
            "file",
            "utf8",
            "open_quote",
            # Bytes, as the text may be in any encoding.
            F.hex(F.col("value").cast("binary")).alias("header"),
            (quotes("value") % 2 == 1).alias("header_goes_on"),
        ).collect()
    if len(found) != facts.count():
        raise RuntimeError("byte ranges changed between two scans")
    out: dict[tuple[str, bool, str], list[str]] = {}
    for r in found:
        charset = encoding or ("UTF-8" if r["utf8"] else "ISO-8859-1")
        several = bool(r["open_quote"]) if multi_line is None else multi_line
        # A header of several lines is not known by its first one: such a file is read by itself.
        header = f"{r['header']} {r['file']}" if several and r["header_goes_on"] else r["header"]
        out.setdefault((charset, several, header), []).append(unquote(r["file"]))
    return {k: sorted(v) for k, v in out.items()} or {(encoding or "UTF-8", bool(multi_line), ""): [path]}


def _read_alike(spark: SparkSession, files: list[str], encoding: str, multi_line: bool) -> DataFrame:
    options = {
        "header": True,
        "encoding": encoding,
        "multiLine": multi_line,
        "escape": '"',
        "quote": '"',
    }
    header = spark.read.options(**options).csv(files).columns
    fields = [T.StructField(c, T.StringType()) for c in header]
    extra = [T.StructField(SURPLUS, T.StringType()), T.StructField(RAW, T.StringType())]
    schema = T.StructType(fields + extra)
    # Fields are counted only when whole lines are parsed.
    checked = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": RAW, "columnPruning": False}
    found = quoted.records(spark, files, encoding) if multi_line and encoding.upper() in quoted.ENCODINGS else None
    if found is None:
        lines = spark.read.options(**options, **checked).schema(schema).csv(files)
    else:
        parsed = {k: str(v).lower() if isinstance(v, bool) else v for k, v in {**options, **checked, "header": False}.items()}
        lines = found.select(F.from_csv("record", schema.toDDL(), parsed).alias("r")).select("r.*")
    # Every regular row is one field short of this schema, so its raw line is
    # kept; a row that fills the surplus field, or fits exactly, is too long.
    regular = lines.where(F.col(RAW).isNotNull() & F.col(SURPLUS).isNull())
    return regular.select(*[ref(c) for c in header])


def _present(c: Column) -> Column:
    return F.when(~F.trim(c).isin(V.MISSING_TOKENS), c)


def inferred_types(df: DataFrame) -> dict[str, str]:
    """Column types as bigint, double, boolean or string: one aggregate for all columns."""
    texts = [f.name for f in df.schema.fields if is_text(f.dataType)]
    out: dict[str, str] = {}
    for start in range(0, len(texts), 100):
        batch = texts[start : start + 100]
        aggs = []
        for i, c in enumerate(batch):
            v = _present(ref(c))
            word = F.trim(v)
            whole = word.rlike(INTEGER_TEXT)
            aggs += [
                F.count(v).alias(f"n{i}"),
                F.bool_and(
                    F.when(v.isNotNull(), whole & word.try_cast("bigint").isNotNull())
                ).alias(f"i{i}"),
                F.bool_and(word.rlike(NUMBER_TEXT)).alias(f"d{i}"),
                F.bool_and(v.isin(V.CSV_TRUE + V.CSV_FALSE)).alias(f"b{i}"),
            ]
        row = df.agg(*aggs).first()
        for i, c in enumerate(batch):
            if not row[f"n{i}"]:
                out[c] = "double"
            elif row[f"i{i}"]:
                out[c] = "bigint"
            elif row[f"d{i}"]:
                out[c] = "double"
            else:
                out[c] = "boolean" if row[f"b{i}"] else "string"
    return out


def infer_types(df: DataFrame) -> DataFrame:
    """Cast text columns to the narrowest type all their values fit. Dates stay text."""
    kinds = inferred_types(df)

    def typed(c: str) -> Column:
        if c not in kinds:
            return ref(c)
        v = _present(ref(c))
        if kinds[c] == "string":
            return v.alias(c)
        if kinds[c] == "boolean":
            return v.isin(V.CSV_TRUE).alias(c)
        return F.trim(v).try_cast(kinds[c]).alias(c)

    return df.select(*[typed(c) for c in df.columns])
