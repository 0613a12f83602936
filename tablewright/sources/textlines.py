"""Tables out of the lines of plain text documents (array expressions, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions import fixed_values as V
from tablewright.functions.columns import ref, trimmed, unrolled


def raw_lines(text: Column) -> Column:
    """All lines; a final line break opens no further line."""
    return F.split(F.regexp_replace(text, f"(?:{V.LINE_BREAK})\\z", ""), V.LINE_BREAK)


def lines_of(text: Column) -> Column:
    """Non-empty lines, stripped."""
    lines = F.transform(F.split(text, V.LINE_BREAK_CHARS), trimmed)
    return F.filter(lines, lambda line: line != "")


def _tabular(text: Column) -> Column:
    """Lines that split into two or more fields, as arrays of fields."""
    fields = F.transform(lines_of(text), lambda line: F.split(line, V.FIELD_SEPARATOR))
    return F.filter(fields, lambda parts: F.size(parts) >= 2)


def _header(parts: Column) -> Column:
    return F.transform(
        parts,
        lambda p, i: F.concat(
            F.lit("Col_"), i.cast("string"), F.lit("_"), trimmed(F.substring(p, 1, 12))
        ),
    )


def text_table(df: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_index, headers, cells) per document.

    The first tabular line names the columns; longer rows are cut to them,
    shorter ones padded with nulls.
    """
    parsed = df.select(ref(id_).alias("doc_id"), _tabular(ref(text)).alias("parts"))
    # A lone header unrolls to nothing. No filter on ``parts``: pushed below
    # the projection it would parse every text twice.
    headed = parsed.select(
        "doc_id",
        _header(F.try_element_at("parts", F.lit(1))).alias("headers"),
        F.slice("parts", 2, F.size("parts")).alias("body"),
    )
    rows = unrolled(headed, F.col("body"), "row_index", "fields")
    width = F.size("headers")
    padding = F.array_repeat(F.lit(None).cast("string"), F.greatest(width - F.size("fields"), F.lit(0)))
    cells = F.slice(F.concat(F.col("fields"), padding), 1, width)
    return rows.select("doc_id", "row_index", "headers", cells.alias("cells"))


def text_lines(
    df: DataFrame, id_: str = "doc_id", text: str = "text", max_lines: int | None = None
) -> DataFrame:
    """(doc_id, line_no, document_line) for documents without a table.

    ``max_lines=2000`` gives the first two thousand lines of each document; by
    default every line is kept.
    """
    parsed = df.select(ref(id_).alias("doc_id"), lines_of(ref(text)).alias("lines"))
    fields = F.filter("lines", lambda line: F.size(F.split(line, V.FIELD_SEPARATOR)) >= 2)
    kept = F.slice("lines", 1, max_lines) if max_lines else F.col("lines")
    plain = parsed.select("doc_id", F.when(F.size(fields) < 2, kept).alias("lines"))
    return unrolled(plain, F.col("lines"), "p", "document_line").select(
        "doc_id", (F.col("p") + 1).alias("line_no"), "document_line"
    )
