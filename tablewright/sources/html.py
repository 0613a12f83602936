"""Tables and text out of HTML pages.

Only markup scanning runs in Python, page by page in Arrow batches. Header
resolution, width checks and the choice of table are array expressions on
the same row, so a page never has to be shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.entities import html5 as ENTITIES
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.columns import ref, unrolled

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# Elements whose text is not part of a page's visible text.
HIDDEN = frozenset("script style template rt rp".split())
# Elements that end each other, and what keeps an outer one of the same kind open.
KINDS = {"table": "table", "tr": "row", "td": "cell", "th": "cell", "ul": "list", "ol": "list", "li": "li", "p": "p"}
HOLDERS = {"row": ("table",), "cell": ("table", "row"), "li": ("list", "cell", "table"), "p": ("cell", "table", "li")}


class _Scanner(HTMLParser):
    """Visible text and the cells of every table of one page, in time linear in the page.

    Rows, cells, list items and paragraphs end where the next one begins, as their end tags are
    optional. Cells are ranges of the page's visible text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.stack: list[tuple[str, dict | None]] = []
        self.open: Counter[str] = Counter()
        # Places in the stack of the open elements of each kind.
        self.places: dict[str, list[int]] = {k: [] for k in ("table", "row", "cell", "list", "li", "p")}
        self.text: list[str] = []
        self.length = 0
        self.tables: list[dict] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        kind, node = KINDS.get(tag), None
        if kind in ("row", "cell", "li", "p"):
            self._end_last(kind)
        if kind == "table":
            node = {"headers": [], "rows": []}
            self.tables.append(node)
        elif kind == "row":
            node = {"td": [], "all": []}
            for table in self._nodes("table"):
                table["rows"].append(node)
        elif kind == "cell":
            node = {"start": self.length, "end": None}
            for row in self._nodes("row"):
                row["all"].append(node)
                if tag == "td":
                    row["td"].append(node)
            if tag == "th":
                for table in self._nodes("table"):
                    table["headers"].append(node)
        self.hidden += tag in HIDDEN
        if kind:
            self.places[kind].append(len(self.stack))
        self.open[tag] += 1
        self.stack.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.open[tag]:
            while self._pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            self.text.append(data)
            self.length += len(data)

    def handle_entityref(self, name):
        # An unknown name stays as it is written.
        self.handle_data(ENTITIES.get(f"{name};", f"&{name}"))

    def handle_charref(self, name):
        self.handle_data(unescape(f"&#{name};"))

    def close(self):
        super().close()
        while self.stack:
            self._pop()

    def _end_last(self, kind):
        """End the open element of this kind, unless it lies outside what holds the new one."""
        last = self.places[kind][-1] if self.places[kind] else -1
        if last > max((self.places[k][-1] for k in HOLDERS[kind] if self.places[k]), default=-1):
            while len(self.stack) > last:
                self._pop()

    def _pop(self) -> str:
        tag, node = self.stack.pop()
        self.open[tag] -= 1
        self.hidden -= tag in HIDDEN
        kind = KINDS.get(tag)
        if kind:
            self.places[kind].pop()
        if kind == "cell":
            node["end"] = self.length
        return tag

    def _nodes(self, kind):
        return [self.stack[at][1] for at in self.places[kind]]


def _scan(page: str | None) -> _Scanner:
    scanner = _Scanner()
    scanner.feed(page or "")
    scanner.close()
    return scanner


def _page(page: str | None) -> tuple[str, list[dict]]:
    """Visible text, and each table's headers and rows of cells."""
    scan = _scan(page)
    text = "".join(scan.text)
    cells = lambda nodes: [text[n["start"] : n["end"]].strip() for n in nodes]
    tables = [
        {
            "headers": cells(t["headers"]),
            "td_rows": [cells(r["td"]) for r in t["rows"] if r["td"]],
            "all_rows": [cells(r["all"]) for r in t["rows"] if r["all"]],
        }
        for t in scan.tables
    ]
    return text, tables


def _scan_tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        scans = [_page(page) for page in batch["html"]]
        lines = [[line.strip() for line in text.splitlines() if line.strip()] for text, _ in scans]
        yield pd.DataFrame({"page_id": batch["page_id"], "tables": [t for _, t in scans], "lines": lines})


def _pages(df: DataFrame, id_: str, html: str) -> DataFrame:
    return df.select(ref(id_).alias("page_id"), ref(html).alias("html"))


def scanned_tables(df: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """One row per page with all its tables and its lines of visible text."""
    pages = _pages(df, id_, html)
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.mapInPandas(
        _scan_tables,
        f"""page_id {kind}, tables array<struct<headers: array<string>,
        td_rows: array<array<string>>, all_rows: array<array<string>>>>, lines array<string>""",
    )


def _first_usable() -> Column:
    """The first table that has rows as wide as its headers."""
    resolved = F.transform(
        "tables",
        lambda t, i: F.struct(
            i.alias("table_index"),
            F.when(F.size(t["headers"]) > 0, t["headers"])
            .when(
                F.size(t["td_rows"]) > 0,
                F.transform(t["td_rows"][0], lambda _, j: F.concat(F.lit("Col_"), (j + 1).cast("string"))),
            )
            .alias("headers"),
            t["td_rows"].alias("td_rows"),
        ),
    )
    checked = F.transform(
        resolved,
        lambda t: F.struct(
            t["table_index"].alias("table_index"),
            t["headers"].alias("headers"),
            F.filter(t["td_rows"], lambda r: F.size(r) == F.size(t["headers"])).alias("rows"),
        ),
    )
    return F.try_element_at(F.filter(checked, lambda t: F.size(t["rows"]) > 0), F.lit(1))


def _largest() -> Column:
    """The table with the most cells; null if no table has any."""
    width = lambda t: F.coalesce(F.array_max(F.transform(t["all_rows"], lambda r: F.size(r))), F.lit(0))
    sized = F.transform(
        "tables",
        lambda t, i: F.struct(
            (F.size(t["all_rows"]) * width(t)).alias("area"), (-i).alias("order"), width(t).alias("n_columns"), t["all_rows"].alias("rows")
        ),
    )
    best = F.array_max(sized)
    return F.when(best["area"] > 0, best)


def html_tables(df: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, table_index, row_index, headers, cells): the first usable table per page.

    Headers are all ``th`` of the table, else ``Col_1`` … as wide as its first
    row. Rows of another width are dropped; a table without rows is passed over.
    """
    chosen = scanned_tables(df, id_, html).select("page_id", _first_usable().alias("t"))
    return unrolled(chosen, F.col("t.rows"), "row_index", "cells").select(
        "page_id",
        F.col("t.table_index").alias("table_index"),
        F.col("t.headers").alias("headers"),
        "row_index",
        "cells",
    )


def html_largest_table(df: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, table_index, n_rows, n_columns, rows): the largest table by area per page."""
    return (
        scanned_tables(df, id_, html)
        .select("page_id", _largest().alias("t"))
        .where("t is not null")
        .select(
            "page_id",
            (-F.col("t.order")).alias("table_index"),
            F.size("t.rows").alias("n_rows"),
            F.col("t.n_columns").alias("n_columns"),
            F.col("t.rows").alias("rows"),
        )
    )


def html_text_lines(
    df: DataFrame, id_: str = "page_id", html: str = "html", max_lines: int | None = None
) -> DataFrame:
    """(page_id, line_no, text_content): non-empty visible lines of pages whose tables hold nothing.

    ``max_lines=1000`` gives the first thousand lines of each page; by default
    every line is kept.
    """
    scanned = scanned_tables(df, id_, html).where(_largest().isNull())
    kept = F.slice("lines", 1, max_lines) if max_lines else F.col("lines")
    return unrolled(scanned, kept, "p", "text_content").select(
        "page_id", (F.col("p") + 1).alias("line_no"), "text_content"
    )


def html_frames(df: DataFrame, id_: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, kind, headers, row_index, cells): every page once, as the best form it has.

    The first usable table (kind ``table``), else the largest with all its cells (``largest``),
    else the lines of text as one column (``text``). A page without anything gives no rows.
    """
    largest, usable = F.col("largest"), F.col("usable")
    numbered = F.transform(F.sequence(F.lit(1), largest["n_columns"]), lambda j: F.concat(F.lit("Col_"), j.cast("string")))
    form = (
        F.when(usable.isNotNull(), F.struct(F.lit("table").alias("kind"), usable["headers"].alias("headers"), usable["rows"].alias("rows")))
        .when(largest.isNotNull(), F.struct(F.lit("largest").alias("kind"), numbered.alias("headers"), largest["rows"].alias("rows")))
        .otherwise(F.struct(F.lit("text").alias("kind"), F.array(F.lit("Text_Content")).alias("headers"), F.transform("lines", lambda x: F.array(x)).alias("rows")))
    )
    chosen = scanned_tables(df, id_, html).select("page_id", "lines", _first_usable().alias("usable"), _largest().alias("largest"))
    chosen = chosen.select("page_id", form.alias("t"))
    return unrolled(chosen, F.col("t.rows"), "row_index", "cells").select("page_id", "t.kind", "t.headers", "row_index", "cells")
