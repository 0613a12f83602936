"""Tables and lines out of HTML, text, DOT graphs and CSV."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogue.registry import query, shaped
from catalogue.views import table
from tablewright.session import scratch_path
from tablewright.sources import delimited, dot, html, textlines


# --- HTML -------------------------------------------------------------------------------


def _tabled(spark, sf):
    """Every page with two tables of its own facts in front: a bare header, then rows."""
    return table(spark, sf, "pages").select(
        "page_id",
        F.concat(
            F.lit("<table><tr><th>heading only</th></tr></table>"),
            F.lit("<table border=1><tr><th>field</th><th> value </th></tr>"),
            F.concat(F.lit("<tr><td>page</td><td>"), F.col("page_id"), F.lit("</td></tr>")),
            F.lit("<tr><td>url</td><td> <b>"),
            F.replace("url", F.lit("&"), F.lit("&amp;")),
            F.lit("</b></td></tr><tr><td>short</td></tr></table>"),
            F.col("html"),
        ).alias("html"),
    )


@query(
    """SELECT page_id, CAST(1 AS BIGINT) AS table_index, row_index, 'field|value' AS headers, cells
    FROM (SELECT page_id, CAST(0 AS BIGINT) AS row_index, concat('page|', page_id) AS cells FROM pages
      UNION ALL SELECT page_id, 1, concat('url|', url) FROM pages)"""
)
def html_tables(spark, sf):
    found = html.html_tables(_tabled(spark, sf))
    return shaped(
        found.withColumn("headers", F.array_join("headers", "|")).withColumn(
            "cells", F.array_join("cells", "|")
        )
    )


@query(
    """SELECT page_id, CAST(1 AS BIGINT) AS table_index, CAST(4 AS BIGINT) AS n_rows,
    CAST(2 AS BIGINT) AS n_columns,
    concat('field|value;page|', page_id, ';url|', url, ';short') AS rows FROM pages"""
)
def html_largest_table(spark, sf):
    found = html.html_largest_table(_tabled(spark, sf))
    rows = F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";")
    return shaped(found.withColumn("rows", rows))


def _untagged(column):
    """Markup removal by patterns: enough for these pages, not for HTML at large."""
    steps = [
        (r"<!--.*?-->", ""),
        (r"<script[^>]*>.*?</script>", ""),
        (r"<style[^>]*>.*?</style>", ""),
        # A reference may go without its semicolon in front of a tag.
        (r"&(amp|lt|gt|quot|copy|middot)<", r"&\1;<"),
        (r"<[^>]+>", ""),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&copy;", "\u00a9"),
        ("&middot;", "\u00b7"),
        ("&amp;", "&"),
    ]
    for pattern, value in steps:
        column = f"regexp_replace({column}, '{pattern}', '{value}', 'gs')"
    return column


@query(
    f"""SELECT page_id, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS text_content FROM
    (SELECT page_id, list_filter(list_transform(string_split({_untagged('html')}, chr(10)),
      lambda l: trim(l)), lambda l: l <> '') AS lines FROM pages)"""
)
def html_text_lines(spark, sf):
    return shaped(html.html_text_lines(table(spark, sf, "pages")))


@query(
    """SELECT page_id, kind, headers, CAST(row_index AS BIGINT) AS row_index, cells FROM (
      SELECT page_id, 'text' AS kind, 'Text_Content' AS headers, 0 AS row_index, concat('page ', page_id) AS cells FROM pages WHERE page_id % 4 = 0
      UNION ALL SELECT page_id, 'text', 'Text_Content', 1, url FROM pages WHERE page_id % 4 = 0
      UNION ALL SELECT page_id, 'table', 'Col_1|Col_2', 0, concat('page|', page_id) FROM pages WHERE page_id % 4 = 1
      UNION ALL SELECT page_id, 'table', 'Col_1|Col_2', 1, concat('url|', url) FROM pages WHERE page_id % 4 = 1
      UNION ALL SELECT page_id, 'table', 'Col_1|Col_2', 0, concat('outerinner ', page_id, '|inner ', page_id) FROM pages WHERE page_id % 4 = 2
      UNION ALL SELECT page_id, 'largest', 'Col_1|Col_2', 0, concat('only|', page_id) FROM pages WHERE page_id % 4 = 3)"""
)
def html_frames(spark, sf):
    """Rowless, headerless and unclosed, nested, and header-only tables: each page comes out once."""
    url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    page = F.col("page_id").cast("string")
    forms = [
        F.concat(F.lit("<table></table><p>page "), page, F.lit("</p>\n"), url),
        F.concat(F.lit("<table><tr><td>page<td>"), page, F.lit("<tr><td>url<td>"), url),
        F.concat(F.lit("<table><tr><td>outer<table><tr><td>inner "), page, F.lit("</td></tr></table></td></tr></table>")),
        F.concat(F.lit("<table><tr><th>only</th><th>"), page, F.lit("</th></tr></table>")),
    ]
    chosen = F.coalesce(*[F.when(F.col("page_id") % 4 == k, form) for k, form in enumerate(forms)])
    found = html.html_frames(table(spark, sf, "pages").select("page_id", chosen.alias("html")))
    joined = {c: F.array_join(c, "|") for c in ("headers", "cells")}
    return shaped(found.withColumns(joined))


# --- text ---------------------------------------------------------------------------------

_PARTS = r"""SELECT doc_id, list_filter(list_transform(lines, lambda l: regexp_split_to_array(l, '\s{2,}|\t|,')),
      lambda p: len(p) >= 2) AS parts, lines FROM
    (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> '')
      AS lines FROM documents)"""


@query(
    f"""WITH p AS ({_PARTS}),
    h AS (SELECT doc_id, list_transform(parts[1], lambda c, i: concat('Col_', i - 1, '_', trim(c[1:12])))
      AS headers, parts[2:] AS body FROM p WHERE len(parts) >= 2),
    r AS (SELECT doc_id, headers, unnest(body) AS cells, unnest(range(0, len(body))) AS row_index FROM h)
    SELECT doc_id, row_index, array_to_string(headers, '|') AS headers,
      array_to_string(list_transform(range(1, len(headers) + 1), lambda i: coalesce(cells[i], '<null>')), '|')
        AS cells FROM r"""
)
def text_to_table(spark, sf):
    found = textlines.text_table(table(spark, sf, "documents"))
    return shaped(
        found.withColumn("headers", F.array_join("headers", "|")).withColumn(
            "cells", F.array_join("cells", "|", "<null>")
        )
    )


@query(
    f"""WITH p AS ({_PARTS})
    SELECT doc_id, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS document_line
    FROM p WHERE len(parts) < 2"""
)
def text_lines(spark, sf):
    return shaped(textlines.text_lines(table(spark, sf, "documents")))


# --- graphs ---------------------------------------------------------------------------------


def _graphs(spark, sf):
    """One DOT text per line item: a weighted, an undirected and a chained edge."""
    text = """concat('digraph { o', l_orderkey, ' -> "p', l_partkey, '" [weight=',
        cast(l_quantity as int), ', flag=', l_returnflag, '];\\n s', l_suppkey, ' -- p', l_partkey,
        '; a -> b -> c }')"""
    return table(spark, sf, "lineitem").selectExpr(
        "concat(l_orderkey, '/', l_linenumber, '/', l_partkey) as graph_id", f"{text} as dot"
    )


@query(
    """WITH l AS (SELECT concat(l_orderkey, '/', l_linenumber, '/', l_partkey) AS graph_id, * FROM lineitem)
    SELECT graph_id, CAST(1 AS BIGINT) AS edge_no, concat('o', l_orderkey) AS source_node,
      concat('p', l_partkey) AS target_node, floor(l_quantity) AS weight,
      concat('weight=', CAST(floor(l_quantity) AS BIGINT), ', flag=', l_returnflag) AS attributes FROM l
    UNION ALL SELECT graph_id, 2, concat('s', l_suppkey), concat('p', l_partkey), 1.0, 'default' FROM l
    UNION ALL SELECT graph_id, 3, 'a', 'b', 1.0, 'default' FROM l"""
)
def dot_edges(spark, sf):
    return shaped(dot.dot_edges(_graphs(spark, sf)))


def _nodes(spark, sf):
    return table(spark, sf, "part").selectExpr(
        "p_partkey as graph_id",
        """concat('p', p_partkey, ' [ label=', p_size, ' ]; "', p_type, '" []; ''b'' [brand=', p_brand,
        ']') as dot""",
    )


@query(
    r"""WITH t AS (SELECT p_partkey AS graph_id, concat('p', p_partkey, ' [ label=', p_size, ' ]; "',
      p_type, '" []; ''b'' [brand=', p_brand, ']') AS dot FROM part),
    m AS (SELECT graph_id, regexp_extract_all(dot, '(["''\w]+)\s*\[([^\]]*)\]') AS found FROM t),
    n AS (SELECT graph_id, unnest(range(1, len(found) + 1)) AS node_no, unnest(found) AS node FROM m)
    SELECT graph_id, node_no, trim(regexp_extract(node, '(["''\w]+)\s*\[([^\]]*)\]', 1), '"'' ') AS node_id,
      trim(regexp_extract(node, '(["''\w]+)\s*\[([^\]]*)\]', 2)) AS attributes FROM n"""
)
def dot_nodes(spark, sf):
    return shaped(dot.dot_nodes(_nodes(spark, sf)))


@query(
    """SELECT doc_id AS graph_id, unnest(range(1, len(lines) + 1)) AS line_no, unnest(lines) AS raw_dot
    FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS lines FROM documents
      WHERE NOT regexp_matches(text, '["''\\pL\\pN_]\\s*(->|--)\\s*["''\\pL\\pN_]')
        AND NOT regexp_matches(text, '["''\\pL\\pN_]\\s*\\[[^\\]]*\\]'))"""
)
def dot_lines(spark, sf):
    return shaped(dot.dot_lines(table(spark, sf, "documents"), "doc_id", "text"))


# --- CSV --------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def src_csv(spark, sf):
    """Write the customers as CSV, read them back with inferred types."""
    path = scratch_path(spark, "csv")
    table(spark, sf, "customer").write.mode("overwrite").option("header", True).csv(path)
    return shaped(delimited.read_csv(spark, path))


@query(
    """SELECT c_custkey AS a, CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_nationkey END AS b,
    CASE WHEN c_custkey % 10 IN (3, 5) THEN NULL ELSE c_acctbal END AS c
    FROM customer WHERE c_custkey % 10 <> 7"""
)
def src_csv_bad(spark, sf):
    """Ragged lines: one in ten too long, two in ten too short."""
    path = scratch_path(spark, "ragged")
    lines = table(spark, sf, "customer").selectExpr(
        """CASE c_custkey % 10 WHEN 3 THEN concat(c_custkey, '')
        WHEN 5 THEN concat(c_custkey, ',', c_nationkey)
        WHEN 7 THEN concat(c_custkey, ',', c_nationkey, ',', c_acctbal, ',surplus')
        ELSE concat(c_custkey, ',', c_nationkey, ',', c_acctbal) END AS `a,b,c`"""
    )
    # A separator the text never contains: the lines are written as they are.
    lines.write.mode("overwrite").option("header", True).option("sep", "\u0001").csv(path)
    return shaped(delimited.read_csv(spark, path))


@query(
    """SELECT c_custkey, concat(CASE c_custkey % 3 WHEN 0 THEN 'Zoë ' WHEN 1 THEN 'José ' ELSE '5" pipe ' END, c_name) AS label
    FROM customer"""
)
def src_csv_mixed(spark, sf):
    """A folder of UTF-8 files, Latin-1 files, and files with stray quotes."""
    path = scratch_path(spark, "mixed")
    for kind, (word, charset) in enumerate((("Zoë", "UTF-8"), ("José", "ISO-8859-1"), ('5" pipe', "UTF-8"))):
        lines = table(spark, sf, "customer").where(F.col("c_custkey") % 3 == kind)
        lines = lines.select(F.concat("c_custkey", F.lit(f",{word} "), "c_name").alias("c_custkey,label"))
        # A separator and a quote that the text never contains: lines are written as they are.
        options = {"header": True, "sep": "\u0001", "quote": "\u0002", "encoding": charset}
        lines.write.mode("append").options(**options).csv(path)
    return shaped(delimited.read_csv(spark, path))


@query(
    r"""SELECT o_orderkey, concat('No. ', o_orderkey, chr(10), '"', o_orderpriority, '", ', chr(13), chr(10), chr(10), 'status ', o_orderstatus) AS note,
    o_totalprice FROM orders"""
)
def src_csv_quoted(spark, sf):
    """Orders with notes of several lines, quotes and commas, cut into records by byte ranges."""
    path = scratch_path(spark, "quoted")
    note = F.expr("""concat('No. ', o_orderkey, '\n"', o_orderpriority, '", ', '\r\n\nstatus ', o_orderstatus)""")
    notes = table(spark, sf, "orders").select("o_orderkey", note.alias("note"), "o_totalprice")
    notes.write.options(header=True, escape='"').csv(path)
    return shaped(delimited.read_csv(spark, path))
