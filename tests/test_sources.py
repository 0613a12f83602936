import time

import pytest

from tablewright.plans.cleaning_plan import CleaningPlan, ColumnDecision, run
from tablewright.sources import delimited, dot, html, sinks, textlines

from tests.helpers import rows


def csv(tmp_path, text, encoding="utf-8"):
    path = tmp_path / "t.csv"
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_long_rows_skip_and_short_rows_pad(spark, tmp_path):
    df = delimited.read_csv(spark, csv(tmp_path, "a,b,c\n1,2,3\n4,5\n6,7,8,9\n1,2,3,4,5\n\n7\n"))
    assert rows(df) == [(1, 2, 3), (4, 5, None), (7, None, None)]
    assert rows(df.select("b")) == [(2,), (5,), (None,)]


def test_types_are_inferred_but_dates_stay_text(spark, tmp_path):
    text = "i,f,b,t,d,e\n1,1.5,True,x,2024-01-05,\n,NA,false,y,2024-01-06,\n3,2,TRUE,7,2024-01-07,\n"
    df = delimited.read_csv(spark, csv(tmp_path, text))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "boolean", "string", "string", "double"]
    assert df.where("i is null").first()["f"] is None


def test_latin_text_and_quoted_line_breaks(spark, tmp_path):
    df = delimited.read_csv(spark, csv(tmp_path, "a,b\ncafé,1\n", "latin1"))
    assert rows(df) == [("café", 1)]
    df = delimited.read_csv(spark, csv(tmp_path, 'a,b\n"two\nlines",1\n"say ""hi""",2\n'))
    assert rows(df) == [('say "hi"', 2), ("two\nlines", 1)]


def test_every_file_is_read_with_its_own_header(spark, tmp_path):
    files = {"a": "x,y\n1,2\n3,4\n", "b": "\nx,y,z\n5,6,7\n", "c": "y,x\n8,9\n", "d": "x,y\n10,11\n", "e": "\n \n"}
    files |= {"f": 'x,"y\n1"\n12,13\n', "g": 'x,"y\n2"\n14,15\n'}
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    for given in ({}, {"encoding": "UTF-8", "multi_line": True}):
        df = delimited.read_csv(spark, str(tmp_path), **given)
        found = {r.x: (r.y, r.z, r["y\n1"], r["y\n2"]) for r in df.collect()}
        no = None
        assert found == {
            1: (2, no, no, no), 3: (4, no, no, no), 5: (6, 7, no, no), 9: (8, no, no, no), 10: (11, no, no, no),
            12: (no, no, 13, no), 14: (no, no, no, 15),
        }


def pages(frame, *texts):
    return frame("page_id int, html string", *enumerate(texts))


def test_html_tables(frame):
    df = pages(
        frame,
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td> 2 </td></tr><tr><td>x</td></tr></table>",
        "<table><tr><td>1</td><td>2</td></tr></table>",
        "<table><tr><th>h</th></tr></table><table><tr><td>&amp;<b>q</b></td></tr></table>",
        "<p>none</p>",
        None,
    )
    found = html.html_tables(df).select("page_id", "table_index", "headers", "cells")
    assert rows(found) == [
        (0, 0, ["a", "b"], ["1", "2"]), (1, 0, ["Col_1", "Col_2"], ["1", "2"]), (2, 1, ["Col_1"], ["&q"]),
    ]


def test_nested_tables_belong_to_the_outer_table_too(frame):
    df = pages(frame, "<table><tr><td>x<table><tr><td>y</td></tr></table></td></tr></table>")
    found = html.html_tables(df).select("headers", "cells")
    assert rows(found) == [(["Col_1", "Col_2"], ["xy", "y"])]


def test_largest_table(frame):
    df = pages(frame, "<table><tr><th>a</th></tr></table><table><tr><th>a</th><th>b</th></tr></table>")
    row = html.html_largest_table(df).first()
    assert (row["table_index"], row["n_rows"], row["n_columns"]) == (1, 1, 2)


def test_html_lines_without_hidden_text(frame):
    page = "<html><head><style>p{}</style><script>x()</script></head><body> a \n\n<p>b&nbsp;c</p>\n</body>"
    df = pages(frame, page, "<table><tr><td>1</td></tr></table>\nno", "one\ntwo\nthree")
    assert rows(html.html_text_lines(df)) == [
        (0, 1, "a"), (0, 2, "b c"), (2, 1, "one"), (2, 2, "two"), (2, 3, "three"),
    ]
    assert html.html_text_lines(df, max_lines=1).count() == 2


def test_character_references(frame):
    page = "a&amp;b &copy; &#65;&#x42; &unknown; c&amp<i>d</i> &ampere"
    assert rows(html.html_text_lines(pages(frame, page))) == [(0, 1, "a&b © AB &unknown c&d &ampere")]


def test_text_table(frame):
    df = frame("doc_id int, text string", (1, "name,qty\na,1\nb\nc,2,9\nd  4\r\ne,"), (2, "x\ny"), (3, "h,i"))
    found = textlines.text_table(df).select("doc_id", "headers", "cells")
    head = ["Col_0_name", "Col_1_qty"]
    assert rows(found) == [
        (1, head, ["a", "1"]), (1, head, ["c", "2"]), (1, head, ["d", "4"]), (1, head, ["e", ""]),
    ]
    assert rows(textlines.text_lines(df)) == [(2, 1, "x"), (2, 2, "y"), (3, 1, "h,i")]
    wide = frame("doc_id int, text string", (1, "a,b,c\n1,2"))
    assert textlines.text_table(wide).first()["cells"] == ["1", "2", None]


def test_dot_graphs(frame):
    df = frame(
        "graph_id int, dot string",
        (1, 'a -> b [weight=5]; c -- d'),
        (2, "a -> b -> c"),
        (3, '"x"->"y" [label="w [1", weight = 2.5 ]'),
        (4, "n1 [label=x]\nn2 []"),
        (5, "free text\nonly\n"),
        (6, "p -> q [weight=1.2.3]"),
    )
    assert rows(dot.dot_edges(df).drop("edge_no")) == [
        (1, "a", "b", 5.0, "weight=5"), (1, "c", "d", 1.0, "default"), (2, "a", "b", 1.0, "default"),
        (3, "x", "y", 2.5, 'label="w [1", weight = 2.5'), (6, "p", "q", 1.0, "weight=1.2.3"),
    ]
    assert rows(dot.dot_nodes(df).drop("node_no")) == [(4, "n1", "label=x"), (4, "n2", "")]
    assert rows(dot.dot_lines(df)) == [(5, 1, "free text"), (5, 2, "only")]


def test_audit_rows_replace_their_own_dataset_only(frame, spark, tmp_path):
    df = frame("a int, b string", (1, "x"), (None, "y"))
    plan = CleaningPlan((ColumnDecision("a", "fill", "mode"), ColumnDecision("b")))
    audit, path = run(df, plan).audit, str(tmp_path / "audit")
    sinks.write_audit(audit, path, "one")
    sinks.write_audit(audit, path, "two")
    sinks.write_audit(audit.where("step_number = 1"), path, "one")
    assert sinks.read_audit(spark, path, "one").count() == 1
    assert [r["step_number"] for r in sinks.read_audit(spark, path, "two").collect()] == [1, 2]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_current_table_prefers_the_cleaned_one(frame, spark, tmp_path, fmt):
    raw, cleaned = str(tmp_path / "raw.parquet"), str(tmp_path / f"cleaned.{fmt}")
    sinks.write_clean(frame("a int", (1,), (2,)), raw)
    assert sinks.current_table(spark, raw, cleaned).count() == 2
    sinks.write_clean(frame("a int", (1,)), cleaned, fmt)
    assert rows(sinks.current_table(spark, raw, cleaned)) == [(1,)]


def test_cells_and_rows_without_end_tags(frame):
    df = pages(frame, "<table><tr><th>a<th>b<tr><td>1<td><b>2<tr><td>3<td>4<table><tr><td>5</table></table><ul><li>x<li>y</ul>")
    found = html.scanned_tables(df).first()["tables"]
    assert found[0]["headers"] == ["a", "b"] and found[0]["td_rows"] == [["1", "2"], ["3", "45", "5"], ["5"]]


def test_many_unclosed_tags_take_linear_time():
    for page in ("<p>a" * 20_000, "<table>" + "<tr><td>a" * 20_000, "<li>a" * 20_000, "<td>a" * 20_000, "<b>a" * 20_000):
        start = time.perf_counter()
        html._page(page)
        assert time.perf_counter() - start < 1


def test_each_page_once(frame):
    df = pages(
        frame, "<table></table><p>hello</p>\nyou", "<table><tr><th>h</th></tr></table>", "<table><tr><td>1</td></tr></table>", "", None,
        "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td></tr></table>",
    )
    found = html.html_frames(df).select("page_id", "kind", "headers", "row_index", "cells")
    assert rows(found) == [
        (0, "text", ["Text_Content"], 0, ["hello"]), (0, "text", ["Text_Content"], 1, ["you"]),
        (1, "largest", ["Col_1"], 0, ["h"]), (2, "table", ["Col_1"], 0, ["1"]),
        (5, "largest", ["Col_1", "Col_2"], 0, ["a", "b"]), (5, "largest", ["Col_1", "Col_2"], 1, ["1"]),
    ]
    assert rows(html.html_text_lines(df)) == [(0, 1, "hello"), (0, 2, "you")]
