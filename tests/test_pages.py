import json

import pytest
from pyspark.sql import functions as F

from quire import schemas
from quire.acceptance import inputs as I
from quire.operators import layout
from quire.profiles import OUTLINE_PROFILE, SECTION_PROFILE
from quire.sources import pages as P
from tests.conftest import SMALL


def span(text, size=10.0, font="Times", flags=0, x=0.0):
    return (text, size, font, flags, [x, 0.0, x, 0.0])


def line(top, *spans, bottom=None):
    return ([5.0, top, 90.0, top + 10.0 if bottom is None else bottom], list(spans))


def block(top, *lines, kind=0):
    return (kind, [0.0, top, 100.0, top], list(lines) or None)


TREES = [
    ("two", 1, 800.0, [
        block(50.0, line(50.0, span("second "), span("line", 10.0))),
        block(10.0, line(10.0, span("AB", 12.0, "Arial"), span("CD", 9.0, "Times-BOLD"), span("EF", 9.0, "Arial"))),
        block(5.0, kind=1),
    ]),
    ("two", 2, 800.0, []),
    ("ties", 1, 800.0, [block(0.0, line(0.0, span("a", 9.0), span("b", 11.0, flags=16)), line(30.0, span("   ")))]),
    ("odd", 1, 100.0, [block(0.0, line(0.0, span(" \x01 1.2 x\x07y ")), line(40.0, bottom=50.0), line(60.0, span("tiny", 2.0)))]),
    ("none", 1, 100.0, None),
]


@pytest.fixture(scope="module")
def trees(spark):
    return spark.createDataFrame(TREES, schemas.PAGE_TREE)


def test_reading_order_mode_and_bold(trees, rows):
    got = rows(P.lines_from_page_trees(trees), "doc", "page_number", "text", "font_size", "font_name", "is_bold", "y_position")
    assert got == sorted([
        ("two", 1, "ABCDEF", 9.0, "Arial", 1, 10.0),
        ("two", 1, "second line", 10.0, "Times", 0, 50.0),
        ("ties", 1, "ab", 9.0, "Times", 1, 0.0),
        ("odd", 1, " 1.2 xy", 10.0, "Times", 0, 0.0),
        ("odd", 1, "tiny", 2.0, "Times", 0, 60.0),
    ], key=repr)


def test_second_profile_keeps_order_and_controls(trees, rows):
    lines = P.lines_from_page_trees(trees, SECTION_PROFILE)
    assert "is_prev_line_blank" not in lines.columns
    got = rows(lines.filter("doc = 'two'").orderBy("line_no"), "line_no", "text")
    assert got == [(0, "second line"), (1, "ABCDEF")]
    odd = lines.filter("doc = 'odd'").orderBy("line_no").first()
    assert odd.text == "\x01 1.2 x\x07y" and odd.starts_with_number == 0


def test_layout_features(trees):
    first, second = P.lines_from_page_trees(trees).filter("doc = 'two'").orderBy("line_no").collect()
    assert first.body_size == second.body_size == 9.0
    assert (first.relative_font_size, second.relative_font_size) == (1.0, 1.111)
    assert (first.is_prev_line_blank, first.is_next_line_blank) == (0, 1)
    assert (second.is_prev_line_blank, second.is_next_line_blank) == (1, 1)
    assert (first.font_size_diff_prev, first.font_size_diff_next, second.font_size_diff_prev) == (0.0, -1.0, 1.0)
    tiny = P.lines_from_page_trees(trees).filter("text = 'tiny'").first()
    assert tiny.body_size == 10.0


def test_small_sizes_only(spark):
    tree = [("d", 1, 100.0, [block(0.0, line(0.0, span("a", 3.0)))])]
    df = spark.createDataFrame(tree, schemas.PAGE_TREE)
    assert P.lines_from_page_trees(df).first().body_size == 12.0
    assert P.lines_from_page_trees(df, SECTION_PROFILE).first().body_size == 3.0


def test_spans_and_page_counts(trees, rows):
    got = rows(P.spans_from_page_trees(trees).filter("doc = 'ties'"), "text", "font_size", "is_bold", "word_count")
    assert got == [("a", 9, 0, 1), ("b", 11, 0, 1)]
    assert rows(P.page_counts(trees)) == [("none", 1), ("odd", 1), ("ties", 1), ("two", 2)]


def test_page_rows_and_windows_agree(spark, rows):
    fused = P.feature_lines(I.text_pages(spark, SMALL))
    plain = I.plain_lines(spark, SMALL)
    columns = ["doc", "page_number", "line_no"]
    sizes = ["body_size", "relative_font_size"]
    near = ["font_size_diff_prev", "is_prev_line_blank", "font_size_diff_next", "is_next_line_blank"]
    assert rows(fused, *columns, *sizes) == rows(layout.with_body_size(plain), *columns, *sizes)
    assert rows(fused, *columns, *near) == rows(layout.neighbor_features(plain), *columns, *near)
    per_page = fused.select("doc", "page_number", "body_size").distinct()
    assert rows(per_page) == rows(layout.body_size(plain))


def test_text_lines(spark, rows):
    docs = spark.createDataFrame([(1, "a\n\n  b \n" + "x\n" * 40), (2, ""), (3, None)], "id int, text string")
    lines = P.lines_from_text(docs, "id", "text")
    got = rows(lines, "doc", "page_number", "line_no", "text")
    assert got[:2] == [("1", 1, 0, "a"), ("1", 1, 10, "x")]
    assert len(got) == 42 and ("1", 1, 2, "b") in got and ("1", 2, 2, "x") in got


def test_html(spark, rows):
    page = (
        "<html><head><title>T &amp; U</title><script>var a='<p>no</p>';</script></head><body><!-- <p>no</p> -->loose &copy; &#8364;&#x41;&#0;"
        "<H1 class=x>Head<br/>two</H1><p><b>Bold</b> and&nbsp;more<br>x<p>open<li>item</li><pre>kept</pre>"
        "<table><tr><td>one</td><td>two</td></tr></table><div>in <i>a</i> div</div> after</body></html>"
    )
    df = spark.createDataFrame([(7, page), (8, None), (9, "")], "page_id int, html string")
    lines = P.lines_from_html(df).orderBy("line_no").collect()
    assert [(r.tag, r.text, r.font_size, r.is_bold) for r in lines] == [
        ("title", "T & U", 30.0, 1), ("body", "loose © €A&#0;", 12.0, 0), ("h1", "Head", 24.0, 1), ("h1", "two", 24.0, 1),
        ("p", "Bold and more", 12.0, 1), ("p", "x", 12.0, 0), ("p", "open", 12.0, 0), ("li", "item", 12.0, 0), ("pre", "kept", 12.0, 0),
        ("td", "one", 12.0, 0), ("td", "two", 12.0, 0), ("div", "in a div", 12.0, 0), ("body", "after", 12.0, 0),
    ]
    assert [r.line_no for r in lines] == list(range(13)) and {r.doc for r in lines} == {"7"}
    featured = P.feature_lines(P.pages_from_html(df)).orderBy("line_no").collect()
    assert [r.text for r in featured] == [r.text for r in lines] and featured[2].relative_font_size == 2.0


def test_bad_pages_are_set_aside(spark, tmp_path, rows):
    good = {"doc": "a", "page_number": 1, "page_height": 10.0, "blocks": []}
    (tmp_path / "pages.jsonl").write_text(json.dumps(good) + "\n{broken\n" + json.dumps({"page_number": 2}) + "\n")
    found, bad = P.read_page_trees(spark, str(tmp_path))
    assert rows(found, "doc", "page_number") == [("a", 1)]
    assert bad.count() == 2 and {r.file for r in bad.collect()} == {"pages.jsonl"}


def test_corpus_listing(spark, tmp_path, rows):
    (tmp_path / "b.pdf").write_text("12345")
    (tmp_path / "a.txt").write_text("x")
    listed = P.list_corpus(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in listed.collect()] == [("b.pdf", 5)]


def test_align(spark):
    df = spark.createDataFrame([(1, "x")], "word_count int, text string")
    aligned = layout.align_features(df, ["text", "x_position", "word_count"])
    assert aligned.columns == ["text", "x_position", "word_count"] and aligned.first().x_position == 0
