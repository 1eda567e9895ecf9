import html
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from tidemark.functions import markup as mk
from tidemark.functions import text as tx

# page, its text
PAGES = [
    ('<p title="a > b">x</p>y', "x\ny"),
    ("<img alt='<p>' >k", "k"),
    ('<a b = ">" c>w', "w"),
    ('<a"b>">v', '">v'),
    ("<a href=x/>y</a>", "y"),
    ("<br/>q<br>r<div/>s", "q\nr\n\ns"),
    ('<script>if (a<b) "</p>" <!-- c --></script>z', "z"),
    ("<script>x = '</scripts>';</SCRIPT\n>z", "z"),
    ("<style>a>b{}</style >s", "s"),
    ("<title>a <b> &amp; c</title>", "a <b> & c"),
    ("<textarea><p>&lt;</textarea>t", "<p><t"),
    ("<!-- a > b -->c<!--> d<!-- e --!> f", "c d f"),
    ("<!doctype html><?xml version='1'?>g", "g"),
    ("1 < 2 and 3<4 <", "1 < 2 and 3<4 <"),
    ("&#65;&#x42;&#X43 &eacute;&hellip;", "ABC é…"),
    ("&amp;lt; &lt;b&gt; &unknown; & &; &#; &#x;", "&lt; <b> &unknown; & &; &#; &#x;"),
    ("&copy 5 &notit; &notin;", "© 5 ¬it; ∉"),
    ("&#128; &#0; &#xD800; &#99999999999;", "€ � � �"),
    ("a&nbsp; b\t\tc\n\n\n\n\nd", "a b c\n\nd"),
    ("x</ y>z</", "xz</"),
    ("<p", ""), ("a<b c='d", "a"), ("a<!-- b", "a"), ("a<script>b", "a"),
    ("", ""), ("  \n ", ""),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_pages(page, text):
    assert mk.read(page) == text


def test_every_named_reference():
    wrong = [n for n in html5 if mk.read(f"x&{n}y") != mk.read("x" + html.escape(html.unescape(f"&{n}")) + "y") and n.endswith(";")]
    assert wrong == []
    # without the semicolon the longest old name counts
    assert all(mk.read(f"[&{n} ]") == mk.read(f"[{html.escape(html5[n])} ]") for n in html5 if not n.endswith(";"))


def test_agrees_with_builtins_on_simple_markup(spark):
    simple = "<html><head><style>p{}</style></head><body><h1>T &amp; x</h1><p>one<br/>two</p>\n\n\n<div>a <b>b</b></div></body></html>"
    row = spark.createDataFrame([(simple,), (None,)], "h string").select(mk.page_text("h").alias("a"), tx.html_text(F.col("h")).alias("b")).collect()
    assert row[0]["a"] == row[0]["b"] == "T & x\n\none\n\ntwo\n\na b" and row[1]["a"] is None


def test_long_page_is_read_whole():
    part = '<p a="1>2">w&amp;<!-- c --></p>'
    assert mk.read(part * 50_000).count("w&") == 50_000


def test_references_without_semicolon_stay_text_where_asked(spark):
    page = "<title>a&amp;&amp</title><p>&copy; &copy &#65; &#65 &lt"
    assert mk.read(page) == "a&&\n© © A A <"
    assert mk.read(page, bare=False) == "a&&amp\n© &copy A &#65 &lt"
    assert spark.createDataFrame([(page,)], "h string").select(mk.page_text("h", bare=False)).first()[0] == mk.read(page, bare=False)
    assert spark.createDataFrame([("<p>&amp</p>",)], "html string").select(mk.page_text("html")).first()[0] == "&"


def test_query_reads_cut_references_as_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from workload import text_queries

    pages = [(1, "<title>ab&amp;&amp</title><p>x &lt;b&gt; &nbsp;</p>"), (2, "<h1>c &copy; &middot; &am</h1>d")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    from workload.common import ORACLES

    got = text_queries.page_text(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(ORACLES["page_text"]).fetchall())
