"""Selectors on single pages."""

import pytest
from pyspark.sql import functions as F

from mosslight.functions.selector import parse_selector, selected, selected_html

PAGE = """<html><head><title>T</title><script>var x = "<p class='a'>no</p>";</script></head><body id=main>
<!-- <p class="a">no</p> --><div class="a b"><p>one<p class='a'>two<b>bold</b></div><ul><li>x<li>y<ul><li class=a>z</ul></ul>
<div><div class="a"><div class="a">inner</div></div><img src="i.png" class="a"></div><p data-x="1, 2">last"""


@pytest.mark.parametrize(
    "css, want",
    [
        ("title", ["<title>T</title>"]),
        ("p", ["<p>one", "<p class='a'>two<b>bold</b>", '<p data-x="1, 2">last']),
        ("p.a", ["<p class='a'>two<b>bold</b>"]),
        (".a.b > p", ["<p>one", "<p class='a'>two<b>bold</b>"]),
        ("#main > ul > li", ["<li>x", "<li>y<ul><li class=a>z</ul>"]),
        ("li li", ["<li class=a>z"]),
        ("ul > ul", []),
        ("div .a", ["<p class='a'>two<b>bold</b>", '<div class="a"><div class="a">inner</div></div>', '<img src="i.png" class="a">']),
        ("body .a .a", ["<p class='a'>two<b>bold</b>", '<div class="a">inner</div>']),
        ("img, [data-x='1, 2'], b", ["<b>bold</b>", '<img src="i.png" class="a">', '<p data-x="1, 2">last']),
        ("nothing", []),
    ],
)
def test_selected(css, want):
    assert [x.strip() for x in selected(PAGE, parse_selector(css))] == want


@pytest.mark.parametrize("css", ["", "a >", "a:hover", "a + b", ","])
def test_unknown_selectors(css):
    with pytest.raises(ValueError, match="selector"):
        parse_selector(css)


def test_column(spark):
    rows = spark.createDataFrame([(1, PAGE), (2, ""), (3, None), (4, "<p>a</p></div></p><p>b")], "id int, html string")
    got = {r.id: r.x for r in rows.select("id", selected_html(F.col("html"), "p").alias("x")).collect()}
    assert got[2] == "" and got[3] is None and got[4] == "<p>a</p> <p>b"
