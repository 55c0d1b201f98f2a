"""Pages to text: unclosed elements, references, order of opening."""
from html import unescape

import pytest
from pyspark.sql import functions as F

from evidloom.bounds import local_table
from evidloom.functions import text as tx

PAGES = {
    "<p>caf&eacute; &#8217;s &#x27;x&#X27; &nbsp;end</p>": "café ’s 'x' end",
    "a<script>var x = '<style>';": "a",
    "a<script>x</script>b<style>/* <script> */</style>c": "a b c",
    "a<!-- <script> -->b<!-- open": "a b",
    "&amp;lt; &unknown; &#0; &#xD800; &#1114112; &#128512; &amp;": "&lt; &unknown; � � � 😀 &",
    "<NAV class=x>menu</NAV >text<aside>more": "text",
    "plain": "plain", "": "", "<p></p>": "", "x & y &; &#; &#x;": "x & y &; &#; &#x;",
}


def test_pages(spark):
    df = local_table(spark, [(k, p) for k, p in enumerate([*PAGES, None])], "id int, html string")
    got = {r.id: r.t for r in df.select("id", tx.html_to_text(F.col("html")).alias("t")).collect()}
    assert got == {**dict(enumerate(PAGES.values())), len(PAGES): None}


@pytest.mark.parametrize("many", [3_000])
def test_references_as_the_standard_library_decodes_them(spark, many):
    text = " ".join([*tx.NAMED, "&#233;", "&#x1F600;", "&Eacute;x"] * (many // 250))
    df = local_table(spark, [(1, text)], "id int, t string")
    assert df.select(tx.decode_references(F.col("t")).alias("t")).first()["t"] == unescape(text)
