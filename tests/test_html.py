"""The HTML tokenizer against another parser, on written cases and on damaged pages."""

import os
import random
import re
import subprocess
import sys
from html import unescape
from html.parser import HTMLParser

import duckdb
import pytest

from sheafline.functions import html as H

DATA = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("a<b>c", [("text", "a"), ("start", "b", {}), ("text", "c")]),
        ("1 < 2 <3 <", [("text", "1 < 2 <3 <")]),
        ("<A HREF='x>y' B=\"&lt;'\" c=d/ href=2>t</a >", [("start", "a", {"href": "x>y", "b": "<'", "c": "d/"}), ("text", "t"), ("end", "a")]),
        ("<br/><img src=a/><p / x>", [("start", "br", {}), ("start", "img", {"src": "a/"}), ("start", "p", {"x": ""})]),
        ("<a\n=b c = d>", [("start", "a", {"=b": "", "c": "d"})]),
        ("<!-- a > b --><!--><!---><!-- c --!>x<!-- open > here", [("comment", " a > b "), ("comment", ""), ("comment", ""), ("comment", " c "), ("text", "x"), ("comment", " open > here")]),
        ("<!DOCTYPE HTML PUBLIC 'x'><?php a ?>b</>c</ d><![CDATA[e]]>", [("doctype", "html"), ("comment", "?php a ?"), ("text", "b"), ("text", "c"), ("comment", " d"), ("comment", "[CDATA[e]]")]),
        ("<script>if (a<b && '</p>') {}</scripts></SCRIPT\n>&amp;", [("start", "script", {}), ("text", "if (a<b && '</p>') {}</scripts>"), ("end", "script"), ("text", "&")]),
        ("<title>a<b>&amp;</title><style>&amp;", [("start", "title", {}), ("text", "a<b>&"), ("end", "title"), ("start", "style", {}), ("text", "&amp;")]),
        ("&notit; &NotEqualTilde;&#x80;&#65;&#65 &#0;&bogus;&copy", [("text", "¬it; ≂̸€AA \ufffd&bogus;©")]),
        ("<a b='&copy=1&copyx&copy;=&ltx=&lt &#65;'>", [("start", "a", {"b": "&copy=1&copyx©=&ltx=< A"})]),
        ("x<p", [("text", "x")]),
        ("x<p a='b>", [("text", "x")]),
        ("x</p a", [("text", "x")]),
        ("<ÄX></ä><aÄ>", [("text", "<ÄX>"), ("comment", "ä"), ("start", "aÄ", {})]),
        ("<plaintext><b>&amp;", [("start", "plaintext", {}), ("text", "<b>&amp;")]),
    ],
)
def test_tokens(page, want):
    got = [(t.kind, *([t.text] if t.kind in ("text", "comment") else [t.name] + ([t.attributes] if t.kind == "start" else []))) for t in H.tokens(page)]
    assert got == want


def test_tags_that_close_themselves():
    assert [t.closed for t in H.tokens("<a/><a b=c/><a b='c'/><a /><a/ ><a>")] == [True, False, True, True, False, False]


class Other(HTMLParser):
    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.found = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.found.append(("start", tag, first))

    def handle_endtag(self, tag):
        self.found.append(("end", tag))

    def handle_data(self, data):
        if self.found and self.found[-1][0] == "text":
            self.found[-1] = ("text", self.found[-1][1] + data)
        else:
            self.found.append(("text", data))

    def handle_comment(self, data):
        self.found.append(("comment", data))

    def handle_decl(self, decl):
        self.found.append(("doctype", decl.split()[1].lower()))


@pytest.mark.skipif(not os.path.exists(DATA), reason="no tables")
def test_pages_against_another_parser():
    pages = [r[0] for r in duckdb.connect().execute(f"SELECT html FROM '{DATA}'").fetchall()]
    for page in pages:
        whole = page[: page.rindex(">") + 1]  # what follows the last tag is cut off anywhere
        got = [("text", t.text) if t.kind == "text" else ("comment", t.text) if t.kind == "comment" else (t.kind, t.name, t.attributes) if t.kind == "start" else (t.kind, t.name) for t in H.tokens(whole)]
        assert got == Other(whole).found


def test_damaged_pages_lose_no_text():
    """Whatever a page is cut and mixed from: tokens end, and text outside markup is all there."""
    rng = random.Random(8)
    pieces = ["<p>", "</p>", "<a href='x", "'>", '"', ">", "<", "&amp;", "&", "&#", "<!--", "-->", "<script>", "</script>", "<title>", "</title>", "word ", "=", "/", "é😀", "\n", "<b c=d>", "\x00"]
    for _ in range(3000):
        page = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        found = list(H.tokens(page))
        assert all(t.kind in ("text", "start", "end", "comment", "doctype") for t in found)
        assert not any(a.kind == b.kind == "text" for a, b in zip(found, found[1:], strict=False) if "</>" not in page) or "<script" in page or "<title" in page
        if "<" not in page:
            assert [t.text for t in found] == ([unescape(page)] if page else [])


def test_long_pages_take_linear_time():
    import time

    took = []
    for n in (20_000, 80_000):
        pages = ["<" * n, "<p a=" * n, "<!--" * n, "&a" * n, "<p a='b'>x" * n, "<script></scrip" * n, "<a " + "b " * n + ">", "</" * n]
        began = time.perf_counter()
        for page in pages:
            for _ in H.tokens(page):
                pass
        took.append(time.perf_counter() - began)
    assert took[1] < 8 * took[0] + 0.5


def test_text_of_pages(spark):
    page = "<head><title>T</title><style>p{}</style></head><body>a  <b>b</b>\n c<br>d<p>e&nbsp;f</p><script>x</script>g<ul><li>h<li>i</ul><!-- j --></body>"
    assert H.visible(page) == "a b c\nd\ne\xa0f\ng\nh\ni"
    assert H.content(page) == "Tp{}a  b\n cde\xa0fxghi"
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    assert [tuple(r) for r in df.select("page_id", H.visible_text(df["html"]), H.text_content(df["html"])).orderBy("page_id").collect()] == [(1, H.visible(page), H.content(page)), (2, None, None), (3, "", "")]
    rows = H.html_tokens(df.selectExpr("*", "1 AS pos"), "html", "page_id").orderBy("pos").collect()
    assert {r["page_id"] for r in rows} == {1} and [r["pos"] for r in rows] == list(range(len(rows)))
    assert [(r["kind"], r["name"], r["text"], r["attributes"] or None) for r in rows] == [(t.kind, t.name, t.text, t.attributes or None) for t in H.tokens(page)]
    assert H.html_tokens(df.limit(0), "html", "page_id").count() == 0


def test_small_dialect_is_part_of_it(spark):
    from pyspark.sql import functions as F

    from sheafline.functions import text as T

    texts = ["a<b>x</b> &lt;i&gt; &quot;q&quot; &#039;s&#039; &amp;amp;", "<!-- c --><i>y</i><br>z"]
    df = spark.createDataFrame([(t,) for t in texts], "h string")
    assert [tuple(r) for r in df.select(T.plain_text(F.col("h")), H.text_content(F.col("h"))).collect()] == [(re.sub("<!--.*?-->|<[^>]*>", "", t).replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&#039;", "'").replace("&amp;", "&"),) * 2 for t in texts]


def test_page_text_is_the_first_query_of_a_session(tmp_path):
    """Workers import nothing but what a session ships: no other query has done so before."""
    code = "import sys; sys.path.insert(0, sys.argv[1])\nfrom sheafline.session import local_session\nfrom sheafline.functions import html as H\nspark = local_session(1, 1)\nframe = spark.createDataFrame([('<p>a&amp;b</p>',)], 'h string')\nprint(frame.select(H.text_content(frame['h']), H.visible_text(frame['h'])).first())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert done.stdout.count("a&b") == 2


def test_a_reference_does_not_reach_over_a_tag():
    """As in pages 43 and 1157 of sf0.1: a title cut inside a reference, and a style after it."""
    assert H.content("<title>a&am</title><style>p{margin:0}</style>&am<b>p;</b>") == "a&amp{margin:0}&amp;"
