"""TXT9 against an independent stdlib HTML-parser extraction on real pages."""

import html
import random
from html.entities import html5
from html.parser import HTMLParser

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from marketmap.constants import DROPPED_HTML_TAGS, VOID_HTML_TAGS
from marketmap.functions.text import decode_references, html_text
from tests.conftest import SF_MID


class _Text(HTMLParser):
    """Open elements on a stack: an end tag closes the nearest of its name and all inside it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = []
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag not in VOID_HTML_TAGS:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if data.strip() and not set(self.stack) & set(DROPPED_HTML_TAGS):
            self.parts.append(data.strip())


def reference_text(html: str) -> str:
    p = _Text()
    p.feed(html)
    p.close()
    return " ".join(" ".join(p.parts).split())


def test_html_text_matches_parser(spark):
    pages = pq.read_table(f"{SF_MID}/pages.parquet").to_pandas()
    got = spark.read.parquet(f"{SF_MID}/pages.parquet") \
        .select("page_id", html_text("html").alias("t")).toPandas()
    by_id = dict(zip(got.page_id, got.t))
    bad = [pid for pid, h in zip(pages.page_id, pages.html) if by_id[pid] != reference_text(h)]
    assert not bad, f"{len(bad)} pages differ, e.g. {bad[:5]}"


def test_html_edge_cases(spark):
    cases = [
        "<p>a<b>b</b>c</p>",
        "<script>var x = '</p>';</script><p>kept</p>",
        "<nav><a>menu</a></nav><!-- note --><p>x &amp;lt; y &copy; 2024</p>",
        "<header>top</header><main>body &quot;q&quot;</main><footer>bottom</footer>",
        "<title>T</title><NOSCRIPT>js</NOSCRIPT><p>a&ampb</p>",
    ]
    df = spark.createDataFrame([(c,) for c in cases], "h string")
    got = [r["t"] for r in df.select(html_text("h").alias("t")).collect()]
    assert got == [reference_text(c) for c in cases]


def both(spark, cases):
    df = spark.createDataFrame(list(enumerate(cases)), "i int, h string")
    got = [r["t"] for r in df.select("i", html_text("h").alias("t")).orderBy("i").collect()]
    return got, [None if c is None else reference_text(c) for c in cases]


def test_dropped_elements_end_with_their_parent(spark):
    got, want = both(spark, [
        "<div><nav><a>m</a></div><p>kept text</p>",
        "<nav>a<nav>b</nav>c</nav>d", "<nav>a<header>b</nav>c</header>d", "x</nav>y", "<nav>to the end<p>of the page",
        "<div><header>h<div>in</div>still</div>out", "<NAV class='a > b'>m</Nav >k", "<nav/>kept<br/>on", "<nav><br>m<img src=x></nav>k",
        "<section><footer>f<section>g</section>h</section>i", "<navy>kept</navy>", "<p>a < b and c</p>", "</>x</ 3>y",
        "<script>'<nav>'</script>k<style>nav{}</style><nav>m", "<nav><script>'</nav>'</script>m</nav>k", "<!-- <nav> -->k",
        "<noscript><p>n</div></noscript>k", "<div><nav></p></span>m</div>k", "", None, "plain", "<nav></nav>"])
    assert got == want
    assert got[0] == "kept text"


def test_random_nesting_matches_parser(spark):
    rng = random.Random(7)
    tags = ["div", "p", "nav", "header", "b", "section", "footer", "noscript"]
    cases = []
    for _ in range(400):
        parts = []
        for i in range(rng.randrange(1, 40)):
            t = rng.choice(tags)
            parts.append(rng.choice([f"<{t}>", f"</{t}>", f"</{t}>", f"<{t} class='x'>", f" w{i} ", "<br>", "&eacute;", f"<{t}/>", "<!-- c -->"]))
        cases.append("".join(parts))
    got, want = both(spark, cases)
    assert got == want


def test_character_references(spark):
    cases = ["&" + n for n in html5] + [f"a&{n}b" for n in html5 if not n.endswith(";")] + [
        f"x&#{n};y" for n in [0, 1, 8, 9, 10, 12, 13, 31, 39, 65, 127, 128, 129, 153, 159, 160, 163, 8217, 55296, 57343, 64976, 65533,
                              65534, 65535, 128512, 1114109, 1114111, 1114112, 99999999, 10 ** 30]] + [
        "&#x2019;", "&#X20ac", "&#x1F600;&#x1f600", "&#xFFFFFFFFFFFFFFFFFFFF;", "&#00000000039;", "&#x;", "&#;", "&", "&&amp;&", "&amp;lt;",
        "&notit;", "&unknown;", "&pound;5 &#8217; &eacute;", "a&b=c&copy=1&lt", "&amp" * 50, "", None, "none"]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, h string")
    got = [r["t"] for r in df.select("i", decode_references("h").alias("t")).orderBy("i").collect()]
    assert got == [None if c is None else html.unescape(c) for c in cases]
