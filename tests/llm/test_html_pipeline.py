import html
import re
import time

import pytest

import corpus_pipeline
from marketmap.llm import html_extract, near_dedup
from tests.conftest import SF_SMALL

WORDS = "Plain words of a paragraph, long enough to count, with commas, and more of them to be sure. " * 2


def page(body):
    return f"<html><head><title>T</title><script>var a='<p>no</p>';</script></head><body>{body}</body></html>"


@pytest.mark.parametrize("markup,want", [
    (None, ""), ("", ""), ("<p", ""), ("just text & more", "just text & more"),
    (page(f"<nav><a href=x>Menu</a></nav><article><h1>Head</h1><p>{WORDS}<p>Two &amp; &eacute;\n  three<br>four</article><footer>Foot</footer>"),
     f"Head\n\n{WORDS.strip()}\n\nTwo & é three four"),
    (page(f"<div class='sidebar'><p>{WORDS}</p></div><div id=content><p>{WORDS}</p><p>Of.</p></div><div class=comments><p>{WORDS}</p></div>"),
     f"{WORDS.strip()}\n\nOf."),
    (page(f"<nav-bar>x</nav-bar><main><p title='a > b'>{WORDS}</p><form><p>{WORDS}</p></form><p hidden>{WORDS}</p></main>"), WORDS.strip()),
    (page("<article><p>Short.</p></article><div>menu</div>"), "Short."),
    (page(f"<article><p>{WORDS}</p><style>p{{}}</style><!-- c --><p>End"), f"{WORDS.strip()}\n\nEnd"),
    (page(f"<article><div class=cookie-notice>{WORDS}</div><p>{WORDS}</p><div class=ad>{WORDS}</div></article>"), WORDS.strip()),
])
def test_main_text(markup, want):
    assert html_extract.main_text(markup) == want


ARTICLE = f"<article><h1>Head</h1><p>{WORDS}</p></article>"
TEXT = f"Head\n\n{WORDS.strip()}"


@pytest.mark.parametrize("markup,want", [
    (page(f"<div class='content-sidebar-wrap'>{ARTICLE}<div class=sidebar><p>{WORDS}</p></div></div>"), TEXT),
    (page(f"<div class='main has-sidebar'><h1>Head</h1><p>{WORDS}</p></div>"), TEXT),
    (page(f"<div class='content no-comments'><p>{WORDS}</p></div><div class=comments><p>{WORDS}</p></div>"), WORDS.strip()),
    (page(f"<div id='page-with-banner-ads'>{ARTICLE}</div>"), TEXT),
    (page(f"<div id='page-with-banner-ads'><p>{WORDS}</p><p>{WORDS}</p></div><div class=ad>{WORDS}</div>"),
     f"{WORDS.strip()}\n\n{WORDS.strip()}"),
    (page("<article><p>Short one.</p></article><div class=promo><p>" + WORDS + "</p></div>"), "Short one."),
    (page(f"<app-root class=has-sidebar>{ARTICLE}</app-root>"), TEXT),
    (page(f"{ARTICLE}<div id=comments><article class=comment-body><p>{WORDS * 5}</p></article></div>"), TEXT),
    (page(f"{ARTICLE}<div class=post-navigation><a href=x>{WORDS}</a></div><div hidden class=content>{WORDS}</div>"), TEXT),
])
def test_wrappers_named_after_boilerplate(markup, want):
    assert html_extract.main_text(markup) == want


PARAGRAPHS = f"<p>{WORDS}</p>" * 5
FIVE = "\n\n".join([WORDS.strip()] * 5)


@pytest.mark.parametrize("markup,want", [
    (page(f"<article><h1>Title</h1><p>Short lead.</p><div class='body'>{PARAGRAPHS}</div></article>"), f"Title\n\nShort lead.\n\n{FIVE}"),
    (page(f"<article><section><h2>A</h2>{PARAGRAPHS}</section><h2>B</h2><section><p>Few words.</p></section></article><div>menu</div>"),
     f"A\n\n{FIVE}\n\nB\n\nFew words."),
    (page(f"<h1>Title</h1><p>Short lead.</p><section>{PARAGRAPHS}</section><h2>B</h2><section><p>Few words.</p></section>"
          "<ul><li>One</li></ul><pre>x = 1</pre><ul><li><a href=x>Link one</a></li></ul><div>menu</div>"),
     f"Title\n\nShort lead.\n\n{FIVE}\n\nB\n\nFew words.\n\nOne\n\nx = 1"),
    (page(f"<main><h1>Title</h1><article>{PARAGRAPHS}</article></main>"), f"Title\n\n{FIVE}"),
    (page(f"<div id=page><div><h1>Title</h1></div><div class=story>{PARAGRAPHS}</div><table><tr><td>1<td>2</table></div><div>menu</div>"),
     f"Title\n\n{FIVE}\n\n1\n\n2"),
    (page(f"<article>{PARAGRAPHS}<div class=related><p>{WORDS}</p></div><nav><h2>More</h2></nav></article>"), FIVE),
])
def test_whole_article_is_kept(markup, want):
    assert html_extract.main_text(markup) == want


@pytest.mark.parametrize("markup,want", [
    (page(f"<form id=aspnetForm><div><ul><li><a href=x>Menu</a></ul></div>{ARTICLE}</form>"), TEXT),
    (page(f"<form id=aspnetForm><main><h1>Head</h1><p>{WORDS}</p></main></form>"), TEXT),
    (page(f"<form><h1>Head</h1><p>{WORDS}</p></form>"), TEXT),
    (page(f"<fieldset>{ARTICLE}</fieldset>"), TEXT),
    (page(f"<div role=form>{ARTICLE}</div><div role=dialog><p>{WORDS}</p></div>"), TEXT),
    (page(f"<nav><a href=x>Menu</a><main><h1>Head</h1><p>{WORDS}</p></main>"), TEXT),
    (page(f"<nav><ul><li>Menu</ul><div><main><h1>Head</h1><p>{WORDS}</p></main></div></nav><footer>Foot</footer>"), TEXT),
    (page(f"<nav><a href=x>Menu</a>{ARTICLE}<footer>Foot</footer>"), TEXT),
    (page(f"<div><nav><a href=x>Menu</a></div>{ARTICLE}"), TEXT),
    (page(f"<header><h1>Site</h1></header><div class=content><p>{WORDS}</p><p>{WORDS}</p></div><form><h1>Log in</h1><p>{WORDS}</p></form>"),
     f"{WORDS.strip()}\n\n{WORDS.strip()}"),
    (page(f"<article><p>{WORDS}</p><form><p>{WORDS}</p><p>{WORDS}</p></form></article>"), WORDS.strip()),
    (page(f"{ARTICLE}<footer><article><p>{WORDS}</p><p>{WORDS}</p>"), TEXT),
    (page(f"<article><p>{WORDS}<button>Share this</button></p></article>"), WORDS.strip()),
    (f"<head profile=x><title>T</title><body>{ARTICLE}", TEXT),
])
def test_wrappers_that_are_boilerplate_by_kind(markup, want):
    assert html_extract.main_text(markup) == want


def test_hostile_markup_ends():
    for markup in ("<div " * 20000, "<" * 50000, "<p title=\"" * 20000, "<!--" * 5000, "<a href='x" * 20000, "</p>" * 20000):
        assert isinstance(html_extract.main_text(markup), str)


@pytest.mark.parametrize("markup", [
    "<div>" * 50000 + "x" * 40, "<div>Some text of this element, " * 50000, "<div class=ad>Some text of this element, " * 50000,
    "<ul><li>" + "<div>" * 25000 + "<li>One, and more text of it</li>" * 25000, "<b class=ad>" * 50000 + "</i>" * 50000,
    "<form>Some text of this element, " * 50000, "<p>" + "<div>" * 25000 + "</p>" * 25000, "<header>Words of this header " * 50000,
])
def test_deep_and_long_pages_take_linear_time(markup):
    start = time.process_time()
    html_extract.main_text(markup)
    assert time.process_time() - start < 4


def test_pages_equal_their_articles(spark):
    rows = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = {r["page_id"]: r for r in html_extract.extract_pages(spark.read.parquet(f"{SF_SMALL}/pages.parquet")).collect()}
    for i, source in rows.items():
        m = re.search(r"<article>(.*?)(</article>|$)", source, re.S)
        body = re.sub(r"</?(p|h1)>", "\0", m[1]).replace("<br>", " ")
        blocks = (re.sub(r"\s+", " ", html.unescape(b)).strip() for b in re.sub(r"<[^>]*(>|$)", "", body).split("\0"))
        assert got[i]["text"] == "\n\n".join(b for b in blocks if b) and got[i]["n_chars"] == len(got[i]["text"])


def test_pages_with_null_columns(spark):
    df = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x</p>", 2), (1, "u", "<p>x</p>", 2)],
                               "page_id long, url string, html string, text int")
    assert [r["text"] for r in html_extract.extract_pages(df).collect()] == ["", "x", "x"]


def test_pipeline_against_its_rules(spark):
    """Each stage on its own input: what goes and what stays."""
    from tests.llm.test_near import brute
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, seen[-1], SF_SMALL), "t")
        assert out.columns == docs.columns
        seen.append(out)
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in seen]
    assert len(texts[1]) >= 0.99 * len(texts[0])
    first = {}
    for i, t in sorted(texts[1].items()):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert set(texts[2]) == set(first.values())
    rows = list(texts[2].items())
    assert set(texts[3]) == {i for i, (_, c) in brute(rows, 5).items() if i == c}
    assert set(texts[4]) <= set(texts[3])
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF_SMALL)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(texts[4])


def test_pipeline_of_empty_table(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF_SMALL), "t")
        assert docs.count() == 0


def test_signature_is_stable():
    s = near_dedup.shingle_set("a b c d e f", 2)
    assert len(s) == 5 and (near_dedup.signature(s) == near_dedup.signature(s[::-1])).all()
