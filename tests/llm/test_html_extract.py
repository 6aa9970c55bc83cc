import html
import re

from pyspark.sql import functions as F

from playcohort.llm.html_extract import extract, main_text
from playcohort.llm.queries import op1_html_extraction


def test_whole_table_against_the_article_blocks(spark, sf):
    """The test pages hold their text in one article of h1 and p blocks."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op1_html_extraction(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        body = re.sub(r"</?b>", "", body.replace("<br>", " "))
        blocks = [" ".join(html.unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_a_page_with_everything():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="ad-free-theme">
    <header><h1>Site name</h1></header><div role="navigation"><a href="/">Home</a></div>
    <div class="cookie-notice">We use cookies on this site, please accept all of them now.</div>
    <div class="layout"><main><article><header><h1>The  title &amp; more</h1></header>
    <p>A first paragraph of <b>some length</b> that&nbsp;tells\n a story to its readers.</p>
    <p>Short.</p><script>document.write("<p>no</p>")</script>
    <ul><li>One point<li>Another <a href="x">with a link</a> inside</ul>
    <div class="advert">Buy this thing today, it is really very cheap and good.</div>
    <ul><li><a href="1">Related story one</a></li><li><a href="2">Related story two</a></li></ul>
    <table><tr><td>cell a<td>cell b</table>
    <p>The last paragraph, again with a good number of words in it.</article></main>
    <aside>Sidebar words that go on for a while, longer than needed by anyone.</aside></div>
    <section id="comments"><p>A comment by a reader that is long enough to look like an article.</p></section>
    <form><label>Mail</label><input value="x"><button>Send</button></form>
    <footer>Imprint &copy;</footer></body></html>"""
    assert main_text(page).split("\n\n") == [
        "The title & more",
        "A first paragraph of some length that tells a story to its readers.",
        "Short.",
        "One point",
        "Another with a link inside",
        "cell a",
        "cell b",
        "The last paragraph, again with a good number of words in it.",
    ]


def test_content_is_found_without_semantic_tags():
    links = "".join(f'<li><a href="{i}">Item {i}</a></li>' for i in range(12))
    text = [f"Paragraph {i} has quite a number of words, as the paragraphs of an article have." for i in range(5)]
    page = f"<body><div><ul>{links}</ul></div><div>{''.join(f'<p>{t}</p>' for t in text)}</div><div><ul>{links}</ul></div>"
    assert main_text(page) == "\n\n".join(text)


def test_articles_split_into_containers():
    a = "".join(f"<p>Sentence {i} of the first part is of the usual length for such a text.</p>" for i in range(10))
    b = "".join(f"<p>Sentence {i} of the second part is of the usual length for such a text.</p>" for i in range(6))
    short = "<ul>" + "".join(f"<li>short point {i}</li>" for i in range(5)) + "</ul>"
    texts = lambda html: [x for x in re.split("<[^>]+>", html) if x]
    title = "<h1>The title</h1>"
    for page, want in [
        (f"<article><section>{a}</section><section>{b}</section></article>", a + b),
        (f"<article><div>{title}</div><div>{a}</div></article>", title + a),
        (f"<article><section>{a}</section><section>{short}</section></article>", a + short),
        (f"<body><div>{title}</div><article>{a}</article></body>", title + a),
        (f"<body><div><div>{title}</div><div>{a}</div><div>{short}</div></div></body>", title + a + short),
        (f"<body><article>{a}</article><article>{b}</article></body>", a + b),
    ]:
        assert main_text(page).split("\n\n") == texts(want), page


def test_wrappers_with_names_of_other_things():
    text = "".join(f"<p>Sentence {i} of the story is of the usual length for such a text.</p>" for i in range(8))
    note = '<div class="cookie-notice">We use cookies on this site, please accept all of them now.</div>'
    comments = '<div id="comments"><article><p>A comment that is long enough to look like a text.</p></article></div>'
    want = re.findall("<p>(.*?)</p>", text)
    for page in [
        f'<div class="page has-sidebar"><article>{text}</article></div>',
        f'<div id="wrap" class="with-comments"><div>{text}</div></div>',
        f'<article class="post category-social">{text}</article>',
        f'<div class="sidebar"><article>{text}</article>{note}{comments}</div>',
        f'<body><form action="/"><div>{text}</div>{note}</form></body>',
        f'<body><form><main>{text}</main><div class="site-footer">Imprint and more</div></form></body>',
        f'<body><article>{text}</article>{comments}<form>Subscribe to our letter</form></body>',
    ]:
        assert main_text(page).split("\n\n") == want, page
    assert main_text(f"<header><h1>Site</h1></header>{note}<div><p>One sentence.</p></div>") == "One sentence."


STORY = "".join(f"<p>Sentence {i} of the story is of the usual length for such a text.</p>" for i in range(8))
TOLD = re.findall("<p>(.*?)</p>", STORY)


def test_comments_and_adverts_of_any_name():
    long = "".join(f"<p>Reader {i} writes a comment that is longer than the story itself, and goes on.</p>" for i in range(20))
    for page in [
        f'<body><article>{STORY}</article><div class="comments"><article>{long}</article></div></body>',
        f'<div class="page"><article>{STORY}</article><div id="comments"><article>{long}</article></div></div>',
        f'<main><article>{STORY}</article><section class="user-comments">{long}</section></main>',
        f'<main><article>{STORY}<div class="reader-comments">{long}</div></article></main>',
        f'<article>{STORY}<div class="ad-slot">Buy this thing today, it is really very cheap.</div></article>',
        f'<article><div id="google-ads">Buy this thing today, it is really cheap.</div>{STORY}</article>',
        f'<article>{STORY}<p style="color:red; display: none">This text is never shown to a reader of it.</p></article>',
        f'<article>{STORY}<div style="visibility:hidden"><p>Nor is this one shown to a reader.</p></div></article>',
    ]:
        assert main_text(page).split("\n\n") == TOLD, page


def test_short_lines_beside_the_text():
    top, end = "<div>Breaking: subscribe today</div>", "<div>Posted by someone</div>"
    for page in [
        f"<body>{top}<div>{STORY}</div>{end}</body>",
        f"<body><div>{top}<div><div>{STORY}</div></div></div>{end}</body>",
    ]:
        assert main_text(page).split("\n\n") == TOLD, page


def test_paragraphs_that_are_links_stay():
    links = '<p><a href="1">A source of this story</a></p><p><a href="2">Another source of it</a></p>'
    want = [*TOLD, "A source of this story", "Another source of it", *TOLD]
    assert main_text(f"<article>{STORY}{links}{STORY}</article>").split("\n\n") == want


def test_broken_markup():
    assert main_text("<p>a<p>b <i>c") == "a\n\nb c"
    assert main_text("</div></p>a</article>") == "a"
    assert main_text("<![foo[ x ]]><p>hello &lt;world&gt; &#x41;&unknown;") == "<![foo[ x ]]>\n\nhello <world> A&unknown;"
    assert main_text("<p>a<!-- never closed <p>b") == "a"
    assert main_text("<p>&lt;!-- text --&gt;</p>") == "<!-- text -->"
    assert main_text("<script>only code") == ""
    assert main_text("<article><p>text <") == "text <"
    assert main_text("<p>" * 5000 + "deep" + "<div>" * 5000) == "deep"


def test_deep_and_unmatched_tags_take_linear_time():
    n = 30_000
    assert main_text("<div>" * n + "deep") == "deep"
    assert main_text("<b>" * n + "</i>" * n + "text") == "text"
    assert main_text("<b><p>" * n + "end") == "end"


def test_odd_rows(spark):
    rows = [(None, None, None), (1, "u", ""), (1, "u", ""), (2, "v", "<p>" + "word &amp; " * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.url, r.n_chars) for r in extract(pages, ["page_id", "url"]).collect()}
    assert got == {(None, None, 0), (1, "u", 0), (2, "v", 50_000 * 7 - 1)}
    assert extract(pages, ["page_id", "url"]).count() == 4
    assert extract(pages.limit(0), ["page_id", "url"]).count() == 0
