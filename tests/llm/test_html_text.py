import html
import re

import pytest
from pyspark.sql import functions as F

from surveyloom.llm import html_text

PAGES = "page_id long, url string, html string"
CASES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><div>My Site</div><ul><li><a href=x>Home</a></li>"
     "<li><a href=y>News</a></li></ul><div><h1>A title</h1><p>First &lt;b&gt; par&eacute;.</p><p>Second <i>one</i>\n too.</p>"
     "</div><div class='comments'><p>Nice!</p></div><p>&copy; 2020 me</p>",
     "A title\nFirst <b> paré.\nSecond one too."),
    ("plain text only", "plain text only"), ("", ""), (None, ""), ("<p></p><div> &nbsp; </div>", ""), ("<p>x", "x"),
    ("<nav><a>q</a><article><p>Body text.</p></article>", "Body text."),
    ("<article><header><h1>T</h1></header><p>Body</p><aside>side</aside><p>More</p><form>f<input></form></article>"
     "<footer>foot</footer>", "T\nBody\nMore"),
    ("<div class=content><p>A paragraph, with <a href=y>a link</a> inside.</p><div class='ad'>Buy <div>now</div></div>"
     "<p>Rest.</p></div>", "A paragraph, with a link inside.\nRest."),
    ("<script>var a='</p><p>no</p>'</script><p>yes</p><!-- <p>no</p> --><script>never closed", "yes"),
    ("<article><p>Body one.</p><section id='comments'><article><p>reader</p></article></section></article>", "Body one."),
    ("<p>a < b and c > d</p>", "a < b and c > d"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_cases(page, text):
    assert html_text.main_text(page or "") == text


def test_distribution_keeps_the_heavy_stretch():
    menu = "".join(f"<p><a href='/{i}'>entry {i}</a></p>" for i in range(6))
    body = "".join(f"<p>Sentence number {i} of the long body of this page.</p>" for i in range(8))
    page = f"<p>Top</p>{menu}{body}{menu}<p>End</p>"
    assert html_text.main_text(page) == "\n".join(f"Sentence number {i} of the long body of this page." for i in range(8))


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    given = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        inner = re.search(r"<article>(.*)</article>", given[r.id], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
    # The distribution finds the same where nothing marks the article.
    unmarked = pages.withColumn("html", F.regexp_replace("html", "(</?)article>", "$1div>"))
    assert {r.id: r.text for r in html_text.extract(unmarked).collect()} == {r.id: r.text for r in html_text.extract(pages).collect()}


LONG = "A sentence of the body that is long enough to count."


@pytest.mark.parametrize(("page", "text"), [
    (f"<article><p class='share-price'>Up.</p><p class='related-work'>Others.</p><div class='article-header'><h1>T</h1></div><p>{LONG}</p></article>",
     f"Up.\nOthers.\nT\n{LONG}"),
    (f"<body><div class='no-sidebar content'><p>{LONG}</p></div><div class='site-header'>Top</div></body>", LONG),
    (f"<div class='widget'><nav>menu</nav><p>{LONG}</p><p>{LONG}</p></div><p>x</p>", f"{LONG}\n{LONG}\nx"),
    ("<article><p><a href=x>Only links</a></p><p><a href=y>in here</a></p></article><p><a href=z>z</a></p>", "Only links\nin here"),
    (f"<p>{LONG}</p>" + "<p><a href=x>l</a></p>" * 5 + f"<p>{LONG}</p><p>Closing words.</p>", f"{LONG}\n{LONG}\nClosing words."),
    (f"<p>{LONG}</p><h1>Later title</h1><p>{LONG}</p>", f"{LONG}\nLater title\n{LONG}"),
    (f"<p>Copyright 2020 was the year of the reform.</p><p>{LONG}</p>", f"Copyright 2020 was the year of the reform.\n{LONG}"),
    (f"<div>{LONG}</div><ul class='nav-links'><li>a</li></ul><div id='cookieBanner'>{LONG}</div><div class='social-share'>s</div>", LONG)])
def test_names_and_notices_take_no_text_of_the_article(page, text):
    assert html_text.main_text(page) == text


def test_odd_rows_and_empty_table(spark):
    rows = [(i, "u", page) for i, (page, _) in enumerate(CASES)] + [(None, None, None), (3, "u", "<p>x"), (3, "u", "<p>x")]
    rows.append((99, None, "<div>" * 3000 + "deep" + "<p>word</p>" * 20_000))
    pages = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as id", "2 as text", "3 as n_chars")
    assert html_text.extract(pages).count() == len(rows)
    assert html_text.extract(spark.createDataFrame([], PAGES)).count() == 0


BODY = "<article><p>Body one.</p><p>Body two.</p></article>"


@pytest.mark.parametrize("before", [
    "<ul><li class='share'>x<li>y</ul>", "<div><p class='ad'>x</div>", "<p id=notice>x<div>y</div>",
    "<table><tr><td class='widget'>x<td>y</table>", "<dl><dt class=promo>x<dd>y</dl>", "<table><tr class=menu><td>x</table>",
    "<div><span class='ad'>x</div>", "<ul><li class='share'>x<ul><li>z</ul></ul>"])
def test_elements_around_end_without_their_end_tag(before):
    assert html_text.main_text(before + BODY) == "Body one.\nBody two."


def test_an_item_around_leaves_its_siblings():
    assert html_text.main_text("<article><ul><li class='share'>x<li>y</ul><p>Body.</p></article>") == "y\nBody."


@pytest.mark.parametrize(("page", "text"), [
    ("<article><h2><a href=x>Linked title</a></h2><p>Body.</p><ul><li><a href=y>One</a></li><li>Two</li></ul>"
     "<table><tr><td><a href=z>Cell</a></td></tr></table><p><a href=w>A last link</a></p><div class=ad>Buy</div></article>",
     "Linked title\nBody.\nOne\nTwo\nCell\nA last link"),
    ("<p>First of the body.</p><p><a href=x>Linked</a></p><p>Third of the body.</p><p><a href=y>Menu</a></p>",
     "First of the body.\nLinked\nThird of the body."),
    ("<p>Copyright law was reformed then.</p><p>More on that law.</p><p>Copyright 2020 me</p>",
     "Copyright law was reformed then.\nMore on that law."),
    ("<article><p>Body.</p><article><a href=x>Linked quote</a></article></article>", "Body.\nLinked quote")])
def test_lines_that_are_links_stay_in_a_kept_stretch(page, text):
    assert html_text.main_text(page) == text
