import time

import pandas as pd
import pytest

from corpuskiln.llm.html_extract import extract_pages, main_text

ARTICLE = "<h1>On tides</h1><p>The sea, which is wide, rises twice a day, as all know.<p>It falls, too.</p>"


def page(body: str, article: str = ARTICLE) -> str:
    return (
        "<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var a='</p><p>no, no, no';</script></head>"
        f"<body><nav><ul><li><a href=x>no</a></ul></nav><!-- no -->{body.format(article)}<footer>no &copy;</footer>"
    )


EXPECTED = "On tides The sea, which is wide, rises twice a day, as all know. It falls, too."


def test_article_without_its_surroundings():
    aside = "<aside><p>no, no, no, this is a side column with many, many commas</p></aside>"
    assert main_text(page("<article>{}</article>")) == EXPECTED
    assert main_text(page("<div class='cookie-notice'><p>no, no, no</p></div><div id=main>{}</div>" + aside)) == EXPECTED
    assert main_text(page("<main><article>{}<div class=comments><p>no, said a reader, no</p></div></article></main>")) == EXPECTED
    assert main_text(page("<header><h2>no</h2></header><article><header><h1>On tides</h1></header>{}", ARTICLE.split("</h1>")[1])) == EXPECTED
    assert main_text(page("<article>{}<form><p>no<input></form><div class='ad'>no</div></article>")) == EXPECTED


def test_best_container_wins_over_link_lists_and_short_boxes():
    links = "<div class=box>" + "".join(f"<p><a href={i}>a link, with, commas {i}</a></p>" for i in range(9)) + "</div>"
    assert main_text(page(links + "<div class=text>{}</div>" + links)) == EXPECTED


def test_lists_of_links_inside_the_article_stay():
    sources = "<h2>Sources</h2><ul>" + "".join(f"<li><a href={i}>Source {i}</a></li>" for i in range(3)) + "</ul>"
    assert main_text(page("<article>{}" + sources + "</article>")) == EXPECTED + " Sources Source 0 Source 1 Source 2"


def test_short_text_beside_the_best_container_stays():
    around = "<div id=content><p>Short lead.</p><div class=body>{}</div>Loose <b>bold</b> text.<br><p>Short end.</p><p><a href=x>no</a></p></div>"
    assert main_text(page(around)) == f"Short lead. {EXPECTED} Loose bold text. Short end."


def test_references_white_space_and_inline_markup():
    text = "<p>a &lt;b&gt; &amp;amp;  &#x41;&nbsp;\n<b>bo</b>ld<br>line &copy &bogus;</p>"
    assert main_text(f"<article>{text}</article>") == "a <b> &amp; A bold line © &bogus;"


def test_broken_pages():
    assert main_text(None) == "" == main_text("") == main_text("<p>") == main_text("<script>only")
    assert main_text("plain") == "plain"
    assert main_text("<div><p>cut o") == "cut o"
    assert main_text("<article><p>" + "<b>" * 5000 + "deep") == "deep"
    assert main_text("</div></p>text<") == "text<"
    assert main_text("<p>a<p>b</i></p>") == "a b"
    long = "word, " * 50_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()


@pytest.mark.parametrize(
    "body",
    [
        "<div class='container with-sidebar'><article>{}</article></div>",
        "<div class='post has-comments'>{}</div>",
        "<form id=aspnetForm><input><div class=page>{}</div></form>",
        "<form id=aspnetForm><nav>no</nav><main>{}</main></form>",
        "<div class=widget><article class='post no-sidebar'>{}</article></div>",
        "<div class=sidebar-left><p>no, no, no</p></div><div id=content>{}</div><div id=relatedPosts><p>no, no</p></div>",
        "<article>{}</article><div class='comments-area'><article class=comment><p>no, said one, no</p></article></div>",
        "<article>{}<div class='ad-slot'><p>no</p></div><div class='social-links'>no</div><div class='newsletter-signup'>no</div></article>",
        "<div class=site-header><h2>no</h2></div><article>{}</article>",
        "<form><label>no</label><input></form><div class=text>{}</div>",
        "<div class=comments>{}</div>",  # nothing else is there
    ],
)
def test_names_around_and_beside_the_article(body):
    assert main_text(page(body)) == EXPECTED


def test_parts_of_the_article_with_telling_words_stay():
    title = "<div class='article-header'><h1>On tides</h1></div><header class='header'><p>By me.</p></header>"
    sections = "".join(
        f"<section {name}><p>Part {i}, of it.</p></section>"
        for i, name in enumerate(["id='related-work'", "id='ad-hoc-networks'", "class='social-theory'", "class='share-of-voice'"])
    )
    wanted = "On tides By me. Part 0, of it. Part 1, of it. Part 2, of it. Part 3, of it."
    assert main_text(page("<article>{}</article>", title + sections)) == wanted


def test_labels_and_formulas_inside_a_paragraph():
    text = "<p>We <label>call it</label> <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here, always.</p>"
    assert main_text(f"<article>{text}</article>") == "We call it x=2 here, always."


@pytest.mark.parametrize("attribute", ["title=don't", "title=\"don't", "data-x='a>b'", 'data-x="a>b" hidden2', "a=b/c=d", "= x", "'"])
def test_attributes_are_read_as_html_does(attribute):
    assert main_text(f"<article><p>one, <b {attribute}>two</b>, three</p></article>") == "one, two, three"


@pytest.mark.parametrize(
    "start, part",
    [
        ("<span>", "<p>x</p>"),
        ("<p><button><span>", "<p>x</p>"),
        ("<b><div>" + "<span>", "</b>"),
        ("<li><ul><span>", "<li>x</li>"),
        ("<div class=header>", "<header>x</header>"),
        ("<span>", "</b>"),
        ("<table><tr>", "<td>x"),
        ("<a href='", ">x"),
    ],
)
def test_time_is_linear_in_open_elements(start, part):
    began = time.perf_counter()
    main_text("<article>" + start * 30_000 + part * 30_000)
    assert time.perf_counter() - began < 20  # a walk up the tree for each takes minutes


def test_query_columns_nulls_and_repeats(spark):
    rows = [(1, "u", page("<article>{}</article>"), 5), (1, "u", None, 5), (None, None, "<p>x", None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, n_chars int")
    found = extract_pages(pages).toPandas()
    assert sorted(found["text"]) == sorted([EXPECTED, "", "x"])
    assert (found["n_chars"] == found["text"].str.len()).all()
    assert pd.isna(found["page_id"]).sum() == 1
    assert extract_pages(pages.limit(0)).count() == 0
