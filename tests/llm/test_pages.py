import pytest

from trackloom.llm.page_text import extract_pages, main_text
from trackloom.llm.queries import QUERIES

ONE = "The first paragraph has some text, and marks. It goes on, for a while; so it counts."
TWO = "Another paragraph follows here, with more words in it. It has an end, too."
FURNITURE = [
    '<nav><ul><li><a href="/x">Home, sweet. Home</a></li></ul></nav>', "<header>Site name. With marks, many.</header>",
    '<div class="sidebar"><p>A long side text, with marks. And more, of the kind; it goes on.</p></div>',
    '<div id="comments"><p>I think, that this is great. Really, I do. Is it not, my friends?</p></div>',
    '<form action="/s"><label>Search, here.</label><input name=q><button>Go. Now, please.</button></form>',
    "<script>if (a < b) { x = '</p>'; }</script>", "<style>p > a { color: red; }</style>", "<!-- a > b, c. -->",
    '<div class="ad banner">Buy this, buy that. Cheap, and good.</div>', "<footer>&copy; us, you. All rights.</footer>",
    '<div role="alert">We use cookies, a lot. Accept, please.</div>', "<aside>By the way, see this. Or that.</aside>",
    '<p hidden>Hidden, text. Here.</p>', "<noscript>Please, enable scripts.</noscript>", "<select><option>A, b.</select>"]


@pytest.mark.parametrize("extra", FURNITURE)
@pytest.mark.parametrize("holder", ["article", 'div class="post-body"', "main"])
def test_furniture_goes(extra, holder):
    name = holder.split()[0]
    page = f"<html><head><title>T. t, t</title></head><body>{extra}<{holder}><h1>A title</h1><p>{ONE}</p>" \
           f"<p>Short.</p><p>{TWO}</p></{name}>{extra}</body></html>"
    assert main_text(page) == f"A title\n{ONE}\nShort.\n{TWO}"


def test_text_is_decoded_and_joined():
    assert main_text("<article><p>a &lt;b&gt; &amp;amp; &#233;&#x20AC;,\n\t c.<br>d <b>e</b>f</p><p>  x,\xa0y. </article>") == \
        "a <b> &amp; é€, c. d ef\nx, y."
    assert main_text("<article><ul><li>one, a.<li>two, b.</ul><table><tr><td>c, d.<td>e, f.</table>") == \
        "one, a.\ntwo, b.\nc, d.\ne, f."


@pytest.mark.parametrize("html", [None, "", "   ", "<html></html>", "<script>x", "<!-- open", "<p", "</p></div>", "<nav>x</nav>"])
def test_nothing_to_find(html):
    assert main_text(html) in ("", "<p")


def test_hostile_pages():
    assert main_text("<div>" * 5000 + "deep, text." + "</div>" * 5000) == "deep, text."
    assert main_text("<a b='" * 20_000).count("<a") == 20_000
    assert main_text("<p>a, b." * 3000).count("\n") == 2999
    assert len(main_text(f"<p>{'word, ' * 200_000}</p>")) == 1_199_999


def test_table(spark, folder):
    got = QUERIES["op1_tag_path_text"](spark, folder).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) > 0 for r in got)
    for r in got:
        assert r.text == main_text(pages[r.page_id])
        assert "<" not in r.text and "track(" not in r.text and "©" not in r.text
    schema = "page_id long, url string, html string, text string, n_chars long"
    frame = spark.createDataFrame([(1, None, None, "x", 9), (1, None, None, "x", 9), (None, "u", f"<p>{ONE}", "x", 9)], schema)
    assert sorted(extract_pages(frame).collect(), key=str) == sorted(
        [(1, None, "", 0), (1, None, "", 0), (None, "u", ONE, len(ONE))], key=str)
    assert extract_pages(frame.limit(0)).collect() == []


@pytest.mark.parametrize("wrap", ["<div id='page' class='site no-sidebar'>", "<div class='layout with-sidebar'>",
                                  "<div class='search layout'>", "<section id='discussion'>"])
def test_a_name_does_not_drop_the_page(wrap):
    side = "<div class='sidebar'><p>Aside, here.</p></div>"
    assert main_text(f"<body>{wrap}{side}<div><h1>A title</h1><p>{ONE}</p><p>{TWO}</p></div></body>") == f"A title\n{ONE}\n{TWO}"


@pytest.mark.parametrize("part", ["<h2 id='search-algorithms'>Search</h2>", "<h2><span id='share'>How to share</span></h2>",
                                  f"<section id='discussion'><h2>Talk</h2><p>{ONE}</p></section>",
                                  f"<section id='related-work'><p>{ONE}</p></section>", "<p>a <b class='alert'>b</b> c</p>"])
def test_names_inside_an_article_are_hints(part):
    import re

    text = "\n".join(re.sub(r"</?(?:b|span)\b[^>]*>|</?section[^>]*>", "", part).replace("><", ">\n<").split("\n"))
    text = re.sub("<[^>]+>", "", text)
    share = "<div class='share'><a href='#'>Share this</a></div><div class='ad'>Buy this</div>"
    long = f"<p>{ONE} {TWO} {ONE} {TWO}</p>"
    page = f"<article><h1>A title</h1>{long}{long}{part}{long}{share}{long}{long}</article><div id='comments'><p>{ONE}</p><p>{TWO}</p></div>"
    line = f"{ONE} {TWO} {ONE} {TWO}"
    assert main_text(page) == f"A title\n{line}\n{line}\n{text}\n{line}\n{line}\n{line}"


def test_many_names_take_linear_time():
    assert main_text("<div class='ad'>x, y." * 5000)
    assert main_text(f"<article><p>{ONE * 3}</p></article>" + "<div class='ad'>x, y.</div>" * 20_000) == ONE * 3


def test_an_advert_longer_than_the_article_goes():
    assert main_text(f"<div class='ad'>{ONE}</div><article><h1>Short.</h1><p>Short.</p></article>") == "Short.\nShort."


LONG = " ".join([ONE] * 5)


@pytest.mark.parametrize("page", [
    "<article><header><h1>Title</h1></header><div class='body'>{five}</div></article>",
    "<body><div class='x'><div class='head'><h1>Title</h1></div><div class='body'>{two}</div><div class='more'>{three}</div></div></body>",
    "<main><div class='t'><h1>Title</h1></div><article>{five}</article></main>",
    "<body><h1>Title</h1>{five}</body>"])
def test_short_blocks_beside_the_heaviest_element_stay(page):
    p = f"<p>{LONG}</p>"
    page = page.format(five=p * 5, two=p * 2, three=p * 3)
    assert main_text(page) == "\n".join(["Title"] + [LONG] * 5)


def test_short_lists_tables_and_headings_stay():
    p = f"<p>{LONG}</p>"
    parts = "<ul><li>one<li>two</ul><table><tr><td>three<td>four</table>"
    want = "\n".join([LONG, LONG, "one", "two", "three", "four", LONG])
    assert main_text(f"<body><nav>x</nav>{p}{p}{parts}{p}<ul class='links'><li><a href='/'>Link</a></ul></body>") == want
    assert main_text(f"<article><div class='text'>{p}{p}</div><div class='facts'>{parts}</div><div class='text'>{p}</div></article>") == want
    sections = f"<section class='a'><h2>A</h2>{p}</section><section class='b'><h2>B</h2>{p}</section>"
    assert main_text(f"<body><div>{sections}</div></body>") == f"A\n{LONG}\nB\n{LONG}"
    assert main_text(f"{LONG}<div class='facts'>{parts}</div>") == "\n".join([LONG, "one", "two", "three", "four"])


def test_stray_and_unclosed_elements_cost_linear_time():
    import time

    for html in ("<span class='ad'>x</i></b></span2>" * 20_000, "<div>a" * 20_000,
                 "<p><td>" + "<span class='ad'>" * 20_000 + "<hr>" * 20_000):
        begin = time.monotonic()
        main_text(html)
        assert time.monotonic() - begin < 10
