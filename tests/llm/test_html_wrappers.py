import html
import json
import random
import re

from corpus import SMALL

from ledgerspark.llm import html_wrappers as web

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/x">X</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies</div>%s<aside>side</aside><div id="comments"><p>first!</p></div>
<form><label>mail</label><input name="a>b"></form><footer>&copy; Site</footer></body></html>"""


def rows(spark, pages):
    schema = "page_id bigint, url string, html string, host string, path string"
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(pages)], schema)
    return {r.page_id: r for r in web.main_texts(df).collect()}


def test_pages_of_the_test_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r.page_id: r for r in web.main_texts(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_article_without_furniture(spark):
    body = "<article><h1>A &amp; B</h1><p>one\n two<p>three <b>bold</b>&nbsp;x<div class='ad'>buy</div><ul><li>i<li>j</ul></article>"
    got = rows(spark, [("http://a.example/1", PAGE % body)])[0]
    assert got.text == "A & B\none two\nthree bold x\ni\nj" and got.n_chars == len(got.text)


def test_host_without_article_element(spark):
    def page(i):
        story = "".join(f"<p>story {i} part {k} {'text ' * 20}</p>" for k in range(i + 1))
        return PAGE % f"<div class='c'><p>Welcome to the site</p></div><div class='story'><h2>Title {i}</h2>{story}</div>"

    got = rows(spark, [(f"http://b.example/{i}", page(i)) for i in range(5)])
    assert all(got[i].text.startswith(f"Title {i}\nstory {i} part 0 text") and "Welcome" not in got[i].text for i in got)
    assert all(len(got[i].text.split("\n")) == i + 2 for i in got)


def test_alignment_makes_optional_and_repeated_children():
    a = web.page_wrapper("<div><h1>x</h1><p>1</p><p>2</p></div>")
    b = web.page_wrapper("<div><h1>y</h1><table>t</table><p>3</p></div>")
    div = web.align(a, b)[web.CHILDREN][0]
    by = {c[web.SIGN_]: c for c in div[web.CHILDREN]}
    assert list(by) == ["h1", "table", "p"]
    assert by["h1"][web.NEEDED] and not by["h1"][web.MANY] and by["h1"][web.SAME] is None
    assert not by["table"][web.NEEDED] and by["p"][web.MANY]
    mixed = web.page_wrapper("<div><h2>a</h2><p>1</p><h2>b</h2><p>2</p></div>")[web.CHILDREN][0]
    assert mixed[web.GROUPED] and all(c[web.MANY] for c in mixed[web.CHILDREN])


def test_broken_markup_and_odd_rows(spark):
    pages = [
        ("http://c.example/1", "<article><p>open <b>bold <p>next &am &lt;tag&gt; 1 < 2"),
        ("http://c.example/2", None),
        ("http://c.example/3", ""),
        (None, "<main>text &#233;&eacute</main>"),
        ("not a url", "<article><!-- never closed"),
        ("http://c.example/4", "<script>x" + "<b>" * 3000 + "</script><article>" + "<div>" * 3000 + "deep" + "</div>" * 3000),
        ("http://c.example/1", "<article><p>open <b>bold <p>next &am &lt;tag&gt; 1 < 2"),
    ]
    got = rows(spark, pages)
    assert len(got) == 7
    assert got[0].text == got[6].text == "open bold\nnext &am <tag> 1 < 2"
    assert [got[i].text for i in (1, 2, 4)] == ["", "", ""]
    assert got[3].text == "text éé" and got[5].text == "deep"


def test_empty_table(spark):
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert web.main_texts(none).collect() == []


def test_doubtful_names_are_decided_by_the_wrapper(spark):
    """Varying text with few links stays whatever its name; links, repeated texts and comments go."""
    def page(i):
        block = f"<div class='share-price'><p>The price rose by {i} per cent in the {i}th week.</p></div>"
        links = f"<div class='share'><a href='/a{i}'>Send number {i}</a> <a href='/b'>Post</a></div>"
        same = "<div class='social-header'>Follow the site</div>"
        said = f"<div class='comment-list'><p>Reader {i} says {'a lot ' * 60}</p></div>"
        return PAGE % f"<article><h1>T{i}</h1><p>Story {i}, with <span class='share-name'>SHR</span>.</p>{block}{links}{same}{said}</article>"

    got = rows(spark, [(f"http://d.example/{i}", page(i)) for i in range(4)])
    for i in range(4):
        assert got[i].text == f"T{i}\nStory {i}, with SHR.\nThe price rose by {i} per cent in the {i}th week."


def test_pages_of_a_rare_layout_keep_their_texts(spark):
    """A text seen once is no template: one page of its host is laid out otherwise, another stands alone."""
    usual = "<div class='page'><div class='top'>Same every time</div><div class='story'><h2>Title {0}</h2><p>{1}</p></div></div>"
    pages = [(f"http://e.example/{i}", usual.format(i, f"words {i} " * 30)) for i in range(6)]
    pages += [("http://e.example/odd", "<section><h2>Odd title</h2><p>One paragraph only.</p></section>"), ("http://alone.example/", "<div><h3>Alone</h3><p>A text.</p></div>")]
    got = rows(spark, pages)
    assert got[6].text == "Odd title\nOne paragraph only." and got[7].text == "Alone\nA text."
    assert all(got[i].text.startswith(f"Title {i}\nwords {i}") and "Same" not in got[i].text for i in range(6))


def test_generated_names_do_not_grow_the_wrapper():
    """Names made anew for every page are evened out or folded; no text is lost by it."""
    rng = random.Random(2)
    name = lambda: "".join(rng.choices("abcdefghij", k=8))
    sizes, whole = [], None
    for n in range(1, 401):
        body = "".join(f"<div class='x{rng.randrange(10**6)}y {name()}'><p class='{name()}'>text {n} {k}</p></div>" for k in range(5))
        new = web.page_wrapper(f"<html><body>{body}</body></html>")
        whole = web.align(whole, new) if whole else new
        if n in (100, 400):
            sizes.append(len(json.dumps(whole)))
    assert sizes[1] < 1.5 * sizes[0] and sizes[1] < 60_000
    chars = lambda n: n[web.CHARS] + sum(map(chars, n[web.CHILDREN]))
    assert chars(whole) == sum(len(f"text {n} {k}") for n in range(1, 401) for k in range(5))
