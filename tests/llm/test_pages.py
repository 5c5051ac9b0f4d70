"""Page extraction: the test table's articles and pages of other templates."""
import html
import re

import duckdb

from tessera.llm import pages
from tessera.llm.registry import op6_html_extraction

SCHEMA = "page_id long, url string, html string"


def test_query_gives_the_articles(spark, sf):
    raw = dict(duckdb.sql(f"SELECT page_id, html FROM read_parquet('{sf}/pages.parquet')").fetchall())
    got = {r.page_id: r for r in op6_html_extraction(spark, sf).collect()}
    assert set(got) == set(raw)
    for i, page in raw.items():
        article = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S).group(1)
        parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(x for x in parts if x)
        assert got[i].text == want and got[i].n_chars == len(want)


def page(body, title="T"):
    return f"<!doctype html><html><head><title>{title}</title><style>p{{}}</style></head><body class='home'>{body}</body></html>"


def div_page(i):
    return page(f"""<header><a href="/">Site</a></header><div id="cookie-notice"><p>We use cookies, many of them, accept now please.</p></div>
<div class="wrap wrap-{i}"><div class="sidebar"><p>Popular things in the sidebar that are long enough to matter.</p></div>
<div class="content post-{i}"><h2>Head {i}</h2><p>First   paragraph of {i} &amp; more<!-- hidden --> text&nbsp;here.</p>
<ul><li>one</li><li>two<li>three</ul><script>var x = "<p>no</p>";</script><form><p>Sign up <input></p></form>
<blockquote>Quoted &lt;b&gt; line<br>next</blockquote><p>Last<b> one</b></div>
<div class="comments"><p>A reader comment that is rather long and says little, again and again.</p></div></div>
<footer><p>Footer words of {i}</p></footer>""")


WANT = "Head {0}\nFirst paragraph of {0} & more text here.\none\ntwo\nthree\nQuoted <b> line next\nLast one"


def test_another_template(spark):
    rows = [(i, f"https://Site.example:80/{i}", div_page(i)) for i in range(8)]
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: WANT.format(i) for i in range(8)}


def test_comments_as_articles(spark):
    body = "<main><article class='post'><h1>T</h1><p>the text itself</p></article>" + "".join(
        f"<article class='comment' id='c{i}'><p>a reader says number {i} at length, again</p></article>" for i in range(5)) + "</main>"
    got = pages.extract_pages(spark.createDataFrame([(i, "http://c.org/", page(body)) for i in range(3)], SCHEMA)).collect()
    assert {r.text for r in got} == {"T\nthe text itself"}


def test_hosts_agree_on_a_path(spark):
    """A page whose sidebar is longer than its article follows its host's other pages."""
    def two(i, aside, main):
        return page(f"<div class='left'><p>{aside}</p></div><div class='right'><p>{main}</p></div>")
    rows = [(i, f"http://h.org/{i}", two(i, "short", f"main text {i} " * 20)) for i in range(9)]
    rows.append((9, "http://h.org/9", two(9, "much longer aside " * 30, "main text 9")))
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[9] == "main text 9" and got[0] == ("main text 0 " * 20).strip()
    paths = pages.host_paths(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.host, r.path, r.votes, r.pages) for r in paths] == [("h.org", "/html/body.home/div.right", 9, 10)]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (None, "http://x/", "plain text only"), (3, "http://x/", "<p>open <b>tags"),
            (3, "http://x/", "<p>open <b>tags"), (4, "http://y/", "<script>never closed <p>x"), (5, "http://y/", "a < b <p title='>'>c</p> &bogus; &amp"),
            (6, "http://z/", "<p>" + "word " * 50000 + "</p>"), (7, "http://w/", "<!-- <p>x</p>")]
    df = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA + ", path string")
    got = sorted(((r.page_id, r.text) for r in pages.extract_pages(df).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (None, "plain text only"), (3, "open tags"), (3, "open tags"), (4, ""),
                          (5, "a < b\nc\n&bogus; &"), (6, ("word " * 50000).strip()), (7, "")], key=str)
    assert pages.extract_pages(spark.createDataFrame([], SCHEMA)).count() == 0


LONG = "The first paragraph of a page that has a good deal to say. " * 12
ARTICLE = f"<h2>Head</h2><p>{LONG}</p><p>And a second one, shorter.</p>"
PLAIN = f"Head\n{LONG.strip()}\nAnd a second one, shorter."


def test_marks_do_not_empty_a_page(spark):
    """Names that only hold a mark word, marks around nearly all text and one form around the body."""
    small = "<div class='copy'><p>Copyright of the site, all rights.</p></div>"
    bodies = [f"<div class='{c}'>{ARTICLE}</div>{small}" for c in
              ("content has-sidebar", "no-sidebar", "search-result", "social-science", "sidebar", "search")]
    bodies += [f"<div data-id='related-3' data-class='ad'>{ARTICLE}</div>{small}", f"<div title='x class=ad'>{ARTICLE}</div>{small}",
               f"<form action='/'><div class='page'>{ARTICLE}</div></form>{small}", f"<div class='comments'>{ARTICLE}</div>"]
    rows = [(i, f"http://h{i}.org/", page(b)) for i, b in enumerate(bodies)]
    rows.append((len(bodies), "http://x.org/", page(f"<form>{ARTICLE}</form>")))
    rows.append((len(bodies) + 1, "http://y.org/", page("<p class='ad'>one</p><p class='ad'>two</p>")))
    got = {r.page_id: r.text for r in pages.extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {**{i: PLAIN for i in range(len(bodies) + 1)}, len(bodies) + 1: "one\ntwo"}


def test_math_stays_and_boilerplate_goes(spark):
    body = (f"<article>{ARTICLE}<p>So <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds.</p><div class='ad-1'><p>Buy</p></div>"
            "<div id='comment-7'><p>A reader</p></div></article><div class='comments'><p>" + "a reader says much " * 90 + "</p></div>")
    got = pages.extract_pages(spark.createDataFrame([(1, "http://m.org/", page(body))], SCHEMA)).collect()
    assert [r.text for r in got] == [PLAIN + "\nSo a=2 holds."]


def test_deep_and_unclosed_elements_are_linear():
    import time
    words = "some words of the article stand here"
    pages_ = ["<div>" * 50_000 + words + "</div>" * 50_000, "<b>x</b><b>" * 50_000 + words, "<p><b>" * 50_000 + words, "</i>" * 50_000 + words,
              "<ul><li>" * 50_000 + words, "<div><p>" * 25_000 + words]
    for page in pages_:
        t = time.time()
        assert pages.extract(page, pages.best_path(page)).endswith(words)
        assert time.time() - t < 20


def _plain_walk(page):
    """(ancestors, text) by a stack, for pages without implied end tags."""
    import re
    stack, out = [], []
    for m in re.finditer(r"<(/?)(\w+)(?: class='([a-z ]*)')?>|([^<]+)", page):
        if m[4]:
            out.append((list(stack), m[4]))
        elif m[1]:
            stack.pop()
        else:
            stack.append((m[2], tuple(sorted((m[3] or "").split()))))
    return out


def _plain_best(page):
    """The best container by summing every text over all its ancestors."""
    scores = {}
    for n, (line, text) in enumerate(_plain_walk(page)):
        if any(t == "a" for t, _ in line) or not text.strip():
            continue
        share = len(text.strip()) * (0.1 if any(t == "nav" for t, _ in line) else 1.0)
        for depth in range(len(line), -1, -1):
            if depth == 0 or line[depth - 1][0] in pages.CONTAINERS:
                at = tuple(line[:depth])
                scores[at] = scores.get(at, 0) + share * (1.1 if depth and line[depth - 1][0] in ("article", "main") else 1.0)
                share *= 0.9
    best = max(scores.items(), key=lambda x: (round(x[1], 6), len(x[0])), default=None)
    return None if best is None else "".join("/" + ".".join([t, *c]) for t, c in best[0])


def test_votes_of_generated_templates_match_plain_sums():
    """Pages of random nested templates, each element with a class of its own: scores by brute force."""
    import random
    rng = random.Random(6)

    def some(depth, n):
        tag = rng.choice(["div", "section", "article", "span", "a", "nav", "main", "h1"])
        name = "".join(rng.choice("bcdfghjk") for _ in range(4)) + "q" * n[0]
        n[0] += 1
        inner = "".join(some(depth - 1, n) if depth and rng.random() < 0.6 else "word " * rng.randrange(6) for _ in range(rng.randrange(1, 4)))
        return f"<{tag} class='{name}'>{inner}</{tag}>"
    for _ in range(300):
        page = f"<html><body>{some(4, [0])}{some(4, [100])}</body></html>"
        assert pages.best_path(page) == _plain_best(page), page
