"""Main text of pages and URL filters."""

import random
import re

import duckdb
import pytest

from commentlab.llm import html_text, urls

from .conftest import prose

SCHEMA = "page_id long, url string, html string, host string, wrapper string"


@pytest.fixture(scope="module")
def pages(spark):
    def make(rows):
        return spark.createDataFrame([(i, u, h, "clash", "clash") for i, u, h in rows], SCHEMA)

    return make


def text_of(page):
    root = html_text.parse(page)
    html_text.Aligner().align(root, html_text.skeleton(root))
    return html_text.main_text(root, frozenset())


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        ("plain  text &amp; more", "plain text & more"),
        ("<p>a<b>b</b>c<br>d<p>e  f</p>", "abc d e f"),
        ("<nav>menu</nav><p>x</p><footer>&copy; y</footer>", "x"),
        ("<article><header>h</header><h1>T</h1><p>x</p><aside>s</aside></article><p>outside</p>", "T x"),
        ('<div class="ad-box">buy</div><div id="main">x</div><div class="user-comments">c</div>', "x"),
        ('<p>x</p><script>var t="</p>";</script><style>p{}</style><form>f<p>g</form><!-- c > --><p>y', "x y"),
        ("<article><p>x &lt;b&gt; &#233; &nbsp; z</article>", "x <b> é z"),
        ("<p>1 < 2 and a <b>bold</p></b></i><p>end<", "1 < 2 and a bold end<"),
        ('<p title="a>b">x</p><p>y <a hre', "x y"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("<script>never closed <p>x", ""),
        ("<main>m<div role=navigation>n</div></main>", "m"),
        ("x<span class=advert>no</span>y", "xy"),
    ],
)
def test_blocks(page, text):
    assert text_of(page) == text


def test_deep_and_long_pages(pages):
    rows = [(1, "http://a.b/c", "<div>" * 3000 + "x" + "</div>" * 3000), (2, "http://a.b/d", "<article><p>" + prose(40_000, 1) + "</article>")]
    out = {r["page_id"]: r for r in html_text.main_texts(pages(rows)).collect()}
    assert out[1]["text"] == "x" and out[2]["n_chars"] == len(prose(40_000, 1))


@pytest.mark.parametrize(
    "page, text",
    [
        ("<body class='single comments-open has-sidebar'><article class='hentry comments-open'><p>x</p></article></body>", "x"),
        ("<body class='search'><div id=content class='has-sidebar'><p>x</p></div><div class=sidebar>s</div></body>", "x"),
        ("<article><section id='related-work'>r<h2 id='search'>s</h2></section><section id=comments><p>c</p></section></article>", "r s c"),
        ("<p data-id='ad' data-class='sidebar' title='class=ad'>x</p><div class='x ad'>no</div><div class=adBox>no</div>", "x"),
        ("<div id=sidebar><main>x</main></div><p>y</p>", "x y"),
        ("<article>x</article><div id=comments><article>no</article></div>", "x"),
        ("<article><pre>a <span class='token comment'># b</span></pre><div class='comment'>no</div><h1 class='banner'>T</h1></article>", "a # b T"),
    ],
)
def test_op10_names_condemn_no_content(page, text):
    assert text_of(page) == text


def test_op10_slots_decide_doubtful_names(pages):
    share = '<div class="share">Share this page</div><div class="related"><a href="/a">Other page {}</a></div>'
    note = '<div class="notice">Note {}</div>'
    rows = [(i, f"http://a.b/{i}", f"<article><p>{prose(9, i)}</p>{share.format(i)}{note.format(i)}</article>") for i in range(12)]
    out = {r["page_id"]: r["text"] for r in html_text.main_texts(pages(rows)).collect()}
    assert out == {i: f"{prose(9, i)} Note {i}" for i in range(12)}


def test_op10_odd_tags_and_very_deep_pages(pages):
    deep = "<div>" * 50_000
    rows = [
        (1, "http://a.b/c", "<p>if (a <b) x> y</p><p>z</p>"), (2, "http://a.b/d", "<p>a</p><x(><q,(y>b</x(><p>c</p>"),
        (3, "http://a.b/e", f"{deep}x"), (4, "http://a.b/f", f"<p>one</p>{deep}y{'</div>' * 50_000}<p>two"),
        (5, "http://a.b/g", f"{'<b>' * 50_000}z{'</i></b>' * 50_000}"), (6, "http://a.b/h", f"<article>{deep}w"),
    ]
    out = {r["page_id"]: r["text"] for r in html_text.main_texts(pages(rows)).collect()}
    assert out == {1: "if (a y z", 2: "a b c", 3: "x", 4: "one y two", 5: "z", 6: "w"}


def test_simple_tree_matching():
    a = html_text.unfold("html(body(div,p,div(ul(li)),p))")
    b = html_text.unfold("html(body(p,div(ul(li)),footer))")
    size, _ = html_text.match(a, b)
    assert size == 1 + 1 + 1 + 1 + 3  # root, html, body, p, div(ul(li))
    assert html_text.match(("x", []), ("y", []))[0] == 0
    node = html_text.parse("<div><p>a</p><p>b</p><ul><li>x<li>y</ul></div>")
    assert html_text.skeleton(node) == "(div(p,ul(li)))"


def test_wrapper_tells_template_from_content(pages):
    rng = random.Random(2)
    rows = []
    for i in range(40):
        extra = "<div>only here</div>" if i % 7 == 0 else ""
        links = "".join(f'<a href="/{k}">{prose(1, rng.randrange(9999))}</a> ' for k in range(4))
        page = f"<html><body><div>Welcome to the site</div>{extra}<div>{links}</div><div><p>{prose(30, i)}</p><p>{prose(9, 900 + i)}</p></div><div>All rights kept</div></body></html>"
        rows.append((i, f"https://One.example.com/{i}", page))
    out = {r["page_id"]: r["text"] for r in html_text.main_texts(pages(rows)).collect()}
    for i in range(40):
        own = f"{prose(30, i)} {prose(9, 900 + i)}"
        assert own in out[i] and "Welcome" not in out[i] and "rights" not in out[i]
        assert len(out[i]) <= len(own) + len("only here ")


def test_op10_copies_of_a_page_are_no_template(pages):
    def page(i):
        return f"<head><title>{i}</title></head><body><div>Site name</div><div><p>{prose(20, i)}</p></div></body>"

    rows = [(i, f"http://c.d/{i}", page(max(i, 90))) for i in range(100)] + [(200 + i, "http://e.f/", page(7)) for i in range(8)]
    rows += [(300 + i, f"http://g.h/{i}", f"<main><p>{prose(9, i % 8)}</p><div>Site words <b>here</b></div></main>") for i in range(40)]
    out = {r["page_id"]: r["text"] for r in html_text.main_texts(pages(rows)).collect()}
    assert all(out[i] == prose(20, max(i, 90)) for i in range(100))
    assert all(out[200 + i] == f"Site name {prose(20, 7)}" for i in range(8))
    assert all(out[300 + i] == prose(9, i % 8) for i in range(40))


def test_repeated_articles_stay(pages):
    page = "<body><nav>m</nav><article><p>the very same words</p></article></body>"
    rows = [(i % 20, "http://h.example/x", page) for i in range(30)] + [(50, None, page), (51, None, None), (None, "nonsense", "")]
    out = html_text.main_texts(pages(rows)).collect()
    assert len(out) == 33
    assert all(r["text"] == "the very same words" for r in out if r["page_id"] is not None and r["page_id"] != 51)
    assert all((r["text"], r["n_chars"]) == ("", 0) for r in out if r["page_id"] in (51, None))
    assert html_text.main_texts(pages([])).count() == 0


def test_op10_against_a_plain_reading(spark, sf_dir):
    """On these pages the article is known: its markup taken away by another way."""
    import html

    from commentlab.llm.queries import QUERIES

    raw = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    out = QUERIES["op10_html_text"](spark, sf_dir).collect()
    assert len(out) == len(raw)
    for r in out:
        article = re.search(r"<article>(.*?)</article>", raw[r["page_id"]], re.S)[1]
        plain = re.sub(r"</?b>", "", article)
        plain = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", plain)).split())
        assert r["text"] == plain and r["n_chars"] == len(plain)


# ---------------------------------------------------------------- URL filters


@pytest.fixture(scope="module")
def judge(spark):
    def run(captures, entries):
        c = spark.createDataFrame(captures, "page_id long, url string, day int, _salt string, host string")
        e = spark.createDataFrame(entries, "rule string, action string, day int")
        return urls.judge(c, e)

    return run


LOG = [
    ("bad.example.com", "block", 10), ("bad.example.com", "remove", 20), ("bad.example.com", "block", 30),
    ("example.com", "block", 100), ("good.example.com", "allow", 100), ("good.example.com/x", "block", 110),
    ("tie.org", "block", 5), ("tie.org", "allow", 5), ("tie.org", "remove", 5), (None, "block", 1), ("n.org", None, 1), ("n.org", "block", None),
]


def test_validity(judge):
    cases = [
        ("http://bad.example.com/p", 9, False, None), ("http://bad.example.com/p", 10, True, "bad.example.com"),
        ("http://bad.example.com/p", 19, True, "bad.example.com"), ("http://bad.example.com/p", 20, False, None),
        ("HTTPS://user.Bad.Example.com:80/p?q#f", 35, True, "bad.example.com"), ("http://other.example.com", 99, False, None),
        ("http://other.example.com", 100, True, "example.com"), ("http://good.example.com/y", 120, False, "good.example.com"),
        ("http://good.example.com/x/z", 109, False, "good.example.com"), ("http://good.example.com/x/z", 110, True, "good.example.com/x"),
        ("http://tie.org", 5, True, "tie.org"), ("http://n.org", 9, False, None), ("nonsense", 9, False, None), (None, 9, False, None),
        ("http://tie.org", None, False, None), ("http://notexample.com", 200, False, None),
    ]
    rows = [(i, u, d, "x", "y") for i, (u, d, *_) in enumerate(cases)]
    out = judge(rows * 2, LOG).collect()
    assert len(out) == 2 * len(cases)
    for r in out:
        assert (r["blocked"], r["rule"]) == cases[r["page_id"]][2:], cases[r["page_id"]]
        assert r["_salt"] == "x"


def test_op3_deep_upper_case_and_userinfo(judge):
    log = [
        ("a.example/1/2/3", "block", 1), ("a.example/1/2/3/4/5", "allow", 1), ("Bad.Example.COM", "block", 1),
        ("Up.Example/X", "block", 1), ("up.example/X", "remove", 9), ("n.example/", "block", 1),
    ]
    cases = [
        ("http://a.example/1/2", False, None), ("http://a.example/1/2/3", True, "a.example/1/2/3"),
        ("http://a.example/1/2/3/4", True, "a.example/1/2/3"), ("http://a.example/1//2/3/4/5/6", False, "a.example/1/2/3/4/5"),
        ("http://bad.example.com/", True, "bad.example.com"), ("http://user:pw@www.bad.example.com:80/", True, "bad.example.com"),
        ("http://u@x@bad.example.com", True, "bad.example.com"), ("http://user@ok.example/@bad.example.com", False, None),
        ("http://bad.example.com@ok.example/", False, None), ("http://up.example/X/y", True, "up.example/X"),
        ("http://up.example/x", False, None), ("http://ok.example?a@bad.example.com", False, None),
    ]
    for r in judge([(i, u, 5, "x", "y") for i, (u, *_) in enumerate(cases)], log).collect():
        assert (r["blocked"], r["rule"]) == cases[r["page_id"]][1:], cases[r["page_id"]]
    after = judge([(1, "http://up.example/X", 9, "x", "y")], log).collect()
    assert [r["blocked"] for r in after] == [False]  # both spellings are one rule


def test_empty_list_and_table(judge):
    assert [r["blocked"] for r in judge([(1, "http://a.b", 1, "", "")], []).collect()] == [False]
    assert judge([], LOG).count() == 0


def test_plan_is_native(judge):
    plan = judge([(1, "http://a.b", 1, "", "")], LOG)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_op3_against_sql(spark, sf_dir):
    from commentlab.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    result = con.execute(SQL["op3_url_filters"])
    names = [d[0] for d in result.description]
    want = sorted(map(repr, result.fetchall()))
    out = QUERIES["op3_url_filters"](spark, sf_dir)
    assert out.columns == names
    assert sorted(repr(tuple(r)) for r in out.collect()) == want
