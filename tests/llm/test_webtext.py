import html
import random
import re
import time
from collections import defaultdict

import pytest
from conftest import SMALL

from motionspark.llm import webtext

LETTERS = "x" * 30


def text_of(page):
    return webtext.main_text(page, set())


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""),
        ("", ""),
        ("just words", "just words"),
        ("<p>a<p>b", "a\nb"),
        ("<p>a &amp; b&nbsp;c &lt;p&gt; &#233;</p>", "a & b c <p> é"),
        ("a < b, 1<2 <3", "a < b, 1<2 <3"),
        ("<article><h1>Title</h1><p>one <b>two</b>\n\t three<br>four</p></article><p>out</p>", "Title\none two three four"),
        ("<head><title>t</title><p>body without a tag", "body without a tag"),
        ("<head><script>var a='<p>x</p>'</script></head><body><nav>menu</nav><p>text", "text"),
        ("<body class='has-sidebar no-ads'><div id=\"cookieNotice\">we use</div><div class=content><p>text</p></div>", "text"),
        ("<header>site</header><article><header><h1>Head</h1></header>x<footer>by</footer></article>", "Head\nx"),
        ("<main><p>x</p><section class='comments'><article class='comment'>me too</article></section></main>", "x"),
        ("<article><p>Hello <span class='ad'>buy <i>now</i></span> world</p></article>", "Hello world"),
        ("<article>a<!-- <p>no</p> --><script>b</script><style>c</style><form>mail <input></form><aside>s</aside>d</article>", "a\nd"),
        ("<article>kept<script>never closed <p>x", "kept"),
        ("<article>kept<!-- never closed <p>x", "kept"),
        ("<article><p class=notice>n<p>t<ul><li class=ad>b<li>c</ul></article>", "t\nc"),
        ("<div role=main>m</div><div>o</div>", "m"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<ARTICLE><P TITLE='a>b'>x</P></ARTICLE>", "x"),
        ("</p></div>a</article><p>b", "a\nb"),
        ("<article><p>fi\nrst</p></article><article>second</article>", "fi rst\nsecond"),
        ("<div class='advertorial'>story</div><div class='adverts'>x</div>", "story"),
    ],
)
def test_pages(page, want):
    assert text_of(page) == want


def longest(a, b):
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    return n[-1][-1]


def test_shared_places_are_a_longest_common_subsequence():
    draw = random.Random(2)
    for _ in range(400):
        a, b = ([draw.randint(0, draw.choice((2, 9, 40))) for _ in range(draw.randint(0, 30))] for _ in range(2))
        places = webtext.shared_places(a, b)
        assert len(places) == longest(a, b) and places == sorted(set(places))
        rest = iter(b)
        assert all(any(a[p] == y for y in rest) for p in places)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def furnished(body, *furniture):
    top, bottom = furniture
    return f"<html><body><div>{top}</div>" + "".join(f"<div>{b}</div>" for b in body) + f"<div>{bottom}</div></body></html>"


def site(draw):
    """Pages without any telling markup on hosts of several sizes, one far larger than a stretch; and what is each one's own."""
    rows, own = [], {}
    for h, size in (("a.example", 700), ("b.example", 3), ("c.example", 1)):
        for i in range(size):
            body = [f"{h} {i} {k} " + "".join(draw.choice("abcdef ") for _ in range(40)) for k in range(draw.randint(1, 6))]
            rows.append((len(rows), f"https://{h}/s{i % 7}/p{i}?q={i}", furnished(body, f"Menu of {h}", f"(c) {h}")))
            own[len(rows) - 1] = "\n".join(" ".join(b.split()) for b in body) if size > 1 else None
    return rows, own


def test_unmarked_furniture_goes_by_differencing(spark, monkeypatch):
    monkeypatch.setattr(webtext, "RANGE", 50)
    monkeypatch.setattr(webtext, "STRETCH", 20)
    rows, own = site(random.Random(4))
    rows += [(9000, rows[5][1] + "&again=1", rows[5][2]), (9001, None, rows[6][2]), (9002, "no url", rows[6][2])]
    found = {r.page_id: (r.text, r.n_shared) for r in webtext.extract(pages_of(spark, rows)).collect()}
    for i, text in own.items():
        assert found[i] == (text, 2) if text is not None else found[i][1] == 0
    assert found[9000] == found[5] and found[9001] == found[9002] == (text_of(rows[6][2]), 0)


def test_neighbours_and_shared_lines_against_brute_force(spark, monkeypatch):
    """Counts of shared lines, with copies and near copies, over limits of ranges and stretches."""
    monkeypatch.setattr(webtext, "RANGE", 30)
    monkeypatch.setattr(webtext, "STRETCH", 7)
    draw = random.Random(9)
    rows = []
    for i in range(260):
        lines = [draw.choice(["menu", "ad one", "ad two", "foot"]) for _ in range(draw.randint(0, 4))] + [f"own {i} {LETTERS}" for _ in range(draw.randint(0, 2))]
        inner = "".join(f"<div>{x}</div>" for x in lines)
        marked = f"<article>story {i}</article>" if draw.random() < 0.5 else ""
        rows.append((i, f"http://{draw.choice('xyz')}.example:80/{draw.randint(0, 40)}/{i}", marked + inner if draw.random() < 0.9 else rows[-1][2] if rows else ""))
    hosts = defaultdict(dict)
    for _, url, page in rows:
        h, p = re.match(r"http://([^/:]+):80([^?]*)", url).groups()
        hosts[h][page] = min(p, hosts[h].get(page, p))
    from hashlib import md5

    want = {}
    for h, pages in hosts.items():
        order = sorted(pages, key=lambda page: (pages[page], md5(f"{h}\n{page}".encode()).hexdigest()))
        for i, page in enumerate(order):
            found = webtext.lines(page)
            marked, mine = any(k == webtext.ARTICLE for _, k in found), [t for t, k in found if k != webtext.ARTICLE]
            shared = set()
            for near in order[max(0, i - 2) : i] + order[i + 1 : i + 3]:
                same = webtext.shared_places(mine, [t for t, k in webtext.lines(near) if k != webtext.ARTICLE])
                if marked or sum(len(mine[p]) for p in same) < 0.8 * sum(map(len, mine)):
                    shared.update(same)
            want[h, page] = len(shared)
    found = webtext.extract(pages_of(spark, rows), keep=("page_id", "url", "html")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.n_shared == want[webtext.re.match(r"http://([^/:]+)", r.url)[1], r.html]
    assert sum(r.n_shared for r in found) > 100


def test_every_page(spark):
    """The given pages' articles, cut out by their fixed template."""
    for folder in (SMALL, "/root/testdata/sf0.01"):
        page = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
        rows = webtext.op12_webtext(spark, folder).collect()
        assert len(rows) == len(page)
        for r in rows:
            article = re.search(r"<article>(.*)</article>", page[r.page_id].html, re.DOTALL)[1]
            blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:h1|p)>", article)]
            assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text) and r.url == page[r.page_id].url


def test_odd_rows(spark):
    rows = [(1, "http://h.example/a", None), (1, "http://h.example/a", None), (None, None, None), (None, "http://h.example/b", "<p>x"), (2, "//H.example/c", ""), (3, "", "<p>y")]
    docs = pages_of(spark, rows).selectExpr("*", "'k' AS key", "'r' AS row", "'h' AS host", "'t' AS text", "0 AS shared")
    found = sorted(((r.page_id, r.url, r.text) for r in webtext.extract(docs).collect()), key=repr)
    assert found == sorted([(i, u, {None: "", "": ""}.get(h, (h or "")[3:])) for i, u, h in rows], key=repr)
    assert webtext.extract(docs.limit(0)).columns == ["page_id", "url", "text", "n_shared"] and webtext.extract(docs.limit(0)).count() == 0


@pytest.mark.parametrize("make", [lambda n: "<a " * n, lambda n: "<a =\"'" * n, lambda n: "<div>" * n + "</span>" * n, lambda n: "<p>w" * n, lambda n: "<!-" * n, lambda n: "<script" * n, lambda n: "<li>x<p>" * n, lambda n: "&" * n, lambda n: "<div class='ad'>" * n])
def test_time_grows_with_length(make):
    took = []
    for n in (10_000, 40_000):
        page, start = make(n), time.process_time()
        webtext.lines(page)
        took.append(time.process_time() - start)
    assert took[1] < 8 * took[0] + 0.3
    many = list(range(20_000))
    start = time.process_time()
    assert webtext.shared_places(many, many[::2]) == many[::2] and time.process_time() - start < 10
