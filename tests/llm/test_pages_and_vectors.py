import math

import numpy as np
import pytest
import text_brute as brute

from kithgraph.llm import html_main, vectors
from kithgraph.llm.html_main import Page, main_text


def clean(html):
    return Page(html).content(None)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<article><h1>T &amp; U</h1><p>a  b<br>c<p>d &lt;x&gt;&nbsp;e</article><footer>no</footer>", "T & U\na b c\nd <x> e"),
        ("<html><body><header><h1>Site</h1></header><div id=content><h1>Hi  there</h1>one<p>two<div class='comments'><article>bad</article></div><script>x<p></script>tail</div><footer>f", "Hi there\none\ntwo\ntail"),
        ("<div class=has-sidebar><main><article><header><h1>T</h1></header><p>x</p><aside>no</aside><ul><li>a<li>b</ul><form><p>sub</form><table><tr><td>1<td>2</table></article><section id='comments'><article><p>" + "c" * 500 + "</article></section></main></div>", "T\nx\na\nb\n1\n2"),
        ("<main><p>a</p><div role=navigation>n</div><div hidden>h</div><p style='display: none'>s</p><div class='cookie-notice'>c</div></main>", "a"),
        ("<nav><ul><li>n</ul></nav><div class=ad>buy</div><p>only <b>bold<i>er</i></b> text<!-- <p>no --></p><noscript>js</noscript>", "only bolder text"),
        ("a<!-- x --> b <b>c", "a b c"),
        ("1 < 2 and <3 x &bogus; &#65;&#x42;", "1 < 2 and <3 x &bogus; AB"),
        ("<title>t</title><textarea><p>no", ""),
        ("", ""),
        ("<nav>n</nav><article><p>one</article><div>between</div><article><p>two</article>", "one\ntwo"),
        ("<p>" + "".join(f"<x{i}>" for i in range(30)) + "deep" + "".join(f"</x{i}>" for i in range(29, -1, -1)) + "<u1>after", "deepafter"),
        ("<p>a</p></div></p><p title='>'>b", "a\n\nb".replace("\n\n", "\n")),
    ],
)
def test_pages(html, text):
    assert clean(html) == text


def page(article, menu="<div><a href=/x>Home</a> <a href=/y>News</a></div>", foot="<div>All rights reserved by Us</div>"):
    return f"<html><body>{menu}<div>{article}</div>{foot}</body></html>"


def test_templates_go_without_any_marks(spark):
    rows = [(i, "http://www.a.example/" + str(i), page(f"<p>Story {i} has words</p><p>and more {i * 7}</p>")) for i in range(8)]
    rows += [(20, "http://b.example/1", page("<p>lone</p>")), (21, None, page("<p>no host</p>")), (22, "http://a.example/9", None), (23, "http://a.example/10", ""), (None, "http://a.example/11", page("<p>Story x</p>"))]
    rows += [(30 + i, f"http://c.example/{i}", page("<p>same story everywhere</p>")) for i in range(9)]  # copies are no template
    rows += [(0, "http://www.a.example/0", page("<p>Story 0 has words</p><p>and more 0</p>"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as trees", "2 as row", "3 as host")
    got = {}
    for r in main_text(frame).collect():
        got.setdefault(r["page_id"], []).append((r["text"], r["n_chars"]))
    assert got[3] == [("Story 3 has words\nand more 21", 29)] and got[0] == [("Story 0 has words\nand more 0", 28)] * 2 and got[None] == [("Story x", 7)]
    assert got[20][0][0] == "Home News\nlone\nAll rights reserved by Us" and "no host" in got[21][0][0]
    assert got[22] == got[23] == [("", 0)] and all("same story everywhere" in got[30 + i][0][0] for i in range(9))
    assert main_text(frame.filter("false")).count() == 0


def test_articles_keep_repeated_prose(spark):
    rows = [(i, "http://a.example/" + str(i), f"<article><p>The same opening line.</p><p>Body {i}</p><div><a href=1>Share this</a> <a href=2>Mail this</a></div></article>") for i in range(9)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"The same opening line.\nBody {i}" for i in range(9)}


def test_recurrence_decides_on_large_hosts(spark):
    """Menus that differ by page go by their shells, unmarked footers by their subtrees; a single aside is no template."""
    rows = [(i, f"http://a.example/{i}", f"<nav><a href=1>To {i}</a></nav><article><h1>T{i}</h1><p>Body {i}</p></article>" + ("<aside>odd</aside>" if i == 3 else "") + "<div>All rights</div>") for i in range(9)]
    rows += [(20 + i, f"http://b.example/{i}", rows[i][2]) for i in range(4)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"T{i}\nBody {i}" + ("\nodd" if i == 3 else "") for i in range(9))
    assert all(got[20 + i] == f"T{i}\nBody {i}" for i in range(4))


def test_very_long_pages(spark):
    story = "".join(f"<p>line {i} &amp; <i>more</i></p>" for i in range(60_000))
    rows = [(i, f"http://a.example/{i}", f"<div>Menu of all pages</div><section><h2>Page {i}</h2>{story if i == 2 else '<p>short'}</section>") for i in range(6)]
    rows.append((9, "http://b.example/", "<b>" * 5_000 + "deep" + "</i>" * 5_000))
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2] == "Page 2\n" + "\n".join(f"line {i} & more" for i in range(60_000)) and got[4].startswith("Page 4") and got[9] == "deep"


def plain_subtrees(html):
    """Every element's subtree as text, found by the standard library's parser, for pages whose elements are all closed."""
    from html.parser import HTMLParser

    stack, out = [("#", [])], []

    class Reader(HTMLParser):
        def handle_starttag(self, tag, attrs):
            stack.append((tag, []))

        def handle_endtag(self, tag):
            name, held = stack.pop()
            assert name == tag
            out.append((name, repr(held)))
            stack[-1][1].append((name, repr(held)))

        def handle_data(self, data):
            if data.split():
                stack[-1][1].append(" ".join(data.split()))

    Reader().feed(html)
    return out


def test_templates_against_plain_counts(spark):
    rng = np.random.default_rng(3)
    menus, notes = [f"<ul><li>m{k}</li><li>x</li></ul>" for k in range(3)], [f"<div><b>note {k}</b></div>" for k in range(5)]
    rows = []
    for i in range(120):
        body = f"<section><p>a story of its own, number {i}, longer than lines</p>" + "".join(f"<p>line {rng.integers(0, 200)}</p>" for _ in range(2)) + "</section>"
        rows.append((i, f"http://h{rng.integers(0, 4)}.example/{i}", f"<div>{menus[rng.integers(0, 3)]}{notes[min(4, rng.geometric(0.5) - 1)]}</div>{body}"))
    held, pages = {}, {}
    for i, url, html in rows:
        host = html_main.host_of(url)
        pages.setdefault(host, set()).add(i)
        for tree in set(plain_subtrees(html)):
            if tree[0] in html_main.BLOCK:
                held.setdefault((host, tree), set()).add(i)
    expect = {}
    for (host, _), at in held.items():
        expect[host] = expect.get(host, 0) + (len(at) >= max(5, 0.1 * len(pages[host])))
    found = html_main.subtrees(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = html_main.site_templates(found).filter(f"tree <> {html_main.SITE}").groupBy("host").count().collect()
    assert {r["host"]: r["count"] for r in got} == {h: n for h, n in expect.items() if n}


def test_pages_of_the_table(spark, data):
    import re
    from html import unescape

    pages, changed = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/pages.parquet"), 0
    got = {r["page_id"]: r["text"] for r in main_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<(br|/?b)>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)
        changed += Page(r["html"]).content(set()) != got[r["page_id"]]
    assert changed > 100  # without their site's templates


def test_hosts():
    assert [html_main.host_of(u) for u in ("https://u:p@WWW.Ex.org:80/x?q=//y", "//a.b/c", "mailto:x", None, "http://[::1]:8/")] == ["ex.org", "a.b", "", "", "[::1]"]


# ---------------------------------------------------------------- vectors


def expected(rows, least=0.98):
    use = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            use[k] = (label, len(v), x / np.linalg.norm(x))
    links = [(a, b) for a in use for b in use if a < b and use[a][:2] == use[b][:2] and use[a][2] @ use[b][2] >= least]
    degree = [sum(k in e for e in links) for k in range(len(rows))]
    root = brute.components(range(len(rows)), links)
    low = {}
    for k, (i, *_r) in enumerate(rows):
        if i is not None:
            low[root[k]] = min(low.get(root[k], i), i)
    return sorted((str(i), degree[k], str(low.get(root[k]))) for k, (i, *_r) in enumerate(rows))


def test_vectors_on_edges(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 16))
    rows = []
    for k in range(160):
        v = base[k % 12] + rng.normal(size=16) * rng.choice([0.0, 0.02, 0.1, 0.4])
        rows.append((k, [float(np.float32(x)) for x in v], int(k % 3) if k % 12 < 9 else 7))
    rows += [(200, None, 1), (201, [], 1), (202, [0.0] * 16, 1), (203, [None] + [1.0] * 15, 1), (204, [math.nan] + [1.0] * 15, 1), (205, [math.inf] + [1.0] * 15, 1), (206, rows[0][1], None)]
    rows += [(207, rows[5][1], rows[5][2]), (207, rows[5][1], rows[5][2]), (None, rows[5][1], rows[5][2]), (208, [1.0, 2.0], 1), (209, [2.0, 4.0], 1), (210, [1e300, 1e300], 1), (211, [-0.0, 1.0], 4), (212, [0.0, 1.0], 4)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as node", "'x' as class", "2 as cell", "3 as n")
    got = vectors.near_vectors(frame, per_cell=16, margin=0.1).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == expected(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert vectors.near_vectors(frame.filter("false")).count() == 0 and vectors.near_vectors(frame.filter("label is null")).count() == 1


def test_vectors_in_many_blocks(spark, data, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 24)
    frame = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    got = vectors.near_vectors(frame, per_cell=64).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == expected(rows)


@pytest.mark.parametrize("size", [4, 16, 64, 256])
def test_planted_links_are_found(spark, size):
    """Pairs just within the threshold, with the shipped settings: 1,200 vectors in several cells, none lost."""
    rng = np.random.default_rng(size)
    x = rng.normal(size=(600, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(axis=1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    near = 0.9801 * x + np.sqrt(1 - 0.9801**2) * away
    v = np.concatenate([x, near])
    frame = spark.createDataFrame([(k, row.tolist(), 1) for k, row in enumerate(v)], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(frame, per_cell=40).collect()}
    assert [got[k] for k in range(1200)] == ((v @ v.T >= 0.98).sum(axis=1) - 1).tolist() and min(got.values()) >= 1


@pytest.mark.parametrize(("size", "least"), [(4, 0.98), (6, 0.9)])
def test_vectors_of_few_dimensions_meet_across_cells(spark, size, least):
    x = np.random.default_rng(size).normal(size=(500, size))
    frame = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= least
    got = {r["vec_id"]: r for r in vectors.near_vectors(frame, least=least, per_cell=16).collect()}
    assert [got[k]["n_links"] for k in range(500)] == (near.sum(axis=1) - 1).tolist()
    low = np.arange(500)
    while (low != (new := np.where(near, low, 500).min(axis=1))).any():
        low = new
    assert [got[k]["component_id"] for k in range(500)] == low.tolist()
