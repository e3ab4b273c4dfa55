import pytest

from driftframe.llm import html_extract as h


def blocks(page):
    return h.parse(page).text


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a &amp;amp; b&nbsp;&lt;c&gt;\n d<br>e</p>", ["a &amp; b <c> d e"]), ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]), ("<p><b>a<br><p>b</p>", ["a", "b"]),
        ("x<script>var t='</p>';</script>y<style>p{}</style><!-- <p>no</p> -->z", ["xyz"]), ("a < b and c > d", ["a < b and c > d"]), ('<p title="x > y" class=\'q\'>in</p>', ["in"]), ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
        ("<p>open <b>bold", ["open bold"]), ("</p></div>text</span>", ["text"]), ("<p>a</p", ["a"]), ("<script>never closed <p>x</p>", []), ("", []), ("<p> \n&nbsp; </p>", []), ('<p a="unclosed>t</p><p>u</p>', ["t", "u"]), ("caf&eacute; &#233; &bogus;", ["café é &bogus;"]),
        ("<textarea>no</textarea><title>no</title><p>yes</p><img src='a>b'>", ["yes"]),
    ],
)
def test_blocks(page, want):
    assert blocks(page) == want


def test_odd_markup_takes_linear_time():
    for page in ("<" * 200_000, '<a "' * 50_000, "<p>" * 50_000, "<!--" * 50_000, "<b>" * 20_000 + "x", '<p a="' + "x" * 200_000):
        h.parse(page)


@pytest.mark.parametrize(
    "page",
    ["<div>x" * 100_000, "<b>" * 100_000 + "</i>" * 100_000, "<b>" * 50_000 + "<p></p>" * 50_000, "<script>" + "</script " * 50_000, "<a " + '"x>" ' * 50_000, "<li><p>x" * 50_000, "<a>" * 50_000 + "</div>x" * 50_000],
    ids=range(7),
)
def test_deep_markup_takes_linear_time_and_little_memory(page):
    import time
    import tracemalloc

    begin = time.process_time()
    h.parse(page)
    assert time.process_time() - begin < 1.5
    tracemalloc.start()
    h.parse(page)
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_all_shown_text_is_judged():
    net = h.default_network()
    article = "<article><h1>Areas of the world</h1><p>area is <math><mi>x</mi><mo>+</mo><mn>1</mn></math> units</p><p>A drawing <svg><text>with words</text></svg> of its own.</p><noscript><p>Shown without scripts, and part of this article as well.</p></noscript></article>"
    want = "Areas of the world\n\narea is x+1 units\n\nA drawing with words of its own.\n\nShown without scripts, and part of this article as well."
    assert h.extract_pages([f"<nav><ul><li><a>Home</a></li></ul></nav>{article}<footer>all rights</footer>"], net) == [want]


def test_a_menu_twenty_levels_deep_is_a_menu():
    net = h.default_network()
    body = "<article><h1>Title of it</h1><p>The text of this page is long enough to be read by all.</p></article>"
    want = "Title of it\n\nThe text of this page is long enough to be read by all."
    deep = lambda inner: "<div>" * 20 + inner + "</div>" * 20
    items = "<ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul>"
    for page in (f"<nav>{deep(items)}</nav>{body}", f'<div class="menu">{deep(items)}</div>{body}', f"{body}<footer>{deep('<p>some words of the owner</p>')}</footer>", deep(f"<nav>{items}</nav>{body}")):
        assert h.extract_pages([page], net) == [want]
    assert len({h.parse(f"<nav>{'<div>' * n}x").path[0] for n in (3, 30, 300)}) == 1


def test_network_gradient():
    import numpy as np

    net = h.Network.start(1)
    pages = [h.parse(p) for p, _ in h.labelled_pages(3, seed=5)]
    x, first = h.features(pages)
    y = (np.arange(len(x)) % 2).astype(np.float32)
    loss = lambda: -np.mean(np.log(np.where(y > 0, p := h.judge(net, x, first).astype(float), 1 - p)))
    for w, g in zip([*net.into, *net.over, net.out], h._slopes(net, x, first, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, eps = w[at], 1e-2
        w[at] = kept + eps
        up = loss()
        w[at] = kept - eps
        down = loss()
        w[at] = kept
        assert abs((up - down) / (2 * eps) - g[at]) < 0.05 * abs(g[at]) + 1e-4


def test_held_out_accuracy_and_independence_of_company():
    net = h.default_network()
    pages = h.labelled_pages(200, seed=404)
    right = whole = 0
    together = h.extract_pages([p for p, _ in pages], net)
    for (page, kept), text in zip(pages, together):
        said = blocks(page)
        got = set(text.split("\n\n")) - {""}
        right += sum((t in got) == (t in kept) for t in said)
        whole += len(said)
    assert right / whole > 0.995
    assert h.extract_pages([pages[7][0]], net) == [together[7]]


def test_pages_table(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r for r in h.extract(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>", "", p).replace("<br>", " ")).split()) for p in re.split("</?(?:p|h1)>", article)]
        want = "\n\n".join(p for p in parts if p)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, None, "<p>" + "word " * 50_000), (4, "u", "<article><h1>T</h1><p>Some text here, long enough to read.</p></article>"), (4, "u", "<article><h1>T</h1><p>Some text here, long enough to read.</p></article>"), (5, "u", "no tags")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'c' as text", "'c' as n_chars")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in h.extract(df).collect()), key=str)
    assert len(got) == 6 and (1, "", 0) in got and (2, "", 0) in got and got.count((4, "T\n\nSome text here, long enough to read.", 39)) == 2
    assert all(n == len(t) for _, t, n in got)
    assert h.extract(df.limit(0)).count() == 0
