import random

import pytest

from gridsight.llm import html_text as h


def texts(page):
    return [b.text for b in h.blocks(page)]


@pytest.mark.parametrize("page,want", [
    ("", []), ("plain  text\n here", ["plain text here"]),
    ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
    ("<p><b>x<br>y</b> z<br><p>w", ["x y z", "w"]),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]),
    ("a&amp;b &eacute;&#233;&#xe9; &nbsp;&amp &am", ["a&b ééé & &am"]),
    ("<script>if (a<b) '</p>'</script><style>p{}</style><p>k</p><!-- <p>no</p> -->", ["k"]),
    ("<p title=\"a>b\">x</p><textarea><p>raw</textarea>", ["x", "<p>raw"]),
    ("<title>t</title><p>1 < 2 & 3</p>", ["1 < 2 & 3"]),
    ("<p>cut <b>off</b", ["cut off"]), ("</div></p>x</article>", ["x"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<p>un<i>broken</i> word</p>", ["unbroken word"]), ("<![CDATA[x]]>", ["x"]),
])
def test_blocks(page, want):
    assert texts(page) == want


@pytest.mark.parametrize("page,want", [
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p>", ["so x=2 holds"]),
    ("<p>a</p><object data=f>no plug-in</object><noscript>no <b>script</b></noscript>b",
     ["a", "no plug-in", "no script", "b"]),
    ("<p>a<noscript>b</noscript>c</p>", ["a", "b", "c"]),
    ("<html><head><title>t</title><meta name=x><p>a<p>b", ["a", "b"]),
    ("<head><link href=x><style>p{}</style><article><h1>a</h1></article></html>", ["a"]),
    ("<head><title>t</title>\n a text<p>b", ["a text", "b"]),
    ("<head><noscript><style>p{}</style></noscript><script>x</script></head><p>a", ["a"]),
    ("<head><noscript><img src=x></noscript><meta name=x></head><body><p>a", ["a"]),
    ("<head><template><p>no</p></template><title>t</title></head><body>a", ["a"]),
    ("<p>a</p><template><p>no</p></template><svg><text>no</text></svg>b", ["a", "b"]),
])
def test_only_unseen_text_is_silent(page, want):
    assert texts(page) == want


def test_chain_maximises_likelihood():
    """The gradient agrees with differences of the exact likelihood."""
    import itertools

    import numpy as np
    rows = [np.array([0, 1]), np.array([1]), np.array([2]), np.array([0, 2])]
    y = np.array([1, 0, 0, 1])
    theta = np.random.default_rng(0).normal(size=9)

    def score(path, t):
        s = t[7 + path[0]] + sum(t[r].sum() for r, p in zip(rows, path) if p)
        return s + sum(t[3 + 2 * a + b] for a, b in zip(path, path[1:]))

    def loss(t):
        every = [score(p, t) for p in itertools.product((0, 1), repeat=4)]
        return np.logaddexp.reduce(every) - score(tuple(y), t)

    got = h._slope(rows, y, theta, 3)
    for i in range(9):
        step = np.zeros(9)
        step[i] = 1e-6
        assert abs(got[i] - (loss(theta + step) - loss(theta - step)) / 2e-6) < 1e-5


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np
    pick = np.random.default_rng(1)
    page = h.blocks("<p>One two.</p><div class=ad>x</div><h2>Y</h2><p>three four five</p><footer>z</footer>")
    names = sorted({f for x in h.features(page) for f in x})
    for _ in range(30):
        chain = h.Chain({f: float(pick.normal()) for f in names}, pick.normal(size=(2, 2)), pick.normal(size=2))
        gains = [sum(chain.weights[f] for f in x) for x in h.features(page)]

        def score(path):
            s = chain.start[path[0]] + sum(g for g, p in zip(gains, path) if p)
            return s + sum(chain.moves[a, b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=len(page)), key=score)
        assert [int(x) for x in chain.decode(page)] == list(best)


@pytest.fixture(scope="module")
def chain():
    import duckdb
    pages = [r[0] for r in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' ORDER BY page_id").fetchall()]
    return h.train(h.labelled(pages[:100])), pages[100:]


def test_held_out_pages(chain):
    """Unseen pages and unseen variants of them."""
    model, pages = chain
    for page in pages:
        want = [b.text for b in h.blocks(page) if "article" in b.tags]
        assert h.main_text(page, model) == "\n\n".join(want)
    pick = random.Random(77)
    articles = [[b.text for b in h.blocks(p) if b.main] for p in pages[:60]]
    other = [t for a in articles for t in a]
    wrong = total = 0
    for a in articles:
        page = h.variant(a, other, pick)
        got = model.decode([b for b, _ in page])
        wrong += sum(x != y for x, (_, y) in zip(got, page))
        total += len(page)
    assert wrong <= 0.01 * total


def test_other_layouts(chain):
    model, _ = chain
    body = "".join(f"<p>This is paragraph {i} of the story, and it goes on for a few more words.</p>" for i in range(4))
    page = f"""<html><head><title>T</title></head><body><header><div class="logo">Site</div>
      <nav><a href="/">Home</a> <a href="/x">News</a></nav></header>
      <div class="cookie-banner">We use cookies. <button>OK</button></div>
      <main><article><h1>The story</h1>{body}<aside class="related">Read also: something else that happened.</aside>
      <form><label>Your mail</label><input></form>
      <section id="comments"><h3>Comments</h3><p>I liked this story a lot, thanks for it.</p></section></article></main>
      <div class="sidebar"><p>Most read stories of the week are here for you.</p></div>
      <footer><p>Copyright by us.</p></footer></body></html>"""
    want = ["The story"] + [f"This is paragraph {i} of the story, and it goes on for a few more words." for i in range(4)]
    assert h.main_text(page, model) == "\n\n".join(want)


def test_without_labelled_pages():
    model = h.train(h.labelled([]))
    assert h.main_text("<nav><a href=x>a</a></nav><article><p>Some text of the page.</p></article>", model) \
        == "Some text of the page."


def test_deep_pages_take_linear_time():
    """200,000 open elements, with text in each, and end tags that close nothing."""
    import time

    began = time.time()
    deep = h.blocks("<article>" + "<div class=story><b>x</b></section>" * 200_000)
    assert len(deep) == 200_000 and time.time() - began < 60
    assert deep[-1].tags == {"article", "div"} and deep[-1].parent == "div" and deep[-1].main
    assert deep[-1].names == {"content"}
    closed = h.blocks("<nav>" * 1000 + "m" + "</nav>" * 1000 + "<p>free")
    assert closed[0].apart and not closed[-1].apart and closed[-1].tags == {"p"}
