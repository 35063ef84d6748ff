"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is read into leaf blocks: runs of text between the starts and ends of block elements,
with the tags and the name words (class, id, role) of all elements around them. Each block
gets indicator features of its ancestors and its text, and a two-state chain with learned
emission and transition weights decides by Viterbi which blocks are main text.

The chain is trained here on a bounded sample of labelled pages. A page labels itself where
its markup names the article (article, main or role=main): blocks inside it are main text,
except those in menus, headers, footers, sidebars, forms and the like. Each labelled page is
also given in variants that other sites would use: the article as a plain division, menus and
footers as named divisions, and notices, share bars, related links, sign-up forms and reader
comments put in front, among and behind its paragraphs, with texts of other sampled pages.
So the model learns what all these look like, also without the landmark elements.

Defined results: a null html counts as empty; a page without main text gives an empty text;
markup that is cut off or badly nested is read as far as it goes; repeated rows give the same
text; without any labelled page only the built-in layouts, filled with plain words, are
learned from; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridsight.llm.registry import query, read

#: Pages to learn from, a documented bound, and variants of each.
MAX_PAGES = 120
VARIANTS = 4
EPOCHS = 20
#: Bytes of html of a page to learn from; longer ones are left out of the sample.
MAX_HTML = 60_000

# Elements of HTML by how they are laid out.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead "
    "tr ul button iframe canvas video audio object noscript".split())
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split())
SILENT_TAGS = frozenset("script style template title head svg iframe".split())
#: Elements that leave an open head open; any other element, or text, ends it.
HEAD_TAGS = frozenset("html head base basefont bgsound link meta noframes noscript script style "
                      "template title".split())
RAW_TAGS = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Start tags that end an open element of the second set, up to one of the third.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_PARAGRAPH = BLOCK_TAGS - {"body", "html", "button", "option", "optgroup", "iframe", "canvas",
                               "video", "audio", "object", "noscript"}
PARAGRAPH_SCOPE = frozenset("article aside blockquote body div footer form header html li main nav "
                            "section table td th ul ol".split())
FORMATTING = frozenset("a abbr b big cite code em font i mark q s small span strong sub sup tt u".split())
#: Landmark elements that never hold the article's own text.
APART = frozenset("nav footer aside form button select textarea dialog menu".split())
APART_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())

#: Word stems in names of elements, by what they tell.
HINTS = {
    "menu": ("nav", "menu", "breadcrumb", "toc", "pagination", "pager", "skip", "tabs"),
    "advert": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner",
               "adsbygoogle", "dfp", "taboola", "outbrain"),
    "comment": ("comment", "comments", "reply", "replies", "discussion", "disqus", "respond",
                "reader", "responses", "thread"),
    "side": ("sidebar", "side", "aside", "rail", "widget", "related", "recommended", "more", "trending",
             "popular", "teaser", "latest"),
    "foot": ("footer", "foot", "copyright", "colophon", "legal", "imprint"),
    "head": ("header", "masthead", "topbar", "logo", "branding", "sitename"),
    "notice": ("notice", "cookie", "cookies", "consent", "gdpr", "alert", "warning", "popup", "modal",
               "overlay", "message", "announcement", "disclaimer", "paywall"),
    "form": ("form", "search", "login", "signup", "signin", "subscribe", "newsletter", "register"),
    "share": ("share", "sharing", "social", "follow", "like", "tools", "meta", "tags", "byline"),
    "hidden": ("hidden", "invisible", "offscreen", "sr"),
    "content": ("article", "content", "post", "entry", "story", "main", "text", "body", "prose"),
}
_HINT_OF = {word: kind for kind, words in HINTS.items() for word in words}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(
    r"""(class|id|role|aria-label|aria-hidden|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>]|\Z)""",
    re.I)
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    tags: frozenset[str]
    parent: str
    names: frozenset[str]  # kinds of HINTS around the block
    linked: float  # share of characters inside links
    main: bool = False  # inside article, main or role=main
    apart: bool = False  # inside a landmark that holds no main text


@dataclass
class _Open:
    tag: str
    names: frozenset[str] = field(default_factory=frozenset)
    role: str = ""


def _names(attributes: str) -> tuple[frozenset[str], str]:
    kinds, role = set(), ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
        if name == "role":
            role = value.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (
                name == "style" and re.search(r"display\s*:\s*none", value)):
            kinds.add("hidden")
        elif name != "style":
            for word in _NAME_WORD.findall(value):
                word = word.lower()
                kind = _HINT_OF.get(word) or _HINT_OF.get(word.rstrip("s"))
                if kind:
                    kinds.add(kind)
    return frozenset(kinds), role


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in page order."""
    out: list[Block] = []
    open_tags: list[_Open] = []
    # What is open, counted as it opens and closes, so that depth costs a block nothing.
    tag_counts: Counter[str] = Counter()
    name_counts: Counter[str] = Counter()
    role_counts: Counter[str] = Counter()
    parents = [""]  # open elements that are no mere formatting
    text: list[str] = []
    in_links = 0
    silent = links = 0  # open elements of these kinds

    def flush() -> None:
        nonlocal in_links
        if text:
            words = " ".join("".join(text).split())
            if words:
                tags = frozenset(tag_counts) - FORMATTING
                out.append(Block(
                    words, tags, parents[-1], frozenset(name_counts), min(1.0, in_links / len(words)),
                    bool({"article", "main"} & tags) or "main" in role_counts,
                    bool(APART & tags) or not APART_ROLES.isdisjoint(role_counts)))
            text.clear()
        in_links = 0

    def count(element: _Open, step: int) -> None:
        for counts, keys in ((tag_counts, (element.tag,)), (name_counts, element.names),
                             (role_counts, (element.role,))):
            for key in keys:
                counts[key] += step
                if not counts[key]:
                    del counts[key]

    def open_element(tag: str, attributes: str) -> None:
        element = _Open(tag, *_names(attributes))
        open_tags.append(element)
        count(element, 1)
        if tag not in FORMATTING:
            parents.append(tag)

    def close_to(n: int) -> None:
        nonlocal silent, links
        while len(open_tags) > n:
            if open_tags[-1].tag in BLOCK_TAGS:
                flush()
            gone = open_tags.pop()
            tag = gone.tag
            count(gone, -1)
            if tag not in FORMATTING:
                parents.pop()
            silent -= tag in SILENT_TAGS
            links -= tag == "a"

    def last(wanted: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> int:
        if not any(t in tag_counts for t in wanted):
            return -1
        for i in range(len(open_tags) - 1, -1, -1):
            if open_tags[i].tag in wanted:
                return i
            if open_tags[i].tag in scope:
                break
        return -1

    def end_head() -> None:
        i = last({"head"}, {"template"})
        while i >= 0:
            close_to(i)
            i = last({"head"}, {"template"})

    def say(part: str) -> None:
        nonlocal in_links
        if silent and open_tags[-1].tag == "head" and part.strip():
            end_head()
        if not silent and part:
            part = entities.unescape(part) if "&" in part else part
            text.append(part)
            if links:
                in_links += len(part.strip())

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        if m.group(2) is None:
            if m.group().startswith("<![CDATA["):
                say(m.group()[9:].removesuffix("]]>"))
            continue
        tag = m.group(2).lower()
        if m.group(1):
            i = last({tag}, frozenset() if tag in BLOCK_TAGS else BLOCK_TAGS - {"p"})
            if i >= 0:
                close_to(i)
            elif tag in BLOCK_TAGS:
                flush()
            continue
        if silent and tag not in HEAD_TAGS:
            end_head()
        if tag in ENDS_PARAGRAPH:
            i = last({"p"}, PARAGRAPH_SCOPE)
            if i >= 0:
                close_to(i)
        if tag in IMPLIED_ENDS:
            i = last(*IMPLIED_ENDS[tag])
            while i >= 0:
                close_to(i)
                i = last(*IMPLIED_ENDS[tag])
        if tag in BLOCK_TAGS:
            flush()
        if tag == "br":
            text.append(" ") if not silent else None
        if tag in VOID_TAGS or m.group(3).rstrip().endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            if tag == "textarea":
                open_element(tag, m.group(3))
                say(page[at:stop])
                close_to(len(open_tags) - 1)
            at = (page.find(">", stop) + 1 or len(page)) if end else len(page)
            continue
        open_element(tag, m.group(3))
        silent += tag in SILENT_TAGS
        links += tag == "a"
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Indicator features of every block."""
    out = []
    for i, b in enumerate(page):
        words = b.text.split()
        n = len(words)
        found = [f"in:{t}" for t in b.tags] + [f"name:{k}" for k in b.names]
        found.append(f"parent:{b.parent}")
        found.append("words:" + str(min(6, n.bit_length())))
        found.append("linked:" + str(int(b.linked * 4)))
        found.append("ends:" + ("stop" if b.text[-1] in ".!?…:;\"”" else "other"))
        if not b.names:
            found.append("unnamed")
        if b.apart:
            found.append("apart")
        if b.main and not b.apart:
            found.append("in_main")
        if "\xa9" in b.text or "(c)" in b.text.lower():
            found.append("copyright")
        if n and sum(w[0].isupper() for w in words) / n > 0.6 and n > 3:
            found.append("titled")
        if not any(c.isalpha() for c in b.text):
            found.append("no_letter")
        if i == 0:
            found.append("first")
        if i == len(page) - 1:
            found.append("last")
        out.append(found)
    return out


@dataclass
class Chain:
    """A two-state linear chain: state 1 is main text."""
    weights: dict[str, float]  # for state 1; state 0 weighs nothing
    moves: np.ndarray  # from state, to state
    start: np.ndarray

    def decode(self, page: list[Block]) -> list[bool]:
        """Viterbi."""
        if not page:
            return []
        gains = [sum(self.weights.get(f, 0.0) for f in x) for x in features(page)]
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = float(self.start[0]), float(self.start[1]) + gains[0]
        back = []
        for gain in gains[1:]:
            back.append((a + m00 < b + m10, a + m01 < b + m11))
            a, b = max(a + m00, b + m10), max(a + m01, b + m11) + gain
        state = b > a
        path = [state]
        for from_0, from_1 in reversed(back):
            state = from_1 if state else from_0
            path.append(state)
        return path[::-1]


def train(pages: list[list[tuple[Block, bool]]], epochs: int = EPOCHS, rate: float = 0.1,
          decay: float = 1e-3) -> Chain:
    """The chain of greatest likelihood (Adam on the exact gradient, L2 decay)."""
    number: dict[str, int] = {}
    encoded = []
    for page in pages:
        found = features([b for b, _ in page])
        rows = [np.array([number.setdefault(f, len(number)) for f in x]) for x in found]
        encoded.append((rows, np.array([int(y) for _, y in page])))
    size = len(number)
    theta = np.zeros(size + 6)  # emissions, four moves, two starts
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    order = np.random.default_rng(7)
    step = 0
    for _ in range(epochs):
        turn = order.permutation(len(encoded))
        for at in range(0, len(turn), 32):
            gradient = np.zeros_like(theta)
            batch = [encoded[i] for i in turn[at:at + 32] if encoded[i][0]]
            for rows, y in batch:
                gradient += _slope(rows, y, theta, size)
            gradient = gradient / max(1, len(batch)) + decay * theta
            step += 1
            first = 0.9 * first + 0.1 * gradient
            second = 0.999 * second + 0.001 * gradient ** 2
            theta -= rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return Chain({f: float(theta[i]) for f, i in number.items()}, theta[size:size + 4].reshape(2, 2),
                 theta[size + 4:])


def _slope(rows: list[np.ndarray], y: np.ndarray, theta: np.ndarray, size: int) -> np.ndarray:
    """Gradient of the negative log-likelihood of one page, by forward-backward."""
    n = len(rows)
    emit = np.zeros((n, 2))
    emit[:, 1] = [theta[r].sum() for r in rows]
    moves, start = theta[size:size + 4].reshape(2, 2), theta[size + 4:]
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = start + emit[0]
    for i in range(1, n):
        ahead[i] = np.logaddexp(ahead[i - 1, 0] + moves[0], ahead[i - 1, 1] + moves[1]) + emit[i]
    for i in range(n - 2, -1, -1):
        later = behind[i + 1] + emit[i + 1]
        behind[i] = np.logaddexp(moves[:, 0] + later[0], moves[:, 1] + later[1])
    total = np.logaddexp(*ahead[-1])
    belief = np.exp(ahead + behind - total)
    out = np.zeros_like(theta)
    for r, p, label in zip(rows, belief[:, 1], y):
        out[r] += p - label
    if n > 1:
        both = np.exp(ahead[:-1, :, None] + moves + (emit + behind)[1:, None, :] - total)
        expected = both.sum(axis=0)
        np.subtract.at(expected, (y[:-1], y[1:]), 1)
        out[size:size + 4] = expected.ravel()
    out[size + 4:] = belief[0]
    out[size + 4 + y[0]] -= 1
    return out


# Labelled pages.

#: Built-in layouts of what surrounds an article: (opening, closing, items, words of an item).
_AROUND = {
    "menu": [('<nav><ul>', '</ul></nav>', '<li><a href="#">{}</a></li>', (1, 3)),
             ('<div class="menu">', '</div>', '<a href="#">{}</a><br>', (1, 3)),
             ('<ul id="navigation">', '</ul>', '<li><a href="#">{}</a></li>', (1, 3))],
    "head": [('<header>', '</header>', '<div>{}</div>', (2, 6)),
             ('<div class="site-header">', '</div>', '<p>{}</p>', (2, 8)),
             ('<div id="masthead">', '</div>', '<span>{}</span>', (2, 6))],
    "foot": [('<footer>', '</footer>', '&copy; {}', (4, 14)),
             ('<div id="footer">', '</div>', '<p>&copy; {}</p>', (4, 14)),
             ('<div class="page-footer legal">', '</div>', '<p>{}</p>', (6, 30))],
    "side": [('<aside>', '</aside>', '<p>{}</p>', (8, 40)),
             ('<div class="sidebar">', '</div>', '<p>{}</p>', (8, 40)),
             ('<div class="related-posts">', '</div>', '<li><a href="#">{}</a></li>', (4, 10))],
    "advert": [('<div class="ad">', '</div>', '{}', (4, 20)),
               ('<div class="advertisement">', '</div>', '<p>{}</p>', (6, 40)),
               ('<section class="sponsored promo">', '</section>', '<p>{}</p>', (6, 40))],
    "notice": [('<div class="cookie-notice" role="alert">', '</div>', '<p>{}</p>', (8, 30)),
               ('<div class="notice">', '</div>', '{}', (6, 30)),
               ('<div id="consent-banner">', '</div>', '<p>{}</p>', (8, 30))],
    "form": [('<form action="#">', '</form>', '<label>{}</label><input>', (1, 5)),
             ('<div class="newsletter"><form>', '</form></div>', '<p>{}</p>', (6, 20)),
             ('<div class="search-form">', '</div>', '<button>{}</button>', (1, 3))],
    "share": [('<div class="share-buttons">', '</div>', '<a href="#">{}</a> ', (1, 2)),
              ('<ul class="social">', '</ul>', '<li><a href="#">{}</a></li>', (1, 2))],
    "comment": [('<section class="comments">', '</section>', '<div class="comment"><p>{}</p></div>', (5, 60)),
                ('<div id="comments">', '</div>', '<p>{}</p>', (5, 60)),
                ('<ol class="comment-list">', '</ol>', '<li>{}</li>', (5, 60)),
                ('<div class="reader-responses">', '</div>', '<p>{}</p>', (5, 60))],
}
_BODIES = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"),
           ('<div role="main">', "</div>"), ("<div>", "</div>"), ('<section id="story">', "</section>"),
           ('<main><article class="post">', "</article></main>")]
_PARTS = ["<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<div>{}</div>", "<blockquote>{}</blockquote>",
          "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<pre>{}</pre>"]
_MARK = "\ue000"  # stands before the text of main blocks while a page is built


def variant(paragraphs: list[str], other: list[str], pick: random.Random) -> list[tuple[Block, bool]]:
    """A page in a random layout around `paragraphs`, with blocks of `other` texts around it."""

    def around(kind: str) -> str:
        opening, closing, item, (least, most) = pick.choice(_AROUND[kind])
        items = []
        for _ in range(pick.randint(1, 5)):
            words = pick.choice(other).split()
            n = pick.randint(least, most)
            at = pick.randint(0, max(0, len(words) - n))
            items.append(item.format(entities.escape(" ".join(words[at:at + n]) or "-")))
        return opening + "".join(items) + closing

    def some(kinds: list[str], share: float) -> str:
        return "".join(around(k) for k in kinds if pick.random() < share)

    opening, closing = pick.choice(_BODIES)
    inside = []
    if pick.random() < 0.8:
        inside.append(f"<h1>{_MARK}{entities.escape(' '.join(paragraphs[0].split()[:10]))}</h1>")
    for text in paragraphs:
        shape = pick.choice(_PARTS) if pick.random() < 0.4 else "<p>{}</p>"
        inside.append(shape.format(_MARK + entities.escape(text)))
        inside.append(some(["advert", "share", "notice", "side", "form"], 0.06))
    tail = some(["comment"], 0.5) + some(["share", "side", "form"], 0.15)
    within = pick.random() < 0.5
    page = ("<html><body>" + some(["notice", "head", "menu", "advert", "form"], 0.6) + opening
            + "".join(inside) + (tail if within else "") + closing + ("" if within else tail)
            + some(["side", "advert", "notice", "foot"], 0.6) + "</body></html>")
    return [(Block(b.text.replace(_MARK, ""), b.tags, b.parent, b.names, b.linked, b.main, b.apart), _MARK in b.text)
            for b in blocks(page)]


def labelled(pages: list[str], seed: int = 11) -> list[list[tuple[Block, bool]]]:
    """Labelled pages: those that name their article, and variants of each."""
    pick = random.Random(seed)
    read_pages = [blocks(p) for p in pages]
    away = {"comment", "advert", "notice", "form", "share", "menu", "hidden"}
    own = [[(b, b.main and not b.apart and not (b.names & away)) for b in page] for page in read_pages
           if any(b.main and not b.apart for b in page)]
    articles = [[b.text for b, y in page if y] for page in own]
    articles = [a for a in articles if a] or [
        [" ".join(pick.choice(["one", "two", "three", "four", "five"]) for _ in range(pick.randint(5, 60))) + "."
         for _ in range(4)] for _ in range(20)]
    texts = [t for a in articles for t in a]
    return own + [variant(a[:12], texts, pick) for a in articles for _ in range(VARIANTS)]


def sample(pages: DataFrame, html_col: str, max_pages: int) -> list[str]:
    """Html of about `max_pages` pages, by a digest of the html."""
    usable = pages.where(F.length(html_col).between(1, MAX_HTML)).select(
        F.col(html_col).alias("html"), F.xxhash64(html_col).alias("digest"))
    n = usable.count()
    if n > max_pages:
        usable = usable.where(F.col("digest") < int(-2 ** 63 + 2 ** 64 * (max_pages / n)))
    return sorted(r["html"] for r in usable.select("html").distinct().collect())


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    return "\n\n".join(b.text for b, keep in zip(found, chain.decode(found)) if keep)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"),
            max_pages: int = MAX_PAGES) -> DataFrame:
    """The columns `keep` and `text`, the main text of every page."""
    chain = train(labelled(sample(pages, html_col, max_pages)))
    schema = T.StructType([*(pages.schema[c] for c in keep), T.StructField("text", T.StringType())])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), chain) for p in pc.fill_null(batch.column(n), "")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n)), pa.array(texts, pa.string())], schema.names)

    return pages.select(*keep, F.col(html_col).alias("_html")).mapInArrow(run, schema)


@query("op9_html_text")
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
