"""Main text of web pages: a recurrent labeller of blocks.

A page is cut into leaf blocks, runs of text between block-level tags, each with its path of tags, classes and ids. A
bidirectional LSTM in numpy reads the blocks of a page in order, each as hashed path, hashed words and a few shares, so
that every block is judged with the whole page in view; blocks judged to be main text are joined by an empty line.

The labeller is trained here, on pages made by a stated generator with known labels: articles in the usual layouts among
menus, headers, footers, sidebars, notices, adverts, forms and reader comments, some with unclosed or missing tags. It is
trained once a process and broadcast; pages of a batch go through the network in step.

Markup is read as browsers do where it matters: scripts, styles, inert templates, titles in the head, the contents of text
fields and of embedded frames are not shown and hold no text; all other text, formulas and drawings included, is judged by
the network. Void tags have no content; an open paragraph or item ends where the next begins; closing tags without an open
one are ignored; what is open at the end ends there. A block's path is its whole path: each open tag keeps the union of its
own slots and its parent's, so a block costs the same at any depth. Each part of a page is looked at a bounded number of
times, whatever is left unclosed.

Defined results: a null, empty or textless page has the empty text and 0 characters; white space of any kind inside a
block becomes one space; repeated rows are read each; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftframe.durable import ship
from driftframe.llm.blocks import blocks, runs_of, strings

#: HTML's elements by how they are read.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT_TAGS = frozenset("script style template textarea iframe title".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
P_STAYS = frozenset("button label option optgroup select legend summary".split())

PATH, WORDS, SHARES, HIDDEN = 192, 24, 5, 16
PAGES, PAGE_BYTES = 500, 2_000_000  # that go through the network in step
_OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")


@dataclass
class Blocks:
    text: list[str] = field(default_factory=list)
    path: list[int] = field(default_factory=list)  # hashed slots as bits
    linked: list[float] = field(default_factory=list)


def _bit(said: str) -> int:
    return 1 << zlib.crc32(said.encode()) % PATH


@lru_cache(maxsize=100_000)
def _slots(above: str, tag: str, said: str) -> int:
    """What an open tag adds to its path: its name, its classes and ids, and the pair with the tag above."""
    out = _bit(tag) | (_bit(f"{above}>{tag}") if above else 0)
    for part in _PART.findall(said.lower()):
        out |= _bit(part)
    return out


class _Open:
    """The open tags, innermost last, with where each name stands among them and which are block-level."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.slots: list[int] = []
        self.at: dict[str, list[int]] = {}
        self.block_at: list[int] = []

    def push(self, tag: str, said: str) -> None:
        above, slots = (self.tags[-1], self.slots[-1]) if self.tags else ("", 0)
        if tag in BLOCK_TAGS:
            self.block_at.append(len(self.tags))
        self.at.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.slots.append(slots | _slots(above, tag, said))

    def pop_to(self, k: int) -> None:
        while len(self.tags) > k:
            self.slots.pop()
            self.at[self.tags.pop()].pop()
        while self.block_at and self.block_at[-1] >= k:
            self.block_at.pop()

    def last(self, tag: str) -> int:
        """Where the innermost open ``tag`` is, or -1."""
        return self.at[tag][-1] if self.at.get(tag) else -1

    @property
    def path(self) -> int:
        return self.slots[-1] | _bit(f"^{self.tags[-1]}") if self.tags else 0


def _end_of_tag(page: str, at: int, no_quote: dict[str, int]) -> int:
    """Where the tag whose name ends at ``at`` is closed (-1: nowhere). A > between quotes does not close it. ``no_quote``:
    places from which on a quote is known not to end."""
    end = page.find(">", at)
    for quote in ('"', "'") if end >= 0 else ():
        odd = page.count(quote, at, end) % 2
        while odd and end < no_quote[quote]:
            close = page.find(quote, end)
            beyond = page.find(">", close) if close >= 0 else -1
            if beyond < 0:
                no_quote[quote] = min(no_quote[quote], end)
                break
            odd = (odd + page.count(quote, end, beyond)) % 2
            end = beyond
    return end


def parse(page: str) -> Blocks:
    """The page's leaf blocks in order."""
    out, open_ = Blocks(), _Open()
    text: list[str] = []
    links = at = 0
    no_quote = {'"': len(page) + 1, "'": len(page) + 1}

    def flush() -> None:
        nonlocal links
        if text:
            said = " ".join(entities.unescape("".join(text)).split())
            if said:
                out.text.append(said)
                out.path.append(open_.path)
                out.linked.append(min(1.0, links / len(said)))
            text.clear()
        links = 0

    while at < len(page):
        m = _OPEN.search(page, at)
        said = page[at : m.start() if m else len(page)]
        if said:
            text.append(said)
            links += len(said) if open_.at.get("a") else 0
        if not m:
            break
        if m[1]:
            end = page.find("-->", m.end())
            at = len(page) if end < 0 else end + 3
            continue
        end = _end_of_tag(page, m.end(), no_quote)
        if end < 0:
            break
        at = end + 1
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            k = open_.last(tag)
            if tag in BLOCK_TAGS or (k >= 0 and open_.block_at and open_.block_at[-1] > k):
                flush()
            if k >= 0:
                open_.pop_to(k)
            continue
        if tag in SILENT_TAGS and page[end - 1] != "/":
            if tag in BLOCK_TAGS:
                flush()
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else len(page)
            continue
        if tag in BLOCK_TAGS:
            flush()
            ends = CLOSES.get(tag, frozenset()) | (frozenset() if tag in P_STAYS else {"p"})
            while open_.block_at and open_.tags[open_.block_at[-1]] in ends:
                open_.pop_to(open_.block_at[-1])
        elif tag == "br":
            text.append(" ")
        if tag not in VOID_TAGS and page[end - 1] != "/":
            attributes = page[m.end() : end]
            open_.push(tag, " ".join(x for g in _NAMES.findall(attributes) for x in g) if "=" in attributes else "")
    flush()
    return out


def features(pages: list[Blocks]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all blocks, and where each page's begin."""
    first = np.concatenate([[0], np.cumsum([len(p.text) for p in pages], dtype=np.int64)])
    x = np.zeros((int(first[-1]), PATH + WORDS + SHARES), np.float32)
    paths = b"".join(p.to_bytes(PATH // 8, "little") for page in pages for p in page.path)
    x[:, :PATH] = np.unpackbits(np.frombuffer(paths, np.uint8).reshape(-1, PATH // 8), axis=1, bitorder="little")
    texts = [t for page in pages for t in page.text]
    for b in blocks(pa.array(texts, pa.string()), lower=True):
        slot = (b.word_hashes() % np.uint64(WORDS)).astype(np.int64)
        n = len(b.first) - 1
        bag = np.bincount(b.doc * WORDS + slot, minlength=n * WORDS).reshape(n, WORDS)
        x[b.rows, PATH : PATH + WORDS] = np.sqrt(bag) / np.maximum(np.sqrt(b.n_words), 1)[:, None]
        x[b.rows, -5] = np.log1p(b.n_words) / 5
    x[:, -4] = [v for page in pages for v in page.linked]
    x[:, -3] = [t[-1:] in ".!?\"'»”" for t in texts]
    x[:, -2] = [len(t) < 25 for t in texts]
    x[:, -1] = 1
    return x, first


@dataclass
class Network:
    """Per direction: input weights (features x 4 hidden), recurrent weights (hidden x 4 hidden). Gates in order: input,
    forget, output, candidate. ``out`` reads both directions' states."""

    into: list[np.ndarray]
    over: list[np.ndarray]
    out: np.ndarray

    @classmethod
    def start(cls, seed: int) -> Network:
        rng = np.random.Generator(np.random.PCG64(seed))
        draw = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
        return cls([draw(PATH + WORDS + SHARES, 4 * HIDDEN) for _ in range(2)], [draw(HIDDEN, 4 * HIDDEN) for _ in range(2)], draw(2 * HIDDEN + 1, 1))


def _steps(first: np.ndarray, backward: bool) -> tuple[list[np.ndarray], np.ndarray]:
    """For each step, the rows that are read, of the pages still running (longest first)."""
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    running = len(size) - np.searchsorted(np.sort(size), np.arange(int(size.max(initial=0))), side="right")
    begin = first[1:][order] - 1 if backward else first[:-1][order]
    return [begin[:n] + (-t if backward else t) for t, n in enumerate(running)], order


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _pass(net: Network, x: np.ndarray, first: np.ndarray, way: int, traced: bool = False) -> tuple[np.ndarray, list]:
    state, trace = np.zeros((len(x), HIDDEN), np.float32), []
    into = x @ net.into[way]
    h = c = np.zeros((len(first) - 1, HIDDEN), np.float32)
    for rows in _steps(first, way == 1)[0]:
        n = len(rows)
        gates = into[rows] + h[:n] @ net.over[way]
        i, f, o = _sigmoid(gates[:, :HIDDEN]), _sigmoid(gates[:, HIDDEN : 2 * HIDDEN] + 1), _sigmoid(gates[:, 2 * HIDDEN : 3 * HIDDEN])
        g, c0, h0 = np.tanh(gates[:, 3 * HIDDEN :]), c[:n], h[:n]
        c = f * c0 + i * g
        h = o * np.tanh(c)
        state[rows] = h
        if traced:
            trace.append((rows, i, f, o, g, c0, c, h0))
    return state, trace


def judge(net: Network, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The probability of each block that it is main text."""
    both = np.concatenate([_pass(net, x, first, 0)[0], _pass(net, x, first, 1)[0], np.ones((len(x), 1), np.float32)], 1)
    return _sigmoid(both @ net.out)[:, 0]


def _slopes(net: Network, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log-loss by backpropagation through time."""
    runs = [_pass(net, x, first, way, True) for way in range(2)]
    both = np.concatenate([runs[0][0], runs[1][0], np.ones((len(x), 1), np.float32)], 1)
    off = ((_sigmoid(both @ net.out)[:, 0] - y) / len(y)).astype(np.float32)[:, None]
    by_state, out = off @ net.out.T, []
    for way in range(2):
        gates = np.zeros((len(x), 4 * HIDDEN), np.float32)
        over = np.zeros_like(net.over[way])
        dh = dc = np.zeros((len(first) - 1, HIDDEN), np.float32)
        for rows, i, f, o, g, c0, c, h0 in reversed(runs[way][1]):
            n, tc = len(rows), np.tanh(c)
            full_h, full_c = dh.copy(), dc.copy()
            h_now = dh[:n] + by_state[rows, way * HIDDEN : (way + 1) * HIDDEN]
            c_now = dc[:n] + h_now * o * (1 - tc * tc)
            d = np.concatenate([c_now * g * i * (1 - i), c_now * c0 * f * (1 - f), h_now * tc * o * (1 - o), c_now * i * (1 - g * g)], 1)
            gates[rows] = d
            over += h0.T @ d
            full_h[:n], full_c[:n] = d @ net.over[way].T, c_now * f
            dh, dc = full_h, full_c
        out.append((x.T @ gates, over))
    return [out[0][0], out[1][0], out[0][1], out[1][1], both.T @ off]


def train(pages: list[tuple[str, set[str]]], epochs: int = 24, batch: int = 50, seed: int = 9) -> Network:
    """``(html, texts of its main blocks)`` to a network."""
    parsed = [parse(p) for p, _ in pages]
    truth = [np.array([t in kept for t in p.text], np.float32) for p, (_, kept) in zip(parsed, pages)]
    net, rng = Network.start(seed), random.Random(seed)
    weights = [*net.into, *net.over, net.out]
    memory = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    groups, step = [], 0
    for k in range(0, len(parsed), batch):
        groups.append((*features(parsed[k : k + batch]), np.concatenate([np.zeros(0, np.float32), *truth[k : k + batch]])))
    for _ in range(epochs):
        rng.shuffle(groups)
        for x, first, y in groups:
            step += 1
            for w, (m, v), g in zip(weights, memory, _slopes(net, x, first, y)):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def labelled_pages(n: int = 500, seed: int = 13) -> list[tuple[str, set[str]]]:
    """Pages in the usual layouts, with the texts of their main blocks."""
    rng = random.Random(seed)
    some = rng.choice
    word = lambda: "".join(some("bcdfglmnprstv") + some(("a", "e", "i", "o", "u", "é", "ü", "ó")) for _ in range(rng.randint(1, 4)))
    used = [0]

    def said(low: int, high: int, stop: bool = True) -> str:
        used[0] += 1
        words = [word() for _ in range(rng.randint(low, high))] + [f"{word()}{used[0]}"]
        return " ".join(words).capitalize() + (some((".", ".", ".", "!", "?", "&amp;", " $$$", "")) if stop else "")

    tag = lambda name, inner, names="": f"<{name}{f' class={chr(34)}{names}{chr(34)}' if names and rng.random() < 0.9 else f' id={chr(34)}{names}{chr(34)}' if names else ''}>{inner}</{name}>"
    items = lambda: "".join(tag("li", f'<a href="/{word()}">{said(0, 2, False)}</a>') for _ in range(rng.randint(2, 8)))
    menu = lambda: some((tag("nav", tag("ul", items())), tag("nav", nested(tag("ul", items()), rng.randint(1, 24))), tag("div", tag("ul", items()), some(("menu", "nav", "navbar", "navigation", "breadcrumbs", "main-menu"))), tag("ul", items(), some(("menu", "nav")))))
    head = lambda: some((tag("header", tag(some(("h1", "div", "p")), said(1, 3, False)) + menu()), tag("div", tag("p", said(1, 6)), some(("header", "masthead", "topbar", "site-header"))), ""))
    advert = lambda: f"<!-- ad {used[0]} -->" + tag(some(("div", "div", "aside", "section")), some((said(2, 25), tag("p", said(2, 25)))), some(("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-box", "banner")))
    notice = lambda: tag("div", tag("p", said(4, 20)) + tag("button", said(0, 1, False)), some(("cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "subscribe", "newsletter", "popup")))
    side = lambda: some((tag("aside", tag("h3", said(0, 2, False)) + tag("ul", items())), tag("div", tag("h4", said(0, 2, False)) + tag("p", said(4, 30)), some(("sidebar", "widget", "related", "recommended", "side"))), tag("aside", tag("p", said(4, 30)))))
    form = lambda: tag("form", tag("label", said(0, 3, False)) + '<input type="text">' + tag("button", said(0, 1, False)), some(("", "search", "login", "contact")))
    remark = lambda: tag("div", tag(some(("h4", "span", "div")), said(0, 1, False)) + tag("p", said(3, 40)), some(("comment", "reply")))
    remarks = lambda: tag(some(("section", "div", "div")), tag("h3", said(0, 2, False)) + "".join(remark() for _ in range(rng.randint(1, 5))) + some(("", form())), some(("comments", "comment-list", "discussion", "responses", "user-comments")))
    foot = lambda: some((tag("footer", f"&copy; {said(1, 12)}"), tag("footer", tag("p", said(2, 12)) + tag("ul", items())), tag("div", said(2, 12), some(("footer", "site-footer", "copyright", "legal")))))
    quiet = lambda: f"<noscript>{said(3, 12)}</noscript>"
    names = ("", "", "", "row", "col", "inner", "wrap", "block", "grid", "layout", "region", "holder")
    nested = lambda inner, most: inner if most == 0 else nested(tag(some(("div", "div", "section", "span")), inner, some(names)), most - 1)
    deep = lambda inner: nested(inner, rng.randint(8, 30) if rng.random() < 0.3 else rng.randint(0, 3))
    out = []
    for _ in range(n):
        kept: set[str] = set()

        def main(low: int, high: int, kept: set[str] = kept) -> str:
            text = said(low, high)
            kept.add(" ".join(entities.unescape(text).split()))
            return text

        def formula(kept: set[str] = kept) -> str:
            before, inner, after = said(1, 12, False), [word() for _ in range(rng.randint(1, 4))], said(1, 20)
            kept.add(" ".join(entities.unescape(f"{before} {' '.join(inner)} {after}").split()))
            sign = some(("math", "math", "svg", "span"))
            return f"<p>{before} <{sign}>{' '.join(f'<{t}>{x}</{t}>' for t, x in ((some(('mi', 'mo', 'mn', 'text')), x) for x in inner))}</{sign}> {after}</p>"

        title, body = main(0, 9), []
        body.append(some((f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h2>{title}</h2>", f"<header><h1>{title}</h1></header>")))
        for _ in range(rng.randint(0, 14)):
            kind = rng.random()
            body.append(
                formula() if kind < 0.04 else f"<p>{main(0, 70)}</p>" if kind < 0.55 else f"<p><b>{main(0, 50)}<br>" if kind < 0.7 else f"<p>{main(3, 60)}" if kind < 0.76 else f"<h2>{main(0, 6)}</h2>" if kind < 0.82
                else tag("ul", "".join(f"<li>{main(0, 12)}</li>" for _ in range(rng.randint(1, 4)))) if kind < 0.87 else tag("blockquote", f"<p>{main(3, 30)}</p>") if kind < 0.9
                else f"<pre>{main(2, 20)}</pre>" if kind < 0.92 else tag("figure", f"<img src='x.png'><figcaption>{main(1, 9)}</figcaption>") if kind < 0.94
                else tag("table", tag("tr", "".join(f"<td>{main(0, 4)}</td>" for _ in range(rng.randint(1, 3))))) if kind < 0.95 else advert() if kind < 0.98 else tag("script", "var t='<p>x</p>';")
            )
        inner = "".join(body)
        layout = rng.random()
        center = (
            f"<article>{inner}</article>" if layout < 0.45 else f"<main>{inner}</main>" if layout < 0.55 else f"<main><article>{inner}</article></main>" if layout < 0.65
            else tag("div", inner, some(("content", "post", "article", "entry", "entry-content", "post-body", "story", "main", "article-body", "page-content")))
        )
        before = [deep(f()) for f in rng.sample((menu, head, advert, notice, form, side, quiet), rng.randint(0, 5))]
        after = [deep(f()) for f in rng.sample((side, remarks, advert, form, notice, menu, foot, quiet), rng.randint(0, 5))] + ([foot()] if rng.random() < 0.7 else [])
        page = "".join(before) + deep(center) + "".join(after)
        if rng.random() < 0.4:
            page = tag("div", page, some(("wrapper", "container", "page", "site")))
        ended = some(("</body></html>", "</body></html>", ""))
        out.append((f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style></head><body>{page}{ended}', kept))
    return out


@lru_cache(maxsize=1)
def default_network() -> Network:
    return train(labelled_pages())


def extract_pages(pages: list[str], net: Network) -> list[str]:
    parsed = [parse(p) for p in pages]
    x, first = features(parsed)
    main = judge(net, x, first) >= 0.5 if len(x) else np.zeros(0, bool)
    return ["\n\n".join(t for t, m in zip(p.text, main[a:b]) if m) for p, a, b in zip(parsed, first[:-1], first[1:])]


def _extractor(shared) -> Callable:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, n) for i, n in runs_of(batch.column("html"), PAGES, PAGE_BYTES)):
                texts = extract_pages(strings(part.column("html")).to_pylist(), shared.value)
                yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, net: Network | None = None) -> DataFrame:
    """``pages(page_id, url, html)`` to ``(page_id, url, text, n_chars)``."""
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(net or default_network())
    kinds = [f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url")]
    return pages.select("page_id", "url", "html").mapInArrow(_extractor(shared), ", ".join([*kinds, "text string", "n_chars long"]))
