"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A leaf block is the text between two borders of block elements. Emissions see its ancestors' tags, the
words in their class, id and role attributes, and its text; transitions see adjacent labels. The field
is trained on labelled pages (made by rule from page layouts, see labelled_pages) and decoded by Viterbi.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of
from .quality import ascend, chains, forward_backward

#: Elements that don't end a block, and elements without content.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that end an open element of the same kind that stands for itself.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements inside which an open paragraph can't be.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())
#: Elements whose text is left out: the first ones run to the end of a page without an end tag, the others don't.
RAW, HIDDEN = frozenset("script style textarea".split()), frozenset("template svg noscript iframe select".split())
#: Containers that an implied end of a list item or cell, or of a paragraph, doesn't reach beyond.
HOLDS_ITEM, HOLDS_TEXT = tuple("ul ol dl table div section article".split()), tuple("div section article li td blockquote".split())
NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: What matters within a tag: its end, and an attribute's value that a quote opens.
WITHIN_TAG = re.compile(r""">|=[\x20\t\r\n\f]{0,8}(["'])""")
HINT = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
#: Tags and attribute words that emissions know.
TAGS = "article main section aside nav header footer form head title body div p li ul ol dl table td th figure figcaption blockquote pre h1 h2 h3 h4 h5 h6 button label legend fieldset address details dialog".split()
WORDS = {
    "advert": "ad ads adv advert advertisement sponsor sponsored promo promotion",
    "notice": "cookie cookies consent gdpr banner notice alert popup modal overlay privacy",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager skip",
    "side": "sidebar aside widget related recommended trending popular tags",
    "ends": "footer copyright legal colophon header masthead logo",
    "social": "share social follow newsletter subscribe signup login search",
    "talk": "comment comments reply replies discussion disqus respond",
    "body": "content article post entry story text body main page",
}
KNOWN = frozenset(TAGS)
OF_WORD = {w: k for k, ws in WORDS.items() for w in ws.split()}
NAMES = [*(f"<{t}>" for t in TAGS), *WORDS, "words", "long", "short", "links", "stop", "signs", "digits", "mark", "first", "last", "bias"]
PLACE = {n: i for i, n in enumerate(NAMES)}


@dataclass
class Block:
    """A leaf block: its text, which of TAGS and of the kinds of WORDS its ancestors have, and the share of its text in links."""

    text: str
    tags: frozenset[str]
    hints: frozenset[str]
    links: float


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes) of a page in order; kind: text (its text as name), start, end, or gap (left out like a space).

    One pass: the search for a tag's end never starts twice over the same characters. An attribute's
    value may hold > within quotes. If quotes leave a tag without an end, they don't count
    for the rest of the page; what follows the last > of a page is text.
    """
    at, n, last = 0, len(html), html.rfind(">")
    quotes = {q: html.rfind(q) for q in "\"'"}
    missing: set[str] = set()  # elements without any further end tag

    def tag_end(at: int) -> int:
        """The place of the > that ends a tag, -1 if none does."""
        nonlocal quotes
        start = at
        while quotes and (m := WITHIN_TAG.search(html, at)):
            if not m[1]:
                return m.start()
            if quotes[m[1]] < m.end():
                break
            at = html.index(m[1], m.end()) + 1
        if quotes:
            quotes = {}
        return html.find(">", start)

    while at < n:
        sign = html.find("<", at)
        if sign < 0 or sign + 1 >= n:
            break
        follows = html[sign + 1]
        if follows in "!?":
            if sign > at:
                yield "text", html[at:sign], ""
            comment = html.startswith("<!--", sign)
            end = html.find("-->", sign + 4) if comment else html.find(">", sign)
            at = n if end < 0 else end + (3 if comment else 1)
            continue
        named = NAME.match(html, sign + 1 + (follows == "/"))
        if not named or sign > last:
            # A sign that opens no tag is text.
            yield "text", html[at : sign + 1], ""
            at = sign + 1
            continue
        name = named[0].lower()
        end = tag_end(named.end())
        if end < 0:
            yield "text", html[at : named.end()], ""
            at = named.end()
            continue
        if sign > at:
            yield "text", html[at:sign], ""
        at = end + 1
        if follows == "/":
            yield "end", name, ""
            continue
        if name in RAW or (name in HIDDEN and name not in missing):
            if name == "svg" and html[end - 1] == "/":
                yield "gap", name, ""
                continue
            if closing := _end_tag(name).search(html, at):
                at = closing.end()
                yield "gap", name, ""
                continue
            if name in RAW:
                yield "gap", name, ""
                return
            missing.add(name)
        yield "start", name, html[named.end() : end]
    if at < n:
        yield "text", html[at:], ""


@cache
def _end_tag(name: str) -> re.Pattern[str]:
    return re.compile(rf"</{name}\s*>", re.IGNORECASE)


class Open:
    """The open elements of a page, with the places of each name, so that closing one takes no search."""

    def __init__(self) -> None:
        self._names: list[str] = []
        self._hints: list[frozenset[str]] = []
        self._places: dict[str, list[int]] = {}
        self._known: Counter[str] = Counter()
        self._kinds: Counter[str] = Counter()

    def push(self, name: str, hints: frozenset[str]) -> None:
        self._places.setdefault(name, []).append(len(self._names))
        self._names.append(name)
        self._hints.append(hints)
        if name in KNOWN:
            self._known[name] += 1
        self._kinds.update(hints)

    def close(self, names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
        """Closes the innermost element of names and all in it, unless one of within is further in."""
        place = lambda many: max((self._places[x][-1] for x in many if self._places.get(x)), default=-1)
        if (at := place(names)) < 0 or place(within) > at:
            return
        while len(self._names) > at:
            name, hints = self._names.pop(), self._hints.pop()
            self._places[name].pop()
            if name in KNOWN:
                self._known[name] -= 1
            self._kinds.subtract(hints)

    def tags(self) -> frozenset[str]:
        return frozenset(k for k, n in self._known.items() if n)

    def hints(self) -> frozenset[str]:
        return frozenset(k for k, n in self._kinds.items() if n)


def blocks(html: str) -> list[Block]:
    """The leaf blocks with text, in page order. Scripts, styles and the like have none; markup may be broken."""
    out: list[Block] = []
    stack = Open()
    held: list[tuple[str, bool]] = []
    anchors = False

    def flush() -> None:
        nonlocal held
        text = " ".join(unescape("".join(t for t, _ in held)).split())
        if text:
            linked = " ".join(unescape("".join(t for t, a in held if a)).split())
            out.append(Block(text, stack.tags(), stack.hints(), len(linked) / len(text)))
        held = []

    for kind, name, attributes in tokens(html):
        if kind == "text":
            held.append((name, anchors))
        elif kind == "gap":
            held.append((" ", False))
        elif name in INLINE:
            if name == "a":
                anchors = kind == "start"
            elif name == "br":
                held.append((" ", False))
        else:
            flush()
            anchors = False
            if kind == "end":
                stack.close((name,))
                continue
            if name in CLOSES:
                stack.close(CLOSES[name], HOLDS_ITEM)
            elif name in BLOCKS:
                stack.close(("p",), HOLDS_TEXT)
            if name not in VOID:
                words = " ".join(a or b or c for a, b, c in HINT.findall(attributes)) if "=" in attributes else ""
                found = frozenset(OF_WORD[w] for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", words).lower()) if w in OF_WORD)
                stack.push(name, found)
    flush()
    return out


def features(page: list[Block]) -> np.ndarray:
    x = np.zeros((len(page), len(NAMES)))
    for i, b in enumerate(page):
        row = x[i]
        for t in b.tags:
            row[PLACE[f"<{t}>"]] = 1
        for h in b.hints:
            row[PLACE[h]] = 1
        n, words = len(b.text), b.text.count(" ") + 1
        signs = sum(map(b.text.count, ".,;:!?"))
        row[PLACE["words"]] = np.log1p(words) / 3
        row[PLACE["long"]], row[PLACE["short"]] = words > 12, words < 4
        row[PLACE["links"]], row[PLACE["stop"]] = b.links, b.text[-1] in ".!?…”\""
        row[PLACE["signs"]] = min(1.0, signs / words)
        row[PLACE["digits"]] = sum(map(b.text.count, "0123456789")) / n
        row[PLACE["mark"]] = "©" in b.text or "|" in b.text or "»" in b.text
        row[PLACE["first"]], row[PLACE["last"]], row[PLACE["bias"]] = i == 0, i == len(page) - 1, 1
    return x


def labelled_pages(n: int = 400, seed: int = 7) -> list[tuple[str, list[tuple[str, int]]]]:
    """Pages with their blocks' labels (1: main text), made from layouts as sites have them.

    The main text stands in an article, main, section or div with or without telling names, or in the
    body itself; around and within it are menus, headers, notices, adverts, side bars, forms, comments and
    footers of many forms. Words are invented, so only layout and the shape of texts can be learned.
    """
    R = random.Random(seed)
    letters = "abcdefghilmnoprstuvy"

    def words(low: int, high: int) -> str:
        return " ".join("".join(R.choice(letters) for _ in range(R.randint(2, 9))) for _ in range(R.randint(low, high)))

    def sentence(low: int = 4, high: int = 18) -> str:
        return words(low, high).capitalize() + R.choice(".....!?")

    out = []
    for _ in range(n):
        html: list[str] = []
        gold: list[tuple[str, int]] = []

        def put(text: str, label: int, before: str = "", after: str = "", html=html, gold=gold) -> None:
            gold.append((text, label))
            html.append(f"{before}{escape(text, quote=False)}{after}")

        def raw(text: str, html=html) -> None:
            html.append(text)

        def menu(label: str, put=put, raw=raw) -> None:
            raw(R.choice([f"<nav{label}><ul>", f"<div class='{R.choice(['menu', 'navbar', 'nav-links', 'breadcrumbs'])}'><ul>", "<nav><ul>"]))
            kind = html[-1]
            for _ in range(R.randint(2, 9)):
                put(words(1, 3) + R.choice(["", "", ".", ","]), 0, '<li><a href="/x">', "</a></li>")
            raw("</ul></nav>" if kind.startswith("<nav") else "</ul></div>")

        def advert(put=put) -> None:
            name = R.choice(["ad", "ads", "advert", "sponsored", "promo-box", "ad-slot"])
            tag = R.choice(["div", "aside", "section", "p"])
            put(sentence(2, 16), 0, f"<{tag} class=\"{name}\">", f"</{tag}>")

        def notice(put=put) -> None:
            name = R.choice(["cookie-banner", "consent", "notice", "alert", "gdpr-popup"])
            put(sentence(5, 20), 0, f"<div id=\"{name}\" role=\"{R.choice(['dialog', 'alert', 'banner'])}\"><p>", "</p></div>")

        def side(put=put, raw=raw) -> None:
            start, end = R.choice([("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<section class="related widget">', "</section>")])
            raw(start)
            put(words(1, 4), 0, "<h3>", "</h3>")
            for _ in range(R.randint(1, 4)):
                put(*((sentence(3, 14), 0, "<p>", "</p>") if R.random() < 0.5 else (words(2, 7), 0, "<p><a href='#'>", "</a></p>")))
            raw(end)

        def form(put=put, raw=raw) -> None:
            raw(f"<form class='{R.choice(['signup', 'search', 'f1'])}'>")
            put(sentence(2, 8), 0, R.choice(["<label>", "<p>", "<legend>"]), "</label>")
            put(words(1, 2), 0, "<button>", "</button>")
            raw("</form>")

        def comments(put=put, raw=raw) -> None:
            tag = R.choice(["div", "section", "aside"])
            raw(f"<{tag} {R.choice(['class', 'id'])}=\"{R.choice(['comments', 'comment-list', 'replies', 'discussion', 'disqus-thread'])}\">")
            if R.random() < 0.6:
                put(words(1, 3), 0, "<h2>", "</h2>")
            for _ in range(R.randint(1, 4)):
                put(sentence(4, 25), 0, R.choice(["<p>", "<div class='comment'>"]), "")
                raw("</p>" if html[-1].startswith("<p>") else "</div>")
            raw(f"</{tag}>")

        def paragraph(put=put) -> None:
            text = " ".join(sentence() for _ in range(R.choice([1, 1, 1, 2, 3, 6, 12])))
            if R.random() < 0.1:
                text = words(1, 30)
            if R.random() < 0.1:
                text = " ".join(w + R.choice(["%%%", "***", "&", "|", "$$"]) for w in text.split())
            put(text, 1, "<p><b>" if R.random() < 0.15 else "<p>", R.choice(["</p>", "</p>", "</p>", "<br>"]))

        if R.random() < 0.8:
            put(title := words(2, 12), 0, "<html><head><title>", "</title><style>p{}</style><script>var t='</p>';</script></head><body>")
        else:
            title = words(2, 12)
            raw("<body>")
        for part in (lambda: raw("<header>"), lambda: put(words(1, 4), 0, "<div class='logo'>", "</div>"), lambda: raw("</header>")) if R.random() < 0.4 else ():
            part()
        order = [menu, notice, advert, side]
        R.shuffle(order)
        for part in order:
            if R.random() < 0.55:
                part("") if part is menu else part()
        start, end = R.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="post-body">', "</div>"), ("<div>", "</div>"), ("<section>", "</section>"), ("", "")])
        raw(start)
        if R.random() < 0.85:
            put(title if R.random() < 0.7 else words(2, 12), 1, "<h1>", "</h1>")
        for _ in range(R.choice([1, 2, 3, 4, 6, 9, 15])):
            kind = R.random()
            if kind < 0.72:
                paragraph()
            elif kind < 0.8:
                put(words(1, 7), 1, f"<h{(k := R.randint(2, 4))}>", f"</h{k}>")
            elif kind < 0.86:
                raw("<ul>")
                for _ in range(R.randint(1, 5)):
                    put(sentence(2, 12) if R.random() < 0.6 else words(1, 8), 1, "<li>", "</li>")
                raw("</ul>")
            elif kind < 0.89:
                put(sentence(5, 25), 1, "<blockquote>", "</blockquote>")
            elif kind < 0.91:
                put(words(3, 20), 1, "<pre>", "</pre>")
            elif kind < 0.93:
                raw("<table><tr>")
                for _ in range(R.randint(2, 4)):
                    put(words(1, 3), 1, "<td>", "</td>")
                raw("</tr></table>")
            elif kind < 0.95:
                advert()
            elif kind < 0.97:
                side()
            else:
                form()
        if R.random() < 0.12:
            comments()
        raw(end)
        for part, share in ((comments, 0.25), (side, 0.25), (form, 0.15), (advert, 0.2)):
            if R.random() < share:
                part()
        if R.random() < 0.8:
            text = R.choice([f"© {words(1, 3)} · {sentence(2, 14)}", f"© 2024 {words(1, 3)}", sentence(3, 12), words(2, 6)])
            put(text, 0, *R.choice([("<footer>", "</footer>"), ("<footer><p>", "</p></footer>"), ("<div class='footer'>", "</div>"), ("<div id='copyright'>", "</div>")]))
        out.append(("".join(html) + R.choice(["</body></html>", ""]), gold))
    # The plainest pages: bare paragraphs or text without any mark-up.
    for _ in range(n // 20):
        own = [" ".join(sentence() for _ in range(R.randint(1, 6))) for _ in range(R.randint(1, 4))]
        out.append(("".join(f"<p>{escape(t)}</p>" for t in own), [(t, 1) for t in own]))
        out.append((escape(own[0]), [(own[0], 1)]))
    return out


def train(pages: list[tuple[str, list[tuple[str, int]]]] | None = None, steps: int = 120, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights, by exact gradient ascent of the labels' log likelihood."""
    pages = labelled_pages() if pages is None else pages
    parsed = [(blocks(html), gold) for html, gold in pages]
    x = np.concatenate([features(b) for b, _ in parsed])
    y = np.concatenate([[label for _, label in gold] for _, gold in parsed]).astype(int)
    owner = np.repeat(np.arange(len(parsed)), [len(b) for b, _ in parsed])
    inside, gold2, index = owner[1:] == owner[:-1], np.zeros((2, 2)), chains(owner)
    np.add.at(gold2, (y[:-1][inside], y[1:][inside]), 1)
    width = x.shape[1]

    def gradient(p: np.ndarray) -> np.ndarray:
        emit, good, pair = x @ p[:width], np.zeros(len(x)), np.zeros((2, 2))
        for block in index:
            g, joint, _ = forward_backward(emit, p[width:].reshape(2, 2), block)
            good[block[block >= 0]] = g[block >= 0]
            pair += joint
        return np.r_[x.T @ (y - good), (gold2 - pair).ravel()] / len(x) - ridge * p

    p = ascend(gradient, width + 4, steps, 0.15)
    return p[:width], p[width:].reshape(2, 2)


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """The likeliest labels of a chain of emission scores of label 1 (label 0 has 0)."""
    t00, t01, t10, t11 = trans.ravel().tolist()
    bad, good, back = 0.0, 0.0, []
    for i, e in enumerate(emit.tolist()):
        if not i:
            good = e
            continue
        from_bad = (bad + t00 >= good + t10, bad + t01 >= good + t11)
        back.append(from_bad)
        bad, good = max(bad + t00, good + t10), max(bad + t01, good + t11) + e
    label = int(good > bad)
    out = [label]
    for choice in reversed(back):
        label = 0 if choice[label] else 1
        out.append(label)
    return np.array(out[::-1][: len(emit)], int)


def main_text(html: str, weights: np.ndarray, trans: np.ndarray) -> str:
    """The page's main blocks, joined by an empty line; empty if there is none."""
    page = blocks(html)
    if not page:
        return ""
    labels = viterbi(features(page) @ weights, trans)
    return "\n\n".join(b.text for b, label in zip(page, labels, strict=True) if label)


@cache
def model() -> tuple[np.ndarray, np.ndarray]:
    return train()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page from its whole html.

    A null html counts as empty and has an empty text; equal rows give equal rows; an empty table
    gives none; columns of pages by the names of results are not read.
    """
    weights, trans = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights, trans) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_of("html").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
