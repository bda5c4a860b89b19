"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

Pages are parsed into block-level nodes (``html.parser``). Each node has features of its tag, of the words
in its class, id and role, of its subtree (text, links and tags in it), its depth and its siblings.
Boosted trees, trained here on generated pages of many layouts, give each node's probability of holding
main text. A node can only be kept below a kept parent: the most likely consistent choice for the whole
tree is found by dynamic programming, so ancestors and descendants never contradict each other.
"""

from __future__ import annotations

import functools
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import lean

# Fixed values of HTML: elements without content, without rendered text, and of block level.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template title svg math iframe object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split()
)
#: Which open elements a start tag ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NO_CROSS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

#: Words in class, id and role attributes, by what they tell of a node.
TOKENS = {
    "advert": "ad ads adv advert advertisement advertising adsense banner promo promotion promoted sponsor sponsored outbrain taboola",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pager pagination toc tabs toolbar skip",
    "notice": "cookie cookies consent gdpr notice notices alert warning popup modal overlay paywall disclaimer subscribe newsletter signup message",
    "comment": "comment comments commentlist disqus reply replies respond discussion reviews feedback guestbook",
    "footer": "footer foot bottom copyright legal colophon imprint credits",
    "header": "header head masthead topbar top logo branding site",
    "sidebar": "sidebar side aside rail widget widgets related recommended trending popular archive tags tagcloud secondary complementary",
    "social": "share sharing social follow facebook twitter login search form contact",
    "content": "article content main post entry story text body page maincontent hentry single blog news",
}
_TOKEN_GROUP = {w: g for g, words in enumerate(TOKENS.values()) for w in words.split()}
_TAG_GROUPS = [
    {"nav", "menu"}, {"header", "hgroup"}, {"footer"}, {"aside"}, {"form", "fieldset", "label", "legend", "select", "option", "textarea", "button", "search", "dialog"},
    {"article"}, {"main"}, {"section"}, {"div"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "dl"}, {"li", "dt", "dd"},
    {"table", "tbody", "thead", "tfoot", "tr", "td", "th"}, {"blockquote", "pre", "figure", "figcaption"}, {"body"}, {"span", "a"},
]
_TAG_GROUP = {t: g for g, tags in enumerate(_TAG_GROUPS) for t in tags}
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


def attribute_words(attrs: list[tuple[str, str | None]]) -> list[str]:
    text = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role", "aria-label"))
    return [w for w in _SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text).lower()) if w] if text else []


@dataclass
class Page:
    """Nodes in page order; ``events`` are (node, text) with None for the border of a block."""

    tags: list[str] = field(default_factory=lambda: ["body"])
    parents: list[int] = field(default_factory=lambda: [-1])
    words: list[list[str]] = field(default_factory=lambda: [[]])
    events: list[tuple[int, str | None, bool]] = field(default_factory=list)


class _Builder(HTMLParser):
    """Elements whose end tag is missing end where browsers end them; a silent one without end keeps what follows it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.open: list[tuple[str, int]] = [("", 0)]  # tag, node that takes its text
        self.counts: Counter[str] = Counter()
        self.silent: str | None = None
        self.loose = False  # reading again what an unclosed silent element held
        self.held: list[tuple] = []
        self.depth = self.links = 0

    def _hush(self, tag: str) -> None:
        self.silent, self.depth, self.held = tag, 1, []

    def handle_starttag(self, tag, attrs):
        if self.silent:
            self.depth += tag == self.silent
            self.held.append((self.handle_starttag, tag, attrs))
            return
        if tag in SILENT and not (self.loose and tag not in ("script", "style")):
            self._hush(tag)
            return
        if tag == "br":
            self.page.events.append((self.open[-1][1], " ", False))
        if tag in VOID:
            if tag == "hr":
                self.page.events.append((self.open[-1][1], None, False))
            return
        if tag in BLOCK and self.counts["p"]:
            self._close("p")
        for ended in _ENDS.get(tag, ()):
            self._close(ended, _NO_CROSS.get(tag, ()))
        if tag in ("html", "head", "body"):
            if attrs and tag == "body":
                self.page.words[0] += attribute_words(attrs)
            return
        node = self.open[-1][1]
        words = attribute_words(attrs)
        if tag in BLOCK or (words and tag in ("span", "a", "ins", "center", "font")):
            self.page.tags.append(tag)
            self.page.parents.append(node)
            self.page.words.append(words)
            node = len(self.page.tags) - 1
            if tag in BLOCK:
                self.page.events.append((node, None, False))
        self.open.append((tag, node))
        self.counts[tag] += 1
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag not in ("svg", "math"):  # only foreign elements can end themselves
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.silent:
            self.held.append((self.handle_endtag, tag))
            if tag == self.silent:
                self.depth -= 1
                if not self.depth:
                    self.silent, self.held = None, []
            return
        if tag == "br":
            self.page.events.append((self.open[-1][1], " ", False))
        self._close(tag)

    def _close(self, tag: str, stops=()) -> None:
        if not self.counts[tag]:
            return
        at = len(self.open) - 1
        while self.open[at][0] != tag:
            if self.open[at][0] in stops:
                return
            at -= 1
        for name, node in reversed(self.open[at:]):
            if name in BLOCK:
                self.page.events.append((node, None, False))
            self.links -= name == "a"
            self.counts[name] -= 1
        del self.open[at:]

    def handle_data(self, data):
        if self.silent:
            self.held.append((self.handle_data, data))
        else:
            self.page.events.append((self.open[-1][1], data, self.links > 0))

    def close(self):
        super().close()
        if self.silent and self.cdata_elem is None:
            held, self.silent, self.loose = self.held, None, True
            for call, *values in held:
                call(*values)


def parse(html: str | None) -> Page:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.page


N_TAGS, N_TOKENS = len(_TAG_GROUPS), len(TOKENS)
FEATURE_COUNT = N_TAGS + 3 * N_TOKENS + N_TAGS + 16


def features(page: Page) -> np.ndarray:
    """One row of features per node."""
    n = len(page.tags)
    parents = np.array(page.parents)
    own = np.zeros((n, 6))  # characters, words, characters in links, sentence marks, nodes, paragraphs
    own[:, 4] = 1
    own[:, 5] = [t == "p" for t in page.tags]
    for node, text, link in page.events:
        if text:
            size = len(text.strip())
            own[node, :4] += (size, text.count(" ") + 1 if size else 0, size * link, sum(map(text.count, ".,;!?")))
    total = own.copy()
    depth = np.zeros(n)
    tag = np.array([_TAG_GROUP.get(t, N_TAGS - 1) for t in page.tags])
    tokens = np.zeros((n, N_TOKENS))
    above = np.zeros((n, N_TOKENS))
    tags_above = np.zeros((n, N_TAGS))
    below = np.zeros((n, N_TOKENS))
    children = np.zeros(n)
    order = np.zeros(n)
    for i in range(n):
        for w in page.words[i]:
            if (group := _TOKEN_GROUP.get(w)) is not None:
                tokens[i, group] = 1
        if i:
            p = parents[i]
            depth[i] = depth[p] + 1
            order[i] = children[p]
            children[p] += 1
            above[i] = np.maximum(above[p], tokens[p])
            tags_above[i] = tags_above[p]
            tags_above[i, tag[p]] = 1
    for i in range(n - 1, 0, -1):
        total[parents[i]] += total[i]
        below[parents[i]] = np.maximum(below[parents[i]], np.maximum(below[i], tokens[i]))
    whole = np.maximum(total[0], 1)
    siblings = np.maximum(children[np.maximum(parents, 0)], 1)
    parent_total = np.maximum(total[np.maximum(parents, 0)], 1)
    seen = np.cumsum(own[:, 0]) - own[:, 0]
    one_hot = np.zeros((n, N_TAGS))
    one_hot[np.arange(n), tag] = 1
    rest = np.stack(
        [
            np.log1p(total[:, 0]), np.log1p(own[:, 0]), total[:, 0] / whole[0], total[:, 0] / parent_total[:, 0], total[:, 2] / np.maximum(total[:, 0], 1),
            total[:, 3] / np.maximum(total[:, 1], 1), total[:, 0] / total[:, 4], total[:, 5], total[:, 5] / whole[5], depth, siblings, order / siblings,
            seen / whole[0], children, np.log1p(total[:, 4]), own[:, 0] / np.maximum(total[:, 0], 1),
        ],
        axis=1,
    )
    return np.concatenate([one_hot, tokens, above, below, tags_above, rest], axis=1)


# --- boosted trees ---------------------------------------------------------------------------


@dataclass
class BoostedTrees:
    """Binary logistic boosting of depth-limited trees over binned features."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.25
    bins: int = 32
    regular: float = 1.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="nearest")) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "right") for e, c in zip(edges, x.T, strict=True)], axis=1)
        used = [f for f, e in enumerate(edges) if len(np.unique(binned[:, f])) > 1]
        rate = y.mean()
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = p - y, p * (1 - p)
            size = 2 ** (self.depth + 1)
            split, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            at = np.ones(len(y), np.int64)
            for node in range(1, size):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                g, h = grad[rows].sum(), hess[rows].sum()
                value[node] = -self.rate * g / (h + self.regular)
                if node >= size // 2 or len(rows) < 8:
                    continue
                best = (1e-6, -1, -1)
                for f in used:
                    b = binned[rows, f]
                    gl, hl = (np.cumsum(np.bincount(b, w[rows], len(edges[f]) + 1))[:-1] for w in (grad, hess))
                    gain = gl**2 / (hl + self.regular) + (g - gl) ** 2 / (h - hl + self.regular) - g**2 / (h + self.regular)
                    gain[(hl < 0.5) | (h - hl < 0.5)] = 0
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), f, int(gain.argmax()))
                if best[1] >= 0:
                    split[node], cut[node] = best[1], edges[best[1]][best[2]]
                    at[rows] = 2 * node + (x[rows, best[1]] >= cut[node])
            self.trees.append((split, cut, value))
            score += value[at]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for split, cut, value in self.trees:
            at = np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = split[at]
                at = np.where(f >= 0, 2 * at + (x[rows, np.maximum(f, 0)] >= cut[at]), at)
            score += value[at]
        return 1 / (1 + np.exp(-score))


# --- training pages --------------------------------------------------------------------------


SYLLABLES = [
    "an er th in on re es ti la de ou é".split(), "ka to mi su ra ne po li ve gu ja cho".split(), "schl ung ei ach ver ge en ber ü st ig ein".split(),
    "по ст на ре ко ни ть ов ра ми ла де".split(), "al wa mu ar sha ki lo ya ne bu da ri".split(), "xi zh ng uo ei an qu li mo te su wen".split(),
]


class _Author:
    """Writes pages of many layouts; the class ``_keep`` marks main text and is taken off again."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.syllables = SYLLABLES[0]
        self.soup = False

    def prose(self, low: int, high: int) -> str:
        r = self.rng
        words = ["".join(r.choices(self.syllables, k=r.randint(1, 4))) for _ in range(r.randint(low, high))]
        return " ".join(w + (r.choice(".,.;") if r.random() < 0.12 else "") for w in words).capitalize() + r.choice([".", ".", "", "!"])

    def name(self, group: str, chance: float = 1.0) -> str:
        r = self.rng
        if r.random() > chance:
            return "" if r.random() < 0.7 else f' class="{r.choice(["wrap", "inner", "box", "row", "col", "x1", "c-2"])}"'
        word = r.choice(TOKENS[group].split())
        word = r.choice([word, word, f"{word}-{r.choice(['box', 'area', 'wrap', 'inner', '1'])}", f"the_{word}", word.capitalize()])
        return f' {r.choice(["class", "class", "id"])}="{word}"'

    def links(self, low: int = 2, high: int = 9) -> str:
        r = self.rng
        items = [f'<a href="/x">{self.prose(1, 3)}</a>' for _ in range(r.randint(low, high))]
        return r.choice(["<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)])

    def paragraph(self, keep: bool) -> str:
        r, mark = self.rng, ' class="_keep"' if keep else ""
        text = self.prose(1, 12) if r.random() < 0.25 else self.prose(8, 90)
        if r.random() < 0.2:
            text = f"<b>{text}"
            return f"<p{mark}>{text}" + r.choice(["</b></p>", "<br>", "<br></p>"])
        if self.soup:
            return f"<div{mark or self.name('content', 0.1)}>{text}</div>"
        if r.random() < 0.2:
            text += f' <a href="/y">{self.prose(1, 4)}</a> {self.prose(1, 5)}'
        return f"<p{mark}>{text}</p>"

    def boilerplate(self, kind: str) -> str:
        r = self.rng
        tag, inside = {
            "menu": ("nav", self.links),
            "header": ("header", lambda: r.choice([self.links(), f"<h2>{self.prose(1, 4)}</h2>", f"<h1>{self.prose(1, 4)}</h1><p>{self.prose(2, 8)}</p>", self.prose(1, 9)])),
            "footer": ("footer", lambda: "&copy; " + self.prose(1, 20) + r.choice(["", self.links(1, 4), f"<p>{self.prose(3, 20)}</p>"])),
            "sidebar": ("aside", lambda: f"<h3>{self.prose(1, 4)}</h3>" + r.choice([self.links(), self.paragraph(False), self.paragraph(False) * 2])),
            "advert": ("div", lambda: r.choice([self.prose(2, 14), self.paragraph(False), f'<a href="/z">{self.prose(2, 9)}</a>', f"<h4>{self.prose(1, 5)}</h4><p>{self.prose(3, 25)}</p>"])),
            "notice": (r.choice(["div", "div", "section", "dialog"]), lambda: r.choice([self.prose(4, 25), self.paragraph(False), f"<p>{self.prose(3, 20)}</p><button>{self.prose(1, 2)}</button>"])),
            "comment": (r.choice(["div", "section", "ol", "ul"]), lambda: f"<h3>{self.prose(1, 3)}</h3>" * (r.random() < 0.5) + "".join(f"<{t}{self.name('comment', 0.5)}>{self.paragraph(False)}</{t}>" for t in r.choices(["div", "li", "article"], k=r.randint(1, 5)))),
            "social": (r.choice(["form", "form", "div"]), lambda: f"<label>{self.prose(1, 3)}</label><input><select><option>{self.prose(1, 2)}</option></select><button>{self.prose(1, 2)}</button>" + r.choice(["", f"<p>{self.prose(2, 15)}</p>"])),
        }[kind]
        own = tag in ("nav", "header", "footer", "aside", "form")
        if own and r.random() < 0.3:
            tag, own = "div", False
        return f"<{tag}{self.name(kind, 0.4 if own else 1.0)}>{inside()}</{tag}>"

    def article(self) -> str:
        r = self.rng
        parts = [f'<h1 class="_keep">{self.prose(2, 14)}</h1>'] * (r.random() < 0.8)
        if parts and r.random() < 0.15:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            x = r.random()
            if x < 0.75:
                parts.append(self.paragraph(True))
            elif x < 0.81:
                parts.append(f'<{(h := r.choice(["h2", "h3"]))} class="_keep">{self.prose(1, 7)}</{h}>')
            elif x < 0.87:
                parts.append("<ul>" + "".join(f'<li class="_keep">{self.prose(2, 18)}</li>' for _ in range(r.randint(1, 5))) + "</ul>")
            elif x < 0.90:
                parts.append(f'<blockquote class="_keep">{self.prose(5, 40)}</blockquote>')
            elif x < 0.92:
                parts.append("<table>" + "".join(f'<tr><td class="_keep">{self.prose(1, 4)}</td><td class="_keep">{self.prose(1, 9)}</td></tr>' for _ in range(2)) + "</table>")
            elif x < 0.94:
                parts.append(f'<figure><img><figcaption class="_keep">{self.prose(3, 12)}</figcaption></figure>')
            else:
                parts.append(self.boilerplate(r.choice(["advert", "advert", "social", "sidebar", "menu", "notice"])))
        body = "".join(parts)
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        body = f"<{tag}{self.name('content', 0.75 if tag in ('div', 'section') else 0.3)}>{body}</{tag}>"
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f"<{(t := r.choice(['div', 'main', 'section']))}{self.name('content', 0.3)}>{body}</{t}>"
        return body

    def page(self) -> str:
        r = self.rng
        kinds = list(TOKENS)[:-1]
        self.syllables = SYLLABLES[0] if r.random() < 0.6 else r.choice(SYLLABLES)
        self.soup = r.random() < 0.1
        before = [self.boilerplate(r.choice(["menu", "header", "advert", "notice", "sidebar", "social"])) for _ in range(r.choice([0, 1, 2, 2, 3, 4]))]
        after = [self.boilerplate(r.choice(["comment", "footer", "sidebar", "advert", "social", "notice", "menu"])) for _ in range(r.choice([0, 1, 2, 2, 3, 4]))]
        if r.random() < 0.08:  # laid out by a table
            html = f"<table><tr><td{self.name('menu', 0.5)}>{''.join(before)}</td><td>{self.article()}</td></tr></table>{''.join(after)}"
        else:
            html = "".join(before) + self.article() + "".join(after)
        if r.random() < 0.25:
            html = f"<div{self.name(r.choice(kinds + ['content'] * 9), 0.1)}>{html}</div>"
        if r.random() < 0.12:  # end tags that may be left out
            html = re.sub(r"</(?:p|li|td|tr)>", "", html)
        title = f"<title>{self.prose(2, 5)}</title>"
        return f"{title}{html}" if r.random() < 0.1 else f"<html><head>{title}</head><body>{html}</body></html>"


TRAIN_PAGES = 1200


def training_rows(seed: int, pages: int) -> Iterator[tuple[Page, np.ndarray]]:
    """Generated pages with each node's label: it holds main text, itself or below."""
    author = _Author(seed)
    for _ in range(pages):
        page = parse(author.page())
        label = np.array(["keep" in w for w in page.words])
        page.words = [[x for x in w if x != "keep"] for w in page.words]
        for i in range(len(label) - 1, 0, -1):
            label[page.parents[i]] |= label[i]
        yield page, label


@functools.lru_cache(maxsize=1)
def default_model() -> BoostedTrees:
    rows = list(training_rows(7, TRAIN_PAGES))
    return BoostedTrees().fit(np.concatenate([features(p) for p, _ in rows]), np.concatenate([y for _, y in rows]).astype(float))


# --- decoding and extraction -----------------------------------------------------------------


def decode(page: Page, probability: np.ndarray) -> np.ndarray:
    """The most likely set of kept nodes in which each kept node's parent is kept; the root is."""
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log1p(-p)
    for i in range(len(p) - 1, 0, -1):  # children come after their parents
        keep[page.parents[i]] += max(keep[i], drop[i])
        drop[page.parents[i]] += drop[i]
    kept = np.ones(len(p), bool)
    for i in range(1, len(p)):
        kept[i] = kept[page.parents[i]] and keep[i] >= drop[i]
    return kept


def render(page: Page, kept: np.ndarray) -> str:
    """Text of the kept nodes: white space is one space, blocks are joined by a line break."""
    blocks: list[str] = []
    held: list[str] = []
    for node, text, _ in page.events:
        if text is None:
            blocks.append(" ".join("".join(held).split()))
            held = []
        elif kept[node]:
            held.append(text)
    blocks.append(" ".join("".join(held).split()))
    return "\n".join(b for b in blocks if b)


def extract(htmls: list[str | None], model: BoostedTrees) -> Iterator[str]:
    for at in range(0, len(htmls), 128):
        pages = [parse(h) for h in htmls[at : at + 128]]
        tables = [features(p) for p in pages]
        scores = model.predict(np.concatenate(tables))
        start = 0
        for page, table in zip(pages, tables, strict=True):
            yield render(page, decode(page, scores[start : start + len(table)]))
            start += len(table)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", model: BoostedTrees | None = None) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``url``, ``text`` and ``n_chars`` (its code points).

    A null or empty page, and a page without main text, gives an empty text. Broken markup is read as browsers do in
    the common cases: missing end tags and heads, silent elements without an end. Very long and deep pages take time in proportion. Rows that repeat, and null ids and urls, are kept. An empty table gives an empty result.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for batch in batches:
            texts = list(extract(batch.column(2).to_pylist(), shared.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(pages[id_col].cast("bigint").alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    return source.mapInArrow(lean(run), "page_id bigint, url string, text string, n_chars bigint")
