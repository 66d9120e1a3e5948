"""Main text of web pages by a tree-structured graphical model over their blocks."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Element names by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
BREAKS = frozenset(("br", "hr", "wbr"))
SILENT = frozenset(
    "script style noscript template textarea title select button datalist iframe object svg math canvas audio video head".split()
)
SKIPPED = {x: re.compile(rf"</{x}(?=[\s/>])[^>]*>", re.I) for x in SILENT}
INSIDE_HEAD = frozenset(("title", "script", "style", "meta", "link", "base", "noscript", "template"))
CLOSES_P = BLOCKS - {"caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "summary", "body", "html"}
ENDS_AT_OWN = {  # a start tag that ends an open one, up to the container in the second set
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dd": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "dt": (frozenset(("dd", "dt")), frozenset(("dl",))),
    "tr": (frozenset(("tr", "td", "th")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
}
TOKEN = re.compile(
    r"""<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""",
    re.S,
)


class Marks:
    """Tags and comments of a page from left to right.

    Behind the last ``>`` there is no tag to look for, and a place that was found is kept until it is passed;
    so open quotes and missing ends cost a page its length, not its length for each ``<``.
    """

    def __init__(self, source: str):
        self.source, self.last = source, source.rfind(">") + 1
        self.comment, self.tag = -1, None
        self.no_comment = self.no_tag = False

    def after(self, at: int) -> tuple[int, int | None, re.Match | None]:
        """Start and end of the next mark from ``at`` on, and its match if it isn't a comment; no end if there is none."""
        if not self.no_comment and self.comment < at:
            self.comment = self.source.find("<!--", at)
            self.no_comment = self.comment < 0
        if not self.no_tag and (self.tag is None or self.tag.start() < at):
            self.tag = TOKEN.search(self.source, at, self.last) if at < self.last else None
            self.no_tag = self.tag is None
        if not self.no_comment and (self.no_tag or self.comment <= self.tag.start()):
            close = self.source.find("-->", self.comment + 4)
            return self.comment, len(self.source) if close < 0 else close + 3, None
        if self.no_tag:
            return len(self.source), None, None
        return self.tag.start(), self.tag.end(), self.tag


ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden|style|aria-label)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

TAG_GROUPS = [
    "p", "h1 h2 h3 h4 h5 h6", "li dd dt", "ul ol dl", "div center", "section", "article", "main", "nav menu dir", "header hgroup",
    "footer", "aside", "form fieldset legend", "table tbody thead tfoot tr td th caption", "blockquote pre", "figure figcaption",
    "body html", "details summary dialog address",
]
NAME_GROUPS = [
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc skip",
    "header masthead topbar logo branding banner",
    "footer copyright legal contentinfo colophon bottom",
    "sidebar side aside widget rail related recommend recommended trending popular more complementary teaser promo",
    "ad ads adv advert adverts advertisement advertising sponsor sponsored dfp outbrain taboola adsense",
    "comment comments disqus reply replies respond discussion responses feedback",
    "cookie cookies consent gdpr notice notices alert modal popup overlay newsletter subscribe subscription signup paywall toast dialog warning",
    "share sharing social follow like tools toolbar actions",
    "form search login signin contact",
    "byline author date meta tags caption",
    "content article post entry story body text main prose copy",
]
TAG_OF = {t: i for i, group in enumerate(TAG_GROUPS) for t in group.split()}
NAME_OF = {t: i for i, group in enumerate(NAME_GROUPS) for t in group.split()}
N_TAGS, N_NAMES = len(TAG_GROUPS), len(NAME_GROUPS)
BORDERS = frozenset(("article", "main", "nav", "header", "footer", "aside", "form", "section"))
WIDTH = 2 * N_TAGS + 2 * N_NAMES + 16
EDGES = 3


class Page:
    """The blocks of one page: parents before children, texts in page order."""

    def __init__(self, source: str):
        self.tags, self.parents, self.names = ["html"], [-1], [()]
        self.pieces: list[tuple[int, list[str]]] = []
        self.chars, self.linked = [0], [0]
        self.hidden = [False]
        self._read(source)

    def _open(self, tag: str, parent: int, attributes: str) -> int:
        words, hidden = [], False
        if attributes:
            for name, value in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), value.strip("\"'")
                if name == "style":
                    hidden |= "display:none" in value.replace(" ", "").lower()
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                    hidden = True
                else:
                    words += [w.lower() for w in NAME_WORD.findall(value)]
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(tuple({NAME_OF[w] for w in words if w in NAME_OF}))
        self.hidden.append(hidden)
        self.chars.append(0)
        self.linked.append(0)
        return len(self.tags) - 1

    def _read(self, source: str) -> None:
        stack, fresh, link = [0], True, 0
        at = 0

        def add(text: str) -> None:
            nonlocal fresh
            if not text:
                return
            node = stack[-1]
            if fresh or not self.pieces:
                self.pieces.append((node, []))
                fresh = False
            self.pieces[-1][1].append(text)
            n = len(text) - text.count(" ") if len(text) < 1 << 16 else len(text)
            self.chars[node] += n
            if link:
                self.linked[node] += n

        marks = Marks(source)
        while True:
            start, end, found = marks.after(at)
            add(unescape(source[at:start]))
            if end is None:
                break
            at = end
            if found is None:
                continue
            closing, name, attributes = found[1], found[2], found[3]
            if name is None:
                closing, name, attributes = found[4], found[5], found[6]
            if name is None:
                continue
            tag = name.lower()
            if tag in SILENT:
                if tag == "head":
                    continue
                if not closing and not attributes.endswith("/"):
                    end = SKIPPED[tag].search(source, at)
                    at = end.end() if end else len(source)
                    if tag in ("select", "button", "textarea"):
                        add(" ")
            elif tag in BREAKS:
                add(" ")
            elif tag == "a":
                link = 0 if closing else stack[-1] + 1
            elif tag in BLOCKS:
                fresh = True
                if closing:
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[k]] == tag:
                            del stack[k:]
                            break
                    if link and link - 1 not in stack:
                        link = 0
                    continue
                if tag == "html":
                    continue
                if tag in CLOSES_P and self.tags[stack[-1]] == "p":
                    stack.pop()
                if tag in ENDS_AT_OWN:
                    ends, until = ENDS_AT_OWN[tag]
                    for k in range(len(stack) - 1, 0, -1):
                        if self.tags[stack[k]] in until:
                            break
                        if self.tags[stack[k]] in ends:
                            del stack[k:]
                            break
                if link and link - 1 not in stack:
                    link = 0
                stack.append(self._open(tag, stack[-1], attributes))

    def texts(self) -> list[tuple[int, str]]:
        """(block, text) of every piece with text, white space made one space."""
        out = []
        for node, parts in self.pieces:
            text = " ".join("".join(parts).split())
            if text:
                out.append((node, text))
        return out


def describe(page: Page, texts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (blocks x WIDTH), parents, and the kind of the edge to the parent."""
    n = len(page.tags)
    x = np.zeros((n, WIDTH), np.float32)
    parents = np.array(page.parents)
    own = np.array(page.chars, float)
    link = np.array(page.linked, float)
    whole, whole_link = own.copy(), link.copy()
    for k in range(n - 1, 0, -1):
        whole[parents[k]] += whole[k]
        whole_link[parents[k]] += whole_link[k]
    stops, words, first, last = np.zeros(n), np.zeros(n), np.full(n, -1.0), np.zeros(n)
    closed = np.zeros(n)
    total = max(sum(len(t) for _, t in texts), 1)
    seen = 0
    for node, text in texts:
        stops[node] += sum(map(text.count, ".,;!?。，、"))
        words[node] += text.count(" ") + 1
        closed[node] = text[-1] in ".!?…。\"'”»)"
        if first[node] < 0:
            first[node] = seen / total
        seen += len(text)
    edges = np.zeros(n, np.int64)
    within, at = N_TAGS + N_NAMES, 2 * (N_TAGS + N_NAMES)  # own tag and names, then those of all blocks above
    for k in range(n):
        tag = page.tags[k]
        if tag in TAG_OF:
            x[k, TAG_OF[tag]] = 1
        for name in page.names[k]:
            x[k, N_TAGS + name] = 1
        if k:
            p = parents[k]
            x[k, within:at] = np.maximum(x[p, within:at], x[p, :within])
            edges[k] = 2 if tag in BORDERS or page.names[k] else int(page.tags[p] in ("body", "html"))
            page.hidden[k] = page.hidden[k] or page.hidden[p]
    numbers = [
        np.ones(n), np.log1p(own) / 5, np.log1p(whole) / 8, link / np.maximum(own, 1), whole_link / np.maximum(whole, 1),
        whole / max(whole[0], 1), np.log1p(words) / 4, np.minimum(stops / np.maximum(words, 1), 1), closed, own > 0,
        (own > 0) & (words < 4), words > 12, (first >= 0) & (first < 0.05), first > 0.95, np.array(page.hidden), np.log1p(stops) / 3,
    ]
    for i, column in enumerate(numbers):
        x[:, at + i] = column
    return x, parents, edges


class Forest:
    """The blocks of several pages as one forest, by depth."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.starts = np.cumsum([0] + [len(p[0]) for p in parts])
        self.x = np.concatenate([p[0] for p in parts])
        self.parents = np.concatenate([np.where(p[1] < 0, -1, p[1] + s) for p, s in zip(parts, self.starts)])
        self.edges = np.concatenate([p[2] for p in parts])
        depth = np.zeros(len(self.parents), np.int64)
        for k, p in enumerate(self.parents.tolist()):
            if p >= 0:
                depth[k] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        self.levels = np.split(order, cuts)

    def marginals(self, unary: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chance of each label (blocks x 2), of each parent-child pair, and log partition sums.

        ``unary`` is blocks x 2, ``pair`` kinds x parent label x child label. One
        sweep of messages goes up from the leaves, one down from the roots.
        """
        n = len(self.parents)
        inbox, up, down = unary.copy(), np.zeros((n, 2)), np.zeros((n, 2))
        for level in self.levels[:0:-1]:
            scores = pair[self.edges[level]] + inbox[level][:, None, :]
            up[level] = np.logaddexp(scores[:, :, 0], scores[:, :, 1])
            np.add.at(inbox, self.parents[level], up[level])
        roots = self.levels[0]
        joint = np.zeros((n, 2, 2))
        belief = inbox.copy()
        for level in self.levels[1:]:
            cavity = belief[self.parents[level]] - up[level]
            scores = cavity[:, :, None] + pair[self.edges[level]]
            down[level] = np.logaddexp(scores[:, 0], scores[:, 1])
            belief[level] = inbox[level] + down[level]
            both = scores + inbox[level][:, None, :]
            both -= both.max((1, 2), keepdims=True)
            both = np.exp(both)
            joint[level] = both / both.sum((1, 2), keepdims=True)
        log_z = np.logaddexp(inbox[roots, 0], inbox[roots, 1])
        shifted = np.exp(belief - belief.max(1, keepdims=True))
        return shifted / shifted.sum(1, keepdims=True), joint, log_z


class Model:
    """Weights of the block features and the parent-child potentials."""

    def __init__(self, weights: np.ndarray, pair: np.ndarray):
        self.weights, self.pair = weights, pair

    def content(self, forest: Forest) -> np.ndarray:
        unary = np.zeros((len(forest.x), 2))
        unary[:, 1] = forest.x @ self.weights
        return forest.marginals(unary, self.pair)[0][:, 1]


def train(forest: Forest, labels: np.ndarray, steps: int = 300, rate: float = 0.1, ridge: float = 3e-4) -> Model:
    """Maximum likelihood of the labels: the gradient is observed minus expected features and pairs."""
    weights, pair = np.zeros(forest.x.shape[1]), np.zeros((EDGES, 2, 2))
    inner = np.flatnonzero(forest.parents >= 0)
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (forest.edges[inner], labels[forest.parents[inner]], labels[inner]), 1)
    moments = [np.zeros(weights.size + pair.size) for _ in range(2)]
    n = len(labels)
    for step in range(1, steps + 1):
        unary = np.zeros((n, 2))
        unary[:, 1] = forest.x @ weights
        chance, joint, _ = forest.marginals(unary, pair)
        expected = np.zeros((EDGES, 2, 2))
        np.add.at(expected, forest.edges[inner], joint[inner])
        slope = np.concatenate([forest.x.T @ (labels - chance[:, 1]), (seen - expected).ravel()]) / n
        slope -= ridge * np.concatenate([weights, pair.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.999 * moments[1] + 0.001 * slope**2
        move = rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        weights, pair = weights + move[: weights.size], pair + move[weights.size :].reshape(pair.shape)
    return Model(weights, pair)


class PageMaker:
    """Labelled pages: layouts put together at random from blocks whose kind is known.

    The words are made up anew for every page, so only structure, names and
    shape of the text can be learned. ``html`` and ``label`` go together: label
    1 marks the blocks that belong to the article.
    """

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> list[str]:
        r = self.r
        letters = r.choice(["aeiounrstlmd", "bcdfghjklmnpqrstvwxyzaeiou", "éàüßñaeiounrst"])
        return ["".join(r.choices(letters, k=r.randint(2, 9))) for _ in range(r.randint(low, high))]

    def sentence(self, low: int = 5, high: int = 25) -> str:
        words = self.words(low, high)
        return escape(" ".join(words).capitalize()) + self.r.choice(".....!?")

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def name(self, group: int | None, other: float = 0.3) -> str:
        r = self.r
        if group is None or r.random() < other:
            if r.random() < 0.5:
                return ""
            word = r.choice(["box", "wrap", "inner", "row", "col", "x1", "block", "c-3", "grid", "item"])
        else:
            word = r.choice(NAME_GROUPS[group].split())
            word = r.choice([word, word, f"{word}-{r.choice(['box', 'wrap', 'inner', 'area', 'list'])}", f"site-{word}", f"{word}{r.randint(1, 9)}"])
        return f' {r.choice(["class", "class", "id"])}="{word}"'

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{" ".join(self.words(low, high))}</a>'

    def links(self, low: int, high: int) -> str:
        r, n = self.r, self.r.randint(low, high)
        if r.random() < 0.75:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return r.choice([" | ", " ", " &middot; "]).join(self.link() for _ in range(n))

    def box(self, tags: str, group: int | None, inside: str, label: int, other: float = 0.3) -> str:
        tag = self.r.choice(tags.split())
        return f'<{tag}{self.name(group, other)} data-y="{label}">{inside}</{tag}>'

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return self.box("nav nav div ul", 0, self.links(3, 9), 0)
        if kind == "header":
            return self.box("header div", 1, self.link() + r.choice(["", self.sentence(2, 6), f"<p>{self.sentence(2, 6)}</p>"]), 0)
        if kind == "footer":
            text = r.choice(["&copy; ", "", "Copyright "]) + self.sentence(2, 12)
            return self.box("footer footer div", 2, text + r.choice(["", self.links(2, 6), f"<p>{self.sentence()}</p>"]), 0)
        if kind == "side":
            body = f"<h3>{' '.join(self.words(1, 3))}</h3>" + r.choice([self.links(3, 8), f"<p>{self.prose(1, 3)}</p>"])
            return self.box("aside aside div section", 3, body, 0, 0.1)
        if kind == "ad":
            return self.box("div div aside ins section", 4, r.choice([self.prose(1, 3), self.link(3, 9), f"<p>{self.prose(1, 2)}</p>"]), 0, 0.0)
        if kind == "comments":
            each = lambda: self.box("div li article", 5, f"<p>{self.prose(1, 4)}</p>" + r.choice(["", self.link()]), 0)
            body = r.choice(["", f"<h2>{' '.join(self.words(1, 3))}</h2>"]) + "".join(each() for _ in range(r.randint(1, 6)))
            return self.box("section div ol", 5, body, 0, 0.0)
        if kind == "notice":
            return self.box("div div aside section dialog", 6, r.choice([self.prose(1, 3), f"<p>{self.prose(1, 3)}</p>"]) + r.choice(["", "<button>ok</button>", self.link()]), 0, 0.0)
        if kind == "share":
            return self.box("div ul p", 7, self.links(2, 5), 0)
        body = f"<label>{' '.join(self.words(1, 3))}</label><input><p>{self.sentence()}</p><button>go</button>"
        return self.box("form", 8, body, 0)

    def article(self) -> str:
        r, out = self.r, []
        head = f"<h1>{' '.join(self.words(3, 10))}</h1>"
        if r.random() < 0.3:
            head += f'<p{self.name(9)}>{self.sentence(2, 6)}</p>'
        out.append(f"<header>{head}</header>" if r.random() < 0.3 else head if r.random() < 0.9 else "")
        for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20])):
            kind = r.random()
            if kind < 0.62:
                text = self.prose(1, 6) if r.random() < 0.85 else self.sentence(1, 3)
                if r.random() < 0.2:
                    text = f"{text} {self.link()} {self.sentence()}"
                if r.random() < 0.15:
                    text = f"<b>{text}<br>"
                out.append(r.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"<div>{text}</div>"]))
            elif kind < 0.70:
                out.append(f"<h{r.randint(2, 4)}>{' '.join(self.words(1, 6))}</h{2}>".replace("</h2>", "</h2>"))
            elif kind < 0.77:
                out.append("<ul>" + "".join(f"<li>{self.sentence(1, 12)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif kind < 0.82:
                out.append(f"<blockquote><p>{self.prose(1, 2)}</p></blockquote>")
            elif kind < 0.86:
                rows = "".join("<tr>" + "".join(f"<td>{' '.join(self.words(1, 3))}</td>" for _ in range(3)) + "</tr>" for _ in range(3))
                out.append(f"<table>{rows}</table>")
            elif kind < 0.90:
                out.append(f"<figure><img src=x><figcaption>{self.sentence(2, 9)}</figcaption></figure>")
            elif kind < 0.93:
                out.append(f"<section><h2>{' '.join(self.words(1, 4))}</h2><p>{self.prose(1, 3)}</p></section>")
            else:
                out.append(self.boilerplate(r.choice(["ad", "side", "share", "notice", "form", "nav"])))
        if r.random() < 0.15:
            out.append(self.boilerplate("comments"))
        if r.random() < 0.12:  # blocks of the article beside those of the page, without an element around them
            mark = lambda part: part if 'data-y="0"' in part[:80] else re.sub(r"^<(\w+)", r'<\1 data-y="1"', part)
            return "".join(map(mark, out))
        tag = r.choice(["article", "article", "main", "div", "section"])
        other = 0.0 if tag in ("div", "section") and r.random() < 0.8 else 0.5
        return f'<{tag}{self.name(10, other)} data-y="1">{"".join(out)}</{tag}>'

    def page(self) -> str:
        r = self.r
        if r.random() < 0.03:
            return f'<html><body data-y="1">{self.prose(1, 12)}</body></html>'
        before = [k for k, p in (("notice", 0.2), ("header", 0.5), ("nav", 0.7), ("ad", 0.4), ("form", 0.15)) if r.random() < p]
        after = [k for k, p in (("side", 0.4), ("comments", 0.35), ("share", 0.2), ("ad", 0.25), ("nav", 0.2), ("form", 0.1), ("notice", 0.1), ("footer", 0.75)) if r.random() < p]
        r.shuffle(before)
        body = "".join(map(self.boilerplate, before)) + self.article() + "".join(map(self.boilerplate, after))
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f'<div{self.name(None)} data-y="0">{body}</div>'
        return f"<html><head><title>{' '.join(self.words(2, 6))}</title></head><body>{body}</body></html>"


LABEL = re.compile(r'\sdata-y="([01])"')


def labelled(source: str) -> tuple[Page, np.ndarray]:
    """A page and its labels: each block takes the nearest label at or above it."""

    class Marked(Page):
        def _open(self, tag, parent, attributes):
            node = super()._open(tag, parent, LABEL.sub("", attributes))
            found = LABEL.search(attributes)
            self.marks.append(int(found[1]) if found else self.marks[parent])
            return node

        def _read(self, source):
            self.marks = [0]
            super()._read(source)

    page = Marked(source)
    return page, np.array(page.marks)


def default_model(pages: int = 400, seed: int = 5) -> Model:
    """A model trained on ``pages`` labelled pages of ``PageMaker`` (a fixed number, whatever the input)."""
    maker = PageMaker(seed)
    made = [labelled(maker.page()) for _ in range(pages)]
    forest = Forest([describe(page, page.texts()) for page, _ in made])
    return train(forest, np.concatenate([y for _, y in made]))


def main_texts(sources: list[str | None], model: Model, least: float = 0.5) -> list[str]:
    """The main text of every page: the texts of blocks whose chance of content is ``least`` or more."""
    pages = [Page(s or "") for s in sources]
    texts = [p.texts() for p in pages]
    forest = Forest([describe(p, t) for p, t in zip(pages, texts)])
    keep = model.content(forest) >= least
    return [" ".join(x for node, x in t if keep[start + node]) for t, start in zip(texts, forest.starts)]


def extract(pages: DataFrame, html: str = "html", model: Model | None = None, batch: int = 64) -> DataFrame:
    """``pages`` without ``html`` and with ``text`` and ``n_chars``, row by row without a shuffle.

    The whole page is read; a null or empty one, or one without content, gives
    an empty text. Markup that isn't closed or nested well is read as a browser
    would, as far as blocks go. Columns named text or n_chars are replaced. The
    model is small (some hundred numbers) and goes with the tasks.
    """
    model = model or default_model()
    names = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                found = main_texts(part.column(html).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in names], pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                    names=[*names, "text", "n_chars"],
                )

    from sievegrid.llm.toxicity import _with

    return pages.select(*names, html).mapInArrow(run, _with(pages.select(*names), "text string, n_chars long"))
