"""Main text of web pages by boosted trees over the nodes of their DOM.

Every element of a page gets features of its subtree (text density, share of
link text, punctuation), of its tag and attribute tokens, of its depth and of
its siblings. Gradient-boosted trees give the odds that an element holds main
text, and a decoding over the tree picks the best labelling in which an
element is kept only below kept ancestors, so no choice contradicts one above
or below it. The kept text nodes make the text.

The trees are fitted on about ``FIT_PAGES`` pages of a bounded length, chosen by
the hash of page_id, whose semantic tags serve as labels. Copies of these pages
teach the trees to do without them: some get other containers and added notices,
side bars, forms, link blocks and comments, and in others the tags that the
labels come from are replaced by plain ones and their attributes removed, so
that text density, links, position and siblings must tell.

Cases: null, empty and tagless pages (the text is then all main text) and
unclosed or stray tags are handled; a page without kept text gives an empty
text; repeated rows are extracted alike; an empty table gives an empty result;
without pages to learn from, semantic tags alone decide; other columns are
ignored, whatever their names. Tags end where HTML says: quotes count only as
the value of an attribute. A ``<`` that no ``>`` follows is text; after a tag
that only quoted ``>`` follow, the rest of the page's tags end at their first
``>``. So each character is scanned a fixed number of times, and parsing takes
time in proportion to a page, however deep its elements are nested.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common

FIT_PAGES = 250
TREES, DEPTH, RATE, BINS = 40, 4, 0.2, 32

# Elements by what HTML says of them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas head select textarea button".split())
RAW = frozenset("script style noscript template textarea iframe svg math title".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
SAME_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPES = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
# Tags and attribute tokens that speak for or against main text.
MAIN_TAGS = ("article", "main")
OTHER_TAGS = ("nav", "footer", "aside", "form", "header", "dialog", "menu")
FOR_TOKENS = ("article", "main", "content", "post", "entry", "story", "body", "text")
AGAINST_TOKENS = (
    "ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "menu", "breadcrumb", "breadcrumbs",
    "header", "masthead", "footer", "sidebar", "aside", "widget", "related", "recommended", "share", "social", "comment", "comments", "reply",
    "replies", "cookie", "consent", "notice", "alert", "popup", "modal", "newsletter", "subscribe", "signup", "login", "form", "search",
    "pagination", "pager", "copyright", "legal", "toolbar", "tags", "disqus", "respond",
)

# Attributes by the rules of HTML: a quote counts only where a value begins, and what is matched is never given back.
_VALUE = r"""[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"([^"]*+)"|'([^']*+)'|([^ \t\n\f\r>"'][^ \t\n\f\r>]*+))"""
_ATTRIBUTE = re.compile(rf"(=?+[^ \t\n\f\r/>=]++|=)(?:{_VALUE})?+")
_TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:[ \t\n\f\r/]++|{_ATTRIBUTE.pattern})*+)>").match
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)([^>]*+)>").match
_NAMES = frozenset(("class", "id", "role", "itemprop"))
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_REFERENCE = re.compile(r"&#(?:([0-9]{9,})|[xX]([0-9a-fA-F]{9,}));?")
_FOR, _AGAINST = frozenset(FOR_TOKENS), frozenset(AGAINST_TOKENS)
TAGS = ("p", "div", "section", "article", "main", "nav", "footer", "header", "aside", "form", "ul", "ol", "li", "a", "table", "td", "h1", "h2", "h3", "blockquote", "pre", "body", "html", "span", "b")
_TAG_AT = {t: i for i, t in enumerate(TAGS)}


def _short(m: re.Match) -> str:
    """A numeric reference of many digits: its character, or U+FFFD beyond all characters."""
    digits = (m[1] or m[2]).lstrip("0") or "0"
    return "\ufffd" if len(digits) > 8 else f"&#{digits};" if m[1] else f"&#x{digits};"


class Page:
    """A page's elements in document order, and its text runs.

    ``runs``: (element, text) with None as the text of a block boundary."""

    def __init__(self, source: str | None):
        self.tag, self.parent, self.tokens, self.runs = ["#root"], [-1], [()], []
        source = source or ""
        self._stack = [0]
        self._places: dict[str, list[int]] = {}  # where in the stack the elements of a tag are open
        self._blocks: list[int] = []  # and those that are not inline
        at, look, end, tag = 0, 0, len(source), _TAG
        close = source.rfind(">")
        limit = max(close, source.rfind("<!--"))
        lowered = source.lower() if "<" in source else source
        if len(lowered) != end:  # some letters grow when lowered
            lowered = re.sub("[A-Z]", lambda m: m[0].lower(), source)
        while look < end:
            start = source.find("<", look)
            if start < 0 or start > limit:
                break
            look, m = start + 1, None
            if source.startswith("<!--", start):
                stop = source.find("-->", start + 4)
                stop = end if stop < 0 else stop + 3
            elif start > close:
                continue
            elif source.startswith(("<!", "<?"), start):
                stop = source.find(">", start) + 1
            else:
                m = tag(source, start)
                if m is None and tag is _TAG:
                    m = _PLAIN(source, start)
                    tag = _PLAIN if m else tag
                if m is None:
                    continue
                stop = m.end()
            if start > at:
                self.runs.append((self._stack[-1], source[at:start]))
            at = look = stop
            if m is not None:
                at = look = self._tag(m, lowered)
        if at < end:
            self.runs.append((self._stack[-1], source[at:]))

    def _tag(self, m: re.Match, lowered: str) -> int:
        """Opens or closes an element; the place where reading goes on."""
        name = m[2].lower()
        if m[1]:
            self._close(name)
        if name not in INLINE:
            self.runs.append((self._stack[-1], None))
        if m[1] or name in VOID:
            return m.end()
        if name in CLOSES_P:
            self._close_open_p()
        if name in SAME_CLOSES:
            self._close_same(name)
        if name not in IN_HEAD:
            self._close("head")
        self.tag.append(name)
        self.parent.append(self._stack[-1])
        self.tokens.append(self._tokens(m[3]) if m[3] else ())
        self._places.setdefault(name, []).append(len(self._stack))
        if name not in INLINE:
            self._blocks.append(len(self._stack))
        self._stack.append(len(self.tag) - 1)
        if name in RAW:  # its content is no markup
            at = lowered.find(f"</{name}", m.end())
            return len(lowered) if at < 0 else at
        return m.end()

    @staticmethod
    def _tokens(attributes: str) -> tuple[str, ...]:
        own = (m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes) if m[1].lower() in _NAMES)
        return tuple(t.lower() for value in own for t in _TOKEN.findall(value))

    def _last(self, *names: str) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((places[-1] for n in names if (places := self._places.get(n))), default=-1)

    def _cut(self, k: int) -> None:
        for i in self._stack[k:]:
            self._places[self.tag[i]].pop()
        while self._blocks and self._blocks[-1] >= k:
            self._blocks.pop()
        del self._stack[k:]

    def _close(self, name: str) -> None:
        if (k := self._last(name)) > 0:
            self._cut(k)

    def _close_open_p(self) -> None:
        """Closes an open paragraph that holds nothing but inline elements."""
        if self._blocks and self.tag[self._stack[self._blocks[-1]]] == "p":
            self._cut(self._blocks[-1])

    def _close_same(self, name: str) -> None:
        """Closes the item or cell before, unless a list or table lies between."""
        k = self._last(*SAME_CLOSES[name])
        if k > self._last(*SCOPES[name]):
            self._cut(k)

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = np.array(self.parent)
        own, marks = np.zeros(n), np.zeros(n)
        for node, text in self.runs:
            if text and (size := len(text) - text.count(" ")):
                own[node] += size
                marks[node] += text.count(".") + text.count(",")
        link = np.array([o if t == "a" else 0.0 for o, t in zip(own, self.tag)])
        size = np.ones(n)
        kids, ps = np.zeros(n), np.zeros(n)
        text, anchor, mark, inner_p = own.copy(), link.copy(), marks.copy(), np.array([float(t == "p") for t in self.tag])
        ps += inner_p
        depth = np.zeros(n)
        for i in range(1, n):
            depth[i] = depth[parent[i]] + 1
            kids[parent[i]] += 1
        rank, seen = np.zeros(n), np.zeros(n)
        left = np.zeros(n)  # text of the sibling before
        last = np.full(n, -1)
        for i in range(n - 1, 0, -1):  # children come after their parents
            p = parent[i]
            text[p] += text[i]
            anchor[p] = anchor[p] + (text[i] if self.tag[i] == "a" and own[i] == 0 else anchor[i])
            mark[p] += mark[i]
            size[p] += size[i]
            ps[p] += ps[i]
        right = np.zeros(n)
        for i in range(1, n):
            p = parent[i]
            rank[i] = seen[p]
            seen[p] += 1
            if last[p] >= 0:
                left[i], right[last[p]] = text[last[p]], text[i]
            last[p] = i
        good = np.array([sum(t in _FOR for t in ts) for ts in self.tokens], float)
        bad = np.array([sum(t in _AGAINST for t in ts) for ts in self.tokens], float)
        main = np.array([float(t in MAIN_TAGS) for t in self.tag])
        other = np.array([float(t in OTHER_TAGS) for t in self.tag])
        up_good, up_bad = good + main, bad + other
        before = np.zeros(n)
        for i in range(1, n):
            up_good[i] += up_good[parent[i]]
            up_bad[i] += up_bad[parent[i]]
        order = np.zeros(n)
        run = 0.0
        for node, t in self.runs:
            if before[node] == 0:
                before[node] = run
            run += len(t) if t else 0
        total = max(text[0], 1.0)
        around = np.maximum(text[np.maximum(parent, 0)], 1.0)
        order = np.array([_TAG_AT.get(t, len(TAGS)) for t in self.tag], float)
        return np.column_stack(
            [
                np.log1p(text), np.log1p(own), text / size, anchor / np.maximum(text, 1), mark / np.maximum(text, 1), text / total,
                text / around, np.log1p(ps), kids, depth, rank, seen[np.maximum(parent, 0)], np.log1p(left), np.log1p(right),
                good, bad, main, other, up_good, up_bad, order, before / max(run, 1.0), np.log1p(size),
                np.isin(order, [0, 16, 17, 18, 19, 20]).astype(float),
            ]
        )

    def semantic(self) -> np.ndarray:
        """Labels from semantic tags and tokens: 1 main, 0 not; ancestors of main count as main."""
        n = len(self.tag)
        state = np.zeros(n, int)
        for i in range(1, n):
            above, tag = state[self.parent[i]], self.tag[i]
            state[i] = above
            if above == 0 and tag in MAIN_TAGS:
                state[i] = 1
            if tag in OTHER_TAGS or tag in SKIPPED or any(t in _AGAINST for t in self.tokens[i]):
                state[i] = -1
        out = state == 1
        for i in range(n - 1, 0, -1):
            if out[i]:
                out[self.parent[i]] = True
        return out.astype(float)

    def decode(self, odds: np.ndarray) -> np.ndarray:
        """The likeliest labelling in which kept elements lie below kept ones."""
        keep = -np.logaddexp(0, -odds)  # log p
        drop = -np.logaddexp(0, odds)
        n = len(odds)
        for i in range(n):
            if self.tag[i] in SKIPPED:
                keep[i] = -1e9
        keep[0], drop[0] = 0.0, -1e9
        own = keep.copy()
        below = drop.copy()  # the whole subtree dropped
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            own[p] += max(own[i], below[i])
            below[p] += below[i]
        kept = np.zeros(n, bool)
        kept[0] = True
        for i in range(1, n):
            kept[i] = kept[self.parent[i]] and own[i] >= below[i]
        return kept

    def text(self, kept: np.ndarray) -> str:
        blocks, now = [], []
        for node, text in self.runs:
            if text is None:
                if now:
                    blocks.append("".join(now))
                    now = []
            elif kept[node]:
                now.append(text)
        if now:
            blocks.append("".join(now))
        clean = (_SPACE.sub(" ", entities.unescape(_REFERENCE.sub(_short, b))).strip() for b in blocks)
        return " ".join(b for b in clean if b)


@dataclass
class Trees:
    """Boosted regression trees over binned features, for the log loss."""

    base: float
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, bin and value of each node of a full tree

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def odds(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self._bins(x), np.arange(len(x))
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (bins[rows, feature[at]] > cut[at])
            out += value[at]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
        mean = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        model = cls(float(np.log(mean / (1 - mean))), edges, [])
        bins, odds = model._bins(x), np.full(len(x), model.base)
        inner, size = 2**DEPTH - 1, 2 ** (DEPTH + 1) - 1
        flat = bins.astype(np.int64) + BINS * np.arange(x.shape[1])
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-odds))
            g, h = weight * (p - y), weight * p * (1 - p)
            feature, cut, value, at = np.zeros(size, np.int64), np.full(size, BINS), np.zeros(size), np.zeros(len(x), np.int64)
            for node in range(inner):
                own = np.flatnonzero(at == node)
                if not len(own):
                    continue
                total_g, total_h = g[own].sum(), h[own].sum()
                wide = x.shape[1] * BINS
                keys = flat[own].ravel()
                sums = [np.bincount(keys, np.repeat(v[own], x.shape[1]), wide).reshape(-1, BINS).cumsum(1) for v in (g, h)]
                lg, lh = sums
                gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1) - total_g**2 / (total_h + 1)
                gain[(lh < 0.5) | (total_h - lh < 0.5)] = -1
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    feature[node], cut[node] = divmod(best, BINS)
                at[own] = 2 * node + 1 + (bins[own, feature[node]] > cut[node])
            leaf_g, leaf_h = np.bincount(at, g, size), np.bincount(at, h, size)
            value = -RATE * leaf_g / (leaf_h + 1)
            odds += value[at]
            model.trees.append((feature, cut, value))
        return model


def _tags_for(rng: random.Random) -> tuple[str, str]:
    token = rng.choice(FOR_TOKENS)
    return rng.choice(
        [("<article>", "</article>"), ("<main>", "</main>"), (f'<div class="{token}">', "</div>"), (f'<div id="{token}-{rng.randint(1, 99)}">', "</div>"), ('<div class="c1">', "</div>"), ("<section>", "</section>")]
    )


#: Tags that say what a page's part is, and the attributes that may.
_TELLING = re.compile(r"<(/?)(?:nav|header|footer|aside|article|main|section)(?=[\s>])", re.I)
_NAMED = re.compile(r"""\s(?:class|id|role|itemprop)\s*=\s*(?:"[^"<>]*"|'[^'<>]*')""", re.I)


def masked(page: str) -> str:
    """A page with the same elements, of which tags and attributes tell nothing."""
    return re.sub(r"<[^<>]*>", lambda m: _NAMED.sub("", _TELLING.sub(r"<\1div", m[0])), page)


def varied(page: str, rng: random.Random, plain: bool = False) -> str:
    """A copy of a page with another container and with added blocks that are no
    main text; with ``plain`` only blocks whose form tells that they are none."""
    words = re.sub(r"<[^>]*>", " ", page).split()[:400] or ["text"]

    def some(least: int, most: int) -> str:
        k = rng.randrange(len(words))
        return entities.escape(" ".join((words[k:] + words)[: rng.randint(least, most)]))

    def block() -> str:
        kind, token = rng.choice((2, 3, 6, 7) if plain else range(8)), rng.choice(AGAINST_TOKENS)
        if kind == 6:
            return f'<div class="{token}">' + " ".join(f'<a href="/x">{some(1, 3)}</a>' for _ in range(rng.randint(2, 9))) + "</div>"
        if kind == 7:
            return f'<ul class="{token}">' + "".join(f'<li><a href="/x">{some(1, 5)}</a></li>' for _ in range(rng.randint(2, 9))) + "</ul>"
        if kind == 0:
            return f'<div class="{token}">{some(3, 40)}</div>'
        if kind == 1:
            return f'<section class="comments" data-x=""><h3>{some(1, 3)}</h3>' + "".join(f'<div class="comment"><p>{some(4, 60)}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>"
        if kind == 2:
            return '<aside><ul>' + "".join(f'<li><a href="/x">{some(1, 6)}</a></li>' for _ in range(rng.randint(2, 8))) + "</ul></aside>"
        if kind == 3:
            return f'<form action="/s"><label>{some(1, 3)}</label><input name="q"><p>{some(2, 12)}</p></form>'
        if kind == 4:
            return f'<div id="{token}"><p>{some(5, 50)}</p><p><a href="/p">{some(1, 4)}</a></p></div>'
        return f'<header class="site-header"><h2>{some(1, 5)}</h2><p>{some(2, 10)}</p></header>'

    opening, closing = _tags_for(rng)
    page = re.sub(r"<(article|main)(\s[^>]*)?>", lambda _: f"\x01{opening}", page, count=1)
    page = re.sub(r"</(article|main)>", lambda _: f"{closing}\x02", page, count=1)
    inside = [m.end() for m in re.finditer(r"</p>", page)]
    for at in sorted(rng.sample(inside, min(len(inside), rng.randint(0, 2))), reverse=True):
        page = page[:at] + block() + page[at:]
    for mark in ("\x01", "\x02"):
        page = page.replace(mark, mark + "".join(block() for _ in range(rng.randint(0, 2))))
    return page


def train(sources: list[str | None], seed: int = 7) -> Trees | None:
    """Fits the trees on pages with semantic tags, on varied copies and on copies
    without telling tags, which keep the labels of their elements."""
    rng = random.Random(seed)
    xs, ys = [], []
    for source in sources:
        for kind in ("own", "varied", "varied", "masked"):
            marked = source or "" if kind == "own" else varied(source or "", rng, plain=kind == "masked")
            bare = marked.replace("\x01", "").replace("\x02", "")
            page = Page(bare)
            labels = page.semantic() if kind == "own" else _varied_labels(marked, page)
            if kind == "masked":
                page = Page(masked(bare))
                if len(page.tag) != len(labels):
                    continue
            xs.append(page.features()[1:])
            ys.append(labels[1:])
    x, y = (np.concatenate(v) if v else np.zeros(0) for v in (xs, ys))
    if not len(y) or y.min() == y.max():
        return None
    return Trees.fit(x, y, np.ones(len(y)))


def _varied_labels(marked: str, page: Page) -> np.ndarray:
    """Labels of a varied copy: as semantic tags would have it in its container."""
    start = marked.find("\x01")
    if start < 0:
        return page.semantic()
    first = Page(marked[:start].replace("\x02", ""))
    labels = np.zeros(len(page.tag))
    head = len(first.tag)
    # the container is the first element after the mark that may hold main text
    container = next((i for i in range(head, len(page.tag)) if _is_container(page, i)), None)
    if container is None:
        return page.semantic()
    labels[container] = 1
    for i in range(container + 1, len(page.tag)):
        tag = page.tag[i]
        inside = page.parent[i] >= container and labels[page.parent[i]] == 1
        labels[i] = float(inside and tag not in OTHER_TAGS and tag not in SKIPPED and not any(t in _AGAINST for t in page.tokens[i]))
    at = page.parent[container]
    while at > 0:
        labels[at] = 1
        at = page.parent[at]
    return labels


def _is_container(page: Page, i: int) -> bool:
    return page.tag[i] in ("article", "main", "div", "section") and not any(t in _AGAINST for t in page.tokens[i])


def fit(pages: DataFrame, n: int = FIT_PAGES) -> Trees | None:
    """Fits on about ``n`` pages, chosen by the hash of page_id."""
    known = pages.select("page_id", "html").where("html is not null")
    return train([r["html"] for r in common.sampled(known, n, "page_id", "html")])


def extract(sources: list[str | None], model: Trees | None) -> list[str]:
    pages = [Page(s) for s in sources]
    if model is None:
        odds = [np.where(p.semantic() > 0, 5.0, -5.0) for p in pages]
    elif pages:
        cuts = np.cumsum([len(p.tag) for p in pages])[:-1]
        odds = np.split(model.odds(np.concatenate([p.features() for p in pages])), cuts)
    else:
        odds = []
    return [p.text(p.decode(o)) if len(p.tag) > 1 else p.text(np.ones(1, bool)) for p, o in zip(pages, odds)]


def main_text(pages: DataFrame, model: Trees | None, html: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources = b.column("html")
            texts = [t for i in range(0, len(sources), 256) for t in extract(sources[i : i + 256].to_pylist(), model)]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(html).alias("html")).mapInArrow(
        run, "page_id long, url string, text string"
    )
    return rows.withColumn("n_chars", F.length("text").cast("long"))
