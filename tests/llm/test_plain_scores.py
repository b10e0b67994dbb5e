"""Scores and page texts against plain computations of their definitions."""

import html.parser
import math
import random
import re

import numpy as np
import pytest

from fieldloom.llm import htmltext, toxicity


def test_toxicity_scores():
    """A score is the logistic of the bias and the weights of all distinct words and word beginnings."""
    r = random.Random(2)
    words = ["".join(r.choices("abcé", k=r.randint(1, 9))) for _ in range(60)]
    features = {f for w in words for f in (w + "$", *(w[:k] for k in (4, 5, 6, 7) if len(w) >= k))}
    weights = {f: r.uniform(-2, 2) for f in sorted(features) if r.random() < 0.7}
    model = toxicity.Model(-0.3, weights)
    texts = ["", None, " \n", "_", *(r.choice((" ", ", ", "_", "\n")).join(r.choices([*words, *(w.upper() for w in words), "12"], k=r.randint(1, 80))) for _ in range(200))]
    for text in texts:
        held = {f for w in re.findall(r"[^\W_]+", (text or "").lower()) for f in (w + "$", *(w[:k] for k in (4, 5, 6, 7) if len(w) >= k))}
        z = -0.3 + sum(weights.get(f, 0.0) for f in held)
        assert model.score(text) == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-12)


class Blocks(html.parser.HTMLParser):
    """Text of a well-formed page, one entry a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.skip = [""], 0

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag not in htmltext.INLINE:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style")
        if tag not in htmltext.INLINE:
            self.blocks.append("")

    def handle_data(self, data):
        if not self.skip:
            self.blocks[-1] += data


def page(r, depth=0):
    out = ""
    for _ in range(r.randint(1, 4)):
        kind = r.random()
        if kind < 0.4 or depth > 5:
            out += r.choice(["word ", "a &amp; b", " &lt;p&gt; ", "it's ", 'said "x" ', "é&#233;&#xe9; ", "\n\t", "1 2 3", "a&nbsp;b"])
        elif kind < 0.5:
            out += r.choice(["<br>", "<!-- <p>no</p> -->", '<img alt="a > b">', "<hr/>", "<script>if (a < b) { x('<p>') }</script>"])
        else:
            tag = r.choice(["div", "section", "b", "i", "span", "a", "article", "h2", "td", "blockquote"])
            attrs = r.choice(["", ' class="post"', " id=x", " data-a='>' hidden", ' title="it\'s > 1"', " title=don't"])
            out += f"<{tag}{attrs}>{page(r, depth + 1)}</{tag}>"
    return out


def test_page_texts():
    """With all nodes kept, a page's text is what a parser of the standard library reads, block by block."""
    r = random.Random(5)
    for _ in range(400):
        source = f"<html><body>{page(r)}</body></html>".replace("<td", "<dd").replace("</td", "</dd")
        if source.count("<dd") > 1:  # which close one another
            continue
        plain = Blocks()
        plain.feed(source)
        plain.close()
        want = " ".join(filter(None, (re.sub(r"\s+", " ", b).strip() for b in plain.blocks)))
        own = htmltext.Page(source)
        kept = np.array([t not in htmltext.SKIPPED for t in own.tag])
        assert own.text(kept) == want, source
