"""Pages and embeddings against exact results."""

import html
import re
import time
from collections import Counter

import numpy as np
import pytest

from fieldloom.llm import common, htmltext, nndescent


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    inner = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inner)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", inner)).split())


def test_main_text(spark, folder):
    pages = common.table(spark, folder.replace("0.001", "0.01"), "pages")
    model = htmltext.fit(pages, 60)
    got = {r["page_id"]: r for r in htmltext.main_text(pages, model).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    right = sum(" ".join(got[r["page_id"]]["text"].split()) == article(r["html"]) for r in rows)
    assert right >= 0.97 * len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    odd = [(1, None, None), (2, "u", ""), (3, "u", "plain &amp; text"), (4, "u", "<p>open<p>next <b>x"), (5, "u", "</div></p>stray"), (5, "u", "</div></p>stray"), (None, None, "<script>1<2</script>"), (6, "u", "<p>" + "long words " * 20_000)]
    table = spark.createDataFrame(odd, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    texts = Counter((r["page_id"], r["text"]) for r in htmltext.main_text(table, model).collect())
    assert texts[(1, "")] == texts[(2, "")] == 1 and texts[(3, "plain & text")] == 1 and texts[(None, "")] == 1
    assert sum(texts.values()) == len(odd)
    assert htmltext.main_text(table.limit(0), model).count() == 0
    assert htmltext.fit(table.limit(0)) is None


def test_pages_without_semantic_tags():
    body = " ".join(f"<p>Sentence {k} of a long story, told with care and in order.</p>" for k in range(12))
    wrap = lambda main: f"<html><head><title>t</title></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>{main}<footer>&copy; x</footer></body></html>"
    model = htmltext.train([wrap(f"<article><h1>Title {k}</h1>{body}</article>") for k in range(40)])
    page = wrap(f'<div class="content"><h1>Title</h1>{body}<div class="comments"><div class="comment"><p>first!</p></div></div></div><div id="cookie-notice"><p>We use cookies</p></div>')
    (text,) = htmltext.extract([page], model)
    assert "long story" in text and "first!" not in text and "cookies" not in text and "Home" not in text


def test_pages_whose_tags_tell_nothing(spark, folder):
    """Without semantic tags and attributes the article stays and link blocks go."""
    pages = [r["html"] for r in common.table(spark, folder.replace("0.001", "0.01"), "pages").collect()]
    model = htmltext.train(pages[:60])
    right = 0
    for page in pages[60:160]:
        (text,) = htmltext.extract([htmltext.masked(page)], model)
        right += sum(w in text.split() for w in article(page).split()) >= 0.95 * len(article(page).split()) and len(text) <= 1.1 * len(article(page))
    assert right >= 90
    links = "<div><a href=/a>alpha</a> <a href=/b>beta</a> <a href=/c>gamma</a></div>"
    story = "".join(f"<p>Sentence {k} of a long story, told with care and in order, as it was.</p>" for k in range(8))
    (text,) = htmltext.extract([f"<html><body>{links}<div><h1>Title</h1>{story}</div>{links}</body></html>"], model)
    assert "long story" in text and not {"alpha", "beta", "gamma"} & set(text.split())


def test_deep_pages_take_linear_time():
    began = time.monotonic()
    for unit in ("<div>", "<div><li>", "<b>", "<ul><li>", "<td>"):
        page = htmltext.Page(unit * 30_000 + "x" + "</i></p></head>" * 10_000)
        assert len(page.tag) > 30_000
    assert time.monotonic() - began < 30


def body(source):
    return htmltext.extract([source], None)[0]


def test_tags_end_where_html_says():
    main = lambda inside: body(f"<main>{inside}</main>")
    assert main("<p title=don't>Hello brave world, it's me</p><p>Second</p>") == "Hello brave world, it's me Second"
    assert main('<p title="a > b">one</p><p title=\'<p>\'>two</p>') == "one two"
    assert main("<p a='it\"s' b=\"it's\" c>one</p><p a = x/y / >two</p>") == "one two"
    assert main('<p " \' x>one</p><p a=">two</p>three') == "one two three"
    assert main("1 < 2 <b>and</b> 3 <4 </ 5 <é>") == "1 < 2 and 3 <4 </ 5 <é>"
    assert main("a<!-- <p> > -->b<!x>c<?y>d<!--") == "abcd"
    assert htmltext.Page('<div data-class="menu" CLASS=post id=\'Side-bar\'>').tokens[1] == ("post", "side", "bar")
    assert main("&#65;&#0000000000000000065;&#x41;&#" + "9" * 9000 + ";&#" + "0" * 9000 + "66;x") == "AAA\ufffdBx"


def test_items_far_above():
    """An item without an end tag ends at the next one, however deep it is."""
    for deep in (1, 100, 300, 5000):
        page = htmltext.Page("<ul><li>" + "<b>" * deep + "one<li>two<ul><li>in</ul><li>three</ul>")
        items = [i for i, t in enumerate(page.tag) if t == "li"]
        assert [page.tag[page.parent[i]] for i in items] == ["ul"] * 4
        assert [page.parent[i] for i in items].count(1) == 3


@pytest.mark.parametrize(
    "piece",
    ["<a", "<a ", "<a>", "</a>", "<", "<!", "<!--", "<a x='", '<a x="', "<a x=\">", "x=\">\" y='<a ' ", "<p><b>", "<div></div>", "<li><b>", "<td>", "<style>", "<a/", "<a =", "&#1", "&"],
)
def test_odd_pages_take_linear_time(piece):
    for begin, end in (("", ""), ("<a ", '"'), ("<p>" + "<b>" * 50_000, ">"), ("<a x='", "")):
        began = time.time()
        page = htmltext.Page(begin + piece * (500_000 // len(piece)) + end)
        page.text(np.ones(len(page.tag), bool))
        assert time.time() - began < 10


def test_decoding_keeps_only_below_kept():
    page = htmltext.Page("<div><p>a</p><section><p>b</p></section></div>")
    odds = np.array([0, -3, 5, -4, 1.0])
    kept = page.decode(odds)
    assert all(kept[page.parent[i]] for i in range(1, len(kept)) if kept[i])
    assert kept.tolist() == [True, True, True, False, False]


def near_vectors(rng):
    base = rng.normal(size=(120, 24))
    rows = [b + rng.normal(size=24) * s for b in base[:30] for s in (0, 0.1, 0.12)]
    cluster = [base[40] + rng.normal(size=24) * 0.08 for _ in range(70)]
    return np.array([*base, *rows, *cluster], np.float32)


def test_embeddings(spark):
    x = near_vectors(np.random.default_rng(8))
    rows = [(i * 3, v.tolist()) for i, v in enumerate(x)]
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [1.0, None]), (9005, []), (9006, [1.0, 2.0]), (9007, [2.0, 4.0]), (None, [1.0] * 24), (9008, x[5].tolist()), (9008, x[5].tolist())]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>").selectExpr("*", "1 AS key", "2 AS vec", "3 AS id", "4 AS links")
    got = nndescent.near_duplicates(table).collect()
    assert len(got) == len(rows) + len(odd)
    usable = [(i, v) for i, v in [*rows, *odd[5:7], *odd[8:]]]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) for _, v in usable]
    linked = lambda a, b: len(a) == len(b) and float(a @ b) >= 0.9
    n = Counter()
    part = list(range(len(usable)))
    for i in range(len(usable)):
        for j in range(i):
            if linked(unit[i], unit[j]):
                n[i] += 1
                n[j] += 1
                a, b = part[i], part[j]
                part = [min(a, b) if p in (a, b) else p for p in part]
    low = {}
    for p, (i, _) in zip(part, usable):
        low[p] = min(low.get(p, i), i)
    want = Counter((i, n[k], low[part[k]], i == low[part[k]]) for k, (i, _) in enumerate(usable))
    for i, _ in odd[:5]:
        want[(i, 0, i, True)] += 1
    want[(None, 0, None, True)] += 1
    assert Counter(tuple(r) for r in got) == want
    assert nndescent.near_duplicates(table.limit(0)).count() == 0


def brute_force(x, threshold=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(linked, low[None, :], len(x)).min(1))
        if (new == low).all():
            return [(i, int(linked[i].sum()), int(low[i]), int(low[i]) == i) for i in range(len(x))]
        low = new


def clumps_and_pairs(rng, pairs):
    """Two clumps of 40 that all link with each other, and isolated pairs among single vectors, of 64 dimensions."""
    a, b = np.linalg.qr(rng.normal(size=(64, 2)))[0].T
    clumps = [c + rng.normal(size=(40, 64)) * 0.008 for c in (a, 0.935 * a + np.sqrt(1 - 0.935**2) * b)]
    single = rng.normal(size=(1500, 64))
    return np.array([*clumps[0], *clumps[1], *single, *(single[:pairs] + rng.normal(size=(pairs, 64)) * 0.38)], np.float32).astype(float)


def table_of(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_linked_clumps(spark, monkeypatch):
    """With the graph of everyone's true 24 best no list leads from clump to clump."""
    x = clumps_and_pairs(np.random.default_rng(5), 0)[:400]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T - 3 * np.eye(len(x))
    best = np.argsort(-sims, axis=1)[:, :24]
    near = [(i, 24, [(float(sims[i, j]), int(j)) for j in row]) for i, row in enumerate(best)]
    graph = spark.createDataFrame(near, "src long, size int, near array<struct<sim: double, dst: long>>")
    monkeypatch.setattr(nndescent, "neighbour_graph", lambda *a: graph)
    report = {}
    assert sorted(map(tuple, nndescent.near_duplicates(table_of(spark, x), report=report).collect())) == brute_force(x)
    assert report[64][0] == 1.0 and report[64][1] >= 200 and not report[64][2]


def test_grown_lists(spark):
    """Saturated lists double until they hold the links of their vectors."""
    x = np.concatenate([clumps_and_pairs(np.random.default_rng(6), 0)[:40], np.random.default_rng(7).normal(size=(600, 64))]).astype(np.float32).astype(float)
    nodes = table_of(spark, x).selectExpr("vec_id id", "1L weight", "embedding vec")
    truth = spark.createDataFrame([(i, 39, 39) for i in range(0, 40, 20)], "src long, n long, links long")
    graph = {r["src"]: r for r in nndescent.neighbour_graph(nodes, 64, 0.9, truth).collect()}
    assert all(graph[i]["size"] == 48 for i in range(40)) and all(graph[i]["size"] == 12 for i in range(40, 640))
    held = {(i, e["dst"]) for i in range(40) for e in graph[i]["near"] if e["sim"] >= 0.9}
    assert len(held | {(b, a) for a, b in held}) >= 0.98 * 40 * 39


def test_rare_links(spark, monkeypatch):
    x = clumps_and_pairs(np.random.default_rng(3), 20)[80:]  # too few links for an audit
    report = {}
    assert sorted(map(tuple, nndescent.near_duplicates(table_of(spark, x), report=report).collect())) == brute_force(x)
    assert report[64][2]


def test_low_recall(spark, monkeypatch):
    """A search that finds too little ends in the exact comparison of all rows."""
    x = clumps_and_pairs(np.random.default_rng(4), 1200)
    want = brute_force(x)
    monkeypatch.setattr(nndescent, "RECALL", 1.01)  # the graph's audit is never content
    monkeypatch.setattr(nndescent, "ROUNDS", 2)
    report = {}
    assert sorted(map(tuple, nndescent.near_duplicates(table_of(spark, x), report=report).collect())) == want
    assert report == {64: (0.0, 0, True)}
    # a graph that passes with half of the edges is caught by the audit of the finished counts
    whole = nndescent.neighbour_graph
    monkeypatch.setattr(nndescent, "RECALL", 0.0)
    monkeypatch.setattr(nndescent, "neighbour_graph", lambda *a: whole(*a).where("src % 3 = 0"))
    assert sorted(map(tuple, nndescent.near_duplicates(table_of(spark, x), report=report).collect())) == want
    share, links, exact = report[64]
    assert share < nndescent.LEAST_RECALL and links >= 200 and exact


def test_very_large_and_small_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate((v, s) for v in base for s in (1e-200, 1.0, 1e200))]
    got = nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, got)) == brute_force(np.array([np.array(v) / np.abs(v).max() for _, v in rows]))
