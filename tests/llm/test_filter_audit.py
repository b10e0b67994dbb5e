"""The filter audit against plain Python over every order of filters."""

import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from fieldloom.llm import filteraudit


def brute(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic)."""
    fails = []
    for d, text, _ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (
            len(words) < 200,
            100 * len(set(words)) < 50 * len(words),
            100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            bool(re.search("[#$%&*|]", t)),
            d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs),
        )
        fails.append({x for x, f in zip("ABCDE", tests) if f})
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out, shapley = {}, {}
    for part in {s or "" for *_, s in docs}:
        rows = [(d, f) for (d, _, s), f in zip(docs, fails) if (s or "") == part]
        for order in permutations("ABCDE"):
            alive = rows
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in alive if x in f]
                kept = [(d, f) for d, f in alive if x not in f]
                failing = sum(x in f for _, f in rows)
                only = sum(f == {x} for _, f in rows)
                out[part, "".join(order), step] = [len(kept), len(gone), failing - len(gone), only, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
                alive = kept
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_popcount():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 7, 64, 1000):
        words = rng.integers(0, 2**32, n, dtype=np.uint32)
        want = [int(((words >> np.uint32(k)) & 1).sum()) for k in range(32)]
        assert filteraudit.positional_popcount(words).tolist() == want


def test_audit(spark, docs, odd_rows, prose):
    long = prose(250, 5)
    rows = [*odd_rows, (20, long, "en", "s"), (21, long, "en", "t"), (21, long, "en", "t"), (22, long.upper(), "en", "s"), (23, long + " #", "en", None),
            (24, "a b " * 300, "en", ""), (None, long, "en", "s"), (3, long, "en", "s"), (25, "É" * 300, "en", "s")]
    labels = [(20, 1, 0), (21, 1, 1), (22, None, 1), (2, 0, 1), (2, 1, 0), (None, 1, 1), (24, 1, 1)]
    table = docs(rows).withColumn("part", F.lit("p")).withColumn("kind", F.lit(9)).withColumn("word", F.create_map(F.lit(1), F.lit(2)))
    got = filteraudit.interactions(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("t")))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {tuple(r[:3]): tuple(r[3:]) for r in got.collect()}
    assert found == brute([(d, t, s) for d, t, _, s in rows], labels)


def test_empty(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.interactions(docs([]), none).count() == 0
    assert filteraudit.interactions(docs([(1, None, None, None)]), none).count() == 600
