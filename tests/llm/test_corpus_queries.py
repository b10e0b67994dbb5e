"""The registered queries and the pipeline over whole small tables."""

from collections import Counter

import corpus_pipeline
import pytest
from compare import rows

import __spark_entry__
from fieldloom.llm import common, decontaminate, mixing, queries, simhash, tokenpack, toxicity


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, folder, name):
    got = queries.QUERIES[name](spark, folder).toPandas()
    if name in queries.ORACLES:
        assert rows(got) == rows(duck.sql(queries.ORACLES[name]).df())
    elif name not in ("op2_suffix_dedup", "op11_conversation_repair"):
        table = "pages" if name.startswith("op5") else "documents"
        assert len(got) == common.table(spark, folder, table).count()


def test_entry_lists_all():
    assert {*queries.QUERIES, "pipeline"} <= set(__spark_entry__.queries())


def test_pipeline(spark, folder):
    """Each stage's result follows from its input, by plain Python."""
    docs = common.table(spark, folder, "documents")
    model = toxicity.fit(docs, common.table(spark, folder, "labels"))
    items = decontaminate.build([tuple(r) for r in common.table(spark, folder, "benchmark").select("item_id", "text").collect()])
    now, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        path = common.scratch_path(spark, f"test-{name}")
        stage(spark, now, folder).write.parquet(path)
        seen.append(now.collect())
        now = spark.read.parquet(path)
        if name != "token_packing":
            assert now.columns == docs.columns
    seen.append(now.collect())
    ids = lambda part: [r["doc_id"] for r in part]
    start, clean, single, free, mix, packed = seen
    assert Counter(ids(clean)) == Counter(r["doc_id"] for r in start if model.score(r["text"]) < 0.5)
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in clean}
    kept = []
    groups: dict[int, int] = {}
    for d in sorted(prints):  # single linkage by plain search
        groups[d] = d
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if groups[a] < groups[b] and (prints[a] ^ prints[b]).bit_count() <= 4:
                    groups[b], changed = groups[a], True
    kept = [d for d in prints if groups[d] == d]
    assert Counter(ids(single)) == Counter(kept)
    assert Counter(ids(free)) == Counter(r["doc_id"] for r in single if not any(decontaminate.hits(decontaminate.words(r["text"]), items)[0]))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.createDataFrame(free, docs.schema)).collect()}
    assert Counter(ids(mix)) == +Counter(copies)
    assert Counter(ids(packed)) == Counter(ids(mix))
    own = tokenpack.encoder(corpus_pipeline.public_tokenizers.path("word_bpe_49k.json"))
    length = {r["doc_id"]: len(own.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in mix}
    at = 0
    for r in sorted(packed, key=lambda r: r["start"]):
        assert (r["start"], r["n_tokens"]) == (at, length[r["doc_id"]])
        at += r["n_tokens"]


def test_near_dedup_keeps_unrelated_texts_of_one_id(spark, docs, prose):
    a, b, c = prose(200, 41), prose(200, 42), prose(200, 43)
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (1, b, "en", "r"), (2, b, "en", "s"), (3, c, "en", "s"), (4, c, "en", "s"), (None, c, "en", "s")]
    table = docs(rows)
    got = corpus_pipeline.near_dedup(spark, table, "")
    assert got.columns == table.columns
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect()) == Counter([(1, a, "s"), (1, b, "r"), (3, c, "s"), (None, c, "s")])


CLASHING = {"kept_id": "1", "kept_hash": "2L", "row": "'r'", "hit_id": "3L", "hit_hash": "4L", "_salt": "'s'", "_copy": "5", "size": "7",
            "copies": "0", "taken": "'t'", "target": "1.5D", "_row": "6", "items": "array(1)", "text_hash": "'h'", "fp": "9L", "m": "map('a', doc_id)", "a.b": "8"}


def test_stages_keep_clashing_columns(spark, docs, prose):
    table = docs([(i, prose(60 + i, i % 7), "en", "s" if i % 3 else None) for i in range(30)] + [(None, prose(50, 99), "en", "s")])
    table = table.selectExpr("doc_id", "text", "lang", "source", "n_chars", *[f"{v} AS `{k}`" for k, v in CLASHING.items()])
    items = spark.createDataFrame([(k, prose(40, 1 if k == 3 else 200 + k)) for k in range(30)], "item_id long, text string")
    plain = lambda rows: sorted(str({k: v for k, v in r.asDict().items()}) for r in rows)
    given = plain(table.collect())
    for stage in (
        lambda d: corpus_pipeline.near_dedup(spark, d, ""),
        lambda d: decontaminate.clean(d, items),
        lambda d: decontaminate.clean(d, items, block_chars=2000),
        mixing.sample,
    ):
        got = stage(table)
        assert got.columns == table.columns
        rows = plain(got.collect())
        assert rows and set(rows) <= set(given)
    assert plain(decontaminate.clean(table, items).collect()) == plain(decontaminate.clean(table, items, block_chars=2000).collect())


def test_the_mix_does_not_depend_on_partitions(spark, docs, prose):
    table = docs([(1, prose(30, i), "en", "a") for i in range(40)] + [(2, prose(30, 5), "en", "b")] * 60)
    taken = [Counter((r["doc_id"], r["text"]) for r in mixing.sample(table.repartition(n)).collect()) for n in (1, 3, 7)]
    assert taken[0] == taken[1] == taken[2]
    assert 0 < sum(v for (d, _), v in taken[0].items() if d == 1)


def test_pipeline_broadcasts_no_variants(spark, docs, prose, monkeypatch):
    """What near_dedup links is joined by shuffles, however few the texts are."""
    seen, whole = [], common.components
    monkeypatch.setattr(common, "components", lambda edges: seen.append(edges._jdf.queryExecution().executedPlan().toString()) or whole(edges))
    rows = docs([(1, prose(80, 1), "en", "s"), (2, prose(80, 1), "en", "s"), (3, prose(80, 2), "en", "s")])
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, rows, "").collect()) == [1, 3]
    assert len(seen) == 1 and "Broadcast" not in seen[0]
