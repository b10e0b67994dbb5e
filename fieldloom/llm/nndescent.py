"""Near-duplicate embeddings by NN-descent.

Equal vectors form one class first. A neighbour graph over the classes starts
from neighbours in the sort orders of a few random-hyperplane codes and is
refined in rounds: the neighbours of a node, forward and reverse, meet in a
local join, and every pair that betters a list goes into it. A list whose
members all reach the threshold is saturated and doubles for the next round,
up to ``MAX_LIST``. The audit compares every vector whose id is divisible by
``AUDIT_EVERY`` with all rows, block by block; rounds go on, with further
orders, until the graph holds enough of the audit's links. Links are the edges
that reach the threshold, in double precision.

Neighbours of neighbours may all lie in one dense group and never lead to another
that it links with: components in which a list was saturated are therefore
compared exactly with all rows, block by block, and only counts and the
components that links join are kept, so dense groups emit no pairs. Where links are too rare for the audit, or it is not content after
all rounds, or the finished counts hold under ``LEAST_RECALL`` of the links of
all audited vectors, saturated ones included, all rows are compared with all.
``report`` takes what the audit measured.

Cases: vectors that are null, zero, or hold null or non-finite components, and
rows with a null vec_id, link with nothing and are components of their own;
vectors of different lengths are never linked; very large and very small
vectors are scaled before their norm is taken; repeated rows are vectors of
their own; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common

THRESHOLD = 0.9
LIST, MAX_LIST, REVERSE = 12, 96, 12
ORDERS, BITS, REACH, FIRST = 6, 24, 12, 4
#: Audit vectors: ids divisible by this, and vectors that a driver or task holds at once.
AUDIT_EVERY, AUDIT_BLOCK = 20, 4096
#: Links that an audit must hold to be trusted, and the share of them that the graph must hold.
AUDIT_LINKS, RECALL, ROUNDS = 200, 0.98, 8
#: Share of the audit's links that the finished counts must hold.
LEAST_RECALL = 0.95
SEED = 5


def _normal(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of the rest neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    return _normal(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim))


def _pairs(src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"src": src.astype(np.int64), "dst": dst.astype(np.int64), "sim": sim.astype(np.float64)})


_EDGES = "src long, dst long, sim double"


def first_edges(nodes: DataFrame, dim: int, turn: int = 0) -> DataFrame:
    """Edges to the nearest of the neighbours in several sort orders, others in each ``turn``."""
    planes = np.random.default_rng([SEED, dim, turn] if turn else [SEED, dim]).standard_normal((ORDERS, dim, BITS))
    kind = nodes.schema["vec"].dataType.simpleString()

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _unit(b.column("vec"), dim)
                for k in range(ORDERS):
                    code = ((x @ planes[k] > 0) @ (1 << np.arange(BITS - 1, -1, -1))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(x), k, np.int32)), pa.array(code), b.column("id"), b.column("vec")],
                        ["k", "code", "id", "vec"],
                    )

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if n < 2:
                continue
            x, ids = _unit(b.column("vec"), dim), b.column("id").to_numpy()
            reach = min(REACH, n - 1)
            sims = np.full((n, 2 * reach), -2.0)
            at = np.zeros((n, 2 * reach), np.int64)
            rows = np.arange(n)
            for s in range(1, reach + 1):
                d = np.einsum("ij,ij->i", x[:-s], x[s:])
                d[ids[:-s] == ids[s:]] = -2.0
                sims[:-s, s - 1], at[:-s, s - 1] = d, rows[s:]
                sims[s:, reach + s - 1], at[s:, reach + s - 1] = d, rows[:-s]
            best = np.argsort(-sims, axis=1)[:, :FIRST]
            sim = np.take_along_axis(sims, best, 1).ravel()
            dst = ids[np.take_along_axis(at, best, 1).ravel()]
            src = np.repeat(ids, best.shape[1])
            yield _pairs(src[sim > -2], dst[sim > -2], sim[sim > -2])

    ordered = nodes.mapInArrow(codes, f"k int, code long, id long, vec {kind}")
    return (
        ordered.repartitionByRange("k", "code", "id").sortWithinPartitions("k", "code", "id").mapInArrow(near, _EDGES)
    )


def lists(edges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(src, size, near): of each node the best neighbours, at most ``size``."""
    best = edges.repartition("src").groupBy("src", "dst").agg(F.max("sim").alias("sim"))
    near = best.groupBy("src").agg(F.sort_array(F.collect_list(F.struct("sim", "dst")), asc=False).alias("near"))
    if sizes is None:
        near = near.withColumn("size", F.lit(LIST))
    else:
        near = near.join(sizes, "src", "left").withColumn("size", F.coalesce("size", F.lit(LIST)))
    return near.select("src", "size", F.slice("near", F.lit(1), F.col("size")).alias("near"))


def _worst(graph: DataFrame, threshold: float) -> DataFrame:
    """What an edge must better: the last of a full list, the threshold (less a
    little) for a list that has grown and is not full, else nothing."""
    full, grown = F.size("near") >= F.col("size"), F.col("size") > LIST
    last = F.when(full, F.element_at("near", -1)["sim"]).when(grown, F.lit(threshold - 1e-9)).otherwise(F.lit(-2.0))
    return graph.select("src", last.alias("worst"), (grown & ~full).alias("open"))


def _mixed(*parts: np.ndarray) -> np.ndarray:
    """A number from each combination of ids, the same in every run."""
    h = np.zeros((), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
    return (h >> np.uint64(11)).astype(np.float64) / 2.0**53


def better_edges(graph: DataFrame, nodes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Edges that better a list, from the local joins about each node: of each
    pair of members the best few. Of links for a list that has grown, a few
    chosen by hash, as about all nodes of a dense group the best would be the same."""
    forward = graph.select("src", F.explode("near").alias("e")).select("src", F.col("e.dst").alias("dst"), F.col("e.sim").alias("sim"))
    reverse = (
        forward.groupBy("dst")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("sim", "src")), asc=False), 1, REVERSE).alias("near"))
        .select(F.col("dst").alias("src"), F.explode("near").alias("e"))
        .select("src", F.col("e.src").alias("dst"))
    )
    itself = graph.select("src", F.col("src").alias("dst"))
    met = forward.select("src", "dst").unionAll(reverse).unionAll(itself).distinct()
    known = nodes.join(_worst(graph, threshold).withColumnRenamed("src", "id"), "id", "left").select(
        F.col("id").alias("dst"), F.coalesce("worst", F.lit(-2.0)).alias("worst"), F.coalesce("open", F.lit(False)).alias("open"), "vec"
    )
    tables = (
        met.join(known, "dst")
        .groupBy("src")
        .agg(
            F.collect_list("dst").alias("ids"),
            F.collect_list("worst").alias("worst"),
            F.collect_list("open").alias("open"),
            F.flatten(F.collect_list("vec")).alias("vecs"),
        )
    )

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.diff(b.column("ids").offsets.to_numpy())
            if not len(sizes):
                continue
            centre, ids, worst = b.column("src").to_numpy(), b.column("ids").flatten().to_numpy(), b.column("worst").flatten().to_numpy()
            grown = b.column("open").flatten().to_numpy(zero_copy_only=False)
            x = _unit(b.column("vecs"), dim)
            starts = np.cumsum(sizes) - sizes
            for m in np.unique(sizes):
                if m < 2:
                    continue
                own = np.flatnonzero(sizes == m)
                for k in np.array_split(own, -(-len(own) * m * m // 2_000_000)):
                    part = starts[k][:, None] + np.arange(m)
                    y = x[part]
                    sim = y @ y.transpose(0, 2, 1)
                    sim[:, np.arange(m), np.arange(m)] = -2.0
                    sim[sim <= worst[part][:, :, None]] = -2.0
                    rank = sim
                    if grown[part].any():
                        drawn = _mixed(centre[k][:, None, None], ids[part][:, :, None], ids[part][:, None, :])
                        rank = np.where(grown[part][:, :, None] & (sim > -2), drawn, sim)
                    best = np.argsort(-rank, axis=2)[:, :, :FIRST]
                    value = np.take_along_axis(sim, best, 2)
                    src = np.broadcast_to(ids[part][:, :, None], value.shape)
                    dst = np.take_along_axis(np.broadcast_to(ids[part][:, None, :], sim.shape), best, 2)
                    keep = value > -2
                    yield _pairs(src[keep], dst[keep], value[keep])

    return tables.mapInArrow(join, _EDGES)


def _flat(graph: DataFrame) -> DataFrame:
    return graph.select("src", F.explode("near").alias("e")).select("src", F.col("e.dst").alias("dst"), F.col("e.sim").alias("sim"))


def _saturated(threshold: float) -> Column:
    """Whether a list is full of links: it may lack others."""
    return F.size(F.filter("near", lambda e: e["sim"] >= threshold)) >= F.col("size")


def _dense(threshold: float) -> Column:
    """Whether a vector has as many links as a list has places at first."""
    return F.size(F.filter("near", lambda e: e["sim"] >= threshold)) >= LIST


def _grown(graph: DataFrame, threshold: float) -> DataFrame:
    """List sizes for the next round: a saturated list doubles."""
    return graph.select("src", F.when(_saturated(threshold), F.least(F.col("size") * 2, F.lit(MAX_LIST))).otherwise(F.col("size")).alias("size"))


def audit(nodes: DataFrame, dim: int, threshold: float) -> DataFrame | None:
    """(src, n, links): exact numbers of linked classes and of linked vectors of
    audit vectors, each compared with all rows of ``nodes`` (id, weight, vec).

    These are all whose id is divisible by ``AUDIT_EVERY``. Where they hold fewer
    than ``AUDIT_LINKS`` links, others chosen by hash join them, up to an eighth
    of the rows; where these do not hold them either, links are too rare to
    judge a graph by and the result is None."""
    spark = nodes.sparkSession
    total = nodes.count()
    others = max(1, -(-total // AUDIT_BLOCK))
    first = F.pmod("id", F.lit(AUDIT_EVERY)) == 0
    turn = F.pmod(F.xxhash64("id"), F.lit(others))
    blocks = [nodes.where(first & (turn == k)) for k in range(others)]  # a twentieth of a block each
    step = AUDIT_EVERY
    parts = [blocks[k : k + step] for k in range(0, others, step)]
    more = [nodes.where(~first & (turn == k)) for k in range(-(-others // 8))]
    done: list[DataFrame] = []
    links = 0
    for k, chosen in enumerate([*(_union(p) for p in parts), *more]):
        if k >= len(parts) and links >= AUDIT_LINKS:
            break
        counted = common.cut(_counted(nodes, chosen.collect(), dim, threshold))
        links += counted.agg(F.sum("n")).first()[0] or 0
        done.append(counted)
    if links < AUDIT_LINKS:
        return None
    return _union(done)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _counted(nodes: DataFrame, chosen: list, dim: int, threshold: float) -> DataFrame:
    """(src, n, links) of the chosen rows, at most about ``AUDIT_BLOCK``, against all."""
    ids = np.array([r["id"] for r in chosen], np.int64)
    queries = _normal(np.array([r["vec"] for r in chosen], np.float64).reshape(-1, dim)) if chosen else np.zeros((0, dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, links = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for b in batches:
            if b.num_rows:
                own, x, weight = b.column("id").to_numpy(), _unit(b.column("vec"), dim), b.column("weight").to_numpy()
                for at in np.array_split(np.arange(len(own)), len(own) * max(1, len(ids)) // 4_000_000 + 1):
                    linked = (x[at] @ queries.T >= threshold) & (own[at][:, None] != ids[None, :])
                    n += linked.sum(0)
                    links += weight[at] @ linked
        yield pa.RecordBatch.from_pydict({"src": ids[n > 0], "n": n[n > 0], "links": links[n > 0]})

    rows = nodes.select("id", "weight", "vec").mapInArrow(run, "src long, n long, links long")
    return rows.groupBy("src").agg(F.sum("n").alias("n"), F.sum("links").alias("links"))


def recall(graph: DataFrame, truth: DataFrame, threshold: float) -> float:
    """Share of the audit's links that lists hold. Dense vectors are left out
    here: they are compared exactly, and audited at the end."""
    full = graph.where(_dense(threshold)).select("src")
    edges = _flat(graph).where(F.col("sim") >= threshold).select("src", "dst")
    both = edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    held = both.join(truth.select("src"), "src", "left_semi").distinct().groupBy("src").agg(F.count(F.lit(1)).alias("held"))
    row = (
        truth.join(full, "src", "left_anti")
        .join(held, "src", "left")
        .agg(F.sum("n").alias("n"), F.sum(F.least("n", F.coalesce("held", F.lit(0)))).alias("held"))
        .first()
    )
    return row["held"] / row["n"] if row["n"] else 1.0


def neighbour_graph(nodes: DataFrame, dim: int, threshold: float, truth: DataFrame) -> DataFrame | None:
    """(src, size, near) over ``nodes`` (id, vec), refined until the audit is
    content and no saturated list can grow; None where it is not content after all rounds."""
    graph = common.cut(lists(first_edges(nodes, dim)))
    content = False
    for k in range(ROUNDS):
        more = better_edges(graph, nodes, dim, threshold)
        if k > 1 and not content:  # other orders too
            more = more.unionAll(first_edges(nodes, dim, k))
        graph = common.cut(lists(_flat(graph).unionAll(more), _grown(graph, threshold)), replaces=graph)
        content = k > 0 and recall(graph, truth, threshold) >= RECALL
        if content and graph.where(_saturated(threshold) & (F.col("size") < MAX_LIST)).isEmpty():
            break
    return graph if content else None


def _compared(own: DataFrame, dim: int, threshold: float, n: int, wanted: int) -> DataFrame:
    """Compares the ``wanted`` rows marked dense with all ``n`` rows of ``own``
    (id, weight, vec, component, dense), block by block. Rows are either (id,
    links), to be added up: all links of a dense vector, and of any other its
    links to dense vectors; or (a, b): components that a link joins."""
    block = min(max(-(-n // 16), 256), 8192)
    across, down = -(-wanted // block), -(-n // block)
    place = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    rest = ["id", "weight", "vec", "component", "dense"]
    asked = own.where("dense").select(place(across).alias("i"), every(down).alias("j"), F.lit(True).alias("asks"), *rest)
    all_rows = own.select(every(across).alias("i"), place(down).alias("j"), F.lit(False).alias("asks"), *rest)

    def run(table: pa.Table) -> pa.Table:
        ids, weight, asks, dense = (table.column(c).to_numpy() for c in ("id", "weight", "asks", "dense"))
        names, label = np.unique(table.column("component").to_numpy(), return_inverse=True)
        x = _unit(table.column("vec").combine_chunks(), dim)
        a, b = np.flatnonzero(asks), np.flatnonzero(~asks)
        count = np.zeros(len(ids), np.int64)
        joined = []
        for part in np.array_split(a, len(a) * len(b) // 4_000_000 + 1):
            linked = x[part] @ x[b].T >= threshold
            linked &= ids[part][:, None] != ids[b][None, :]
            count[part] = linked @ weight[b]
            count[b] += weight[part] @ linked
            rows = np.flatnonzero(count[part])
            while len(rows):  # links between components, until there is none
                cross = linked[rows] & (label[part[rows]][:, None] != label[b][None, :])
                at = cross.any(1)
                rows, first = rows[at], cross[at].argmax(1)
                for r, c in zip(part[rows], b[first]):
                    if label[r] != label[c]:
                        joined.append((names[label[r]], names[label[c]]))
                        label[label == label[r]] = label[c]
        count[b[dense[b]]] = 0  # counted where they ask
        some = count > 0
        empty = [None] * len(joined)
        return pa.table(
            {
                "id": pa.array([*ids[some].tolist(), *empty], pa.int64()),
                "links": pa.array([*count[some].tolist(), *empty], pa.int64()),
                "a": pa.array([*[None] * int(some.sum()), *(int(p) for p, _ in joined)], pa.int64()),
                "b": pa.array([*[None] * int(some.sum()), *(int(q) for _, q in joined)], pa.int64()),
            }
        )

    return asked.unionAll(all_rows).groupBy("i", "j").applyInArrow(run, "id long, links long, a long, b long")


def near_duplicates(
    vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", report: dict | None = None
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id and kept. ``report``
    is given, by length of vectors, (share of the audit's links that the graph
    way held, number of these links, whether all rows were compared with all)."""
    report = {} if report is None else report
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists(vec, lambda v: v != 0) & F.col(id_col).isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(usable, vec).alias("vec"))
    rows = rows.withColumn("key", F.xxhash64("vec"))
    classes = common.cut(
        rows.where("vec is not null")
        .groupBy("key", "vec")
        .agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("weight"))
    )
    found = None
    for r in classes.select(F.size("vec").alias("dim")).distinct().collect():  # as many as lengths of vectors
        part = _components(classes.where(F.size("vec") == r["dim"]), r["dim"], threshold, report)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = classes.select("key", "vec", "weight", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    named = rows.join(found, ["key", "vec"], "left")
    return named.select(
        "vec_id",
        F.coalesce(F.col("links") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("component") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _components(classes: DataFrame, dim: int, threshold: float, report: dict) -> DataFrame:
    """(key, vec, weight, links, component) of the classes, by the graph where the
    audit is content with its result, else by comparing all with all."""
    nodes = classes.select("id", "weight", "vec")
    truth = audit(nodes, dim, threshold)
    graph = neighbour_graph(nodes, dim, threshold, truth) if truth is not None else None
    report[dim] = (0.0, 0, True)
    if graph is not None:
        found = common.cut(_by_graph(classes, graph, dim, threshold))
        row = truth.join(found.select(F.col("id").alias("src"), F.col("links").alias("found")), "src").agg(
            F.sum("links").alias("links"), F.sum(F.least("links", "found")).alias("found")
        ).first()
        share = row["found"] / row["links"]
        report[dim] = (share, row["links"], share < LEAST_RECALL)
        if share >= LEAST_RECALL:
            return found.drop("id")
    own = common.cut(classes.withColumns({"component": F.col("id"), "dense": F.lit(True), "listed": F.lit(0).cast("long")}))
    return _exact(own, dim, threshold).drop("id")


def _by_graph(classes: DataFrame, graph: DataFrame, dim: int, threshold: float) -> DataFrame:
    linked = _flat(graph).where(F.col("sim") >= threshold).select("src", "dst")
    both = linked.unionAll(linked.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    parts = common.components(linked.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    dense = graph.where(_dense(threshold)).join(parts.withColumnRenamed("node", "src"), "src").select("component").distinct()
    own = classes.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    own = own.join(dense.withColumn("dense", F.lit(True)), "component", "left").withColumn("dense", F.coalesce("dense", F.lit(False)))
    # a listed link never leaves its component, so those of the others lead to no dense vector
    listed = both.join(classes.select(F.col("id").alias("dst"), "weight"), "dst").groupBy("src").agg(F.sum("weight").alias("listed"))
    own = own.join(listed.withColumnRenamed("src", "id"), "id", "left")
    own = own.withColumn("listed", F.when(F.col("dense"), F.lit(0).cast("long")).otherwise(F.coalesce("listed", F.lit(0).cast("long"))))
    return _exact(common.cut(own), dim, threshold)


def _exact(own: DataFrame, dim: int, threshold: float) -> DataFrame:
    """``own`` with the links and components of its dense vectors compared with all rows."""
    size = own.agg(F.count(F.lit(1)).alias("n"), F.count_if("dense").alias("dense")).first()
    if not size["dense"]:
        return own.select("id", "key", "vec", "weight", F.col("listed").alias("links"), "component")
    compared = common.cut(_compared(own, dim, threshold, size["n"], size["dense"]))
    exact = compared.where("id is not null").groupBy("id").agg(F.sum("links").alias("links"))
    joined = common.components(compared.where("a is not null").select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return (
        own.join(exact, "id", "left")
        .join(joined, "component", "left")
        .select("id", "key", "vec", "weight", (F.col("listed") + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("whole", "component").alias("component"))
    )


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding :: DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT a, b FROM l UNION SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (
  SELECT a AS vec_id, least(a, min(b)) AS component_id FROM reach GROUP BY a
), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n_links, 0) :: BIGINT AS n_links, coalesce(component_id, e.vec_id) AS component_id,
       coalesce(component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
