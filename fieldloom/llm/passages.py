"""Passages that repeat across documents, by a sparse suffix array.

A passage is a run of at least ``LENGTH`` words. Of all suffixes only those at
minimisers are retained: in every window of ``LENGTH`` words the place of the
``GRAM`` words with the least hash, which equal windows share wherever they
stand. The retained suffixes, (document, position), are sorted by their first
``GRAM`` words, and neighbours are compared by these words; a suffix that
begins like its neighbour from another document is a seed. Around the seeds
matches are extended left and right: the windows about a seed are hashed
whole, equal runs of windows are matched at once and the rest window by
window, always among suffixes that begin with the same words, and windows that
occur in another document join into maximal spans.

Words are separated by ASCII white space, A-Z in lower case. Hashes are
polynomial over the bytes, 64 bits wide.

Cases: null, blank and short texts have no passage; repeats inside one
document, or between rows of one doc_id, do not count; rows with a null doc_id
are left out; copies are matched through one representative; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm import common

LENGTH, GRAM = 50, 16
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(11).integers(1, _MASK, 256, np.uint64, endpoint=True)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """Hashes of the word ranges of one text, each in constant time."""

    def __init__(self, text: str | None):
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        self.n = len(words)
        self.line = b" ".join(words) + b" "
        line = np.frombuffer(self.line, np.uint8)
        powers, self.inverse = _powers(len(line) + 1)
        self.sums = np.zeros(len(line) + 1, np.uint64)
        np.cumsum(_VALUES[line] * powers[:-1], out=self.sums[1:])
        self.starts = np.concatenate(([0], np.flatnonzero(line == 32) + 1)) if self.n else np.zeros(1, np.int64)

    def ranges(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Hashes of words ``first`` to ``last``, the latter excluded."""
        a, b = self.starts[first], self.starts[last]
        return _mixed((self.sums[b] - self.sums[a]) * self.inverse[a])

    def grams(self, size: int) -> np.ndarray:
        k = np.arange(max(0, self.n - size + 1))
        return self.ranges(k, k + size)

    def minimisers(self, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """For every window of ``length`` words the least hash of its grams, and where it first stands."""
        least, width = self.grams(gram), length - gram + 1
        if len(least) < width:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at, done = np.arange(len(least)), 1
        while done < width:
            step = min(done, width - done)
            later = least[step:] < least[:-step]
            at = np.where(later, at[step:], at[:-step])
            least = np.where(later, least[step:], least[:-step])
            done += step
        return least, at

    def words(self, first: int, last: int) -> bytes:
        return self.line[self.starts[first] : self.starts[last] - 1]


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(values)]))


def suffixes(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(lead, key, doc_id, position): the retained suffixes of each document with
    their first words and these words' hash; of suffixes that begin alike the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leads, keys, ids, places = [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                h = Hasher(text.as_py())
                least, at = h.minimisers(length, gram)
                own, first = np.unique(least, return_index=True)
                keys.append(own)
                places.append(at[first])
                leads += [h.words(p, p + gram) for p in at[first].tolist()]
                ids.append(np.full(len(own), doc_id, np.int64))
            yield pa.RecordBatch.from_pydict(
                {
                    "lead": pa.array(leads, pa.binary()), "key": np.concatenate(keys).view(np.int64), "doc_id": np.concatenate(ids),
                    "position": np.concatenate(places).astype(np.int32),
                }
            )

    return docs.mapInArrow(run, "lead binary, key long, doc_id long, position int")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a sorted part: suffixes that begin like a neighbour of another
    document, and, as edge, the first and the last suffix of the part.

    Of one document's suffixes that begin alike the first counts. One suffix is
    held back until its next neighbour is known, however many begin alike."""
    names = ["lead", "key", "doc_id", "position"]
    held, sure_held, first = None, False, True

    def out(t: pa.Table, sure: np.ndarray, edge: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = pa.array(sure | edge)
        found = t.append_column("sure", pa.array(sure)).append_column("edge", pa.array(edge)).filter(keep)
        yield from found.combine_chunks().to_batches()

    for b in batches:
        t = pa.Table.from_batches([b]).select(names)
        t = (t if held is None else pa.concat_tables([held, t])).combine_chunks()
        if not t.num_rows:
            continue
        alike = lambda t: pc.equal(t["lead"].slice(1), t["lead"].slice(0, t.num_rows - 1)).to_numpy()
        doc = t["doc_id"].to_numpy()
        again = np.concatenate(([False], alike(t) & (doc[1:] == doc[:-1])))
        t = t.filter(pa.array(~again)).combine_chunks()
        same = alike(t)
        sure = np.concatenate(([sure_held], same)) | np.concatenate((same, [False]))
        edge = np.zeros(t.num_rows, bool)
        edge[0] = first
        if t.num_rows > 1:
            yield from out(t.slice(0, t.num_rows - 1), sure[:-1], edge[:-1])
            first = False
        held, sure_held = t.slice(t.num_rows - 1), bool(sure[-1])
    if held is not None:
        yield from out(held, np.array([sure_held]), np.array([True]))


def seeds(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, doc_id, position) of the suffixes that another document's neighbour begins like."""
    every = common.cut(suffixes(docs, length, gram))  # sorting reads them twice
    order = ["lead", "doc_id", "position"]
    ordered = every.repartitionByRange(*order).sortWithinPartitions(*order)
    near = ordered.mapInArrow(_neighbours, "lead binary, key long, doc_id long, position int, sure boolean, edge boolean")
    near = common.cut(near, replaces=every)
    # suffixes that begin alike may lie on both sides of a cut between parts: at most two edges a part
    across = (
        near.where("edge")
        .groupBy("lead")
        .agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        .where("a < b")
        .select("lead")
    )
    late = near.where("edge and not sure").join(across, "lead", "left_semi")
    return near.where("sure").unionByName(late).select("key", "doc_id", "position")


def runs(docs: DataFrame, keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """Runs of windows about seeds: key, run (hash of all their words), doc_id,
    start (word), n (windows) and windows (their hashes, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"key": [], "run": [], "doc_id": [], "start": [], "n": [], "windows": []}
            for doc_id, text, keys in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("keys")):
                h = Hasher(text.as_py())
                least, _ = h.minimisers(length, gram)
                if not len(least):
                    continue
                begin, end = _runs(least)
                wanted = np.isin(least[begin].view(np.int64), keys.values.to_numpy())
                begin, end = begin[wanted], end[wanted]
                if not len(begin):
                    continue
                windows = h.grams(length)
                out["key"] += least[begin].view(np.int64).tolist()
                out["run"] += h.ranges(begin, end + length - 1).view(np.int64).tolist()
                out["doc_id"] += [doc_id] * len(begin)
                out["start"] += begin.tolist()
                out["n"] += (end - begin).tolist()
                out["windows"] += [windows[i:j].tobytes() for i, j in zip(begin, end)]
            yield pa.RecordBatch.from_pydict(
                {k: pa.array(v, pa.binary() if k == "windows" else pa.int64()) for k, v in out.items()}
            )

    sets = keyed.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))  # no more than a document has words
    return docs.join(sets, "doc_id").mapInArrow(
        run, "key long, run long, doc_id long, start long, n long, windows binary"
    )


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (excluded), n_words and first_doc_id (the
    smallest doc_id that shares a part) of every maximal repeated span."""
    if not 0 < gram <= length:
        raise ValueError("a gram is part of a passage")
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null")
    path = common.scratch_path(spark, "runs")
    runs(own, seeds(own, length, gram), length, gram).write.parquet(path)
    found = spark.read.parquet(path)

    equal = common.cut(
        found.groupBy("key", "run").agg(
            F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min(F.struct("doc_id", "start")).alias("at")
        )
    )
    open_keys = equal.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    # one representative of each run that other runs of its key may overlap
    heads = (
        equal.join(open_keys, "key", "left_semi")
        .select("key", "run", "low", "high", F.col("at.doc_id").alias("doc_id"), F.col("at.start").alias("start"))
        .join(found.select("key", "run", "doc_id", "start", "windows").dropDuplicates(["key", "run", "doc_id", "start"]), ["key", "run", "doc_id", "start"])
        .select("key", "run", "low", "high", "windows")
    )
    single = heads.mapInArrow(_windows, "key long, run long, low long, high long, at int, window long")
    window_path = common.scratch_path(spark, "windows")
    single.write.parquet(window_path)
    single = spark.read.parquet(window_path)
    shared = (
        single.groupBy("key", "window")  # equal windows have the same least gram
        .agg(F.min("low").alias("first"), F.max("high").alias("last"))
        .where("first < last")
        .select("key", "window", "first")
    )
    # of a run: where its repeated windows are, as many as it has at most
    partly = (
        single.join(shared, ["key", "window"])
        .groupBy("key", "run")
        .agg(F.collect_list(F.struct("at", "first")).alias("hits"))
    )
    spans = found.select("key", "run", "doc_id", "start", "n").join(
        equal.select("key", "run", "low", "high").join(partly, ["key", "run"], "left").where("low < high or hits is not null"),
        ["key", "run"],
    )
    lowest = F.least("low", F.array_min(F.transform("hits", lambda h: h["first"])))
    whole = spans.where("low < high").select(
        "doc_id", "start", (F.col("start") + F.col("n") - 1 + length).alias("end"), lowest.alias("first")
    )
    parts = spans.where("low >= high").select("doc_id", "start", F.explode("hits").alias("h")).select(
        "doc_id",
        (F.col("start") + F.col("h.at")).alias("start"),
        (F.col("start") + F.col("h.at") + length).alias("end"),
        F.col("h.first").alias("first"),
    )
    by_start = Window.partitionBy("doc_id").orderBy("start", "end")
    reach = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = (
        whole.unionByName(parts)
        .withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
        .withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "island")
        .agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("first").alias("first_doc_id"))
    )
    return islands.select(
        "doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc_id"
    )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        t = pd.DataFrame({c: b.column(c).to_numpy() for c in ("key", "run", "low", "high")})
        packed = [np.frombuffer(w, np.int64) for w in b.column("windows").to_pylist()]
        sizes = np.array([len(w) for w in packed], np.int64)
        if not sizes.sum():
            continue
        out = {c: np.repeat(t[c].to_numpy(), sizes) for c in t}
        out["at"] = (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        out["window"] = np.concatenate(packed)
        yield pa.RecordBatch.from_pydict(out)
