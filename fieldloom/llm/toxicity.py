"""Toxicity scores from a counterfactually regularised linear classifier.

The features of a text are the presence of words and of word beginnings. A
logistic model is fitted on a bounded sample of labelled documents. Labelled
sentences give counterfactual pairs: in every sentence that names an identity
term the term is swapped for the others of its group, and into one sentence of
each document, chosen by its checksum, a term is put and then swapped likewise.
The fit penalises the squared change of the score over all pairs, so that
naming a group does not make a neutral text look toxic. Pairs count by what
they change, so there is no bound on their number.

Fixed for the fit: about ``FIT_PER_CLASS`` rows of each label, chosen by the
hash of doc_id, of texts of a bounded length; everything is scored on whole
texts.

Cases: null, blank and wordless texts get the score of a text without
features; a null label or one that is not 0 or 1 is not learned from; labels
that repeat a doc_id count once, toxic if any is; of texts that share a doc_id
the least is learned from; without labelled rows of both kinds every score is
the prior; repeated rows are scored alike; a null doc_id is not held out and
not learned from; an empty table gives an empty result; other columns are
ignored, whatever their names, and ``accept`` keeps them.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common

FIT_PER_CLASS = 2000
FEATURES = 1500
#: Strength of the counterfactual penalty and of the ridge.
COUNTERFACTUAL, RIDGE = 10.0, 0.3
PREFIXES = (4, 5, 6, 7)
CACHE_WORDS = 60_000

#: Identity terms, grouped by what may replace what.
IDENTITY = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("woman", "man", "girl", "boy"),
    ("women", "men", "girls", "boys"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("deaf", "blind", "disabled", "autistic"),
)
_GROUP = {term: group for group in IDENTITY for term in group}
_WORDS = re.compile(r"[^\W_]+").findall
_SENTENCES = re.compile(r"[.!?\n]+").split


def words(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


def features_of(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in PREFIXES if len(word) >= k)]


@dataclass
class Model:
    bias: float
    weights: dict[str, float]
    cache: dict[str, float | tuple] = field(default_factory=dict, repr=False)

    def _own(self, word: str) -> tuple:
        got = tuple(f for f in features_of(word) if f in self.weights)
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        self.cache[word] = got
        return got

    def score(self, text: str | None) -> float:
        found: set[str] = set()
        cache = self.cache
        for w in set(words(text)):
            got = cache.get(w)
            if got is None:
                got = self._own(w)
            if got:
                found.update(got)
        z = self.bias + sum(map(self.weights.__getitem__, sorted(found)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _placed_sentence(text: str) -> tuple[list[str], str] | None:
    """A sentence of the text and a term to put into it, both by the text's checksum."""
    parts = [w for part in _SENTENCES(text) if (w := words(part))]
    if not parts:
        return None
    draw = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    group = IDENTITY[draw // 7919 % len(IDENTITY)]
    return parts[draw % len(parts)], group[draw // 104_729 % len(group)]


def counterfactuals(text: str | None) -> Iterator[tuple[list[str], str | None, str]]:
    """(the other words of a sentence, a term or none, what stands there instead)."""
    low = (text or "").lower()
    if any(term in low for term in _GROUP):
        for sentence in _SENTENCES(text or ""):
            own = words(sentence)
            for i, w in enumerate(own):
                for other in _GROUP.get(w, ()):
                    if other != w:
                        yield [*own[:i], *own[i + 1 :]], w, other
    if placed := _placed_sentence(text or ""):
        own, term = placed
        yield own, None, term
        for other in _GROUP[term]:
            if other != term:
                yield own, term, other


class _Codes:
    """Features of words by their checksums, each word's worked out once."""

    def __init__(self) -> None:
        self.known: dict[str, bytes] = {}

    def of(self, tokens: set[str]) -> np.ndarray:
        """The distinct features of some words."""
        known = self.known
        for w in tokens:
            if w not in known:
                known[w] = array("I", [zlib.crc32(f.encode()) for f in features_of(w)]).tobytes()
        return np.unique(np.frombuffer(b"".join(map(known.__getitem__, tokens)), np.uint32))


def _changes(texts: list[str | None], columns: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct changes of the features over the pairs, as rows, and how many pairs make each."""
    seen: Counter[tuple[tuple[int, ...], tuple[int, ...]]] = Counter()
    of = lambda w: {columns[f] for f in features_of(w) if f in columns}
    cached: dict[str, set[int]] = {None: set()} | {t: of(t) for t in _GROUP}
    for text in texts:
        for rest, term, other in counterfactuals(text):
            gone, new = cached[term] - cached[other], cached[other] - cached[term]
            if gone or new:
                held = set()
                for w in rest:
                    if w not in cached:
                        cached[w] = of(w)
                    held |= cached[w]
                gone, new = gone - held, new - held
            seen[tuple(sorted(gone)), tuple(sorted(new))] += 1
    d = np.zeros((len(seen), max(columns.values(), default=-1) + 1), np.float32)
    for r, (gone, new) in enumerate(seen):
        d[r, list(gone)], d[r, list(new)] = -1, 1
    return d, np.array(list(seen.values()), np.float64)


def train(
    texts: list[str | None],
    labels: list[int],
    n_features: int = FEATURES,
    penalty: float = COUNTERFACTUAL,
    ridge: float = RIDGE,
    rounds: int = 400,
) -> Model:
    """Fits the classifier on labelled texts held in memory."""
    y = np.asarray(labels, np.float64)
    n1, n0 = y.sum(), len(y) - y.sum()
    if not n1 or not n0:
        return Model(float(np.log((n1 + 0.5) / (n0 + 0.5))), {})
    # chi-square of each feature's presence against the label; features count by
    # their checksums, in arrays, as most of a corpus's features are rare
    own = _Codes()
    present = [own.of(set(words(t))) for t in texts]
    codes, at = np.unique(np.concatenate(present), return_inverse=True)
    label = np.repeat(np.asarray(labels, np.int64), [len(p) for p in present])
    a, b = (np.bincount(at[label == k], minlength=len(codes)).astype(float) for k in (1, 0))
    codes, a, b = (v[a + b >= 3] for v in (codes, a, b))
    n = n0 + n1
    off = a * (n0 - b) - b * (n1 - a)
    chi = n * off**2 / np.maximum((a + b) * (n - a - b) * n1 * n0, 1)
    best = codes[np.argsort(-chi, kind="stable")[:n_features]]
    terms = np.array([zlib.crc32(f"{t}$".encode()) for t in _GROUP], np.uint32)
    chosen = np.unique(np.concatenate((best, terms)))
    place = {int(c): k for k, c in enumerate(chosen)}
    wanted = set(place)
    columns = {  # features by name; those of one checksum share a column
        f: place[c]
        for w, known in {**own.known, **{t: own.of({t}).tobytes() for t in _GROUP}}.items()
        if not wanted.isdisjoint(np.frombuffer(known, np.uint32).tolist())
        for f in features_of(w)
        if (c := zlib.crc32(f.encode())) in place
    }
    x = np.zeros((len(texts), len(chosen)), np.float32)
    for r, p in enumerate(present):
        k = np.minimum(np.searchsorted(chosen, p), len(chosen) - 1)
        x[r, k[chosen[k] == p]] = 1
    del present, own
    d, pairs = _changes(texts, columns)
    share = (pairs / pairs.sum() if len(pairs) else pairs).astype(np.float32)
    single = lambda values: values.astype(np.float32)  # the type of the matrices, which are not copied then
    weight = np.where(y == 1, np.sqrt(n0 / n1), 1.0)
    weight /= weight.sum()
    w, bias = np.zeros(len(chosen)), float(np.log(n1 / n0))
    m = np.zeros(len(chosen) + 1)
    v = np.zeros(len(chosen) + 1)
    for k in range(1, rounds + 1):  # Adam, with full batches
        p = 1 / (1 + np.exp(-np.clip(x @ single(w) + bias, -30, 30)))
        error = weight * (p - y)
        grad = x.T @ single(error) + ridge / n * w
        if len(pairs):
            grad += penalty * (d.T @ (share * (d @ single(w))))
        g = np.append(grad, error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return Model(float(bias), {f: float(w[k]) for f, k in sorted(columns.items()) if abs(w[k]) > 1e-4})


def identity_gap(model: Model, texts: list[str | None]) -> float:
    """Mean change of the score's log-odds when a term is put into a sentence of each text."""
    def odds(tokens: list[str]) -> float:
        s = model.score(" ".join(tokens))
        return float(np.log(s / (1 - s)))

    placed = [p for t in texts if (p := _placed_sentence(t or ""))]
    return float(np.mean([abs(odds([*own, term]) - odds(own)) for own, term in placed])) if placed else 0.0


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, per_class: int = FIT_PER_CLASS, **options) -> Model:
    """Fits on about ``per_class`` labelled documents of each label, chosen by
    the hash of doc_id among those whose crc32 mod 5 is not 0."""
    known = labels.where(in_training(F.col("doc_id")) & F.col("toxic").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.element_at(F.array(*[F.lit(min(1.0, per_class / counts.get(k, 1))) for k in (0, 1)]), F.col("toxic") + 1)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    # about 2 x per_class distinct ids are broadcast, and one text of each is collected
    chosen = F.broadcast(known.where(draw < share))
    usable = docs.select("doc_id", "text").where(F.coalesce(F.length("text") <= common.FIT_CHARS, F.lit(True)))
    rows = usable.join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([r["text"] for r in rows], [r["toxic"] for r in rows], **options)


def scores(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = pa.array([model.score(t.as_py()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), score], ["doc_id", "held_out", "score"])

    held_out = F.coalesce(~in_training(F.col("doc_id")), F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    out = own.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accept(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that score below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) < threshold for t in b.column(text)], pa.bool_()))
        pa.default_memory_pool().release_unused()  # a worker lives on for other stages

    return docs.mapInArrow(run, docs.schema)
