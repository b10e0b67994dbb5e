"""Language identification of mixed-language text.

A word's script, read from code point ranges, narrows the languages that it
may belong to. Within them a word scores each language by its character
n-grams, and a Viterbi pass over the words, with a penalty for every switch,
labels spans. The document's language is the one with most letters.

Fitted on about ``FIT_PER_LANG`` documents of each language, of a bounded length,
chosen by the hash of doc_id among those whose crc32 mod 4 is not 2. Letters are
the characters of Unicode's categories L; numerals such as ½ or Ⅷ are none.

Cases: a null text or one without letters is ``und`` with score 0; with no
learned language every text is ``und``; equal totals go to the first language
by name; repeated rows are labelled alike; an empty table gives an empty
result; rows with a null language or doc_id are predicted but not learned from;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common

FIT_PER_LANG = 600
ORDERS = (2, 3)
SWITCH = 5.0
CACHE_WORDS = 250_000

#: First code point of a range, and the script from there on.
SCRIPTS = (
    (0x0000, "Latin"),
    (0x0370, "Greek"),
    (0x0400, "Cyrillic"),
    (0x0530, "Armenian"),
    (0x0590, "Hebrew"),
    (0x0600, "Arabic"),
    (0x0700, "Other"),
    (0x0900, "Devanagari"),
    (0x0980, "Indic"),
    (0x0E00, "Thai"),
    (0x0E80, "Other"),
    (0x10A0, "Georgian"),
    (0x1100, "Hangul"),
    (0x1200, "Other"),
    (0x1E00, "Latin"),
    (0x1F00, "Greek"),
    (0x2000, "Other"),
    (0x3040, "Kana"),
    (0x3100, "Han"),
    (0xAC00, "Hangul"),
    (0xD7B0, "Other"),
    (0xF900, "Han"),
    (0xFB00, "Other"),
    (0x20000, "Han"),
)
_STARTS, _NAMES = [s for s, _ in SCRIPTS], [n for _, n in SCRIPTS]
#: Numerals that regular expressions take for letters.
_NUMERALS = "".join(c for c in map(chr, range(0x20000)) if unicodedata.category(c) in ("Nl", "No"))
_LETTERS = re.compile(rf"[^\W\d_{_NUMERALS}]+").findall
_WORDS = re.compile(r"[^\W\d_]+").findall


def script_of(word: str) -> str:
    return _NAMES[bisect_right(_STARTS, ord(word[0])) - 1]


def words(text: str | None) -> list[str]:
    found = _WORDS(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in ([w] if w.isalpha() else _LETTERS(w))]


def grams(word: str) -> list[str]:
    edged = f" {word} "
    return [edged[i : i + n] for n in ORDERS for i in range(len(edged) - n + 1)]


@dataclass
class Model:
    langs: list[str]
    table: dict[str, int]  # n-gram to its row of ``logs``
    logs: np.ndarray  # rows: n-grams, then one for any unknown
    scripts: dict[str, np.ndarray]  # script to a mask of languages
    switch: float = SWITCH
    index: dict[str, int] = field(default_factory=dict, repr=False)
    known: np.ndarray | None = field(default=None, repr=False)

    def rows(self, tokens: list[str]) -> np.ndarray:
        """Log scores of the languages for each word, the best at 0."""
        at, sizes, masks = [], [], []
        get, scripts, free = self.table.get, self.scripts, np.ones(len(self.langs), bool)
        for w in tokens:
            found = [i for g in grams(w) if (i := get(g)) is not None]
            at += found
            sizes.append(len(found))
            masks.append(scripts.get(script_of(w), free))
        ends = np.cumsum(sizes)
        sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.logs[at], 0, np.float64)])
        score = (sums[ends] - sums[ends - sizes]) / 2
        score = np.maximum(score - score.max(1, keepdims=True), -8)
        return np.where(np.array(masks), score, -20).astype(np.float32)

    def ids(self, tokens: list[str]) -> np.ndarray:
        index = self.index
        if new := [w for w in dict.fromkeys(tokens) if w not in index]:
            k = len(index)
            if self.known is None:
                self.known = np.zeros((1024, len(self.langs)), np.float32)
            while k + len(new) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros_like(self.known)])
            self.known[k : k + len(new)] = self.rows(new)
            index.update(zip(new, range(k, k + len(new))))
        return np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))


def viterbi(rows: list[np.ndarray], scores: np.ndarray, switch: float) -> list[np.ndarray]:
    """The best label sequence of each document, all documents at a time.

    ``rows``: per document the rows of ``scores`` that its words have."""
    order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
    lengths = np.array([len(rows[i]) for i in order])
    longest = int(lengths[0]) if len(lengths) else 0
    flat = np.concatenate([rows[i] for i in order]) if longest else np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # documents longer than t
    now = np.zeros((len(rows), scores.shape[1]), np.float32)
    back = []
    states = np.arange(scores.shape[1], dtype=np.uint8)
    for t in range(longest):
        n = active[t]
        own = now[:n]
        if t:
            top = own.argmax(1)
            jump = own[np.arange(n), top] - switch
            stay = own >= jump[:, None]
            back.append(np.where(stay, states, top[:, None].astype(np.uint8)))
            own = np.where(stay, own, jump[:, None])
        now[:n] = own + scores[flat[first[:n] + t]]
    labels = np.zeros(len(flat), np.uint8)
    state = now.argmax(1).astype(np.uint8)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        labels[first[:n] + t] = state[:n]
        if t:
            state[:n] = back[t - 1][np.arange(n), state[:n]]
    out: list = [None] * len(rows)
    for k, i in enumerate(order):
        out[i] = labels[first[k] : first[k] + lengths[k]]
    return out


def train(samples: list[tuple[str | None, str]]) -> Model:
    """Fits n-gram scores on (text, language) pairs."""
    langs = sorted({lang for _, lang in samples})
    place = {lang: i for i, lang in enumerate(langs)}
    seen: dict[str, Counter] = defaultdict(Counter)
    for text, lang in samples:
        seen[lang].update(words(text))
    counts: dict[str, np.ndarray] = {}
    by_script: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(langs)))
    for lang, tokens in seen.items():
        k = place[lang]
        for w, n in tokens.items():
            by_script[script_of(w)][k] += n
            n = min(n, 50)  # a frequent word is not the whole of a language
            for g in grams(w):
                if g not in counts:
                    counts[g] = np.zeros(len(langs), np.float32)
                counts[g][k] += n
    kept = sorted(g for g, c in counts.items() if c.sum() >= 3)
    matrix = np.array([counts[g] for g in kept], np.float32).reshape(len(kept), len(langs))
    logs = np.log((matrix + 0.5) / (matrix.sum(0) + 0.5 * len(kept)))
    logs = np.maximum(logs - logs.max(1, keepdims=True), -6) if len(kept) else logs
    total = sum(by_script.values(), np.zeros(len(langs)))
    scripts = {s: mask for s, c in by_script.items() if (mask := c >= 0.01 * np.maximum(total, 1)).any()}
    return Model(langs, {g: i for i, g in enumerate(kept)}, logs, scripts)


def in_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


def fit(docs: DataFrame, per_lang: int = FIT_PER_LANG) -> Model:
    """Fits on about ``per_lang`` documents of each language."""
    known = docs.where(in_training(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    return train([(r["text"], r["lang"]) for r in common.sampled(known, per_lang, "doc_id", "text", "lang")])


def label(texts: list[str | None], model: Model, spans: bool = True) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, share of letters, spans of words) of each text; without ``spans`` the last is empty."""
    out: list = [("und", 0.0, [])] * len(texts)
    if not model.langs:
        return out
    group: list[tuple[int, list[str]]] = []
    held = 0

    def run() -> None:
        if len(model.index) > CACHE_WORDS:
            model.index.clear()
        rows = [model.ids(tokens) for _, tokens in group]
        for (i, tokens), got in zip(group, viterbi(rows, model.known, model.switch)):
            letters = np.bincount(got, np.fromiter(map(len, tokens), np.int64, len(tokens)), len(model.langs))
            best = int(letters.argmax())
            cuts = [0, *(np.flatnonzero(np.diff(got)) + 1).tolist(), len(got)] if spans else []
            named = [(a, b, model.langs[got[a]]) for a, b in zip(cuts, cuts[1:])]
            out[i] = (model.langs[best], float(letters[best] / letters.sum()), named)

    for i, text in enumerate(texts):
        if tokens := words(text):
            group.append((i, tokens))
            held += len(tokens)
            if held * len(model.langs) > 4_000_000:
                run()
                group, held = [], 0
    if group:
        run()
    return out


def identify(docs: DataFrame, model: Model, text: str = "text", spans: bool = True) -> DataFrame:
    """doc_id, held_out, lang_pred, score and, if wanted, spans (start and end word, lang)."""

    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = label(b.column("text").to_pylist(), model, spans)
            out = {
                "doc_id": b.column("doc_id"),
                "held_out": b.column("held_out"),
                "lang_pred": pa.array([g[0] for g in got], pa.string()),
                "score": pa.array([g[1] for g in got], pa.float64()),
            }
            if spans:
                out["spans"] = pa.array([[{"start": i, "end": j, "lang": lang} for i, j, lang in g[2]] for g in got], kind)
            yield pa.RecordBatch.from_pydict(out)

    held_out = F.coalesce(~in_training(F.col("doc_id")), F.lit(False))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    return own.mapInArrow(run, schema + (", spans array<struct<start: int, end: int, lang: string>>" if spans else ""))
