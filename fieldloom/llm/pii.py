"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches
of four patterns that pass a check; they always stay. Beyond them looser
patterns propose candidates of further kinds. On every candidate, base spans
included, six labelers vote for or against personal data or abstain: the
strict form of the kind, a checksum or range, gazetteers (top-level domains,
dial codes, issuers, countries, given names), cue words before it, other
candidates near it, and digits that are a filler. Expectation-maximisation
over the counts of all vote patterns of the corpus, kind by kind, estimates
how each labeler votes on personal data and on other spans, and so how likely
a candidate is personal data. A logistic classifier over the span's shape and
the words around it learns these likelihoods and keeps or drops the candidates
that are no base span.

Texts are read once; candidates, a few per cent of the text, are written to
the shared folder. The vote patterns are counted by Spark (at most 3^6 for a
kind, whatever the corpus), so the estimates rest on all documents. The
classifier is fitted on about ``FIT_SPANS`` candidates of each kind, chosen by
a hash threshold. Every pattern is matched in time in proportion to the text.

Cases: a null text is an empty one; empty texts have no spans; spans are in
code points, end exclusive; candidates that overlap a base span are not
proposed, and of overlapping kept candidates the likelier stays, then the
earlier, then the kind listed first; repeated rows are scanned alike and count
each; without candidates the classifier keeps none; an empty table gives an
empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.llm import common

BASE = ("email", "ip", "card", "phone")
MORE = ("email_written", "ipv6", "card_spaced", "phone_local", "iban", "ssn", "person")
KINDS = BASE + MORE
#: Candidates of each kind that the classifier is fitted on.
FIT_SPANS = 3000
#: Feature buckets of the classifier, its ridge and steps.
BUCKETS, RIDGE, STEPS = 4096, 1.0, 300
#: Characters before a candidate that hold its cues, and around it that hold its neighbours.
REACH, NEAR = 40, 80

#: Characters of a local part, and the patterns of the base kinds after their first sign.
_LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+").match
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer

_BRACKETED = re.compile(r"[\[({<]\x20?(?:at|AT|At)\x20?[\])}>]").finditer
_SPOKEN = re.compile("\x20at\x20").finditer
_DOTTED = re.compile(r"(?i)[a-z0-9-]{1,63}(?:(?:\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?|\x20dot\x20|\.)[a-z0-9-]{1,63}){1,6}").match
_SIX = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f:]{6,39}+(?![0-9A-Za-z:])").finditer
_SPACED = re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){2}[\x20._/-]{1,3}[0-9]{1,7}(?![0-9A-Za-z])").finditer
_NEARBY = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z-])").finditer
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])").finditer
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])").finditer
_DIGIT = re.compile("[0-9]").search

#: Gazetteers.
DOMAINS = frozenset("com org net edu gov mil int info biz io co us uk de fr es it nl be ch at pl se no dk fi pt ie cz gr ru cn jp kr in br mx ar au nz ca za eu".split())
DIAL = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 353 358 380 420".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35")
COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK TR".split())
GIVEN = tuple(
    "James Mary John Patricia Robert Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Daniel Nancy Matthew Lisa Anthony Betty Mark Sandra Paul Emily Steven Anna Andrew Maria Peter Laura Hans Sabine Klaus Petra Jean Marie Pierre "
    "Claire Luis Carmen Jose Ana Carlos Sofia".split()
)
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame")
_PAIR = re.compile(r"[A-Z][a-z]{1,20}+\.?\x20(?=[A-Z][a-z])").finditer
_CALLED = re.compile(r"\x20(?:name(?:\x20is|:)?|named)\x20(?=[A-Z][a-z])").finditer
_FULL = re.compile(r"[A-Z][a-z]{1,20}+(?:\x20[A-Z][a-z]{1,20}+){0,2}(?![^\W_])").match
#: Words that speak for a kind, and words that speak against all.
CUES = {
    "email": "mail email e-mail contact write reach address correo courriel",
    "ip": "ip host server address from client login connected",
    "card": "card visa mastercard amex credit debit payment tarjeta karte carte",
    "phone": "phone call tel telephone mobile cell fax contact telefono anruf appelez",
    "iban": "iban account bank transfer konto compte cuenta",
    "ssn": "ssn social security insurance taxpayer",
    "person": "name mr mrs ms miss dr prof dear sincerely signed by author contact patient",
}
AGAINST = frozenset("version section chapter figure table page isbn issn order invoice serial part no number id license doi ratio score".split())
_GIVEN, _NAMING = frozenset(GIVEN), frozenset(GIVEN + TITLES)
#: The kind whose cues and gazetteer a further kind shares.
LIKE = {"email_written": "email", "ipv6": "ip", "card_spaced": "card", "phone_local": "phone"}
_CUES = {k: frozenset(CUES[LIKE.get(k, k)].split()) for k in KINDS}
_WORD = re.compile(r"[^\W_]+(?:-[^\W_]+)?").findall


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(span: str) -> str:
    return "".join(c for c in span if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    bound, at = 0, text.find("@")
    while at >= 0:
        before = text[bound:at]
        start = bound + len(before.rstrip(_LOCAL))
        domain = _DOMAIN(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
        bound = domain.end() if domain else at + 1
        at = text.find("@", bound)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base spans, by kind as listed, then start."""
    out = [(0, *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT(text):
        for m in _IP(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((1, *m.span()))
        for m in _CARD(text):
            if m.end() - m.start() >= 13:
                digits = _digits(m[0])
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _PHONE(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def _loose(text: str) -> Iterator[tuple[str, int, int]]:
    """Candidates of the further kinds."""
    for find in (_BRACKETED, _SPOKEN):
        for m in find(text):
            before = text[max(0, m.start() - 65) : m.start()]
            name = before.removesuffix(" ") if find is _BRACKETED else before
            start = m.start() - len(before) + len(name.rstrip(_LOCAL))
            domain = _DOTTED(text, m.end() + text.startswith(" ", m.end())) if name and name[-1] in _LOCAL else None
            if domain:
                yield "email_written", start, domain.end()
    if ":" in text:
        for m in _SIX(text):
            if m[0].count(":") >= 3:
                try:
                    ipaddress.IPv6Address(m[0])
                except ValueError:
                    continue
                yield "ipv6", *m.span()
    if _DIGIT(text):
        for kind, find in (("card_spaced", _SPACED), ("phone_local", _NEARBY), ("iban", _IBAN), ("ssn", _SSN)):
            for m in find(text):
                digits = _digits(m[0])
                if kind == "card_spaced" and not (13 <= len(digits) <= 19 and luhn(digits)):
                    continue
                if kind == "phone_local" and not 9 <= len(digits) <= 13:
                    continue
                yield kind, *m.span()
    for m in _PAIR(text):
        first = m[0].rstrip(" .")
        if first in _NAMING and not text[max(0, m.start() - 1) : m.start()].isalnum():
            full = _FULL(text, m.start() if first in _GIVEN else m.end())
            if full:
                yield "person", *full.span()
    for m in _CALLED(text) if "name" in text else ():
        full = _FULL(text, m.end())
        if full:
            yield "person", *full.span()


def _sign(test: bool | None) -> int:
    return 0 if test is None else 1 if test else -1


def _strict(kind: str, span: str) -> bool | None:
    if kind == "email_written":
        return bool(re.search(r"(?i)[\[({<]", span))
    if kind == "card_spaced":
        return len({*re.findall(r"[^0-9]+", span)}) == 1
    if kind == "phone_local":
        return span.startswith("(") or len({*re.findall(r"[^0-9]", span)}) == 1
    if kind == "person":
        return span.count(" ") in (1, 2)
    return True


def _checked(kind: str, span: str) -> bool | None:
    digits = _digits(span)
    if kind in ("card", "card_spaced"):
        return luhn(digits)
    if kind == "iban":
        moved = span.replace(" ", "")
        moved = moved[4:] + moved[:4]
        return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    if kind == "ssn":
        return not (digits.startswith(("000", "666", "9")) or digits[3:5] == "00" or digits[5:] == "0000")
    if kind == "phone_local":
        return digits[0] not in "19" or None
    return None


def _listed(kind: str, span: str) -> bool | None:
    """Whether a gazetteer has what the kind's spans begin or end with."""
    digits = _digits(span)
    if kind in ("email", "email_written"):
        return re.split(r"[^A-Za-z0-9-]+", span.rstrip("])}> "))[-1].lower() in DOMAINS
    if kind in ("card", "card_spaced"):
        return digits.startswith(ISSUERS)
    if kind == "phone":
        return digits.startswith(DIAL)
    if kind == "iban":
        return span[:2] in COUNTRIES
    if kind == "person":
        return span.split(" ", 1)[0] in _GIVEN or None
    if kind in ("ip", "ipv6"):
        own = span if kind == "ipv6" else ".".join(str(int(p)) for p in span.split("."))
        return not (ipaddress.ip_address(own).is_loopback or ipaddress.ip_address(own).is_unspecified)
    return None


def votes(kind: str, text: str, start: int, end: int, starts: list[int], k: int) -> str:
    """The six labelers' votes on a candidate, + 0 or -, ``k`` its place in the sorted ``starts``."""
    span = text[start:end]
    before = [w.lower() for w in _WORD(text[max(0, start - REACH) : start])]
    cue = 1 if _CUES[kind].intersection(before) else -1 if AGAINST.intersection(before[-2:]) else 0
    near = (k > 0 and start - starts[k - 1] <= NEAR) or (k + 1 < len(starts) and starts[k + 1] - start <= NEAR)
    digits = _digits(span)
    filler = len(digits) >= 7 and (len(set(digits)) <= 2 or digits in "01234567890123456789")
    all_votes = (_sign(_strict(kind, span)), _sign(_checked(kind, span)), _sign(_listed(kind, span)), cue, int(near), -int(filler))
    return "".join("-0+"[v + 1] for v in all_votes)


def features(kind: str, text: str, start: int, end: int) -> list[int]:
    """Buckets of what the classifier sees: kind, shape, length and the words around."""
    span = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", span[:80]))))
    before = _WORD(text[max(0, start - REACH) : start].lower())[-3:]
    after = _WORD(text[end : end + REACH].lower())[:2]
    names = [kind, f"{kind}:{shape[:24]}", f"{kind}#{min(end - start, 64) // 4}", f"{kind}^{span[:2]}", f"{kind}${span[-3:].lower()}"]
    names += [f"<{w}" for w in before] + [f">{w}" for w in after] + [f"{kind}<{w}" for w in before[-1:]]
    return sorted({zlib.crc32(n.encode("utf-8", "surrogatepass")) % BUCKETS for n in names})


def overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether (start, end) meets one of the sorted spans, of which none meets another."""
    k = bisect_left(spans, (end,))
    return k > 0 and spans[k - 1][1] > start


def _flat(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that meet joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def candidates(text: str) -> list[tuple[int, int, int, bool, str, list[int]]]:
    """(kind, start, end, whether a base span, votes, features) of one whole text, by kind and start."""
    base = base_spans(text)
    known = _flat((s, e) for _, s, e in base)
    more = sorted({(KINDS.index(k), s, e) for k, s, e in _loose(text) if not overlaps(known, s, e)})
    found = [*base, *more]
    by_start = sorted(range(len(found)), key=lambda i: found[i][1:])
    starts = [found[i][1] for i in by_start]
    place = {i: p for p, i in enumerate(by_start)}
    return [
        (k, s, e, i < len(base), votes(KINDS[k], text, s, e, starts, place[i]), features(KINDS[k], text, s, e)) for i, (k, s, e) in enumerate(found)
    ]


_FOUND = "array<struct<kind:int,start:int,end:int,base:boolean,votes:string,features:array<int>>>"


def found(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, found): the candidates of every row."""
    kind = pa.list_(
        pa.struct(
            [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]
        )
    )
    names = ("kind", "start", "end", "base", "votes", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[dict(zip(names, c)) for c in candidates(t.as_py())] for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, kind)], ["doc_id", "found"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return own.mapInArrow(run, f"doc_id long, found {_FOUND}")


@dataclass
class Estimate:
    """How the labelers vote on one kind: the share of personal data, and the
    chances of -, 0 and + of each labeler for other spans and for personal data."""

    share: float
    chances: np.ndarray  # labeler, class, vote

    def likelihood(self, pattern: str) -> float:
        vote = ["-0+".index(v) for v in pattern]
        log = np.log([1 - self.share, self.share]) + sum(np.log(self.chances[j, :, v]) for j, v in enumerate(vote))
        return float(1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60))))

    def reliability(self) -> np.ndarray:
        """Of each labeler, how often a vote that is no abstention is right."""
        mix = np.array([1 - self.share, self.share])
        right = mix[0] * self.chances[:, 0, 0] + mix[1] * self.chances[:, 1, 2]
        return right / (mix @ (self.chances[:, :, 0] + self.chances[:, :, 2]).T)


#: Votes that the estimates start from, as so many candidates: personal data draws +, other spans -.
PRIOR = 20.0 * np.array([[0.5, 0.4, 0.1], [0.1, 0.4, 0.5]])


def estimate(counts: dict[str, int], rounds: int = 200) -> Estimate:
    """Expectation-maximisation over the counts of vote patterns."""
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    seen = np.array([[["-0+".index(v) == k for k in range(3)] for v in p] for p in patterns], float)  # pattern, labeler, vote
    now = Estimate(0.5, np.broadcast_to(PRIOR / PRIOR.sum(axis=1, keepdims=True), (seen.shape[1], 2, 3)).copy())
    for _ in range(rounds):
        yes = np.array([now.likelihood(p) for p in patterns])
        weight = np.stack([n * (1 - yes), n * yes])
        totals = np.einsum("cp,pjk->jck", weight, seen) + PRIOR
        share = (weight[1].sum() + 5) / (n.sum() + 10)
        moved = abs(share - now.share)
        now = Estimate(float(share), totals / totals.sum(axis=2, keepdims=True))
        if moved < 1e-9:
            break
    return now


@dataclass
class Model:
    estimates: dict[str, Estimate]
    bias: float
    weights: np.ndarray

    def score(self, buckets: list[int]) -> float:
        z = self.bias + self.weights[buckets].sum() if len(buckets) else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def keep(self, rows: list[tuple[int, int, int, bool, list[int]]]) -> list[tuple[int, int, int]]:
        """(kind, start, end) of all spans, by kind and start, from (kind, start, end, base, features)."""
        out = [(k, s, e) for k, s, e, base, _ in rows if base]
        likely = sorted((-p, s, k, e) for k, s, e, base, own in rows if not base and (p := self.score(own)) >= 0.5)
        taken: list[tuple[int, int]] = []
        for _, s, k, e in likely:
            if not overlaps(taken, s, e):
                taken.insert(bisect_left(taken, (s, e)), (s, e))
                out.append((k, s, e))
        return sorted(out)

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) of one whole text."""
        rows = [(k, s, e, base, own) for k, s, e, base, _, own in candidates(text or "")]
        return [(KINDS[k], s, e) for k, s, e in self.keep(rows)]


def train(rows: list[tuple[list[int], float]]) -> tuple[float, np.ndarray]:
    """Logistic regression by accelerated gradient steps on likelihoods as labels."""
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return -1.0, weights
    owner = np.repeat(np.arange(len(rows)), [len(b) for b, _ in rows])
    bucket = np.array([x for b, _ in rows for x in b], int)
    want = np.array([y for _, y in rows])
    rate = 4.0 / (np.bincount(owner, minlength=len(rows)).max() + 2)
    look, before, look_bias, before_bias = weights, weights, bias, bias
    for t in range(STEPS):
        z = look_bias + np.bincount(owner, look[bucket], len(rows))
        off = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - want
        weights = look - rate * (np.bincount(bucket, off[owner], BUCKETS) + RIDGE * look) / len(rows)
        bias = look_bias - rate * off.mean()
        push = t / (t + 3)
        look, look_bias = weights + push * (weights - before), bias + push * (bias - before_bias)
        before, before_bias = weights, bias
    return float(bias), weights


def fit(found_rows: DataFrame) -> Model:
    """Estimates over all candidates of :func:`found`, and the classifier."""
    each = found_rows.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    counts: dict[str, dict[str, int]] = {}
    for r in each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(KINDS[r["kind"]], {})[r["votes"]] = r["n"]
    estimates = {k: estimate(c) for k, c in sorted(counts.items())}
    keyed = each.select("kind", "votes", "features", F.xxhash64("doc_id", "kind", "start", "end").alias("key"))
    drawn = common.sampled(keyed, FIT_SPANS, "key", "votes", "kind")
    rows = [(r["features"], estimates[KINDS[r["kind"]]].likelihood(r["votes"])) for r in drawn]
    return Model(estimates, *train(rows))


def decide(found_rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of every row of :func:`found`."""
    names = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"]
    joined = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans = [], [], []
            for cell in b.column("found"):
                rows = [(c["kind"], c["start"], c["end"], c["base"], c["features"]) for c in cell.as_py()]
                base = [(k, s, e) for k, s, e, own, _ in rows if own]
                counts.append([sum(k == j for k, *_ in base) for j in range(len(BASE))])
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(model.keep(rows)))
            columns = [pa.array([c[j] for c in counts], pa.int64()) for j in range(len(BASE))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())], names)

    return found_rows.mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string")


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Finds, fits and decides over all rows."""
    rows = common.cut(found(docs, text))
    return decide(rows, fit(rows))


def redacted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with each span of a text replaced by its kind in angle brackets; a null text stays null."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cell in b.column(place):
                whole = cell.as_py()
                parts, at = [], 0
                for kind, s, e in sorted(model.spans(whole), key=lambda x: x[1:]):
                    if s >= at:
                        parts += [whole[at:s], f"<{kind}>"]
                    at = max(at, e)
                out.append(None if whole is None else "".join([*parts, whole[at:]]))
            columns = list(b.columns)
            columns[place] = pa.array(out, b.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
