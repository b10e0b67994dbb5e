"""Token ids of documents in fixed-width bit-packed blocks.

Texts are encoded with a public tokenizer; a token file is a Parquet folder
whose rows are blocks of whole documents in ascending doc_id order. A block
stores every id in the minimum number of bits that the vocabulary needs, as
one little-endian bit stream, with the ids' offsets of its documents, so that
numpy unpacks a block at once and one document can be read alone.

Columns: shard, block (order of blocks), first_token (ids of the shard before
the block), first_id and last_id (of its documents, by whose statistics a
reader skips row groups), width, n_tokens, doc_ids, lengths, payload.

Where the tokenizer never joins words across ASCII white space, each distinct
run between white space is encoded once a chunk of documents, from its pieces
(letters, digits, marks), whose ids are kept in a bounded cache. Other
tokenizers encode whole texts.

Cases: a null or blank text has the end id alone; repeated rows and equal
doc_ids keep a span each, ties in the order of the text's hash; null doc_ids
come first; an empty table writes an empty file; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.llm import common

END_ID = 2
BLOCK_TOKENS = 1 << 16
#: Bytes of text that are encoded at once.
CHUNK_BYTES = 2_000_000
#: Distinct pieces that a worker keeps; beyond it the cache starts anew.
CACHE_PIECES = 120_000
#: Shards whose starts are broadcast to the reader; with more they are joined by a shuffle.
BROADCAST_SHARDS = 1_000_000

SCHEMA = (
    "shard int, block int, first_token long, first_id long, last_id long, width int, n_tokens long, "
    "doc_ids array<long>, lengths array<int>, payload binary"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids to a little-endian bit stream of ``width`` bits each."""
    ids = np.asarray(ids, np.uint32)
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, width: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from id ``start`` on, reading only the bytes they lie in."""
    if width in (8, 16, 32):
        return np.frombuffer(payload, f"<u{width // 8}", count, start * width // 8).astype(np.uint32)
    first = start * width
    raw = np.frombuffer(payload, np.uint8)[first // 8 : (first + count * width + 7) // 8]
    bits = np.unpackbits(raw, bitorder="little")[first % 8 : first % 8 + count * width]
    return bits.reshape(count, width).astype(np.uint32) @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


#: Words of these characters keep their code points under composition and are
#: lowered one by one: printable ASCII, Latin, Cyrillic, general punctuation, Han, Hangul.
_SIMPLE = "^[!-~\u00a1-\u012f\u0132-\u017e\u0410-\u044f\u2010-\u2027\u2030-\u205e\u20ac\u4e00-\u9fff\uac00-\ud7a3]*$"
#: The pieces into which such words are split, as the vocabulary file has it.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
_PROBE = "Théâtre größer AND Straße año it's 'tis 'LLAMA l'eau, (a)--b!! x&&& 12a3 o'd <> Ÿ # --- d'été. Ärger½ ²ª «Ž» Москва 你好，3 한국 … — l’eau €5"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def _bytes_as_letters(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)


class Encoder:
    """Encodes texts, by words through a cache of their pieces where that gives the same ids."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = width_of(self.tokenizer.get_vocab_size())
        self.pieces: dict[str, bytes] = {}
        self._tokenize = self.tokenizer.model.tokenize
        alone = [i for w in _PROBE.split() for i in self._encode(w)]
        self.by_words = self._encode(_PROBE) == alone and self._encode("\n" + _PROBE.replace(" ", " \t")) == alone
        self.by_pieces = self.by_words and self._simple_words(pa.array(_PROBE.split()))[0].tolist() == alone

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _piece(self, piece: str) -> bytes:
        got = array("I", [t.id for t in self._tokenize(_bytes_as_letters(piece))]).tobytes() if piece else b""
        if len(self.pieces) >= CACHE_PIECES:
            self.pieces.clear()
        self.pieces[piece] = got
        return got

    def _simple_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words one after another, and how many each has."""
        lists = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words), _PIECES, r"\0 "))
        pieces = lists.flatten().dictionary_encode()
        get, own = self.pieces.get, self._piece
        got = [own(p) if (i := get(p)) is None else i for p in pieces.dictionary.to_numpy(zero_copy_only=False)]
        return _spread(_joined(got), pieces.indices.to_numpy(), pc.list_value_length(lists).to_numpy())

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        simple = np.zeros(len(words), bool)
        if self.by_pieces:
            simple = pc.and_not(pc.match_substring_regex(words, _SIMPLE), pc.match_substring(words, "<|")).to_numpy(zero_copy_only=False)
        flat, sizes = self._simple_words(words.filter(pa.array(simple)))
        others = words.filter(pa.array(~simple)).cast(pa.binary()).to_pylist()
        more, more_sizes = _joined([array("I", self._encode(w.decode("utf-8", "replace"))).tobytes() for w in others])
        # simple words come first, then the others
        place = np.empty(len(words), np.int64)
        place[np.flatnonzero(simple)], place[np.flatnonzero(~simple)] = np.arange(len(sizes)), len(sizes) + np.arange(len(more_sizes))
        return _spread((np.concatenate((flat, more)), np.concatenate((sizes, more_sizes))), place, np.ones(len(words), np.int64))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        if not self.by_words:
            return _joined([array("I", self._encode(t.as_py() or "")).tobytes() for t in texts])
        lists = pc.ascii_split_whitespace(texts.fill_null(""))
        words = lists.flatten().dictionary_encode()
        return _spread(self._words(words.dictionary), words.indices.to_numpy(), pc.list_value_length(lists).to_numpy())


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def _spread(known: tuple[np.ndarray, np.ndarray], at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the ids of distinct parts those of the sequence ``at`` of parts, and
    how many ids each group of so many parts has."""
    flat, sizes = known
    lengths = sizes[at]
    ends = np.cumsum(lengths)
    place = np.arange(lengths.sum()) + np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - lengths), lengths)
    upto = np.concatenate(([0], ends))[np.cumsum(group)]
    return flat[place], np.diff(upto, prepend=0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``CHUNK_BYTES`` of text, or of one longer text."""
    size = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy().astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, before + CHUNK_BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    text: str = "text",
) -> None:
    """Encodes ``docs`` (doc_id, text) and writes the token file at ``path``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).withColumns(
        {"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()}
    )
    order = ["doc_id", "tie", "row"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(tokenizer), TaskContext.get().partitionId()
        ids, parts, sizes, held, before, block = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, parts, sizes, held, before, block
            named = [i for i in ids if i is not None]
            row = (
                shard, block, before, min(named, default=None), max(named, default=None), own.width, held, ids, sizes,
                pack(np.concatenate(parts), own.width),
            )
            kinds = (
                pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()),
                pa.list_(pa.int32()), pa.binary(),
            )
            before, block = before + held, block + 1
            ids, parts, sizes, held = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], _NAMES)

        for b in (c for b in batches for c in _chunks(b)):
            got, lengths = own.encode(b.column("text"))
            lengths = lengths + 1
            ends = np.cumsum(lengths)
            body = np.full(ends[-1], end_id, np.uint32)
            inner = np.ones(len(body), bool)
            inner[ends - 1] = False
            body[inner] = got
            taken = 0
            for doc_id, n, end in zip(b.column("doc_id").to_pylist(), lengths.tolist(), ends.tolist()):
                ids.append(doc_id)
                sizes.append(n)
                held += n
                if held >= block_tokens:
                    parts.append(body[taken:end])
                    taken = end
                    yield flush()
            if taken < len(body):
                parts.append(body[taken:])
        if ids:
            yield flush()
        pa.default_memory_pool().release_unused()  # a worker lives on for other stages

    # small row groups keep writers small and let a reader skip to a document
    ordered.mapInArrow(blocks, SCHEMA).write.option("parquet.block.size", 8 << 20).parquet(path)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The blocks with ``start``, the ids of all blocks before theirs."""
    blocks = spark.read.parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row to a shard: as many as the file has parts
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shard_start"))
    last = blocks.agg(F.max("shard")).first()[0] or 0
    if last < BROADCAST_SHARDS:  # the payload stays where it is
        starts = F.broadcast(starts)
    return blocks.join(starts, "shard").withColumn("start", F.col("shard_start") + F.col("first_token"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens, ids."""
    return _unpacked(_placed(spark, path), digest=False)


def summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file: doc_id, start, n_tokens, ids_crc32."""
    return _unpacked(_placed(spark, path), digest=True)


def _unpacked(blocks: DataFrame, digest: bool) -> DataFrame:
    name, kind = ("ids_crc32", pa.int64()) if digest else ("ids", pa.list_(pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                lengths = b.column("lengths")[k].values.to_numpy().astype(np.int64)
                ends = np.cumsum(lengths)
                ids = unpack(b.column("payload")[k].as_py(), b.column("width")[k].as_py(), 0, int(ends[-1])).astype("<u4")
                parts = [ids[e - n : e] for e, n in zip(ends, lengths)]
                starts = b.column("start")[k].as_py() + ends - lengths
                last = [zlib.crc32(p.tobytes()) for p in parts] if digest else parts
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_ids")[k].values, pa.array(starts), pa.array(lengths), pa.array(last, kind)],
                    ["doc_id", "start", "n_tokens", name],
                )

    return blocks.select("lengths", "width", "payload", "start", "doc_ids").mapInArrow(
        run, f"doc_id long, start long, n_tokens long, {name} {'long' if digest else 'array<long>'}"
    )


def document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of each document with this id. Files and row groups
    whose first and last ids exclude it are not read, and of a block's stream
    only the bytes of the document are unpacked."""
    out = []
    for r in _holding(spark, path, doc_id).orderBy("shard", "block").collect():
        ends = np.cumsum(r["lengths"])
        for k, d in enumerate(r["doc_ids"]):
            if d == doc_id:
                out.append(unpack(r["payload"], r["width"], int(ends[k] - r["lengths"][k]), r["lengths"][k]))
    return out


def _holding(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    near = (F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)
    return spark.read.parquet(path).where(near & F.array_contains("doc_ids", F.lit(doc_id)))
