"""Byte-pair encoding and decoding with a priority queue of merge ranks.

A word is a doubly linked list of symbols.  Every adjacent pair that has a
merge sits in a heap ordered by (rank, position); the best pair is merged and
its two new neighbours are pushed.  Entries whose symbols have changed since
they were pushed are stale and skipped when popped.  Decoding looks every id
up in the vocabulary and concatenates the strings, by the rule of the
tokenizer file (a file without a decoder joins them with a space).

Cases: a null or empty text has no ids and decodes to ``""``; repeated rows
give repeated results; extra columns of the input are ignored; an empty table
gives an empty table.  Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table

VOCABULARY = "word_bpe_49k.json"
#: Entries in one generation of a memo; two generations are alive at most.
MEMO_ENTRIES = 150_000
#: Longer chunks are encoded anew each time.
MEMO_CHARS = 48
#: Separators for str.split() that the tokenizer's white space does not have.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b], spare = chr(spare), spare + 1
    return [names[b] for b in range(256)]


class Memo(dict):
    """A bounded memo of two generations: the older one goes when the newer one is full."""

    def __init__(self, compute, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= MEMO_CHARS:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class BpeCodec:
    """``encode`` and ``decode`` for a word-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = text
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        #: pair of ids -> rank; rank -> merged id
        self.ranks, self.merged = {}, []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank)
            self.merged.append(vocab[a + b])
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the tokenizer's \s is the White_Space property
        self.words = regex.compile(pattern.replace("\\s", "\\p{White_Space}"))
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self._word = Memo(self._encode_word)
        self._chunk = Memo(self._encode_span)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word's bytes."""
        last = len(word) - 1
        inner, ranks, merged = self.inner, self.ranks, self.merged
        ids = [inner[b] for b in word]
        ids[last] = self.final[word[last]]
        before, after = list(range(-1, last)), list(range(1, last + 2))
        after[last] = -1
        heap = []
        for i in range(last):
            rank = ranks.get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                heap.append(rank << 40 | i)
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            rank, i = top >> 40, top & 0xFFFFFFFFFF
            j = after[i]
            if ids[i] < 0 or j < 0 or ranks.get(ids[i] << 32 | ids[j]) != rank:
                continue  # stale
            ids[i], ids[j] = merged[rank], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                rank = ranks.get(ids[i] << 32 | ids[k])
                if rank is not None:
                    push(heap, rank << 40 | i)
            h = before[i]
            if h >= 0:
                rank = ranks.get(ids[h] << 32 | ids[i])
                if rank is not None:
                    push(heap, rank << 40 | h)
        return [x for x in ids if x >= 0]

    def _encode_word(self, word: str) -> bytes:
        return np.array(self.merge(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()

    def _encode_plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return b"".join(map(self._word.__getitem__, self.words.findall(text.lower())))

    def _encode_span(self, text: str) -> bytes:
        if "<|" not in text:
            return self._encode_plain(text)
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self._encode_plain(text[at : m.start()]), np.array([self.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._encode_plain(text[at:])])

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            return self._encode_span(text)
        return b"".join(map(self._chunk.__getitem__, text.split()))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> BpeCodec:
    return BpeCodec(path)


def encode_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = codec(path)
        ids = [own.encode(t.as_py()) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([own.decode(x) for x in ids], pa.string())],
            [id_col, "ids", "decoded"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run, f"{id_col} {kind}, ids array<int>, decoded string")


def digest_documents(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``encode_documents``, with the ids and the decoded text replaced by their SHA-256 inside the task."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, n, ids_sha, decoded_sha = codec(path), [], [], []
        for text in batch.column(1):
            packed = own.encode_bytes(text.as_py())
            n.append(len(packed) // 4)
            ids_sha.append(hashlib.sha256(packed).hexdigest())
            decoded = own.decode(np.frombuffer(packed, "<u4").tolist())
            decoded_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
            [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run, f"{id_col} {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), default_path())
