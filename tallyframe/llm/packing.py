"""Sum-of-squares online packing of token sequences.

``counts[h]`` is the number of open windows filled to level h.  A piece of s
tokens goes to the level h that makes the sum of squared counts smallest
after h -> h + s (h = 0 opens a window, h + s = capacity closes one).
Documents longer than a window are cut into full windows and one rest.

Every partition packs its own stream in one pass and shuffles nothing.  At
its end the windows still open stay as the rule filled them; only what they
lack is taken, in cut pieces, from the emptiest of them, so that at most one
stays partly filled; that one is cut into lengths that are powers of two,
which need no padding.  A partition that runs again gives the same rows.

Memory: ids are held for pieces of open windows only (a closed window keeps
checksums), texts come one group of at most ``GROUP`` texts and
``GROUP_BYTES`` at a time, and the memo of words is bounded in bytes.

Cases: a null or empty text is the end id alone; repeated rows are packed as
often as they occur; ties between levels go to the fullest window; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .bpe import byte_symbols, default_path
from .common import map_arrow, table

CAPACITY = 4096
END_ID = 2
#: Letters and numbers of the tokenizer's classes among the Latin-1 bytes, in lower case; its white space there.
_LETTER, _NUMBER, _SPACE = rb"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", rb"0-9\xb2\xb3\xb9\xbc-\xbe", rb"\x09-\x0d\x20\x85\xa0"
_WORDS = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[" + _LETTER + rb"]+|[" + _NUMBER + rb"]|[^" + _SPACE + _LETTER + _NUMBER + rb"]+")
SCHEMA = "doc_id {}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class WordIds:
    """Ids of texts by ``tokenizers``, memoised by word within a bound.

    The tokenizer's words do not influence each other, so the ids of a text
    are those of its words in a row.  Texts in Latin-1 are split into words
    here; all others, and those that may hold added tokens, go to the
    tokenizer as they are.
    """

    #: Texts whose unknown words are learned together, and their characters.
    GROUP, GROUP_BYTES = 64, 1 << 20
    #: Bytes of a longer word are not memoised; what an entry takes besides its word and ids.
    LONGEST, ENTRY = 48, 170

    def __init__(self, path: str, memory: int = 24 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = byte_symbols()
        self.symbols = {c: "".join(names[b] for b in chr(c).encode()) for c in range(256)}
        self.memory = memory  # of one generation
        self.held = 0
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}  # an older generation

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @staticmethod
    def split(text: str) -> list[bytes] | None:
        """The words of a Latin-1 text."""
        if "<|" in text:
            return None
        try:
            return _WORDS.findall(text.lower().encode("latin-1"))
        except UnicodeEncodeError:
            return None

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words that the tokenizer leaves whole: its model takes their UTF-8 bytes as symbols."""
        out, tokenize, symbols = {}, self.tokenizer.model.tokenize, self.symbols
        for k in range(0, len(words), 4000):
            part = words[k : k + 4000]
            ids: list[int] = []
            cuts = [0]
            for w in part:
                ids += [t.id for t in tokenize(w.decode("latin-1").translate(symbols))]
                cuts.append(4 * len(ids))
            packed = np.array(ids, "<u4").tobytes()
            out.update((w, packed[cuts[i] : cuts[i + 1]]) for i, w in enumerate(part))
        return out

    def _group(self, group: list[str]) -> Iterator[bytes]:
        parts = [self.split(t) for t in group]
        if self.held > self.memory:
            self.old, self.known, self.held = self.known, {}, 0
        known, old, lost = self.known, self.old, []
        new: set[bytes] = set()
        for p in parts:
            if p:
                new.update(p)
        long: dict[bytes, bytes] = {}
        for w in new.difference(known):
            if (had := old.get(w)) is not None:
                known[w] = had
                self.held += self.ENTRY
            else:
                lost.append(w)
        for w, ids in self.learn(lost).items():
            if len(w) > self.LONGEST:
                long[w] = ids
            else:
                known[w] = ids
                self.held += self.ENTRY
        find = known.__getitem__ if not long else lambda w: known[w] if w in known else long[w]
        for t, p in zip(group, parts):
            yield self._encode(t) if p is None else b"".join(map(find, p))

    def texts(self, texts: Iterator[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        group, size = [], 0
        for t in texts:
            group.append(t or "")
            size += len(group[-1])
            if len(group) == self.GROUP or size > self.GROUP_BYTES:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


class SumOfSquaresPacker:
    """Windows of ``capacity`` tokens; ``place`` returns the rows of windows that it closed.

    A piece is (key, start, ids, doc_tokens); a row is (key, start, length, crc32 of the ids, doc_tokens, window, offset).
    """

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # level -> windows, each a list of pieces
        self.windows = 0

    def level(self, size: int) -> int:
        """The level whose use leaves the smallest sum of squares; full ties go to the fuller window."""
        n, c = self.counts, self.capacity
        left, right = n[: c - size + 1], n[size:].copy()
        right[c - size] = 0 if c - size else 0
        # change / 2: counts[h + s] - counts[h] + 1, without what an empty or a closed window does not count
        change = 2 * (right - left) + 2
        change[0] = 2 * right[0] + 1
        change[c - size] -= 1
        if size == c:
            return 0
        change[1:][left[1:] == 0] = np.iinfo(np.int64).max
        best = change.min()
        return int(np.flatnonzero(change == best)[-1])

    def _close(self, pieces: list) -> list[tuple]:
        rows, at, window = [], 0, self.windows
        self.windows += 1
        for key, start, ids, doc_tokens in pieces:
            rows.append((key, start, len(ids) // 4, zlib.crc32(ids), doc_tokens, window, at))
            at += len(ids) // 4
        return rows

    def place(self, key, ids: bytes) -> list[tuple]:
        rows, total, full = [], len(ids) // 4, self.capacity * 4
        whole = len(ids) // full
        for k in range(whole):
            rows += self._close([(key, k * self.capacity, ids[k * full : (k + 1) * full], total)])
        rest = ids[whole * full :]
        if rest:
            size = len(rest) // 4
            h = self.level(size)
            pieces = [] if h == 0 else self.open[h].pop()
            if h:
                self.counts[h] -= 1
            pieces.append((key, whole * self.capacity, rest, total))
            if h + size == self.capacity:
                rows += self._close(pieces)
            else:
                self.counts[h + size] += 1
                self.open.setdefault(h + size, []).append(pieces)
        return rows

    def finish(self) -> list[tuple]:
        """Fill up the fullest open windows with pieces cut from the emptiest; cut the last one at powers of two."""
        rows: list[tuple] = []
        left = [(h, w) for h in sorted(self.open) for w in self.open[h]]
        self.open, self.counts[:] = {}, 0
        low, high = 0, len(left) - 1
        spare: list = left[low][1] if left else []
        while low < high:
            level, window = left[high]
            while level < self.capacity and low < high:
                if not spare:
                    low += 1
                    spare = left[low][1]
                    continue
                key, start, ids, doc_tokens = spare.pop()
                n = min(self.capacity - level, len(ids) // 4)
                window.append((key, start, ids[: 4 * n], doc_tokens))
                level += n
                if 4 * n < len(ids):
                    spare.append((key, start + n, ids[4 * n :], doc_tokens))
            if low == high:  # the window itself has become the last
                break
            rows += self._close(window)
            high -= 1
        rest = sum(len(p[2]) // 4 for p in spare)
        for b in range(self.capacity.bit_length() - 1, -1, -1):
            if not rest >> b & 1:
                continue
            size, window = 1 << b, []
            while size:
                key, start, ids, doc_tokens = spare.pop()
                n = min(size, len(ids) // 4)
                window.append((key, start, ids[: 4 * n], doc_tokens))
                size -= n
                if 4 * n < len(ids):
                    spare.append((key, start + n, ids[4 * n :], doc_tokens))
            rows += self._close(window)
        return rows


def pack_documents(df: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer = word_ids(path), SumOfSquaresPacker(capacity)
        base = TaskContext.get().partitionId() << 40
        kind, rows = None, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows)] or [[]] * 7
            columns[5] = [base + w for w in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for key, ids in zip(batch.column(0), ids_of.texts(t.as_py() for t in batch.column(1))):
                rows += packer.place(key.as_py(), ids + end)
                if len(rows) >= 5000:
                    yield batch_of(rows)
                    rows = []
        if kind is not None:
            yield batch_of(rows + packer.finish())

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, SCHEMA.format(kind).replace("doc_id", id_col, 1))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_path())
