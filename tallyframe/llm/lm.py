"""Language-model scoring with a log-bilinear model trained by noise-contrastive estimation.

Every word that the training tokens hold ``MIN_COUNT`` times or more has
vectors of its own (the most frequent ``MAX_WORDS``, which bounds what is sent
to the executors), so their number grows with the corpus.  Words are dealt to
classes by frequency, about as many classes as the root of their number; every
class has one more outcome for the rarer words whose endings fall to it.  The
model predicts class and word from the ``CONTEXT`` outcomes before them,

    h = sum_k c_k * r(outcome_k),   s(x) = h . q(x) + b(x),

once over all classes and once over the words of the class, and a rarer word
has its add-one share within its class's outcome.  Both steps are normalised
with batched matrix products, so that the probabilities of all known tokens
and of one unknown token per class sum to 1.

Texts are tokenised twice, to count and to number; the numbers are kept.
Training goes over every token of the training documents: documents are dealt
to shards by a hash, as many as the tokens ask for, and each shard runs
noise-contrastive estimation (noise from the frequencies, shared within a
batch) from common values; parameters are averaged with token weights after each of ``ROUNDS`` parts.  Neither shards
nor their order depend on the partitions of the input, so nor does the model.

Cases: a null or empty text is one end token; words are what is left between
the white space of the contract after lower-casing A-Z; without training
documents the classes are uniform; repeated rows are scored each; a null id
is in the group of the empty text's checksum; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, crc_mod, map_arrow, table

WIDTH, CONTEXT = 16, 4
MIN_COUNT, MAX_WORDS = 32, 60_000
LISTED = 200_000
#: Distinct tokens counted at once in a task.
COUNTED = 200_000
#: Noise classes and noise words, shared within a batch; places of a batch, and neighbours that come to a batch together.
NOISE, BATCH, STRETCH = 64, 2048, 64
RATE = 0.08
#: Tokens that a shard should have, the most shards, and the parts between averages.
SHARD_TOKENS, MAX_SHARDS, ROUNDS = 8 << 20, 4096, 4
#: Parameters that travel together; tokens that are scored together.
CHUNK, SCORED = 1 << 16, 1 << 17
#: No word holds white space, so this is no word.
END = b" "
_MARKS = bytes(c for c in range(128) if not chr(c).isalnum())


def tokens_of(text: str | bytes | None) -> list[bytes]:
    """Words of the ASCII-lower-cased text, without the end token."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return raw.lower().split()


def ending(word: bytes) -> int:
    """A hash of a word's last bytes and what follows them."""
    body = word.rstrip(_MARKS)
    n = len(body)
    return zlib.crc32(word[max(0, n - 3) : n + 1])


class Listed(dict):
    """Place of a listed word; -1 for others."""

    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Vocabulary:
    """Outcomes are the end (0), the words with vectors (1 ..), and last the rarer words of each class."""

    listed: Listed  # word -> place; places from the most frequent on
    counts: np.ndarray  # of the listed
    own: int  # so many places have vectors
    class_of: np.ndarray  # of every outcome
    frequency: np.ndarray  # training tokens of every outcome
    rare_tokens: np.ndarray  # of every class
    rare_types: np.ndarray
    end: int
    tokens: int
    types: int
    listed_class: np.ndarray  # where a listed word's rarer ones would be

    @property
    def n_classes(self) -> int:
        return len(self.rare_tokens)

    @property
    def size(self) -> int:
        return 1 + self.own + self.n_classes

    def rare_class(self, word: bytes) -> int:
        return 1 + ending(word) % (self.n_classes - 1)

    def shares(self) -> np.ndarray:
        """log10 of what the add-one counts of each class's rarer words are divided by."""
        return np.log10(np.maximum(1, self.rare_tokens + self.rare_types + 1))


def classes_for(counts: np.ndarray) -> np.ndarray:
    """The class (from 1) of each word, most frequent first: equal sums of the roots of counts."""
    n = len(counts)
    if not n:
        return np.zeros(0, np.int64)
    wanted = max(1, math.isqrt(n))
    mass = np.cumsum(np.sqrt(counts))
    return 1 + np.minimum((mass - np.sqrt(counts)) / mass[-1] * wanted, wanted - 1).astype(np.int64)


def count_tokens(df: DataFrame, text_col: str) -> DataFrame:
    """(word binary, n bigint) over all rows; the end token is counted too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts.update(tokens_of(text.as_py()))
                counts[END] += 1
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return map_arrow(df.select(text_col), run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def with_endings(counts: DataFrame) -> DataFrame:
    """(word, n) -> (word, n, ending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([ending(w.as_py()) for w in batch.column(0)], pa.int64())], ["word", "n", "ending"])

    return map_arrow(counts, run, "word binary, n bigint, ending bigint")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From a kept table (word, n, ending) of the training tokens."""
    top = counts.filter(F.col("word") != F.lit(bytearray(END))).orderBy(F.desc("n"), "word").limit(LISTED).toArrow()
    words, n, endings = top.column("word").to_pylist(), top.column("n").to_numpy().astype(np.int64), top.column("ending").to_numpy()
    own = min(MAX_WORDS, int((n >= MIN_COUNT).sum()))
    of_words = classes_for(n[:own])
    n_classes = 2 + int(of_words.max(initial=0))
    rare_tokens, rare_types = np.zeros(n_classes, np.int64), np.zeros(n_classes, np.int64)
    total = counts.groupBy(F.when(F.col("word") == F.lit(bytearray(END)), -1).otherwise(F.pmod("ending", F.lit(n_classes - 1))).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()
    end = sum(r["n"] for r in total if r["c"] < 0)
    for r in total:
        if r["c"] >= 0:
            rare_tokens[1 + r["c"]], rare_types[1 + r["c"]] = r["n"], r["types"]
    tokens, types = int(rare_tokens.sum()) + end, int(rare_types.sum()) + (end > 0)
    at = 1 + endings[:own] % (n_classes - 1)
    np.subtract.at(rare_tokens, at, n[:own])
    np.subtract.at(rare_types, at, 1)
    frequency = np.concatenate([[end], n[:own], rare_tokens])
    class_of = np.concatenate([[0], of_words, np.arange(n_classes)]).astype(np.int64)
    return Vocabulary(Listed(zip(words, range(len(words)))), n, own, class_of, frequency, rare_tokens, rare_types, end, tokens, types, 1 + endings % (n_classes - 1))


def _sigmoid_of_negative(x: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(x)); overwrites x.  An exponential that overflows gives 0."""
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class LogBilinear:
    """class_of: the class of every outcome; frequency: how often the training tokens hold it."""

    NAMES = ("seen", "classes", "words", "mix")  # the last column of classes and words is the bias

    def __init__(self, class_of: np.ndarray, frequency: np.ndarray, seed: int = 5):
        n, size = int(class_of.max()) + 1, len(class_of)
        rng = np.random.default_rng(seed)
        normal = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.class_of = class_of
        mass = np.bincount(class_of, frequency, n) + 0.5
        self.class_noise = mass / mass.sum()
        own = frequency + 0.5
        self.word_noise = own / own.sum()
        # outcomes by class
        self.order = np.argsort(class_of, kind="stable")
        self.begin = np.searchsorted(class_of[self.order], np.arange(n + 1))
        self.drawn = [np.cumsum(p) for p in (self.class_noise, self.word_noise)]
        self.seen, self.classes, self.words = normal(size, WIDTH), normal(n, WIDTH + 1), normal(size, WIDTH + 1)
        self.classes[:, -1], self.words[:, -1] = np.log(self.class_noise), np.log(self.word_noise)
        self.mix = np.full((CONTEXT, WIDTH), 1 / CONTEXT, np.float32)
        self.logs = [np.log(NOISE * p).astype(np.float32) for p in (self.class_noise, self.word_noise)]
        self.squares = [np.zeros_like(p) for p in self.parameters()]

    def parameters(self) -> list[np.ndarray]:
        return [getattr(self, x) for x in self.NAMES]

    def flat(self) -> np.ndarray:
        """Parameters and the sums of their squared gradients."""
        return np.concatenate([p.ravel() for p in (*self.parameters(), *self.squares)])

    def set_flat(self, values: np.ndarray) -> None:
        at = 0
        for p in (*self.parameters(), *self.squares):
            p[...] = values[at : at + p.size].reshape(p.shape)
            at += p.size

    def hidden(self, seen: list[np.ndarray]) -> np.ndarray:
        """seen: the vectors of CONTEXT outcomes, the nearest first, any number of them in a row; a last column of ones meets the biases."""
        mix = np.tile(self.mix, seen[0].shape[1] // WIDTH)
        total = seen[0] * mix[0]
        for k in range(1, CONTEXT):
            total += seen[k] * mix[k]
        h = np.ones((total.size // WIDTH, WIDTH + 1), np.float32)
        h[:, :-1] = total.reshape(-1, WIDTH)
        return h

    def log_probabilities(self, contexts: np.ndarray, targets: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """Natural logarithms of the targets' probabilities, normalised over classes and over each class's outcomes.  contexts: CONTEXT x n outcomes, the nearest first."""
        parts = ((self.hidden([self.seen.take(c[k : k + step], 0) for c in contexts]), targets[k : k + step]) for k in range(0, len(targets), step))
        return self._shares(parts)

    def log_probabilities_of(self, documents: list[np.ndarray], step: int = 1 << 16) -> np.ndarray:
        """``log_probabilities`` of the ``windows`` of documents; a vector is fetched once for all windows that hold it."""
        stream, goal = laid(documents)

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for k in range(CONTEXT, len(stream), step):
                here = stream[k - CONTEXT : k + step]
                seen, n = self.seen.take(here, 0).reshape(1, -1), len(here) - CONTEXT
                at = np.flatnonzero(goal[k : k + step])
                yield self.hidden([seen[:, WIDTH * (CONTEXT - i) : WIDTH * (CONTEXT - i + n)] for i in range(1, CONTEXT + 1)]).take(at, 0), here[CONTEXT:][at]

        return self._shares(parts())

    def _shares(self, parts: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        place = np.empty(len(self.class_of), np.int64)
        place[self.order] = np.arange(len(self.order))
        by_class = self.words[self.order]
        longest = math.sqrt(max(float((w[:, :-1] ** 2).sum(1).max(initial=0)) for w in (self.classes, self.words)))
        bias = max(float(np.abs(w[:, -1]).max(initial=0)) for w in (self.classes, self.words))
        found = [np.zeros(0, np.float32)]
        for h, t in parts:
            c = self.class_of[t]
            order = np.argsort(c.astype(np.int16), kind="stable")
            h = h.take(order, 0)
            safe = math.sqrt(float(np.einsum("nd,nd->n", h[:, :-1], h[:, :-1]).max(initial=0))) * longest + bias < 80  # no exponential overflows
            c, t = c[order], place[t[order]]
            got = np.empty(len(t), np.float32)
            for a in range(0, len(t), 1024):
                got[a : a + 1024] = _log_share(h[a : a + 1024] @ self.classes.T, c[a : a + 1024], safe)
            cuts = np.flatnonzero(np.r_[True, c[1:] != c[:-1], True])[: len(c) + 1]
            for a, b in zip(cuts, cuts[1:]):
                low, high = self.begin[c[a]], self.begin[c[a] + 1]
                if high - low == 1:
                    continue
                weights = by_class[low:high].T
                wide = max(1, (1 << 18) // (high - low))
                for i in range(a, b, wide):
                    j = min(b, i + wide)
                    got[i:j] += _log_share(h[i:j] @ weights, t[i:j] - low, safe)
            out = np.empty(len(t), np.float32)
            out[order] = got
            found.append(out)
        return np.concatenate(found)

    def update(self, stretches: np.ndarray, goal: np.ndarray, rng: np.random.Generator, rate: float) -> None:
        """One AdaGrad step of noise-contrastive estimation on a batch: of classes, and of outcomes among all.

        stretches: rows of neighbouring outcomes, of which all but the first CONTEXT are learnt where goal says so.
        An outcome's score among all is its score within its class but for a number that the whole class shares.
        """
        rows, wide = goal.shape
        n = int(goal.sum())
        vectors = self.seen.take(stretches, 0).reshape(rows, -1)
        shifted = [slice(WIDTH * (CONTEXT - k), WIDTH * (CONTEXT - k + wide)) for k in range(1, CONTEXT + 1)]
        seen = [vectors[:, x] for x in shifted]
        h = self.hidden(seen)
        idle = np.flatnonzero(~goal)
        h[idle] = 0  # then their gradients are 0
        targets = stretches[:, CONTEXT:].ravel()
        gh, grads = np.zeros((len(h), WIDTH), np.float32), []
        for k, own, table in ((0, self.class_of[targets], self.classes), (1, targets, self.words)):
            noise = np.minimum(np.searchsorted(self.drawn[k], rng.random(NOISE)), len(table) - 1)
            these, others, log_kp = table.take(own, 0), table.take(noise, 0), self.logs[k]
            true = np.einsum("nd,nd->n", h, these)
            true = -_sigmoid_of_negative(true - log_kp[own])  # the probability of noise, negative
            against = -others
            against[:, -1] += log_kp[noise]
            false = _sigmoid_of_negative(h @ against.T)
            gh += true[:, None] * these[:, :-1]
            gh += false @ others[:, :-1]
            grads.append(_scatter(np.concatenate([own, noise]), np.concatenate([true[:, None] * h, (h.T @ false).T])))
        gh[idle] = 0
        gh, mix = gh.reshape(rows, -1), np.tile(self.mix, wide)
        back = np.zeros_like(vectors)
        for k in range(CONTEXT):
            back[:, shifted[k]] += gh * mix[k]
        grads = [_scatter(stretches.ravel(), back.reshape(-1, WIDTH)), *grads]
        g_mix = np.stack([(gh * seen[k]).sum(0).reshape(wide, WIDTH).sum(0) for k in range(CONTEXT)])
        for p, (at, g), sq in zip(self.parameters(), (*grads, (np.arange(CONTEXT), g_mix)), self.squares):
            g /= n
            new = sq.take(at, 0)
            new += g * g
            _put(sq, at, new)
            np.sqrt(new, out=new)
            new += 1e-7
            g *= rate
            g /= new
            _put(p, at, p.take(at, 0) - g)


def _log_share(scores: np.ndarray, at: np.ndarray, safe: bool) -> np.ndarray:
    """log softmax of every row at one place; overwrites scores."""
    if not safe:
        scores -= scores.max(1, keepdims=True)
    wide = scores.shape[1]
    picked = scores.ravel().take(np.arange(0, wide * len(at), wide) + at)
    np.exp(scores, out=scores)
    return picked - np.log(scores @ np.ones(wide, np.float32))


def _put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """table[rows] = values, a row as one item."""
    item = np.dtype((np.void, table.strides[0]))
    table.view(item)[:, 0][rows] = np.ascontiguousarray(values).view(item)[:, 0]


def _scatter(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sums of their values)."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort
    ordered = rows[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[starts], np.add.reduceat(values.take(order, 0), starts)


def laid(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(stream of the documents' outcomes, which of them are predicted): each document is preceded by CONTEXT ends and ended by one, which two neighbours share."""
    parts = [np.zeros(CONTEXT, np.uint16)]
    rest = np.zeros(CONTEXT, np.uint16)
    for d in documents:
        parts += [d, rest]
    lengths = np.full((len(documents), 2), CONTEXT - 1)
    lengths[:, 0] = [len(d) + 1 for d in documents]
    goal = np.repeat(np.arange(2 * len(documents)) % 2 == 0, lengths.ravel())
    return np.concatenate(parts), np.r_[np.zeros(CONTEXT, bool), goal]


def windows(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(contexts CONTEXT x n, targets n) of documents of outcomes; each is preceded and ended by the end."""
    stream, goal = laid(documents)
    at = np.flatnonzero(goal)
    return np.stack([stream[at - k] for k in range(1, CONTEXT + 1)]), stream[at]


def train_stream(model: LogBilinear, documents: Iterator[np.ndarray], seed: int, rate: float = RATE) -> int:
    """One pass over a stream of documents of outcomes, in stretches of neighbours dealt at random to batches; the number of tokens."""
    rng = np.random.default_rng(seed)
    held: list[np.ndarray] = []
    total = waiting = 0
    places = np.arange(CONTEXT + STRETCH)

    def learn() -> None:
        stream, goal = laid(held)
        starts = STRETCH * rng.permutation(-(-(len(stream) - 2 * CONTEXT + 1) // STRETCH))  # the last CONTEXT - 1 are not predicted
        more = max(0, CONTEXT + STRETCH * len(starts) - len(stream))
        stream, goal = np.pad(stream, (0, more)), np.pad(goal, (0, more))
        for k in range(0, len(starts), max(1, BATCH // STRETCH)):
            at = starts[k : k + max(1, BATCH // STRETCH), None] + places
            model.update(stream[at], goal[at[:, CONTEXT:]], rng, rate)

    for d in documents:
        held.append(d)
        waiting += len(d) + 1
        total += len(d) + 1
        if waiting >= 1 << 15:
            learn()
            held, waiting = [], 0
    if held:
        learn()
    return total


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of stretches of these lengths, which may be 0."""
    out = np.zeros(len(lengths), values.dtype)
    some = lengths > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(lengths) - lengths)[some])
    return out


def numbered(df: DataFrame, words, learns: str, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: a document's outcomes and what its listed words give; and its words that are not listed.

    Column ``learns`` of df says which documents train.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = [id_col, "_learns", "_mark", "_row", "_ids", "n_tokens", "n_known", "base_score", "score", "_word", "_class", "_n"]
    kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = words.value
        base_all = math.log10(max(1, own.tokens + own.types + 1))
        log_counts, shares = np.log10(own.counts + 1.0), own.shares()
        at_row = TaskContext.get().partitionId() << 40
        find = own.listed.__getitem__
        class_of = own.listed_class
        for batch in batches:
            if not batch.num_rows:
                continue
            words_of = [tokens_of(x.as_py()) for x in batch.column(1).cast(pa.binary())]
            lengths = np.array([len(d) for d in words_of])
            ends = np.cumsum(lengths)
            rows = np.arange(at_row, at_row + len(lengths))
            at_row += len(lengths)
            d = list(chain.from_iterable(words_of))
            places = np.fromiter(map(find, d), np.int64, len(d))
            ids = places + 1
            listed_only = np.flatnonzero(places >= own.own)
            there = places[listed_only]
            ids[listed_only] = 1 + own.own + class_of[there]
            odd = np.flatnonzero(places < 0)
            spelt = [d[k] for k in odd.tolist()]
            number = {w: k for k, w in enumerate(dict.fromkeys(spelt))}
            spelling, which = list(number), np.fromiter(map(number.__getitem__, spelt), np.int64, len(spelt))
            rare_class = np.fromiter(map(own.rare_class, spelling), np.int64, len(spelling))
            ids[odd] = 1 + own.own + rare_class[which]
            known = np.zeros(len(places))
            known[places >= 0] = log_counts[places[places >= 0]]
            within = np.zeros(len(places))
            within[listed_only] = log_counts[there] - shares[class_of[there]]
            n = lengths + 1
            base = _sums(known, lengths) + math.log10(own.end + 1) - n * base_all
            packed = ids.astype("<u2").tobytes()
            held = [packed[2 * (e - k) : 2 * e] for e, k in zip(ends.tolist(), lengths.tolist())]
            n_known = _sums((places >= 0).astype(np.int64), lengths) + (own.end > 0)
            values = (batch.column(2), batch.column(3), rows, held, n, n_known, base, _sums(within, lengths), *[pa.nulls(len(n), t) for t in kinds[-3:]])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(values, kinds))], names)
            if len(odd):
                pairs, m = np.unique(np.repeat(np.arange(len(n)), lengths)[odd] * len(spelling) + which, return_counts=True)
                of, which = np.divmod(pairs, len(spelling))
                none = [pa.nulls(len(m), t) for t in kinds[:8]]
                none[2] = pa.array(rows[of])
                rare = (pa.array(spelling, pa.binary()).take(pa.array(which)), pa.array(rare_class[which], pa.int32()), pa.array(m, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.nulls(len(m), batch.column(0).type), *none, *rare], names)

    mark = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    schema = f"{id_col} {kind}, _learns boolean, _mark bigint, _row bigint, _ids binary, n_tokens bigint, n_known bigint, base_score double, score double, _word binary, _class int, _n bigint"
    return map_arrow(df.select(F.col(id_col), F.col(text_col), F.col(learns).alias("_learns"), mark.alias("_mark")), run, schema)


def train(documents: DataFrame, words) -> np.ndarray:
    """Parameters after one pass over kept documents (_mark, _ids): shards by hash, averages after each of ROUNDS parts."""
    own: Vocabulary = words.value
    class_of, frequency = own.class_of, own.frequency
    values = LogBilinear(class_of, frequency).flat()
    shards = max(1, min(MAX_SHARDS, own.tokens // SHARD_TOKENS))
    spark = documents.sparkSession

    def learn(given, turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out(shard: int, stream: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
                model = LogBilinear(class_of, frequency)
                model.set_flat(given.value)
                n = train_stream(model, stream, MAX_SHARDS * turn + shard)
                after = model.flat()
                for k in range(0, len(after), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([float(n)]), pa.array([after[k : k + CHUNK].tobytes()])], ["at", "n", "part"])

            rows = ((s.as_py(), np.frombuffer(i.as_py(), "<u2")) for batch in batches for s, i in zip(batch.column(0), batch.column(1)))
            for shard, group in groupby(rows, lambda r: r[0]):
                yield from out(shard, (ids for _, ids in group))

        return run

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for at, n, part in zip(*batch.columns):
                held = sums.setdefault(at.as_py(), [0.0, 0.0])
                held[0] += n.as_py()
                held[1] = held[1] + n.as_py() * np.frombuffer(part.as_py(), np.float32).astype(np.float64)
        for at, (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([n]), pa.array([(total / n).astype(np.float32).tobytes()])], ["at", "n", "part"])

    dealt = documents.select(F.pmod("_mark", F.lit(shards)).alias("shard"), "_ids", "_mark", F.pmod(F.shiftright("_mark", 20), F.lit(ROUNDS)).alias("turn"))
    for turn in range(ROUNDS):
        given = spark.sparkContext.broadcast(values)
        part = dealt.filter(F.col("turn") == turn).repartition(shards, "shard").sortWithinPartitions("shard", "_mark", "_ids").select("shard", "_ids")
        learned = map_arrow(part, learn(given, turn), "at bigint, n double, part binary")
        # sums in an order that does not depend on the layout
        found = map_arrow(learned.repartition("at").sortWithinPartitions("at", "n", "part"), average, "at bigint, n double, part binary").toArrow()
        values = values.copy()
        for at, part in zip(found.column("at").to_pylist(), found.column("part").to_pylist()):
            values[at : at + CHUNK] = np.frombuffer(part, np.float32)
        given.unpersist()
    return values


def scored(documents: DataFrame, words, parameters, id_col: str) -> DataFrame:
    """Documents of ``numbered`` with their outcomes' log10 probabilities added to ``score``."""
    kept = [id_col, "_row", "n_tokens", "n_known", "base_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Vocabulary = words.value
        model = LogBilinear(own.class_of, own.frequency)
        model.set_flat(parameters.value)
        for batch in batches:
            got = np.zeros(batch.num_rows)
            ids = [np.frombuffer(x.as_py(), "<u2") for x in batch.column("_ids")]
            ends = np.cumsum([len(x) + 1 for x in ids])
            at = 0
            while at < len(ids):  # documents of SCORED tokens together
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SCORED, "right")))
                logs = model.log_probabilities_of(ids[at:to]).astype(np.float64) / math.log(10)
                got[at:to] = np.add.reduceat(logs, np.r_[0, ends[at : to - 1] - (ends[at - 1] if at else 0)])
                at = to
            columns = [batch.column(c) for c in kept[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(got + batch.column("score").to_numpy())], kept)

    kind = documents.schema[id_col].dataType.simpleString()
    return map_arrow(documents.select("_ids", *kept), run, f"{id_col} {kind}, _row bigint, n_tokens bigint, n_known bigint, base_score double, score double")


def assess(df: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score, train_tokens) of all rows of df, under the model of the rows where ``learns``."""
    spark = df.sparkSession
    scratch = Scratch(spark)
    docs = df.select(F.col(id_col), F.col(text_col), F.coalesce(learns, F.lit(False)).alias("_learns"))
    counts = scratch.keep(with_endings(count_tokens(docs.filter("_learns"), text_col)))
    words = spark.sparkContext.broadcast(vocabulary(counts))
    own: Vocabulary = words.value
    both = scratch.keep(numbered(docs, words, "_learns", id_col, text_col))
    documents, rare = both.filter("n_tokens is not null"), both.filter("_word is not null").select("_row", "_word", "_class", "_n")
    parameters = spark.sparkContext.broadcast(train(documents.filter("_learns"), words))
    whole = scored(documents, words, parameters, id_col)
    shares = F.array(*(F.lit(float(x)) for x in own.shares()))
    joined = rare.join(counts.select(F.col("word").alias("_word"), F.col("n").alias("_count")), "_word", "left")
    seen = F.coalesce("_count", F.lit(0))
    log_count = F.log10(seen + 1.0)
    more = joined.groupBy("_row").agg(
        F.sum(F.when(seen > 0, F.col("_n")).otherwise(0)).alias("_known"), F.sum(F.col("_n") * log_count).alias("_base"), F.sum(F.col("_n") * (log_count - shares[F.col("_class")])).alias("_score")
    )
    add = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    out = whole.join(more, "_row", "left").select(id_col, "n_tokens", add("n_known", "_known"), add("base_score", "_base"), add("score", "_score"))
    return out.withColumn("train_tokens", F.lit(own.tokens).cast("bigint"))


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_mod("doc_id", 7) == 2
    return assess(docs, ~held).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
