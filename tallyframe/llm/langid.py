"""Language identification by sparse multinomial logistic regression.

Features are hashed character 1- to 3-grams of the lower-cased whole text
(runs of non-letters become one mark), weighted by (1 + log tf) * idf and
scaled to length 1.  The weights are learned with follow-the-regularised-
leader (FTRL-proximal) under an elastic-net penalty, so most of them are
zero; a temperature fitted on rows kept out of the updates calibrates the
probabilities.

The model is fitted on at most ``max_train`` labelled rows, taken in hash
order of the id from the eligible ones; the weight table has a fixed size,
which bounds what is sent to the executors.

Cases: a null text or one without a letter is ``und`` with score 0; labels
that are null are not learned; without any label every text is ``und``; ties
go to the label that sorts first; repeated rows score alike; an empty table
stays empty; extra columns are ignored by ``score_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, release, table

BUCKET_BITS = 15
MAX_TRAIN = 6000
UNDETERMINED = "und"
#: Code points handled at once; longer texts go in overlapping pieces.
PIECE = 1 << 20
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself for letters, else 0."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of a text; None without a letter."""
    if not text:
        return None
    points = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
    if not points.any():
        return None
    gap = points == 0
    keep = ~gap
    keep[1:] |= ~gap[:-1]  # one mark for a run of non-letters
    points = points[keep]
    points = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
    counts, shift = np.zeros(1 << BUCKET_BITS, np.int64), np.uint32(32 - BUCKET_BITS)
    for k in range(0, max(1, len(points) - 2), PIECE):
        part = points[k : k + PIECE + 2]
        one = part * _MIX[0]
        two = (one[:-1] ^ (part[1:] + _MIX[1])) * _MIX[2]
        three = (two[:-1] ^ (part[2:] + _MIX[0])) * _MIX[1]
        n = min(PIECE, len(part))
        for h in (one[:n], two[:n], three[:n]):
            counts += np.bincount((h ^ (h >> np.uint32(15))) * _MIX[0] >> shift, minlength=len(counts))
    buckets = np.flatnonzero(counts)
    return buckets, counts[buckets]


@dataclass
class LanguageModel:
    labels: list[str]
    weights: np.ndarray  # buckets x labels
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def vector(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[buckets]
        return (x / max(np.sqrt(x @ x), 1e-12)).astype(np.float32)

    def probabilities(self, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logits = (self.vector(buckets, counts) @ self.weights[buckets] + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        got = ngram_counts(text) if self.labels else None
        if got is None:
            return UNDETERMINED, 0.0
        p = self.probabilities(*got)
        k = int(p.argmax())
        return self.labels[k], float(p[k])


def fit(rows: list[tuple], epochs: int = 3, alpha: float = 2.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-4, seed: int = 7) -> LanguageModel:
    """FTRL-proximal over rows of (buckets, counts, label); every fifth row calibrates the temperature."""
    size = 1 << BUCKET_BITS
    labels = sorted({r[2] for r in rows})
    n_labels = max(1, len(labels))
    seen = np.zeros(size)
    for buckets, _, _ in rows:
        seen[buckets] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    model = LanguageModel(labels, np.zeros((size, n_labels), np.float32), np.zeros(n_labels, np.float32), idf, 1.0)
    if not rows:
        return model
    index = {x: k for k, x in enumerate(labels)}
    vectors = [(b, model.vector(b, c), index[y]) for b, c, y in rows]
    fit_rows = [v for i, v in enumerate(vectors) if i % 5] or vectors
    held = [v for i, v in enumerate(vectors) if i % 5 == 0]
    z, n = np.zeros((size, n_labels)), np.zeros((size, n_labels))
    bias, rng = np.zeros(n_labels), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(fit_rows)):
            b, x, y = fit_rows[i]
            zb, nb = z[b], n[b]
            w = np.where(np.abs(zb) <= l1, 0, (np.sign(zb) * l1 - zb) / ((beta + np.sqrt(nb)) / alpha + l2))
            logits = x @ w + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            grown = nb + g * g
            z[b] = zb + g - (np.sqrt(grown) - np.sqrt(nb)) / alpha * w
            n[b] = grown
            bias -= 0.02 * p
    model.weights = np.where(np.abs(z) <= l1, 0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2)).astype(np.float32)
    model.bias = bias.astype(np.float32)
    logits = np.array([x @ model.weights[b] + model.bias for b, x, _ in held])
    truth = np.array([y for _, _, y in held])

    def loss(t: float) -> float:
        s = logits / t
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

    model.temperature = min(np.geomspace(0.05, 5, 60).tolist(), key=loss)
    return model


def train(df: DataFrame, id_col: str, text_col: str, label_col: str, max_train: int = MAX_TRAIN) -> LanguageModel:
    """Fit on at most ``max_train`` rows with a label, in hash order of the id."""
    rank = F.xxhash64(F.col(id_col).cast("string"))
    own = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    last = own.select(rank.alias("rank")).orderBy("rank").limit(max_train).agg(F.max("rank")).first()[0]
    if last is None:
        return fit([])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [ngram_counts(t.as_py()) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([None if g is None else g[0] for g in got], pa.list_(pa.int32())), pa.array([None if g is None else g[1] for g in got], pa.list_(pa.int32())), batch.column(2).cast(pa.string())],
            ["rank", "buckets", "counts", "label"],
        )

    sample = own.filter(rank <= F.lit(last)).select(rank.alias("rank"), text_col, label_col)
    rows = map_batches(sample, run, "rank bigint, buckets array<int>, counts array<int>, label string").filter("buckets is not null").toArrow().sort_by([("rank", "ascending"), ("label", "ascending")])
    columns = [rows.column(c).combine_chunks() for c in ("buckets", "counts")]
    model = fit([(b.values.to_numpy(), c.values.to_numpy(), y.as_py()) for b, c, y in zip(*columns, rows.column("label"))][:max_train])
    del rows, columns
    release()
    return model


def score_documents(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [model.predict(t.as_py()) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], [id_col, "lang_pred", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run, f"{id_col} {kind}, lang_pred string, score double")


def keep_identified(df: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows whose text has a language with a probability of ``least``; all columns stay as they are."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index(text_col))
        return batch.filter(pa.array([label != UNDETERMINED and p >= least for label, p in (model.predict(t.as_py()) for t in texts)], pa.bool_()))

    return map_batches(df, run, df.schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(crc_mod("doc_id", 4) != 2), "doc_id", "text", "lang")
    held = crc_mod("doc_id", 4) == 2
    return score_documents(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")
