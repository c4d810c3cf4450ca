"""A byte-level convolutional quality classifier in numpy.

Every byte has a learned embedding.  Filters see chunks of two neighbouring
blocks of 16 bytes; chunks overlap by one block and cover the document from
its first byte to its last (the end is padded with a byte value of its own).
Each filter's largest response over the document goes through a rectifier,
and a logistic unit combines them into one probability.

Only the chunk with the largest response of a filter gets a gradient, so
training costs little more than scoring.  It uses at most ``max_train``
labelled rows in hash order of the id, of at most ``max_bytes`` bytes each
(longer ones are left to scoring); both bound the driver's memory.

Cases: a null or empty text is one chunk of padding; labels that are null are
not learned; without labels every score is 0.5; repeated rows score alike;
an empty table stays empty; texts of any length are scored whole, block by
block; extra columns are ignored by ``score_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, map_batches, release, table

MAX_TRAIN = 5000
MAX_BYTES = 1 << 15
BLOCK, WIDTH, FILTERS = 16, 8, 32
PAD = 256
#: Blocks whose responses are held at once.
STEP = 1 << 14


def blocks_of(text: str | None) -> np.ndarray:
    """(n, 16) byte values; the last chunk is completed with padding."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(raw) // BLOCK)) + 1
    out = np.full(n * BLOCK, PAD, np.int16)
    out[: len(raw)] = raw
    return out.reshape(n, BLOCK)


@dataclass
class QualityNet:
    embedding: np.ndarray  # 257 x WIDTH
    first: np.ndarray  # BLOCK * WIDTH x FILTERS, for a chunk's first block
    second: np.ndarray
    offset: np.ndarray
    mix: np.ndarray
    bias: float

    def responses(self, blocks: np.ndarray) -> np.ndarray:
        """Filter responses of the chunks of one run of blocks."""
        x = self.embedding[blocks].reshape(len(blocks), -1)
        return x[:-1] @ self.first + x[1:] @ self.second

    def pooled(self, texts: list[np.ndarray]) -> np.ndarray:
        """The largest response of every filter in each text."""
        out = np.full((len(texts), FILTERS), -np.inf, np.float32)
        run, rows, total = [], [], 0

        def flush():
            nonlocal run, rows, total
            if run:
                r = self.responses(np.concatenate(run))
                starts = np.cumsum([0, *(len(b) for b in run[:-1])])
                # chunks that would span two texts end each run but the last
                ends = np.cumsum([len(b) for b in run])[:-1] - 1
                r[ends] = -np.inf
                np.maximum.at(out, rows, np.maximum.reduceat(r, starts))
            run, rows, total = [], [], 0

        for i, blocks in enumerate(texts):
            for k in range(0, len(blocks) - 1, STEP):
                part = blocks[k : k + STEP + 1]
                if total + len(part) > STEP:
                    flush()
                run.append(part)
                rows.append(i)
                total += len(part)
        flush()
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        hidden = np.maximum(self.pooled([blocks_of(t) for t in texts]) + self.offset, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.mix + self.bias, -30, 30).astype(np.float64)))


def fit(rows: list[tuple[str, int]], epochs: int = 8, batch: int = 32, rate: float = 4e-3, seed: int = 11) -> QualityNet:
    """Adam on the logistic loss, both labels weighted towards balance."""
    rng = np.random.default_rng(seed)
    scale = (BLOCK * WIDTH * 2) ** -0.5
    p = {
        "embedding": rng.normal(0, 1, (257, WIDTH)), "first": rng.normal(0, scale, (BLOCK * WIDTH, FILTERS)), "second": rng.normal(0, scale, (BLOCK * WIDTH, FILTERS)),
        "offset": np.zeros(FILTERS), "mix": rng.normal(0, FILTERS**-0.5, FILTERS), "bias": np.zeros(1),
    }
    p = {k: v.astype(np.float32) for k, v in p.items()}
    if len({y for _, y in rows}) < 2:
        p["mix"][:] = 0
        p["bias"][:] = 0 if not rows else 4 if rows[0][1] else -4
        return QualityNet(p["embedding"], p["first"], p["second"], p["offset"], p["mix"], float(p["bias"][0]))
    blocks, truth = [blocks_of(t) for t, _ in rows], np.array([y for _, y in rows], np.float32)
    share = truth.mean()
    weight = np.where(truth > 0, 1.0, np.sqrt(share / (1 - share))).astype(np.float32)
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    steps, total = 0, epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            ids = order[at : at + batch]
            own = np.concatenate([blocks[i] for i in ids])
            lengths = np.array([len(blocks[i]) for i in ids])
            starts = np.cumsum(lengths) - lengths
            x = p["embedding"][own].reshape(len(own), -1)
            r = x[:-1] @ p["first"] + x[1:] @ p["second"]
            best = np.stack([s + r[s : s + n - 1].argmax(0) for s, n in zip(starts, lengths)])  # texts x filters
            top = r[best, np.arange(FILTERS)]
            hidden = top + p["offset"]
            active = (hidden > 0).astype(np.float32)
            hidden *= active
            out = 1 / (1 + np.exp(-np.clip(hidden @ p["mix"] + p["bias"], -30, 30)))
            g = (out - truth[ids]) * weight[ids] / len(ids)
            gh = g[:, None] * p["mix"] * active
            grads = {"mix": hidden.T @ g, "bias": g.sum(keepdims=True), "offset": gh.sum(0)}
            ge = np.zeros_like(p["embedding"])
            for name, shift in (("first", 0), ("second", 1)):
                seen = x[best + shift]  # texts x filters x inputs
                grads[name] = np.einsum("bfi,bf->if", seen, gh)
                back = gh[..., None] * p[name].T  # texts x filters x inputs
                flat, bytes_ = back.reshape(-1, WIDTH), own[best + shift].reshape(-1)
                for d in range(WIDTH):
                    ge[:, d] += np.bincount(bytes_, flat[:, d], 257)
            grads["embedding"] = ge
            steps += 1
            now = rate * (1 - steps / (total + 1))
            for k, d in grads.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.001 * (d * d - v[k])
                p[k] -= (now * (m[k] / (1 - 0.9**steps)) / (np.sqrt(v[k] / (1 - 0.999**steps)) + 1e-8)).astype(np.float32)
    return QualityNet(p["embedding"], p["first"], p["second"], p["offset"], p["mix"], float(p["bias"][0]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN, max_bytes: int = MAX_BYTES) -> QualityNet:
    """Fit on at most ``max_train`` labelled rows; the broadcast side has that many ids at most."""
    own = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label"), F.xxhash64(F.col(id_col).cast("string")).alias("_rank"))
    sample = own.orderBy("_rank", "_label").limit(max_train)
    found = docs.filter(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) <= max_bytes).select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    got = found.join(F.broadcast(sample), "_id").select("_rank", "_label", "_text").toArrow().sort_by([("_rank", "ascending"), ("_label", "ascending"), ("_text", "ascending")])
    net = fit(list(zip(got.column("_text").to_pylist(), got.column("_label").to_pylist()))[:max_train])
    del got
    release()
    return net


def score_documents(df: DataFrame, net: QualityNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(net, batch.column(1)), pa.float64())], [id_col, "score"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run, f"{id_col} {kind}, score double")


def _scores(net: QualityNet, column: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0), *(net.scores([t.as_py() for t in column.slice(k, 256)]) for k in range(0, len(column), 256))])


def keep_good(df: DataFrame, net: QualityNet, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows with a score of ``least``; all columns stay as they are."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_scores(net, batch.column(batch.schema.get_field_index(text_col))) >= least))

    return map_batches(df, run, df.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2))
    scored = score_documents(docs, net)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
