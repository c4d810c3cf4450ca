"""N-gram Jaccard self-join with signature trees.

A document is the set of its distinct five-word shingles (64-bit hashes).
Equal sets are one node.  Every node has ``BANDS`` keys, each made of ``ROWS``
min-hashes; two sets of similarity s share none with probability
(1 - s ** ROWS) ** BANDS, which at s = 0.8 is 4e-8, while sets of similarity
0.2 share one with probability 0.18 in all.  The members of a bucket (one key)
form a signature tree: leaves of ``LEAF`` nodes, every tree node with the OR
of its members' token bitmaps and the range of their sizes.  A traversal of
pairs of tree nodes drops a pair when its sizes cannot reach the threshold,
when the common bits plus the tokens that share bits cannot reach the overlap
that the smallest sizes need, or when all its members are linked already.
Members of a bucket are taken by size, so that a tree's sizes differ by less
than a factor of 1.25 ** 2 and its bitmaps have about ``DENSITY`` bits a token.
What is left is verified on the full sets.

How buckets of any size are searched, and how links become components, is
described in ``linking``.

Cases: a text without words (null, empty) has an empty set and links with
nothing; a text of fewer than five words is one shingle; a component is named
by the smallest id in it, null if none of its rows has one; rows of one id and
different texts belong each to its own text's component; ids may be of any
type that has an order; an empty table gives no rows; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_batches, table
from .hashing import ODD, mix, word_hashes
from .linking import link, sized

SHINGLE, THRESHOLD_NUM, THRESHOLD_DEN = 5, 80, 100
BANDS, ROWS, LEAF, FAN = 24, 3, 16, 8
#: Bits of a bitmap: the least, and a token's share.
BITS, DENSITY = 64, 8
_SEEDS = np.random.default_rng(97).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_MORE = np.random.default_rng(98).integers(1, 2**63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x2545F4914F6CDD1D) + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def describe(own: np.ndarray) -> tuple[int, np.ndarray, bytes]:
    """(hash of the set, bucket keys, bitmap of DENSITY bits or more per token)."""
    name = int(mix(np.add.reduce(mix(own), keepdims=True) + np.array([len(own)], np.uint64) * ODD).view(np.int64)[0])
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for k in range(0, len(own), 1024):
        part = own[k : k + 1024]
        low = np.minimum(low, ((part[None, :] ^ _MORE[:, None]) * _SEEDS[:, None]).min(1))
    # the smallest values name ROWS tokens; mixed with the number of their band they are a bucket
    keys = np.arange(BANDS, dtype=np.uint64) * ODD
    for column in low.reshape(BANDS, ROWS).T:
        keys = mix(keys * np.uint64(0x2545F4914F6CDD1D) + column)
    size = max(BITS, 1 << (DENSITY * len(own) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[own % np.uint64(size)] = 1
    return name, keys.view(np.int64), np.packbits(bits, bitorder="little").tobytes()


def fold(bitmap: bytes, size: int) -> bytes:
    """A bitmap with its bits taken modulo a smaller power of two."""
    if len(bitmap) * 8 == size:
        return bitmap
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint8).reshape(-1, size // 8), 0).tobytes()


def _overlap_needed(a, b):
    """100 * o >= 80 * (a + b - o), as a lower bound on o times 180."""
    return THRESHOLD_NUM * (a + b)


class SignatureTree:
    """Levels from the leaves up: OR of bitmaps, smallest and largest size, most tokens beyond the bits, range of components."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, components: np.ndarray | None = None, levels: bool = True):
        bits = np.bitwise_count(bitmaps).sum(1).astype(np.int64)
        own = np.arange(len(sizes)) if components is None else components
        level = (bitmaps, sizes, sizes, sizes - bits, own, own)
        self.levels = [level]
        fan = LEAF
        while levels and len(level[1]) > 1:
            at = np.arange(0, len(level[1]), fan)
            kinds = (np.bitwise_or, np.minimum, np.maximum, np.maximum, np.minimum, np.maximum)
            level = tuple(f.reduceat(x, at, 0) for f, x in zip(kinds, level))
            self.levels.append(level)
            fan = FAN
        self.fans = [LEAF] + [FAN] * (len(self.levels) - 2)

    def possible(self, depth: int, x: np.ndarray, y: np.ndarray, step: int = 1 << 21) -> np.ndarray:
        """Which pairs of tree nodes may hold a pair to link; ``step`` words of bitmaps are compared at once."""
        bits, low, high, beyond, first, last = self.levels[depth]
        keep = np.zeros(len(x), bool)
        step = max(1, step // bits.shape[1])
        for k in range(0, len(x), step):
            a, b = x[k : k + step], y[k : k + step]
            ok = (THRESHOLD_DEN * high[a] >= THRESHOLD_NUM * low[b]) & (THRESHOLD_DEN * high[b] >= THRESHOLD_NUM * low[a])
            ok &= (first[a] != last[b]) | (first[b] != last[a]) if depth else first[a] != first[b]
            a, b = a[ok], b[ok]
            common = np.bitwise_count(bits[a] & bits[b]).sum(1).astype(np.int64)
            most = common + np.minimum(beyond[a], beyond[b])
            ok[ok] = (THRESHOLD_NUM + THRESHOLD_DEN) * most >= _overlap_needed(low[a], low[b])
            keep[k : k + step] = ok
        return keep

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Members x < y that may reach the threshold: a traversal of pairs of tree nodes from the root."""
        x = y = np.zeros(1, np.int64)
        for depth in range(len(self.levels) - 1, 0, -1):
            keep = self.possible(depth, x, y)
            x, y, fan, n = x[keep], y[keep], self.fans[depth - 1], len(self.levels[depth - 1][1])
            parts = []
            for k in range(0, len(x), 2048):
                a = (x[k : k + 2048, None, None] * fan + np.arange(fan)[:, None]).repeat(fan, 2)
                b = (y[k : k + 2048, None, None] * fan + np.arange(fan)[None, :]).repeat(fan, 1)
                a, b = a.ravel(), b.ravel()
                ok = (a < n) & (b < n) & ((a < b) if depth == 1 else (a <= b))
                a, b = a[ok], b[ok]
                if depth == 1:
                    ok = self.possible(0, a, b)
                    a, b = a[ok], b[ok]
                parts.append((a, b))
            x = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
            y = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        return (x, y) if len(self.levels) > 1 else (x[:0], y[:0])


def search(cols: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one unit that may reach the threshold: a signature tree for every two neighbouring classes of size."""
    unit, sizes, sketch = cols["unit"], cols["n"].astype(np.int64), cols["sketch"]
    classes = np.floor(np.log(np.maximum(sizes, 1)) / np.log(1.25) + 1e-9).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(unit)]):
        order = s + np.lexsort((sizes[s:e], cols["component"][s:e], classes[s:e]))
        own = classes[order]
        for c in np.unique(own).tolist():
            low, middle, high = np.searchsorted(own, [c, c + 1, c + 2])
            rows = order[low:high]
            if len(rows) < 2 or cols["component"][rows].min() == cols["component"][rows].max():
                continue
            least = min(len(sketch[r]) for r in rows) * 8
            bitmaps = np.frombuffer(b"".join(fold(sketch[r], least) for r in rows), np.uint64).reshape(len(rows), -1)
            x, y = SignatureTree(sizes[rows], bitmaps, cols["component"][rows]).pairs()
            new = np.minimum(x, y) < middle - low  # two of the larger class meet in that class's own tree
            yield rows[x[new]], rows[y[new]]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k, text): k is a hash of the text, null for a null text."""
    text = F.col(text_col)
    return df.select(F.col(id_col).alias("id"), F.when(text.isNotNull(), F.xxhash64(text)).alias("k"), text.alias("text"))


def described(docs: DataFrame) -> DataFrame:
    """docs (id, k, text) -> (id, k, n, name, keys, bitmap); all but id, k and n are null for empty sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, names, keys, bitmaps = [], [], [], []
        for text in batch.column(2):
            own = shingles(text.as_py())
            name, key, bitmap = describe(own) if len(own) else (None, None, None)
            n.append(len(own))
            names.append(name)
            keys.append(key)
            bitmaps.append(bitmap)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(names, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(bitmaps, pa.binary())], ["id", "k", "n", "name", "keys", "bitmap"])

    return map_batches(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, k bigint, n bigint, name bigint, keys array<bigint>, bitmap binary")


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps do not rule out."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for n_a, a, n_b, b in zip(*(batch.column(c) for c in (2, 3, 4, 5))):
            n_a, n_b = n_a.as_py(), n_b.as_py()
            if THRESHOLD_DEN * n_a < THRESHOLD_NUM * n_b or THRESHOLD_DEN * n_b < THRESHOLD_NUM * n_a:
                keep.append(False)
                continue
            a, b = a.as_py(), b.as_py()
            size = 8 * min(len(a), len(b))
            x, y = (np.frombuffer(fold(m, size), np.uint64) for m in (a, b))
            most = int(np.bitwise_count(x & y).sum()) + min(n_a - int(np.bitwise_count(x).sum()), n_b - int(np.bitwise_count(y).sum()))
            keep.append((THRESHOLD_NUM + THRESHOLD_DEN) * most >= _overlap_needed(n_a, n_b))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: nodes.select(F.col("name").alias(c), F.col("n").alias(f"_n_{c}"), F.col("bitmap").alias(f"_m_{c}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_n_a", "_m_a", "_n_b", "_m_b")
    return map_batches(joined, run, "a bigint, b bigint")


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [shingles(text.as_py()).tobytes() for text in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["node", "own"])

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)
            common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
            keep.append(THRESHOLD_DEN * common >= THRESHOLD_NUM * (len(x) + len(y) - common))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    near = scratch.keep(_possible(pairs, nodes))
    needed = near.select(F.explode(F.array("a", "b")).alias("name")).distinct().join(nodes.select("name", "id", "k"), "name")
    needed = scratch.keep(needed.select("name", F.col("id").alias("_id"), F.col("k").alias("_k")))
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("k").eqNullSafe(F.col("_k"))
    # rows of one id and one text are one
    full = map_batches(docs.join(sized(needed), same).select("name", "text"), sets, "node bigint, own binary")
    full = scratch.keep(full.groupBy("node").agg(F.first("own").alias("own")))
    side = lambda c: full.select(F.col("node").alias(c), F.col("own").alias(f"_{c}"))
    joined = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", "_a", "_b")
    links = scratch.keep(map_batches(joined, check, "a bigint, b bigint"))
    scratch.drop(near, needed, full)
    return links


def labelled(df: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """(id, k, n, component, component_id) of every row: the component's own name (null for an empty set) and smallest id."""
    docs = keyed(df, id_col, text_col)
    rows = scratch.keep(described(docs))
    nodes = rows.filter("name is not null").groupBy("name").agg(F.min(F.struct("id", "k")).alias("at"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("bitmap").alias("bitmap"))
    nodes = scratch.keep(nodes.select("name", "at.id", "at.k", "least", "n", "keys", "bitmap"))
    members = nodes.select(F.explode("keys").alias("g"), F.col("name").alias("node"))
    found = link(members, lambda pairs: _verified(pairs, docs, nodes, scratch), nodes.select(F.col("name").alias("node"), "n", "keys", F.col("bitmap").alias("sketch")), search, scratch)
    named = nodes.select("name", "least").join(found.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    places = scratch.keep(named.select("name", "component").join(smallest, "component"))
    return rows.select("id", "k", "n", "name").join(places, "name", "left")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row; the component is the smallest id that links reach."""
    found = labelled(df, id_col, text_col, Scratch(df.sparkSession))
    component = F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: of its smallest id, and there of the smallest text hash.

    Rows without words are components of their own and stay; rows of one id and one text stay once.  Columns stay as they are.
    """
    scratch = Scratch(df.sparkSession)
    found = labelled(df, id_col, text_col, scratch)
    rows = scratch.keep(found.groupBy("id", "k").agg(F.first("component").alias("component"), F.count(F.lit(1)).alias("n")))
    # nulls last: a row without an id stays only where no other can
    order = lambda c: F.struct(F.col("id").isNull().alias("none"), "id", "k").alias(c)
    best = rows.filter("component is not null").groupBy("component").agg(F.min(order("best")).alias("best"))
    lost = rows.join(best, "component").filter(~(F.col("id").eqNullSafe(F.col("best.id")) & F.col("k").eqNullSafe(F.col("best.k"))))
    lost = scratch.keep(lost.select(F.col("id").alias("id"), "k"))
    again = scratch.keep(rows.filter("n > 1").select("id", "k").join(lost, ["id", "k"], "left_anti"))
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"), F.when(F.col(text_col).isNotNull(), F.xxhash64(text_col)).alias("k"))
    same = lambda side: F.col("d.id").eqNullSafe(F.col(f"{side}.id")) & F.col("d.k").eqNullSafe(F.col(f"{side}.k"))
    left = packed.alias("d").join(sized(lost).alias("l"), same("l"), "left_anti")
    if not again.isEmpty():
        left = left.alias("d")
        several = left.join(sized(again).alias("r"), same("r"), "left_semi").groupBy("d.id", "d.k").agg(F.first("d.row").alias("row"))
        left = left.join(sized(again).alias("r"), same("r"), "left_anti").select("d.row").unionByName(several.select("row"))
    return left.select("row.*")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY k) AS r FROM sets),
own AS (SELECT s.doc_id, s.g FROM s JOIN rep ON s.doc_id = rep.r AND rep.doc_id = rep.r),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM own a JOIN own b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT DISTINCT r, r FROM rep UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
c AS (SELECT x, min(y) AS component FROM r GROUP BY x)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component, t.doc_id) AS component_id
FROM t LEFT JOIN n USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN c ON c.x = rep.r
"""
