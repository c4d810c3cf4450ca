"""Fuzzy line deduplication.

Lines are normalised (ASCII lower case, digits alike, punctuation as space,
single blanks).  Equal lines are one node.  A line's n-grams are sampled:
those that begin at a word, at a letter of three bytes or more, or where a hash says so
(every one of a short line).  Its 64-bit SimHash is the majority of their
hashes.  Its blocks are ``BANDS`` keys, each made of the smallest hashes of
``ROWS`` n-grams: by the pigeonhole principle an edit spoils only the blocks
that sampled an n-gram over it, and lines that agree in one block meet.  Of
these, lines within ``RADIUS`` bits of SimHash and a factor 0.8 of length are
verified by edit similarity, links become groups, and the first occurrence of
a group (smallest id, then line) stays.  Blocks cut from the SimHash itself
would need a radius of 3 bits and miss most lines at similarity 0.8; the
README has the measured recall of either form.

Lines of up to ``SHORT`` characters also meet on their text less one
character, which finds every pair one edit apart.

Blocks travel as packed arrays: a task that reads texts deals its lines' blocks
to parts by hash, a task that has a part sorts them and names the pairs.  A
block that many lines of one reading task share is gathered there, and only
its first line goes to the part.  Groups of three and more are searched across
components once more (``linking.across_components``), so that no pair of lines
with a common block escapes.

Every line with a letter or digit takes part, however short; a line of a
script that writes no blanks is one word.

Cases: null and empty texts have no lines to lose; a null id sorts first;
rows of one id and one text are one document, and lose or keep the same
lines; a line that repeats within its document keeps its first occurrence;
extra columns stay as they are, whatever their names, but one named
``removed_lines`` is replaced; an empty table stays empty.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, estimated_bytes, map_arrow, table
from .hashing import ODD, mix
from .linking import across_components, connected_components, sized

SIMILARITY = 0.8
#: Blocks of a line, and n-grams in a block.
BANDS, ROWS = 20, 3
#: Bits of SimHash that lines of a block may differ in.
RADIUS = 24
#: Bytes of an n-gram, and the least and most bytes of the lines that it serves: two similar lines have one kind in common.
KINDS = ((4, 8, 100), (8, 80, None))
#: Characters up to which lines meet on their text less one character.
SHORT = 12
#: A logarithmic code of lengths: the difference that a factor 0.8 allows, and the code of keys that stand for themselves.
LENGTH, FACTOR, ANY = 2800, 626, 65535
#: Bytes of lines that are signed at once, and whose blocks are dealt out together.
SIGNED, DEALT = 1 << 19, 1 << 22
#: Hashes whose bits are counted together.
COUNTED = 8192
#: Lines of one block that a reading task gathers itself; members that are compared at once with those after them.
GATHERED, LAGS = 8, 64
#: Input bytes for a part, and the most parts.
PART_BYTES, PARTS = 8 << 20, 1 << 20
#: Pairs whose texts are compared together, and their bytes.
TESTED, TESTED_BYTES = 1 << 13, 1 << 24
#: Hashes of lines that a task remembers, so as not to sign a line twice.
REMEMBERED = 1 << 19
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c if c >= 128 or 97 <= c <= 122 or c == 10 else 32 for c in range(256))
_FACTORS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * ODD) | np.uint64(1)
#: The bits of a byte in eight bytes.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()
_BLOCK = np.dtype([("key", "<u4"), ("node", "<i8"), ("sim", "<u8"), ("size", "<u2"), ("more", "u1")])
_GATHERED = np.dtype([("g", "<i8"), ("node", "<i8"), ("sim", "<u8"), ("size", "<u2")])


def normalised(text: str | bytes | None) -> list[bytes]:
    """The lines of a text with single blanks; a line without a letter or digit is empty."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    return [b" ".join(x.split()) if b"  " in x else x.strip() for x in raw.translate(_TABLE).split(b"\n")]


def line_hash(line: bytes) -> int:
    return int.from_bytes(blake2b(line, digest_size=8).digest(), "little", signed=True)


def without_one(text: str) -> list[int]:
    """Hashes of a text and of the text less any one character."""
    return [line_hash(x.encode("utf-8", "surrogatepass")) for x in sorted({text, *(text[:i] + text[i + 1 :] for i in range(len(text)))})]


def grams(lines: list[bytes], n: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the sampled n-grams of all lines, place of each line's first); every line has one at least.  n is 8 at most."""
    end = b"\n" + bytes(8)  # n-grams reach over a line's end, where all lines look alike
    data = np.frombuffer(b"".join([x + end for x in lines]), np.uint8)
    begin = np.cumsum([0, *(len(x) + len(end) for x in lines[:-1])])
    size = len(data) - 8
    here = data[:size]
    at = here > 32  # neither blank nor end
    if not every:
        start = here >= 0xE0
        start[1:] |= here[:-1] == 32
        spot = here * np.uint8(37) ^ data[1 : size + 1] * np.uint8(101) ^ data[2 : size + 2] * np.uint8(59)
        at &= start | (spot < 32)
    at[begin] = True
    places = np.flatnonzero(at)
    value = np.ndarray((size,), "<u8", data, strides=(1,))[places]
    if n < 8:
        value &= np.uint64((1 << 8 * n) - 1)
    return mix(value), np.searchsorted(places, begin)


def bit_counts(value: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How often each of 64 bits is set in each line's hashes: eight counters in a word, for 255 hashes at most."""
    pieces = -(-count // 255)
    line = np.cumsum(pieces) - pieces
    start = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(line, pieces))
    octets = value.view(np.uint8).reshape(-1, 8)
    cuts = np.unique(np.r_[np.searchsorted(start, np.arange(0, len(value), COUNTED)), len(start)]).tolist()
    parts = []
    for a, b in zip(cuts, cuts[1:]):  # at most COUNTED hashes and a piece, whose counters stay in the cache
        own = octets[start[a] : start[b] if b < len(start) else None]
        parts.append(np.add.reduceat(_SPREAD[own], start[a:b] - start[a], axis=0))
    sums = np.concatenate(parts).view(np.uint8)
    return np.add.reduceat(sums, line, axis=0, dtype=np.int32)


def signatures(lines: list[bytes], n: int, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(SimHashes, block keys lines x BANDS)."""
    value, first = grams(lines, n, every)
    count = np.diff(np.r_[first, len(value)])
    sims = np.packbits(2 * bit_counts(value, first, count) > count[:, None], axis=1).view(np.uint64).ravel()
    stretch = (first[:, None] + count[:, None] * np.arange(ROWS) // ROWS).ravel()
    least, scaled = np.empty((BANDS, len(lines), ROWS), np.uint64), np.empty_like(value)
    for b in range(BANDS):
        np.multiply(value, _FACTORS[b], out=scaled)
        np.minimum.reduceat(scaled, stretch, out=least[b].reshape(-1))
    keys = np.arange(1000 * n, 1000 * n + BANDS, dtype=np.uint64)[:, None]
    for r in range(ROWS):
        keys = mix(keys * ODD + least[:, :, r])
    return sims, np.ascontiguousarray(keys.T)


def blocks(lines: list[bytes], nodes: list[int], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, _BLOCK rows) of lines."""
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(keys: np.ndarray, own: np.ndarray, sims: np.ndarray, sizes: np.ndarray) -> None:
        rows = np.zeros(len(keys), _BLOCK)
        rows["key"], rows["node"], rows["sim"], rows["size"] = keys & np.uint64(0xFFFFFFFF), own, sims, sizes
        found.append(((keys >> np.uint64(32)) % np.uint64(parts), rows))

    node = np.array(nodes, np.int64)
    length = np.array([len(x) for x in lines])
    texts = [x.decode("utf-8", "replace") for x in lines]
    chars = np.array([len(t) for t in texts])
    code = (LENGTH * np.log(np.maximum(chars, 1))).astype(np.uint16)
    for n, least, most in KINDS:
        own = np.flatnonzero((length >= least) & (length <= (most or length.max(initial=0))))
        if len(own):
            sims, keys = signatures([lines[i] for i in own], n, most is not None)
            each = np.repeat(own, BANDS)
            add(keys.ravel(), node[each], np.repeat(sims, BANDS), code[each])
    short = [(k, i) for i in np.flatnonzero((chars >= 4) & (chars <= SHORT)).tolist() for k in without_one(texts[i])]
    if short:
        keys, own = np.array(short).T
        add(mix(keys.view(np.uint64)), node[own], np.zeros(len(own), np.uint64), np.full(len(own), ANY))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, _BLOCK)
    return np.concatenate([p for p, _ in found]), np.concatenate([r for _, r in found])


def near(sim: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    a, b = size[i].astype(np.int32), size[j].astype(np.int32)
    return (a == ANY) | (np.abs(a - b) <= FACTOR) & (np.bitwise_count(sim[i] ^ sim[j]) <= RADIUS)


def paired(g: np.ndarray, node: np.ndarray, sim: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups (sorted by g, no node twice in one) -> (i, j) of pairs to verify, one with an earlier row for each row at most; rows of groups with more pairs.

    Members are compared with their group's first and with LAGS members after them; what a larger group has besides is left to the search across components.
    """
    n = len(g)
    best = np.full(n, n)
    linked = np.zeros(n, bool)
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if n else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(start)), np.diff(np.r_[start, n]))
    passed = np.zeros(len(start), np.int64)
    i, lag = np.arange(n), 0
    while lag <= LAGS and len(i):
        if lag == 0:  # each with its group's first, in groups that the lags do not cover
            j = np.flatnonzero(np.arange(n) - start[of] > LAGS)
            x = start[of[j]]
        else:
            i = i[i + lag < n]
            i = i[g[i] == g[i + lag]]
            x, j = i, i + lag
        ok = near(sim, size, x, j)
        x, j = x[ok], j[ok]
        np.minimum.at(best, j, x)
        linked[x] = linked[j] = True
        passed += np.bincount(of[j], minlength=len(start))
        lag += 1
    j = np.flatnonzero(best < n)
    more = passed > np.bincount(of[j], minlength=len(start))
    large = np.diff(np.r_[start, n]) > LAGS + 1
    return best[j], j, np.flatnonzero(large[of] | more[of] & linked)


def dealt(docs: DataFrame, parts: int) -> DataFrame:
    """docs (id, k, text) -> (part, gathered, rows): packed blocks; gathered rows are a task's own large groups, dealt at random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        lines: list[bytes] = []
        nodes: list[int] = []
        size = 0
        held: list[tuple[np.ndarray, np.ndarray]] = []
        turn = [TaskContext.get().partitionId()]

        def out() -> pa.RecordBatch:
            part, rows = (np.concatenate(x) for x in zip(*held))
            g = (part << np.uint64(32) | rows["key"]).view(np.int64)
            order = np.argsort(g)
            part, rows, g = part[order], rows[order], g[order]
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            count = np.diff(np.r_[start, len(g)])
            many = np.repeat(count > GATHERED, count)
            away, columns = rows[many], [[], [], []]
            if len(away):
                group = np.empty(len(away), _GATHERED)
                group["g"] = g[many]
                for name in ("node", "sim", "size"):
                    group[name] = away[name]
                cuts = np.flatnonzero(np.r_[True, group["g"][1:] != group["g"][:-1], True])
                for a, b in zip(cuts, cuts[1:]):
                    turn[0] = (turn[0] * 6364136223846793005 + 1442695040888963407) % (1 << 63)
                    for c, v in zip(columns, ((turn[0] >> 20) % parts, True, group[a:b].tobytes())):
                        c.append(v)
            rows["more"][start[count > GATHERED]] = 1  # the group goes on elsewhere
            stay = ~many
            stay[start] = True
            part, rows = part[stay], rows[stay]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            for a, b in zip(cuts, cuts[1:]):
                for c, v in zip(columns, (int(part[a]), False, rows[a:b].tobytes())):
                    c.append(v)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.bool_()), pa.array(columns[2], pa.binary())], ["part", "gathered", "rows"])

        for batch in batches:
            for text in batch.column(2).cast(pa.binary()):
                for line in normalised(text.as_py()):
                    if not line or (h := line_hash(line)) in seen:
                        continue
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(h)
                    lines.append(line)
                    nodes.append(h)
                    size += len(line)
                    if size >= SIGNED:
                        held.append(blocks(lines, nodes, parts))
                        lines, nodes, size = [], [], 0
                        if sum(r.nbytes for _, r in held) >= DEALT:
                            yield out()
        if lines:
            held.append(blocks(lines, nodes, parts))
        if any(len(r) for _, r in held):
            yield out()

    return map_arrow(docs, run, "part bigint, gathered boolean, rows binary")


def met(packed: DataFrame) -> DataFrame:
    """Packed blocks -> pairs to verify (a, b; the rest null) and rows of groups with more pairs (g, node, sim, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(g: np.ndarray, rows: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
            """more: rows of groups that go on in another task."""
            order = np.argsort(g)
            alone = g[order]
            alone = np.r_[True, alone[1:] != alone[:-1]] & np.r_[alone[1:] != alone[:-1], True] if len(g) else np.zeros(0, bool)
            order = order[~alone | more[order]]
            g, rows, more = g[order], rows[order], more[order]
            order = np.lexsort((~more, rows["node"], g))
            g, rows, more = g[order], rows[order], more[order]
            new = np.r_[True, (g[1:] != g[:-1]) | (rows["node"][1:] != rows["node"][:-1])][: len(g)]
            g, rows, more = g[new], rows[new], more[new]
            start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]][: len(g)])
            count = np.diff(np.r_[start, len(g)])
            more = np.repeat(np.logical_or.reduceat(more, start) if len(g) else more, count)
            keep = np.repeat(count > 1, count) | more
            g, rows, more = g[keep], rows[keep], more[keep]
            i, j, own = paired(g, rows["node"], rows["sim"], rows["size"])
            own = np.union1d(own, np.flatnonzero(more)).astype(np.int64)
            a, b = rows["node"][i], rows["node"][j]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
            none = lambda k: pa.nulls(k, pa.int64())
            members = (g[own], rows["node"][own], rows["sim"][own].view(np.int64), rows["size"][own].astype(np.int64))
            columns = [(pa.array(pairs[:, 0]), none(len(own))), (pa.array(pairs[:, 1]), none(len(own))), *((none(len(pairs)), pa.array(x)) for x in members)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], ["a", "b", "g", "node", "sim", "size"])

        part, held = None, []

        def whole() -> Iterator[pa.RecordBatch]:
            if held:
                rows = np.concatenate([np.frombuffer(x, _BLOCK) for x in held])
                yield found((rows["key"].astype(np.uint64) | np.uint64(part) << np.uint64(32)).view(np.int64), rows, rows["more"] > 0)
                held.clear()

        for batch in batches:
            for p, gathered, rows in zip(*batch.columns):
                if gathered.as_py():
                    own = np.frombuffer(rows.as_py(), _GATHERED)
                    yield found(own["g"], own, np.ones(len(own), bool))
                    continue
                if p.as_py() != part:
                    yield from whole()
                    part = p.as_py()
                held.append(rows.as_py())
        yield from whole()

    return map_arrow(packed.repartition("part").sortWithinPartitions("part"), run, "a bigint, b bigint, g bigint, node bigint, sim bigint, size bigint")


def search(cols: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one unit that are near, an array of partners for each row."""
    unit, sim, size, component = cols["unit"], cols["sim"].view(np.uint64), cols["size"], cols["component"]
    i, lag = np.arange(len(unit) - 1), 1
    while len(i):
        i = i[unit[i] == unit[i + lag]]
        own = i[component[i] != component[i + lag]]
        own = own[near(sim, size, own, own + lag)]
        if len(own):
            yield own, own + lag
        lag += 1
        i = i[i + lag < len(unit)]


def lines_of(docs: DataFrame) -> DataFrame:
    """docs (id, k, text) -> (id, k, line, h) of lines that are not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, line, h = [], [], []
            for row, text in enumerate(batch.column(2).cast(pa.binary())):
                for number, x in enumerate(normalised(text.as_py())):
                    if x:
                        at.append(row)
                        line.append(number)
                        h.append(line_hash(x))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(line, pa.int32()), pa.array(h, pa.int64())], ["id", "k", "line", "h"])

    return map_arrow(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, k bigint, line int, h bigint")


def texts_of(docs: DataFrame, lines: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """Kept (h, line_text) of the wanted hashes (h), each from its first place."""
    place = lines.join(sized(wanted), "h", "left_semi").groupBy("h").agg(F.min(F.struct("id", "k", "line")).alias("at"))
    places = place.groupBy("at.id", "at.k").agg(F.collect_list(F.struct("at.line", "h")).alias("at"))
    places = scratch.keep(places.select(F.col("id").alias("_id"), F.col("k").alias("_k"), "at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, out = [], []
            for text, at in zip(*batch.columns):
                own = normalised(text.as_py())
                for x in at.as_py():
                    h.append(x["h"])
                    out.append(own[x["line"]].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(out, pa.string())], ["h", "line_text"])

    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("k") == F.col("_k"))
    found = map_arrow(docs.join(sized(places, 64 + 24 * F.size("at")), same).select("text", "at"), run, "h bigint, line_text string")
    found = scratch.keep(found.groupBy("h").agg(F.first("line_text").alias("line_text")))  # rows of one id and one text
    scratch.drop(places)
    return found


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def edit_distance(a: str, b: str) -> int:
    """Insertions, deletions and substitutions; common ends are cut off, the rest goes column by column in bit rows."""
    n = _common(a, b)
    a, b = a[n:], b[n:]
    n = _common(a[::-1], b[::-1])
    a, b = a[: len(a) - n], b[: len(b) - n]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    plus, minus = full, 0
    for c in b:
        here = places.get(c, 0)
        vertical = here | minus
        across = ((here & plus) + plus ^ plus) | here
        up = minus | full & ~(across | plus)
        down = plus & across
        score += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        plus = (down | full & ~(vertical | up)) & full
        minus = up & vertical & full
    return score


def few_edits(a: str, b: str, most: int) -> bool:
    """Whether the distance is at most ``most``, diagonal by diagonal: cheap for few edits in long lines."""
    m, n = len(a), len(b)

    def slide(i: int, j: int) -> int:
        step, low = 16, 0
        while i + low < m and j + low < n and a[i + low : i + low + step] == b[j + low : j + low + step]:
            if i + low + step >= m or j + low + step >= n:
                return min(m - i, n - j)
            low, step = low + step, step * 2
        return low + _common(a[i + low : i + low + step], b[j + low : j + low + step])

    reach = {0: slide(0, 0)}
    for edits in range(most + 1):
        if reach.get(m - n, -1) >= m:
            return True
        new = {}
        for d in range(-edits - 1, edits + 2):
            i = max(reach.get(d, -2) + 1, reach.get(d - 1, -2) + 1, reach.get(d + 1, -2))
            i = min(i, m, n + d)
            if i >= max(0, d):
                new[d] = i + slide(i, i - d)
        reach = new
    return False


#: Words of 64 rows up to which pairs are compared together, and the bytes of their tables.
TOGETHER, TABLES = 32, 1 << 23


def _codes(texts: list[str]) -> tuple[np.ndarray, bool]:
    """(codes below 128, a text in each row; whether different characters always have different codes)."""
    size = np.array([len(t) for t in texts])
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = np.unique(points)
    out = np.zeros((len(texts), int(size.max(initial=0))), np.uint8)
    codes = np.searchsorted(kinds, points) if len(kinds) <= 128 else points & 127
    out[np.arange(out.shape[1]) < size[:, None]] = codes
    return out, len(kinds) <= 128


def within(left: list[str], right: list[str], most: np.ndarray) -> tuple[np.ndarray, bool]:
    """(whether each pair's edit distance is at most ``most``, True); with more than 128 different characters false only if it is not, False.

    All pairs advance together, a column at a time, in words of 64 rows along the diagonal.
    """
    n_pairs, ones, one = len(left), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(1)
    m, n = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    words = int(-(-m.max() // 64))
    codes, exact = _codes([*left, *right])
    a, b, band = codes[:n_pairs], codes[n_pairs:], int(most.max())
    rows = np.arange(n_pairs)
    equal = np.zeros((n_pairs * 128, words), np.uint64)
    for i in range(int(m.max())):
        there = np.flatnonzero(i < m)
        equal[there * 128 + a[there, i], i // 64] |= one << np.uint64(i % 64)
    plus, minus = np.full((words, n_pairs), ones), np.zeros((words, n_pairs), np.uint64)
    bottom = np.repeat(64 * np.arange(1, words + 1)[:, None], n_pairs, 1)
    last, rest = (m - 1) // 64, m - 64 * ((m - 1) // 64)
    beyond = np.where(rest < 64, ones << np.minimum(rest, 63).astype(np.uint64), np.uint64(0))
    ends = np.argsort(n, kind="stable")
    cuts = np.searchsorted(n[ends], np.arange(int(n.max()) + 2))
    out = np.zeros(n_pairs, bool)
    entered = min(words - 1, band // 64)
    for j in range(int(n.max())):
        low, high = max(0, (j - band) // 64), min(words - 1, (j + band) // 64)
        while entered < high:
            entered += 1
            bottom[entered] = bottom[entered - 1] + 64
        column = equal[rows * 128 + b[:, j]]
        up, down = np.full(n_pairs, one), np.zeros(n_pairs, np.uint64)  # what enters from above: one more
        for w in range(low, high + 1):
            p, q, eq = plus[w], minus[w], column[:, w]
            vertical = eq | q
            eq = eq | down
            across = (((eq & p) + p) ^ p) | eq
            rise, fall = q | ~(across | p), p & across
            up_out, down_out = rise >> np.uint64(63), fall >> np.uint64(63)
            bottom[w] += up_out.astype(np.int64) - down_out.astype(np.int64)
            rise, fall = rise << one | up, fall << one | down
            plus[w], minus[w] = fall | ~(vertical | rise), rise & vertical
            up, down = up_out, down_out
        done = ends[cuts[j + 1] : cuts[j + 2]]
        done = done[(last[done] >= low) & (last[done] <= high)]
        if len(done):
            w = last[done]
            more = np.bitwise_count(plus[w, done] & beyond[done]).astype(np.int64) - np.bitwise_count(minus[w, done] & beyond[done])
            out[done] = bottom[w, done] - more <= most[done]
    return out, exact


#: Characters from which lines are first compared for few edits, and how many.
LONG, FEW = 2000, 64
#: Characters from which lines are first compared word by word, and the bits of that table.
WORDY, SEQUENCE = 128, 1 << 24


def allowed(a: str, b: str) -> int:
    return int((1 - SIMILARITY) * max(len(a), len(b)) + 1e-9)


def aligned(a: str, b: str, most: int) -> bool:
    """Whether replacing words by those in the same places takes at most so many edits."""
    x, y = a.split(" "), b.split(" ")
    return len(x) == len(y) and sum(max(len(p), len(q)) for p, q in zip(x, y) if p != q) <= most


def replaced(a: str, b: str, most: int) -> bool:
    """Whether so many edits turn what lies between the words of a longest common sequence into each other, a stretch at a time."""
    x, y = a.split(" "), b.split(" ")
    if len(x) * len(y) > SEQUENCE:
        return False
    places: dict[str, int] = {}
    for i, w in enumerate(x):
        places[w] = places.get(w, 0) | 1 << i
    row, rows = (1 << len(x)) - 1, []
    for w in y:  # a zero where the sequence grows
        here = row & places.get(w, 0)
        row = row + here | row - here
        rows.append(row)
    i, j, edits, left, right = len(x), len(y), 0, 0, 0  # left, right: characters since the last common word, a blank for each word

    def stretch() -> int:
        return max(left, right) - (left > 0 < right)

    while i and j and edits <= most:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
            left += len(x[i]) + 1
            continue
        j -= 1
        if j and not rows[j - 1] >> (i - 1) & 1:
            right += len(y[j]) + 1
            continue
        i -= 1
        edits += stretch()
        left = right = 0
    left += sum(map(len, x[:i])) + i
    right += sum(map(len, y[:j])) + j
    return edits + stretch() <= most


def similar(a: str, b: str) -> bool:
    most = allowed(a, b)
    if abs(len(a) - len(b)) > most:
        return False
    if max(len(a), len(b)) >= LONG and few_edits(a, b, min(most, FEW)):
        return True
    return edit_distance(a, b) <= most


def all_similar(left: list[str], right: list[str]) -> np.ndarray:
    """similar() of every pair; most pairs are settled by their words, or together with others of their length."""
    out = np.zeros(len(left), bool)
    open_pairs: list[tuple[int, int, str, str, int]] = []
    for k, (a, b) in enumerate(zip(left, right)):
        most = allowed(a, b)
        if abs(len(a) - len(b)) > most:
            continue
        if aligned(a, b, most) or max(len(a), len(b)) > WORDY and replaced(a, b, most):
            out[k] = True
            continue
        if max(len(a), len(b)) > 64 * TOGETHER:
            out[k] = similar(a, b)
            continue
        n = _common(a, b)
        a, b = a[n:], b[n:]
        n = _common(a[::-1], b[::-1])
        a, b = a[: len(a) - n], b[: len(b) - n]
        if max(len(a), len(b)) <= most:
            out[k] = True
        else:  # neither is empty, as the lengths are near
            open_pairs.append((len(a), k, a, b, most))
    open_pairs.sort()
    while open_pairs:
        words = -(-open_pairs[-1][0] // 64)
        longer = len(open_pairs) - bisect_left(open_pairs, (open_pairs[-1][0] // 2,))
        count = max(1, min(longer, TABLES // (128 * 8 * words)))
        now, open_pairs = open_pairs[-count:], open_pairs[:-count]
        _, at, a, b, most = zip(*now)
        found, exact = within(list(a), list(b), np.array(most))
        for k in np.flatnonzero(found).tolist():
            out[at[k]] = exact or edit_distance(a[k], b[k]) <= most[k]
    return out


def groups_of_lines(docs: DataFrame, lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the lines that a similar line has joined."""
    parts = max(16, min(PARTS, 1 << math.ceil(math.log2(max(1, estimated_bytes(docs) / PART_BYTES)))))
    both = scratch.keep(met(dealt(docs, parts)))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.Table:
            pairs = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            keep = all_similar(pairs.column("_a").to_pylist(), pairs.column("_b").to_pylist())
            return pairs.select(["a", "b"]).filter(pa.array(keep)).combine_chunks()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TESTED or sum(b.nbytes for b in held) >= TESTED_BYTES:
                yield from out().to_batches()
        if held:
            yield from out().to_batches()

    wanted = both.select(F.explode(F.when(F.col("a").isNull(), F.array("node")).otherwise(F.array("a", "b"))).alias("h"))
    wanted = scratch.keep(wanted.distinct())
    texts = texts_of(docs, lines, wanted, scratch)

    def verify(pairs: DataFrame) -> DataFrame:
        text = lambda c: texts.select(F.col("h").alias(c), F.col("line_text").alias(f"_{c}"))
        joined = pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "_a", "_b")
        return scratch.keep(map_arrow(joined, check, "a bigint, b bigint"))

    pairs = scratch.keep(both.filter("a is not null").select("a", "b").distinct())
    groups = both.filter("a is null").select("g", "node", "sim", "size")
    parts = scratch.keep(connected_components(verify(pairs), scratch))
    found = across_components(groups, parts, pairs, verify, None, search, scratch)
    scratch.drop(both, pairs, wanted, texts)
    return found


def removals(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """docs (id, k, text) -> (id, k, removed array<int>): the lines to drop of every document that loses some."""
    lines = scratch.keep(lines_of(docs))
    found = groups_of_lines(docs, lines, scratch)
    labelled = lines.join(sized(found.withColumnRenamed("node", "h")), "h", "left").select("id", "k", "line", F.coalesce("component", "h").alias("component"))
    place = F.struct("id", "k", "line")
    kept = labelled.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("keep")).filter("n > 1")
    lost = labelled.join(kept.select("component", "keep"), "component").filter(~place.eqNullSafe(F.col("keep")))
    out = scratch.keep(lost.groupBy("id", "k").agg(F.array_sort(F.collect_set("line")).alias("removed")))
    scratch.drop(lines)
    return out


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with the repeated lines gone from its text, and the column ``removed_lines`` (their numbers, from 0)."""
    scratch = Scratch(df.sparkSession)
    own = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    docs = df.select(F.col(id_col).alias("id"), own.alias("k"), F.col(text_col).alias("text"))
    lost = removals(docs, scratch)
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(id_col).alias("id"), own.alias("k"), F.col(text_col).alias("text"))
    same = F.col("d.id").eqNullSafe(F.col("l.id")) & (F.col("d.k") == F.col("l.k"))
    joined = packed.alias("d").join(sized(lost, 64 + 4 * F.size("removed")).alias("l"), same, "left")
    cut = F.array_join(F.filter(F.split(F.col("d.text"), "\n"), lambda x, i: ~F.array_contains("l.removed", i)), "\n")
    text = F.when(F.col("l.removed").isNull(), F.col("d.text")).otherwise(cut)
    columns = [text.alias(c) if c == text_col else F.col(f"d.row.`{c}`") for c in df.columns if c != "removed_lines"]
    return joined.select(*columns, F.coalesce("l.removed", F.array().cast("array<int>")).alias("removed_lines"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    out = drop_repeated_lines(docs.withColumn("n_lines", n_lines.cast("bigint")))
    return out.select("doc_id", "n_lines", F.size("removed_lines").cast("bigint").alias("n_removed"), "removed_lines", "text")
