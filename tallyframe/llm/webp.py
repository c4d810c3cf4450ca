"""Lossless WebP (VP8L) in numpy: a full decoder and an encoder for byte payloads.

The decoder reads prefix codes (simple and normal), several prefix groups,
back-references with the two-dimensional distance map, the colour cache, and
inverts the predictor, cross-colour, subtract-green and palette transforms.

Every payload goes through the whole encoder: the transforms (none, subtract
green, predictor, both, or a palette) and the size of the colour cache are
those of the least estimated bits, back-references are searched in every
payload, and all channels have Huffman codes.  Tokens, codes and bits are
arrays; only code trees and references are walked.

Cases: a null or empty text is 64 zero bytes; texts of any length are stored
whole (rows of pixels are added where one image column is not enough); equal
texts give equal bytes; extra columns are ignored; empty tables stay empty.
A damaged stream raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_arrow, map_batches, table

PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
MAX_SIDE = 1 << 14
BLOCK = 64
#: Sizes of the colour cache that are tried, the longest prefix code written (four of them and a place within a byte fill a word), the longest reference.
CACHES, LONGEST, REACH = (8,), 14, 4096
#: Bytes of a stream that are laid out as words at once; bytes and rows of payloads whose stored forms are read back together.
AHEAD, READ_BYTES, READ_ROWS = 1 << 12, 1 << 24, 4000
# Fixed values of the format: order of code-length symbols; distance map (x, y) of the codes 1 to 120.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
CACHE_FACTOR = 0x1E35A7BD
OPAQUE_BLACK = 0xFF000000


# --- bits -----------------------------------------------------------------


class BitReader:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if not n:
            return 0
        p = self.at
        self.at = p + n
        if self.at > self.end:
            raise ValueError("the stream ends too early")
        return int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        """Up to n bits; zeros beyond the end."""
        p = self.at
        return int.from_bytes(self.data[p >> 3 : (p + n + 7) >> 3], "little") >> (p & 7) & ((1 << n) - 1)

    def words(self, most: int = AHEAD) -> tuple[list[int], int, int]:
        """(64 bits from every byte on, from the one with the next bit; the first one's place; bits that they serve); zeros beyond the end."""
        first = self.at >> 3
        if first > len(self.data):
            raise ValueError("the stream ends too early")
        n = min(most, len(self.data) - first) + 1
        raw = self.data[first : first + n + 39].ljust(n + 39, b"\0")
        return np.ndarray((n + 32,), "<u8", raw, strides=(1,)).tolist(), 8 * first, 8 * n


class BitWriter:
    """Fields of up to 64 bits, laid out together at the end."""

    def __init__(self):
        self.parts: list[tuple] = []
        self.value: list[int] = []
        self.size: list[int] = []

    def write(self, value: int, n: int) -> None:
        self.value.append(value)
        self.size.append(n)

    def write_all(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.size:
            self.parts.append((np.array(self.value, np.uint64), np.array(self.size, np.int64)))
            self.value, self.size = [], []
        self.parts.append((values, sizes))

    def done(self) -> bytes:
        self.write_all(np.zeros(1, np.uint64), np.zeros(1, np.int64))
        value, size = (np.concatenate(x) for x in zip(*self.parts))
        end = np.cumsum(size)
        at = end - size
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out = np.zeros(int(word[-1]) + 2, "<u8")
        out[word[start]] = np.bitwise_or.reduceat(value << shift, start)
        out[word[start] + 1] |= np.bitwise_or.reduceat(value >> np.uint64(1) >> (np.uint64(63) - shift), start)
        return out.tobytes()[: (int(end[-1]) + 7) >> 3]


def _reversals(n: int) -> np.ndarray:
    """All numbers of n bits, read backwards."""
    out = np.zeros(1, np.int64)
    for _ in range(n):
        out = np.concatenate([2 * out, 2 * out + 1])
    return out


_REVERSED = [_reversals(n) for n in range(16)]
#: Entries of a table over so many bits that a code of so many takes.
_SHARES = [np.array([1 << max(0, most - n) for n in range(16)]) for most in range(16)]
_ONE = np.ones(1, np.int64)


def _canonical(lengths: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bits of every symbol, its code as it stands in the stream); owner: the place of the code that a symbol is of, in order.

    The symbol of a code of one takes no bits.
    """
    used = lengths.nonzero()[0]
    own = lengths[used] if owner is None else lengths[used] + (owner[used] << 4)
    order = used[np.argsort(own, kind="stable")]
    size, code = lengths.copy(), np.zeros(len(lengths), np.uint64)
    if owner is not None:
        single = np.bincount(owner[used], minlength=int(owner[-1]) + 1)[owner[order]] == 1
        size[order[single]] = 0
        order = order[~single]
    share = 1 << (15 - size[order])
    code[order] = _REVERSED[15][(np.cumsum(share) - share) & 32767]  # a whole code has 2**15 shares
    return size, code


class PrefixCode:
    """A decoding table over the longest code's bits."""

    def __init__(self, lengths: list[int] | np.ndarray):
        lengths = np.asarray(lengths, np.uint8)
        used = lengths.nonzero()[0]
        if not used.size:
            raise ValueError("a prefix code without symbols")
        if used.size == 1:
            self.bits, self.coded, self.share = 0, used << 4, _ONE
        else:
            order = lengths[used].argsort(kind="stable")
            used = used[order]
            size = lengths[used]
            self.bits = bits = int(size[-1])
            self.coded, self.share = used << 4 | size, _SHARES[bits][size]
            if int(self.share.sum()) != 1 << bits:
                raise ValueError("a prefix code that is not complete")
        self.held: np.ndarray | None = None
        self.table: list[int] | None = None

    @property
    def entries(self) -> np.ndarray:
        if self.held is None:
            self.held = self.coded.repeat(self.share)[_REVERSED[self.bits]]
        return self.held

    def prepare(self) -> "PrefixCode":
        if self.table is None:
            self.table = self.entries.tolist()
        return self

    def read(self, bits: BitReader) -> int:
        got = self.table[bits.peek(self.bits)]
        bits.at += got & 15
        return got >> 4


@lru_cache(1024)
def _length_code(n: int, value: int) -> PrefixCode:
    """The code of code lengths of n fields of three bits."""
    lengths = [0] * 19
    for k in range(n):
        lengths[LENGTH_ORDER[k]] = value >> 3 * k & 7
    return PrefixCode(lengths).prepare()


_TIMES = [bytes([n]) * 6 for n in range(16)]
#: Bits of code lengths that are looked up at once.
WINDOW = 12


@lru_cache(64)
def _window(n: int, value: int) -> list[tuple[bytes, int, int]] | None:
    """What every WINDOW bits hold of a known code of code lengths: (lengths, their bits, the last that is not 0); up to a symbol that repeats the length before."""
    if (n, value) not in _KNOWN:
        return None
    table, bits = _length_code(n, value).table, _length_code(n, value).bits
    out = []
    for w in range(1 << WINDOW):
        found, p, last = b"", 0, 0
        while True:
            got = table[w >> p & (1 << bits) - 1]
            size, s = got & 15, got >> 4
            more = 3 if s == 17 else 7 if s == 18 else 0
            if s == 16 or p + size + more > WINDOW:
                break
            if s < 16:
                found, last = found + bytes([s]), s or last
            else:
                found += bytes((3 if s == 17 else 11) + (w >> p + size & (1 << more) - 1))
            p += size + more
        out.append((found, p, last))
    return out


def _read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    if bits.read(1):  # simple
        lengths, two = np.zeros(alphabet, np.int64), bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        both = [first, bits.read(8)] if two else [first]
        if max(both) >= alphabet:
            raise ValueError("a symbol outside its alphabet")
        lengths[both] = 1
        return PrefixCode(lengths)
    n = 4 + bits.read(4)
    value = bits.read(3 * n)
    code = _length_code(n, value)
    limited = bits.read(1)
    most = 2 + bits.read(2 + 2 * bits.read(3)) if limited else alphabet
    if most > alphabet:
        raise ValueError("too many code lengths")
    words, base, stop = bits.words(64)
    table, mask, p = code.table, (1 << code.bits) - 1, bits.at - base
    window, whole = None if limited else _window(n, value), (1 << WINDOW) - 1
    lengths, last, total = bytearray(), 8, bits.end - base
    while len(lengths) < alphabet and most:
        if p >= stop:
            bits.at = base + p
            words, base, stop = bits.words(64)
            p, total = bits.at - base, bits.end - base
        w = words[p >> 3] >> (p & 7)
        if window is not None:
            piece, used, newest = window[w & whole]
            if used and len(lengths) + len(piece) <= alphabet:
                lengths += piece
                p += used
                last = newest or last
                continue
        most -= 1
        got = table[w & mask]
        w >>= got & 15
        p += got & 15
        s = got >> 4
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += _TIMES[last][: 3 + (w & 3)]
            p += 2
        elif s == 17:
            lengths += bytes(3 + (w & 7))
            p += 3
        else:
            lengths += bytes(11 + (w & 127))
            p += 7
    if p > total:
        raise ValueError("the stream ends too early")
    if len(lengths) > alphabet:
        raise ValueError("code lengths run over")
    bits.at = base + p
    return PrefixCode(np.frombuffer(lengths.ljust(alphabet, b"\0"), np.uint8))


# --- decoding -------------------------------------------------------------


def _ceil_shift(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _extra(bits: BitReader, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


def _read_reference(bits: BitReader, symbol: int, distance: PrefixCode, width: int) -> tuple[int, int]:
    """(length, distance in pixels) after a reference's green symbol."""
    length = _extra(bits, symbol - 256)
    d = _extra(bits, distance.read(bits))
    if d > 120:
        return length, d - 120
    x, y = DISTANCE_MAP[d - 1]
    return length, max(1, x + y * width)


_EIGHT = np.arange(8, dtype=np.uint32)


def _read_group(bits: BitReader, codes: list[PrefixCode], width: int, count: int, cache_bits: int) -> np.ndarray:
    """Pixels under one prefix group whose literals fit a word.

    The place after a literal is found for every place at once; literals are then a chain of places.  A pixel from
    the colour cache is the latest one of its slot, which is looked up when all are read: with a cache, references
    copy the number of the pixel that they go back to.
    """
    masks = [np.uint32((1 << c.bits) - 1) for c in codes[:4]]
    sizes = [c.entries & 15 for c in codes[:4]]
    symbols = [c.entries >> 4 for c in codes[:4]]
    refers, alone = (symbols[0] >= 256) & (symbols[0] < 280), symbols[0] >= 280
    distance = codes[4].prepare()
    out, n = np.empty(count, np.uint32), 0
    source = np.arange(count) if cache_bits else out
    slots = np.full(count, -1) if cache_bits else None
    while n < count:
        first = bits.at >> 3
        if first > len(bits.data):
            raise ValueError("the stream ends too early")
        rows = min(AHEAD, len(bits.data) - first) + 1
        raw = bits.data[first : first + rows + 20].ljust(rows + 20, b"\0")
        here = (np.ndarray((rows + 16, 1), "<u4", raw, strides=(1, 0)) >> _EIGHT).ravel()
        stop = 8 * rows
        index = here & masks[0]
        after = np.arange(stop)
        after += sizes[0].take(index[:stop])
        for mask, size in zip(masks[1:], sizes[1:]):
            after += size.take(here.take(after) & mask)
        if cache_bits:
            after = np.where(alone.take(index[:stop]), np.arange(stop) + sizes[0].take(index[:stop]), after)
        after[refers.take(index[:stop])] = -1
        after = after.tolist() + [-1] * 128  # a literal or reference may end so far beyond
        p, chain, start = bits.at - 8 * first, [], n
        runs: list[tuple[int, int, int, int]] = []  # literals before, place, length, distance
        append = chain.append
        while True:
            n -= len(chain)
            for _ in range(count - n - len(chain)):
                q = after[p]
                if q < 0:
                    break
                append(p)
                p = q
            n += len(chain)
            if n >= count or p >= stop:
                break
            g = int(index[p])
            bits.at = 8 * first + p + int(sizes[0][g])
            length, d = _read_reference(bits, int(symbols[0][g]), distance, width)
            p = bits.at - 8 * first
            if d > n or n + length > count:
                raise ValueError("a reference outside the image")
            runs.append((len(chain), n, length, d))
            n += length
        bits.at = 8 * first + p
        at = np.array(chain, np.int64)
        pixels = np.zeros(len(at), np.uint32)
        for mask, size, symbol, shift in zip(masks, sizes, symbols, (8, 16, 0, 24)):
            entry = here.take(at) & mask
            pixels |= symbol.take(entry).astype(np.uint32) << np.uint32(shift)
            at = at + size.take(entry)
        slot = symbols[0].take(index.take(np.array(chain, np.int64))) - 280 if cache_bits else None
        _place(out, source, slots, pixels, slot, runs, start, n)
    if bits.at > bits.end:
        raise ValueError("the stream ends too early")
    return _from_cache(out, source, slots, cache_bits) if cache_bits else out


def _from_cache(pixels: np.ndarray, source: np.ndarray, slots: np.ndarray, cache_bits: int) -> np.ndarray:
    """pixels: the literals; source: the pixel that each is a copy of; slots: where a pixel from the cache lies."""
    slot = np.where(slots >= 0, slots, (pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits))[source]
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    lone = np.flatnonzero(slots[order] >= 0)
    lone = lone[source[order[lone]] == order[lone]]  # not the places that a reference has filled
    empty = (lone == 0) | (slot[order[lone]] != slot[order[lone - 1]])
    source[order[lone]] = order[lone - 1]
    if empty.any():  # a slot that nothing was put into is zero
        pixels[order[lone[empty]]] = 0
        source[order[lone[empty]]] = order[lone[empty]]
    while True:
        further = source[source]
        if (further == source).all():
            return pixels[source]
        source = further


#: A token in _read_together: six bits of size, two free, the pixel, then 0 for a literal, or the green symbol less 255.
_PIXEL, _KIND = 8, 40
_LITERALS = np.int64(1 << _KIND)
#: Steps between looks at what has ended; what a step and a pixel of _read_group take, in the same unit.
_STEPS, _STEP_COST, _PIXEL_COST = 16, 60, 2


def _read_together(images: list[tuple[BitReader, list[PrefixCode], int, int, int]]) -> list[np.ndarray]:
    """What _read_group gives for each: (bits, codes, width, count, cache_bits).  All advance together, a token at a time.

    An image that is much larger than the others is read by itself.
    """
    out: list[np.ndarray | None] = [None] * len(images)
    by_size = sorted(range(len(images)), key=lambda k: -images[k][3])
    sizes = np.array([images[k][3] for k in by_size], np.int64)
    cost = _PIXEL_COST * np.r_[0, np.cumsum(sizes)] + _STEP_COST * np.r_[sizes, 0]
    alone = int(cost.argmin())
    for k in by_size[:alone]:
        out[k] = _read_group(*images[k])
    by_size = by_size[alone:]
    if not by_size:
        return out
    own = [images[k] for k in by_size]
    # all streams as one, all tables as one
    lengths = np.array([len(x[0].data) for x in own])
    base = 8 * (np.cumsum(lengths) - lengths)
    raw = b"".join([x[0].data for x in own]) + bytes(32 * _STEPS)
    words = np.ndarray((len(raw) - 8,), "<i8", raw, strides=(1,)).copy()
    codes = [c for x in own for c in x[1][:4]]
    coded = np.concatenate([c.coded for c in codes])
    channel = (np.arange(len(codes)) & 3).repeat([len(c.coded) for c in codes])
    symbol = coded >> 4
    green = channel == 0
    special = green & (symbol >= 256)
    coded = coded & 15 | np.where(special, (symbol - 255) << _KIND, symbol << (np.array([8, 16, 0, 24]) + _PIXEL)[channel])
    spread = np.array([1 << c.bits for c in codes])
    table_at = np.cumsum(spread) - spread
    table = coded.repeat(np.concatenate([c.share for c in codes]))[np.concatenate([_REVERSED[c.bits] for c in codes]) + table_at.repeat(spread)]
    masks, tables = (spread - 1).reshape(-1, 4).T, table_at.reshape(-1, 4).T

    who = np.arange(len(own))
    p = base + np.array([x[0].at for x in own])
    end = base + np.array([x[0].end for x in own])
    count = np.array([x[3] for x in own])
    left, taken = count.copy(), np.zeros(len(own), np.int64)
    runs: dict[int, list[tuple[int, int, int, int]]] = {}  # literals before, place, length, distance
    tokens, owners = [], []
    turn, name = np.arange(_STEPS)[:, None], np.min_scalar_type(len(own))
    while len(who):
        (m0, m1, m2, m3), (t0, t1, t2, t3) = np.ascontiguousarray(masks[:, who]), np.ascontiguousarray(tables[:, who])
        kept = np.empty((_STEPS, len(who)), np.int64)
        for step in range(_STEPS):  # an image that ends on the way reads on; that is dropped below
            w = words.take(p >> 3)
            w >>= p & 7
            i = w & m0
            i += t0
            g = table.take(i)
            w >>= g & 15
            np.bitwise_and(w, m1, out=i)
            i += t1
            e = table.take(i)
            w >>= e & 15
            np.bitwise_and(w, m2, out=i)
            i += t2
            f = table.take(i)
            w >>= f & 15
            e += f
            np.bitwise_and(w, m3, out=i)
            i += t3
            e += table.take(i)
            e += g
            other = g >= _LITERALS
            kept[step] = e
            if other.any():
                np.copyto(e, g, where=other)
                p += e & 63
                kept[step] = e
                for j in (other & (g < 25 << _KIND)).nonzero()[0].tolist():
                    x = int(who[j])
                    if left[x] <= step:
                        continue
                    bits, its, width, n, _ = own[x]
                    bits.at = int(p[j] - base[x])
                    length, d = _read_reference(bits, 255 + (int(g[j]) >> _KIND), its[4].prepare(), width)
                    p[j] = base[x] + bits.at
                    place = n - int(left[x]) + step
                    if d > place or place + length > n:
                        raise ValueError("a reference outside the image")
                    mine = runs.setdefault(x, [])
                    mine.append((int(taken[x]) + step - len(mine), place, length, d))
                    left[x] -= length - 1
            else:
                p += e & 63
        rest = left[who]
        names = np.broadcast_to(who.astype(name), kept.shape)
        ended = (rest <= _STEPS).nonzero()[0]
        if len(ended):
            true = turn < rest
            p[ended] -= np.where(true[:, ended], 0, kept[:, ended] & 63).sum(0)
            tokens.append(kept[true])
            owners.append(names[true])
        else:
            tokens.append(kept.ravel())
            owners.append(names.ravel())
        if (p > end[who]).any():
            raise ValueError("the stream ends too early")
        taken[who] += np.minimum(rest, _STEPS)
        left[who] -= _STEPS
        if len(ended):
            going = rest > _STEPS
            who, p = who[going], p[going]
    order = np.argsort(np.concatenate(owners), kind="stable")  # a radix sort
    every = np.concatenate(tokens)[order]
    pixels = (every >> _PIXEL).astype(np.uint32)
    cuts = np.r_[0, np.cumsum(taken)].tolist()
    for x, k in enumerate(by_size):
        a, b = cuts[x], cuts[x + 1]
        mine, cache_bits = runs.get(x), own[x][4]
        if not mine and not cache_bits:
            out[k] = pixels[a:b].copy()
            continue
        kind = every[a:b] >> _KIND
        literal = (kind == 0) | (kind >= 25)
        n = int(count[x])
        image = np.empty(n, np.uint32)
        source, slots = (np.arange(n), np.full(n, -1)) if cache_bits else (image, None)
        _place(image, source, slots, pixels[a:b][literal], kind[literal] - 25, mine or [], 0, n)
        out[k] = _from_cache(image, source, slots, cache_bits) if cache_bits else image
    return out


def _place(out: np.ndarray, source: np.ndarray, slots: np.ndarray | None, pixels: np.ndarray, slot: np.ndarray | None, runs: list[tuple[int, int, int, int]], start: int, end: int) -> None:
    """Writes pixels from the place ``start`` to ``end``, and what the references between them copy."""
    k, to = 0, start
    for before, place, length, d in [*runs, (len(pixels), end, 0, 1)]:
        out[to:place] = pixels[k:before]
        if slots is not None:
            slots[to:place] = slot[k:before]
        k, to = before, place + length
        source[place:to] = source[place - d : to - d] if d >= length else np.resize(source[place - d : place], length)


def _begin_image(bits: BitReader, width: int, height: int, main: bool) -> tuple[list[list[PrefixCode]], list[int] | None, int, int, int]:
    """What stands before an image's tokens: (prefix groups, the group of every block, its side in bits, blocks in a row, cache_bits)."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache that is too large")
    groups, owner, meta_bits, meta_width = 1, None, 0, 0
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta_width = _ceil_shift(width, meta_bits)
        meta = _read_image(bits, meta_width, _ceil_shift(height, meta_bits), False)
        owner = (meta >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64).tolist()
        groups = max(owner) + 1
    alphabets = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    return [[_read_code(bits, n) for n in alphabets] for _ in range(groups)], owner, meta_bits, meta_width, cache_bits


def _fits(codes: list[list[PrefixCode]]) -> bool:
    """Whether there is one group, whose literals fit a word."""
    return len(codes) == 1 and sum(c.bits for c in codes[0][:4]) <= 57


def _read_image(bits: BitReader, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image, flat."""
    return _read_tokens(bits, width, height, *_begin_image(bits, width, height, main))


def _read_tokens(bits: BitReader, width: int, height: int, codes: list[list[PrefixCode]], owner: list[int] | None, meta_bits: int, meta_width: int, cache_bits: int) -> np.ndarray:
    count = width * height
    if _fits(codes):
        return _read_group(bits, codes[0], width, count, cache_bits)
    for group in codes:
        for c in group:
            c.prepare()
    out, n = [0] * count, 0
    cache, shift = [0] * (1 << cache_bits), 32 - cache_bits
    green, red, blue, alpha, distance = codes[0]
    while n < count:
        if owner is not None:
            y, x = divmod(n, width)
            green, red, blue, alpha, distance = codes[owner[(y >> meta_bits) * meta_width + (x >> meta_bits)]]
        s = green.read(bits)
        if s < 256:
            r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
            out[n] = pixel = a << 24 | r << 16 | s << 8 | b
            if cache_bits:
                cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
            n += 1
        elif s < 280:
            length = _extra(bits, s - 256)
            d = _extra(bits, distance.read(bits))
            if d > 120:
                d -= 120
            else:
                x, y = DISTANCE_MAP[d - 1]
                d = max(1, x + y * width)
            if d > n or n + length > count:
                raise ValueError("a reference outside the image")
            if d >= length:
                out[n : n + length] = out[n - d : n - d + length]
            else:
                part = out[n - d : n]
                out[n : n + length] = (part * (length // d + 1))[:length]
            if cache_bits:
                for pixel in out[n : n + length]:
                    cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
            n += length
        else:
            out[n] = pixel = cache[s - 280]
            cache[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
            n += 1
    if bits.at > bits.end:
        raise ValueError("the stream ends too early")
    return np.array(out, np.uint32)


def _bytes_of(pixels: np.ndarray) -> np.ndarray:
    """(..., 4) samples: blue, green, red, alpha."""
    return np.ascontiguousarray(pixels, "<u4").view(np.uint8).reshape(*pixels.shape, 4)


def _pixels_of(samples: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(samples, np.uint8).view("<u4").reshape(samples.shape[:-1])


def _average(a, b):
    return (a + b) >> 1


def _predict(mode, left, top, right_top, left_top):
    """Predicted samples (int arrays); ``mode`` is one number."""
    if mode == 0 or mode > 13:
        return np.zeros_like(left) + np.array([0, 0, 0, 255])
    if mode < 5:
        return (left, top, right_top, left_top)[mode - 1]
    if mode == 5:
        return _average(_average(left, right_top), top)
    if mode < 10:
        a, b = ((left, left_top), (left, top), (left_top, top), (top, right_top))[mode - 6]
        return _average(a, b)
    if mode == 10:
        return _average(_average(left, left_top), _average(top, right_top))
    if mode == 11:
        to_left = np.abs(top - left_top).sum(-1, keepdims=True)
        to_top = np.abs(left - left_top).sum(-1, keepdims=True)
        return np.where(to_left < to_top, left, top)
    if mode == 12:
        return np.clip(left + top - left_top, 0, 255)
    a = _average(left, top)
    half = a - left_top
    return np.clip(a + (half + (half < 0)) // 2, 0, 255)


def _unpredict(residual: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    height, width = residual.shape
    rest = _bytes_of(residual).astype(np.int64)
    out = rest.copy()
    out[0, 0] = (rest[0, 0] + np.array([0, 0, 0, 255])) & 255
    out[0] = np.cumsum(out[0], 0) & 255  # the top row is predicted from the left
    if (modes == 2).all():
        return _pixels_of((np.cumsum(out, 0) & 255).astype(np.uint8))
    if (modes == 1).all():
        out[:, 0] = np.cumsum(out[:, 0], 0) & 255
        out[1:] = np.cumsum(out[1:], 1) & 255
        return _pixels_of(out.astype(np.uint8))
    for y in range(1, height):
        above, row = out[y - 1], out[y]
        row[0] = (rest[y, 0] + above[0]) & 255
        for x in range(1, width):
            mode = int(modes[y >> size_bits, x >> size_bits])
            corner = above[x + 1] if x + 1 < width else row[0]
            row[x] = (rest[y, x] + _predict(mode, row[x - 1], above[x], corner, above[x - 1])) & 255
    return _pixels_of(out.astype(np.uint8))


def _predicted(pixels: np.ndarray, modes: np.ndarray, size_bits: int) -> np.ndarray:
    """Residuals of an image."""
    height, width = pixels.shape
    own = _bytes_of(pixels).astype(np.int64)
    guess = np.zeros_like(own)
    guess[0, 0] = (0, 0, 0, 255)
    guess[0, 1:] = own[0, :-1]
    guess[1:, 0] = own[:-1, 0]
    if width > 1 and height > 1:
        left, top, left_top = own[1:, :-1], own[:-1, 1:], own[:-1, :-1]
        right_top = np.concatenate([own[:-1, 2:], own[1:, :1]], 1)
        mode = np.kron(modes, np.ones((1 << size_bits, 1 << size_bits), np.int64))[1:height, 1:width]
        for m in np.unique(mode):
            at = mode == m
            guess[1:, 1:][at] = _predict(int(m), left[at], top[at], right_top[at], left_top[at])
    return _pixels_of(((own - guess) & 255).astype(np.uint8))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def _cross_colour(pixels: np.ndarray, elements: np.ndarray, size_bits: int, sign: int) -> np.ndarray:
    height, width = pixels.shape
    s = _bytes_of(pixels).astype(np.int64)
    e = _bytes_of(elements).astype(np.uint8)
    full = np.repeat(np.repeat(e, 1 << size_bits, 0), 1 << size_bits, 1)[:height, :width]
    green_red, green_blue, red_blue = _signed(full[..., 0]), _signed(full[..., 1]), _signed(full[..., 2])
    green = _signed(s[..., 1])
    red = (s[..., 2] + sign * ((green_red * green) >> 5)) & 255
    original = red if sign > 0 else s[..., 2]  # the true red on either side
    s[..., 0] = (s[..., 0] + sign * (((green_blue * green) >> 5) + ((red_blue * _signed(original)) >> 5))) & 255
    s[..., 2] = red
    return _pixels_of(s.astype(np.uint8))


def _subtract_green(pixels: np.ndarray, sign: int) -> np.ndarray:
    s = _bytes_of(pixels).astype(np.int64)
    s[..., 0] += sign * s[..., 1]
    s[..., 2] += sign * s[..., 1]
    return _pixels_of((s & 255).astype(np.uint8))


def _palette_bits(size: int) -> int:
    return 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0


def _open(data: bytes) -> tuple[BitReader, int, int, list]:
    """(bits from the main image on, its width, its height, what undoes the transforms) of a lossless WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image in the file")
        at += 8 + (struct.unpack("<I", data[at + 4 : at + 8])[0] + 1) // 2 * 2
    size = struct.unpack("<I", data[at + 4 : at + 8])[0]
    bits = BitReader(data[at + 8 : at + 8 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no lossless image in the file")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo, seen = [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform that occurs twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            b = bits.read(3) + 2
            w, h = _ceil_shift(width, b), _ceil_shift(height, b)
            image = _read_image(bits, w, h, False).reshape(h, w)
            if kind == PREDICTOR:
                modes = (image >> np.uint32(8) & np.uint32(15)).astype(np.int64)
                undo.append(lambda p, modes=modes, b=b: _unpredict(p, modes, b))
            else:
                undo.append(lambda p, image=image, b=b: _cross_colour(p, image, b, 1))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda p: _subtract_green(p, 1))
        else:
            n = bits.read(8) + 1
            colours = _bytes_of(_read_image(bits, n, 1, False)).astype(np.int64)
            colours = _pixels_of((np.cumsum(colours, 0) & 255).astype(np.uint8))
            b, true_width = _palette_bits(n), width
            width = _ceil_shift(width, b)

            def restore(p, colours=colours, b=b, true_width=true_width):
                index = (p >> np.uint32(8)) & np.uint32(255)
                if b:
                    each = 8 >> b
                    parts = [(index >> np.uint32(k * each)) & np.uint32((1 << each) - 1) for k in range(1 << b)]
                    index = np.stack(parts, -1).reshape(p.shape[0], -1)[:, :true_width]
                full = np.zeros(256, np.uint32)
                full[: len(colours)] = colours
                return full[index]

            undo.append(restore)
    return bits, width, height, undo


def _undone(flat: np.ndarray, width: int, height: int, undo: list) -> np.ndarray:
    pixels = flat.reshape(height, width)
    for f in reversed(undo):
        pixels = f(pixels)
    return pixels


def decode(data: bytes) -> np.ndarray:
    """The ARGB pixels (height, width) of a lossless WebP file."""
    bits, width, height, undo = _open(data)
    return _undone(_read_image(bits, width, height, True), width, height, undo)


def decode_all(files: list[bytes]) -> list[np.ndarray]:
    """decode() of each; the tokens of those of one prefix group are read together."""
    flat: list[np.ndarray | None] = [None] * len(files)
    opened, together, places = [], [], []
    for k, data in enumerate(files):
        bits, width, height, undo = _open(data)
        opened.append((width, height, undo))
        begun = _begin_image(bits, width, height, True)
        if _fits(begun[0]):
            together.append((bits, begun[0][0], width, width * height, begun[-1]))
            places.append(k)
        else:
            flat[k] = _read_tokens(bits, width, height, *begun)
    for k, found in zip(places, _read_together(together)):
        flat[k] = found
    return [_undone(x, *how) for x, how in zip(flat, opened)]


# --- encoding -------------------------------------------------------------


def _huffman(counts: np.ndarray, limit: int = LONGEST) -> np.ndarray:
    """Code lengths; flatter counts where a code would be too long."""
    lengths = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        if len(used) and used[0] >= 256:  # a symbol beyond the simple form: a second one completes the code
            lengths[0] = 1
        return lengths
    n, floor = len(used), 1
    while True:
        weight = np.maximum(counts[used], floor)
        order = used[np.argsort(weight, kind="stable")]
        leaf = np.sort(weight).tolist() + [1 << 62]
        inner, above = [1 << 62] * n, [0] * (2 * n - 1)
        i = j = 0
        for k in range(n - 1):
            total = 0
            for _ in (0, 1):
                if leaf[i] <= inner[j]:
                    total += leaf[i]
                    above[i] = n + k
                    i += 1
                else:
                    total += inner[j]
                    above[n + j] = n + k
                    j += 1
            inner[k] = total
        depth = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth[:n]) <= limit:
            lengths[order] = depth[:n]
            return lengths
        floor *= 2


def _write_codes(out: BitWriter, lengths: np.ndarray, owner: np.ndarray, bounds: np.ndarray) -> None:
    """The lengths of several codes, one after the other; owner: the code of every symbol; bounds: where each begins, and the end."""
    new = np.empty(len(lengths), bool)
    new[0] = True
    np.not_equal(lengths[1:], lengths[:-1], out=new[1:])
    new[bounds[:-1]] = True
    start = new.nonzero()[0]
    value, of = lengths[start], owner[start]
    one = value > 0  # a length is written before it is repeated
    full, rest = np.divmod(np.diff(np.r_[start, len(lengths)]) - one, np.where(one, 6, 138))
    tail = rest >= 3
    parts = np.empty((4, len(value), 4), np.int64)  # symbols, repetitions, codes, times of a run's parts
    symbols, repeated, codes, times = parts
    times[:, 0], times[:, 1], times[:, 2], times[:, 3] = one, full, tail, rest * ~tail
    symbols[:, 0] = symbols[:, 3] = value
    symbols[:, 1] = symbols[:, 2] = 18 - 2 * one
    symbols[:, 2] -= ~one & (rest < 11)
    repeated[:, 0] = repeated[:, 3] = 0
    repeated[:, 1], repeated[:, 2] = np.where(one, 6, 138), rest
    codes[:] = of[:, None]
    symbols, extras, codes = parts[:3].reshape(3, -1).repeat(times.ravel(), 1)
    n = len(bounds) - 1
    counts = np.bincount(codes * 19 + symbols, minlength=19 * n).reshape(n, 19)
    chosen = (counts @ _LENGTH_BITS.T + _HEAD_BITS).argmin(1)
    extras = np.maximum(extras - _LEAST[symbols], 0).astype(np.uint64)
    heads = [(_LENGTH_CODES[k][0] << 1, _LENGTH_CODES[k][1] + 2) for k in chosen.tolist()]
    used = np.add.reduceat(lengths > 0, bounds[:-1])
    for c in (used < 2).nonzero()[0].tolist():  # the simple form
        s = int(lengths[bounds[c] : bounds[c + 1]].argmax())
        heads[c] = (1 | (s > 1) << 2 | s << 3, 11 if s > 1 else 4)
    written = (used >= 2)[codes]
    symbols, extras, codes = symbols[written], extras[written], codes[written]
    k = chosen[codes]
    size = _LENGTH_BITS[k, symbols]
    at = np.searchsorted(codes, np.arange(n)) + np.arange(n)
    body = np.arange(len(codes)) + codes + 1  # every code's head goes before it
    values, sizes = np.empty(n + len(codes), np.uint64), np.empty(n + len(codes), np.int64)
    values[at], sizes[at] = (np.array(x, d) for x, d in zip(zip(*heads), (np.uint64, np.int64)))
    values[body], sizes[body] = _LENGTH_TABLE[k, symbols] | extras << size.astype(np.uint64), size + _EXTRA_BITS[symbols]
    out.write_all(values, sizes)


_EXTRA_BITS = np.array([0] * 16 + [2, 3, 7])
_LEAST = np.array([0] * 16 + [3, 3, 11])
#: Codes of code lengths to choose from: Huffman codes of the lengths of groups of like texts' codes, and one for what is like none of them.
LENGTH_LENGTHS = (
    (2, 7, 7, 7, 6, 5, 6, 5, 5, 4, 3, 2, 5, 7, 7, 7, 6, 4, 5),
    (3, 7, 7, 4, 4, 4, 3, 3, 3, 7, 7, 6, 6, 6, 6, 6, 6, 4, 3),
    (2, 7, 7, 7, 6, 5, 6, 5, 5, 3, 2, 7, 7, 7, 6, 6, 6, 3, 5),
    (2, 7, 7, 4, 4, 4, 4, 4, 4, 4, 4, 7, 7, 7, 7, 7, 7, 4, 3),
    (2, 7, 7, 4, 3, 3, 3, 4, 7, 7, 7, 7, 7, 7, 7, 7, 6, 5, 3),
    (3, 7, 7, 5, 4, 4, 4, 3, 4, 3, 7, 7, 7, 7, 6, 6, 6, 3, 3),
    (3, 4, 5, 5, 4, 2, 5, 7, 7, 7, 7, 7, 7, 6, 6, 6, 4, 3, 3),
    (5, 5, 5, 5, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 5, 4, 5, 4),
)


def _length_codes() -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(the code's own lengths as they are written, their bits, bits and codes of its symbols) of each."""
    out = []
    for lengths in LENGTH_LENGTHS:
        most = max(3, *(k for k, s in enumerate(LENGTH_ORDER) if lengths[s]))
        head = most + 1 - 4 | sum(lengths[LENGTH_ORDER[k]] << 4 + 3 * k for k in range(most + 1))
        out.append((head, 4 + 3 * (most + 1), *_canonical(np.array(lengths))))
    return out


_LENGTH_CODES = _length_codes()
#: Numbers of fields and values of these codes, as they are written.
_KNOWN = {(4 + (x[0] & 15), x[0] >> 4) for x in _LENGTH_CODES}
_LENGTH_BITS, _HEAD_BITS, _LENGTH_TABLE = np.array(LENGTH_LENGTHS), np.array([x[1] for x in _LENGTH_CODES]), np.stack([x[3] for x in _LENGTH_CODES])


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbols, extra values, extra bits) of length or distance codes of 1 or more."""
    v = value - 1
    high = np.maximum(np.frexp(v.astype(np.float64))[1].astype(np.int64) - 1, 1)
    second = v >> (high - 1) & 1
    small = v < 4
    return np.where(small, v, 2 * high + second), np.where(small, 0, v & ((1 << (high - 1)) - 1)), np.where(small, 0, high - 1)


def _references(pixels: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of the runs of three pixels or more that the latest like place gives, in order."""
    n = len(pixels)
    if n < 4:
        return []
    wide = pixels.astype(np.uint64)
    key = (wide[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (wide[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (wide[2:] * np.uint64(0x165667B19E3779F9))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    if not len(same):
        return []
    place, source = order[same + 1], order[same]
    by = np.argsort(place)
    place, source = place[by], source[by]
    found, k = [], 0
    while k < len(place):
        i, j = int(place[k]), int(source[k])
        most = min(REACH, n - i)
        differs = pixels[i : i + most] != pixels[j : j + most]
        length = int(differs.argmax())
        if not differs[length]:
            length = most
        if length < 3:
            k += 1
            continue
        found.append((i, length, i - j))
        k = int(np.searchsorted(place, i + length))
    return found


def _hits(pixels: np.ndarray, cache_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(slot of every pixel in the colour cache, whether it is there)."""
    slot = (pixels * np.uint32(CACHE_FACTOR)) >> np.uint32(32 - cache_bits)
    order = np.argsort(slot.astype(np.uint16), kind="stable")
    there = np.zeros(len(pixels), bool)
    there[order[1:]] = (slot[order[1:]] == slot[order[:-1]]) & (pixels[order[1:]] == pixels[order[:-1]])
    return slot.astype(np.int64), there


#: n log2 n of small n.
_XLOGX = np.arange(1 << 12) * np.log2(np.maximum(np.arange(1 << 12), 1))


def _xlogx(n: np.ndarray) -> np.ndarray:
    return _XLOGX[n] if n.max(initial=0) < len(_XLOGX) else n * np.log2(np.maximum(n, 1))


def _bits_of(counts: np.ndarray, each: int = 4) -> np.ndarray:
    """Estimated bits of symbols that occur so often (along the last axis), with so many bits for the code of each."""
    return _xlogx(counts.sum(-1)) - _xlogx(counts).sum(-1) + each * (counts > 0).sum(-1)


def _channel_bits(images: np.ndarray) -> np.ndarray:
    """Estimated bits of each of several images (k, n, 4 samples)."""
    k = len(images)
    offsets = np.arange(4 * k, dtype=np.int64).reshape(k, 1, 4) << 8
    return _bits_of(np.bincount((images + offsets).ravel(), minlength=1024 * k).reshape(k, 4, 256)).sum(1)


def _cache_for(pixels: np.ndarray, literal: np.ndarray, sizes: tuple[int, ...]) -> tuple[int, np.ndarray | None, np.ndarray | None]:
    """(size of the colour cache with the least estimated bits of the literals, its slots and hits)."""
    best = (0, None, None)
    samples = _bytes_of(pixels)
    least = None
    for cache_bits in sizes:
        slot, there = _hits(pixels, cache_bits)
        hit = literal & there
        few = int(hit.sum())
        if not few:
            continue
        # the slots, which literals are hits, and the other literals; lone slots are far apart in the green code
        own = np.bincount(slot[hit])
        if 10 * int((own > 0).sum()) > 32 * few:  # more than the hits' pixels
            continue
        if least is None:
            least = float(_channel_bits(samples[literal][None])[0])
        bits = float(_bits_of(own, 10)) + float(_bits_of(np.array([few, int(literal.sum()) - few])))
        if bits < least and (bits := bits + float(_channel_bits(samples[literal & ~there][None])[0])) < least:
            least, best = bits, (cache_bits, slot, there)
    return best


@lru_cache(64)
def _near_codes(width: int) -> dict[int, int]:
    """The least code of every distance that the distance map names."""
    return {max(1, x + y * width): k + 1 for k, (x, y) in reversed([*enumerate(DISTANCE_MAP)])}


_FIVE = np.arange(5)


def _bounds(greens: int) -> np.ndarray:
    """Where the five alphabets of a prefix group begin, one after the other, and their end."""
    return np.array([0, greens, greens + 256, greens + 512, greens + 768, greens + 808])


def _write_image(out: BitWriter, pixels: np.ndarray, main: bool, cache_bits: int | None = 0, references: bool = False, groups: np.ndarray | None = None, meta_bits: int = 0) -> None:
    """cache_bits: None for the size of least estimated bits."""
    height, width = pixels.shape
    flat = np.ascontiguousarray(pixels, np.uint32).ravel()
    found = _references(flat) if references else []
    literal = np.ones(len(flat), bool)
    for i, length, _ in found:
        literal[i : i + length] = False
    cache_bits, slot, there = _cache_for(flat, literal, CACHES) if cache_bits is None else (cache_bits, *(_hits(flat, cache_bits) if cache_bits else (None, None)))
    out.write(int(cache_bits > 0), 1)
    if cache_bits:
        out.write(cache_bits, 4)
    if main:
        out.write(int(groups is not None), 1)
        if groups is not None:
            out.write(meta_bits - 2, 3)
            _write_image(out, groups.astype(np.uint32) << np.uint32(8), False)
    # tokens by place: a literal, a place in the cache, or a reference
    starts = literal.copy()
    starts[[i for i, _, _ in found]] = True
    at = np.flatnonzero(starts)
    refers = ~literal[at]
    symbols = _bytes_of(flat[at])[:, [1, 2, 0, 3]].astype(np.int64)
    first = symbols[:, 0]
    cached = np.zeros(len(at), bool)
    if cache_bits:
        cached = there[at] & ~refers
        first[cached] = 280 + slot[at[cached]]
    if found:
        codes_of = _near_codes(width)
        length, length_extra, length_bits = _prefix(np.array([n for _, n, _ in found]))
        far, far_extra, far_bits = _prefix(np.array([codes_of.get(d, d + 120) for _, _, d in found]))
        first[refers] = 256 + length
    plain = ~(refers | cached)
    alphabets = (280 + (1 << cache_bits if cache_bits else 0),)
    of = np.zeros(len(at), np.int64) if groups is None else groups[at // width >> meta_bits, at % width >> meta_bits].astype(np.int64)
    value, size = np.zeros(len(at), np.uint64), np.zeros(len(at), np.int64)
    for g in range(1 if groups is None else int(groups.max()) + 1):
        own = of == g
        literals, references_ = (own & plain).nonzero()[0], own[refers] if found else None
        begin = _bounds(alphabets[0])
        merged = symbols[literals] + begin[:4]
        every = [first[own & ~plain], merged.ravel()]
        if found:
            every.append(begin[4] + far[references_])
        counts = np.bincount(np.concatenate(every), minlength=begin[5])
        owner = _FIVE.repeat(np.diff(begin))
        lengths = np.concatenate([_huffman(counts[a:b]) for a, b in zip(begin.tolist(), begin.tolist()[1:])])
        _write_codes(out, lengths, owner, begin)
        sizes, codes = _canonical(lengths, owner)
        rest = (own & ~plain).nonzero()[0]
        value[rest], size[rest] = codes[first[rest]], sizes[first[rest]]
        columns = np.ascontiguousarray(merged.T)
        each, bits = sizes.take(columns), codes.take(columns)
        end, whole = each[0], bits[0]
        for k in (1, 2, 3):
            whole |= bits[k] << end.view(np.uint64)
            end += each[k]
        value[literals], size[literals] = whole, end
        if found and references_.any():
            here, k = np.flatnonzero(refers)[references_], np.flatnonzero(references_)
            for more, n in ((length_extra[k], length_bits[k]), (codes[begin[4] + far[k]], sizes[begin[4] + far[k]]), (far_extra[k], far_bits[k])):
                value[here] |= more.astype(np.uint64) << size[here].astype(np.uint64)
                size[here] += n
    out.write_all(value, size)


def _container(stream: bytes) -> bytes:
    chunk = b"VP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def _header(out: BitWriter, width: int, height: int) -> None:
    if not (1 <= width <= MAX_SIDE and 1 <= height <= MAX_SIDE):
        raise ValueError("an image side is out of range")
    out.write(0x2F, 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 1)
    out.write(0, 3)


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), modes: np.ndarray | None = None, elements: np.ndarray | None = None, size_bits: int = 3, cache_bits: int | None = 0, references: bool = True, groups: np.ndarray | None = None, meta_bits: int = 2) -> bytes:
    """A lossless WebP file of ARGB pixels with the transforms and tools asked for."""
    height, width = pixels.shape
    out = BitWriter()
    _header(out, width, height)
    for kind in transforms:
        out.write(1, 1)
        out.write(kind, 2)
        height, width = pixels.shape
        shape = (_ceil_shift(height, size_bits), _ceil_shift(width, size_bits))
        if kind == PREDICTOR:
            own = np.full(shape, 11, np.int64) if modes is None else modes
            out.write(size_bits - 2, 3)
            _write_image(out, own.astype(np.uint32) << np.uint32(8), False)
            pixels = _predicted(pixels, own, size_bits)
        elif kind == CROSS_COLOUR:
            own = np.zeros(shape, np.uint32) if elements is None else elements.astype(np.uint32)
            out.write(size_bits - 2, 3)
            _write_image(out, own, False)
            pixels = _cross_colour(pixels, own, size_bits, -1)
        elif kind == SUBTRACT_GREEN:
            pixels = _subtract_green(pixels, -1)
        else:
            colours, index = np.unique(pixels, return_inverse=True)
            if len(colours) > 256:
                raise ValueError("too many colours for a palette")
            out.write(len(colours) - 1, 8)
            s = _bytes_of(colours).astype(np.int64)
            s[1:] -= s[:-1].copy()
            _write_image(out, _pixels_of((s & 255).astype(np.uint8))[None, :], False)
            index, b = index.reshape(height, width).astype(np.uint32), _palette_bits(len(colours))
            if b:
                each, wide = 8 >> b, _ceil_shift(width, b)
                index = np.pad(index, ((0, 0), (0, (wide << b) - width))).reshape(height, wide, 1 << b)
                index = sum((index[..., k] << np.uint32(k * each) for k in range(1 << b)), np.zeros((height, wide), np.uint32))
            pixels = np.uint32(OPAQUE_BLACK) | index << np.uint32(8)
    out.write(0, 1)
    _write_image(out, pixels, True, cache_bits, references, groups, meta_bits)
    return _container(out.done())


def transforms_for(pixels: np.ndarray) -> tuple[tuple[int, ...], np.ndarray | None]:
    """(transforms, modes of the predictor) of the least estimated bits."""
    height, width = pixels.shape
    own = _bytes_of(pixels)
    tried = np.empty((6, height, width, 4), np.uint8)
    tried[0] = tried[3] = own
    tried[3, ..., 0] -= own[..., 1]
    tried[3, ..., 2] -= own[..., 1]
    for k in (0, 3):
        _neighbours(tried[k], tried[k + 1], 1)
        _neighbours(tried[k], tried[k + 2], 2)
    bits = _channel_bits(tried.reshape(6, -1, 4)) + (0, 64, 64, 0, 64, 64)
    k = int(bits.argmin())
    if len(own) > 1 or width > 1:
        ordered = np.sort(pixels, axis=None)
        start = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        if len(start) <= min(256, pixels.size // 2):
            steps = np.diff(_bytes_of(ordered[start]), axis=0, prepend=np.zeros((1, 4), np.uint8))
            if float(_bits_of(np.diff(start, append=len(ordered)))) + float(_channel_bits(steps[None])[0]) < bits[k]:
                return (PALETTE,), None
    kinds = (SUBTRACT_GREEN,) if k >= 3 else ()
    if k % 3 == 0:
        return kinds, None
    return (*kinds, PREDICTOR), np.full((_ceil_shift(height, SIZE_BITS), _ceil_shift(width, SIZE_BITS)), k % 3, np.int64)


def _neighbours(own: np.ndarray, out: np.ndarray, mode: int) -> None:
    """What the predictor of the left (1) or upper (2) neighbour leaves of an image's samples."""
    out[...] = own
    out[0, 1:] -= own[0, :-1]
    out[1:, 0] -= own[:-1, 0]
    out[1:, 1:] -= own[1:, :-1] if mode == 1 else own[:-1, 1:]
    out[0, 0, 3] += np.uint8(1)  # less 255


#: Sides of the blocks that name a predictor, as a power of two: the largest.
SIZE_BITS = 9


# --- payloads -------------------------------------------------------------


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes with zeros up to a positive multiple of 64, and their number without the zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * ((-len(raw)) % BLOCK or (0 if raw else BLOCK)), len(raw)


def store(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as the R, G, B, A samples of an image."""
    n = len(payload) // 4
    width = 16 * -(-n // (16 * MAX_SIDE))
    height = -(-n // width)
    samples = np.frombuffer(payload.ljust(4 * width * height, b"\0"), np.uint8).reshape(-1, 4)
    pixels = _pixels_of(samples[:, [2, 1, 0, 3]]).reshape(height, width)
    transforms, modes = transforms_for(pixels)
    return encode(pixels, transforms, modes, size_bits=SIZE_BITS, cache_bits=None)


def load(media: bytes, payload_bytes: int) -> np.ndarray:
    """The payload's samples."""
    return _bytes_of(decode(media).ravel())[:, [2, 1, 0, 3]].reshape(-1)[:payload_bytes]


def load_all(media: list[bytes], payload_bytes: list[int]) -> list[np.ndarray]:
    """load() of each."""
    return [_bytes_of(p.ravel())[:, [2, 1, 0, 3]].reshape(-1)[:n] for p, n in zip(decode_all(media), payload_bytes)]


def features(samples: np.ndarray) -> str:
    """Moments, distinct values and a 16-bin histogram of 8-bit samples, as exact integers."""
    counts = np.bincount(samples, minlength=256)
    value = np.arange(256)
    bins = ",".join(map(str, counts.reshape(16, 16).sum(1).tolist()))
    return f"n={len(samples)};sum={int(counts @ value)};squares={int(counts @ (value * value))};distinct={int((counts > 0).sum())};bins={bins}"


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, media): the stored form of every text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, padded, media = [], [], []
        for text in batch.column(1):
            payload, size = payload_of(text.as_py())
            n.append(size)
            padded.append(len(payload))
            media.append(store(payload))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(padded, pa.int64()), pa.array(media, pa.binary())], [id_col, "n_bytes", "payload_bytes", "media"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, text_col), run, f"{id_col} {kind}, n_bytes bigint, payload_bytes bigint, media binary")


def pixel_columns(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, width, height, pixels array<int>) of a column ``media``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        width, height, pixels = [], [], []
        for media in batch.column(1):
            image = decode(media.as_py())
            height.append(image.shape[0])
            width.append(image.shape[1])
            pixels.append(image.ravel().view(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(width, pa.int32()), pa.array(height, pa.int32()), pa.array(pixels, pa.list_(pa.int32()))], [id_col, "width", "height", "pixels"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(id_col, "media"), run, f"{id_col} {kind}, width int, height int, pixels array<int>")


def digest_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store, read back and describe every text within its task; the media bytes do not leave it.

    A few thousand stored forms are read back together: the longer the list, the less a step of the decoder costs each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        rows: list[tuple] = []
        sizes: list[int] = []
        padded: list[int] = []
        held: list[bytes] = []

        def read_back() -> None:
            for size, media, samples in zip(sizes, held, load_all(held, padded)):
                back = samples.tobytes()
                rows.append((size, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)))
            for x in (sizes, padded, held):
                x.clear()

        def out() -> pa.RecordBatch:
            read_back()
            columns = [pa.concat_arrays(ids), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))]
            ids.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids.append(batch.column(0))
            waiting = sum(padded)
            for text in batch.column(1):
                payload, size = payload_of(text.as_py())
                sizes.append(size)
                padded.append(len(payload))
                held.append(store(payload))
                waiting += len(payload)
                if waiting >= READ_BYTES:
                    read_back()
                    waiting = 0
            if len(rows) + len(held) >= READ_ROWS:
                yield out()
        if ids:
            yield out()

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df.select(id_col, text_col), run, f"{id_col} {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")


def op5_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_columns(table(spark, sf_dir, "documents"))
