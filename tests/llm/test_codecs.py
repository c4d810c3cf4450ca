"""Byte-pair codec, packing and lossless images against other implementations and exact round trips."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import bpe, packing, webp

ODD = [None, "", " ", "a", "The theme's end.", "É é Σ İ ß ﬁ", "x" * 5000, "a\x1cb c\x85d\xa0e", "<|endoftext|>x<|startoftext|>", "１２ 3a\t\n\x0b!?…", "don't WE'LL", "中文 字", "é e", "\x00\x01", "😀" * 20]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    return t


def _same(reference, text):
    want = reference.encode(text or "", add_special_tokens=False).ids
    codec = bpe.codec(bpe.default_path())
    assert codec.encode(text) == want
    assert codec.decode(want) == reference.decode(want, skip_special_tokens=False)
    got = b"".join(packing.WordIds(bpe.default_path()).texts([text]))
    assert np.frombuffer(got, "<u4").tolist() == want


@pytest.mark.parametrize("text", ODD)
def test_ids_equal_the_library(reference, text):
    _same(reference, text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abXYzé'sdl .,!?#1 \n\tñüßΣ<|>"), max_size=60))
def test_ids_equal_the_library_on_random_texts(reference, text):
    _same(reference, text)


def test_stale_entries():
    codec = bpe.codec(bpe.default_path())
    assert codec.decode(codec.merge(b"aaaaaaaaaaaaaaaa")).replace(" ", "").replace("</w>", "") == "a" * 16


def _levels(packer, size):
    """The level by trying all of them."""
    best = None
    for h in range(packer.capacity):
        if h + size > packer.capacity or h and not packer.counts[h]:
            continue
        n = packer.counts.copy()
        if h:
            n[h] -= 1
        if h + size < packer.capacity:
            n[h + size] += 1
        cost = int((n[1:] ** 2).sum())
        if best is None or cost <= best[0]:
            best = (cost, h)
    return best


def test_packing_level_is_the_smallest_sum_of_squares():
    rng = random.Random(3)
    packer = packing.SumOfSquaresPacker(64)
    for _ in range(800):
        size = rng.randint(1, 63)
        cost, h = _levels(packer, size)
        own = packer.level(size)
        n = packer.counts.copy()
        if own:
            n[own] -= 1
        if own + size < 64:
            n[own + size] += 1
        assert int((n[1:] ** 2).sum()) == cost
        assert own == h
        packer.place("k", b"\0\0\0\0" * size)


def test_packing_keeps_every_id_once():
    rng = random.Random(5)
    packer, rows, docs = packing.SumOfSquaresPacker(64), [], {}
    for key in range(300):
        ids = np.array([rng.randrange(1000) for _ in range(rng.choice([1, 5, 30, 64, 65, 200]))], "<u4")
        docs[key] = ids
        rows += packer.place(key, ids.tobytes())
    rows += packer.finish()
    seen, fill = {k: [] for k in docs}, {}
    for key, start, length, crc, total, window, at in rows:
        assert fill.get(window, 0) == at and total == len(docs[key])
        assert crc == zlib.crc32(docs[key][start : start + length].tobytes())
        fill[window] = at + length
        seen[key].append((start, length))
    for key, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(docs[key])
    assert all(n == 64 or n & (n - 1) == 0 for n in fill.values())


def test_packing_keeps_open_windows_at_the_end():
    packer, ids = packing.SumOfSquaresPacker(64), lambda n: b"\1\0\0\0" * n
    for level, n in ((40, 3), (20, 1), (60, 2)):
        packer.open[level] = [[(f"{level}.{k}", 0, ids(level), level)] for k in range(n)]
    rows = packer.finish()
    first = {w: (key, n) for key, _, n, _, _, w, at in rows if at == 0 and key[:2] in ("60", "40") and n == int(key[:2])}
    # 2 x 60 and two of the 40s stay whole; the 20 and one of the 40s are what fills them
    assert len(first) >= 4 and sum(r[2] for r in rows) == 3 * 40 + 20 + 2 * 60
    assert len({r[5] for r in rows}) == 260 // 64 + bin(260 % 64).count("1")


def test_word_memo_is_bounded(reference):
    own = packing.WordIds(bpe.default_path(), memory=50 * packing.WordIds.ENTRY)
    texts = [" ".join(f"w{k}x{j}" for j in range(40)) + " " + "long" * 40 for k in range(300)]
    got = list(own.texts(iter(texts)))
    assert [len(x) // 4 for x in got] == [len(reference.encode(t, add_special_tokens=False).ids) for t in texts]
    assert max(map(len, own.known)) <= own.LONGEST and len(own.known) + len(own.old) < 64 * 50 * 4


def test_words_are_learned_from_their_symbols(reference):
    class Counted:
        """The tokenizer, but texts that are encoded whole are counted."""

        def __init__(self):
            self.model, self.calls = reference.model, 0

        def encode(self, *args, **more):
            self.calls += 1
            return reference.encode(*args, **more)

    own = packing.WordIds(bpe.default_path())
    own.tokenizer = counted = Counted()
    latin = "".join(map(chr, range(256)))
    texts = [latin, " ".join(latin), "x" * 70000, "Déjà 12 vu… ß's ''s !'re \x7f\xad", "中 é", "a<|endoftext|>b"]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.texts(iter(texts))]
    assert got == [reference.encode(t, add_special_tokens=False).ids for t in texts]
    assert counted.calls == 3  # beyond Latin-1 (…, 中), added tokens


def test_packing_query(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(ODD)], "doc_id bigint, text string, length string")
    rows = packing.pack_documents(df, bpe.default_path()).collect()
    for i, t in enumerate(ODD):
        want = np.array(reference.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) * 4 == len(want) and all(r.doc_tokens * 4 == len(want) for r in own)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(want[4 * r.start : 4 * (r.start + r.length)]) for r in own]
    assert packing.pack_documents(df.limit(0), bpe.default_path()).count() == 0


def test_bpe_tables(spark):
    df = spark.createDataFrame([(1, "The end", 5), (1, "The end", 5), (None, None, None)], "doc_id bigint, text string, ids int")
    own = bpe.encode_documents(df, bpe.default_path()).collect()
    assert len(own) == 3 and own[0].ids == own[1].ids and own[2].ids == [] and own[2].decoded == ""
    assert bpe.digest_documents(df, bpe.default_path()).filter("n_tokens = 0").count() == 1


def _image(rng, h, w, colours):
    if colours:
        return rng.integers(0, 2**32, colours, dtype=np.uint32)[rng.integers(0, colours, (h, w))]
    return rng.integers(0, 2**32, (h, w), dtype=np.uint32)


@pytest.mark.parametrize("transforms", [(), (0,), (1,), (2,), (3,), (2, 0), (0, 1, 2)])
@pytest.mark.parametrize("cache_bits", [0, 1, 6])
def test_images_round_trip(transforms, cache_bits):
    rng = np.random.default_rng(7)
    for h, w in ((1, 1), (1, 9), (7, 1), (13, 18)):
        for colours in (None, 1, 2, 4, 16, 100):
            p = _image(rng, h, w, colours)
            if 3 in transforms and len(np.unique(p)) > 256:
                continue
            hh, ww = webp._ceil_shift(h, 2), webp._ceil_shift(w, 2)
            groups = rng.integers(0, 3, (hh, ww)) if cache_bits == 1 and 3 not in transforms else None
            data = webp.encode(p, transforms, rng.integers(0, 14, (hh, ww)), rng.integers(0, 2**24, (hh, ww), dtype=np.uint32), 2, cache_bits, True, groups, 2)
            assert (webp.decode(data) == p).all()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.integers(1, 40))
def test_payloads_round_trip(text, times):
    payload, n = webp.payload_of(text * times)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload[:n] == (text * times).encode("utf-8", "surrogatepass")
    media = webp.store(payload)
    assert webp.load(media, len(payload)).tobytes() == payload
    assert webp.store(payload) == media


def test_damaged_images_raise():
    media = webp.store(webp.payload_of("some text of a document")[0])
    for broken in (b"", media[:30], b"RIFX" + media[4:], media[:20] + b"\0" + media[21:]):
        with pytest.raises(ValueError):
            webp.decode(broken)


def test_image_columns(spark):
    df = spark.createDataFrame([(1, "abc abc " * 99, b"q"), (2, None, b"q"), (3, "", None), (4, "é" * 70000, None)], "doc_id bigint, text string, media binary")
    stored = webp.media_columns(df)
    pixels = {r.doc_id: r for r in webp.pixel_columns(stored).collect()}
    digests = {r.doc_id: r for r in webp.digest_columns(df).collect()}
    assert pixels[2].width * pixels[2].height == 16 and digests[2].n_bytes == 0 and digests[2].payload_bytes == 64
    assert digests[2].media_sha256 == digests[3].media_sha256
    assert digests[4].payload_bytes == 140032 and digests[4].tail_crc32 == zlib.crc32(("é" * 70000).encode().ljust(140032, b"\0")[-64:])


def test_ordinary_payloads_go_through_the_whole_encoder(monkeypatch):
    """Huffman codes, references, colour cache, palette and transforms are on the way of payloads that are not mostly repetition."""
    seen = {"lengths": set(), "references": 0}
    code, extra = webp.PrefixCode, webp._extra

    def watched(lengths):
        own = np.asarray(lengths)
        if len(own) >= 256:
            seen["lengths"].add(len(set(own[own > 0].tolist())))
        return code(lengths)

    def counted(*args):
        seen["references"] += 1
        return extra(*args)

    monkeypatch.setattr(webp, "PrefixCode", watched)
    monkeypatch.setattr(webp, "_extra", counted)
    rng = random.Random(2)
    words = ["".join(rng.choice("eeeeeetttaaoinshrdlucmfwypvbgkjqxz") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    prose = " ".join(rng.choice(words) for _ in range(700))
    payload, _ = webp.payload_of(prose)
    assert len(zlib.compress(payload, 1)) > len(payload) // 3
    assert webp.load(webp.store(payload), len(payload)).tobytes() == payload
    assert max(seen["lengths"]) > 3
    twice, _ = webp.payload_of(prose[:2000] + prose[400:520] + prose[2000:])
    seen["references"] = 0
    media = webp.store(twice)
    assert webp.load(media, len(twice)).tobytes() == twice and seen["references"] >= 2
    assert len(media) < len(webp.store(payload)) + 60

    ramp = np.cumsum(np.array([[rng.choice((1, 2, 3)) for _ in range(4)] for _ in range(4096)]), 0).astype(np.uint8).tobytes()
    grey = b"".join(bytes([v, v, v, rng.randrange(256)]) for v in (rng.randrange(256) for _ in range(4096)))
    few = b"".join(rng.choice([b"abcd", b"wxyz", b"1234", b"    "]) for _ in range(4096))
    for data, kind in ((ramp, webp.PREDICTOR), (grey, webp.SUBTRACT_GREEN), (few, webp.PALETTE)):
        pixels = webp._pixels_of(np.frombuffer(data, np.uint8).reshape(-1, 4)[:, [2, 1, 0, 3]]).reshape(-1, 16)
        assert kind in webp.transforms_for(pixels)[0]
        assert webp.load(webp.store(data), len(data)).tobytes() == data


def test_stored_forms_are_read_together(monkeypatch):
    """Many streams advance together, whatever their lengths, references, caches and transforms; damage is noticed."""
    rng = random.Random(8)
    words = ["".join(rng.choice("eeeetaoinshrdluüж中") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 40, 200, 400)))) for _ in range(120)]
    texts = [*prose, *ODD, *(x * 3 for x in prose[:20]), "ab" * 700, "\n".join(words[:9] * 40), "".join(map(chr, range(32, 3000)))]
    payloads = [webp.payload_of(t)[0] for t in texts]
    pixels = np.random.default_rng(1).integers(0, 1 << 32, (40, 16), dtype=np.uint32)
    pixels[20:] = pixels[:20] ^ np.uint32(1)
    files = [*map(webp.store, payloads), webp.encode(pixels, cache_bits=5), webp.encode(pixels, groups=np.arange(40).reshape(10, 4) % 3)]
    one_by_one, alone = [webp.decode(x) for x in files], []
    group = webp._read_group
    monkeypatch.setattr(webp, "_read_group", lambda *args: alone.append(args[3]) or group(*args))
    together = webp.decode_all(files)
    assert all((a == b).all() and a.shape == b.shape for a, b in zip(together, one_by_one)) and len(together) == len(files)
    assert [x.tobytes() for x in webp.load_all(files[: len(payloads)], [len(x) for x in payloads])] == payloads
    assert len([n for n in alone if n > 256]) < 40  # palettes and the like are read by themselves
    assert webp.decode_all([]) == []
    stream = files[0][20:-8]
    damaged = webp._container(stream)
    with pytest.raises(ValueError):
        webp.decode(damaged)
    for at in (0, 60):
        with pytest.raises(ValueError):
            webp.decode_all([*files[:at], damaged, *files[at:120]])


def test_codes_of_code_lengths_are_complete():
    for lengths in webp.LENGTH_LENGTHS:
        assert len(lengths) == 19 and all(lengths) and sum(2.0**-n for n in lengths) == 1


def test_long_and_odd_payloads_round_trip():
    rng = np.random.default_rng(4)
    skewed = np.minimum(rng.geometric(0.3, 300_000), 255).astype(np.uint8)
    same = bytes(5_000_000)
    for data in (skewed.tobytes(), rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes(), same, skewed[:90_000].tobytes() * 3, bytes(range(256)) * 40):
        payload = data + bytes(-len(data) % 64)
        media = webp.store(payload)
        assert webp.load(media, len(payload)).tobytes() == payload


@pytest.fixture(scope="module")
def libwebp():
    import ctypes
    import ctypes.util

    name = ctypes.util.find_library("webp")
    if not name:
        pytest.skip("no libwebp")
    lib = ctypes.CDLL(name)
    lib.WebPDecodeRGBA.restype = ctypes.c_void_p
    lib.WebPDecodeRGBA.argtypes = [ctypes.c_char_p, ctypes.c_size_t, ctypes.POINTER(ctypes.c_int), ctypes.POINTER(ctypes.c_int)]
    lib.WebPEncodeLosslessRGBA.restype = ctypes.c_size_t
    lib.WebPEncodeLosslessRGBA.argtypes = [ctypes.c_char_p, ctypes.c_int, ctypes.c_int, ctypes.c_int, ctypes.POINTER(ctypes.c_void_p)]
    lib.WebPFree.argtypes = [ctypes.c_void_p]

    class Library:
        def decode(self, media):
            w, h = ctypes.c_int(), ctypes.c_int()
            at = lib.WebPDecodeRGBA(media, len(media), w, h)
            assert at
            out = ctypes.string_at(at, 4 * w.value * h.value)
            lib.WebPFree(at)
            return out

        def encode(self, samples, width):
            at = ctypes.c_void_p()
            n = lib.WebPEncodeLosslessRGBA(samples, width, len(samples) // 4 // width, 4 * width, at)
            out = ctypes.string_at(at, n)
            lib.WebPFree(at)
            return out

    return Library()


def test_another_implementation_reads_and_writes_the_same(libwebp, sf_dir):
    import duckdb

    rng = np.random.default_rng(6)
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{sf_dir}/documents.parquet' ORDER BY doc_id").fetchall()]
    payloads = [webp.payload_of(t)[0] for t in texts] + [rng.integers(0, 256, 6400, dtype=np.uint8).tobytes(), bytes(range(256)) * 30, bytes(64_000)]
    for payload in payloads:
        media = webp.store(payload)
        assert libwebp.decode(media)[: len(payload)] == payload
    for payload in payloads[::4]:
        samples = bytearray(payload)
        samples[3::4] = bytes(b or 1 for b in samples[3::4])  # the library clears colours under a transparent pixel
        samples = bytes(samples)
        assert webp.load(libwebp.encode(samples, 16), len(samples)).tobytes() == samples
