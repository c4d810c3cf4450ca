"""Shingle join and fuzzy lines against brute force, with hot groups and odd rows."""

import random

import numpy as np
import pytest

from tallyframe.llm import hashing, jaccard, line_dedup, linking
from tallyframe.llm.common import Scratch


def words(rng, n):
    return [rng.choice("ab bc cd de ef fg gh hi ij jk kl lm mn no op pq qr rs st tu uv vw wx".split()) + rng.choice("xyzuvw") for _ in range(n)]


def brute_components(texts):
    import re

    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            inter, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if union and 100 * inter >= 80 * union:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    texts, base = {}, words(rng, 150)
    for i in range(120):  # a hot group of near copies, a shared passage, short and odd texts
        w = list(base)
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = "changed" + str(rng.randrange(50))
        texts[i] = " ".join(w)
    passage = words(rng, 60)
    for i in range(120, 200):
        texts[i] = " ".join(words(rng, 100) + passage)
    for i in range(200, 260):
        texts[i] = " ".join(words(rng, rng.randrange(1, 9)))
    for i, t in enumerate(["", None, "   ", "one", "ONE", "a b c d", "A B\tC\nD", "x " * 3000, base and " ".join(base).upper()]):
        texts[300 + i] = t
    return texts


@pytest.mark.parametrize("bucket", [1024, 16])
def test_shingle_join_equals_brute_force(spark, corpus, monkeypatch, bucket):
    monkeypatch.setattr(linking, "BUCKET", bucket)
    df = spark.createDataFrame([(i, t, 0) for i, t in corpus.items()], "doc_id bigint, text string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components(df).collect()}
    assert got == brute_components(corpus)


def test_shingle_join_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f"), (3, "A b c d e f")], "doc_id bigint, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.components(df).collect())
    assert got == [(-1, -1), (-1, 3), (3, 3), (5, 3), (5, 3)]
    assert jaccard.components(df.limit(0)).count() == 0
    kept = jaccard.keep_representatives(df)
    assert kept.columns == df.columns and sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, ""), (3, "A b c d e f")]


def test_one_row_of_a_component_stays(spark):
    line = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [("x", line, 1), ("x", line + " new", 2), (None, "0 " + line, 3), (None, "p q r s t v", 4), ("y", "", 5), ("y", "", 5), ("z", None, 6)]
    df = spark.createDataFrame(rows, "doc_id string, text string, k int").withColumnRenamed("k", "name")
    kept = sorted(r.name for r in jaccard.keep_representatives(df).collect())
    assert len(kept) == 4 and kept[0] in (1, 2) and kept[1:] == [4, 5, 6]
    assert {r.name: r.component_id for r in jaccard.components(df.withColumn("name", df.name)).join(df, "doc_id").collect()}.get(1) == "x"


def test_signature_tree_loses_no_pair():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = rng.integers(0, 2**63, 80, dtype=np.uint64)
        for _ in range(3):
            own = base.copy()
            own[: rng.integers(0, 20)] = rng.integers(0, 2**63, 1, dtype=np.uint64)
            sets.append(np.unique(own))
    sets.sort(key=len)
    bitmaps = np.stack([np.frombuffer(jaccard.fold(jaccard.describe(s)[2], 512), np.uint64) for s in sets])
    x, y = jaccard.SignatureTree(np.array([len(s) for s in sets]), bitmaps).pairs()
    found = set(zip(x.tolist(), y.tolist()))
    true = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}
    assert true <= found and len(found) < len(sets) * 8


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)] + [(500, 500 + i) for i in range(1, 90)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in linking.connected_components(df, Scratch(spark)).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: find(i) for i in linked}
    assert linking.connected_components(df.limit(0), Scratch(spark)).count() == 0


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_few_edges_are_contracted_in_one_task(spark, monkeypatch, most):
    rng = random.Random(7)
    monkeypatch.setattr(linking, "CONTRACTED", most)
    edges = [(rng.randrange(-90, 90), rng.randrange(-90, 90)) for _ in range(70)] + [(i, i - 1) for i in range(200, 230)] + [(600, 500 + i) for i in range(40)] + [(7, 7)]
    scratch = Scratch(spark)
    got = {r.node: r.component for r in linking.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), scratch).collect()}
    node, component = linking.smallest(*np.array([e for e in edges if e[0] != e[1]]).T)
    assert got == dict(zip(node.tolist(), component.tolist()))
    assert all(got[a] == got[b] <= min(a, b) for a, b in edges if a != b) and all(got[c] == c for c in got.values())
    assert (scratch.count == 1) == (most > 0)  # tables written, each a plan that the driver holds


def test_word_hashes_follow_the_words():
    rng = random.Random(9)
    for _ in range(300):
        t = "".join(rng.choice(["a", "B", "é", " ", "\t", "\n", "\x0b", "1", "\xa0"]) for _ in range(rng.randrange(30)))
        raw = t.encode()
        own = hashing.word_hashes(raw)
        parts = raw.lower().split()
        assert len(own) == len(parts)
        for h, p in zip(own, parts):
            assert hashing.word_hashes(p)[0] == h
    assert len(set(hashing.word_hashes(b" ".join(b"%d" % i for i in range(20000))).tolist())) == 20000


def brute_lines(docs):
    """Lost lines by the edit similarity of all pairs of lines."""
    lines = [(i, n, x.decode("utf-8", "replace")) for i in sorted(docs) for n, x in enumerate(line_dedup.normalised(docs[i])) if x]
    root = list(range(len(lines)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def distance(a, b):
        row = list(range(len(b) + 1))
        for x, ca in enumerate(a, 1):
            last, row[0] = row[0], x
            for y, cb in enumerate(b, 1):
                last, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, last + (ca != cb))
        return row[-1]

    for x, (*_, a) in enumerate(lines):
        for y in range(x + 1, len(lines)):
            b = lines[y][2]
            if a == b or 5 * abs(len(a) - len(b)) <= max(len(a), len(b)) and 5 * distance(a, b) <= max(len(a), len(b)):
                p, q = find(x), find(y)
                root[max(p, q)] = min(p, q)
    lost = {}
    for x, line in enumerate(lines):
        if find(x) != x:
            lost.setdefault(line[0], set()).add(line[1])
    return lost


def fuzzy_docs(rng, n):
    base = [" ".join(words(rng, rng.randrange(3, 60))) for _ in range(12)]
    docs = {}
    for i in range(n):
        own = []
        for _ in range(rng.randrange(1, 5)):
            line = rng.choice(base).split()
            for _ in range(rng.randrange(0, 1 + len(line) // 15)):
                line[rng.randrange(len(line))] = rng.choice(["q", "changed", ""])
            if rng.random() < 0.3:
                line[rng.randrange(len(line))] += "q"
            own.append(" ".join(line).capitalize() + rng.choice(["", ".", " 12", "!"]))
        docs[i] = "\n".join([*own, "short one", ""])
    return docs


@pytest.mark.parametrize(("gathered", "bucket", "lags"), [(8, 4096, 64), (1, 16, 3)])
def test_lines_equal_brute_force(spark, monkeypatch, gathered, bucket, lags):
    monkeypatch.setattr(line_dedup, "GATHERED", gathered)
    monkeypatch.setattr(line_dedup, "LAGS", lags)
    monkeypatch.setattr(line_dedup, "DEALT", 1 << 14)
    monkeypatch.setattr(line_dedup, "SIGNED", 1 << 11)
    monkeypatch.setattr(linking, "BUCKET", bucket)
    docs = fuzzy_docs(random.Random(6), 40)
    df = spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in docs.items()], "doc_id bigint, text string, line string, _id int, id int, component int")
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == [*df.columns, "removed_lines"]
    lost = brute_lines(docs)
    assert sum(map(len, lost.values())) > 10
    for r in got.collect():
        assert set(r.removed_lines) == lost.get(r.doc_id, set())
        assert r.text == "\n".join(x for k, x in enumerate(docs[r.doc_id].split("\n")) if k not in r.removed_lines)
        assert (r._id, r.id, r.component) == (1, 2, 3)


def test_pairs_of_groups():
    """paired() names near pairs only, one with an earlier row for each row, and the rows of groups with more."""
    rng = np.random.default_rng(5)
    g = np.sort(rng.integers(0, 40, 600))
    sim = rng.integers(0, 4, 600).astype(np.uint64) * np.uint64(0x1111111111111111) * np.uint64(3)
    size, node = np.full(600, 100, np.uint16), np.arange(600)
    i, j, more = line_dedup.paired(g, node, sim, size)
    assert (g[i] == g[j]).all() and (i < j).all() and len(set(j.tolist())) == len(j) and line_dedup.near(sim, size, i, j).all()
    for k in range(40):
        rows = np.flatnonzero(g == k).tolist()
        all_pairs = [(x, y) for x in rows for y in rows if x < y and line_dedup.near(sim, size, np.array([x]), np.array([y]))[0]]
        own = [p for p in zip(i.tolist(), j.tolist()) if g[p[0]] == k]
        assert set(own) <= set(all_pairs)
        if len(all_pairs) > len(own):
            assert {x for p in all_pairs for x in p} <= set(more.tolist())


def test_edit_distance():
    rng = random.Random(12)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for x, ca in enumerate(a, 1):
            last, row[0] = row[0], x
            for y, cb in enumerate(b, 1):
                last, row[y] = row[y], min(row[y] + 1, row[y - 1] + 1, last + (ca != cb))
        return row[-1]

    for _ in range(500):
        a = "".join(rng.choice("abcé") for _ in range(rng.randrange(40)))
        b = "".join(c for c in a if rng.random() > 0.1) if rng.random() < 0.5 else "".join(rng.choice("abcé") for _ in range(rng.randrange(40)))
        assert line_dedup.edit_distance(a, b) == plain(a, b)


def test_lines_odd_rows(spark):
    line = "one two three four five six"
    df = spark.createDataFrame([(None, line), (1, None), (2, ""), (3, line), (3, line), (4, f"{line}\n{line}")], "doc_id bigint, text string")
    got = sorted(((r.doc_id or -1), r.text or "-") for r in line_dedup.drop_repeated_lines(df).collect())
    assert got == [(-1, line), (1, "-"), (2, "-"), (3, "-"), (3, "-"), (4, "-")]
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_few_edits_and_similar():
    rng = random.Random(13)
    for _ in range(300):
        a = "".join(rng.choice("ab c") for _ in range(rng.randrange(60)))
        b = "".join(c for c in a if rng.random() > 0.1) + rng.choice(["", "ab"])
        d = line_dedup.edit_distance(a, b)
        assert [line_dedup.few_edits(a, b, k) for k in (d - 1, d, d + 3) if k >= 0] == [False, True, True][-(3 if d else 2) :]
        assert line_dedup.similar(a, b) == (d <= int(0.2 * max(len(a), len(b)) + 1e-9))
    pairs = []
    for _ in range(600):
        a = "".join(rng.choice("abcdefghijkl é中 ") for _ in range(rng.choice([3, 12, 64, 65, 130, 400, 700])))
        rate = rng.choice([0, 0.1, 0.19, 0.22, 0.6])
        if len(pairs) >= 300:  # more characters than a table has
            a = "".join(chr(0x4E00 + 3 * rng.randrange(400)) if rng.random() < 0.5 else c for c in a)
        pairs.append((a, "".join(rng.choice([c + "x", "", "y", " "]) if rng.random() < rate else c for c in a)))
    got = line_dedup.all_similar([a for a, _ in pairs], [b for _, b in pairs])
    want = [line_dedup.edit_distance(a, b) <= line_dedup.allowed(a, b) for a, b in pairs]
    assert got.tolist() == want and 100 < sum(want) < 500
    long = "".join(rng.choice("abcdefgh ") for _ in range(1 << 20))
    assert line_dedup.similar(long, long[:1000] + "x" + long[1003:500_000] + long[500_010:] + "end")


def test_bit_counts():
    rng = np.random.default_rng(3)
    value, first = rng.integers(0, 2**63, 3000, dtype=np.uint64), np.array([0, 1, 400, 655, 910, 2990])
    count = np.diff(np.r_[first, len(value)])
    bits = np.unpackbits(value.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    assert (line_dedup.bit_counts(value, first, count) == np.add.reduceat(bits, first, axis=0)).all()


def test_signatures_do_not_depend_on_neighbours():
    lines = [b"one two three four", b"x", "\u8fd9\u662f\u4e00\u884c".encode(), b"a" * 300, b"one two three four five six seven eight nine"]
    for n, every in ((4, True), (6, False)):
        sims, keys = line_dedup.signatures(lines, n, every)
        for k, x in enumerate(lines):
            s, own = line_dedup.signatures([x], n, every)
            assert s[0] == sims[k] and (own[0] == keys[k]).all()


def test_short_and_unspaced_lines_are_joined(spark):
    chinese = "\u8fd9\u662f\u4e00\u884c\u6ca1\u6709\u7a7a\u683c\u7684\u6587\u5b57"
    df = spark.createDataFrame([(1, f"All rights reserved\n{chinese}"), (2, f"own words\nall rights reserved.\n\n{chinese}"), (3, "Page 3\n \n-"), (4, "page 8\n \n-")], "doc_id bigint, text string")
    got = {r.doc_id: (r.removed_lines, r.text) for r in line_dedup.drop_repeated_lines(df).collect()}
    assert got[1][0] == [] and got[2] == ([1, 3], "own words\n")
    assert got[3][0] == [] and got[4] == ([0], " \n-")


def test_lines_of_one_edit_meet(spark):
    rng = random.Random(21)
    docs, pairs = {}, 40
    for i in range(pairs):  # one letter more in one word
        line = [rng.choice("abcdefghijklmnopqrstuvwxyz") + w for w in words(rng, rng.randrange(2, 60))]
        docs[i] = " ".join(line)
        line[rng.randrange(len(line))] += "q"
        docs[1000 + i] = " ".join(line)
    docs[2000], docs[2001] = "abcde", "abxde"
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {r.doc_id for r in line_dedup.drop_repeated_lines(df).collect() if r.removed_lines}
    assert 2001 in got and got <= {*range(1000, 1000 + pairs), 2001}
    assert len(got) >= 0.97 * pairs


def test_changed_words_are_settled_by_words(monkeypatch):
    """Words inserted, dropped and moved in a line are no work for the character tables; what is settled by words is similar."""
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcdeö") for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    pairs = []
    for _ in range(300):
        x = [rng.choice(pool) for _ in range(rng.randrange(1, 60))]
        y = list(x)
        for _ in range(rng.randrange(0, 1 + len(x) // 3)):
            k = rng.randrange(len(y) + 1)
            y[k : k + rng.choice((0, 1, 1))] = [rng.choice(pool)] * rng.choice((0, 1, 1))
        pairs.append((" ".join(x), " ".join(y)))
    for a, b in [*pairs, ("", "abc"), ("abc", ""), ("", ""), ("a b", "b a"), ("a", "a b c")]:
        d = line_dedup.edit_distance(a, b)
        assert not line_dedup.replaced(a, b, d - 1) and line_dedup.replaced(a, b, len(a) + len(b) + 1)
        assert line_dedup.replaced(a, a, 0)
    assert not line_dedup.replaced("the end", "end", 3) and line_dedup.replaced("the end", "end", 4) and line_dedup.replaced("x the y", "x abcde y", 5)
    long = [rng.choice(pool) for _ in range(80)]
    moved = " ".join([*long[:10], *long[11:30], long[10], *long[30:60], "new", *long[60:]])
    left, right = zip(*pairs)
    want = [line_dedup.edit_distance(a, b) <= line_dedup.allowed(a, b) for a, b in pairs]
    assert line_dedup.all_similar(list(left), list(right)).tolist() == want
    monkeypatch.setattr(line_dedup, "within", lambda *a: pytest.fail("compared by characters"))
    assert line_dedup.all_similar([" ".join(long)], [moved]).tolist() == [True]


def test_bits_are_counted_in_parts(monkeypatch):
    value = np.random.default_rng(6).integers(0, 1 << 63, 2000, dtype=np.uint64)
    first = np.array([0, 1, 2, 700, 701, 990, 1999])
    count = np.diff(np.r_[first, len(value)])
    whole = line_dedup.bit_counts(value, first, count)
    for size in (1, 100, 255, 1000):
        monkeypatch.setattr(line_dedup, "COUNTED", size)
        assert (line_dedup.bit_counts(value, first, count) == whole).all()
