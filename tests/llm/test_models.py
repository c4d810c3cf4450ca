"""Language model, language and quality classifiers: probabilities that sum to 1, exact counts, held-out accuracy."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyframe.llm import langid, lm, quality_net
from tallyframe.llm.common import crc_mod

ALPHABETS = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}


def text_of(rng, lang, n):
    return " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randrange(1, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    return [(i, text_of(rng, lang := rng.choice(list(ALPHABETS)), rng.randrange(3, 60)), lang) for i in range(400)]


def test_language_held_out(spark, corpus):
    rows = [(i, t, None if i % 9 == 0 else lang, "x") for i, t, lang in corpus] + [(900, None, "aa", "x"), (901, "123 !?", "aa", "x"), (902, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score string")
    model = langid.train(df.filter("doc_id % 4 <> 2"), "doc_id", "text", "lang")
    got = {r.doc_id: r for r in langid.score_documents(df, model).collect()}
    held = [(i, lang) for i, _, lang in corpus if i % 4 == 2]
    assert np.mean([got[i].lang_pred == lang for i, lang in held]) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert 0.3 < (model.weights != 0).mean(1).max() <= 1 and (model.weights == 0).mean() > 0.5
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and kept.filter("doc_id >= 900").count() == 0 and kept.count() > 380


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id bigint, text string, lang string")
    model = langid.train(df, "doc_id", "text", "lang")
    assert langid.score_documents(df, model).first().lang_pred == "und"
    assert langid.score_documents(df.limit(0), model).count() == 0


def test_ngrams_of_long_texts_do_not_depend_on_pieces(monkeypatch):
    t = "the quick brown fox " * 300
    whole = langid.ngram_counts(t)
    monkeypatch.setattr(langid, "PIECE", 64)
    parts = langid.ngram_counts(t)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_quality_held_out(spark, corpus):
    rng = random.Random(8)
    rows = [(i, t if (good := rng.random() < 0.6) else " ".join(w + rng.choice(["###", "$$$"]) for w in t.split()), int(good)) for i, t, _ in corpus]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(900, None, 1), (901, "", 1)], "doc_id bigint, text string, quality int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, None)], "doc_id bigint, quality int")
    net = quality_net.train(docs, labels.filter("doc_id % 4 <> 2"))
    got = {r.doc_id: r.score for r in quality_net.score_documents(docs, net).collect()}
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, _, y in rows if i % 4 == 2]) > 0.95
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    assert quality_net.keep_good(docs, net).columns == docs.columns


def test_quality_covers_the_whole_text(monkeypatch):
    net = quality_net.fit([("plain text here " * 4, 1), ("bad ### bad ### ", 0)] * 20, epochs=2)
    texts = ["x" * n + tail for n in (0, 15, 16, 17, 500) for tail in ("", "###")] + ["y " * 4000]
    whole = net.scores(texts)
    monkeypatch.setattr(quality_net, "STEP", 8)
    assert np.allclose(net.scores(texts), whole, atol=1e-5)
    assert np.allclose([net.scores([t])[0] for t in texts], whole, atol=1e-5)


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")
    net = quality_net.train(docs, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert quality_net.score_documents(docs, net).first().score == 0.5


def test_language_model(spark, corpus, monkeypatch):
    rows = [(i, t, 1) for i, t, _ in corpus] + [(800, None, 1), (801, "", 1), (802, "unseen WORDS unseen", 1), (803, text_of(random.Random(1), "aa", 500), 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    monkeypatch.setattr(lm, "MIN_COUNT", 4)
    monkeypatch.setattr(lm, "LISTED", 300)
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    monkeypatch.setattr(lm, "BATCH", 128)
    both = [{r.doc_id: r for r in lm.assess(df.repartition(k), crc_mod("doc_id", 7) != 2).collect()} for k in (1, 7)]
    got = both[0]
    assert all(math.isclose(got[i].score, both[1][i].score, rel_tol=1e-5) for i in got)  # whatever the partitions
    tokens = {i: [w.lower() for w in (t or "").split()] + [" "] for i, t, _ in rows}
    counts = Counter(w for i, ws in tokens.items() if not held(i) for w in ws)
    n, v = counts.total(), len(counts)
    for i, ws in tokens.items():
        assert got[i].train_tokens == n and got[i].n_tokens == len(ws)
        assert got[i].n_known == sum(counts[w] > 0 for w in ws)
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert got[i].score < 0
    own = [i for i in tokens if held(i) and i < 800]
    assert sum(got[i].score for i in own) > sum(got[i].base_score for i in own)


def small_model():
    counts = np.sort(np.random.default_rng(2).integers(5, 900, 60))[::-1]
    of_words = lm.classes_for(counts)
    n = 2 + of_words.max()
    class_of = np.concatenate([[0], of_words, np.arange(n)])
    return lm.LogBilinear(class_of, np.concatenate([[40], counts, np.full(n, 7)]))


def test_probabilities_sum_to_one():
    model = small_model()
    rng, size = np.random.default_rng(1), len(model.class_of)
    lm.train_stream(model, (rng.integers(0, size, 50) for _ in range(40)), 1)
    contexts = np.repeat(rng.integers(0, size, (lm.CONTEXT, 1)), size, 1)
    logs = model.log_probabilities(contexts, np.arange(size))
    assert abs(np.exp(logs).sum() - 1) < 1e-4
    # plainly, one outcome at a time
    h = np.r_[sum(model.seen[contexts[k, 0]] * model.mix[k] for k in range(lm.CONTEXT)), 1]
    for o in range(size):
        c = model.class_of[o]
        by_class = np.exp(model.classes @ h)
        own = np.flatnonzero(model.class_of == c)
        by_word = np.exp(model.words[own] @ h)
        want = by_class[c] / by_class.sum() * by_word[own.tolist().index(o)] / by_word.sum()
        assert math.isclose(logs[o], math.log(want), rel_tol=1e-4)


def test_estimation_learns_a_pattern():
    model = small_model()
    lm.train_stream(model, (np.tile([3, 9, 30], 30) for _ in range(400)), 1)
    contexts, targets = lm.windows([np.tile([3, 9, 30], 5)])
    assert np.exp(model.log_probabilities(contexts, targets)[6:14]).min() > 0.5


def test_windows_follow_documents():
    docs = [np.array([5, 6, 7]), np.array([], np.int64), np.array([9])]
    contexts, targets = lm.windows(docs)
    assert targets.tolist() == [5, 6, 7, 0, 0, 9, 0]
    assert contexts[0].tolist() == [0, 5, 6, 7, 0, 0, 9]
    assert contexts[1].tolist() == [0, 0, 5, 6, 0, 0, 0]


def test_language_model_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert lm.assess(df, F.lit(True)).count() == 0


def test_scores_of_a_rare_large_bias_need_no_maximum(monkeypatch):
    """Large biases alone do not send every batch through the search for its maximum; the logarithms stay normalised."""
    rng = np.random.default_rng(3)
    class_of = np.r_[0, np.sort(rng.integers(1, 5, 60)), np.arange(5)]
    frequency = np.r_[50_000_000, rng.integers(1, 100, 60), np.ones(5, np.int64)]
    model = lm.LogBilinear(class_of, frequency)
    for table in (model.classes, model.words):
        table[:, :-1] *= 10
    contexts = rng.integers(0, len(class_of), (lm.CONTEXT, 200))
    seen, share = [], lm._log_share
    monkeypatch.setattr(lm, "_log_share", lambda scores, at, safe: seen.append(safe) or share(scores, at, safe))
    model.seen *= 20
    total = sum(np.exp(model.log_probabilities(contexts, np.full(200, w)).astype(np.float64)) for w in range(len(class_of)))
    assert np.allclose(total, 1, atol=1e-4) and all(seen)
    model.words[3, :-1] = 1e4
    assert np.isfinite(model.log_probabilities(contexts, np.full(200, 2))).all() and not all(seen)


def test_stretches_hold_every_window_once(monkeypatch):
    """Training deals stretches of neighbours, scoring reads the stream in pieces; both see the windows of every document."""
    rng = np.random.default_rng(4)
    docs = [rng.integers(1, 60, n).astype(np.uint16) for n in (0, 1, 2, 300, 0, 0, 63, 64, 5, 0)]
    contexts, targets = lm.windows(docs)
    model = small_model()
    want = model.log_probabilities(contexts, targets)
    for step in (7, 64, 1 << 16):
        assert np.allclose(model.log_probabilities_of(docs, step), want, atol=1e-5)
    met, whole = [], model.update

    def update(stretches, goal, *rest):
        assert len(goal) * goal.shape[1] <= 128 and goal.any(1).all()
        for row, here in zip(stretches, goal):
            met.extend(tuple(row[k : k + lm.CONTEXT + 1].tolist()) for k in np.flatnonzero(here))
        whole(stretches, goal, *rest)

    monkeypatch.setattr(lm, "BATCH", 128)
    monkeypatch.setattr(model, "update", update)
    assert lm.train_stream(model, iter(docs), 1) == len(targets)
    assert Counter(met) == Counter(zip(*(c.tolist() for c in contexts[::-1]), targets.tolist()))
    assert all(np.isfinite(p).all() for p in model.parameters())


def test_gradients_reach_all_vectors():
    """A step of the batch form equals one that goes from target to target."""
    docs = [np.array([3, 9, 30, 3], np.uint16), np.array([9], np.uint16)]
    stream, goal = lm.laid(docs)
    stretches, goal = stream[None, : len(stream) - lm.CONTEXT + 1], goal[None, lm.CONTEXT : len(stream) - lm.CONTEXT + 1]
    model, plain = small_model(), small_model()
    model.update(stretches, goal, np.random.default_rng(1), 0.1)
    rng, (contexts, targets) = np.random.default_rng(1), lm.windows(docs)
    grads = [np.zeros(p.shape) for p in plain.parameters()]
    draws = [np.minimum(np.searchsorted(plain.drawn[k], rng.random(lm.NOISE)), len(v) - 1) for k, v in ((0, plain.classes), (1, plain.words))]
    for t, context in zip(targets, contexts.T):
        h = np.r_[sum(plain.seen[o] * plain.mix[k] for k, o in enumerate(context)), 1]
        gh = np.zeros(lm.WIDTH)
        for k, (own, v) in enumerate(((plain.class_of[t], plain.classes), (t, plain.words))):
            for o, label in [(own, 1), *((x, 0) for x in draws[k])]:
                g = 1 / (1 + math.exp(-(h @ v[o] - plain.logs[k][o]))) - label
                grads[1 + k][o] += g * h
                gh += g * v[o, :-1]
        for k, o in enumerate(context):
            grads[0][o] += gh * plain.mix[k]
            grads[3][k] += gh * plain.seen[o]
    for p, q, g in zip(model.parameters(), plain.parameters(), grads):
        g /= len(targets)
        assert np.allclose(p, q - 0.1 * g / (np.abs(g) + 1e-7), atol=2e-3)
    for sq, g in zip(model.squares, grads):
        assert np.allclose(np.sqrt(sq), np.abs(g), rtol=1e-3, atol=1e-6)
