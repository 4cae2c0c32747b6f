"""Toxicity and quality: gradients, held-out accuracy, odd inputs."""

import random
import zlib

import numpy as np
import pytest

from cloakwork.llm import learning, quality, toxicity

WORDS = "the of and thor ing tion ente wher onsh ereat nder hation ply stern".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", ",", ".")) for _ in range(n))


def toxic_set(n=800):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        y = i // 4 % 2
        words = prose(rng, rng.choice((5, 30, 90, 300))).split(" ")
        if y:
            words.insert(rng.randrange(len(words)), rng.choice(("idiot", "scum", "grawl" + rng.choice("aeiou") + rng.choice("xyz"))))
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.start().items()}
    buckets, chars = toxicity.encode(["idiot", "the", "of", "ärger"])
    buckets, chars = np.r_[0, buckets], np.r_[np.zeros((1, toxicity.PIECE + 2), int), chars]
    ids, lengths, y = np.array([[1, 2, 3, 0], [4, 2, 1, 3]]), np.array([3, 4]), np.array([1.0, 0.0])
    _, g = toxicity.gradients(p, buckets, chars, ids, lengths, y)
    for k in ("wf", "ub", "att", "att_v", "out", "out_b", "bf", "conv"):
        at = tuple(rng.integers(s) for s in p[k].shape)
        held = p[k][at]
        loss = []
        for d in (1e-4, -1e-4):
            p[k][at] = held + d
            loss.append(toxicity.gradients(p, buckets, chars, ids, lengths, y)[0])
        p[k][at] = held
        assert abs((loss[0] - loss[1]) / 2e-4 - g[k][at]) < 1e-4, k


def test_windows_cover_all_words():
    for n in (0, 1, 64, 65, 112, 113, 500):
        seen = {at + i for at, size in toxicity.windows(n) for i in range(size)}
        assert seen == set(range(n)) and all(size <= toxicity.WINDOW for _, size in toxicity.windows(n))


def test_toxicity_learns_words_and_stems():
    rows = toxic_set()
    model = toxicity.train([t for i, t, _ in rows if i % 4 != 2], np.array([y for i, _, y in rows if i % 4 != 2], np.float32), rounds=4)
    held = [(t, y) for i, t, y in rows if i % 4 == 2] + [("the grawlooz of", 1)] + [(prose(random.Random(7), 3000), 0)]
    held += [(prose(random.Random(8), 1500) + " idiot " + prose(random.Random(9), 1500), 1)]
    s = learning.sigmoid(model["a"] * toxicity.Scorer(model).highest([t for t, _ in held]) + model["b"])
    right = np.mean([(x >= 0.3) == y for x, (_, y) in zip(s, held)])
    assert right > 0.95


def test_toxicity_frame(spark):
    rows = toxic_set(160)
    docs = spark.createDataFrame([(i, t, 9.0) for i, t, _ in rows] + [(900, None, 1.0), (901, "", 1.0), (None, "x", 1.0), (1, rows[1][1], 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(901, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.report(docs, labels).collect()
    assert len(got) == 164 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert {r.score for r in toxicity.report(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.report(docs.limit(0), labels).count() == 0


def junk(rng, n):
    words = prose(rng, n).split(" ")
    return rng.choice((" ".join(w + rng.choice(("%%%", "$$$", "&&&")) for w in words), " ".join(w.upper() + "!!" for w in words), " ".join([words[0]] * n), " | ".join(words)))


def quality_set(n=300):
    rng = random.Random(2)
    return [(i, prose(rng, 150) if i % 2 else junk(rng, rng.choice((60, 150))), i % 2) for i in range(n)]


def test_quality_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in quality.start().items()}
    x, bag, y = rng.normal(size=(7, quality.FEATURES + 2)), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0.0, 1.0])
    _, g = quality.gradients(p, x, bag, y)
    for k in p:
        at = tuple(rng.integers(s) for s in p[k].shape)
        held, loss = p[k][at], []
        for d in (1e-4, -1e-4):
            p[k][at] = held + d
            loss.append(quality.gradients(p, x, bag, y)[0])
        p[k][at] = held
        assert abs((loss[0] - loss[1]) / 2e-4 - g[k][at]) < 1e-5, k


def test_quality_frame(spark):
    rows = quality_set()
    docs = spark.createDataFrame([(i, t, 3) for i, t, _ in rows] + [(900, None, 1), (901, "", 1), (None, "x " * 9, 1), (902, "y" * 100_000, 1)], "doc_id long, text string, n_chars int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.report(docs, labels).collect()}
    truth = {i: y for i, _, y in rows}
    held = [r for r in got.values() if r.held_out and r.doc_id in truth]
    assert len(held) > 30 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    kept = quality.keep(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.predicted}
    assert {r.score for r in quality.report(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.report(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_platt_orders_and_calibrates(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=2000)
    y = (rng.random(2000) < learning.sigmoid(2 * x - 1)).astype(float)
    a, b = learning.platt(x, y)
    assert abs(a - 2) < 0.5 and abs(b + 1) < 0.4


@pytest.mark.parametrize("held", [quality.DRIVER_BYTES, 0])
def test_quality_is_learnt_from_all_labelled_texts(spark, monkeypatch, held):
    """More labelled texts than any sample had, the bad ones all long: no row is left out, on the driver or not."""
    monkeypatch.setattr(quality, "DRIVER_BYTES", held)
    rng = random.Random(5)
    rows = [(i, prose(rng, 8), 1) for i in range(4600)]
    rows += [(i, (" | ".join(prose(rng, 50).split(" ")) + " ") * 180, 0) for i in range(5000, 5060)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda bags: seen.append(bags.total(lambda x, bag, y: np.array([len(y), y.sum(), len(x)], float), 3)) or train(bags))
    got = {r.doc_id: r.predicted for r in quality.report(docs, labels).collect()}
    own = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(own) > 3000 and min(len(t) for t, y in own if not y) > 60_000
    assert seen[0].tolist() == [len(own), sum(y for _, y in own), sum(-(-len(t.split()) // quality.PASSAGE) for t, _ in own)]
    assert np.mean([got[i] == y for i, _, y in rows]) > 0.99
