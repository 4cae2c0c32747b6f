"""Near copies by five-word shingles against brute force."""

import itertools
import random

import corpus_pipeline
from cloakwork.llm import nearcopies, simhash


def brute_shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    return len(a & b) / len(a | b)


def planted():
    """Chains and copies at 0.8 to 0.95, and pairs just below 0.8, which stay."""
    rng, texts = random.Random(6), []
    for k in range(24):
        base = [f"v{rng.randint(0, 5000)}" for _ in range(rng.choice((60, 110, 400)))]
        texts.append(" ".join(base))
        for edits in rng.choices((1, 2, 3, 4, 8, 14), k=3):
            words = list(base)
            for at in rng.sample(range(len(words)), edits):
                words[at] = f"new{rng.randint(0, 10**9)}"
            texts.append(" ".join(words))
    cut = " ".join(f"q{i}" for i in range(104))
    return [*texts, cut, cut.rsplit(" ", 20)[0].upper(), cut.rsplit(" ", 21)[0] + " z", "a b", "A  b", "a c"]


def brute_classes(texts):
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        near = (simhash.fingerprint(texts[i]) ^ simhash.fingerprint(texts[j])).bit_count() <= 2
        if near or jaccard(texts[i], texts[j]) >= 0.8:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
    return root


def test_alike_is_exact_at_the_threshold():
    a = [f"w{i}" for i in range(104)]  # 100 shingles
    near, far = a[:84], a[:83]  # 80 and 79 of them
    sets = [nearcopies.shingles(" ".join(x)) for x in (far, near, a)]
    assert nearcopies.alike([sets[1], sets[2]]).tolist() == [0, 0] and nearcopies.alike([sets[0], sets[2]]).tolist() == [0, 1]
    assert nearcopies.alike(sets).tolist() == [0, 0, 0]  # over the middle one


def test_stage_leaves_one_of_each_class(spark):
    texts = planted()
    pairs = [(a, b) for a, b in itertools.combinations(texts, 2) if 0.8 <= jaccard(a, b) < 0.95]
    assert sum((simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 2 for a, b in pairs) > 10
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == sorted(set(brute_classes(texts)))
    assert stage(spark, docs.limit(0), "").count() == 0


def test_chains_hold_beyond_the_two_ends_of_a_key(spark, monkeypatch):
    """Neighbours of a chain are alike, others aren't: whichever texts a key is measured against, none is lost."""
    monkeypatch.setattr(nearcopies, "PIECE_TEXTS", 2)
    words = [f"c{i}" for i in range(400)]
    texts = [" ".join(words[8 * k : 8 * k + 104]) for k in range(14)] + [" ".join(words[320:])] + ["x y"]
    assert jaccard(texts[0], texts[1]) >= 0.8 > jaccard(texts[0], texts[2]) and jaccard(texts[13], texts[14]) < 0.8
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[3]])], "doc_id long, text string")
    found = nearcopies.links(docs).collect()
    node = {r.node: r.doc_id for r in docs.selectExpr("xxhash64(text) as node", "doc_id").orderBy("doc_id", ascending=False).collect()}
    root = {i: i for i in range(16)}
    for r in found:
        a, b = sorted((root[node[r.a]], root[node[r.b]]))
        root = {i: a if x == b else x for i, x in root.items()}
    assert [root[i] for i in range(16)] == [0] * 14 + [14, 15]
