"""SimHash fingerprints, keys and components against brute force."""

import itertools
import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from cloakwork.llm import simhash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=2):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= distance:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(fps))]


def test_fingerprint_is_the_majority_of_shingle_hashes():
    random.seed(1)
    pieces = ["aÉ", "B", "\x1c", "x\x85y", "　z", "Ĥ\t", "q\n", "w" * 40, "😀"]
    for _ in range(200):
        text = " ".join(random.choice(pieces) for _ in range(random.randint(0, 12)))
        assert simhash.fingerprint(text) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    long = " ".join(f"w{random.randint(0, 99)}" for _ in range(2000))
    assert simhash.fingerprint(long) == simhash.fingerprint(long.upper()) == brute_fingerprint(long)
    assert simhash.fingerprint(long, piece=100) == brute_fingerprint(long)


def test_thresholds_are_the_cheapest_of_the_right_sum():
    rng = random.Random(2)
    for _ in range(100):
        costs = [[0.0, *sorted(rng.uniform(1, 100) for _ in range(3))] for _ in range(4)]
        got = simhash.thresholds(costs, 2)
        best = min((sum(c[e + 1] for c, e in zip(costs, t)), t) for t in itertools.product(range(-1, 3), repeat=4) if sum(t) == 2 - 4 + 1)
        assert sum(got) == -1 and abs(sum(c[e + 1] for c, e in zip(costs, got)) - best[0]) < 1e-9


def test_every_close_pair_shares_a_key():
    rng = np.random.default_rng(3)
    bits = rng.random((500, 64)) < rng.uniform(0.05, 0.95, 64)  # skewed bits
    both = bits.astype(float).T @ bits
    masks = simhash.plan_masks(2, 500, both)
    assert all(64 - m.bit_count() <= simhash.FREE_BITS for m in masks)
    for i, j in itertools.combinations_with_replacement(range(64), 2):
        flip = 1 << i | 1 << j
        assert any(not flip & m for m in masks)


def test_forest_direct_and_by_flips_agree(monkeypatch):
    rng = np.random.default_rng(4)
    base = np.uint64(0x123456789ABCDEF0)
    fps = np.unique(base ^ rng.integers(0, 1 << 12, 600).astype(np.uint64))
    monkeypatch.setattr(simhash, "DIRECT", 10_000)
    a = simhash.forest(fps, (1 << 12) - 1, 2)
    monkeypatch.setattr(simhash, "DIRECT", 1)
    b = simhash.forest(fps, (1 << 12) - 1, 2)
    assert all((x == y).all() for x, y in zip(a, b))


def planted(n=120):
    random.seed(5)
    words = [f"v{i}" for i in range(300)]
    texts = []
    for i in range(n):
        base = [random.choice(words) for _ in range(random.choice((2, 5, 60, 400)))]
        texts.append(" ".join(base))
        if i % 4 == 0:
            base[len(base) // 2] = "changed"
            texts += [" ".join(base), " ".join(base).upper()]
    return texts + ["", None, "  "]


def test_components_match_brute_force(spark):
    texts = planted()
    ids = [1000 - 3 * i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in simhash.report(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    roots = brute_components(fps)
    for i, root in enumerate(roots):
        same = [ids[j] for j, r in enumerate(roots) if r == root]
        assert got[ids[i]].fingerprint == f"{fps[i]:016x}"
        assert got[ids[i]].component_id == min(same)


def test_long_chains_settle(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long").select((F.col("a") * 7919 % 100_003).alias("a"), (F.col("b") * 7919 % 100_003).alias("b"))
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    chain = [i * 7919 % 100_003 for i in range(n + 1)]
    assert all(got.get(x, x) == min(chain) for x in chain)


def test_nulls_repeats_and_empty(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.report(df).collect())
    assert got == [(0, 1), (1, 1), (1, 1), (2, 2), (3, 2)]
    assert simhash.report(df.limit(0)).count() == 0
    kept = simhash.one_of_each(df.withColumn("count", F.lit(1))).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 2]


def test_one_row_of_each_class_whatever_the_ids(spark):
    """Repeated ids over several classes, against a plain loop over classes of rows."""
    rng = random.Random(8)
    texts = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcdefgh"} | {"z": None}
    rows = [(5, "a"), (5, "b"), (3, "b"), (7, "a"), (3, "c"), (5, "c"), (9, "c"), (4, "z"), (4, "z"), (4, "d")]
    rows += [(rng.randint(0, 12), rng.choice("abcdefgh")) for _ in range(60)] + [(None, "e"), (None, "z")]
    df = spark.createDataFrame([(i, texts[c], f"s{n % 3}") for n, (i, c) in enumerate(rows)], "doc_id long, text string, row string")
    smallest = {}
    for i, c in rows:
        if i is not None:
            smallest[c] = min(i, smallest.get(c, i))
    expected = [(i, texts[c]) for c, i in smallest.items()] + [(None, texts["e"]), (None, None)]
    first = sorted(map(tuple, simhash.one_of_each(df).collect()), key=str)
    assert sorted(((r[0], r[1]) for r in first), key=str) == sorted(expected, key=str)
    again = simhash.one_of_each(df.repartition(5, "row")).collect()
    assert sorted(map(tuple, again), key=str) == first
