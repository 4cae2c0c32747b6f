"""Raking and drawing against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import mixing


def test_rake_meets_margins():
    rng = np.random.default_rng(0)
    index = np.array([(a, b, c) for a in range(5) for b in range(3) for c in range(4)])
    tokens = rng.integers(1, 1000, len(index)).astype(float)
    targets = [rng.dirichlet(np.ones(n)) for n in (5, 3, 4)]
    w = mixing.rake(index, tokens, targets)
    for m, t in enumerate(targets):
        assert np.allclose(np.bincount(index[:, m], w * tokens) / tokens.sum(), t, atol=1e-6)


@pytest.mark.parametrize("share", [0.01, 0.3, 0.77, 1.0])
def test_scale_meets_the_budget(share):
    rng = np.random.default_rng(1)
    tokens, w = rng.integers(0, 500, 200).astype(float), rng.exponential(size=200)
    w[::17] = 0
    c = mixing.scale(tokens, w, share * tokens.sum())
    got = (np.where(w > 0, np.minimum(1, c * np.maximum(w, 1e-300)), 0) * tokens).sum()
    assert abs(got - min(share * tokens.sum(), tokens[w > 0].sum())) < 1e-6


def docs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 60))), rng.choice(["en", "en", "en", "de", None]), rng.choice(["a"] * 8 + ["b", "c"])) for i in range(2000)]
    rows = [(i, t, None if l is None else str(l), str(s), "x") for i, t, l, s in rows] + [(5000, None, "en", "a", "x"), (5001, "", "en", None, "x"), (None, "w1 w2", "en", "a", "x"), (7, rows[7][1], "en", "a", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, weight string")


def test_driver_and_table_rake_alike(spark):
    cells = spark.createDataFrame([(s, l, t, int(100 + 37 * i % 900)) for i, (s, l, t) in enumerate((s, l, t) for s in "abc" for l in "xy" for t in "pq")], "source string, lang string, topic string, tokens long")
    a = {tuple(r)[:3]: (r.weight, r.probability) for r in mixing.probabilities(cells, mixing.POWER, 0.4).collect()}
    b = {tuple(r[c] for c in mixing.MARGINS): (r.weight, r.probability) for r in mixing.probabilities(cells, mixing.POWER, 0.4, limit=1).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], rtol=1e-5) for k in a)


def test_draw_meets_targets_and_is_stable(spark):
    df = docs(spark)
    rows = mixing.weighed(df).collect()
    assert len(rows) == df.count()
    total = sum(r.n_tokens for r in rows)
    expected = sum(r.probability * r.n_tokens for r in rows)
    assert abs(expected / total - mixing.BUDGET) < 1e-6
    kept = sum(r.n_tokens for r in rows if r.kept)
    assert abs(kept / total - mixing.BUDGET) < 0.06
    shares = {}
    for r in rows:
        shares[r.source] = shares.get(r.source, 0) + r.weight * r.n_tokens / total
    own = {s: sum(r.n_tokens for r in rows if r.source == s) / total for s in shares}
    wanted = mixing.tempered(own, mixing.POWER["source"])
    assert all(abs(shares[s] - wanted[s]) < 1e-6 for s in shares)
    again = mixing.weighed(df.repartition(7, "text")).collect()
    assert sorted((r.doc_id or -1, r.kept) for r in rows) == sorted((r.doc_id or -1, r.kept) for r in again)


def test_mix_keeps_what_was_weighed(spark):
    df = docs(spark)
    kept = sorted(r.doc_id or -1 for r in mixing.weighed(df).where("kept").collect())
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "topic", "n_tokens", "probability"]
    assert sorted(r.doc_id or -1 for r in mixed.collect()) == kept
    own = df.withColumn("topic", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd"))
    assert {r.topic for r in mixing.weighed(own).collect()} == {"even", "odd"}
    assert mixing.weighed(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0


def skewed(spark):
    """Cells of which several stop at 1 under a budget of 0.5, and topic r has too few tokens for its target."""
    size = {"a": 900, "b": 90, "c": 30, "x": 10, "y": 3, "p": 10, "q": 8, "r": 1}
    rows = [(s, l, t, size[s] * size[l] * size[t] * (3 if (s, l) == ("c", "y") else 1)) for s in "abc" for l in "xy" for t in "pqr"]
    return rows, spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")


@pytest.mark.parametrize("limit", [mixing.DRIVER_CELLS, 1])
def test_the_draw_meets_the_targets_and_not_the_weights_alone(spark, limit):
    rows, cells = skewed(spark)
    power, total = {"source": 0.9, "lang": 0.7, "topic": 0.0}, sum(r[3] for r in rows)
    odds = {tuple(r[c] for c in mixing.MARGINS): r.probability for r in mixing.probabilities(cells, power, 0.5, limit).collect()}
    assert max(odds.values()) <= 1
    for m, c in enumerate(mixing.MARGINS):
        own, drawn = {}, {}
        for r in rows:
            own[r[m]] = own.get(r[m], 0) + r[3] / total
            drawn[r[m]] = drawn.get(r[m], 0) + odds[r[:3]] * r[3] / (0.5 * total)
        wanted = mixing.tempered(own, power[c])
        if c == "topic":  # 1/19 of all is less than a third of one half: kept whole, the others share the rest
            wanted = {"r": own["r"] * 2, "p": 0.5 - own["r"], "q": 0.5 - own["r"]}
        assert all(abs(drawn[k] - wanted[k]) < 1e-5 for k in wanted), (c, drawn, wanted)


@pytest.mark.parametrize("limit", [mixing.DRIVER_CELLS, 1])
def test_given_targets(spark, limit):
    """A category without a target shares 0; a target for a category that isn't there has no effect."""
    rows, cells = skewed(spark)
    targets = {"source": {"a": 4.0, "b": 1.0, "elsewhere": 5.0}}
    power, budget = {"source": 0.5, "lang": 1.0, "topic": 1.0}, 0.05
    odds = {tuple(r[c] for c in mixing.MARGINS): r.probability for r in mixing.probabilities(cells, power, budget, limit, targets).collect()}
    drawn = {}
    for r in rows:
        drawn[r[0]] = drawn.get(r[0], 0) + odds[r[:3]] * r[3] / (budget * sum(r[3] for r in rows))
    assert abs(drawn["a"] - 0.8) < 1e-4 and abs(drawn["b"] - 0.2) < 1e-4 and drawn["c"] == 0


def themed():
    rng = np.random.default_rng(6)
    vocabulary = [[f"{theme}{i}" for i in range(60)] for theme in ("sea", "law", "code")]
    rows = []
    for i in range(300):
        words = [str(rng.choice(vocabulary[i % 3])) for _ in range(30)] + [f"the{rng.integers(0, 5)}" for _ in range(20)]
        rows.append((i, " ".join(words), ["en", "de"][i % 2], "abc"[i % 7 % 3]))
    return rows + [(900, None, "en", "a"), (901, "  ", None, "a"), (None, rows[0][1], "en", None), (7, rows[7][1], "de", "b")]


def test_topics_are_themes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TOPICS", 3)
    rows = themed()
    topics = mixing.Topics([t for _, t, _, _ in rows if t and t.strip()], 3)
    places = mixing._Places()
    found = [topics.topic(mixing._uses(places, t)) for _, t, _, _ in rows]
    assert len(set(found[:300])) == 3 and all(len({found[i] for i in range(k, 300, 3)}) == 1 for k in range(3))
    assert found[300:302] == [None, None]
    assert mixing.Topics([]).topic(np.ones(mixing.WORDS)) == "topic0"


def test_every_row_by_plain_computation(spark):
    """Topics by the whole table of cosines, weights and probabilities by loops over dictionaries, the draw by hash."""
    import xxhash

    rows = themed()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixing.weighed(df).collect()
    topics = mixing.learnt(df)

    def uses(text):
        out = np.zeros(mixing.WORDS)
        for w in (text or "").lower().split():
            out[xxhash.xxh64_intdigest(w, 3) % mixing.WORDS] += 1
        return out

    def topic(text):
        x = np.log(1 + uses(text)) * topics.idf
        cosines = [float(c @ x) for c in topics.centres]
        return f"topic{cosines.index(max(cosines))}" if uses(text).any() else ""

    cell = [(s or "", l or "", topic(t)) for _, t, l, s in rows]
    tokens = [len((t or "").split()) for _, t, _, _ in rows]
    total, sums = sum(tokens), {}
    for c, n in zip(cell, tokens):
        sums[c] = sums.get(c, 0) + n
    targets = []
    for m, name in enumerate(mixing.MARGINS):
        held = {}
        for c, n in sums.items():
            held[c[m]] = held.get(c[m], 0) + n / total
        raised = {k: v ** mixing.POWER[name] if v else 0 for k, v in held.items()}
        targets.append({k: v / sum(raised.values()) for k, v in raised.items()})
    weight = dict.fromkeys(sums, 1.0)
    for _ in range(mixing.ROUNDS):
        for m, target in enumerate(targets):
            now = {}
            for c, n in sums.items():
                now[c[m]] = now.get(c[m], 0) + weight[c] * n
            weight = {c: min(max(w * (target[c[m]] * total / now[c[m]] if now[c[m]] else 1), 1e-9), 1e9) for c, w in weight.items()}
    by_id = sorted(((r.doc_id is None, r.doc_id or 0), r) for r in got)
    own = sorted(((i is None, i or 0), k) for k, (i, _, _, _) in enumerate(rows))
    expected = [{} for _ in targets]
    for (_, r), (_, k) in zip(by_id, own):
        assert (r.source, r.lang, r.topic, r.n_tokens) == (*cell[k], tokens[k])
        assert r.weight == pytest.approx(weight[cell[k]], rel=1e-5)
        key = str(rows[k][0]) if rows[k][0] is not None else "text " + rows[k][1]
        draw = xxhash.xxh64_intdigest((17).to_bytes(4, "little"), xxhash.xxh64_intdigest(key, 42)) >> 11
        assert r.kept == (draw / 2.0**53 < r.probability) and 0 <= r.probability <= 1
        for m, c in enumerate(cell[k]):
            expected[m][c] = expected[m].get(c, 0) + r.probability * r.n_tokens
    assert sum(expected[0].values()) == pytest.approx(mixing.BUDGET * total, rel=1e-6)
    for m, target in enumerate(targets):  # a category that is short of tokens is kept whole, the others share the rest
        held, names = {}, sorted(target)
        for c, n in sums.items():
            held[c[m]] = held.get(c[m], 0) + n
        goal, full = {}, set()
        while True:
            left = mixing.BUDGET * total - sum(held[c] for c in full)
            goal = {c: held[c] if c in full else left * target[c] / sum(target[x] for x in names if x not in full) for c in names}
            if short := {c for c in names if goal[c] > held[c]}:
                full |= short
            else:
                break
        assert all(expected[m].get(c, 0) == pytest.approx(goal[c], rel=1e-3, abs=1e-3) for c in names), (m, goal, expected[m])


@pytest.mark.parametrize("held", [mixing.DRIVER_PLACES, 0])
def test_topics_are_learnt_from_all_texts(spark, monkeypatch, held):
    """More texts than any sample had, and a theme that only long texts have; driver and table learn the same."""
    monkeypatch.setattr(mixing, "DRIVER_PLACES", held)
    rng = np.random.default_rng(8)
    texts = [" ".join(f"{theme}{x}" for x in rng.integers(0, 50, 12)) for theme in ("sea", "law") for _ in range(1100)]
    texts += [" ".join(f"code{x}" for x in rng.integers(0, 50, 3000)) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts + [None, ""])], "doc_id long, text string, lang string, source string")
    topics = mixing.learnt(df.repartition(3))
    places, have = mixing._Places(), np.zeros(mixing.WORDS)
    for t in texts:
        have += mixing._uses(places, t) > 0
    assert np.allclose(topics.idf, np.log((1 + len(texts)) / (1 + have)))
    again = mixing.Topics(texts)
    assert (topics.idf == again.idf).all() and (topics.centres == again.centres).all()
    long = {topics.topic(mixing._uses(places, t)) for t in texts[2200:]}
    assert len(long) == 1 and np.mean([topics.topic(mixing._uses(places, t)) in long for t in texts[:2200]]) < 0.05


def test_words_hashed_together_have_the_places_of_words_hashed_alone(monkeypatch):
    """Every length of word, all white space of str.split(), letters whose small form depends on what follows; texts over several turns."""
    import sys

    spaces = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]
    texts = [None, "", " ", "".join(f"a{c}B" for c in spaces), "ΟΔΟΣ ΣΑΣ", "Σ", "İstanbul ẞ \U0001f600", "a\x00b \x00", "end ", *("X" * n + " " + "é" * n + " y\n" + "日" * n for n in range(40))]
    places = mixing._Places()
    alone = [(int((uses := mixing._uses(places, t)).sum()), *mixing._histogram(uses)) for t in texts]
    assert [*mixing._histograms(texts)] == alone and [*mixing._histograms([])] == []
    monkeypatch.setattr(mixing, "_BYTES", 30)
    monkeypatch.setattr(mixing, "_AT_ONCE", 3)
    assert [*mixing._histograms(texts)] == alone


@pytest.mark.parametrize("picked, looks", [(mixing._PICKED, 0), (0, 5)])
def test_the_start_takes_one_pass_and_more_only_where_it_proves_nothing(monkeypatch, picked, looks):
    """The texts picked by chance hold the start; with none picked each centre takes a pass, with the same centres."""
    monkeypatch.setattr(mixing, "_PICKED", picked)
    passes = []

    class Counted(mixing._Held):
        def first(self, work):
            passes.append("first")
            return super().first(work)

        def where(self, work):
            passes.append("where")
            return super().where(work)

    rng = np.random.default_rng(9)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 500, 30)) for _ in range(1000)]
    rows = [(i * 0x9E3779B97F4A7C15 % (1 << 63), *h[1:]) for i, h in enumerate(mixing._histograms(texts))]
    packs = [*mixing._packs(*zip(*rows))]
    assert len(packs) < len(rows) / 20
    topics = mixing.Topics.__new__(mixing.Topics)
    topics._fit(Counted(packs), len(rows), 5)
    assert (passes.count("where"), passes.count("first")) == (1, looks)
    plain = mixing.Topics.__new__(mixing.Topics)
    monkeypatch.setattr(mixing, "_PICKED", len(rows) * 100)
    plain._fit(mixing._Held(packs), len(rows), 5)
    assert (topics.centres == plain.centres).all() and len(topics.centres) == 5


def test_packs_hold_every_number_of_uses():
    rows = [(0, b"", b""), *((n, *mixing._histogram(np.concatenate([[0, n, 1], np.arange(n % 300)]))) for n in [*range(1, 600), 70_000, 10**9])]
    got = [mixing._row(piece, i) for piece in mixing._pieces([*mixing._packs(*zip(*rows))]) for i in range(len(piece.h))]
    assert got == rows[1:]


def test_one_pass_reads_and_packs(spark, monkeypatch):
    """Histograms and packs are written by one step, which is gone afterwards; every text is in one pack, as in its own row."""
    written = []

    class Counted(mixing.Steps):
        def __call__(self, df):
            written.append(super().__call__(df))
            return written[-1]

    monkeypatch.setattr(mixing, "Steps", Counted)
    monkeypatch.setattr(mixing, "DRIVER_PLACES", 0)
    texts = [None, "", " ", *(" ".join(f"w{x}" for x in range(i % 40)) + " often" * (i % 600) for i in range(900))]
    df = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(3)
    held = mixing.histograms(df).collect()
    packs = [tuple(r.pack) for r in held if r.pack]
    alone = sorted(mixing._row(p, i)[1:] for r in held if r.places for p in mixing._pieces([(bytes(8), *map(bytes, (r.sizes, r.places, r.codes, r.more)))]) for i in range(len(p.h)))
    assert alone == sorted(mixing._row(p, i)[1:] for p in mixing._pieces(packs) for i in range(len(p.h)))
    assert alone == sorted(tuple(h[1:]) for h in mixing._histograms(texts) if h[1])
    assert {r.doc_id: r.n_tokens for r in held} == {i: len((t or "").split()) for i, t in enumerate(texts)}
    assert len(packs) < len(alone) / 10
    topics, rows = mixing._learnt_and_measured(df)
    assert len(written) == 1
    places = mixing._Places()
    assert {r.doc_id: r.topic for r in rows.collect()} == {i: topics.topic(mixing._uses(places, t)) if (t or "").strip() else None for i, t in enumerate(texts)}
