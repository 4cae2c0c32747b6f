"""Benchmark decontamination against brute force, by both ways."""

import hashlib
import random
import re

import pytest

from cloakwork.llm import decontaminate


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        if w:
            n = min(window, len(w))
            for i in range(len(w) - n + 1):
                grams.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                g = tuple(w[i : i + n])
                if g in grams:
                    hit |= set(range(i, i + n))
                    found |= grams[g]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus():
    random.seed(3)
    vocabulary = ["alpha", "Beta", "ÉTÉ", "42", "x", "ß", "日本", "it's", "re-do"]
    say = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, say(random.randint(10, 30))) for i in range(12)] + [(50, "short item here"), (51, "one"), (52, ""), (53, None), (54, "!!!"), (9, say(12)), (2, say(15))]
    items.append((60, items[0][1].upper()))
    docs = [(i, say(random.randint(0, 80))) for i in range(30)]
    for i in range(30):
        _, passage = random.choice(items[:12])
        docs.append((100 + i, f"{say(20)}. {passage.replace(' ', ' , ')} {say(5)} {passage if i % 3 == 0 else ''}"))
    docs += [(200, None), (201, ""), (202, "..."), (203, "SHORT, item; HERE"), (204, "one"), (100, docs[30][1]), (None, items[1][1])]
    return docs, items


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 50])
def test_report_matches_brute_force(spark, block):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.report(d, b, block=block).collect()), key=str)
    assert got == brute(docs, items)


@pytest.mark.parametrize("window", [1, 3, 7, 8])
def test_other_windows(spark, window):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in decontaminate.report(d, b, window).collect()), key=str)
    assert got == brute(docs, items, window)


def test_clean_and_spans(spark):
    docs = [(1, "a b c d e f g h i j k", "u", "clash"), (2, "nothing of that", "v", None), (3, None, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, w string, spans string")
    b = spark.createDataFrame([(7, "b c d e f g h i j k")], "item_id long, text string")
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    cut = {r.doc_id: r.text for r in decontaminate.without_spans(d, b).collect()}
    assert cut == {1: "a", 2: "nothing of that", 3: None}
    none = b.limit(0)
    assert decontaminate.clean(d, none).count() == 3 and decontaminate.report(d.limit(0), b).count() == 0


def test_a_million_windows_are_broadcast_and_nothing_else_is_shuffled(spark):
    words = [f"w{i * 7919 % 1_000_003}" for i in range(1_000_009)]
    items = [(1, " ".join(words[:500_000])), (2, " ".join(words[499_991:])), (3, "short one")]
    docs = [(i, " ".join(["x", *words[99_000 * i : 99_000 * i + 12], "y"])) for i in range(10)] + [(20, "a Short, one"), (21, " ".join(words[5:14])), (22, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.report(d, b).collect()}
    assert got == {i: (12, 1) for i in range(10)} | {20: (2, 1), 21: (0, 0), 22: (0, 0)}
    plan = decontaminate._met(d, spark.range(10).withColumnRenamed("id", "_h"), [10], 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan
