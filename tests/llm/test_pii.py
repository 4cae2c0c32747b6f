"""Personal data: base spans against brute force, patterns, redaction."""

import hashlib
import re

from pyspark.sql import functions as F

from cloakwork.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def brute(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


TEXTS = [
    "a@b.c_d@e.f x@y.z@q.w a.b@c %@d.e f@g.h mail: Ü@x.de",
    "1.2.3.4.5.6.7.8 999.1.1.1 00000000000000000000255.1.1.1 1.2.3 256.0.0.1 0.0.0.0",
    "4111 1111-1111 1111 and 4111-1111-1111-1112 and 4111111111111111 end 4111  111111111111",
    "+1 (582) 555-5777 +49 (0) 30 1234567 +1 23 ++4 123 456 789. +1 4111111111111111",
    "é😀 a@b.co 😀 +49 30 1234567 😀4111111111111111",
    "", None, "no data", "1" * 3000, "1." * 2000, "a@" * 500 + "b.c", "@.@", "x" * 5000 + "@y.z",
]


def test_base_spans_match_brute_force(spark):
    df = spark.createDataFrame([(i, t, "e") for i, t in enumerate(TEXTS)], "doc_id long, text string, spans string")
    for r in pii.report(df).collect():
        spans = brute(TEXTS[r.doc_id] or "")
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(filter(None, listed.split(","))) <= set(filter(None, r.spans.split(",")))


def keys(n):
    return [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]


def learnable():
    rows = [(i, f'set token = "{k[:40]}" now') for i, k in enumerate(keys(20))]
    rows += [(100 + i, f"login password={k[:16]} ok") for i, k in enumerate(keys(10))]
    rows += [(200, "room of 2024abcd and the x99999 of y12345"), (201, "nothing here")]
    return rows


def test_patterns_of_seeds_find_unseen_tokens(spark):
    df = spark.createDataFrame(learnable(), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.report(df).collect()}
    assert got[0] == "secret:13:53"
    assert all(got[100 + i] == "secret:15:31" for i in range(10))
    assert got[200] == got[201] == ""


def test_patterns_by_join_are_the_same(spark):
    df = spark.createDataFrame(learnable(), "doc_id long, text string")
    scanned = pii.scan(df)
    confident = pii.patterns_of(scanned)
    a, b = (sorted((r.doc_id, str(r._spans)) for r in pii.with_spans(scanned, confident, inline).collect()) for inline in (10_000, 0))
    assert a == b


def test_redaction_keeps_all_else(spark):
    rows = [(1, "mail a@b.co now", "x", 15), (2, None, None, None), (3, "clean", "y", 5), (1, "é😀 4111111111111111.", "_t", 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _t string, n_chars long")
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted([(1, "mail [EMAIL] now", "x", 16), (2, None, None, None), (3, "clean", "y", 5), (1, "é😀 [CARD].", "_t", 10)], key=str)
    assert pii.redact(df.limit(0)).count() == 0 and pii.report(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string").withColumn("text", F.col("text"))
    plan = pii.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
