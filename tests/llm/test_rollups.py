"""Delta-maintained token counts."""

import re

from cloakwork.llm import rollups
from cloakwork.llm.rollups import Rollup, changes


def count(rows):
    out = {}
    for sign, _, source, lang, text in rows:
        t = text or ""
        found = {"words-1": re.findall(r"[^\x20\x09-\x0D]+", t), "pieces-2": re.findall(r"[A-Za-z\x80-\U0010FFFF]+|[0-9]{1,3}|[^A-Za-z0-9\x80-\U0010FFFF\x20\x09-\x0D]", t)}
        for version, tokens in found.items():
            old = out.setdefault((source, lang, version), [0, 0, 0])
            for i, v in enumerate((1, len(tokens), len(t))):
                old[i] += sign * v
    return {(*k, *v) for k, v in out.items() if any(v)}


DOCS = [(1, "a", "en", "It's 12345 words, é!"), (2, "a", "en", ""), (3, "b", None, None), (4, None, "de", "über 1 Ding"), (4, None, "de", "über 1 Ding")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")


def totals(r):
    return {tuple(x) for x in r.totals().collect()}


def test_batches_count_once(spark, tmp_path):
    r = Rollup(spark, str(tmp_path))
    assert totals(r) == set() and r.batches() == []
    assert r.commit("b1", changes(frame(spark, DOCS), 1))
    assert not r.commit("b1", changes(frame(spark, DOCS), 1))
    assert totals(r) == count([(1, *d) for d in DOCS])
    gone, new = [DOCS[0]], [(1, "a", "en", "now shorter")]
    assert r.commit("b2", changes(frame(spark, gone), -1).unionByName(changes(frame(spark, new), 1)))
    assert r.commit("b3", changes(frame(spark, DOCS[3:]), -1))
    signed = [(1, *d) for d in DOCS] + [(-1, *gone[0]), (1, *new[0])] + [(-1, *d) for d in DOCS[3:]]
    assert totals(r) == count(signed)
    r.compact()
    assert totals(r) == count(signed) and r.batches() == ["b1", "b2", "b3"]
    assert not r.commit("b2", changes(frame(spark, gone), -1))
    assert r.commit("b4", changes(frame(spark, DOCS[:1]), 1)) and totals(r) == count([*signed, (1, *DOCS[0])])
    assert r.commit("empty", changes(frame(spark, DOCS).limit(0), 1))


def test_a_broken_batch_is_written_anew(spark, tmp_path):
    r = Rollup(spark, str(tmp_path))
    r.commit("b1", changes(frame(spark, DOCS), 1))
    (tmp_path / "batches" / "b1" / "_SUCCESS").unlink()
    assert totals(r) == set()
    assert r.commit("b1", changes(frame(spark, DOCS), 1)) and totals(r) == count([(1, *d) for d in DOCS])


def test_public_vocabulary(spark):
    import pytest

    vocabularies = pytest.importorskip("public_tokenizers")
    rows = rollups.bpe_counts(frame(spark, DOCS), vocabularies.path("byte_bpe_50k.tiktoken"), "bpe").collect()
    assert len(rows) == len(DOCS) and sum(r.n_tokens for r in rows) > 10 and {r.n_tokens for r in rows if not r.n_chars} == {0}


def test_report_leaves_out_toxic_and_revises_poor(spark):
    docs = [(1, "a", "en", "x y"), (2, "a", "en", "t u v"), (3, "a", "en", "p%%% q###"), (4, "b", "en", "z")]
    labels = spark.createDataFrame([(2, 1, 1), (3, 0, 0), (4, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {tuple(r) for r in rollups.report(frame(spark, docs), labels).collect()}
    assert got == count([(1, *d) for d in (docs[0], (3, "a", "en", "p q"), docs[3])])
