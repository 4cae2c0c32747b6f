"""The pipeline stage by stage, and the registered queries of this folder."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from cloakwork.llm import decontaminate, pii, quality, simhash
from cloakwork.llm.common import table

from .test_decontaminate import brute as brute_hits
from .test_nearcopies import brute_classes
from .test_pii import brute as brute_spans
from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    seen = {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "mixing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        now = {r.doc_id: r.text for r in docs.collect()}
        if name != "mixing":
            assert docs.columns == columns
        if name == "quality":
            report = quality.report(table(spark, SF, "documents"), table(spark, SF, "labels"))
            assert set(now) == {r.doc_id for r in report.collect() if r.predicted}
        elif name == "near_dedup":
            ids = sorted(seen)
            # the stage's links: operator 4's, and five-word shingles of Jaccard 0.8 or more
            assert set(now) == {ids[r] for r in brute_classes([seen[i] for i in ids])}
            first = brute_components([brute_fingerprint(seen[i]) for i in ids])
            assert set(now) <= {ids[r] for r in first}
        elif name == "decontamination":
            items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
            assert set(now) == {r[0] for r in brute_hits(list(seen.items()), items) if not r[5]}
        elif name == "pii":
            assert set(now) == set(seen)
            for i, text in seen.items():
                spans = brute_spans(text)
                assert all(text[a:b] not in now[i] for a, _, b in spans) and (now[i] == text or spans or "[SECRET]" in now[i])
        else:
            assert set(now) <= set(seen) and now and set(columns) < set(docs.columns)
        seen = now


def test_run_gives_the_last_stage(spark):
    assert {"doc_id", "text", "topic", "weight", "probability"} <= set(corpus_pipeline.run(spark, SF).columns)


@pytest.mark.parametrize("name", ["op5_token_counts", "op8_licenses", "op9_decontamination"])
def test_oracles(spark, name):
    import duckdb

    got = entry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, con.fetchall()))


def test_native_operators_stay_in_the_jvm(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    for df in (decontaminate.clean(docs, items), decontaminate.report(docs, items), pii.scan(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_near_copies_leave_one_each(spark):
    docs = table(spark, SF, "documents")
    once = simhash.one_of_each(docs)
    assert simhash.report(once).groupBy("component_id").count().where("count > 1").isEmpty()


def test_odd_rows_pass_every_stage(spark):
    columns = "doc_id long, text string, lang string, source string, n_chars long, row string, topic string, weight double, _t string, count int, w string"
    long = "word " * 60_000
    odd = [
        (1, None, None, None, None, None, None, None, None, None, None), (None, "a null id stays, with its text", "en", "s", 30, "r", "t", 1.0, "x", 1, "w"), (3, "", "en", "s", 0, "r", None, None, "x", 1, "w"),
        (4, "twice the same row", "en", "s", 18, "r", "t", 1.0, "x", 1, "w"), (4, "twice the same row", "en", "s", 18, "r", "t", 1.0, "x", 1, "w"), (5, long, "en", "s", len(long), "r", "t", 1.0, "x", 1, "w"), (6, "mail a@b.co", "", "", 11, "", "", 0.0, "", 0, ""),
    ]
    docs = spark.createDataFrame(odd, columns)
    kept = dict(corpus_pipeline.STAGES)
    near = kept["near_dedup"](spark, docs, SF)
    assert near.columns == docs.columns and sorted(r.doc_id or 0 for r in near.collect()) == [0, 1, 4, 5, 6]  # 1 and 3 have no words
    clean = kept["decontamination"](spark, docs, SF)
    assert clean.columns == docs.columns and clean.count() == len(odd)
    redacted = kept["pii"](spark, docs, SF)
    assert redacted.columns == docs.columns and sorted(r.text or "" for r in redacted.collect())[3:5] == ["mail [EMAIL]", "twice the same row"]
    assert set(docs.columns) <= set(kept["mixing"](spark, docs, SF).columns)
    report = {(r.doc_id, r.score): r.predicted for r in quality.report(docs, table(spark, SF, "labels")).collect()}
    passed = sorted(str(r.doc_id) for r in kept["quality"](spark, docs, SF).collect())
    assert passed == sorted(str(r.doc_id) for r in quality.report(docs, table(spark, SF, "labels")).where("predicted = 1").collect()) and len(report) >= 6
    mixed = kept["mixing"](spark, docs, SF)
    # every cell has its own topic or language: whole documents are kept or left by their draw alone
    assert {tuple(r) for r in mixed.select("doc_id", "text").collect()} <= {(r[0], r[1]) for r in odd} and mixed.count() in range(1, len(odd))
    for _, stage in corpus_pipeline.STAGES:
        assert set(docs.columns) <= set(stage(spark, docs, SF).columns)
        assert stage(spark, docs.limit(0), SF).count() == 0
