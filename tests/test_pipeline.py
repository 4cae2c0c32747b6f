"""The whole dataflow, in batch and as a stream, and the registered queries."""

import json
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cloakwork.config import Config, Target
from cloakwork.functions.kernel import redacted
from cloakwork.operators import audit
from cloakwork.plans import more_queries, pipeline, queries  # noqa: F401
from cloakwork.sources import requests as source
from cloakwork.streaming import runner

SF = "/root/testdata/sf0.001"
TARGETS = {"openai": Target("https://o.example/v1"), "anthropic": Target("https://a.example", provider="anthropic")}


def request(name, body, path="/v1/chat/completions", method="POST"):
    return (name, method, path, "", None, "", body if body is None or isinstance(body, str) else json.dumps(body, ensure_ascii=False))


REQUESTS = [
    request("chat", {"model": "m", "messages": [{"role": "system", "content": "手机13912345678 password: keep-it"}, {"role": "user", "content": "Bob, 13912345678, a@b.co"}], "tools": [{"function": {"name": "f", "parameters": {"format": 1}}}]}),
    request("claude", {"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "密码是hunter2"}]}, "/v1/messages"),
    request("bad", "{"), request("null", "null"), request("none", None, "/v1/models", "GET"), request("health", None, "/health", "GET"), request("fail", {"messages": [{"role": "user", "content": "my salary, slow"}]}),
]


def extract(text):
    if "slow" in text:
        raise TimeoutError
    return json.dumps([{"type": "NAME", "value": "Bob"}] if "Bob" in text else [])


def frame(spark, rows=REQUESTS):
    return spark.createDataFrame(rows, source.SCHEMA)


def test_batch(spark):
    at = F.lit("2026-01-01 00:00:00").cast("timestamp")
    out = pipeline.run(frame(spark), Config(targets=TARGETS), extract, at=at)
    sent = {r.request_id: r for r in out.outbound.collect()}
    assert set(sent) == {"chat", "claude", "fail"} | ({"none"} & set(sent))
    chat = json.loads(sent["chat"].body)
    assert chat["messages"][0]["content"] == "手机[REDACTED:PHONE] password: keep-it"
    assert chat["messages"][1]["content"] == "[REDACTED:NAME], [REDACTED:PHONE], [REDACTED:EMAIL]"
    assert chat["tools"][0]["function"]["parameters"] == {} and sent["chat"].uri == "https://o.example/v1/chat/completions"
    claude = json.loads(sent["claude"].body)
    assert claude["system"] == "s" and "hunter2" not in sent["claude"].body and sent["claude"].response_headers["x-desensitize-provider"] == "anthropic"
    assert sent["chat"].content_length == len(sent["chat"].body.encode())
    rejects = {r.request_id: (r.status, r.body) for r in out.rejects.collect()}
    assert rejects["bad"] == (400, '{"error":{"message":"invalid json request body"}}') and rejects["null"][0] == 400
    log = {(r.source, r.label) for r in out.audit.collect()}
    assert {("regex", "PHONE"), ("llm", "NAME"), ("llm-post-regex", "EMAIL"), ("regex", "PASSWORD")} <= log
    status = source.checked(frame(spark), Config()).withColumn("block", F.lit(None).cast("string"))
    metrics = {(r.metric, r.tag): r.value for r in audit.counters(status, out.parts, out.results).collect()}
    assert metrics["desensitize_requests_total", None] == 6 and metrics["regex_hits_total", "phase2"] == 2 and metrics["llm_desensitize_calls_total", None] == 1
    assert sum(v for (m, _), v in metrics.items() if m == "llm_failures_total") == 1


def test_strict_mode_blocks(spark):
    out = pipeline.run(frame(spark), Config(targets=TARGETS, strict=True), extract)
    rejects = {r.request_id: r.status for r in out.rejects.collect()}
    assert rejects["fail"] == 502 and "chat" not in rejects
    off = pipeline.run(frame(spark), Config(targets={}), None)
    assert all(r.status == 502 for r in off.rejects.where("request_id = 'chat'").collect()) and off.outbound.count() == 0


def test_stream_matches_batch(spark, tmp_path):
    frame(spark).write.json(str(tmp_path / "in"))
    config = Config(targets=TARGETS)
    query = runner.start(source.stream(spark, str(tmp_path / "in")), config, str(tmp_path / "out"), extract)
    query.awaitTermination(120)
    got = {r.request_id: r.body for r in spark.read.json(str(tmp_path / "out" / "outbound" / "*")).collect()}
    assert got == {r.request_id: r.body for r in pipeline.run(frame(spark), config, extract).outbound.collect()}


def test_stream_of_parts_and_days(spark, tmp_path):
    rows = [("2026-01-01 15:59:00", "p", "a@b.co", False), ("2026-01-01 16:01:00", "p", "a@b.co c@d.ef", False)]
    df = spark.createDataFrame(rows, "at string, path string, text string, is_system boolean").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    runner.write_audit(runner.redacted_stream(stream), str(tmp_path / "audit"), "at").awaitTermination(120)
    log = spark.read.json(str(tmp_path / "audit" / "log" / "redactions"))
    assert {str(r.dt): r.n for r in log.groupBy("dt").agg(F.count("*").alias("n")).collect()} == {"2026-01-01": 1, "2026-01-02": 2}
    counts = runner.day_counts(runner.redacted_stream(stream), "at")
    counts.writeStream.outputMode("complete").format("memory").queryName("days").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.n for r in spark.table("days").collect()) == [1, 2]


def test_stream_cache_asks_once(spark, tmp_path):
    batches = [[("k1", "a", "hello"), ("k1", "b", "hello"), ("k2", "c", "slow")], [("k1", "d", "hello"), ("k2", "e", "slow")]]
    schema = "cache_key string, id string, text string"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    out = runner.cached_answers(stream, extract)
    query = out.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    done = spark.read.schema(runner.ANSWER)
    try:
        for _ in range(60):  # a query whose state times out has no last batch to wait for
            time.sleep(1)
            if (tmp_path / "out").exists() and done.json(str(tmp_path / "out")).count() == 5:
                break
    finally:
        query.stop()
    got = {r.id: (r.raw, r.failure, r.was_model_used) for r in done.json(str(tmp_path / "out")).collect()}
    assert sum(used for _, _, used in got.values()) == 1 and {got[i][0] for i in "abd"} == {"[]"}
    assert got["c"] == got["e"] == (None, "timeout", False)


def test_every_query_runs_and_matches_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in queries.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    wrong = []
    for name, build in queries.QUERIES.items():
        df = build(spark, SF)
        got = df.collect()
        if name not in queries.ORACLES:
            assert got, name
            continue
        con.execute(queries.ORACLES[name])
        names = [d[0] for d in con.description]
        assert sorted(names) == sorted(df.columns), name
        if sorted(str(tuple(r[c] for c in names)) for r in got) != sorted(map(str, con.fetchall())):
            wrong.append(name)
    assert not wrong


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("doc_id", redacted("text").alias("r"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "n_chars" not in plan


@pytest.mark.parametrize("module", ["config", "operators.parts", "streaming.runner", "plans.pipeline", "functions.kernel"])
def test_nothing_imports_the_llm_folder(module):
    import importlib
    import inspect

    assert "cloakwork.llm" not in inspect.getsource(importlib.import_module(f"cloakwork.{module}"))
