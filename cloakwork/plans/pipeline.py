"""The whole dataflow: requests in; outbound requests, rejects, audit rows and counters out.

Request bodies are opened once. Parts meet their request again by request_id only, so the plan
shuffles where texts of one request gather and, if a model takes part, where equal texts do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.config import Config
from cloakwork.functions.kernel import HIT, redacted
from cloakwork.operators import audit, classify, parts, providers, routing, semantic
from cloakwork.sources import requests as source

NO_HITS = f"cast(array() as array<{HIT}>)"


@dataclass
class Outcome:
    """What a run gives. outbound: requests to send on; rejects: status and error body."""

    outbound: DataFrame
    rejects: DataFrame
    parts: DataFrame
    audit: DataFrame
    results: DataFrame | None


def redact_parts(text_parts: DataFrame, config: Config = Config()) -> DataFrame:
    """text_parts with content, hit_phases, hits: one pass of the redaction kernel."""
    df = text_parts.withColumn("_r", redacted("text", config.rules, config.system, "is_system"))
    return df.select(*text_parts.columns, "_r.content", "_r.hit_phases", "_r.hits")


def classified(redacted_parts: DataFrame, config: Config = Config()) -> DataFrame:
    """With hit_level, reason, confidence and action.

    Detection reads the text before redaction. For user text its redaction tells whether anything
    hits; system text, whose redaction may be partial, is only looked at if the policy says so.
    """
    df = redacted_parts
    if config.system.rule_engine:
        df = df.withColumn("_full", F.when(F.col("is_system"), redacted("text", config.rules)["content"] != F.col("text")).otherwise(F.col("content") != F.col("text")))
    else:
        df = df.withColumn("_full", F.col("content") != F.col("text"))
    any_hit = F.coalesce("_full", F.lit(False))
    df = df.withColumn("_d", classify.check(F.col("text"), any_hit, config))
    action = classify.model_action(F.col("text"), F.col("content"), F.col("is_system"), F.col("_d.hit_level"), any_hit, config)
    return df.select(*redacted_parts.columns, "_d.hit_level", "_d.reason", "_d.confidence", action.alias("action"))


def with_semantics(df: DataFrame, extract: semantic.Extractor, config: Config = Config(), cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Classified parts after the model, and the model's results for those that were queued."""
    queue = df.where("action = 'queue'").select("request_id", "path", "part_idx", "text", "hit_level")
    results = semantic.redacted_by_model(queue, extract, config, cache)
    again = results.withColumn("_r", F.when(F.col("status") == "Success", redacted("content", config.rules)))
    again = again.select("request_id", "part_idx", "status", F.col("reason").alias("failure"), "was_model_used", F.col("hits").alias("model_hits"), F.col("_r.content").alias("final"), F.col("_r.hits").alias("post_hits"))
    joined = df.join(again, ["request_id", "part_idx"], "left")
    return joined.withColumn("content", F.coalesce("final", "content")), results


def run(requests: DataFrame, config: Config, extract: semantic.Extractor | None = None, cache: DataFrame | None = None, at: Column | None = None, hold: Callable[[DataFrame], DataFrame] | None = None) -> Outcome:
    """requests: request_id, method, path, query, content_length, transfer_encoding, body.

    at: the time of audit rows (now, by default). hold: what keeps the redacted parts (persist, or
    a table written and read again) for callers that use several outputs; without it each output
    redacts for itself.
    """
    checked = source.checked(requests, config)
    live = checked.where("not bypassed and status = 200")
    opened = live.where("with_body")
    text_parts = parts.text_parts(opened.select("request_id", "body"))
    df = classified(redact_parts(text_parts, config), config)
    results = None
    if extract is not None and config.model.enabled:
        df, results = with_semantics(df, extract, config, cache)
    else:
        none = {"status": "string", "failure": "string", "was_model_used": "boolean", "model_hits": f"array<{HIT}>", "final": "string", "post_hits": f"array<{HIT}>"}
        df = df.withColumns({k: F.lit(None).cast(v) for k, v in none.items()})
    if hold is not None:
        df = hold(df)
    per_request = df.groupBy("request_id").agg(
        classify.block_of(F.col("part_idx"), F.col("action"), F.col("status"), F.col("hit_level"), config).alias("block"),
        F.map_from_entries(F.collect_list(F.struct("path", F.col("content").alias("text")))).alias("texts"),
    )
    joined = live.join(per_request, "request_id", "left")
    model = F.try_variant_get(F.try_parse_json("body"), "$.model", "string")
    spoken = routing.protocol(F.col("path"), F.try_parse_json("body"))
    routed = joined.withColumns({"target": routing.target_name(spoken, config), "model": model})
    # every target's requests go on together: the redaction behind them runs once

    failed = routed.where("block is not null or target is null")
    message = F.coalesce("block.message", F.lit(routing.target_error(config)))
    late = failed.select("request_id", F.coalesce("block.status", F.lit(502)).alias("status"), audit.error_body(message).alias("body"))
    early = checked.where("not bypassed and status <> 200").select("request_id", "status", audit.error_body(F.col("message")).alias("body"))

    fine = routed.where("block is null and target is not null")
    if config.targets:
        new_body, address, headers = providers.finished(config.targets)
        sent = fine.select("request_id", "method", "target", address.alias("uri"), new_body.alias("body"), headers.alias("response_headers"))
        sent = source.outbound(sent)
    else:
        sent = fine.limit(0).select("request_id", "method", "target")

    now = F.current_timestamp() if at is None else at
    rows = audit.audit_rows(df, F.lit("regex"), now, config)
    if results is not None:
        came = F.when(F.col("was_model_used"), F.lit("llm")).otherwise(F.lit("llm-cache"))
        done = df.where("status = 'Success'")
        rows = rows.unionByName(audit.audit_rows(done, came, now, config, "model_hits")).unionByName(audit.audit_rows(done, F.lit("llm-post-regex"), now, config, "post_hits"))
    return Outcome(sent, early.unionByName(late), df, rows, results)
