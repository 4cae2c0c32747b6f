"""Audit rows, their log, and the counters over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.config import Config
from cloakwork.functions import native


def audit_rows(parts: DataFrame, source: Column, at: Column, config: Config = Config(), hits: str = "hits") -> DataFrame:
    """A row per hit: timestamp (text, +08:00), source, path, isSystem, phase, label, count,
    originalValue (null if values aren't logged), redactedValue."""
    if not config.observability.redaction_log:
        parts = parts.limit(0)
    local = native.local_time(at)
    rows = parts.select(local.alias("_at"), source.alias("source"), "path", F.col("is_system").alias("isSystem"), F.explode(hits).alias("h"))
    value = F.col("h.original_value") if config.observability.log_values else F.lit(None).cast("string")
    return rows.select(
        F.date_format("_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+08:00'").alias("timestamp"), "source", "path", "isSystem",
        F.col("h.phase").alias("phase"), F.col("h.label").alias("label"), F.col("h.count").alias("count"), value.alias("originalValue"), F.col("h.redacted_value").alias("redactedValue"),
    )


def write_log(rows: DataFrame, folder: str) -> None:
    """Appends audit rows as JSON lines, a folder per local day. Nulls are written."""
    days = rows.withColumn("dt", F.substring("timestamp", 1, 10))
    days.write.mode("append").partitionBy("dt").option("ignoreNullFields", "false").json(f"{folder.rstrip('/')}/log/redactions")


def phase_counts(parts: DataFrame, phases: str = "hit_phases") -> DataFrame:
    """phase, n: parts that the phase changed (not its matches)."""
    return parts.select(F.explode(phases).alias("phase")).groupBy("phase").agg(F.count("*").alias("n"))


def label_counts(parts: DataFrame, hits: str = "hits") -> DataFrame:
    """phase, label, n: matches."""
    return parts.select(F.explode(hits).alias("h")).groupBy("h.phase", "h.label").agg(F.sum("h.count").cast("long").alias("n"))


def failure_counts(results: DataFrame) -> DataFrame:
    """reason, n of model results that aren't successes."""
    reason = F.coalesce("reason", F.lower("status"))
    return results.where("status <> 'Success'").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def counters(requests: DataFrame, parts: DataFrame, results: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """metric, tag, value: every counter in one table; empty when metrics are off.

    requests has status (null: bypassed) and block (a blocked request's message, else null).
    """
    spark = requests.sparkSession
    if not config.observability.metrics:
        return spark.createDataFrame([], "metric string, tag string, value double")

    def row(df: DataFrame, metric: str, value: Column) -> DataFrame:
        return df.agg(value.cast("double").alias("value")).select(F.lit(metric).alias("metric"), F.lit(None).cast("string").alias("tag"), "value")

    def tagged(df: DataFrame, metric: str, tag: str) -> DataFrame:
        return df.select(F.lit(metric).alias("metric"), F.col(tag).alias("tag"), F.col("n").cast("double").alias("value"))

    out = row(requests.where("not bypassed"), "desensitize_requests_total", F.count("*"))
    out = out.unionByName(tagged(phase_counts(parts), "regex_hits_total", "phase"))
    out = out.unionByName(row(requests, "strict_mode_blocks_total", F.count("block")))
    if results is not None:
        done = results.where("status = 'Success'")
        out = out.unionByName(row(done, "llm_desensitize_calls_total", F.count_if("was_model_used")))
        out = out.unionByName(row(done, "llm_cache_hits_total", F.count_if(~F.col("was_model_used"))))
        out = out.unionByName(tagged(failure_counts(results), "llm_failures_total", "reason"))
    return out


def durations(batches: DataFrame, seconds: str = "seconds") -> DataFrame:
    """The histogram of batch durations: count, sum, quartiles and tail."""
    quantiles = F.percentile_approx(seconds, F.array(*map(F.lit, (0.5, 0.9, 0.99))))
    return batches.agg(F.count(seconds).alias("n"), F.sum(seconds).alias("total"), quantiles.alias("quantiles"))


def summary(parts: DataFrame) -> DataFrame:
    """request_id, n_parts, n_hit_parts, n_queued."""
    queued = F.count_if(F.col("action") == "queue") if "action" in parts.columns else F.lit(0).cast("long")
    return parts.groupBy("request_id").agg(F.count("*").alias("n_parts"), F.count_if(F.size("hit_phases") > 0).alias("n_hit_parts"), queued.alias("n_queued"))


def error_body(message: Column) -> Column:
    """The body of an error reply; the message is put in as it is."""
    return F.concat(F.lit('{"error":{"message":"'), message, F.lit('"}}'))


def health(spark, llm: str, config: Config, cache_entries: int) -> DataFrame:
    """One row: status (healthy only if the model is connected) with its code, and what it rests on."""
    ok = llm == "connected"
    row = ("healthy" if ok else "degraded", 200 if ok else 503, "ok", llm, config.model.model, config.model.endpoint, cache_entries)
    return spark.createDataFrame([row], "status string, code int, regex string, llm string, llm_model string, llm_endpoint string, cache_entries long")
