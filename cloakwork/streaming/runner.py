"""The dataflow over a stream of requests, and a cache of model results with sliding expiry."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cloakwork.config import Config
from cloakwork.operators import audit, semantic
from cloakwork.plans import pipeline
from cloakwork.plans.pipeline import classified, redact_parts

EXPIRY = timedelta(minutes=30)


def redacted_stream(text_parts: DataFrame, config: Config = Config()) -> DataFrame:
    """Redacted and classified parts of a stream of parts. No state: any output mode, any restart."""
    return classified(redact_parts(text_parts, config), config)


def start(requests: DataFrame, config: Config, folder: str, extract: semantic.Extractor | None = None, **trigger) -> StreamingQuery:
    """Runs the dataflow on every micro-batch; outbound, rejects and audit go to folders below
    `folder`, each batch to its own, so that a batch that is run again replaces what it had written.
    """

    def batch(df: DataFrame, n: int) -> None:
        held = df.persist()
        outcome = pipeline.run(held, config, extract, hold=DataFrame.persist)
        try:
            for name, rows in (("outbound", outcome.outbound), ("rejects", outcome.rejects), ("audit", outcome.audit)):
                rows.write.mode("overwrite").json(f"{folder}/{name}/batch={n}", ignoreNullFields=False)
        finally:
            outcome.parts.unpersist()
            held.unpersist()

    writer: DataStreamWriter = requests.writeStream.foreachBatch(batch).option("checkpointLocation", f"{folder}/_checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def day_counts(parts: DataFrame, at: str, watermark: str = "1 hour") -> DataFrame:
    """phase, label, count by local day of a stream's hits; late ones count within the watermark."""
    rows = parts.withWatermark(at, watermark).select(at, F.explode("hits").alias("h"))
    day = F.window(F.col(at), "1 day", startTime="16 hours")  # midnight at +08:00
    return rows.groupBy(day.alias("day"), "h.phase", "h.label").agg(F.sum("h.count").alias("n"))


ANSWER = "cache_key string, id string, text string, raw string, failure string, was_model_used boolean"


def cached_answers(queue: DataFrame, extract: semantic.Extractor, expiry: timedelta = EXPIRY) -> DataFrame:
    """ANSWER columns for a stream of cache_key, id, text: equal keys ask the model once.

    An answer is kept as the key's state until it hasn't been asked for during the expiry: every
    use sets the clock back. Failures aren't kept. Run it with a processing-time trigger: a query
    whose state can time out never has a last batch.
    """
    wait = int(expiry.total_seconds() * 1000)

    def answer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(batches)
        used, failure, raw = False, None, state.get[0] if state.exists else None
        if raw is None:
            used = True
            try:
                raw = extract(rows["text"].iloc[0])
            except TimeoutError:
                failure = "timeout"
            except (OSError, ValueError, RuntimeError) as e:
                failure = str(e)
        if raw is not None:
            state.update((raw,))
            state.setTimeoutDuration(wait)
        n = len(rows)
        # of equal texts in a batch only the first asks; the others find its answer
        yield pd.DataFrame({"cache_key": key[0], "id": rows["id"], "text": rows["text"], "raw": [raw] * n, "failure": [failure] * n, "was_model_used": [used and failure is None and i == 0 for i in range(n)]})

    grouped = queue.select("cache_key", "id", "text").groupBy("cache_key")
    return grouped.applyInPandasWithState(answer, ANSWER, "raw string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def write_audit(stream_parts: DataFrame, folder: str, at: str, config: Config = Config()) -> StreamingQuery:
    """Appends the audit rows of a stream of redacted parts, a folder per local day."""
    rows = audit.audit_rows(stream_parts, F.lit("regex"), F.col(at), config).withColumn("dt", F.substring("timestamp", 1, 10))
    writer = rows.writeStream.format("json").partitionBy("dt").option("path", f"{folder}/log/redactions").option("ignoreNullFields", "false")
    return writer.option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()
