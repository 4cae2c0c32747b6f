"""Semantic redaction: a pluggable extractor names values, which are then replaced literally."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.config import Config, prompt
from cloakwork.functions import native
from cloakwork.functions.kernel import HIT

#: An extractor takes a text and gives the model's raw answer. It may raise TimeoutError, or
#: OSError, ValueError, RuntimeError with a message.
Extractor = Callable[[str], str]

ITEMS = "array<struct<type:string,value:string>>"


def chat_url(endpoint: Column, kind: Column) -> Column:
    """The address of the model's chat call."""
    base = F.regexp_replace(endpoint, "/+$", "")
    low = F.lower(base)
    native_ = F.when(low.endswith("/api/chat"), base).otherwise(F.concat(base, F.lit("/api/chat")))
    other = F.when(low.endswith("/chat/completions"), base).when(low.endswith("/v1"), F.concat(base, F.lit("/chat/completions"))).otherwise(F.concat(base, F.lit("/v1/chat/completions")))
    return F.when(F.lower(kind) == "ollama-native", native_).otherwise(other)


def answer(payload: Column) -> Column:
    """The text of the model's reply: of the first choice, of the message, or the whole payload."""
    v = F.try_parse_json(payload)

    def text(path: str) -> Column:
        x = F.try_variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))

    return F.coalesce(text("$.choices[0].message.content"), text("$.message.content"), payload)


def model_client(config: Config = Config(), root: str = ".") -> Extractor:
    """An extractor that asks a local model by HTTP."""
    model, system = config.model, prompt(config, root)
    base = model.endpoint.rstrip("/")
    low, is_native = base.lower(), model.type.lower() == "ollama-native"
    if is_native:
        url = base if low.endswith("/api/chat") else base + "/api/chat"
    else:
        url = base if low.endswith("/chat/completions") else base + ("" if low.endswith("/v1") else "/v1") + "/chat/completions"

    def extract(text: str) -> str:
        body = {"model": model.model, "messages": [{"role": "system", "content": system}, {"role": "user", "content": text}], "stream": False}
        body |= {"options": {"temperature": 0}} if is_native else {"temperature": 0}
        request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
        if model.api_key and model.api_key.strip():
            request.add_header("Authorization", f"Bearer {model.api_key}")
        try:
            with urllib.request.urlopen(request, timeout=max(1, model.timeout_ms) / 1000) as reply:
                payload = reply.read().decode()
        except urllib.error.HTTPError as e:
            raise OSError(f"local model returned {e.code}") from None
        return reply_text(payload)

    return extract


def chat_client(chat: Callable[[list[dict]], str], config: Config = Config(), root: str = ".") -> Extractor:
    """An extractor over any chat function that takes messages and gives a text."""
    system = prompt(config, root)
    return lambda text: chat([{"role": "system", "content": system}, {"role": "user", "content": text}]) or "[]"


def reply_text(payload: str) -> str:
    """answer(), for one payload. Payloads that are no JSON raise ValueError."""
    doc = json.loads(payload)
    if isinstance(doc, dict):
        choices = doc.get("choices")
        first = choices[0] if isinstance(choices, list) and choices else None
        for owner in (first, doc):
            message = owner.get("message") if isinstance(owner, dict) else None
            if isinstance(message, dict) and isinstance(message.get("content"), str):
                return message["content"]
    return payload


def probe(extract: Extractor, config: Config = Config()) -> str:
    """disabled, connected, timeout or error."""
    if not config.model.enabled:
        return "disabled"
    try:
        extract("health check: no pii")
    except TimeoutError:
        return "timeout"
    except Exception:  # whatever an extractor raises means the same here
        return "error"
    return "connected"


def fingerprint(config: Config = Config(), root: str = ".") -> str:
    """What the answers depend on besides the text: part of every cache key."""
    payload = {"prompt": prompt(config, root), "model": config.model.model, "mapping": 1, "rules": asdict(config.rules), "keywords": [config.triggers, config.hints]}
    return hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True).encode()).hexdigest().upper()


def normalised(raw: Column) -> Column:
    """The JSON array in a raw answer: fences, single quotes and trailing commas are mended."""
    x = F.regexp_replace(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), r"(?iU)^```(?:json)?\s*|\s*```$", "")
    start = F.instr(x, "[")
    end = F.length(x) - F.instr(F.reverse(x), "]") + 1
    has_end = (F.instr(x, "]") > 0) & (end >= start)
    x = F.when(start > 0, F.when(has_end, F.substring(x, start, end - start + 1)).otherwise(F.concat(F.substring(x, start, F.length(x)), F.lit("]")))).otherwise(x)
    x = F.regexp_replace(x, r"'([^'\r\n]*)'", '"$1"')
    return F.regexp_replace(x, r"(?U),\s*([}\]])", "$1")


def items(raw: Column) -> Column:
    """array<struct<type, value>> of a raw answer; null if it holds no JSON array. Items without a
    type or value of text are passed over."""
    v = F.try_parse_json(F.when(~native.blank(raw), normalised(raw)))
    array = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))

    def text(x: Column, key: str) -> Column:
        y = F.try_variant_get(x, f"$.{key}", "variant")
        return F.when(F.schema_of_variant(y) == "STRING", F.try_variant_get(y, "$", "string"))

    pairs = F.transform(array, lambda x: F.struct(text(x, "type").alias("type"), text(x, "value").alias("value")))
    return F.filter(pairs, lambda p: ~native.blank(p["type"]) & ~native.blank(p["value"]))


def occurrences(text: Column, value: Column) -> Column:
    """How often value occurs in text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, value, F.lit("")))) / F.length(value)).cast("int")


def fold(text: Column, found: Column) -> Column:
    """struct(content, hits): the items' values replaced, the longest first, equals in their order."""
    ranked = F.array_sort(F.transform(found, lambda p, i: F.struct((-native.units(p["value"])).alias("n"), i.alias("i"), p["type"].alias("type"), p["value"].alias("value"))))
    zero = F.struct(text.alias("content"), F.expr(f"cast(array() as array<{HIT}>)").alias("hits"))

    def step(acc: Column, p: Column) -> Column:
        label = native.type_label(p["type"])
        put = F.concat(F.lit("[REDACTED:"), label, F.lit("]"))
        n = occurrences(acc["content"], p["value"])
        hit = F.struct(F.lit("llm").alias("phase"), label.alias("label"), p["value"].alias("original_value"), put.alias("redacted_value"), n.alias("count"))
        return F.when(n > 0, F.struct(F.replace(acc["content"], p["value"], put).alias("content"), F.concat(acc["hits"], F.array(hit)).alias("hits"))).otherwise(acc)

    return F.aggregate(ranked, zero, step)


def built(text: Column, level: Column, raw: Column) -> Column:
    """struct(content, status, reason, hits) of a raw answer."""
    return native.bound(items(raw), lambda every: _built(text, level, every))


def _built(text: Column, level: Column, every: Column) -> Column:
    valid = F.filter(every, lambda p: text.contains(p["value"]))
    none = F.expr(f"cast(array() as array<{HIT}>)")

    def result(content: Column, status: str, reason: str | None, hits: Column) -> Column:
        return F.struct(content.alias("content"), F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"), hits.alias("hits"))

    done = fold(text, valid)
    return (
        F.when(every.isNull(), result(text, "ParseFailure", "invalid json array", none))
        .when(F.size(every) == 0, F.when(level == "None", result(text, "Success", None, none)).otherwise(result(text, "EmptyResult", "empty pii array", none)))
        .when(F.size(valid) == 0, result(text, "AllItemsInvalid", "all values missing from original content", none))
        .otherwise(result(done["content"], "Success", None, done["hits"]))
    )


def asked(extract: Extractor, text: str = "text", workers: int = 4) -> Column:
    """struct(raw, failure, seconds): the extractor's answers. A batch's texts are asked `workers` at a time."""

    def one(t: str) -> tuple[str | None, str | None, float]:
        began = time.monotonic()
        try:
            raw, failure = extract(t), None
        except TimeoutError:
            raw, failure = None, "timeout"
        except (OSError, ValueError, RuntimeError) as e:
            raw, failure = None, str(e)
        return raw, failure, time.monotonic() - began

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(max(1, workers)) as pool:
            for texts in batches:
                yield pd.DataFrame(list(pool.map(one, texts)), columns=["raw", "failure", "seconds"])

    return F.pandas_udf(run, "struct<raw:string,failure:string,seconds:double>")(text)


def redacted_by_model(queue: DataFrame, extract: Extractor, config: Config = Config(), cache: DataFrame | None = None, root: str = ".") -> DataFrame:
    """queue (with text, hit_level) and content, was_model_used, status, reason, hits, seconds (of the answer).

    Equal texts are asked for once. `cache` (cache_key, content, hits) holds earlier results, which
    come first and are marked as such. Only successful results are worth keeping (see cacheable).
    """
    queue = queue.withColumn("cache_key", native.cache_key(F.col("text"), fingerprint(config, root)))
    distinct = queue.groupBy("cache_key", "hit_level").agg(F.first("text").alias("text"))
    once = distinct.groupBy("cache_key").agg(F.first("text").alias("text"))
    if cache is not None:
        once = once.join(cache.select("cache_key"), "cache_key", "left_anti")
    answers = once.withColumn("a", asked(extract, "text", config.model.max_concurrency)).select("cache_key", "a.raw", "a.failure", "a.seconds")
    fresh = distinct.join(answers, "cache_key").select("cache_key", "hit_level", "failure", "seconds", built(F.col("text"), F.col("hit_level"), F.col("raw")).alias("r"), "text")
    failed = F.col("failure").isNotNull()
    fresh = fresh.select(
        "cache_key", "hit_level",
        F.when(failed, F.col("text")).otherwise(F.col("r.content")).alias("content"),
        (~failed).alias("was_model_used"),
        F.when(failed, "ModelFailure").otherwise(F.col("r.status")).alias("status"),
        F.when(failed, F.col("failure")).otherwise(F.col("r.reason")).alias("reason"),
        F.when(failed, F.expr(f"cast(array() as array<{HIT}>)")).otherwise(F.col("r.hits")).alias("hits"),
        "seconds",
    )
    results = fresh
    if cache is not None:
        hits = F.transform("hits", lambda h: h.withField("phase", F.lit("llm-cache")))
        known = distinct.select("cache_key", "hit_level").join(cache.select("cache_key", "content", hits.alias("hits")), "cache_key")
        results = fresh.unionByName(known.select("cache_key", "hit_level", "content", F.lit(False).alias("was_model_used"), F.lit("Success").alias("status"), F.lit(None).cast("string").alias("reason"), "hits", F.lit(None).cast("double").alias("seconds")))
    return queue.join(results, ["cache_key", "hit_level"])


def cacheable(results: DataFrame) -> DataFrame:
    """cache_key, content, hits of the results that the model has just given."""
    own = results.where("status = 'Success' and was_model_used")
    return own.groupBy("cache_key").agg(F.first("content").alias("content"), F.first("hits").alias("hits"))
