"""Which texts go to the model: keyword rules, and the gates behind them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.config import Config
from cloakwork.functions import native

LEVELS = ("None", "Hint", "Trigger")


def check(text: Column, any_hit: Column, config: Config = Config()) -> Column:
    """struct(hit_level, reason, confidence). any_hit: whether the full redaction changes the text.

    A trigger keyword comes before a hit of the patterns, that before a hint keyword.
    """

    def result(level: str, reason: Column, confidence: float) -> Column:
        return F.struct(F.lit(level).alias("hit_level"), reason.cast("string").alias("reason"), F.lit(confidence).alias("confidence"))

    trigger, hint = native.first_keyword(text, config.triggers), native.first_keyword(text, config.hints)
    nothing = result("None", F.lit(None), 0.0)
    return (
        F.when(native.blank(text), nothing)
        .when(trigger.isNotNull(), result("Trigger", F.concat(F.lit("trigger keyword: "), trigger), 1.0))
        .when(any_hit, result("Trigger", F.lit("regex hit"), 1.0))
        .when(hint.isNotNull(), result("Hint", F.concat(F.lit("hint keyword: "), hint), 0.5))
        .otherwise(nothing)
    )


def should_run_model(level: Column, any_hit: Column, config: Config = Config()) -> Column:
    return (level == "Trigger") | ((level == "Hint") & (any_hit | F.lit(config.strict)))


def model_action(original: Column, current: Column, is_system: Column, level: Column, any_hit: Column, config: Config = Config()) -> Column:
    """skip, queue, or block_413: what becomes of a part after the patterns have run.

    original is the text before redaction, current the text after it.
    """
    system_too = config.system.rule_engine and config.system.llm
    skipped = native.blank(current) | native.blank(original) | (is_system & F.lit(not system_too))
    long_ = native.units(original) > config.max_part_units
    blocked = F.lit(config.strict) & (level != "None")
    return (
        F.when(skipped, "skip")
        .when(long_, F.when(blocked, "block_413").otherwise("skip"))
        .when(should_run_model(level, any_hit, config), "queue")
        .otherwise("skip")
    )


# What a blocked request is told.
TOO_LARGE = "PII semantic desensitization skipped because text part is too large"
DISABLED = "PII semantic desensitization disabled in strict mode"
FAILED = "PII desensitization failed in strict mode"


def block_of(part_idx: Column, action: Column, model_status: Column, level: Column, config: Config = Config()) -> Column:
    """Aggregate over a request's parts: struct(status, message) of its first block, or null.

    A part that is too large blocks before the model is asked; then a disabled model, then the
    first part in order that the model failed on. All but the first only in strict mode.
    """
    large = F.max((action == "block_413").cast("int")) == 1
    queued = F.max((action == "queue").cast("int")) == 1
    bad = (action == "queue") & (F.coalesce(model_status, F.lit("ModelFailure")) != "Success") & (level != "None")
    failed = F.min(F.when(bad, part_idx)).isNotNull()

    def block(status: int, message: str) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(message).alias("message"))

    out = F.when(large, block(413, TOO_LARGE))
    if config.strict:
        out = out.when(queued, block(502, DISABLED)) if not config.model.enabled else out.when(failed, block(502, FAILED))
    return out
