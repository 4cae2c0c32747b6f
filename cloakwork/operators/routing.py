"""Where a request goes: protocol, target, compatibility mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.config import Config, Target

# Which providers speak a protocol, and the modes of the responses interface.
SPEAKERS = {"openai": ("openai", "openai-compatible"), "anthropic": ("anthropic",), "gemini": ("gemini", "google", "vertex")}
PROVIDERS = tuple(p for names in SPEAKERS.values() for p in names)
NATIVE, AUTO, DEEPSEEK = "native", "auto", "deepseek-chat-completions"
NO_TARGETS = "No upstream targets configured"
NO_DEFAULT = "Multiple upstream targets configured. Set a default target or define a target named 'default'."


def _has(body: Column, key: str) -> Column:
    """Whether the variant body has a value that isn't null under the key."""
    value = F.try_variant_get(body, f"$.{key}", "variant")
    return value.isNotNull() & ~F.is_variant_null(value)


def protocol(path: Column, body: Column | None = None) -> Column:
    """anthropic, gemini, openai, or null. body is a variant; none for requests without one."""
    low = F.lower(F.coalesce(path, F.lit("")))
    has = (lambda key: _has(body, key)) if body is not None else (lambda key: F.lit(False))
    return (
        F.when(low.contains("/messages"), "anthropic")
        .when((low == "/v1beta/models") | low.contains("generatecontent"), "gemini")
        .when(has("contents") | has("systemInstruction"), "gemini")
        .when(low.contains("/responses") | low.contains("/chat/completions") | has("input"), "openai")
    )


def speaker_of(provider: str | None) -> str | None:
    name = (provider if provider is not None else "openai-compatible").lower()
    return next((p for p, names in SPEAKERS.items() if name in names), None)


def target_name(spoken: Column, config: Config) -> Column:
    """The name of the target for a protocol: the first that speaks it, the default one, the one
    called default, or the only one; null if none of these."""
    by_protocol = {}
    for name, target in config.targets.items():
        by_protocol.setdefault(speaker_of(target.provider), name)
    rest = None
    if config.default_target and config.default_target.strip():
        rest = config.default_target if config.default_target in config.targets else None
    rest = rest or ("default" if "default" in config.targets else None) or (next(iter(config.targets)) if len(config.targets) == 1 else None)
    found = F.lit(rest).cast("string")
    for p in SPEAKERS:
        if p in by_protocol:
            found = F.when(spoken == p, F.lit(by_protocol[p])).otherwise(found)
    return found


def target_error(config: Config) -> str:
    return NO_DEFAULT if config.targets else NO_TARGETS


def model_matches(pattern: str | None, model: Column) -> Column:
    """A pattern with a star at its end is a prefix; case never counts; blanks never match."""
    wanted = (pattern or "").strip().lower()
    if not wanted:
        return F.lit(False)
    low = F.lower(model)
    return F.coalesce((F.trim(model) != "") & (low.startswith(wanted[:-1]) if wanted.endswith("*") else low == wanted), F.lit(False))


def _mode(mode: str | None) -> str:
    name = (mode or "").strip().lower()
    return AUTO if name in ("", AUTO) else DEEPSEEK if name == DEEPSEEK else NATIVE


def host(url: str) -> str:
    rest = url.split("://", 1)
    return rest[1].split("/")[0].split("@")[-1].split(":")[0].lower() if len(rest) == 2 else ""


def compatibility(target: Target, model: Column) -> Column:
    """The mode for a model: of the first rule that matches, else the target's, else by its host.

    A rule's own `auto` stands as it is, and isn't the DeepSeek mode.
    """
    mode = _mode(target.responses_compatibility)
    if mode == AUTO:
        mode = DEEPSEEK if "deepseek" in host(target.base_url) else NATIVE
    found = F.lit(mode)
    for rule in reversed(target.rules):
        if rule.mode and rule.mode.strip():
            found = F.when(model_matches(rule.model_pattern, model), F.lit(_mode(rule.mode))).otherwise(found)
    return found
