"""Request bodies and paths in the form that a provider takes.

Bodies are rewritten as JSON values (order and unknown keys survive); paths, roles and headers are
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.config import Config, Target, expand_key
from cloakwork.functions import jsontext
from cloakwork.functions.jsontext import dump

from . import routing
from .parts import put_texts

# Keywords that tool schemas may not hold, keys that the chat interface doesn't
# take, names of roles, headers and the interface version.
UNSUPPORTED = frozenset("patternProperties $schema $id $ref $defs definitions examples minLength maxLength minimum maximum multipleOf pattern format minItems maxItems uniqueItems minProperties maxProperties".split())
NOT_CHAT = frozenset("instructions input previous_response_id max_output_tokens text reasoning background conversation include max_tool_calls prompt store truncation".split())
ROLES = {"developer": "system", "system": "system", "assistant": "assistant", "tool": "tool"}
EFFORTS = {"max": "max", "xhigh": "max", "high": "high", "medium": "high", "low": "high"}
TEXTS = ("input_text", "output_text", "text")
SYSTEM = ("system", "developer")
GEMINI = routing.SPEAKERS["gemini"]
ANTHROPIC_VERSION = "2023-06-01"


def _lower(value) -> str | None:
    if value is None or isinstance(value, str):
        return value.lower() if value else value
    raise ValueError("a string was expected")


def _get(value, key: str):
    return value.get(key) if isinstance(value, dict) else None


def _blank(text: str | None) -> bool:
    return not text or not text.strip()


# ---------------------------------------------------------------- tool schemas
def clean(value, provider: str | None):
    """The value without any key that schemas may not hold, at any depth."""
    drop = UNSUPPORTED | ({"additionalProperties"} if (provider or "").lower() in GEMINI else frozenset())

    def walk(x):
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items() if k not in drop}
        return [walk(v) for v in x] if isinstance(x, list) else x

    return walk(value)


def cleaned(body: str, provider: str | None) -> Column:
    """Bodies whose tools, if they are a list, are cleaned."""
    return jsontext.rewriting(lambda b: b | {"tools": clean(b["tools"], provider)} if isinstance(_get(b, "tools"), list) else b, body)


# ---------------------------------------------------------------- responses to chat
def flat_text(node) -> str:
    """A text, an object's text, the texts of a list by lines; else the value's JSON."""
    if node is None:
        return ""
    if isinstance(node, str):
        return node
    if isinstance(_get(node, "text"), str):
        return node["text"]
    if isinstance(node, list):
        return "\n".join(t for t in map(flat_text, node) if not _blank(t))
    return dump(node)


def chat_content(content):
    """Items of a content list as chat parts; a list without any, and all else, as one text."""
    if not isinstance(content, list):
        return flat_text(content)
    parts = []
    for item in content:
        kind = _lower(_get(item, "type")) if isinstance(item, dict) else None
        if kind in TEXTS:
            parts.append({"type": "text", "text": "" if item.get("text") is None else item["text"]})
        elif kind == "input_image":
            url = next((item[k] for k in ("image_url", "url") if item.get(k) is not None), "")
            parts.append({"type": "image_url", "image_url": {"url": url}})
    return parts or flat_text(content)


def merge(old: str | None, new: str | None) -> str | None:
    return old if _blank(new) else new if _blank(old) else f"{old}\n{new}"


def chat_message(item: dict, thought: str | None) -> dict | None:
    """A chat message of an input item; None for a reasoning item. thought: reasoning before it."""
    kind = _lower(item.get("type"))
    if kind == "reasoning":
        return None
    if kind == "function_call_output":
        return {"role": "tool", "tool_call_id": item.get("call_id"), "content": flat_text(item.get("output"))}
    if kind == "function_call":
        arguments = "{}" if item.get("arguments") is None else item["arguments"]
        call = {"id": item.get("call_id"), "type": "function", "function": {"name": item.get("name"), "arguments": arguments}}
        message = {"role": "assistant", "content": "", "tool_calls": [call]}
    else:
        role = item.get("role")
        if role is not None and not isinstance(role, str):
            raise ValueError("a role must be a string")
        message = {"role": ROLES.get(role, "user"), "content": chat_content(item if item.get("content") is None else item["content"])}
    if message["role"] == "assistant" and not _blank(thought):
        message["reasoning_content"] = thought
    return message


def chat_messages(body: dict) -> list:
    """The messages of a responses request. Reasoning is carried on to the next object message."""
    out, thought = [], None
    if body.get("instructions") is not None:
        out.append({"role": "system", "content": flat_text(body["instructions"])})
    given = body.get("input")
    if isinstance(given, list):
        for item in given:
            if isinstance(item, str):
                out.append({"role": "user", "content": item})
            elif isinstance(item, dict):
                message = chat_message(item, thought)
                if message is None:
                    said = next((item[k] for k in ("content", "summary", "text") if item.get(k) is not None), None)
                    thought = merge(thought, flat_text(said))
                else:
                    out.append(message)
                    thought = None
    elif isinstance(given, str):
        out.append({"role": "user", "content": given})
    elif isinstance(body.get("messages"), list):
        out += body["messages"]
    return out


def effort(value: str | None) -> str | None:
    return None if _blank(value) else EFFORTS.get(value.strip().lower(), value.strip())


def responses_to_chat(body):
    """A responses request as a chat request; other bodies stay as they are."""
    if not isinstance(body, dict):
        raise ValueError("an object was expected")
    if all(body.get(k) is None for k in ("input", "instructions", "reasoning", "max_output_tokens")):
        return body
    out = {k: v for k, v in body.items() if k not in NOT_CHAT}
    out["messages"] = chat_messages(body)
    if body.get("max_output_tokens") is not None:
        out["max_completion_tokens"] = body["max_output_tokens"]
    asked = _get(body.get("reasoning"), "effort")
    strength = effort(asked if isinstance(asked, str) else None)
    if strength:
        out |= {"reasoning_effort": strength, "thinking": {"type": "enabled"}}
    if _get(body.get("text"), "format") is not None:
        out["response_format"] = body["text"]["format"]
    if body.get("stream") is True:
        options = body.get("stream_options")
        out["stream_options"] = (options if isinstance(options, dict) else {}) | {"include_usage": True}
    return out


# ---------------------------------------------------------------- other providers
def _functions(tools, schema: str) -> list:
    """Function tools as name, description and schema; other tools are left out."""
    functions = [t["function"] for t in tools if isinstance(_get(t, "function"), dict)] if isinstance(tools, list) else []
    return [{"name": f.get("name"), "description": f.get("description"), schema: {"type": "object"} if f.get("parameters") is None else f["parameters"]} for f in functions]


def to_anthropic(body):
    """Only model, limits, stream, messages, system text and function tools are taken over."""
    if not isinstance(body, dict):
        raise ValueError("an object was expected")
    out = {"model": body.get("model"), "max_tokens": 4096 if body.get("max_tokens") is None else body["max_tokens"], "stream": False if body.get("stream") is None else body["stream"]}
    if isinstance(body.get("messages"), list):
        messages = [m for m in body["messages"] if isinstance(m, dict)]
        said = [m.get("content") for m in messages if _lower(m.get("role")) in SYSTEM]
        out["messages"] = [m for m in messages if _lower(m.get("role")) not in SYSTEM]
        system = ""
        for text in said:
            if isinstance(text, str):
                system += ("\n" if system else "") + text
        if system:
            out["system"] = system
    if body.get("tools") is not None:
        out["tools"] = _functions(body["tools"], "input_schema")
    return out


def _gemini_text(content) -> str:
    if isinstance(content, str):
        return content
    if not isinstance(content, list):
        return ""
    texts = [p.get("text") for p in content if isinstance(p, dict) and _lower(p.get("type")) == "text"]
    return "\n".join(t for t in texts if isinstance(t, str) and t)


def to_gemini(body):
    """Messages as contents, system text apart; a body that has contents stays as it is."""
    if not isinstance(body, dict):
        raise ValueError("an object was expected")
    if body.get("contents") is not None:
        return body
    contents, system = [], []
    for m in body["messages"] if isinstance(body.get("messages"), list) else ():
        if isinstance(m, dict) and (text := _gemini_text(m.get("content"))):
            role = _lower(m.get("role")) or "user"
            if role in SYSTEM:
                system.append({"text": text})
            else:
                contents.append({"role": "model" if role == "assistant" else "user", "parts": [{"text": text}]})
    out: dict = {"contents": contents}
    if system:
        out["systemInstruction"] = {"parts": system}
    if declared := _functions(body.get("tools"), "parameters"):
        out["tools"] = [{"functionDeclarations": declared}]
    return out


def family(target: Target) -> str:
    """openai, anthropic or gemini. Other providers are no one's: ValueError."""
    found = routing.speaker_of(target.provider)
    if found is None:
        raise ValueError(f"Provider '{target.provider}' is not supported")
    return found


# ---------------------------------------------------------------- paths, headers
def base_path(target: Target) -> str:
    rest = target.base_url.rstrip("/").split("://", 1)[-1]
    return "/" + rest.split("/", 1)[1] if "/" in rest else ""


def below_base(path: Column, target: Target) -> Column:
    """The path without the prefix that the target's address already has."""
    base = base_path(target)
    if not base:
        return F.coalesce(path, F.lit("/"))
    return F.when(F.lower(path).startswith(base.lower() + "/"), F.substring(path, len(base) + 1, 100_000)).otherwise(F.coalesce(path, F.lit("/")))


def chat_path(path: Column) -> Column:
    """The chat path in place of the responses path; null for others."""
    low = F.lower(F.regexp_replace(path, "/+$", ""))
    return F.when(low == "/responses", "/chat/completions").when(low == "/v1/responses", "/v1/chat/completions")


def gemini_model(path: Column, model: Column) -> Column:
    """models/X of the path, else of the body's model."""
    at = F.instr(F.lower(path), "/models/")
    named = F.regexp_replace(F.substring(path, at + 1, F.length(path)), ":[\\s\\S]*$", "")
    own = F.when(F.trim(model) != "", F.when(F.lower(model).startswith("models/"), model).otherwise(F.concat(F.lit("models/"), model)))
    return F.when(at > 0, named).otherwise(own)


def outbound_path(path: Column, query: Column, model: Column, target: Target) -> Column:
    """Path and query below the target's address; null where a Gemini model is asked for and not named."""
    kind, query = family(target), F.coalesce(query, F.lit(""))
    if kind == "anthropic":
        own = F.coalesce(path, F.lit(""))
        return F.concat(F.when(F.lower(own).endswith("/chat/completions"), "/v1/messages").otherwise(own), query)
    if kind == "gemini":
        low = F.lower(F.coalesce(path, F.lit("")))
        suffix = F.when(low.contains("stream"), ":streamGenerateContent").otherwise(":generateContent")
        named = F.concat(F.lit("/v1beta/"), gemini_model(path, model), suffix, query)
        return F.when(low == "/v1beta/models", F.concat(path, query)).otherwise(named)
    own = below_base(path, target)
    deepseek = routing.compatibility(target, model) == routing.DEEPSEEK
    return F.concat(F.when(deepseek, F.coalesce(chat_path(own), own)).otherwise(own), query)


def uri(path_and_query: Column, target: Target) -> Column:
    return F.concat(F.lit(target.base_url.rstrip("/") + "/"), F.regexp_replace(path_and_query, "^/+", ""))


def outbound_body(body: str, path: str, model: str, target: Target) -> Column:
    """The body as the target takes it."""
    kind = family(target)
    if kind != "openai":
        return jsontext.rewriting(to_anthropic if kind == "anthropic" else to_gemini, body)
    responses = chat_path(below_base(F.col(path), target)).isNotNull() & (routing.compatibility(target, F.col(model)) == routing.DEEPSEEK)
    return jsontext.rewriting(lambda b, convert: responses_to_chat(b) if convert else b, body, responses)


def _by_target(name: Column, targets: dict[str, Target], make) -> Column:
    """make(target) of the row's target, by its name."""
    return F.coalesce(*(F.when(name == n, make(t)) for n, t in targets.items()))


def finished(targets: dict[str, Target], name: str = "target", body: str = "body", texts: str = "texts", path: str = "path", query: str = "query", model: str = "model") -> tuple[Column, Column, Column]:
    """Body, address and response headers of requests to any of the targets, in one pass.

    A body is opened once: its texts (a map of path to text, or null) are put in place, its tools
    cleaned, and the whole turned into what its target takes.
    """
    shapes = {n: (family(t), t.provider) for n, t in targets.items()}

    def change(root, new, target, convert):
        kind, provider = shapes[target]
        put_texts(root, new)
        if isinstance(_get(root, "tools"), list):
            root["tools"] = clean(root["tools"], provider)
        if kind == "openai":
            return responses_to_chat(root) if convert else root
        return to_anthropic(root) if kind == "anthropic" else to_gemini(root)

    own = F.col(name)
    chat = _by_target(own, targets, lambda t: chat_path(below_base(F.col(path), t)).isNotNull() & (routing.compatibility(t, F.col(model)) == routing.DEEPSEEK) if family(t) == "openai" else F.lit(False))
    out = jsontext.rewriting(change, body, texts, name, chat)
    address = _by_target(own, targets, lambda t: uri(outbound_path(F.col(path), F.col(query), F.col(model), t), t))
    headers = _by_target(own, targets, lambda t: F.create_map(*(F.lit(x) for pair in response_headers(t).items() for x in pair)).cast("map<string,string>"))
    return out, address, headers


def response_headers(target: Target) -> dict[str, str]:
    kind = family(target)
    if kind == "openai":
        return {}
    name = "anthropic" if kind == "anthropic" else target.provider or "gemini"
    return {"x-desensitize-provider": name, "x-desensitize-response-mode": "provider-native"}


def auth_headers(target: Target) -> dict[str, str]:
    """For whoever sends the requests. Never a column."""
    key, kind = expand_key(target.api_key), family(target)
    if kind == "openai":
        return {"Authorization": f"Bearer {key}"}
    return {"x-api-key": key, "anthropic-version": ANTHROPIC_VERSION} if kind == "anthropic" else {"x-goog-api-key": key}


def auth_header_names(target: Target) -> list[str]:
    return list(auth_headers(Target(target.base_url, "", target.provider)))


def role(name: Column) -> Column:
    """The chat role of a role; case counts."""
    return F.coalesce(*(F.when(name == k, F.lit(v)) for k, v in ROLES.items()), F.lit("user"))


def effort_of(value: Column) -> Column:
    low = F.lower(F.trim(value))
    known = F.coalesce(*(F.when(low == k, F.lit(v)) for k, v in EFFORTS.items()))
    return F.when(F.trim(value) != "", F.coalesce(known, F.trim(value)))


def default_target(config: Config) -> Target:
    return next(iter(config.targets.values()))
