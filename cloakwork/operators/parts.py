"""Text parts of request bodies: out to rows, and back by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakwork.functions import jsontext

PART = "array<struct<path:string,text:string,is_system:boolean>>"
#: The types of content items that hold text, by the shape of the body.
CHAT_TYPES, INPUT_TYPES, SYSTEM_ROLES = ("text",), ("input_text", "output_text", "text"), ("system", "developer")


def _get(v: Column, key: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _string(v: Column) -> Column:
    """The value if it is a JSON string, else null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _list(v: Column, key: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{key}", "array<variant>"), F.expr("cast(array() as array<variant>)"))


def _part(path: Column, text: Column, is_system: Column) -> Column:
    return F.struct(path.alias("path"), text.alias("text"), F.coalesce(is_system, F.lit(False)).alias("is_system"))


def _items(owner: Column, path: Column, types: tuple[str, ...], is_system: Column) -> Column:
    """The parts of a content list whose items have one of the types."""

    def one(x: Column, j: Column) -> Column:
        fits = F.lower(_string(_get(x, "type"))).isin(*types)
        return _part(F.concat(path, F.lit(".content["), j.cast("string"), F.lit("].text")), F.when(fits, _string(_get(x, "text"))), is_system)

    return F.transform(_list(owner, "content"), one)


def _messages(body: Column, key: str, types: tuple[str, ...]) -> Column:
    """Parts of a list of messages: contents that are strings, or lists of typed items."""

    def one(m: Column, i: Column) -> Column:
        path = F.concat(F.lit(f"{key}["), i.cast("string"), F.lit("]"))
        is_system = F.lower(_string(_get(m, "role"))).isin(*SYSTEM_ROLES)
        own = F.array(_part(F.concat(path, F.lit(".content")), _string(_get(m, "content")), is_system))
        return F.concat(own, _items(m, path, types, is_system))

    return F.flatten(F.transform(_list(body, key), one))


def _gemini(owner: Column, path: Column, is_system: bool) -> Column:
    def one(x: Column, j: Column) -> Column:
        return _part(F.concat(path, F.lit(".parts["), j.cast("string"), F.lit("].text")), _string(_get(x, "text")), F.lit(is_system))

    return F.transform(_list(owner, "parts"), one)


def _contents(body: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        return _gemini(c, F.concat(F.lit("contents["), i.cast("string"), F.lit("]")), False)

    return F.flatten(F.transform(_list(body, "contents"), one))


def parts_of(body: Column) -> Column:
    """The array of parts of a variant body: messages, input, contents, system instruction, in this order."""
    whole = F.array(_part(F.lit("input"), _string(_get(body, "input")), F.lit(False)))
    found = F.concat(
        _messages(body, "messages", CHAT_TYPES),
        whole,
        _messages(body, "input", INPUT_TYPES),
        _contents(body),
        _gemini(_get(body, "systemInstruction"), F.lit("systemInstruction"), True),
    )
    return F.filter(found, lambda p: p["text"].isNotNull())


def text_parts(requests: DataFrame, body: str = "body") -> DataFrame:
    """A row per text part: the columns of requests but the body, part_idx, path, text, is_system."""
    keep = [c for c in requests.columns if c != body]
    parsed = requests.select(*keep, F.try_parse_json(body).alias("_v"))
    return parsed.select(*keep, F.posexplode(parts_of(F.col("_v"))).alias("part_idx", "_p")).select(*keep, "part_idx", "_p.*")


def put_texts(root, new):
    """root with the texts of a map or of pairs (path, text) put in place."""
    for path, text in (new.items() if hasattr(new, "items") else new or ()):
        jsontext.put(root, path, text)
    return root


def patched(body: str, texts: str) -> Column:
    """The body with the texts of a map (path to text) put in place; all else stays as it is."""

    return jsontext.rewriting(put_texts, body, texts)


def write_back(requests: DataFrame, parts: DataFrame) -> DataFrame:
    """requests with the texts of parts (request_id, path, text) written into their bodies."""
    texts = parts.groupBy("request_id").agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("_texts"))
    joined = requests.join(texts, "request_id", "left")
    return joined.withColumn("body", F.when(F.col("_texts").isNull(), F.col("body")).otherwise(patched("body", "_texts"))).select(*requests.columns)
