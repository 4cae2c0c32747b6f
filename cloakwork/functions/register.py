"""The functions under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cloakwork.config import Rules

from . import kernel


def register(spark: SparkSession, rules: Rules = Rules()) -> None:
    """redact(text): the redacted text. text_parts(body): a table function of its parts."""
    import json

    import pandas as pd

    def redact(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else kernel.redact(t, rules)[0])

    redact.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    spark.udf.register("redact", F.pandas_udf(redact, "string"))

    class TextParts:
        def eval(self, body: str):
            try:
                root = json.loads(body or "")
            except ValueError:
                return
            for key, kinds in (("messages", {"text"}), ("input", {"input_text", "output_text", "text"})):
                given = root.get(key) if isinstance(root, dict) else None
                if key == "input" and isinstance(given, str):
                    yield "input", given, False
                for i, m in enumerate(given if isinstance(given, list) else ()):
                    if isinstance(m, dict):
                        is_system = str(m.get("role")).lower() in ("system", "developer")
                        content = m.get("content")
                        if isinstance(content, str):
                            yield f"{key}[{i}].content", content, is_system
                        for j, x in enumerate(content if isinstance(content, list) else ()):
                            if isinstance(x, dict) and str(x.get("type")).lower() in kinds and isinstance(x.get("text"), str):
                                yield f"{key}[{i}].content[{j}].text", x["text"], is_system
            contents = root.get("contents") if isinstance(root, dict) else None
            owners = [(f"contents[{i}]", c, False) for i, c in enumerate(contents if isinstance(contents, list) else ())]
            owners += [("systemInstruction", root.get("systemInstruction"), True)] if isinstance(root, dict) else []
            for path, owner, is_system in owners:
                parts = owner.get("parts") if isinstance(owner, dict) else None
                for j, x in enumerate(parts if isinstance(parts, list) else ()):
                    if isinstance(x, dict) and isinstance(x.get("text"), str):
                        yield f"{path}.parts[{j}].text", x["text"], is_system

    spark.udtf.register("text_parts", F.udtf(TextParts, returnType="path string, text string, is_system boolean"))
