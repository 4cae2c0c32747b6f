"""JSON bodies as text: reading without surprises, writing in order, changing by path."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _no(token: str):
    raise ValueError(token)


def load(body: str):
    """The value of strict JSON; ValueError for anything else."""
    return json.loads(body, parse_constant=_no)


def dump(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def steps(path: str) -> list[str | int]:
    """`messages[0].content[2].text` as its keys and positions."""
    return [int(i) if i else k for k, i in re.findall(r"([^.\[\]]+)|\[(\d+)\]", path)]


def put(root, path: str, text: str) -> None:
    *way, last = steps(path)
    for step in way:
        root = root[step]
    root[last] = text


def rewriting(change: Callable, *columns: Column | str) -> Column:
    """A column of bodies rewritten by change(value, *others). Bodies that are null or no JSON, and
    those that change refuses with ValueError, give null."""

    def one(body, *others):
        if body is None:
            return None
        try:
            return dump(change(load(body), *others))
        except (ValueError, RecursionError):
            return None

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            yield pd.Series([one(*row) for row in zip(*series)], dtype=object)

    def alone(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for bodies in batches:
            yield pd.Series([one(b) for b in bodies], dtype=object)

    return F.pandas_udf(run if len(columns) > 1 else alone, "string")(*columns)
