"""The whole redaction of a text in one pass of Python, for the full pipeline.

A chain of eighteen native rules that also collects hits makes a plan that grows with every rule,
so the pipeline runs this kernel as one Arrow column; single rules are native (see native.py).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.config import Rules, SystemPolicy

from . import patterns as P

HIT = "struct<phase:string,label:string,original_value:string,redacted_value:string,count:int>"
RESULT = f"struct<content:string,hit_phases:array<string>,hits:array<{HIT}>>"

_TOKEN_SIGNS = frozenset("_-./+=")


def units(text: str) -> int:
    """Length in UTF-16 code units, in which limits are given."""
    return len(text) + sum(c > "￿" for c in text)


def _alnum(c: str) -> bool:
    return c.isalpha() or c.isdecimal()


def plausible(value: str, label: str) -> bool:
    """Whether what stands behind a keyword can be the secret that it names."""
    if not value.strip() or value[:9].lower() == "[redacted" or "\\n" in value or value.endswith("\\"):
        return False
    if not any(map(_alnum, value)):
        return False
    if label in ("TOKEN", "API_KEY", "PASSWORD") and any(c in P.NOISE or "一" <= c <= "鿿" for c in value):
        return False
    if label in ("TOKEN", "API_KEY") and not all(_alnum(c) or c in _TOKEN_SIGNS for c in value):
        return False
    return units(value) >= (6 if label in ("TOKEN", "API_KEY") else 4)


def mark(label: str) -> str:
    return f"[REDACTED:{label}]"


Rule = Callable[[str, str, list], str]


def matches_of(find: re.Pattern, run: str | None) -> Callable[[str], Iterator[re.Match]]:
    """All matches of a pattern; run: the signs that it begins with, whose first place alone is tried."""
    if run is None:
        return find.finditer
    first = re.compile(f"(?<!{run}){find.pattern}")

    def each(text: str) -> Iterator[re.Match]:
        m = first.search(text)
        while m:
            yield m
            m = find.match(text, m.end()) or first.search(text, m.end())

    return each


def _plain(label: str, pattern: str) -> Rule:
    find, put, needs = matches_of(P.python(pattern), P.RUNS.get(label)), mark(label), P.NEEDS.get(label)

    def run(text: str, phase: str, hits: list) -> str:
        if needs and not any(n in text for n in needs):
            return text
        out, at = [], 0
        for m in find(text):
            out += [text[at : m.start()], put]
            hits.append((phase, label, m[0], put, 1))
            at = m.end()
        return "".join(out) + text[at:] if out else text

    return run


def _context(label: str, pattern: str) -> Rule:
    find, put = P.python(pattern), mark(label)

    def run(text: str, phase: str, hits: list) -> str:
        def swap(m: re.Match) -> str:
            value = m[2].rstrip(P.TAIL)
            if not plausible(value, label):
                return m[0]
            hits.append((phase, label, value, put, 1))
            return f"{m[1]} {put}{m[2][len(value):]}"

        return find.sub(swap, text)

    return run


def _keyword(word: str, label: str, strict: bool) -> Rule:
    find, put = P.python(P.keyword(word, strict)), mark(label)

    def run(text: str, phase: str, hits: list) -> str:
        if word not in text:
            return text

        def swap(m: re.Match) -> str:
            if not m[3] or not plausible(m[3], label):
                return m[0]
            hits.append((phase, label, m[3], put, 1))
            return m[1] + m[2] + put

        return find.sub(swap, text)

    return run


@lru_cache(maxsize=64)
def phases(rules: Rules) -> dict[str, list[Rule]]:
    return {
        "phase1": [_plain(label, p) for label, p in P.PHASE1],
        "phase2": [_plain(label, p) for label, switch, p in P.PHASE2 if getattr(rules, switch)],
        "phase3": [_context(label, p) for label, p in P.CONTEXT] + [_keyword(*k) for k in P.KEYWORDS],
    }


def redact(text: str, rules: Rules = Rules(), run: tuple[str, ...] = ("phase1", "phase2", "phase3")) -> tuple[str, list[str], list[tuple]]:
    """Content, the phases that changed it, and the hits, in order."""
    hits: list[tuple] = []
    changed = []
    for phase, steps in phases(rules).items():
        if phase not in run:
            continue
        before = text
        if phase == "phase3":
            # between fences stands code, which context rules leave alone; each piece stands for itself
            pieces = text.split(P.FENCE)
            for i in range(0, len(pieces), 2):
                for step in steps:
                    pieces[i] = step(pieces[i], phase, hits)
            text = P.FENCE.join(pieces)
        else:
            for step in steps:
                text = step(text, phase, hits)
        if text != before:
            changed.append(phase)
    return text, changed, hits


def system_phases(policy: SystemPolicy) -> tuple[str, ...]:
    return tuple(p for p in ("phase1", "phase2", "phase3") if getattr(policy, p))


def redacted(text: str, rules: Rules = Rules(), system: SystemPolicy | None = None, is_system: str | None = None) -> Column:
    """The result struct of a text column; rows whose is_system column is true follow the policy.

    Null and blank texts are given back as they are, without hits.
    """
    own = system_phases(system) if system else None

    def one(text: str | None, is_sys: bool) -> dict:
        if text is None or not text.strip():
            return {"content": text, "hit_phases": [], "hits": []}
        content, changed, hits = redact(text, rules, own) if is_sys and own is not None else redact(text, rules)
        return {"content": content, "hit_phases": changed, "hits": [dict(zip(("phase", "label", "original_value", "redacted_value", "count"), h)) for h in hits]}

    if is_system is None:

        def plain(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                yield pd.DataFrame([one(t, False) for t in texts], columns=["content", "hit_phases", "hits"])

        return F.pandas_udf(plain, RESULT)(text)

    def split(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, flags in batches:
            yield pd.DataFrame([one(t, bool(s)) for t, s in zip(texts, flags)], columns=["content", "hit_phases", "hits"])

    return F.pandas_udf(split, RESULT)(text, is_system)
