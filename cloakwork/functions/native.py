"""Single rules and helpers as expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloakwork.config import Config, Rules, SystemPolicy

from . import patterns as P

_PHASE1 = dict(P.PHASE1)
_PHASE2 = {label: p for label, _, p in P.PHASE2}
BEARER = P.CONTEXT[5][1]
_CONTEXT = {label: p for label, p in P.CONTEXT[:5]}


def mark(label: str) -> str:
    return f"[REDACTED:{label}]"


def pattern(label: str) -> str:
    """The Java pattern of a rule of the first two phases. CARD is the second phase's."""
    return P.java(_PHASE1.get(label) or _PHASE2[label], P.RUNS.get(label))


def bound(text: Column, work) -> Column:
    """work(text), with the text bound to a name: a chain of rules grows by each rule's own size only."""
    return F.transform(F.array(text), work)[0]


def _guarded(text: Column, label: str, work, otherwise) -> Column:
    """work(text) where the rule can match at all."""
    needs = P.NEEDS.get(label)
    if not needs:
        return work(text)

    def run(x: Column) -> Column:
        can = x.contains(needs[0])
        for other in needs[1:]:
            can |= x.contains(other)
        return F.when(can, work(x)).otherwise(otherwise(x))

    return bound(text, run)


def replace(text: Column, label: str) -> Column:
    return _guarded(text, label, lambda x: F.regexp_replace(x, F.lit(pattern(label)), F.lit(mark(label))), lambda x: x)


def found(text: Column, label: str) -> Column:
    """Every match of a rule of the first two phases."""
    none = F.expr("cast(array() as array<string>)")
    return _guarded(text, label, lambda x: F.regexp_extract_all(x, F.lit(pattern(label)), F.lit(0)), lambda x: F.when(x.isNotNull(), none))


def matches(text: Column, label: str) -> Column:
    """Whether a rule of the first two phases matches anywhere."""
    return _guarded(text, label, lambda x: x.rlike(pattern(label)), lambda x: F.when(x.isNotNull(), False))


def phase1(text: Column) -> Column:
    for label, _ in P.PHASE1:
        text = replace(text, label)
    return text


def phase2(text: Column, rules: Rules = Rules()) -> Column:
    for label, switch, _ in P.PHASE2:
        if getattr(rules, switch):
            text = replace(text, label)
    return text


def units(text: Column) -> Column:
    """Length in UTF-16 code units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def plausible(value: Column, label: str) -> Column:
    """Whether what stands behind a keyword can be the secret that it names."""
    ok = (F.trim(value) != "") & ~F.lower(value).startswith("[redacted") & ~value.contains("\\n") & ~value.endswith("\\") & value.rlike(r"[\p{L}\p{Nd}]")
    if label in ("TOKEN", "API_KEY", "PASSWORD"):
        ok &= ~value.rlike(f"[{P.NOISE}一-鿿]")
    if label in ("TOKEN", "API_KEY"):
        ok &= value.rlike(r"^[\p{L}\p{Nd}_./+=-]*$")
    return ok & (units(value) >= (6 if label in ("TOKEN", "API_KEY") else 4))


def _woven(text: Column, pattern_: str, groups: int, swap) -> Column:
    """Every match replaced by swap(groups); text between matches is kept.

    A match that swap leaves as it is stays consumed, which a plain replacement can't do. Texts
    without a match are passed by a cheap test.
    """
    lit = F.lit(pattern_)
    every = [F.regexp_extract_all(text, lit, F.lit(i)) for i in range(groups + 1)]
    gaps = F.split(text, pattern_, -1)
    put = F.transform(F.arrays_zip(*(e.alias(f"g{i}") for i, e in enumerate(every))), swap)
    pairs = F.zip_with(gaps, F.concat(put, F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    return F.when(text.rlike(pattern_), F.array_join(pairs, "")).otherwise(text)


def context(text: Column, label: str, bearer: bool = False) -> Column:
    """A keyword rule of the third phase."""
    ending = "[" + "".join("\\" + c for c in P.TAIL) + "]*$"

    def swap(x: Column) -> Column:
        value = F.regexp_replace(x["g2"], ending, "")
        tail = F.substring(x["g2"], F.length(value) + 1, F.length(x["g2"]))
        return F.when(plausible(value, label), F.concat(x["g1"], F.lit(f" {mark(label)}"), tail)).otherwise(x["g0"])

    return _woven(text, P.java(BEARER if bearer else _CONTEXT[label]), 2, swap)


def keyword(text: Column, word: str) -> Column:
    """A Chinese keyword rule of the third phase."""
    label, strict = next((l, s) for w, l, s in P.KEYWORDS if w == word)

    def swap(x: Column) -> Column:
        return F.when((x["g3"] != "") & plausible(x["g3"], label), F.concat(x["g1"], x["g2"], F.lit(mark(label)))).otherwise(x["g0"])

    return _woven(text, P.java(P.keyword(word, strict)), 3, swap)


def outside_fences(text: Column, rule) -> Column:
    """rule applied to every piece outside code fences."""
    pieces = F.split(text, P.FENCE, -1)
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 0, rule(x)).otherwise(x)), P.FENCE)


def phase3(text: Column) -> Column:
    """The context and keyword rules, outside code fences; texts without any of their words are passed."""
    def of_context(label: str, bearer: bool = False):
        return lambda x: context(x, label, bearer)

    def of_keyword(word: str):
        return lambda x: F.when(x.contains(word), keyword(x, word)).otherwise(x)

    rules = [*map(of_context, _CONTEXT), of_context("TOKEN", True), *(of_keyword(word) for word, _, _ in P.KEYWORDS)]

    def every(piece: Column) -> Column:
        for rule in rules:
            piece = bound(piece, rule)
        return piece

    can = "(?i)" + "|".join((*P.CONTEXT_WORDS, *(w for w, _, _ in P.KEYWORDS)))
    return bound(text, lambda x: F.when(x.rlike(can), outside_fences(x, every)).otherwise(x))


def redact(text: Column, rules: Rules = Rules(), phases: tuple[str, ...] = ("phase1", "phase2", "phase3")) -> Column:
    """The redacted text, all in the JVM. Without hits: those come from the kernel."""
    if "phase1" in phases:
        text = phase1(text)
    if "phase2" in phases:
        text = phase2(text, rules)
    return phase3(text) if "phase3" in phases else text


def any_hit(text: Column, rules: Rules = Rules()) -> Column:
    """Whether any rule of the three phases changes the text."""
    return bound(text, lambda x: redact(x, rules) != x)


def redact_as(text: Column, is_system: Column, policy: SystemPolicy = SystemPolicy(), rules: Rules = Rules()) -> Column:
    """The redacted text; of system text the phases that the policy has on."""
    own = tuple(p for p in ("phase1", "phase2", "phase3") if getattr(policy, p))
    return bound(text, lambda x: F.when(is_system, redact(x, rules, own)).otherwise(redact(x, rules)))


def contains_ci(text: Column, word: str) -> Column:
    """A keyword in a text, whatever the case. Small letters, not capitals: ß must not become SS."""
    return F.lit(False) if not word.strip() else F.lower(text).contains(word.lower())


def first_keyword(text: Column, words: Iterable[str]) -> Column:
    """The first of the words, in their order, that the text contains, whatever the case."""
    words = [w for w in words if w.strip()]

    def first(low: Column) -> Column:
        return F.coalesce(F.lit(None).cast("string"), *(F.when(low.contains(w.lower()), F.lit(w)) for w in words))

    # bound to a name, the small letters are made once and not for every word
    return F.transform(F.array(F.lower(text)), first)[0]


def blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def any_rule_hits(text: Column, rules: Rules = Rules()) -> Column:
    """Whether the full redaction would change the text, for texts without keyword contexts: phases 1 and 2."""
    labels = [label for label, _ in P.PHASE1] + [label for label, switch, _ in P.PHASE2 if getattr(rules, switch)]
    out = F.lit(False)
    for label in labels:
        out |= matches(text, label)
    return out


def system_or_user(text: Column, is_system: Column, policy: SystemPolicy = SystemPolicy(), rules: Rules = Rules()) -> Column:
    """Phases 1 and 2 natively, for system text as far as the policy has them on."""
    own = text
    if policy.phase1:
        own = phase1(own)
    if policy.phase2:
        own = phase2(own, rules)
    return F.when(is_system, own).otherwise(phase2(phase1(text), rules))


def cache_key(text: Column, fingerprint: str) -> Column:
    return F.upper(F.sha2(F.concat(F.lit(fingerprint + "\n"), text), 256))


# Which label a type of the model's answer gets.
TYPE_LABELS = {
    "NAME": "NAME", "SENDER_NAME": "NAME", "RECIPIENT_NAME": "NAME",
    "PHONE": "PHONE", "MOBILE": "PHONE", "LANDLINE": "PHONE",
    "ADDRESS": "ADDRESS",
    "PASSWORD": "SECRET", "API_KEY": "SECRET", "TOKEN": "SECRET", "SECRET": "SECRET",
    "ID": "ID", "ID_CARD": "ID", "ID_NUMBER": "ID",
    "CARD": "CARD", "BANK_CARD": "CARD", "CARD_NUMBER": "CARD",
    "ACCESS_CODE": "DELIVERY", "DELIVERY": "DELIVERY", "COURIER_NUMBER": "DELIVERY",
    "EMAIL": "EMAIL", "IP": "IP",
    "LICENSE_PLATE": "LICENSE", "PLATE": "LICENSE",
    "SALARY": "AMOUNT", "AMOUNT": "AMOUNT",
}


def type_label(kind: Column) -> Column:
    """The label of a type: by the table, else the type itself in ASCII capitals' own letters."""
    upper = F.upper(F.trim(kind))
    known = F.create_map(*(F.lit(x) for pair in TYPE_LABELS.items() for x in pair))
    own = F.regexp_replace(upper, "[^A-Za-z0-9_]", "")
    return F.coalesce(known[upper], F.when(own == "", F.lit("UNKNOWN")).otherwise(own))


def local_time(ts: Column) -> Column:
    """The fixed +08:00 wall clock of the audit log. The session's time zone must be UTC."""
    return F.from_utc_timestamp(ts, "+08:00")


def default_config() -> Config:
    return Config()
