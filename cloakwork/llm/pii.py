"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base entities (email, ip, card, phone) and seed keys are found by their form. The words and
signs before them are lexical patterns; tokens with digits are the instances that patterns
point at. Over the graph of patterns and distinct instances, scores go back and forth: a pattern
is as good as its instances, an instance as good as its best pattern. Patterns that end up
confident mark the unseen tokens behind them as personal data too.

Spans count code points, end exclusive. Base spans are never changed by the method; a token that
overlaps one is no instance.

Cases: a null or empty text has no spans; a null doc_id keeps its row; repeated rows each get
their own result and copies of one text don't make a pattern more confident (instances are
distinct); of kinds with equal scores the first listed counts; identifiers are tokens of TOKEN_LEAST signs
or more with a digit among them: shorter ones and words are never discovered by context alone; texts of any
length are read whole; a table without seeds yields base spans only; empty tables give empty results;
columns besides doc_id and text are ignored or kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Kinds in the order in which spans of equal start are listed; the last is what the method adds.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]

# The base patterns. They are the contract's, with possessive repeats where what
# follows can't match inside the repeat, and with the start held to the first place that can
# match: the same matches, in time linear in the text and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Forms of keys that serve as seeds (a public key-id format, long hexadecimal keys).
SEED_KEYS = r"^(?:AKIA[0-9A-Z]{16}|(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,})$"
_TOKEN = r"(?<![A-Za-z0-9_/+.-])(?=[A-Za-z_/+.-]*+[0-9])[A-Za-z0-9_/+.-]++"
_EDGE = r"[_/+.-]+"
TOKEN_LEAST, LEFT = 6, 48
#: The method's constants: rounds over the graph; the least score at which a pattern speaks for its instances;
#: the least at which it marks unseen ones; the least number of distinct instances of a pattern; and so many
#: instances of no kind are added to each, so that a few chance ones don't make a pattern confident.
ROUNDS, GATE, CONFIDENT, SUPPORT, DOUBT = 4, 0.4, 0.7, 5, 2
#: Up to so many confident patterns ride in the plan; more are joined.
INLINE_PATTERNS = 10_000

_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of a digit string is a multiple of ten."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + value(i)) % 10 == 0


def _sound(kind: str, x: Column) -> Column:
    """Whether a match is one of its kind."""
    n = F.length(_digits(x))
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda part: F.coalesce(part.try_cast("long"), F.lit(256)) <= 255)
    if kind == "card":
        return F.when(n.between(12, 19), _luhn(_digits(x))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _guard(kind: str) -> Column:
    """A cheap test that every text with a sound match passes."""
    t = F.col("_t")
    if kind in ("email", "phone"):
        return t.contains("@" if kind == "email" else "+")
    return F.col("_d") & t.rlike(r"[0-9]\.[0-9]++\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){11}")


def _places(gaps: Column, matches: Column) -> Column:
    """start, end, text of every match, from the pieces between matches."""
    zero = F.struct(F.lit(0).alias("at"), _none("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("text")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(matches)), matches, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def _found(df: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Adds _{name}: the places of the pattern's matches."""
    lit = F.lit(pattern)
    df = df.withColumn(f"_m_{name}", F.when(guard, F.regexp_extract_all("_t", lit, F.lit(0))).otherwise(_none("array<string>")))
    matches = F.col(f"_m_{name}")
    none = _none("array<struct<start:int,end:int,text:string>>")
    return df.withColumn(f"_{name}", F.when(F.size(matches) > 0, _places(F.split("_t", pattern, -1), matches)).otherwise(none)).drop(f"_m_{name}")


def scan(docs: DataFrame) -> DataFrame:
    """docs with _base (sorted spans) and _tokens: the instances with the patterns before them.

    A token has start, end, inst (hash of its text), rank (of its kind if known, else -1) and
    patterns. Base entities are among the tokens, as seeds.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    df = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_t"))
    df = df.withColumn("_d", F.col("_t").rlike("[0-9]"))
    for kind in BASE:
        df = _found(df, kind, PATTERNS[kind], _guard(kind))
    df = _found(df, "token", _TOKEN, F.col("_d"))
    for rank, kind in enumerate(BASE):
        sound = F.filter(f"_{kind}", _of_kind(kind))
        df = df.withColumn(f"_{kind}", F.transform(sound, _as_seed(rank)))
    base = F.concat(*(F.col(f"_{k}") for k in BASE))
    df = df.withColumn("_seeds", base)
    df = df.withColumn("_token", F.filter(F.transform("_token", _trimmed), lambda x: F.length(x["text"]) >= TOKEN_LEAST))
    free = F.filter("_token", lambda x: ~F.exists("_seeds", lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"])))
    free = F.transform(free, lambda x: F.struct(x["start"].alias("start"), F.when(x["text"].rlike(SEED_KEYS), 4).otherwise(-1).alias("rank"), x["end"].alias("end"), x["text"].alias("text")))
    df = df.withColumn("_all", F.concat("_seeds", free))
    spans = F.array_sort(F.transform("_seeds", _bare))
    return df.select(*keep, spans.alias("_base"), F.transform("_all", _with_patterns).alias("_tokens"))


def _of_kind(kind: str):
    return lambda x: _sound(kind, x["text"])


def _as_seed(rank: int):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), x["text"].alias("text"))


def _bare(x: Column) -> Column:
    return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))


def _trimmed(x: Column) -> Column:
    head = F.length(F.regexp_extract(x["text"], "^" + _EDGE, 0))
    body = F.regexp_replace(x["text"], f"^{_EDGE}|{_EDGE}$", "")
    start = x["start"] + head
    return F.struct(start.alias("start"), (start + F.length(body)).alias("end"), body.alias("text"))


def _with_patterns(x: Column) -> Column:
    at = F.greatest(x["start"] - LEFT, F.lit(0))
    left = F.lower(F.substring(F.col("_t"), at + 1, x["start"] - at))
    sign = F.regexp_replace(F.regexp_replace(F.regexp_extract(left, r"([^\p{L}_]{0,6})$", 1), r"[\s\"']", ""), "[0-9]+", "0")
    word = F.regexp_extract(left, r"([\p{L}_]+)[^\p{L}_]{0,6}$", 1)
    before = F.regexp_extract(left, r"([\p{L}_]+)[^\p{L}_]+[\p{L}_]+[^\p{L}_]{0,6}$", 1)
    patterns = F.array(
        F.when(word != "", F.concat(F.lit("1 "), word, F.lit(" "), sign)),
        F.when(before != "", F.concat(F.lit("2 "), before, F.lit(" "), word, F.lit(" "), sign)),
        F.when(sign.rlike("[=:]"), F.concat(F.lit("0 "), sign)),
    )
    inst = F.xxhash64(x["text"])
    return F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), inst.alias("inst"), F.array_compact(patterns).alias("patterns"))


# ---------------------------------------------------------------- bootstrapping
def patterns_of(scanned: DataFrame) -> DataFrame:
    """pattern, rank: the patterns that are confident of a kind after the rounds."""
    tokens = scanned.select(F.explode("_tokens").alias("x")).select("x.inst", "x.rank", F.explode("x.patterns").alias("pattern"))
    graph = tokens.groupBy("pattern", "inst").agg(F.max("rank").alias("rank"))
    k = range(len(KINDS))
    known = graph.groupBy("pattern").agg(F.count("*").alias("n"), *(F.sum((F.col("rank") == i).cast("double")).alias(f"n{i}") for i in k))
    # a pattern that has too few distinct instances can't get confident, whatever they score
    known = cut(known.where(F.col("n") >= SUPPORT))
    open_ = cut(graph.where("rank = -1").join(known.select("pattern"), "pattern", "left_semi").select("pattern", "inst"))
    scored = known.select("pattern", "n", *(F.col(f"n{i}") for i in k), *((F.col(f"n{i}") / (F.col("n") + DOUBT)).alias(f"c{i}") for i in k))
    for _ in range(ROUNDS):
        gated = [F.when(F.col(f"c{i}") >= GATE, F.col(f"c{i}")).otherwise(0.0).alias(f"s{i}") for i in k]
        inst = open_.join(scored.select("pattern", *gated), "pattern").groupBy("inst").agg(*(F.max(f"s{i}").alias(f"s{i}") for i in k))
        added = open_.join(inst, "inst").groupBy("pattern").agg(*(F.sum(f"s{i}").alias(f"a{i}") for i in k))
        joined = known.join(added, "pattern", "left")
        scored = cut(joined.select("pattern", "n", *(F.col(f"n{i}") for i in k), *(((F.col(f"n{i}") + F.coalesce(f"a{i}", F.lit(0.0))) / (F.col("n") + DOUBT)).alias(f"c{i}") for i in k)))
    best = F.greatest(*(F.col(f"c{i}") for i in k))
    rank = F.coalesce(*(F.when(F.col(f"c{i}") == best, i) for i in k))
    return scored.where(best >= CONFIDENT).select("pattern", rank.alias("rank"))


def with_spans(scanned: DataFrame, confident: DataFrame, inline: int = INLINE_PATTERNS) -> DataFrame:
    """scanned with _spans: base spans, seed keys, and tokens behind confident patterns, sorted."""
    rows = confident.limit(inline + 1).collect()
    seeds = F.transform(F.filter("_tokens", lambda x: x["rank"] >= 0), _bare)
    if len(rows) <= inline:
        found = [seeds]
        for rank in range(len(KINDS)):
            own = [r["pattern"] for r in rows if r["rank"] == rank]
            if own:
                found.append(_behind(own, rank, [r["pattern"] for r in rows if r["rank"] < rank]))
        return scanned.withColumn("_spans", F.array_sort(F.concat(*found)))
    # rows meet their spans by what the spans follow from; ids of rows might change when a lost
    # partition is made again
    scanned = scanned.withColumn("_row", F.xxhash64(F.to_json("_tokens")))
    unseen = scanned.select("_row", F.explode_outer("_tokens").alias("x")).where("x.rank = -1")
    hit = unseen.select("_row", "x.start", "x.end", F.explode("x.patterns").alias("pattern")).join(confident, "pattern")
    spans = hit.groupBy("_row", "start", "end").agg(F.min("rank").alias("rank")).groupBy("_row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("_more"))
    joined = scanned.join(spans, "_row", "left").drop("_row")
    return joined.withColumn("_spans", F.array_sort(F.concat(seeds, F.coalesce("_more", _none(_SPAN))))).drop("_more")


def _behind(patterns: list[str], rank: int, earlier: list[str]) -> Column:
    """The unseen tokens behind one of the patterns and behind none of an earlier kind."""

    def fits(x: Column) -> Column:
        hit = (x["rank"] == -1) & F.exists(x["patterns"], lambda p: p.isin(patterns))
        return hit & ~F.exists(x["patterns"], lambda p: p.isin(earlier)) if earlier else hit

    return F.transform(F.filter("_tokens", fits), lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end")))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row."""
    scanned = cut(scan(docs.select("doc_id", "text")).select("doc_id", "_base", "_tokens"))
    found = with_spans(scanned, patterns_of(scanned))
    counts = [F.size(F.filter("_base", _is(rank))).cast("long").alias(f"n_{kind}") for rank, kind in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("_base")), 256).alias("base_sha256"), _listed(F.col("_spans")).alias("spans"))


def _is(rank: int):
    return lambda s: s["rank"] == rank


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; n_chars, if there, follows.

    Texts are scanned twice, once for the patterns and once to rewrite, and are never shuffled.
    """
    learnt = cut(scan(docs.select("text")).select("_tokens"))
    confident = cut(patterns_of(learnt))
    # the row rides along whole, so that no name of its columns can clash with the scan's
    found = with_spans(scan(docs.select(F.struct("*").alias("row"), "text")), confident)
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col("text")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], gap, names[s["rank"]])).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate("_spans", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))
    hit = F.size("_spans") > 0
    found = found.withColumn("clean", F.when(hit, clean).otherwise(text))
    changed = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
