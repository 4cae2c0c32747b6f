"""Benchmark decontamination: find documents that hold passages of benchmark items.

The hashes of the normalised test n-grams are broadcast, at most BLOCK of them at once (a larger set goes in
several blocks, each with its own scan), and every window of the documents meets them in a hash join inside
the scan: windows are never shuffled, and only those that hit go on. A hash hit counts only if the window's
text is in the set too. Everything is DataFrame functions.

Rows are told apart by their id and a hash of their text, so that a partition that is made again after an
executor is lost gives the same rows; clean documents take no part in anything after the scan.

Cases: a null or wordless text has no words and no hits; an item without words takes no part;
items shorter than a window are one window of their own length; repeated rows each get their
own result; texts of any length are read whole; empty tables give empty (documents) or all-clean
(benchmark) results; columns besides doc_id, text / item_id, text are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, lower_ascii, small

WINDOW = 10
#: So many hashes are broadcast at once (a hash table of about 100 MB).
BLOCK = 4_000_000
#: The windows' texts are broadcast up to so many (about 20 MB); beyond, they are joined.
TEXTS = 100_000
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BREAKS, -1), "")


def _joined(left: Column, right: Column, skip: int) -> Column:
    """left[i] combined with right[i + skip], for as many i as there are."""
    n = F.greatest(F.size(right) - skip, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, 1 + skip, n), lambda a, b: F.xxhash64(a, b))


def with_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds g{n} for every n in lengths: the hashes of all runs of n words of the column w.

    Runs double: g2 combines neighbours of g1, g4 those of g2; other lengths add up powers of
    two. So a window costs a few steps however long it is.
    """
    df = df.withColumn("g1", F.transform("w", lambda x: F.xxhash64(x)))
    power = 1
    while 2 * power <= max(lengths, default=1):
        df = df.withColumn(f"g{2 * power}", _joined(F.col(f"g{power}"), F.col(f"g{power}"), power))
        power *= 2
    for n in lengths:
        if n & (n - 1):
            top = 1 << (n.bit_length() - 1)
            at, col = top, F.col(f"g{top}")
            for bit in reversed(range(n.bit_length() - 1)):
                if n >> bit & 1:
                    col, at = _joined(col, F.col(f"g{1 << bit}"), at), at + (1 << bit)
            df = df.withColumn(f"g{n}", col)
    return df


def windows_of(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows of the items: item_id, n (its words), gram."""
    words = benchmark.select("item_id", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    n = F.least(F.size("w"), F.lit(window))
    grams = words.withColumn("n", n).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    return grams.select("item_id", "n", F.array_join(F.slice("w", F.col("at"), F.col("n")), " ").alias("gram")).distinct()


def _window_hashes(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """windows (n, gram, items) with h: the hash that with_hashes gives the same words."""
    hashed = with_hashes(windows.withColumn("w", F.split("gram", " ", -1)), lengths)
    pick = reduce(lambda rest, n: F.when(F.col("n") == n, F.col(f"g{n}")[0]).otherwise(rest), lengths, F.lit(None).cast("long"))
    return hashed.select("n", "gram", "items", pick.alias("h"))


def _covered(spans: Column) -> Column:
    """How many words lie inside any of the spans (sorted structs of at, n)."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc, x):
        end = x["at"] + x["n"]
        gain = F.greatest(end - F.greatest(acc["end"], x["at"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + gain).alias("n"))

    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """doc_id, key (a hash of the text), at, n, items: every window of n words, from word at, that is in the set.

    items: the ids, as strings, of the items that hold the window. Written to the shared folder.
    """
    spark = docs.sparkSession
    windows = windows_of(benchmark, window).groupBy("n", "gram").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())  # at most `window` rows
    if not lengths:
        kind = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, key long, at int, n int, items array<string>")
    windows = cut(_window_hashes(windows, lengths))
    rounds = max(1, -(-windows.count() // block))
    found = cut(_met(docs, windows.select(F.col("h").alias("_h")).distinct(), lengths, rounds))
    known = windows.select(F.struct("n", "h", "gram").alias("x"), "items")
    rows = found.select("doc_id", "key", "at", F.struct("n", "h", "gram").alias("x"))
    if rounds == 1 and windows.count() <= TEXTS:
        sure = rows.join(F.broadcast(known), "x")
    else:
        counts = rows.groupBy("x").agg(F.count("*").alias("many"))
        sure = join_hot(rows, cut(known.join(counts, "x")), "x", "many")
    return cut(sure.select("doc_id", "key", "at", F.col("x.n").alias("n"), "items"))


def _met(docs: DataFrame, hashes: DataFrame, lengths: list[int], rounds: int) -> DataFrame:
    """doc_id, key, at, n, h, gram: the windows of docs whose hash is among hashes (_h)."""
    words = with_hashes(docs.select("doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("w")), lengths)
    # runs of all lengths in one list; a place in the list says which run it is
    every = F.concat(*(F.col(f"g{n}") for n in lengths))
    places = words.select("doc_id", "key", "w", F.posexplode(every).alias("p", "h"))
    blocks = [hashes.where(F.pmod("_h", F.lit(rounds)) == r) for r in range(rounds)] if rounds > 1 else [hashes]
    found = reduce(DataFrame.union, [places.join(F.broadcast(b), places["h"] == F.col("_h"), "left_semi") for b in blocks])
    at, n, before = F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0)
    for length in lengths:
        own = F.greatest(F.size("w") - length + 1, F.lit(0))
        inside = F.col("p").between(before, before + own - 1)
        at, n = F.when(inside, F.col("p") - before).otherwise(at), F.when(inside, F.lit(length)).otherwise(n)
        before = before + own
    found = found.select("doc_id", "key", "h", at.alias("at"), n.alias("n"), "w")
    return found.select("doc_id", "key", "at", "n", "h", F.expr("array_join(slice(w, at + 1, n), ' ')").alias("gram"))


def _spans(found: DataFrame) -> DataFrame:
    """_id, _key, n_hit, spans, items of every row that hits."""
    one = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("spans"), F.collect_set("items").alias("items"))
    items = F.array_sort(F.array_distinct(F.flatten("items")))
    return one.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), _covered(F.col("spans")).alias("n_hit"), "spans", items.alias("items"))


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select("doc_id", "text")
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    joined = rows.join(_spans(hits(docs, benchmark, window, block)), _same(), "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce(F.size("items").cast("long"), zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """docs without the documents that hold a benchmark window. No text is moved while few ids have to go."""
    found = hits(docs.select("doc_id", "text"), benchmark, window, block)
    gone = small(cut(found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct()))
    return _packed(docs).join(gone, _same(), "left_anti").select("row.*")


def _packed(docs: DataFrame) -> DataFrame:
    """The row rides along whole, so that no name of its columns can clash."""
    return docs.select(F.struct("*").alias("row"), "doc_id", "text", F.xxhash64("text").alias("key"))


def without_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """Every document; the words of benchmark windows are taken out of the text of those that hold
    some, which is then the remaining normalised words, joined by one space."""
    spans = _spans(hits(docs.select("doc_id", "text"), benchmark, window, block))
    found = _packed(docs).join(spans.select("_id", "_key", "spans"), _same(), "left")
    rest = F.filter(words_of(F.col("text")), lambda _, i: ~F.exists("spans", lambda s: (i >= s["at"]) & (i < s["at"] + s["n"])))
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(rest, " "))
    return found.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
