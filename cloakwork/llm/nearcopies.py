"""Near copies by word shingles: pairs of texts whose sets of five-word shingles have a Jaccard of 0.8 or more.

Words are those of operator 4 (ASCII capitals lowered, split at ASCII white space). MinHash in BANDS bands
of ROWS finds candidates: a pair at Jaccard 0.8 shares no band with a chance of (1 - 0.8**4)**30, about
1e-7, and closer pairs with less. Candidates of a band's key are verified from the sets themselves, in two
steps. First all texts of a key against two of them (the first and the last in one of ORDERS orders): that is
linear, and as a rule unites a group of copies, however large. Then, of keys whose texts still stand in several
components, the texts outside the largest one against all, in pieces of at most PIECE_TEXTS texts and
PIECE_HASHES hashes, two pieces a task: so no link is left out by which pair was looked at first, and no task
holds a whole group.
Only links that connect are given on, never all pairs.

Cases: null and wordless texts take no part (operator 4 links them); fewer words than a shingle make one
shingle of all words; copies of one text are one node; ids and other columns are not looked at; texts of any
length are read whole; an empty table gives no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot, short_batches, small, spread
from .simhash import _roots, components, shingle_hashes

SHINGLE = 5
#: The least Jaccard as a fraction of whole numbers: compared without rounding.
LEAST = (4, 5)
BANDS, ROWS = 30, 4
ORDERS = 8
PIECE_TEXTS, PIECE_HASHES = 256, 1 << 18
#: A set that stands for a hot key is broadcast only up to so many hashes (HOT_KEYS of them: 80 MB).
HOT_HASHES = 50_000
_PIECE = 1 << 8
_FACTORS = np.random.default_rng(5).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, shingle, 0)]))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for every band, with the band's number in its hash; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), _PIECE):
        mixed = (hashes[at : at + _PIECE, None] ^ _FACTORS[0]) * _FACTORS[1]
        least = np.minimum(least, mixed.min(axis=0))
    keys = [xxhash.xxh64_intdigest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64)


def alike(sets: list[np.ndarray], least: tuple[int, int] = LEAST) -> np.ndarray:
    """For each set, the smallest index that it reaches over pairs of at least that Jaccard."""
    n, sizes = len(sets), np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    posted = owner[np.argsort(token, kind="stable")]  # the sets of each token, token after token
    counts = np.bincount(token)
    starts, ends = np.cumsum(counts) - counts, np.cumsum(sizes)
    up, down = least
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(n):
        mine = token[ends[i] - sizes[i] : ends[i]]
        many = counts[mine]
        at = np.repeat(starts[mine] - np.cumsum(many) + many, many) + np.arange(many.sum())
        shared = np.bincount(posted[at], minlength=n)
        j = np.nonzero((up + down) * shared >= up * (sizes[i] + sizes))[0]  # shared / (sizes - shared) >= up / down
        j = j[j > i]
        a.append(np.full(len(j), i))
        b.append(j)
    return _roots(n, np.concatenate(a), np.concatenate(b))


def _close(shared: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m hashes that share so many have the least Jaccard."""
    return F.lit(sum(LEAST)) * shared >= F.lit(LEAST[0]) * (n + m)


def keyed(docs: DataFrame) -> DataFrame:
    """node (xxhash64 of the text), keys (of its bands): a row a distinct text with words."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([bands(shingles(t)) for t in texts])

    short_batches(docs.sparkSession)
    found = docs.select(F.xxhash64("text").alias("node"), F.pandas_udf(run, "array<long>")("text").alias("keys"))
    return found.where(F.size("keys") > 0).groupBy("node").agg(F.first("keys").alias("keys"))


def sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n, s (its sorted hashes) for the texts that are among nodes."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingles(t).view(np.int64) for t in texts])

    texts = docs.select(F.xxhash64("text").alias("node"), "text").where("text is not null")
    texts = texts.join(small(cut(nodes)), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    return spread(texts, "node").select("node", F.pandas_udf(run, "array<long>")("text").alias("s")).withColumn("n", F.size("s"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs a, b (many with the same a) that are alike."""
    # sizes first: sets that differ too much in size can't be alike, and aren't moved
    size = {c: sets.select(F.col("node").alias(c), F.col("n").alias(f"m{c}")) for c in "ab"}
    sized = pairs.join(size["a"], "a").join(size["b"], "b")
    pairs = cut(sized.where(_close(F.least("ma", "mb"), F.col("ma"), F.col("mb"))).select("a", "b"))
    other = sets.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("n").alias("nb"))
    counts = pairs.groupBy("a").agg(F.count("*").alias("many"))
    first = sets.join(counts, F.col("node") == F.col("a")).select("a", F.col("s").alias("sa"), F.col("n").alias("na"), F.when(F.col("n") <= HOT_HASHES, F.col("many")).otherwise(0).alias("many"))
    both = join_hot(pairs.join(other, "b"), cut(first), "a", "many")
    return both.where(_close(F.size(F.array_intersect("sa", "sb")), F.col("na"), F.col("nb"))).select("a", "b")


def _rest(met: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that the keys in met hold beyond those found.

    Of a key whose texts stand in several components, those outside the largest one meet all: so a large
    group of copies that is united already costs no more than its size.
    """
    roots = components(found)
    stand = cut(met.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("part")))
    sums = (F.min("part") != F.max("part")).alias("open"), F.count("*").alias("many"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")
    # of up to three texts the two ends have met all; bands of the very same texts are looked at once
    left = stand.groupBy("key").agg(*sums).where("open and many > 3").groupBy("many", "mark").agg(F.min("key").alias("key"))
    rows = cut(join_hot(stand, cut(left.select("key", "many")), "key", "many").join(sets.select("node", "n"), "node").select("key", "node", "part", "n"))
    parts = rows.groupBy("key", "part").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    whole = parts.groupBy("key").agg(F.max(F.struct("c", "part", "n")).alias("main"), F.sum("c").alias("many"), F.sum("n").alias("n"))
    pieces = lambda c, n: F.greatest(F.ceil(c / PIECE_TEXTS), F.ceil(n / PIECE_HASHES)).cast("int")
    plan = whole.select("key", "many", F.col("main.part").alias("main"), pieces(F.col("many"), F.col("n")).alias("all"), pieces(F.col("many") - F.col("main.c"), F.col("n") - F.col("main.n")).alias("few"))
    rows = join_hot(rows.select("key", "node", "part"), cut(plan), "key", "many")
    mine = F.xxhash64("node", F.lit(7))
    every = rows.select("key", "node", F.pmod(mine, "all").alias("x"), F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("y"))
    others = rows.where("part <> main").select("key", "node", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("x"), F.pmod(mine, "few").alias("y"))
    rows = every.union(others).distinct().join(sets.select("node", "s"), "node")

    def linked(x: pd.DataFrame) -> pd.DataFrame:
        nodes = x["node"].to_numpy()
        root = alike([np.asarray(s, np.int64).view(np.uint64) for s in x["s"]])
        child = np.nonzero(root != np.arange(len(root)))[0]
        return pd.DataFrame({"a": nodes[root[child]], "b": nodes[child]})

    return rows.groupBy("key", "x", "y").applyInPandas(linked, "a long, b long").distinct()


def links(docs: DataFrame) -> DataFrame:
    """a, b: texts that are alike, by their nodes (xxhash64 of the text); all others follow over these."""
    each = cut(spread(keyed(docs))).select("node", F.explode("keys").alias("key"))
    # every key orders nodes by one of ORDERS ways: so the bands of a group measure it against many of its texts
    turn = F.xxhash64(F.pmod("key", F.lit(ORDERS)))
    turned = F.col("node").bitwiseXOR(turn)
    ends = cut(each.groupBy("key").agg(F.min(turned).alias("low"), F.max(turned).alias("high"), F.count("*").alias("many")).where("many > 1"))
    met = cut(join_hot(each, ends, "key", "many").select("key", "node", F.col("low").bitwiseXOR(turn).alias("low"), F.col("high").bitwiseXOR(turn).alias("high")))
    pairs = met.select(F.explode(F.array("low", "high")).alias("a"), F.col("node").alias("b")).where("a <> b").distinct()
    sets = cut(sets_of(docs, met.select("node").distinct()))
    found = cut(_verified(pairs, sets))
    return found.union(_rest(met, found, sets))
