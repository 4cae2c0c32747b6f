"""SimHash near-dedup by the generalised pigeonhole principle.

A text's fingerprint has 64 bits: a bit is set if it is set in over half of the XXH64 hashes of
its word shingles. Documents whose fingerprints differ in at most `distance` bits are linked.

Search. The 64 bits are grouped into partitions of correlated bits (so that bits which tend to
be equal together share one partition and spoil only that one), and every partition i gets a
threshold t[i] with sum(t) = distance - partitions + 1; then any linked pair differs by at most
t[i] bits in some partition i (-1: the partition is not probed). Dynamic programming picks the
thresholds with the least estimated candidate count, from counts over all fingerprints. A key
of a probe is the partition's value with t[i] of its bits blanked; fingerprints with a common key are
candidates. The principle is applied again to the bits that a key leaves free until these are
at most FREE_BITS: so no key, however frequent, gathers more than 2**FREE_BITS distinct
fingerprints, and none is capped. Within a key, linked fingerprints are united and only a
spanning forest is given on: the output is linear in the input, never all pairs.

Connected components come from alternating large and small stars over distinct fingerprints;
copies of one text are one fingerprint throughout.

Cases: null or wordless texts have fingerprint zero and are linked like any other; fewer words
than a shingle make one shingle of all words; a null doc_id keeps its row, and is never the
smallest id unless all ids of its component are null; repeated rows stay, and an id that several
texts have stands in each of their components; texts of any length are read whole, in pieces of
bounded memory; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, cut, join_hot, short_batches, small, spread

BITS, SEED = 64, 42
DISTANCE = 2
#: A key leaves at most so many bits free: at most 2**22 distinct fingerprints (32 MB) share it.
FREE_BITS = 22
#: Up to this many fingerprints of a key are compared with each other directly.
DIRECT = 2048


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(text: str | None, shingle: int, seed: int = SEED, piece: int = 1 << 16) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles, repeats included, in pieces; of fewer words, that of them all."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and ASCII white space
    digest, line = xxhash.xxh64_intdigest, b" ".join(words)
    if not words:
        return
    if len(words) < shingle:
        yield np.array([digest(line, seed)], np.uint64)
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[: len(words) - shingle + 1].tolist()
    stops = ends[shingle - 1 :].tolist()
    for at in range(0, len(starts), piece):
        yield np.array([digest(line[a:b], seed) for a, b in zip(starts[at : at + piece], stops[at : at + piece])], np.uint64)


def fingerprint(text: str | None, shingle: int = 3, piece: int = 1 << 16) -> int:
    total, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text, shingle, piece=piece):
        total += _bit_counts(hashes)
        n += len(hashes)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


#: For a byte: its 8 bits, one in each byte of a 64-bit word, so that 255 bytes add up at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    total, spread = np.zeros(BITS, np.int64), _SPREAD[hashes.view(np.uint8).reshape(-1, 8)]
    for at in range(0, len(spread), 255):
        total += spread[at : at + 255].sum(axis=0, dtype=np.uint64).view(np.uint8)
    return total


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long), node (a hash of the text)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts)).view(np.int64))

    short_batches(docs.sparkSession)
    return docs.select("doc_id", F.pandas_udf(run, "long")("text").alias("fp"), F.xxhash64("text").alias("node"))


# ---------------------------------------------------------------- partitions and thresholds
def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many distinct fingerprints there are, and for each two bits in how many both are set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS)), 0
        for b in batches:
            bits = np.unpackbits(b["fp"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
            n += len(b)
        yield pd.DataFrame({"i": [*range(BITS), BITS], "v": [*both.tolist(), [float(n)]]})

    rows = fps.select("fp").mapInPandas(run, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    both = np.zeros((BITS + 1, BITS))
    for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # 64 x 64 + 1 rows
        both[r["i"], r["j"]] = r["v"]
    return int(both[BITS, 0]), both[:BITS]


def group_bits(bits: list[int], parts: int, n: int, both: np.ndarray) -> list[list[int]]:
    """Deals bits into partitions of about equal size, each grown from the strongest correlations."""
    p = both.diagonal() / max(n, 1)
    var = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(var, var)
    left, groups = list(bits), []
    for k in range(parts):
        size = -(-len(left) // (parts - k))
        seed = max(left, key=lambda b: (sum(corr[b, x] for x in left if x != b), -b))
        group = [seed]
        while len(group) < size:
            group.append(max((b for b in left if b not in group), key=lambda b: (sum(corr[b, x] for x in group), -b)))
        groups.append(sorted(group))
        left = [b for b in left if b not in group]
    return groups


def thresholds(costs: list[list[float]], distance: int) -> list[int]:
    """The t[i] >= -1 with sum(t) = distance - len(costs) + 1 of least total cost.

    costs[i][e + 1] is what threshold e costs in partition i (e = -1: nothing).
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for e in range(-1, len(row) - 1):
                now = (cost + row[e + 1], [*chosen, e])
                if spent + e + 1 <= distance + 1 and (spent + e + 1 not in step or now < step[spent + e + 1]):
                    step[spent + e + 1] = now
        best = step
    return best[distance + 1][1]


def _mask(bits: tuple[int, ...] | list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def plan_masks(distance: int, n: int, both: np.ndarray, same: dict[tuple[int, ...], float] | None = None, parts: int = 4) -> list[int]:
    """The masks of the keys: fingerprints within the distance agree under one mask at least.

    Every mask leaves at most FREE_BITS bits free. `same`: for a partition (its bits), how many
    pairs of fingerprints agree on it, counted over all of them; estimated from the bits' own
    frequencies where it isn't given.
    """
    p = both.diagonal() / max(n, 1)
    differ = 2 * p * (1 - p)

    def candidates(group: list[int], e: int, pairs: float) -> float:
        """Estimated pairs, of those that agree so far, that also agree under the keys of threshold e."""
        d = differ[group]
        total = pairs * float(np.prod(1 - d))
        if same is not None and tuple(group) in same:
            total = same[tuple(group)]
        ratios = np.sort(1 / np.maximum(1 - d, 1e-6))[::-1]
        return total * sum(float(np.prod(c)) for c in itertools.combinations(ratios.tolist(), e)) if e else total

    def masks(fixed: list[int], free: list[int], pairs: float) -> set[int]:
        if len(free) <= FREE_BITS:
            return {_mask(fixed)}
        m = parts if not fixed else 3
        groups = group_bits(free, m, n, both)
        # a key costs a row for every fingerprint, and candidates only cost a comparison
        costs = [[0.0] + [candidates(g, e, pairs) / 50 + n * len(list(itertools.combinations(g, e))) for e in range(min(distance, len(g)) + 1)] for g in groups]
        out = set()
        for group, t in zip(groups, thresholds(costs, distance)):
            for blank in itertools.combinations(group, t) if t >= 0 else ():
                held = [b for b in group if b not in blank]
                kept = candidates(group, t, pairs) / max(1, len(list(itertools.combinations(group, t))))
                out |= masks(fixed + held, [b for b in free if b not in held], kept)
        return out

    return sorted(masks([], list(range(BITS)), n * n / 2))


def first_groups(n: int, both: np.ndarray, parts: int = 4) -> list[list[int]]:
    return group_bits(list(range(BITS)), parts, n, both)


def pairs_alike(fps: DataFrame, groups: list[list[int]]) -> dict[tuple[int, ...], float]:
    """For every partition, how many pairs of fingerprints agree on all its bits."""
    keys = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(g)))).alias("v")) for i, g in enumerate(groups)))
    counts = fps.select(F.explode(keys).alias("k")).groupBy("k.i", "k.v").count()
    rows = counts.groupBy("i").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()
    return {tuple(groups[r["i"]]): r["pairs"] for r in rows}


# ---------------------------------------------------------------- links
def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def forest(fps: np.ndarray, free: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star for every linked group of distinct fingerprints that agree but for the bits of free."""
    fps = np.sort(fps)
    n, a, b = len(fps), [], []
    if n <= DIRECT:
        step = max(1, (1 << 20) // n)
        for at in range(0, n, step):
            near = np.bitwise_count(fps[at : at + step, None] ^ fps[None, :]) <= distance
            i, j = np.nonzero(near)
            keep = i + at < j
            a.append(i[keep] + at)
            b.append(j[keep])
    else:
        bits = [x for x in range(BITS) if free >> x & 1]
        for k in range(1, distance + 1):
            for flip in itertools.combinations(bits, k):
                other = fps ^ np.uint64(_mask(flip))
                at = np.minimum(np.searchsorted(fps, other), n - 1)
                i = np.nonzero((fps[at] == other) & (fps < other))[0]
                a.append(i)
                b.append(at[i])
    root = _roots(n, np.concatenate(a), np.concatenate(b))
    child = np.nonzero(root != np.arange(n))[0]
    return fps[child], fps[root[child]]


def links(fps: DataFrame, distance: int = DISTANCE, parts: int = 4) -> DataFrame:
    """a, b: links between distinct fingerprints that connect all within the distance."""
    n, both = bit_statistics(fps)
    if n < 2:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    masks = plan_masks(distance, n, both, pairs_alike(fps, first_groups(n, both, parts)), parts)
    every = (1 << BITS) - 1
    keys = F.array(*(F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)))
    groups = spread(fps.select("fp"), "fp").select("fp", F.explode(keys).alias("k")).groupBy("k.m", "k.v").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("m", "fps")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = [], []
            for m, group in zip(batch["m"], batch["fps"]):
                x, y = forest(np.asarray(group, np.int64).view(np.uint64), every ^ masks[m], distance)
                a.append(x)
                b.append(y)
            yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})

    return groups.mapInPandas(run, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root for every node of the links a-b; root is the smallest node that it reaches.

    Alternating stars: the large star hangs a node's larger neighbours on its smallest one, the
    small star a node and its smaller neighbours; every round is written to the shared folder.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both if large else pairs  # pairs have u > v
        low = near.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low")).withColumnRenamed("u", "k")
        hung = (both.where("v > u") if large else pairs).join(low, F.col("u") == F.col("k"))
        out = hung.select(F.col("v").alias("u"), F.col("low").alias("v"))
        if not large:
            out = out.union(low.select(F.col("k").alias("u"), F.col("low").alias("v")))
        return out.where("u > v").distinct()

    step = Steps(edges.sparkSession)
    pairs = step(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    before = None
    for _ in range(rounds):
        pairs = step(star(star(pairs, True), False))
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame, distance: int = DISTANCE, shingle: int = 3, parts: int = 4, also: DataFrame | None = None) -> DataFrame:
    """doc_id, fp, node, root (the class), component_id (the smallest doc_id that is reached) for every row of docs.

    also: further links a, b between texts, by their nodes (xxhash64 of the text).
    """
    rows = cut(fingerprints(docs, shingle))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    edges = links(fps, distance, parts)
    if also is not None:
        ends = rows.select("node", "fp").distinct()
        a, b = (ends.select(F.col("node").alias(c), F.col("fp").alias(f"f{c}")) for c in "ab")
        more = also.select("a", "b").join(a, "a").join(b, "b")
        edges = edges.union(more.select("fa", "fb"))
    roots = components(edges)
    rooted = cut(fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("fps"))
    named = join_hot(rooted, least, "root", "fps").select("fp", "n", "root", "component_id")
    return join_hot(rows, cut(named), "fp", "n").select("doc_id", "fp", "node", "root", "component_id")


def report(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return classes(docs, distance).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, distance: int = DISTANCE, also: DataFrame | None = None) -> DataFrame:
    """docs with one row of each class: of its smallest id, and of that id's texts the one of smallest hash.

    Classes are of rows and not of ids: an id that has texts in several classes stays once in each
    class whose smallest id it is. Of rows with that id and text, the first by all its columns as JSON
    stays, so any run keeps the same. Rows without an id stay. Rows to leave out meet the texts in an
    anti-join: while they are few, they are sent to the texts, and both are dealt by id when they aren't.
    """
    found = cut(classes(docs, distance, also=also).where("doc_id is not null").select("doc_id", "node", "root"))
    first = found.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.count("*").alias("n"))
    marked = cut(join_hot(found, first, "root", "n").select("doc_id", "node", (F.struct("doc_id", "node") == F.col("first")).alias("stays")))
    gone = small(cut(marked.where("not stays").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")).distinct()))
    twice = cut(marked.where("stays").groupBy("doc_id", "node").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("node").alias("_node")))
    rows = docs.select(F.struct("*").alias("row"), "doc_id", F.xxhash64("text").alias("node"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("node") == F.col("_node"))
    once = rows.join(gone, same, "left_anti")
    if not twice.isEmpty():
        again = once.join(twice, same, "left_semi").groupBy("doc_id", "node").agg(F.min_by("row", F.to_json("row")).alias("row"))
        once = once.join(twice, same, "left_anti").select("row").unionByName(again.select("row"))
    return once.select("row.*")
