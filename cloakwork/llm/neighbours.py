"""Approximate nearest neighbours: a forest of random-projection trees.

Every tree splits space by random directions at the median of a bounded sample; the whole table
is then dealt to the leaves. A query walks all trees through one priority queue, ordered by the sum
of squares of the margins by which branches were passed over, until the leaves it met hold `budget`
rows of the whole table; then the vectors of those leaves are ranked by exact distance.

The budget is measured and not guessed: for CHECKED queries, the first by a hash of their ids, the exact
neighbours are found by one pass over all rows, and the budget is the least at which the share TARGET of
them is met. On vectors that form clusters it stays as small however many rows there are; on vectors
without any structure it has to grow with them, as for any index.

Equal vectors are one node with its smallest ids (more than k + 1 of them can't matter), so a
vector that makes up a third of the table is no larger than any other. Vectors are shuffled once, to
blocks of at most BLOCK_ROWS: leaves hold ids only, and a query sends to a block the ids that it asks
for there. A block meets its queries QUERIES at a time. Each block gives a query at most k + 1
candidates, so what meets at a query is bounded by its leaves.

Cases: null vectors, zero vectors, vectors that hold null or non-finite components, and vectors
of another length than most take no part, as queries or as candidates; null ids neither; fewer
candidates than k give all; ties go to the smaller id; repeated rows of an id count once (the
smallest vector); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread

#: The trees are fitted on at most so many vectors, the first by a hash of their ids.
SAMPLE = 20_000
#: Leaves of so many sampled vectors.
TREES, LEAF = 16, 8
#: The share of exact neighbours that the budget has to meet, and for how many queries it is measured.
TARGET, CHECKED = 0.95, 100
#: A block holds at most so many vectors, and meets at most so many queries at once.
BLOCK_ROWS, QUERIES = 4000, 2048


class Forest:
    """Random-projection trees over a sample. Leaves are numbered through all trees."""

    def __init__(self, sample: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.dims = sample.shape[1]
        self.roots: list[int] = []
        left, right, cuts, dirs = [], [], [], []

        def new() -> int:
            left.append(-1)
            right.append(-1)
            cuts.append(0.0)
            dirs.append(None)
            return len(left) - 1

        for _ in range(trees):
            root = new()
            self.roots.append(root)
            stack = [(root, np.arange(len(sample)))]
            while stack:
                node, rows = stack.pop()
                best = None
                if len(rows) > leaf:
                    for _ in range(3):  # the direction of two members tells clusters apart
                        a, b = sample[rng.choice(rows, 2, replace=False)]
                        d = (a - b) + 0.1 * rng.normal(size=self.dims) * (np.linalg.norm(a - b) / np.sqrt(self.dims) + 1e-9)
                        size = np.linalg.norm(d)
                        d = (d / size if size else rng.normal(size=self.dims) / np.sqrt(self.dims)).astype(np.float32)
                        at = sample[rows] @ d
                        mid = float(np.median(at))
                        low = at < mid
                        if 0 < low.sum() < len(rows):
                            best = (d, mid, low)
                            break
                if best is None:
                    continue
                dirs[node], cuts[node] = best[0], best[1]
                left[node], right[node] = new(), new()
                stack += [(left[node], rows[best[2]]), (right[node], rows[~best[2]])]
        self.left, self.right, self.cuts = np.array(left, np.int32), np.array(right, np.int32), np.array(cuts)
        # directions of the nodes that branch alone; row: where a node's stands
        inner = self.left >= 0
        self.row = np.cumsum(inner, dtype=np.int32) - 1
        self.dirs = np.array([d for d in dirs if d is not None], np.float32).reshape(int(inner.sum()), self.dims)
        self.cuts = self.cuts[inner]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of x in every tree."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            here = np.full(len(x), root)
            while True:
                rows = np.nonzero(self.left[here] >= 0)[0]
                if not len(rows):
                    break
                at = here[rows]
                own = self.row[at]
                side = np.einsum("ij,ij->i", x[rows], self.dirs[own]) < self.cuts[own]
                here[rows] = np.where(side, self.left[at], self.right[at])
            out[:, t] = here
        return out

    def walk(self, q: np.ndarray) -> Iterator[int]:
        """The leaves of all trees, nearest to q first."""
        margins = (self.dirs @ q - self.cuts).tolist()
        queue = [(0.0, root) for root in self.roots]
        heapq.heapify(queue)
        while queue:
            passed, node = heapq.heappop(queue)
            while self.left[node] >= 0:
                m = margins[self.row[node]]
                near, far = (self.left[node], self.right[node]) if m < 0 else (self.right[node], self.left[node])
                heapq.heappush(queue, (passed + m * m, int(far)))
                node = near
            yield int(node)

    def search(self, q: np.ndarray, rows: np.ndarray, budget: int) -> list[int]:
        """The leaves nearest to q, until they hold `budget` rows. rows: how many each leaf holds."""
        found, held = [], 0
        for leaf in self.walk(q):
            if rows[leaf]:
                found.append(leaf)
                held += rows[leaf]
                if held >= budget:
                    break
        return found

    def met_at(self, q: np.ndarray, rows: np.ndarray, wanted: list[list[int]]) -> list[int]:
        """For each wanted vector, given by its leaves, the budget at which a search for q meets it."""
        out, held = [0] * len(wanted), 0
        by_leaf: dict[int, list[int]] = {}
        for i, leaves in enumerate(wanted):
            for leaf in leaves:
                by_leaf.setdefault(leaf, []).append(i)
        left = len(wanted)
        for leaf in self.walk(q) if left else ():
            held += int(rows[leaf])
            for i in by_leaf.get(leaf, ()):
                if not out[i]:
                    out[i], left = held, left - 1
            if not left:
                break
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: the vectors that take part."""
    rows = vectors.select("vec_id", F.col("embedding").alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows


def exact(nodes: DataFrame, questions: dict[int, np.ndarray], k: int) -> dict[int, list[int]]:
    """The k nearest nodes of each question, itself apart, by one pass. A task gives k + 1 rows a question at most."""
    names, q = list(questions), np.array(list(questions.values()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [np.zeros((0, 2))] * len(names)
        for b in batches:
            x, own = np.array(b["v"].tolist(), np.float64), b["node"].to_numpy()
            for i in range(len(names) if len(own) else 0):
                d = ((x - q[i]) ** 2).sum(axis=1)
                few = np.argpartition(d, k)[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                both = np.concatenate([best[i], np.stack([d[few], own[few].view(np.float64)], axis=1)])
                best[i] = both[np.argsort(both[:, 0], kind="stable")[: k + 1]]
        for name, rows in zip(names, best):
            yield pd.DataFrame({"q": name, "d": rows[:, 0], "node": np.ascontiguousarray(rows[:, 1]).view(np.int64)})

    found = nodes.select("node", "v").mapInPandas(run, "q long, d double, node long").where("q <> node")
    top = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "node"))), 1, k).alias("top"))
    return {r["q"]: [t["node"] for t in r["top"]] for r in top.collect()}  # CHECKED rows


def nearest(vectors: DataFrame, is_query, k: int = 10, trees: int = TREES, sample: int = SAMPLE, target: float = TARGET, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row that is_query(vec_id) picks."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = usable(vectors)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return empty
    rows = rows.where(F.size("v") == lengths["n"]).groupBy("vec_id").agg(F.min("v").alias("v"))
    # equal vectors once: k + 1 of their ids are enough for any query, even one of themselves
    nodes = _smallest(rows, k + 1)
    nodes = cut(nodes.withColumn("node", F.col("ids")[0]))
    # nodes first, as every task sends so many; then their vectors
    first = cut(nodes.select("node").orderBy(F.xxhash64("node"), "node").limit(sample))
    chosen = nodes.join(F.broadcast(first), "node").select("node", "v").toArrow().sort_by("node")
    fitted = chosen["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, lengths["n"])
    grown = Forest(fitted, trees, max(4, min(LEAF, len(fitted) // 4)), seed)
    forest = spark.sparkContext.broadcast(grown)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                leaves = forest.value.leaves(np.array(b["v"].tolist(), np.float64))
                yield pd.DataFrame({"node": b["node"], "leaf": leaves.astype(np.int32).tolist()})

    dealt = cut(spread(nodes.select("node", "v"), "node").mapInPandas(deal, "node long, leaf array<int>"))
    counts = np.zeros(len(grown.left), np.int64)
    for r in dealt.select(F.explode("leaf").alias("leaf")).groupBy("leaf").count().collect():  # a row per leaf
        counts[r["leaf"]] = r["count"]
    # a vector's block follows from its leaf in the first tree
    home, pieces = _blocks(len(counts), {leaf: int(counts[leaf]) for leaf in _below(grown, grown.roots[0])})
    block = spark.createDataFrame(pd.DataFrame({"first": np.arange(len(home)), "block": home, "pieces": pieces}), "first int, block long, pieces int")
    placed = dealt.join(F.broadcast(block), F.col("leaf")[0] == F.col("first"))  # a row per leaf is broadcast
    placed = placed.select("node", "leaf", "block", F.pmod(F.xxhash64("node"), "pieces").cast("int").alias("piece"))

    asked = rows.where(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    asked = asked.join(nodes.select(F.col("v").alias("qv"), F.col("node").alias("qnode")), "qv").select("query_id", "qnode", "qv")
    asked = cut(asked)
    questions = cut(asked.groupBy("qnode").agg(F.first("qv").alias("qv")))
    budget = _budget(grown, counts, dealt, nodes, questions, k, target)

    # a leaf's members are kept as lists of at most a block, which a query takes as they are
    lists = -(-counts // BLOCK_ROWS)
    parts = spark.createDataFrame(pd.DataFrame({"leaf": np.arange(len(lists)), "lists": lists}), "leaf int, lists int")
    members = placed.select("node", F.struct("node", "block", "piece").alias("m"), F.explode("leaf").alias("leaf")).join(F.broadcast(parts), "leaf")
    members = members.groupBy("leaf", F.pmod(F.xxhash64("node", F.lit(3)), "lists").cast("int").alias("list")).agg(F.collect_list("m").alias("m"))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for qnode, v in zip(b["qnode"], b["qv"]):
                leaves = np.array(forest.value.search(np.asarray(v, np.float64), counts, budget), np.int32)
                many = lists[leaves]
                yield pd.DataFrame({"qnode": qnode, "leaf": np.repeat(leaves, many), "list": np.concatenate([np.arange(k, dtype=np.int32) for k in many])})

    def gather(x: pd.DataFrame) -> pd.DataFrame:
        """A query's candidates, each once, by the block that holds them."""
        found = pd.DataFrame({c: np.concatenate(x[c].tolist()) for c in ("node", "block", "piece")}).drop_duplicates("node")
        rows = [(int(x["qnode"].iloc[0]), *key, own["node"].to_numpy()) for key, own in found.groupby(["block", "piece"])]
        return pd.DataFrame(rows, columns=["qnode", "block", "piece", "nodes"])

    routes = spread(questions, "qnode").mapInPandas(route, "qnode long, leaf int, list int")
    wanted = routes.join(members, ["leaf", "list"]).select("qnode", *(F.col(f"m.{c}").alias(c) for c in ("node", "block", "piece")))
    wanted = wanted.groupBy("qnode").applyInPandas(gather, "qnode long, block long, piece int, nodes array<long>")
    wanted = cut(wanted.join(questions, "qnode")).select("block", "piece", "qnode", "nodes", "qv")
    rounds = cut(wanted.groupBy("block", "piece").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("rounds"))).toDF("block", "piece", "rounds")
    wanted = wanted.join(rounds, ["block", "piece"]).withColumn("turn", F.pmod(F.xxhash64("qnode"), "rounds").cast("int"))
    held = placed.select("node", "block", "piece").join(rounds, ["block", "piece"]).join(nodes.select("node", "v"), "node")
    held = held.select("block", "piece", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("turn"), "node", "v").toDF("block", "piece", "turn", "node", "v")

    def rank(key, q: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(m):
            own = m["node"].to_numpy()
            order = np.argsort(own)
            own, x = own[order], np.array(m["v"].tolist(), np.float64)[order]
            for qnode, v, some in zip(q["qnode"], q["qv"], q["nodes"]):
                at = np.searchsorted(own, np.asarray(some, np.int64))
                d = np.sqrt(((x[at] - np.asarray(v, np.float64)) ** 2).sum(axis=1))
                if len(at) > 4 * k:
                    few = np.nonzero(d <= np.partition(d, k)[k])[0]
                    at, d = at[few], d[few]
                best = np.lexsort((own[at], d))[: k + 1]
                out.append((np.full(len(best), qnode), own[at[best]], d[best]))
        parts = [np.concatenate(p) for p in zip(*out)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("qnode", "node", "score"), parts)))

    deal_by = ("block", "piece", "turn")
    near = wanted.groupBy(*deal_by).cogroup(held.groupBy(*deal_by)).applyInPandas(rank, "qnode long, node long, score double")
    best = near.groupBy("qnode").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "node"))), 1, k + 1).alias("best"))
    best = best.select("qnode", F.explode("best").alias("b")).select("qnode", "b.score", "b.node")
    best = best.join(nodes.select("node", "ids"), "node").select("qnode", "score", F.explode("ids").alias("vec_id"))
    # of all ids of the k + 1 nearest nodes, the k + 1 nearest: one of them may be the query itself
    top = best.groupBy("qnode").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("top"))
    found = asked.select("query_id", "qnode").join(top, "qnode")
    found = found.select("query_id", F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k).alias("top"))
    found = found.select("query_id", F.posexplode("top").alias("at", "t"))
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def _below(forest: Forest, root: int) -> list[int]:
    """The leaves of one tree, in order."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if forest.left[node] < 0:
            found.append(node)
        else:
            stack += [int(forest.right[node]), int(forest.left[node])]
    return found


def _budget(forest: Forest, counts: np.ndarray, dealt: DataFrame, nodes: DataFrame, questions: DataFrame, k: int, target: float) -> int:
    """The rows that a query's leaves have to hold for the target share of neighbours, measured on some queries."""
    some = {r["qnode"]: np.array(r["qv"], np.float64) for r in questions.orderBy(F.xxhash64("qnode"), "qnode").limit(CHECKED).collect()}
    if not some:
        return 0
    truth = exact(nodes, some, k)
    known = dealt.where(F.col("node").isin(sorted({n for near in truth.values() for n in near})))  # at most CHECKED * k
    leaves = {r["node"]: r["leaf"] for r in known.collect()}
    met = [at for q, near in truth.items() for at in forest.met_at(some[q], counts, [leaves[n] for n in near])]
    return int(np.quantile(met, target, method="higher")) if met else 0


def _blocks(n: int, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """For every leaf of one tree its block (neighbours together, BLOCK_ROWS vectors at most) and its pieces."""
    block, pieces, held = np.zeros(n, np.int64), np.ones(n, np.int32), 0
    now = 0
    for leaf, size in counts.items():
        alone = size > BLOCK_ROWS
        if held and (alone or held + size > BLOCK_ROWS):
            now, held = now + 1, 0
        block[leaf] = now
        held += size
        if alone:
            pieces[leaf] = -(-size // BLOCK_ROWS)
            now, held = now + 1, 0
    return block, pieces


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """v, ids: the n smallest ids of every vector. Each task passes on n ids of a vector at most."""
    at = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = rows.withColumn("at", at).where(F.col("at") <= n)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def report(vectors: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest of every vector whose id is divisible by 100."""
    kind = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return nearest(kind, lambda vec_id: vec_id % 100 == 0, k)
