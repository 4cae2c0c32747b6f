"""Quality scores from attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Every passage is encoded by a small layer over
measures of its letters, symbols, repetition and word shapes; gated attention, learnt from the
documents' labels alone, weighs the passages; the weighted representation is scored. All passages
of the whole text take part. The model is fitted on the whole texts of all labelled rows that aren't
held out: their passages are measured once, to the shared folder, and every step of L-BFGS and of the
calibration is a pass over these in the executors, whose sums alone come to the driver.

Cases: a null, empty or blank text is one empty passage; words longer than PIECE characters are
read in pieces; without labels of both kinds every score is the share of good ones (0.5 if there are none);
a label that is given twice is the larger one, and rows of one id all have its label; repeated rows get equal
scores; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, cut, fold_of, remove, short_batches, small
from .learning import minimised, platt_by, platt_sums, sigmoid

PASSAGE, PIECE = 64, 400
ENCODED, GATE = 16, 8


def _classes() -> bytes:
    """For each byte a letter that names its class."""
    table = bytearray(b"x" * 256)  # x: part of a character beyond ASCII
    for b in range(128):
        c = chr(b)
        table[b] = ord("u" if c.isupper() else "l" if c.islower() else "d" if c.isdigit() else "s" if c.isspace() else "c" if b < 32 or b == 127 else "!" if c == "!" else "." if c in ".,;:?" else "q" if c in "'\"()-" else "y")
    return bytes(table)


_CLASS = _classes()
_COUNTED = [c.encode() for c in "ulds!.qyxc"]
FEATURES = len(_COUNTED) + 12
WIDTH = FEATURES + 2
#: Passages of up to so many bytes together are held by the driver; more are read in every pass.
DRIVER_BYTES = 8_000_000
#: Passages are computed on in pieces of about so many.
PIECE_PASSAGES = 4096
DECAY = 1e-4


def _measures(words: list[str]) -> list[float]:
    n = len(words)
    line = " ".join(words).encode("utf-8", "replace")
    kinds = line.translate(_CLASS)
    size = max(1, len(line))
    shares = [kinds.count(c) / size for c in _COUNTED]
    lengths = list(map(len, words))
    low = " ".join(words).lower().split(" ")
    distinct = len(set(low))
    repeats = sum(map(eq, low, low[1:])) if n > 1 else 0
    mean = sum(lengths) / max(1, n)
    ends = [w[-1] for w in words if w]
    marked = sum(not e.isalnum() and e not in ".,;:?!'\")" for e in ends)
    bare = sum(1 for w in words if not any(map(str.isalnum, w)))
    return [*shares, mean / 10, max(lengths, default=0) / 40, min(lengths, default=0) / 10, distinct / max(1, n), repeats / max(1, n), marked / max(1, n), bare / max(1, n), kinds.count(b"y" * 3) / max(1, n), sum(map(str.isupper, words)) / max(1, n), sum(map(str.istitle, words)) / max(1, n), float(np.log1p(n)), kinds.count(b"!!") / max(1, n)]


def passages(text: str | None) -> np.ndarray:
    """The measures of every passage of the text; two columns more on the document as a whole."""
    text = text or ""
    words = text.split()
    if words and max(map(len, words)) > PIECE:
        words = [w[i : i + PIECE] for w in words for i in range(0, len(w), PIECE)]
    rows = [_measures(words[i : i + PASSAGE]) for i in range(0, len(words), PASSAGE)] or [_measures([])]
    lines = [x for x in text.split("\n") if x.strip()]
    whole = [1 - len(set(lines)) / len(lines) if lines else 0.0, float(np.log1p(len(words))) / 10]
    return np.concatenate([np.array(rows, np.float32), np.tile(np.array(whole, np.float32), (len(rows), 1))], axis=1)


def start(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    return {"w": draw(FEATURES + 2, ENCODED, scale=0.3), "b": np.zeros(ENCODED, np.float32), "v": draw(ENCODED, GATE, scale=0.4), "u": draw(ENCODED, GATE, scale=0.4), "a": draw(GATE, scale=0.4), "o": draw(ENCODED, scale=0.4), "c": np.zeros(1, np.float32)}


def _forward(p: dict, x: np.ndarray, bag: np.ndarray, n: int) -> tuple:
    """x: passages of all bags, sorted by bag; bag: which one each belongs to."""
    h = np.tanh(x @ p["w"] + p["b"])
    tv, su = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
    e = (tv * su) @ p["a"]
    starts = np.searchsorted(bag, np.arange(n))
    e = e - np.maximum.reduceat(e, starts)[bag]
    w = np.exp(e)
    w /= np.add.reduceat(w, starts)[bag]
    z = np.add.reduceat(w[:, None] * h, starts, axis=0)
    return h, tv, su, w, z, z @ p["o"] + p["c"][0]


def gradients(p: dict, x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    n = len(y)
    h, tv, su, w, z, logit = _forward(p, x, bag, n)
    prob = sigmoid(logit)
    loss = float(-(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)).mean())
    d = (prob - y) / n
    g = {"o": z.T @ d, "c": d.sum(keepdims=True)}
    d_z = (d[:, None] * p["o"])[bag]
    d_w = (d_z * h).sum(axis=1)
    starts = np.searchsorted(bag, np.arange(n))
    d_e = w * (d_w - np.add.reduceat(w * d_w, starts)[bag])
    g["a"] = (tv * su).T @ d_e
    d_t, d_s = d_e[:, None] * p["a"] * su * (1 - tv * tv), d_e[:, None] * p["a"] * tv * su * (1 - su)
    g["v"], g["u"] = h.T @ d_t, h.T @ d_s
    d_h = (w[:, None] * d_z + d_t @ p["v"].T + d_s @ p["u"].T) * (1 - h * h)
    g["w"], g["b"] = x.T @ d_h, d_h.sum(axis=0)
    return loss, g


def logits(p: dict, docs: list[np.ndarray]) -> np.ndarray:
    if not docs:
        return np.zeros(0)
    x = (np.concatenate(docs) - p["mean"]) / p["spread"]
    return _forward(p, np.clip(x, -8, 8), np.repeat(np.arange(len(docs)), list(map(len, docs))), len(docs))[-1].astype(np.float64)


def _pieces(bags: Sequence[bytes], y: Sequence[float]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Passages, the bag of each and the bags' labels, in pieces of about PIECE_PASSAGES."""
    sizes = np.fromiter(map(len, bags), np.int64, len(bags)) // (4 * WIDTH)
    piece, y = np.cumsum(sizes) // PIECE_PASSAGES, np.asarray(y, np.float64)
    starts = np.flatnonzero(np.diff(piece, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(sizes)]):
        x = np.frombuffer(b"".join(bags[a:b]), np.float32).reshape(-1, WIDTH)
        yield x.astype(np.float64), np.repeat(np.arange(b - a), sizes[a:b]), y[a:b]


class Bags:
    """Sums over all of a table's bags (y, bag), which the driver holds if they are few."""

    def __init__(self, table: DataFrame):
        self.table, self.held = table.select("y", "bag"), None
        if (table.agg(F.sum(F.length("bag"))).first()[0] or 0) <= DRIVER_BYTES:
            rows = self.table.collect()
            self.held = [*_pieces([bytes(r["bag"]) for r in rows], [r["y"] for r in rows])]

    def total(self, work: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
        if self.held is not None:
            return sum((work(*p) for p in self.held), np.zeros(size))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = np.zeros(size)
            for b in batches:
                for piece in _pieces(b["bag"].tolist(), b["y"].tolist()):
                    own += work(*piece)
            yield pd.DataFrame({"v": [own.tobytes()]})

        # a few kilobytes a task, added up in the order of tasks
        return sum((np.frombuffer(r["v"]) for r in self.table.mapInPandas(run, "v binary").collect()), np.zeros(size))


def train(bags: Bags, seed: int = 11) -> dict:
    """The model's arrays."""

    def measure(x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(y), y.sum(), len(x)], x.sum(axis=0), (x * x).sum(axis=0)])

    sums = bags.total(measure, 3 + 2 * WIDTH)
    n, up, many = sums[:3]
    if not 0 < up < n:
        return {"fixed": float(up / n) if n else 0.5}
    mean = sums[3 : 3 + WIDTH] / many
    spread = np.sqrt(np.maximum(sums[3 + WIDTH :] / many - mean * mean, 0)) + 0.02
    p = {k: v.astype(np.float64) for k, v in start(seed).items()}
    cuts = np.cumsum([v.size for v in p.values()])[:-1]

    def parts(flat: np.ndarray) -> dict[str, np.ndarray]:
        return {k: v.reshape(p[k].shape) for k, v in zip(p, np.split(flat, cuts))}

    def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
        now = parts(flat)

        def work(x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> np.ndarray:
            value, g = gradients(now, np.clip((x - mean) / spread, -8, 8), bag, y)
            return np.concatenate([[value], *(g[k].ravel() for k in now)]) * len(y)

        sums = bags.total(work, 1 + len(flat)) / n
        return float(sums[0] + DECAY / 2 * flat @ flat), sums[1:] + DECAY * flat

    p = parts(minimised(loss, np.concatenate([v.ravel() for v in p.values()])))

    def newton(a: float, b: float) -> np.ndarray:
        def work(x: np.ndarray, bag: np.ndarray, y: np.ndarray) -> np.ndarray:
            return platt_sums(_forward(p, np.clip((x - mean) / spread, -8, 8), bag, len(y))[-1], y, up, n - up, a, b)

        return bags.total(work, 5)

    a, b = platt_by(newton, up, n - up)
    return p | {"mean": mean, "spread": spread, "scale": a, "shift": b}


def learnt(docs: DataFrame, labels: DataFrame) -> dict:
    """The model of all rows of docs that have a label and aren't held out (crc32 of the id modulo 4 is not 2)."""
    spark = docs.sparkSession
    short_batches(spark)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([passages(t).tobytes() for t in texts])

    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 2))
    known = small(cut(known.groupBy("doc_id").agg((F.max("quality") > 0).cast("int").alias("_y"))))
    rows = docs.select("doc_id", "text").join(known, "doc_id").select(F.col("_y").alias("y"), "text")
    step = Steps(spark)
    model = train(Bags(step(rows.select("y", F.pandas_udf(run, "binary")("text").alias("bag")))))
    remove(spark, step.folder)
    return model


def scores(model: dict, texts: list[str | None]) -> np.ndarray:
    if "fixed" in model:
        return np.full(len(texts), model["fixed"])
    out = [logits(model, [passages(t) for t in texts[i : i + 256]]) for i in range(0, len(texts), 256)]
    return sigmoid(model["scale"] * np.concatenate([*out, np.zeros(0)]) + model["shift"])


def scored(model: dict, text: str = "text") -> Column:
    """The score of a text column."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(scores(model, texts.tolist()))

    return F.pandas_udf(run, "double")(text)


def score(docs: DataFrame, model: dict, cut: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, over its whole text."""
    short_batches(docs.sparkSession)
    rows = docs.select("doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), scored(model).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def report(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    return score(docs, learnt(docs, labels), cut)


def keep(docs: DataFrame, labels: DataFrame, cut: float = 0.7) -> DataFrame:
    """The rows of docs with a score of at least cut, with all their columns; no row is moved."""
    short_batches(docs.sparkSession)
    return docs.where(scored(learnt(docs, labels)) >= cut)
