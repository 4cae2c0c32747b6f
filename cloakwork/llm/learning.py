"""What the trained operators share: a bounded labelled sample, Adam, L-BFGS, and calibration."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fold_of

#: A model is fitted on at most so many documents of either label, none longer than SAMPLE_CHARS
#: and no more than SAMPLE_TOTAL characters of either label together.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 3000, 60_000, 40_000_000


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> tuple[list[str], np.ndarray, float | None]:
    """Texts and labels to learn from, and the share of label 1 among all rows that may be learnt from.

    The texts are those of the first per_class documents of either label by a hash of their id, of
    those that are in docs, short enough and not held out (crc32 of the id modulo 4 is not 2). A label
    that is given twice is the larger one; of an id with several texts the one of smallest hash counts.
    Labels meet ids, lengths and hashes first; then at most 2 * per_class texts are read and collected.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) != 2))
    known = known.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("_y"))
    counts = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    sized = docs.select("doc_id", F.xxhash64("text").alias("th"), F.length("text").alias("n")).where(F.col("n") <= chars)
    sized = cut(sized.join(known, "doc_id").groupBy("doc_id", "_y").agg(F.min(F.struct("th", "n")).alias("t")).select("doc_id", "_y", "t.th", "t.n"))
    wanted = []
    for y in (0, 1):
        room = SAMPLE_TOTAL
        for r in sized.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect():
            if r["n"] <= room:
                room -= r["n"]
                wanted.append((r["doc_id"], r["th"], y))
    share = counts.get(1, 0) / sum(counts.values()) if counts else None
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = docs.sparkSession.createDataFrame(wanted, f"doc_id {kind}, th long, _y int")
    rows = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "th"])
    pulled = {r["doc_id"]: r["text"] for r in cut(rows.groupBy("doc_id").agg(F.min("text").alias("text"))).toLocalIterator()}
    return [pulled[i] for i, _, _ in wanted], np.array([y for _, _, y in wanted], np.float32), share


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Adam:
    """Adam over a dict of arrays."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, decay: float = 0.0):
        self.params, self.rate, self.decay, self.t = params, rate, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray], clip: float = 5.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, clip / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale + self.decay * self.params[k]
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def platt(logits: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """a > 0 and b such that sigmoid(a * logit + b) fits y; labels are smoothed as Platt advised."""
    up, down = float((y > 0).sum()), float((y == 0).sum())
    return platt_by(lambda a, b: platt_sums(logits, y, up, down, a, b), up, down, steps)


def platt_sums(logits: np.ndarray, y: np.ndarray, up: float, down: float, a: float, b: float) -> np.ndarray:
    """What a Newton step of platt_by adds up over rows: two parts of the gradient, three of the Hessian."""
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    p = sigmoid(a * logits + b)
    w = np.maximum(p * (1 - p), 1e-6)
    return np.array([((p - t) * logits).sum(), (p - t).sum(), (w * logits * logits).sum(), (w * logits).sum(), w.sum()])


def platt_by(sums: Callable[[float, float], np.ndarray], up: float, down: float, steps: int = 200) -> tuple[float, float]:
    """platt() of rows that sums, platt_sums() over all of them, stands for."""
    if not up or not down:
        return 1.0, 0.0
    a, b = 1.0, 0.0
    for _ in range(steps):
        s = sums(a, b)
        g = np.array([s[0] + 1e-3 * (a - 1), s[1]])
        h = np.array([[s[2] + 1e-3, s[3]], [s[3], s[4] + 1e-9]])
        step = np.linalg.lstsq(h, g, rcond=None)[0]
        step = np.clip(step, -1, 1)
        a, b = max(0.05, a - step[0]), b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 60, memory: int = 10, close: float = 1e-4) -> np.ndarray:
    """x where f, which gives value and gradient, is least: L-BFGS, until a step gains less than that share."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, parts = g / max(1.0, float(np.linalg.norm(g))), []
        if pairs:
            way = g.copy()
            for s, y in reversed(pairs):
                parts.append(s @ way / (s @ y))
                way -= parts[-1] * y
            way *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
            for (s, y), part in zip(pairs, reversed(parts)):
                way += (part - y @ way / (s @ y)) * s
        rate = 1.0
        while rate > 1e-6:
            now, now_g = f(x - rate * way)
            if now <= value - 1e-4 * rate * (g @ way):
                break
            rate /= 3
        else:
            return x
        s, y = -rate * way, now_g - g
        if s @ y > 1e-12:
            pairs = [*pairs[1 - memory :], (s, y)]
        gain, x, value, g = value - now, x + s, now, now_g
        if gain <= close * value:
            break
    return x
