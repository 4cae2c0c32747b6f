"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A word is read twice: as a hashed word vector, and letter by letter (a convolution over its
characters, pooled by maximum). Two gated recurrent layers read a window of words from either
side, attention weighs their states, and a linear unit gives the window's logit. All windows of
WINDOW words, STRIDE apart, of the whole text are scored; the document has the highest one,
calibrated on the documents learnt from. Everything is numpy: training on the driver over a
bounded sample of labelled rows (see learning.sample), scoring in the executors.

Cases: null, empty and wordless texts are one empty window; words longer than PIECE letters are
read in pieces; without labels of both kinds every score is the share of toxic ones (0.5 if there
are none); repeated rows get equal scores; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, short_batches
from .learning import Adam, platt, sample, sigmoid

WINDOW, STRIDE, PIECE = 64, 48, 20
WORDS, CHARS = 1 << 13, 256
WORD_DIM, CHAR_DIM, FILTERS, WIDTH, HIDDEN, ATTENTION = 8, 6, 16, 4, 8, 8
#: A worker keeps the inputs of so many words at most.
KEPT_WORDS = 200_000
_WORD = re.compile(rf"\w{{1,{PIECE}}}")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Word buckets (0 is kept for no word) and character ids (0: none), a row a word."""
    buckets = np.fromiter((xxhash.xxh32_intdigest(w) for w in words), np.int64, len(words)) % (WORDS - 1) + 1
    points = np.array(words, f"<U{PIECE}").view(np.uint32).reshape(len(words), PIECE).astype(np.int64)
    chars = np.where(points == 0, 0, np.where(points < 128, points, 128 + points % (CHARS - 128)))
    edge = np.zeros((len(words), 1), np.int64)
    return buckets, np.concatenate([edge + 1, chars, edge], axis=1)  # 1: the word's start


def start(seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    inputs = WORD_DIM + FILTERS
    p = {"word": draw(WORDS, WORD_DIM, scale=0.1), "char": draw(CHARS, CHAR_DIM, scale=0.5), "conv": draw(WIDTH * CHAR_DIM, FILTERS, scale=0.3), "conv_b": np.zeros(FILTERS, np.float32)}
    for side in "fb":
        p |= {f"w{side}": draw(inputs, 3 * HIDDEN, scale=0.3), f"b{side}": np.zeros(3 * HIDDEN, np.float32), f"u{side}": draw(HIDDEN, 3 * HIDDEN, scale=0.3)}
    return p | {"att": draw(2 * HIDDEN, ATTENTION, scale=0.4), "att_b": np.zeros(ATTENTION, np.float32), "att_v": draw(ATTENTION, scale=0.4), "out": draw(2 * HIDDEN, scale=0.4), "out_b": np.zeros(1, np.float32)}


def word_inputs(p: dict, buckets: np.ndarray, chars: np.ndarray, keep: bool = False):
    """The vector of every word: its hashed vector beside its pooled character filters."""
    spread = p["char"][chars]  # n, PIECE + 2, CHAR_DIM
    spread[chars == 0] = 0
    n, length = chars.shape
    views = np.concatenate([spread[:, i : length - WIDTH + 1 + i] for i in range(WIDTH)], axis=2)
    maps = (views.reshape(-1, WIDTH * CHAR_DIM) @ p["conv"]).reshape(n, length - WIDTH + 1, FILTERS)
    top = maps.argmax(axis=1) if keep else None
    pooled = np.maximum(maps.max(axis=1) + p["conv_b"], 0)
    x = np.concatenate([p["word"][buckets], pooled], axis=1)
    return (x, views, top) if keep else x


def _gru(xw: np.ndarray, u: np.ndarray, mask: np.ndarray | None, steps, trace: list | None = None) -> np.ndarray:
    """The states of one direction: xw is (time, rows, 3 * HIDDEN) of input sums."""
    t_max, rows, _ = xw.shape
    h = np.zeros((rows, HIDDEN), np.float32)
    out = np.empty((t_max, rows, HIDDEN), np.float32)
    for t in steps:
        hu = h @ u
        gates = xw[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
        np.clip(gates, -30, 30, out=gates)
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        cand = np.tanh(xw[t, :, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
        new = cand + z * (h - cand)
        if mask is not None:
            new = np.where(mask[t][:, None], new, h)
        if trace is not None:
            trace.append((t, h, hu, r, z, cand))
        out[t] = h = new
    return out


def window_logits(p: dict, xf: np.ndarray, xb: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Logits of windows. ids: (windows, time) of rows of xf and xb, each word's input sums."""
    ids = ids.T
    t_max = len(ids)
    mask = None if (lengths == t_max).all() else np.arange(t_max)[:, None] < lengths[None, :]
    hf = _gru(xf[ids], p["uf"], mask, range(t_max))
    hb = _gru(xb[ids], p["ub"], mask, range(t_max - 1, -1, -1))
    e = np.tanh(hf @ p["att"][:HIDDEN] + hb @ p["att"][HIDDEN:] + p["att_b"]) @ p["att_v"]
    if mask is not None:
        e[~mask] = -np.inf
    e -= e.max(axis=0)
    a = np.exp(e)
    a /= a.sum(axis=0)
    votes = hf @ p["out"][:HIDDEN] + hb @ p["out"][HIDDEN:]
    return (a * votes).sum(axis=0) + p["out_b"][0]


def windows(n: int) -> list[tuple[int, int]]:
    """Start and length of the windows over n words; the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)]
    return [(at, WINDOW) for at in range(0, n - WINDOW, STRIDE)] + [(n - WINDOW, WINDOW)]


class Scorer:
    """Scores texts; keeps the input sums of words it has met."""

    def __init__(self, p: dict):
        self.p = p
        self.rows: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.rows.clear()
        x = np.zeros((1, WORD_DIM + FILTERS), np.float32)
        self.xf, self.xb = (x @ self.p[f"w{s}"] + self.p[f"b{s}"] for s in "fb")
        self.size = 1

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 20_000):
            some = words[at : at + 20_000]
            x = word_inputs(self.p, *encode(some))
            if self.size + len(some) > len(self.xf):
                room = max(2 * len(self.xf), self.size + len(some))
                self.xf, self.xb = (np.concatenate([a[: self.size], np.empty((room - self.size, 3 * HIDDEN), np.float32)]) for a in (self.xf, self.xb))
            for s, a in (("f", self.xf), ("b", self.xb)):
                a[self.size : self.size + len(some)] = x @ self.p[f"w{s}"] + self.p[f"b{s}"]
            self.rows.update(zip(some, range(self.size, self.size + len(some))))
            self.size += len(some)

    def logits(self, docs: list[list[str]]) -> list[np.ndarray]:
        """The logits of every document's windows."""
        if self.size > KEPT_WORDS:
            self._reset()
        new = set().union(*docs) - self.rows.keys() if docs else set()
        if new:
            self._learn(sorted(new))
        look = self.rows.__getitem__
        flat = np.fromiter((look(w) for words in docs for w in words), np.int64)
        spans, owners, base = [], [], 0
        for k, words in enumerate(docs):
            for at, n in windows(len(words)):
                spans.append((base + at, n))
                owners.append(k)
            base += len(words)
        spans, owners = np.array(spans, np.int64).reshape(-1, 2), np.array(owners, np.int64)
        flat = np.concatenate([flat, [0]])
        out = np.empty(len(spans), np.float32)
        order = np.argsort(spans[:, 1], kind="stable")
        for at in range(0, len(order), 2048):
            pick = order[at : at + 2048]
            n = np.maximum(spans[pick, 1], 1)
            place = spans[pick, :1] + np.arange(n.max())[None, :]
            ids = np.where(np.arange(n.max())[None, :] < spans[pick, 1:], flat[np.minimum(place, len(flat) - 1)], 0)
            out[pick] = window_logits(self.p, self.xf, self.xb, ids, n)
        return np.split(out, np.searchsorted(owners, np.arange(1, len(docs)))) if docs else []

    def highest(self, texts: list[str | None], piece: int = 150_000) -> np.ndarray:
        """The highest window logit of every text; about `piece` words are held at once."""
        out, held, n = [], [], 0
        for k, text in enumerate(texts):
            held.append(tokens(text))
            n += len(held[-1])
            if n >= piece or k == len(texts) - 1:
                out += [float(x.max()) for x in self.logits(held)]
                held, n = [], 0
        return np.array(out, np.float64)


def gradients(p: dict, buckets: np.ndarray, chars: np.ndarray, ids: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Loss and its gradients for a batch of windows; ids point to the words of buckets and chars."""
    x, views, top = word_inputs(p, buckets, chars, keep=True)
    ids, rows = ids.T, len(ids)
    t_max = len(ids)
    mask = np.arange(t_max)[:, None] < lengths[None, :]
    traces: dict[str, list] = {"f": [], "b": []}
    h = {s: _gru((x @ p[f"w{s}"] + p[f"b{s}"])[ids], p[f"u{s}"], mask, steps, traces[s]) for s, steps in (("f", range(t_max)), ("b", range(t_max - 1, -1, -1)))}
    both = np.concatenate([h["f"], h["b"]], axis=2)
    q = np.tanh(both @ p["att"] + p["att_b"])
    e = np.where(mask, q @ p["att_v"], -np.inf)
    a = np.exp(e - e.max(axis=0))
    a /= a.sum(axis=0)
    pooled = (a[:, :, None] * both).sum(axis=0)
    logit = pooled @ p["out"] + p["out_b"][0]
    prob = sigmoid(logit)
    loss = float(-(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)).mean())

    g = {k: np.zeros_like(v) for k, v in p.items()}
    d = ((prob - y) / rows).astype(np.float32)
    g["out"], g["out_b"] = pooled.T @ d, d.sum(keepdims=True)
    d_pooled = d[:, None] * p["out"]
    d_a = (both * d_pooled).sum(axis=2)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    g["att_v"] = np.tensordot(d_e, q, 2)
    d_q = d_e[:, :, None] * p["att_v"] * (1 - q * q)
    flat = d_q.reshape(-1, ATTENTION)
    g["att"], g["att_b"] = both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(axis=0)
    d_both = a[:, :, None] * d_pooled + d_q @ p["att"].T
    d_x = np.zeros_like(x)
    for s, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
        carry = np.zeros((rows, HIDDEN), np.float32)
        d_xw = np.zeros((t_max, rows, 3 * HIDDEN), np.float32)
        for t, before, hu, r, z, cand in reversed(traces[s]):
            now = d_both[t, :, part] + carry
            live = mask[t][:, None]
            d_h = np.where(live, now, 0)
            d_cand = d_h * (1 - z) * (1 - cand * cand)
            d_z = d_h * (before - cand) * z * (1 - z)
            d_r = d_cand * hu[:, 2 * HIDDEN :] * r * (1 - r)
            d_hu = np.concatenate([d_r, d_z, d_cand * r], axis=1)
            d_xw[t] = np.concatenate([d_r, d_z, d_cand], axis=1)
            g[f"u{s}"] += before.T @ d_hu
            carry = np.where(live, d_h * z + d_hu @ p[f"u{s}"].T, now)
        sums = np.zeros((len(x), 3 * HIDDEN), np.float32)
        np.add.at(sums, ids.ravel(), d_xw.reshape(-1, 3 * HIDDEN))
        g[f"w{s}"], g[f"b{s}"] = x.T @ sums, sums.sum(axis=0)
        d_x += sums @ p[f"w{s}"].T
    np.add.at(g["word"], buckets, d_x[:, :WORD_DIM])
    d_pool = d_x[:, WORD_DIM:] * (x[:, WORD_DIM:] > 0)
    g["conv_b"] = d_pool.sum(axis=0)
    n = np.arange(len(x))
    for k in range(FILTERS):
        at = top[:, k]
        g["conv"][:, k] = views[n, at].T @ d_pool[:, k]
        back = d_pool[:, k, None] * p["conv"][:, k]
        for i in range(WIDTH):
            np.add.at(g["char"], chars[n, at + i], back[:, i * CHAR_DIM : (i + 1) * CHAR_DIM])
    g["char"][0] = 0
    return loss, g


def _fit(p: dict, items: list[list[str]], y: np.ndarray, epochs: int, rate: float, rng: np.random.Generator, batch: int = 96) -> None:
    adam = Adam(p, rate)
    if len(items) < 20 * batch:  # few documents: smaller steps, and more rounds through them
        batch, epochs = max(16, len(items) // 20), 3 * epochs
    for epoch in range(epochs):
        adam.rate = rate * (1 - 0.7 * epoch / max(1, epochs))
        order = rng.permutation(len(items))
        order = np.concatenate([c[np.argsort([len(items[i]) for i in c], kind="stable")] for c in np.array_split(order, max(1, len(order) // (8 * batch)))])
        for at in rng.permutation(range(0, len(order), batch)):
            pick = order[at : at + batch]
            words = sorted(set().union(*(items[i] for i in pick)))
            row = dict(zip(words, range(1, len(words) + 1)))
            lengths = np.array([max(1, len(items[i])) for i in pick])
            ids = np.zeros((len(pick), lengths.max()), np.int64)
            for k, i in enumerate(pick):
                ids[k, : len(items[i])] = [row[w] for w in items[i]]
            buckets, chars = encode(words) if words else (np.zeros(0, np.int64), np.zeros((0, PIECE + 2), np.int64))
            # a word now and then loses its own vector, so that its letters have to tell
            buckets = np.where(rng.random(len(buckets)) < 0.4, 0, buckets)
            _, g = gradients(p, np.concatenate([[0], buckets]), np.concatenate([np.zeros((1, PIECE + 2), np.int64), chars]), ids, lengths, y[pick])
            g["word"][0] = 0
            p["word"][0] = 0
            adam.step(g)


def train(texts: list[str], y: np.ndarray, share: float | None = None, rounds: int = 4, epochs: int = 2, seed: int = 7) -> dict:
    """The network's arrays, with a and b of the calibration.

    First, texts of one or two windows are learnt from, whose label is their windows' label. Then,
    in rounds, every text by its highest window so far; of texts that aren't toxic also a window
    at random. `share` is the share of toxic texts among all labelled ones; the sample holds more.
    """
    rng = np.random.default_rng(seed)
    p = start(seed)
    p["word"][0] = 0
    if len(set(y.tolist())) < 2:
        return p | {"fixed": float(y.mean()) if len(y) else 0.5}
    docs = [tokens(t) for t in texts]
    spans = [windows(len(d)) for d in docs]
    short = [i for i, s in enumerate(spans) if len(s) <= 2]
    if len({float(y[i]) for i in short}) < 2:
        short = list(range(len(docs)))
    picks = [(i, k) for i in short for k in range(len(spans[i]))]
    for k in range(rounds + 1):
        items = [docs[i][spans[i][w][0] : spans[i][w][0] + spans[i][w][1]] for i, w in picks]
        _fit(p, items, np.array([y[i] for i, _ in picks], np.float32), epochs + 2 * (k == 0), 0.01 if k < 2 else 0.005 if k < rounds else 0.002, rng)
        scored = Scorer(p).logits(docs)
        top = [int(x.argmax()) for x in scored]
        picks = list({(i, top[i]) for i in range(len(docs))} | {(i, int(rng.integers(len(spans[i])))) for i in range(len(docs)) if not y[i]})
        picks.sort()
    a, b = platt(np.array([float(x.max()) for x in scored]), y)
    own = float(y.mean())
    share = own if share is None else min(max(share, 1e-3), 1 - 1e-3)
    return p | {"a": a, "b": b + float(np.log(share / (1 - share)) - np.log(own / (1 - own)))}


def score(docs: DataFrame, model: dict, cut: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs, over its whole text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = None if "fixed" in model else Scorer(model)
        for texts in batches:
            if scorer is None:
                yield pd.Series(np.full(len(texts), model["fixed"]))
            else:
                yield pd.Series(sigmoid(model["a"] * scorer.highest(texts.tolist()) + model["b"]))

    short_batches(docs.sparkSession)
    rows = docs.select("doc_id", (fold_of(F.col("doc_id")) == 2).alias("held_out"), F.pandas_udf(run, "double")("text").alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def report(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    return score(docs, train(*sample(docs, labels, "toxic")), cut)
