"""Mixing sources to target weights by iterative proportional fitting.

Documents' tokens are summed by source, language and topic. Raking scales the cells' weights in
turn until the weighted tokens meet the target shares of every margin. A document is then kept
with its cell's probability: the weights, scaled to the budget, are raked on with the cap of 1 inside
the loop, so that the expected tokens of the draw meet the target shares of the budget and not the
weights alone. A category that has fewer tokens than its target of the budget is kept whole, and the
others of its margin share the rest in the ratio of their targets. The draw is a hash of the
document's id: the same documents are kept in any run, order or number of partitions.

Topics are learnt: spherical k-means over hashed words weighed by tf-idf, fitted on the whole texts of all
documents, each of which is then assigned to its nearest topic. Texts are read once, to histograms in the
shared folder; the same pass packs them, many texts a pack, and puts each pack into one of its batch's rows.
Idf, the k-means++ start and every step are a pass over the packs alone. The start takes one pass for all centres: a centre is the text of least chance / distance, and
as no distance is above 1, texts of a greater chance than the least such key can't be it. Only if none of the
texts picked by chance proves to be it is a centre looked for in a pass of its own. Sums are of whole numbers,
so that any order and number of partitions learns the very same topics. A column of that name takes their
place if there is one.

Cases: null sources, languages or topics are a category of their own; null or empty texts have no
tokens and are kept with their cell's probability, or 0 if the cell has no tokens; null ids are drawn
by their text; repeated rows of an id are kept or left together; texts of any length are read whole;
of equally near topics the first counts; targets for categories that aren't there have no
effect, categories without a target share 0; margins that can't all be met (empty cells) are met
as closely as the rounds get; columns of docs named like a result (`weight`, `probability`, `n_tokens`) are
never read: mix() puts the computed ones in their place; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, cut, remove, short_batches

MARGINS = ("source", "lang", "topic")
TOPICS = 8
#: Up to so many cells are raked on the driver (and broadcast); more are raked as a table.
DRIVER_CELLS = 100_000
ROUNDS, CLOSE = 200, 1e-9
#: Weights stay within; where margins contradict each other they would grow without end.
WITHIN = (1e-9, 1e9)
KEPT_WORDS = 200_000
#: Words are hashed to WORDS places; k-means takes at most STEPS steps.
WORDS, STEPS = 1 << 12, 25
#: Histograms of up to so many places together are held by the driver (6 bytes a place); more are read in every pass.
DRIVER_PLACES = 1 << 20
#: Rows are computed on in pieces of about so many places.
_PIECE = 1 << 16
#: Histograms are packed into rows of about so many places, so that the usual batches of rows stay small.
_PACK = 1 << 10
#: So many texts are picked by chance for each centre that k-means starts with.
_PICKED = 64
#: Texts are hashed together up to so many bytes, words so many at a time.
_BYTES, _AT_ONCE = 1 << 20, 1 << 17
#: Components of unit vectors are summed as multiples of 1 / _UNIT.
_UNIT = float(1 << 30)
#: The tasks' sums are added up by so many tasks before the driver adds theirs.
_ADDERS = 4


#: White space as str.split() has it: bytes of ASCII, and characters beyond.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
_FAR_SPACES = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: XXH64's primes.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_SEED = 3


class _Places(dict):
    """word -> its place among WORDS."""

    def __missing__(self, word: str) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        self[word] = place = xxhash.xxh64_intdigest(word, _SEED) % WORDS
        return place


def _uses(places: _Places, text: str | None) -> np.ndarray:
    """How often the text uses each place."""
    return np.bincount([*map(places.__getitem__, (text or "").lower().split())], minlength=WORDS) if text else np.zeros(WORDS, np.int64)


def _histogram(uses: np.ndarray) -> tuple[bytes, bytes]:
    """The places that are used, and the logarithm of 1 + how often each is."""
    at = np.flatnonzero(uses)
    return at.astype(np.uint16).tobytes(), np.log1p(uses[at]).astype(np.float32).tobytes()


def _lowered(text: str | None) -> bytes:
    """The text in small letters, all white space beyond ASCII as spaces."""
    text = (text or "").lower()
    if not text.isascii():
        for c in _FAR_SPACES:
            if c in text:
                text = text.replace(c, " ")
    return text.encode()


def _turned(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _short_hashes(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """XXH64 of the words of so many bytes, less than 32, that start there; 8 more bytes follow the last."""
    eights = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    h = np.full(len(starts), int(_P5) + _SEED + size, np.uint64)
    for at in range(0, size - 7, 8):
        h ^= _turned(eights[starts + at].view("<u8")[:, 0] * _P2, 31) * _P1
        h = _turned(h, 27) * _P1 + _P4
    if rest := size % 8:
        last = eights[starts + (size - rest)].view("<u8")[:, 0]
        if rest >= 4:
            h ^= (last & np.uint64(0xFFFFFFFF)) * _P1
            h = _turned(h, 23) * _P2 + _P3
        for byte in range(rest // 4 * 4, rest):
            h ^= (last >> np.uint64(8 * byte) & np.uint64(0xFF)) * _P5
            h = _turned(h, 11) * _P1
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _word_places(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The place of every word, as _Places has it."""
    out = np.empty(len(starts), np.uint32)
    for a in range(0, len(starts), _AT_ONCE):
        own, n = starts[a : a + _AT_ONCE], np.minimum(sizes[a : a + _AT_ONCE], 32).astype(np.uint8)
        order, ends = np.argsort(n, kind="stable"), np.cumsum(np.bincount(n, minlength=33))
        for size in range(1, 33):
            if len(some := order[ends[size - 1] : ends[size]]):
                if size < 32:
                    out[a + some] = _short_hashes(data, own[some], size) % np.uint64(WORDS)
                else:
                    out[a + some] = [xxhash.xxh64_intdigest(data[s : s + k].tobytes(), _SEED) % WORDS for s, k in zip(own[some], sizes[a + some])]
    return out


def _histograms(texts: Sequence[str | None]) -> Iterator[tuple[int, bytes, bytes]]:
    """Every text's number of words, and its _histogram()."""
    held, size = [], 0
    for text in texts:
        held.append(_lowered(text))
        size += len(held[-1])
        if size >= _BYTES or len(held) * WORDS >= 1 << 31:
            yield from _histograms_of(held)
            held, size = [], 0
    yield from _histograms_of(held)


def _histograms_of(texts: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    data = np.frombuffer(b" ".join([b"", *texts, b" " * 8]), np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts = edges[::2]
    first = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in texts)]))
    n = np.diff(first)
    keys = _word_places(data, starts, edges[1::2] - starts)
    keys += np.repeat(np.arange(len(texts), dtype=np.uint32) * np.uint32(WORDS), n)
    keys.sort()
    at = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint32(1)))
    found = keys[at]
    places, logs = (found % WORDS).astype(np.uint16), np.log1p(np.diff(at, append=len(keys))).astype(np.float32)
    ends = np.searchsorted(found, np.arange(len(texts) + 1) * WORDS)
    for words, a, b in zip(n.tolist(), ends, ends[1:]):
        yield words, places[a:b].tobytes(), logs[a:b].tobytes()


@dataclass
class _Rows:
    """Histograms of some texts, one after the other; none is empty."""

    h: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    places: np.ndarray
    logs: np.ndarray


#: h, the numbers of places, the places, the logs' numbers in _LOGS and those logs that aren't in it, of some texts, one after the other.
_Pack = tuple[bytes, bytes, bytes, bytes, bytes]
_PACKED = ["h", "sizes", "places", "codes", "more"]
#: The logs of 1 to 255 uses, a byte each in a pack; 255 stands for any other.
_LOGS = np.log1p(np.arange(1, 256)).astype(np.float32)


def _runs(sizes: Sequence[int], most: int) -> Iterator[slice]:
    """Runs of items, of about so much together."""
    run = np.cumsum(sizes) // most
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    return map(slice, starts, [*starts[1:], len(sizes)])


def _packs(h: Sequence[int], places: Sequence[bytes], logs: Sequence[bytes]) -> Iterator[_Pack]:
    """The histograms that aren't empty, in packs of about _PACK places."""
    some = [i for i, p in enumerate(places) if p]
    h, places, logs = np.asarray(h, np.int64)[some], [places[i] for i in some], [logs[i] for i in some]
    sizes = np.fromiter(map(len, places), np.int64, len(some)) // 2
    for own in _runs(sizes, _PACK):
        x = np.frombuffer(b"".join(logs[own]), np.float32)
        codes = np.minimum(np.searchsorted(_LOGS, x), len(_LOGS) - 1)
        codes[_LOGS[codes] != x] = len(_LOGS)
        yield h[own].tobytes(), sizes[own].astype(np.uint16).tobytes(), b"".join(places[own]), codes.astype(np.uint8).tobytes(), x[codes == len(_LOGS)].tobytes()


def _taken_apart(packs: Sequence[_Pack]) -> Iterator[_Pack]:
    """A pack for each text of the packs."""
    for h, sizes, places, codes, more in packs:
        at = used = 0
        for i, n in enumerate(np.frombuffer(sizes, np.uint16).tolist()):
            own = codes[at : at + n]
            others = 4 * own.count(len(_LOGS))
            yield h[8 * i : 8 * i + 8], sizes[2 * i : 2 * i + 2], places[2 * at : 2 * (at + n)], own, more[used : used + others]
            at, used = at + n, used + others


def _pieces(packs: Sequence[_Pack]) -> Iterator[_Rows]:
    """The packs in pieces of about _PIECE places."""
    for own in _runs([len(p[2]) // 2 for p in packs], _PIECE):
        kinds = np.uint64, np.uint16, np.uint16, np.uint8, np.float32
        h, sizes, places, codes, more = (np.frombuffer(b"".join(parts), kind) for parts, kind in zip(zip(*packs[own]), kinds))
        n, logs = sizes.astype(np.int64), np.take(_LOGS, codes, mode="clip")
        if len(more):
            logs[codes == len(_LOGS)] = more
        yield _Rows(h, np.cumsum(n) - n, n, places.astype(np.intp), logs)


def _luck(h: np.ndarray, turn: int) -> np.ndarray:
    """A number in (0, 1] for each text's hash, another in every turn."""
    x = h + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54


#: h, places and logs of a row; those with the row's key before them.
_Row = tuple[int, bytes, bytes]
_Found = tuple[float, int, bytes, bytes]


class _Held:
    """Passes over histograms that the driver holds."""

    def __init__(self, packs: Sequence[_Pack]):
        self.pieces = [*_pieces(packs)]

    def total(self, work: Callable[[_Rows], np.ndarray], size: int) -> np.ndarray:
        """The sum of work(piece), whole numbers, over all pieces."""
        return sum(map(work, self.pieces), np.zeros(size, np.int64))

    def first(self, work: Callable[[_Rows], np.ndarray]) -> _Found | None:
        """The row of the least finite work(piece), and of equal ones of the least hash."""
        return min((x for p in self.pieces if (x := _first(p, work(p)))), default=None)

    def where(self, work: Callable[[_Rows], np.ndarray]) -> list[_Row]:
        """The rows, each once, that work(piece) is true of."""
        return [*{r for p in self.pieces for r in _where(p, work(p))}]


class _Stored:
    """The same over a table of packs."""

    def __init__(self, table: DataFrame):
        self.table = table.select(*_PACKED)

    def _each(self, run: Callable[[Iterator[_Rows]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
        def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return run(piece for b in batches for piece in _pieces([*zip(*(b[c] for c in _PACKED))]))

        return self.table.mapInPandas(over, schema)

    def total(self, work: Callable[[_Rows], np.ndarray], size: int) -> np.ndarray:
        def run(pieces: Iterator[_Rows]) -> Iterator[pd.DataFrame]:
            own = np.zeros(size, np.int64)
            for piece in pieces:
                own += work(piece)
            yield pd.DataFrame({"v": [own.tobytes()]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            own = np.zeros(size, np.int64)
            for b in batches:
                for v in b["v"]:
                    own += np.frombuffer(v, np.int64)
            yield pd.DataFrame({"v": [own.tobytes()]})

        sums = self._each(run, "v binary").repartition(_ADDERS).mapInPandas(add, "v binary").collect()
        return sum((np.frombuffer(r["v"], np.int64) for r in sums), np.zeros(size, np.int64))

    def first(self, work: Callable[[_Rows], np.ndarray]) -> _Found | None:
        def run(pieces: Iterator[_Rows]) -> Iterator[pd.DataFrame]:
            best = min((x for piece in pieces if (x := _first(piece, work(piece)))), default=None)
            yield pd.DataFrame([best] if best else [], columns=["key", "h", "places", "logs"])

        rows = self._each(run, "key double, h long, places binary, logs binary")
        best = rows.orderBy("key", "h", "places", "logs").limit(1).collect()
        return (best[0]["key"], best[0]["h"], bytes(best[0]["places"]), bytes(best[0]["logs"])) if best else None

    def where(self, work: Callable[[_Rows], np.ndarray]) -> list[_Row]:
        def run(pieces: Iterator[_Rows]) -> Iterator[pd.DataFrame]:
            yield pd.DataFrame([*{r for piece in pieces for r in _where(piece, work(piece))}], columns=["h", "places", "logs"])

        rows = self._each(run, "h long, places binary, logs binary").distinct()
        return [(r["h"], bytes(r["places"]), bytes(r["logs"])) for r in rows.collect()]


def _row(rows: _Rows, i: int) -> _Row:
    own = slice(rows.starts[i], rows.starts[i] + rows.sizes[i])
    return int(rows.h.view(np.int64)[i]), rows.places[own].astype(np.uint16).tobytes(), rows.logs[own].tobytes()


def _first(rows: _Rows, keys: np.ndarray) -> _Found | None:
    i = np.lexsort((rows.h.view(np.int64), keys))[0]
    return (float(keys[i]), *_row(rows, i)) if np.isfinite(keys[i]) else None


def _where(rows: _Rows, true: np.ndarray) -> Iterator[_Row]:
    return (_row(rows, i) for i in np.flatnonzero(true))


def _picked(rows: _Rows, k: int, chance: float) -> np.ndarray:
    """Whether a row's key can be chance or less in the race for any of k centres."""
    return np.any([-np.log(_luck(rows.h, turn)) <= chance for turn in range(k)], axis=0)


class Topics:
    """Spherical k-means over tf-idf. Texts without words have no topic; of no texts there is one topic."""

    def __init__(self, texts: list[str], k: int = TOPICS):
        rows = [(xxhash.xxh64_intdigest(t, 42), p, n) for t, (_, p, n) in zip(texts, _histograms(texts)) if p]
        h, at, n = zip(*rows) if rows else ((), (), ())
        self._fit(_Held([*_packs(np.array(h, np.uint64).view(np.int64), at, n)]), len(rows), k)

    @classmethod
    def of(cls, table: DataFrame, k: int = TOPICS) -> Topics:
        """Of all packs of a table of histograms."""
        packs = table.where("pack is not null").select("pack.*")
        n, size = packs.agg(F.sum(F.length("sizes")), F.sum(F.length("places"))).first()
        passes = _Stored(packs)
        if (size or 0) // 2 <= DRIVER_PLACES:
            passes = _Held([*map(tuple, passes.table.collect())])
        self = cls.__new__(cls)
        self._fit(passes, (n or 0) // 2, k)
        return self

    def _fit(self, passes: _Held | _Stored, n: int, k: int) -> None:
        have = passes.total(lambda rows: np.bincount(rows.places, minlength=WORDS), WORDS)
        self.idf, self.centres = np.log((1 + n) / (1 + have)), np.zeros((0, WORDS))
        chance = _PICKED / max(n, 1)
        picked = _Held([*_packs(*zip(*rows))]) if (rows := passes.where(lambda rows: _picked(rows, k, chance))) else _Held([])
        while len(self.centres) < k:  # k-means++ by a race: the next is as likely as it is far from those that there are
            best = picked.first(self._race)
            if best is None or best[0] > chance:  # one that isn't picked may be before it
                best = passes.first(self._race)
            if best is None:
                break
            weights, _ = self._vectors(next(_pieces([*_packs(*zip(best[1:]))])))
            centre = np.zeros((1, WORDS))
            centre[0, np.frombuffer(best[2], np.uint16)] = weights
            self.centres = np.concatenate([self.centres, centre])
        if not len(self.centres):
            self.centres = np.zeros((1, WORDS))
        for _ in range(STEPS):
            sums = passes.total(self._sums, self.centres.size).reshape(self.centres.shape) / _UNIT
            sums = np.where(sums.any(axis=1, keepdims=True), sums, self.centres)
            sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
            done, self.centres = np.allclose(sums, self.centres), sums
            if done:
                break

    def _vectors(self, rows: _Rows) -> tuple[np.ndarray, np.ndarray]:
        """The unit vectors' components, and whether each row has any."""
        x = rows.logs * self.idf[rows.places]
        norm = np.sqrt(np.add.reduceat(x * x, rows.starts))
        return x / np.repeat(np.maximum(norm, 1e-12), rows.sizes), norm > 0

    def _cosines(self, rows: _Rows, x: np.ndarray) -> np.ndarray:
        return np.stack([np.add.reduceat(np.take(c, rows.places) * x, rows.starts) for c in self.centres], axis=1)

    def _race(self, rows: _Rows) -> np.ndarray:
        x, some = self._vectors(rows)
        far = 1 - self._cosines(rows, x).max(axis=1) if len(self.centres) else np.ones(len(some))
        some &= far > 1e-9
        return np.divide(-np.log(_luck(rows.h, len(self.centres))), far, out=np.full(len(far), np.inf), where=some)

    def _sums(self, rows: _Rows) -> np.ndarray:
        x, _ = self._vectors(rows)
        own = self._cosines(rows, x).argmax(axis=1)
        return np.bincount(np.repeat(own * WORDS, rows.sizes) + rows.places, np.rint(x * _UNIT), self.centres.size).astype(np.int64)

    def topics(self, places: Sequence[bytes], logs: Sequence[bytes]) -> list[str | None]:
        """The topic of every histogram."""
        return self._of_packs([i for i, p in enumerate(places) if p], [*_packs(np.zeros(len(places), np.int64), places, logs)], len(places))

    def topics_of_packs(self, packs: Sequence[_Pack | None]) -> list[str | None]:
        """The topic of every pack of one text; none for a text without words."""
        some = [i for i, p in enumerate(packs) if p]
        return self._of_packs(some, [packs[i] for i in some], len(packs))

    def _of_packs(self, some: list[int], packs: Sequence[_Pack], n: int) -> list[str | None]:
        """The topics of the packs' texts at the places some of n."""
        out: list[str | None] = [None] * n
        found = (self._cosines(rows, self._vectors(rows)[0]).argmax(axis=1) for rows in _pieces(packs))
        for i, j in zip(some, (int(j) for piece in found for j in piece)):
            out[i] = f"topic{j}"
        return out

    def topic(self, uses: np.ndarray) -> str | None:
        places, logs = _histogram(uses)
        return self.topics([places], [logs])[0]


def _measured(h: Sequence[int], texts: Sequence[str | None]) -> pd.DataFrame:
    """n_tokens and the histogram (a pack of its own; null without words) of every text, and in the first rows all packs of the batch."""
    n, places, logs = zip(*_histograms(texts)) if len(texts) else ((), (), ())
    packs = [*_packs(h, places, logs)]
    alone = _taken_apart(packs)
    out = pd.DataFrame({"n_tokens": n}, dtype=np.int64)
    rows = [next(alone)[1:] if p else (None,) * 4 for p in places]
    out[_PACKED[1:]] = pd.DataFrame(rows, columns=_PACKED[1:], dtype=object)
    out[[f"pack_{c}" for c in _PACKED]] = pd.DataFrame(packs + [(None,) * len(_PACKED)] * (len(texts) - len(packs)), columns=_PACKED, dtype=object)
    return out


def histograms(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, draw, n_tokens (white-space words), sizes, places, codes, more (its histogram; null without words), pack (null in most rows)."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for h, texts in batches:
            yield _measured(h, texts)

    short_batches(docs.sparkSession)
    kinds = ", ".join(f"{c}:binary" for c in [*_PACKED[1:], *(f"pack_{c}" for c in _PACKED)])
    read = F.pandas_udf(run, f"struct<n_tokens:long, {kinds}>")(F.xxhash64("text"), "text").alias("x")
    rows = docs.select("doc_id", "source", "lang", draw_of(docs).alias("draw"), read)
    pack = F.when(F.col("x.pack_h").isNotNull(), F.struct(*(F.col(f"x.pack_{c}").alias(c) for c in _PACKED)))
    return rows.select("doc_id", "source", "lang", "draw", "x.n_tokens", *(f"x.{c}" for c in _PACKED[1:]), pack.alias("pack"))


def learnt(docs: DataFrame) -> Topics | None:
    """The topics of docs, of all their texts; none if it names its own."""
    return _learnt_and_measured(docs)[0]


def _learnt_and_measured(docs: DataFrame) -> tuple[Topics | None, DataFrame]:
    """The topics of docs, and doc_id, source, lang, topic, n_tokens, draw of every row by them."""
    short_batches(docs.sparkSession)
    if "topic" in docs.columns:
        rows = docs.select("doc_id", "source", "lang", "topic", _read(None).alias("x"), draw_of(docs).alias("draw"))
        return None, cut(rows.select("doc_id", "source", "lang", "topic", "x.n_tokens", "draw"))
    step = Steps(docs.sparkSession)
    held = step(histograms(docs))
    topics = Topics.of(held)

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series(topics.topics_of_packs([(bytes(8), *p) if p[0] else None for p in zip(*columns)]), dtype=object)

    rows = cut(held.select("doc_id", "source", "lang", F.pandas_udf(run, "string")(*_PACKED[1:]).alias("topic"), "n_tokens", "draw"))
    remove(docs.sparkSession, step.folder)
    return topics, rows


def _read(topics: Topics | None, text: str = "text") -> Column:
    """struct(n_tokens, topic) of a text column, in one pass."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            n, places, logs = zip(*_histograms(texts)) if len(texts) else ((), (), ())
            yield pd.DataFrame({"n_tokens": n, "topic": topics.topics(places, logs) if topics else None}, columns=["n_tokens", "topic"])

    return F.pandas_udf(run, "struct<n_tokens:long,topic:string>")(text)


def draw_of(docs: DataFrame, seed: int = 17) -> Column:
    """A number in [0, 1) from the document's id."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.coalesce("text", F.lit(""))))
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def _categories(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in MARGINS})


def tempered(shares: dict[str, float], power: float) -> dict[str, float]:
    """Shares to the power, and to sum 1: below 1, small categories gain."""
    raised = {k: v**power if v > 0 else 0.0 for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total if total else 0.0 for k, v in raised.items()}


def wanted_shares(held: dict[str, float], power: float, given: dict[str, float] | None) -> dict[str, float]:
    """The target shares of a margin's categories: those given, as far as the categories are there, or tempered ones."""
    if given is None:
        return tempered(held, power)
    some = {k: max(0.0, given.get(k, 0.0)) for k in held}
    total = sum(some.values())
    return {k: v / total if total else 0.0 for k, v in some.items()}


def rake(index: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Weights of cells. index: (cells, margins) category numbers; targets: shares by category."""
    weights, total = np.ones(len(tokens)), tokens.sum()
    if not total:
        return weights
    for _ in range(rounds):
        off = 0.0
        for m, target in enumerate(targets):
            sums = np.bincount(index[:, m], weights * tokens, len(target))
            factor = np.divide(target * total, sums, out=np.ones(len(target)), where=sums > 0)
            off = max(off, float(np.abs(factor[sums > 0] - 1).max(initial=0)))
            weights = np.clip(weights * factor[index[:, m]], *WITHIN)
        if off < close:
            break
    return weights


def scale(tokens: np.ndarray, weights: np.ndarray, budget: float) -> float:
    """c such that sum(min(1, c * weights) * tokens) is the budget, or all that there is."""
    live = (weights > 0) & (tokens > 0)
    t, w = tokens[live], weights[live]
    if not len(t) or budget >= t.sum():
        return float("inf")
    order = np.argsort(-w, kind="stable")
    t, w = t[order], w[order]
    full = np.concatenate([[0], np.cumsum(t)])[:-1]  # tokens of those whose probability is 1 before this one
    rest = (t * w)[::-1].cumsum()[::-1]
    c = (budget - full) / rest
    fits = np.nonzero(c * w <= 1 + 1e-12)[0]
    return float(c[fits[0]])


def reachable(shares: np.ndarray, held: np.ndarray, budget: float) -> np.ndarray:
    """The tokens of every category: the budget by the shares, and no more than a category has."""
    full = held <= 0
    while True:
        left, open_shares = budget - held[full].sum(), shares[~full].sum()
        wanted = np.where(full, held, shares * (left / open_shares if open_shares > 0 else 0.0))
        if not (wanted > held).any():
            return wanted
        full |= wanted >= held


def calibrate(index: np.ndarray, tokens: np.ndarray, targets: list[np.ndarray], chances: np.ndarray, budget: float, rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Chances of cells, of which min(1, chance) * tokens meets the targets of the budget in every margin."""
    for _ in range(rounds):
        off = 0.0
        for m, target in enumerate(targets):
            held = np.bincount(index[:, m], tokens, len(target))
            wanted = reachable(target, held, budget)
            capped = chances >= 1
            sure = np.bincount(index[:, m], tokens * capped, len(target))
            rest = np.bincount(index[:, m], tokens * chances * ~capped, len(target))
            off = max(off, float(np.abs(np.divide(sure + rest, wanted, out=np.ones(len(target)), where=wanted > 0) - 1).max(initial=0)))
            # above 1 other cells may stop at 1 too, which the next round makes up for
            by_all = np.divide(wanted, sure + rest, out=np.ones(len(target)), where=sure + rest > 0)
            factor = np.divide(wanted - sure, rest, out=by_all, where=(rest > 0) & (wanted > sure))
            factor = np.where(wanted >= held * (1 - 1e-12), WITHIN[1] / WITHIN[0], factor)
            chances = np.clip(chances * factor[index[:, m]], *WITHIN)
        if off < close:
            break
    return chances


Targets = dict[str, dict[str, float]]


def probabilities(cells: DataFrame, power: dict[str, float], budget_share: float, limit: int = DRIVER_CELLS, targets_by: Targets | None = None) -> DataFrame:
    """cells (source, lang, topic, tokens) with weight and probability.

    targets_by: for some margins the target share of each category; the others' follow from power.
    """
    spark, targets_by = cells.sparkSession, targets_by or {}
    known = cells.limit(limit + 1).collect()
    if len(known) > limit:
        return _probabilities_by_table(cells, power, budget_share, targets_by)
    known.sort(key=lambda r: tuple(r[c] for c in MARGINS))
    tokens = np.array([float(r["tokens"]) for r in known])
    index, targets = np.zeros((len(known), len(MARGINS)), np.int64), []
    for m, c in enumerate(MARGINS):
        names, index[:, m] = np.unique([r[c] for r in known], return_inverse=True) if known else ([], 0)
        sums = np.bincount(index[:, m], tokens, len(names)) if known else np.zeros(0)
        shares = wanted_shares(dict(zip(names, sums / max(sums.sum(), 1))), power[c], targets_by.get(c))
        targets.append(np.array([shares[n] for n in names]))
    weights, budget = rake(index, tokens, targets), budget_share * tokens.sum()
    chances = weights
    if 0 < budget < tokens.sum():
        chances = calibrate(index, tokens, targets, weights * scale(tokens, weights, budget), budget)
    c = scale(tokens, chances, budget)
    p = np.where(tokens > 0, np.minimum(1.0, np.where(chances > 0, c * np.maximum(chances, 1e-300), 0.0)), 0.0)
    for m, target in enumerate(targets):
        p = np.where(target[index[:, m]] > 0, p, 0.0) if len(p) else p
    rows = [(r["source"], r["lang"], r["topic"], float(w), float(x)) for r, w, x in zip(known, weights, p)]
    return spark.createDataFrame(rows, "source string, lang string, topic string, weight double, probability double")


def _probabilities_by_table(cells: DataFrame, power: dict[str, float], budget_share: float, targets_by: Targets) -> DataFrame:
    """The same for any number of cells: each round of raking is a sum and a join by category.

    Rounds are cut to the shared folder; the scale is found by bisection over sums.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    step = Steps(cells.sparkSession)
    now = step(cells.withColumn("weight", F.lit(1.0)))
    targets = {}
    for c in MARGINS:
        raised = F.pow(F.sum("tokens") / total, F.lit(power[c]))
        if c in targets_by:
            given = targets_by[c]
            table = F.create_map(*(x for k, v in given.items() for x in (F.lit(k), F.lit(max(0.0, float(v)))))) if given else F.lit(None).cast("map<string,double>")
            raised = F.coalesce(F.try_element_at(table, F.col(c)), F.lit(0.0))
        sums = cells.groupBy(c).agg(F.sum("tokens").alias("held"), raised.alias("raised")).where("held > 0 or raised >= 0").select(c, "raised")
        whole = float(sums.agg(F.sum("raised")).first()[0])
        targets[c] = cut(sums.select(c, (F.col("raised") / (whole or 1.0) * total).alias("target")))
    for _ in range(ROUNDS):
        off = 0.0
        for c in MARGINS:
            sums = now.groupBy(c).agg(F.sum(F.col("weight") * F.col("tokens")).alias("held"))
            factor = sums.join(targets[c], c).select(c, F.when(F.col("held") > 0, F.col("target") / F.col("held")).otherwise(1.0).alias("factor"), "held")
            off = max(off, float(factor.where("held > 0").agg(F.max(F.abs(F.col("factor") - 1))).first()[0] or 0))
            now = now.join(factor.drop("held"), c).withColumn("weight", F.greatest(F.lit(WITHIN[0]), F.least(F.lit(WITHIN[1]), F.col("weight") * F.col("factor")))).drop("factor")
        now = step(now)
        if off < CLOSE:
            break
    budget = budget_share * total
    now = now.withColumn("chance", F.col("weight"))
    if 0 < budget < total:
        now = _calibrate_by_table(now.withColumn("chance", F.lit(_scale_by_table(now, budget)) * F.col("chance")), targets, total, budget)
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(_scale_by_table(now, budget)) * F.col("chance"))).otherwise(0.0)
    none = now.select(*MARGINS, "weight", p.alias("probability"))
    for c in MARGINS:  # categories without a target share nothing
        none = none.join(targets[c].select(c, (F.col("target") > 0).alias("some")), c).withColumn("probability", F.when(F.col("some"), F.col("probability")).otherwise(0.0)).drop("some")
    return none


def _scale_by_table(now: DataFrame, budget: float) -> float:
    """scale() for the column chance: 31 values at once between two bounds, 12 times over."""

    def kept(tried: list[float]) -> list[float]:
        return [x or 0 for x in now.agg(*(F.sum(F.least(F.lit(1.0), F.lit(c) * F.col("chance")) * F.col("tokens")) for c in tried)).first()]

    low, high = 0.0, 1.0
    while kept([high])[0] < budget * (1 - 1e-12) and high < 1e12:
        high *= 2
    for _ in range(12):
        tried = [low + (high - low) * k / 32 for k in range(1, 32)]
        enough = [c for c, x in zip(tried, kept(tried)) if x >= budget]
        low, high = max([low, *(c for c in tried if c < min(enough, default=high))]), min(enough, default=high)
    return high


def _calibrate_by_table(now: DataFrame, targets: dict[str, DataFrame], total: float, budget: float) -> DataFrame:
    """calibrate() for the column chance: each step is a sum and a join by category."""
    wanted = {}
    for c in MARGINS:
        sums = cut(now.groupBy(c).agg(F.sum("tokens").cast("double").alias("has")).join(targets[c], c).withColumn("target", F.col("target") / total))
        ratio, before = 0.0, -1.0
        while ratio > before:  # a larger ratio fills more categories, which leaves more to the others
            full = (F.col("has") <= 0) | (F.lit(ratio) * F.col("target") >= F.col("has"))
            held, open_shares = sums.agg(F.sum(F.when(full, F.col("has")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("target")))).first()
            if not open_shares:
                break
            before, ratio = ratio, max(ratio, (budget - held) / open_shares)
        wish = F.when(full, F.col("has")).otherwise(F.lit(ratio) * F.col("target"))
        wanted[c] = cut(sums.select(c, "has", wish.alias("wanted")))
    capped, step = F.col("chance") >= 1, Steps(now.sparkSession)
    for _ in range(ROUNDS):
        off = 0.0
        for c in MARGINS:
            sums = now.groupBy(c).agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)).cast("double").alias("sure"), F.sum(F.when(capped, 0.0).otherwise(F.col("tokens") * F.col("chance"))).alias("rest"))
            sums = sums.join(wanted[c], c)
            by_all = F.when(F.col("sure") + F.col("rest") > 0, F.col("wanted") / (F.col("sure") + F.col("rest"))).otherwise(1.0)
            factor = F.when(F.col("wanted") >= F.col("has") * (1 - 1e-12), F.lit(WITHIN[1] / WITHIN[0])).when((F.col("rest") > 0) & (F.col("wanted") > F.col("sure")), (F.col("wanted") - F.col("sure")) / F.col("rest")).otherwise(by_all)
            change = sums.select(c, factor.alias("factor"), F.when(F.col("wanted") > 0, F.abs((F.col("sure") + F.col("rest")) / F.col("wanted") - 1)).otherwise(0.0).alias("off"))
            off = max(off, float(change.agg(F.max("off")).first()[0] or 0))
            now = now.join(change.drop("off"), c).withColumn("chance", F.greatest(F.lit(WITHIN[0]), F.least(F.lit(WITHIN[1]), F.col("chance") * F.col("factor")))).drop("factor")
        now = step(now)
        if off < CLOSE:
            break
    return now


#: How targets follow from the corpus: its shares to these powers.
POWER = {"source": 0.5, "lang": 0.7, "topic": 0.0}
BUDGET = 0.5


def weighed(docs: DataFrame, power: dict[str, float] | None = None, budget_share: float = BUDGET, limit: int = DRIVER_CELLS, targets_by: Targets | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept for every document.

    targets_by: target shares by margin (source, lang, topic) and category, such as {"source": {"web": 0.4,
    "books": 0.6}}; a null category is the empty string. Margins without get tempered shares of the corpus.
    """
    rows = _categories(_learnt_and_measured(docs)[1])
    cells = rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens"))
    odds = probabilities(cells, power or POWER, budget_share, limit, targets_by)
    joined = rows.join(odds, list(MARGINS))
    return joined.select("doc_id", *MARGINS, "n_tokens", "weight", "probability", (F.col("draw") < F.col("probability")).alias("kept"))


def mix(docs: DataFrame, power: dict[str, float] | None = None, budget_share: float = BUDGET, limit: int = DRIVER_CELLS, targets_by: Targets | None = None) -> DataFrame:
    """The documents drawn, with their columns, topic, n_tokens, weight and probability.

    Texts are read whole twice and shuffled only if there are more cells than the driver rakes.
    """
    topics, rows = _learnt_and_measured(docs)
    rows = _categories(rows)
    cells = cut(rows.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    odds = probabilities(cells, power or POWER, budget_share, limit, targets_by)
    few = cells.limit(limit + 1).count() <= limit

    found = docs.select(F.struct("*").alias("row"), draw_of(docs).alias("draw"), _read(topics).alias("x"))
    topic = F.col("x.topic") if topics else F.col("row.topic")
    found = found.select("row", "draw", F.col("x.n_tokens").alias("n_tokens"), F.col("row.source").alias("source"), F.col("row.lang").alias("lang"), topic.alias("topic"))
    joined = _categories(found).join(F.broadcast(odds) if few else odds, list(MARGINS)).where(F.col("draw") < F.col("probability"))
    own = [F.col(c) if c in ("n_tokens", "weight", "probability") else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return joined.select(*own, *(c for c in ("topic", "n_tokens", "weight", "probability") if c not in docs.columns))
