"""Token counts as delta-maintained rollups.

Totals of documents, tokens and characters by source, language and tokenizer version are sums of
signed changes: an insert counts +1 and its tokens, a delete -1 and minus its tokens, a revision
both. A batch of changes is pre-aggregated to one row per group and written to a folder of its
own, named by the batch; it counts once its folder is complete. Committing a batch again finds
the folder and does nothing, and a batch that broke off is written anew: so every batch counts
exactly once. `compact` folds the batches that one look at the folder finds into a base; their names stay
known. A batch committed meanwhile is in the next one. Folders that an older base holds are deleted with the
compaction after it, so that who has just listed them can still read them.

Tokenizers are given by version; any Column expression counts tokens natively, and
`bpe_counts` counts with a public vocabulary file.

Cases: null texts have no tokens; null sources or languages are groups of their own; a group
whose totals have come to zero leaves the report; deletes may arrive before inserts; repeated
rows of a batch are so many changes; empty batches commit too; an id labelled twice counts as toxic if any
label says so, and as of low quality likewise; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remove, shared_folder

GROUP = ("source", "lang", "tokenizer")
SUMS = ("n_docs", "n_tokens", "n_chars")

#: Native tokenizers by version: white-space words; and runs of letters, up to three digits, single signs.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: _runs(text, r"[^\x20\x09-\x0D]+"),
    "pieces-2": lambda text: _runs(text, r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]{1,3}|[^A-Za-z0-9\x{80}-\x{10FFFF}\x20\x09-\x0D]"),
}


def _runs(text: Column, pattern: str) -> Column:
    """How many matches a pattern has that leaves only white space unmatched: each becomes one letter."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit("x"))
    return F.length(F.translate(marked, " \t\n\x0b\x0c\r", ""))


def counted(docs: DataFrame, tokenizers: dict[str, Callable[[Column], Column]] = TOKENIZERS, text: str = "text") -> Column:
    """An array with a struct (tokenizer, n_tokens, n_chars) for every version."""
    t = F.coalesce(text, F.lit(""))
    return F.array(*(F.struct(F.lit(v).alias("tokenizer"), f(t).cast("long").alias("n_tokens"), F.length(t).cast("long").alias("n_chars")) for v, f in sorted(tokenizers.items())))


def changes(docs: DataFrame, sign: int, tokenizers: dict[str, Callable[[Column], Column]] = TOKENIZERS) -> DataFrame:
    """Signed changes for rows of doc_id, source, lang, text: +1 inserts, -1 deletes."""
    rows = docs.select("source", "lang", F.explode(counted(docs, tokenizers)).alias("c"))
    return signed(rows.select("source", "lang", "c.*"), sign)


def signed(rows: DataFrame, sign: int) -> DataFrame:
    """Changes from counted rows (source, lang, tokenizer, n_tokens, n_chars)."""
    return rows.select(*GROUP, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"), (F.col("n_chars") * sign).alias("n_chars"))


def bpe_counts(docs: DataFrame, vocabulary: str, version: str) -> DataFrame:
    """source, lang, tokenizer, n_tokens, n_chars with a byte-pair vocabulary of tiktoken's form.

    `vocabulary` is a file of lines "base64 rank" that every executor can read.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import base64

        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            texts = b["text"].fillna("").tolist()
            yield pd.DataFrame({"source": b["source"], "lang": b["lang"], "tokenizer": version, "n_tokens": [len(encoder.encode_ordinary(t)) for t in texts], "n_chars": list(map(len, texts))})

    return docs.select("source", "lang", "text").mapInPandas(run, "source string, lang string, tokenizer string, n_tokens long, n_chars long")


class Rollup:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _complete(self, top: str) -> list[str]:
        if not self.fs.exists(self._path(top)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(top))]
        return sorted(n for n in names if self.fs.exists(self._path(f"{top}/{n}/_SUCCESS")))

    def _snapshot(self) -> tuple[str | None, list[str]]:
        """One look at the folder: the newest base, and the complete batches that aren't in it."""
        base, alone = max(self._complete("bases"), default=None), self._complete("batches")
        if base and alone:
            held = self._members(base).where(F.col("batch").isin(alone)).collect()  # of those that still have a folder
            alone = sorted(set(alone) - {r["batch"] for r in held})
        return base, alone

    def _members(self, base: str) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.folder}/members/{base}")

    def batches(self) -> list[str]:
        """The batches that count, whether they still stand alone or are part of the base."""
        base, alone = self._snapshot()
        return sorted({*alone, *((r["batch"] for r in self._members(base).collect()) if base else ())})

    def _known(self, batch: str) -> bool:
        base, alone = self._snapshot()
        return batch in alone or base is not None and not self._members(base).where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Adds a batch of changes; False if it has been committed before."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self._known(batch):
            return False
        sums = rows.groupBy(*GROUP).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))
        sums.write.mode("overwrite").parquet(f"{self.folder}/batches/{batch}")
        return True

    def _parts(self, base: str | None, alone: list[str]) -> DataFrame | None:
        paths = [f"{self.folder}/batches/{b}" for b in alone] + ([f"{self.folder}/bases/{base}"] if base else [])
        return self.spark.read.parquet(*paths) if paths else None

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens, n_chars; groups that have come to zero are gone."""
        return self._sums(self._parts(*self._snapshot()))

    def _sums(self, parts: DataFrame | None) -> DataFrame:
        if parts is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long")
        sums = parts.groupBy(*GROUP).agg(*(F.sum(c).cast("long").alias(c) for c in SUMS))
        return sums.where("n_docs != 0 or n_tokens != 0 or n_chars != 0")

    def compact(self) -> None:
        """Folds the batches of one snapshot into a new base. Its member list is complete before the base is."""
        base, alone = self._snapshot()
        if not alone:
            return
        new = f"{int(base or 0) + 1:012d}"
        names = self.spark.createDataFrame([(n,) for n in alone], "batch string")
        if base:
            names = names.unionByName(self._members(base))
        names.write.mode("overwrite").parquet(f"{self.folder}/members/{new}")
        self._sums(self._parts(base, alone)).write.mode("overwrite").parquet(f"{self.folder}/bases/{new}")
        if base:  # what the base before this one held has been folded twice
            standing = set(self._complete("batches")) - set(alone)
            for r in self._members(base).where(F.col("batch").isin(sorted(standing))).collect() if standing else ():
                self.fs.delete(self._path(f"batches/{r['batch']}"), True)
            for old in self._complete("bases"):
                if old < base:
                    self.fs.delete(self._path(f"bases/{old}"), True)
                    self.fs.delete(self._path(f"members/{old}"), True)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The totals after four commits: all documents inserted; those labelled toxic deleted; those
    labelled of low quality revised to their text without runs of signs; the deletes again, which
    changes nothing. Texts are counted in one pass; labels meet the counts, not the texts.
    """
    spark = docs.sparkSession
    plain = F.regexp_replace("text", r"[#$%&*@!|]+", "")
    both = docs.select("doc_id", "source", "lang", "text", plain.alias("plain"))
    counts = both.select("doc_id", "source", "lang", counted(both).alias("old"), counted(both, text="plain").alias("new"))
    counts = cut(counts)
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = cut(counts.join(marks.where("toxic = 1 or quality = 0"), "doc_id"))
    spread = lambda rows, c: rows.select("source", "lang", F.explode(c).alias("c")).select("source", "lang", "c.*")
    folder = f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    rollup = Rollup(spark, folder)
    toxic, poor = marked.where("toxic = 1"), marked.where("quality = 0 and (toxic is null or toxic <> 1)")
    rollup.commit("1-inserts", signed(spread(counts, "old"), 1))
    rollup.commit("2-deletes", signed(spread(toxic, "old"), -1))
    rollup.commit("3-revisions", signed(spread(poor, "old"), -1).unionByName(signed(spread(poor, "new"), 1)))
    rollup.commit("2-deletes", signed(spread(toxic, "old"), -1))
    totals = cut(rollup.totals())
    remove(spark, folder)
    return totals
