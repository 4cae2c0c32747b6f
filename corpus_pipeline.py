"""The training-data pipeline: five stages over documents, each written and read again.

run() writes every stage's rows as Parquet to the folder that driver and executors share
(spark.checkpoint.dir) and reads them back as the next stage's input; a stage's rows are deleted once the
next one's are written, so that the last table alone remains.

Cases, in every stage: null and empty texts pass as their operator says; null ids and repeated rows stay
rows of their own; other columns, whatever their names, are handed on; an empty table gives an empty one;
texts of any length are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import decontaminate, mixing, nearcopies, pii, quality, simhash
from cloakwork.llm.common import remove, shared_folder, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. A null text is judged as an empty one."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays: by operator 4's links and by five-word shingles.

    Groups are of texts and not of ids: see simhash.one_of_each for repeated ids. Rows without an id stay;
    all wordless texts are one group.
    """
    return simhash.one_of_each(docs, also=nearcopies.links(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Wordless texts and items hold none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the name of its kind; n_chars follows. Null texts stay null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A draw of documents that meets the target shares; adds topic, n_tokens, weight, probability, where no
    column has the name already. Rows of one id are kept or left together; null ids are drawn by their text."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: The trained and the near-copy stages are beyond SQL; the tests check every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, f"{folder}/{before}")
        before = name
    return docs
