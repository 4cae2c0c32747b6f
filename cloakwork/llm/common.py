"""What the operators of this folder share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the ASCII capitals and small letters of the contracts' "lower-case A-Z".
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _own_folder(spark: SparkSession, prefix: str) -> str:
    """A temporary folder, on one machine only: on a cluster it would be another folder on every machine."""
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix=prefix)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared checkpoint folder and read them back.

    The folder is the session's ``spark.checkpoint.dir``; a temporary one is set only where
    that is unset and the session runs on one machine, as in tests.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", "") and context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_own_folder(spark, "cloakwork-checkpoint-"))
    return df.checkpoint(eager=True)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, CAPITALS, SMALL)


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out. A null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4, F.lit(2))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt evenly to as many tasks as a shuffle has, or as there are cores if these are more.

    What a shuffle or a checkpoint gives back is coalesced by its bytes; rows that each start much
    work are dealt anew.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(n, *columns)


#: Texts go to Python and back in batches of at most so many rows.
BATCH = 1000


def short_batches(spark: SparkSession) -> None:
    """Texts are long: the usual batches of 10,000 rows would take hundreds of megabytes on both sides.

    Sets the session's limit, unless it has a lower one.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


#: At most so many keys are held to be hot.
HOT_KEYS = 200


def join_hot(rows: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined to keyed, which has one row a key and, in column n, how many rows have the key.

    The HOT_KEYS most frequent keys are broadcast (so many rows at most), so that none of them is one
    task's work; all others meet by shuffle. Give tables that are cheap to read twice.
    """
    hot = cut(keyed.orderBy(F.desc(n), key).limit(HOT_KEYS))
    names = hot.select(F.col(key).alias("_hot"))
    some = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(names), rows[key] == names["_hot"], "left_anti")
    return some.unionByName(rest.join(keyed, key).select(*some.columns))


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A checkpointed table of a few short columns, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where none is set, on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else _own_folder(spark, "cloakwork-shared-")
    return folder.rstrip("/")


def remove(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any store that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Steps:
    """The tables of an iteration: each is written to the shared folder, and the one before it deleted.

    Unlike a checkpoint, a table that is read back has its true size. A checkpoint keeps the estimate of
    its plan, and where every step joins the last with itself, that estimate's digits double with each
    step, until planning alone takes for ever.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, None

    def __call__(self, df: DataFrame) -> DataFrame:
        folder = f"{shared_folder(self.spark)}/step-{uuid.uuid4().hex}"
        df.write.parquet(folder)
        if self.folder:
            remove(self.spark, self.folder)
        self.folder = folder
        return self.spark.read.schema(df.schema).parquet(folder)
