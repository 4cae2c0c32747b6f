"""Requests in: from files or streams, with the checks that come before any work on a body."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakwork.config import Config

SCHEMA = "request_id string, method string, path string, query string, content_length long, transfer_encoding string, body string"
# Messages of rejected requests.
INVALID, EMPTY, TOO_LARGE = "invalid json request body", "empty json request body", "request body too large"
BODILESS_METHODS = ("GET", "HEAD", "DELETE")


def read(spark: SparkSession, path: str, form: str = "json") -> DataFrame:
    """Requests from a folder of JSON lines or another format that Spark reads."""
    reader = spark.read.format(form)
    return (reader if form == "parquet" else reader.schema(SCHEMA)).load(path)


def stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Requests from files of JSON lines as they arrive."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def has_body(method: Column, length: Column, encoding: Column) -> Column:
    chunked = F.coalesce(F.trim(encoding) != "", F.lit(False))
    positive = F.coalesce(length > 0, F.lit(False))
    return chunked | F.when(F.upper(method).isin(*BODILESS_METHODS), positive).otherwise(length.isNull() | positive)


def bypassed(path: Column, config: Config = Config()) -> Column:
    """Requests that are none of ours: all when switched off, and the health path."""
    if not config.enabled:
        return F.lit(True)
    health = config.observability
    return F.coalesce(F.lower(path) == health.health_path.lower(), F.lit(False)) if health.health_check else F.lit(False)


def too_large(body: Column, length: Column, config: Config = Config()) -> Column:
    """By the declared length or by the bytes that there are, whichever says so."""
    return F.coalesce(length > config.max_body_bytes, F.lit(False)) | F.coalesce(F.octet_length(body) > config.max_body_bytes, F.lit(False))


def parse_status(body: Column) -> Column:
    """struct(status, message): 200, or 400 for what is no JSON or nothing but null."""
    v = F.try_parse_json(body)
    bad = F.struct(F.lit(400).alias("status"), F.lit(INVALID).alias("message"))
    empty = F.struct(F.lit(400).alias("status"), F.lit(EMPTY).alias("message"))
    return F.when(v.isNull(), bad).when(F.is_variant_null(v), empty).otherwise(F.struct(F.lit(200).alias("status"), F.lit(None).cast("string").alias("message")))


def checked(requests: DataFrame, config: Config = Config()) -> DataFrame:
    """requests with bypassed, with_body, status and message (status 200: go on)."""
    length, encoding = F.col("content_length"), F.col("transfer_encoding")
    big = F.struct(F.lit(413).alias("status"), F.lit(TOO_LARGE).alias("message"))
    fine = F.struct(F.lit(200).alias("status"), F.lit(None).cast("string").alias("message"))
    df = requests.withColumn("bypassed", bypassed(F.col("path"), config)).withColumn("with_body", has_body(F.col("method"), length, encoding))
    outcome = F.when(F.col("bypassed"), fine).when(too_large(F.col("body"), length, config), big).when(~F.col("with_body"), fine).otherwise(parse_status(F.col("body")))
    return df.withColumn("_o", outcome).select(*df.columns, "_o.status", "_o.message")


def outbound(df: DataFrame, body: str = "body") -> DataFrame:
    """df with what follows from a new body: content_type, content_length, no transfer_encoding."""
    return df.withColumns({"content_type": F.lit("application/json; charset=utf-8"), "content_length": F.octet_length(body).cast("long"), "transfer_encoding": F.lit(None).cast("string")})
