"""Delimited files, logs and files by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import from_hex


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Comma-separated with a header; the schema is given, never inferred."""
    return spark.read.csv(path, header=True, schema=schema)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Two columns without a header: (k, v)."""
    return spark.read.csv(path, schema="k int, v bigint")


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated, nothing quoted."""
    return spark.read.csv(path, sep="\t", quote="", schema=schema)


def read_reference_ids(spark: SparkSession, path: str) -> DataFrame:
    """(source_paper, ref_paper) of a tab-separated file of hexadecimal ids."""
    rows = read_tsv(spark, path, "s string, r string")
    return rows.select(from_hex("s").alias("source_paper"), from_hex("r").alias("ref_paper"))


def read_semicolons(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Semicolon-separated and quoted, with a header; empty fields are null."""
    return spark.read.csv(path, sep=";", quote='"', header=True, nullValue="", emptyValue="", schema=schema)


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """(line, seconds) of ``TRACK:<seconds>`` lines of a log."""
    rows = spark.read.text(path).select(F.regexp_extract("value", r"TRACK:([0-9.]+)", 1).try_cast("double").alias("seconds"), F.monotonically_increasing_id().alias("line"))
    return rows.where("seconds is not null").select("line", "seconds")


def read_log_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(kind, id, title) of ``SOURCE id:title`` and ``REF id:title`` lines."""
    m = lambda g: F.regexp_extract("value", r"(SOURCE|REF) ([0-9A-Fa-f]+):(.*)$", g)
    return spark.read.text(path).select(m(1).alias("kind"), m(2).alias("id"), F.trim(m(3)).alias("title")).where("kind != ''")


def write_id_lists(df: DataFrame, key: str, ids: str, path: str) -> None:
    """Key and its ids, joined by spaces, as CSV."""
    df.select(key, F.array_join(F.col(ids).cast("array<string>"), " ").alias("ids")).write.mode("overwrite").csv(path)


def write_reports(df: DataFrame, path: str) -> None:
    """Text files of df(outcome, line), a folder for each outcome."""
    df.select("outcome", "line").write.mode("overwrite").partitionBy("outcome").text(path)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)
