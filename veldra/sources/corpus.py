"""A directory tree of Markdown and plain files as a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decoded(content: Column) -> Column:
    """Bytes as UTF-8; malformed ones become substitution marks."""
    return F.make_valid_utf8(content.cast("string"))


def root_of(spark: SparkSession, folder: str) -> str:
    """The whole URI of a folder on any file system that Spark reads; an error where it is
    missing, so that it is never taken for an empty corpus."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path) or not files.getFileStatus(path).isDirectory():
        raise FileNotFoundError(folder)
    return files.makeQualified(path).toString().rstrip("/")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text, hash, size, modified`` of every document file below a folder.

    Files and directories whose name starts with a dot or an underscore are left
    out (Spark does not list them).  A missing folder is an error; an empty folder is
    an empty corpus.
    """
    root = root_of(spark, folder)
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.expr(f"substring(path, instr(path, {_literal(root + '/')}) + {len(root) + 1})")
    named = read.withColumn("path", path).filter(F.col("path").rlike(r"\.(md|markdown|txt)$"))
    return named.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), decoded(F.col("content")).alias("text"))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
