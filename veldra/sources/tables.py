"""Reading tables, current rows of versioned keys, and tables kept for later stages."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, parts: int | None = None) -> DataFrame:
    """A scan whose work per row outweighs moving it, over ``parts`` partitions; by
    default over ``veldra.scan.partitions`` of the session, and as it is where that is
    not set.  A table of many files, as on a cluster, has splits enough."""
    parts = parts or int(df.sparkSession.conf.get("veldra.scan.partitions", "0"))
    return df.repartition(parts) if parts else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where a session has none, one on this machine is made, for a local session only;
    on a cluster that is an error, as executors could not read each other's files.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and context._jsc.sc().getCheckpointDir().isDefined():
        folder = context._jsc.sc().getCheckpointDir().get()
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(Path(tempfile.mkdtemp(prefix="spark-")).as_uri())
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


_RELEASED = {"times": 0}


def released() -> int:
    """How often kept tables were deleted: what was remembered before is gone."""
    return _RELEASED["times"]


def _own_folder(spark: SparkSession):
    """This application's tables below the shared folder, which go when it ends."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/veldra-{context.applicationId}")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    files.deleteOnExit(path)
    return files, path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a frame into the shared folder and read it back.

    Cuts the lineage, so that a stage used several times is computed once and a
    lost executor costs no more than the tasks it ran.  The table is deleted when the
    application ends, or by ``release``.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)[1].toString()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all kept tables of the application; frames that read them end with that."""
    files, path = _own_folder(spark)
    files.delete(path, True)
    _RELEASED["times"] += 1


def fingerprint(column: Column, name: str) -> list[Column]:
    """128 bits that stand for a value, as two longs: equal values, equal longs."""
    return [F.xxhash64(column).alias(f"{name}1"), F.xxhash64(F.lit(name), column).alias(f"{name}2")]


def current_keys(rows: DataFrame, key: str, values: list[str], at: str = "ingested_at") -> DataFrame:
    """The values of the latest row of each key, for values of fixed width.

    Rows of null key are no rows.  Redelivered rows (all columns equal) give one
    row.  Every value is picked by its own ``max_by``, so that the aggregation
    stays a hash aggregation; equal times with unequal values would be an older
    version at the same instant, which the tables do not hold, and give the
    largest value of each.  A null time is older than any other.
    """
    time = F.coalesce(F.unix_micros(F.col(at).cast("timestamp")), F.lit(-(1 << 62)))
    return (
        rows.filter(F.col(key).isNotNull())
        .select(key, time.alias("_at"), *values)
        .groupBy(key)
        .agg(*[F.max_by(v, "_at").alias(v) for v in values])
    )


def current_rows(rows: DataFrame, key: str, at: str = "ingested_at") -> DataFrame:
    """Whole latest row of each key, once; rows of null key are no rows."""
    columns = [c for c in rows.columns if c not in (key, at)]
    # maps are neither comparable nor orderable, so the row is picked by the time alone
    return (
        rows.filter(F.col(key).isNotNull())
        .withColumn("_at", F.coalesce(F.col(at).cast("timestamp"), F.timestamp_seconds(F.lit(-(1 << 40)))))
        .groupBy(key)
        .agg(F.max_by(F.struct(*columns, at), "_at").alias("_row"))
        .select(key, "_row.*")
    )
