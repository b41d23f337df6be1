"""Tables, and frames written to the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Paths of what is kept for a session's further queries.
KEPT: dict[tuple, str] = {}
#: Bytes of the tables that make a bucket of what is kept of them.
BUCKET_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def joins_by_hints(spark: SparkSession) -> None:
    """From here on, only what is marked by F.broadcast goes to the driver and to all executors. Spark's estimates are
    the bytes of files, which are encoded, and leave out what explode multiplies: 600 MB were taken for under 10.
    And frames that are dealt out by case are joined by case and more where they are; a union is dealt out anew, as
    its parts may have other numbers of partitions once small ones are put together."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir. Where that is unset it becomes a local folder, if driver and
    executors are one process, as in tests; a cluster has to name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")

        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved_at(df: DataFrame, name: str, by: str | None = None, parts: int | None = None) -> tuple[DataFrame, str]:
    path = shared_folder(df.sparkSession, name)
    if by:
        df.write.option("path", path).bucketBy(parts, by).saveAsTable(bucketed(path), format="parquet")
        return df.sparkSession.table(bucketed(path)), path
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def bucketed(path: str) -> str:
    """Name of the table at path, which knows that it is dealt out."""
    return re.sub(r"\W", "_", path.rsplit("/", 1)[1])


def saved(df: DataFrame, name: str, by: str | None = None, parts: int | None = None) -> DataFrame:
    """df, written to the shared folder and read again: its lineage ends there and it is worked out once. by: a column
    that df is dealt out by, into so many parts; what is read then needs no other shuffle by it."""
    return saved_at(df, name, by, parts)[0]


def hadoop(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes what was saved, once nothing reads it any more."""
    files, at = hadoop(spark, path)
    files.delete(at, True)


def state(spark: SparkSession, path: str) -> tuple:
    """Number of files, bytes and time of a table's last change."""
    files, at = hadoop(spark, path)
    sums, own = files.getContentSummary(at), files.getFileStatus(at)
    return sums.getFileCount(), sums.getLength(), own.getModificationTime()


def buckets(spark: SparkSession, folder: str, tables: tuple[str, ...]) -> int:
    """Parts that rows of these tables are dealt out into: two a core, or more where they are larger."""
    return max(2 * spark.sparkContext.defaultParallelism, sum(state(spark, f"{folder}/{t}.parquet")[1] for t in tables) // BUCKET_BYTES)


def kept(spark: SparkSession, folder: str, tables: tuple[str, ...], name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """make(), saved once a session for the tables as they are now: another state of one of them, or a saved
    table that is gone, has it made again. by: a column that it is dealt out by, into the tables' number of buckets."""
    states = tuple(state(spark, f"{folder}/{t}.parquet") for t in tables)
    key = (spark.sparkContext.applicationId, folder, name, states)
    path = KEPT.get(key)
    if path:
        files, at = hadoop(spark, f"{path}/_SUCCESS")
        if files.exists(at):
            return spark.table(bucketed(path)) if by else spark.read.parquet(path)
    df, KEPT[key] = saved_at(make(), name, by, buckets(spark, folder, tables) if by else None)
    return df
