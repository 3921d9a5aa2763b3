"""Incremental synchronisation: marker scans in batch, and streams that upsert or accumulate batch by batch.

The stream's checkpoint takes the place of markers and progress rows. A batch is written under its own number and
overwritten when it is replayed, so a restart never counts anything twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)


def after_marker(df: DataFrame, marker: DataFrame, column: str, tie: str) -> DataFrame:
    """STM-01: rows after the marker (one row, column marker; null: all rows), in order."""
    rows = df.crossJoin(F.broadcast(marker)).where(F.col("marker").isNull() | (F.col(column) > F.col("marker"))).drop("marker")
    return rows.orderBy(column, tie)


def _place(spark: SparkSession, path: str) -> tuple:
    """The path and its file system, in whatever store it lies."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def there(spark: SparkSession, path: str) -> bool:
    """Whether a path exists."""
    place, fs = _place(spark, path)
    return fs.exists(place)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of a marker's versions, whole or not."""
    place, fs = _place(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(place)] if fs.exists(place) else []
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def stored_marker(spark: SparkSession, path: str, default: str = "1970-01-01") -> DataFrame:
    """STM-02: the marker table of a task, its newest whole version, or the default where none is stored."""
    whole = [v for v in _versions(spark, path) if there(spark, f"{path}/v={v}/_SUCCESS")]
    if whole:
        return spark.read.schema("marker string").parquet(f"{path}/v={whole[-1]}")
    return spark.sql(f"select '{default}' as marker")


def marker_set(spark: SparkSession, path: str, marker: str | None) -> None:
    """STM-02: stores a task's marker as a version of its own, then drops older ones: a stop in between leaves one that is whole. None resets it to the default."""
    before = _versions(spark, path)
    if marker is not None:
        spark.createDataFrame([(marker,)], "marker string").coalesce(1).write.parquet(f"{path}/v={max(before, default=0) + 1}")
        gone = [f"{path}/v={v}" for v in before]
    else:
        gone = [path] if there(spark, path) else []
    for x in gone:
        place, fs = _place(spark, x)
        fs.delete(place, True)


def in_shards(df: DataFrame, key: str, shards: int, path: str) -> list[int]:
    """STM-06: df by shards of its key's hash, each a folder that appears when it is whole; those that are there are passed over. The numbers of those written, all in one reading of df."""
    spark = df.sparkSession
    missing = [k for k in range(shards) if not there(spark, f"{path}/shard={k}")]
    if missing:
        rows = df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")).where(F.col("shard").isin(missing))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)
        for k in missing:  # a shard without rows is an empty folder
            place, fs = _place(spark, f"{path}/shard={k}")
            fs.mkdirs(place)
    return missing


def crawl_state(done: DataFrame, planned: DataFrame) -> DataFrame:
    """STM-07: task, cursor, done, total, completed from finished pages (task, page, cursor) and planned ones (task, pages)."""
    last = done.groupBy("task").agg(F.max_by("cursor", "page").alias("cursor"), F.countDistinct("page").alias("done"))
    rows = planned.join(last, "task", "left").select("task", "cursor", F.coalesce("done", F.lit(0)).alias("done"), F.col("pages").alias("total"))
    return rows.withColumn("completed", F.col("done") >= F.col("total"))


def source(spark: SparkSession, path: str, schema: T.StructType = EVENTS, files: int = 1) -> DataFrame:
    """A stream of the Parquet files under path, `files` a batch."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in schema.names else rows


def synchronised(stream: DataFrame, target: str, checkpoint: str, processor: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """STM-03, FLT-26: each batch, through a row processor that may drop rows, into its own folder of target, all at once."""

    def put(batch: DataFrame, number: int) -> None:
        processor(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def accumulated(stream: DataFrame, keys: list[str], value: str, late: str = "10 minutes") -> DataFrame:
    """STM-04: running sums by key; repeated event_ids within the watermark count once."""
    once = stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(*keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))


def windowed(stream: DataFrame, keys: list[str], value: str, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Sums by event-time window; rows later than the watermark are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", size), *keys).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
