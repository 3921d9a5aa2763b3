"""Results that are computed once and kept in the folder that the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_kept: dict[tuple, DataFrame] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, set as the checkpoints' folder. A session of one process may do without (tests); on a cluster a local folder would be no one else's."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^\],]+(,\s*\d+)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "lodestone-checkpoints"))
    return sc.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a folder in the shared one that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def stored(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a small table that go to all tasks at once.
FEW = 1_000_000


def few(rows: DataFrame) -> DataFrame:
    """rows, stored, for all tasks at once if they are no more than FEW."""
    kept = stored(rows)
    return F.broadcast(kept) if kept.count() <= FEW else kept


def written(df: DataFrame) -> DataFrame:
    """df from Parquet files in the shared folder, which go with the application: many rows take a fraction of a checkpoint's place there, but how they were partitioned is lost."""
    spark = df.sparkSession
    path = new_folder(spark, "table")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    df.write.parquet(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files under path, which change when they are written anew."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found, files = [], fs.listFiles(place, True) if fs.exists(place) else None
    while files is not None and files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def once(spark: SparkSession, name: str, path: str, make: Callable[[], DataFrame], *settings: object, keep: Callable[[DataFrame], DataFrame] = stored) -> DataFrame:
    """What make gives, stored (or kept otherwise); a later call of the application with the same name and settings gets the same table while the files under path are the same."""
    key = (spark.sparkContext.applicationId, name, path, repr(settings), state_of(spark, path))
    if key not in _kept:
        for old in [k for k in _kept if k[0] != key[0] or k[1:4] == key[1:4]]:
            del _kept[old]
        _kept[key] = keep(make())
    return _kept[key]


def forget(name: str | None = None, path: str | None = None) -> None:
    """Lets go of what once keeps: of that name, of that path, or all of it."""
    for k in [k for k in _kept if (name is None or k[1] == name) and (path is None or k[2] == path)]:
        del _kept[k]
