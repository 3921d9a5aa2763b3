"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are broadcast only when this many bytes at most were counted first; as a hash table on the driver they take some ten times that.
BROADCAST_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; only sessions of one process without one (tests) get their own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not re.fullmatch(r"local(\[[^\],]+(,\s*\d+)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that driver and executors share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "lodestone-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """df, stored in the shared checkpoint folder: computed once, and safe when executors are lost."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def compact(df: DataFrame, rows: int = 200_000) -> tuple[DataFrame, int]:
    """df stored, read back in one partition for about so many rows, and its number of rows: small tables then make few shuffle files."""
    kept = cut(df)
    n = kept.count()
    return kept.coalesce(max(1, -(-n // rows))), n


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows fit BROADCAST_BYTES, else as it is (a shuffled join)."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def without_ids(documents: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose key is not among ids (distinct, stored); null keys stay. A small set is broadcast after it was counted."""
    gone = fresh(documents, "_gone")
    ids = ids.select(F.col(key).alias(gone))
    n = ids.count()
    if n == 0:
        return documents
    return documents.join(small(ids, n, 24), F.col(key) == F.col(gone), "left_anti")
