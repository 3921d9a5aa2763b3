"""Writers: JSON, JSON lines, triples, CSV, snapshots. Spark's commit makes each all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    """SNK-14/15: one object a line."""
    df.write.mode("overwrite").json(path)


def triples(df: DataFrame, path: str) -> None:
    """SNK-16."""
    df.select("h", "r", "t", "w").write.mode("overwrite").option("sep", " ").csv(path)


def appended_csv(df: DataFrame, path: str) -> None:
    """SNK-17."""
    df.write.mode("append").option("header", True).csv(path)


def input_digest(df: DataFrame) -> str:
    """A digest of a table's rows in any order, from sums over all of them."""
    h = F.xxhash64(*df.columns)
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.sum(F.xxhash64(h).cast("decimal(38,0)"))).first()
    return f"{n}-{a}-{b}"


def snapshot(df: DataFrame, path: str, inputs: DataFrame) -> DataFrame:
    """SNK-20: df as stored for just these inputs; computed and stored if they are new."""
    place = f"{path}/{input_digest(inputs)}"
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{place}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        df.write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
