"""Readers of the file formats in use, each with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLES = "h int, r int, t int, w double"


def csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """SRC-04: with a header; only the columns asked for are parsed."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.select(*columns) if columns else df


def triples(spark: SparkSession, path: str) -> DataFrame:
    """SRC-05: h r t w, separated by blanks, without a header."""
    return spark.read.schema(TRIPLES).option("sep", " ").csv(path)


def json_object(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """SRC-06: key, value of a file that is one JSON object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def json_lines(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """SRC-07: one object a line; lines that don't parse are passed over."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return df if limit is None else df.limit(limit)


def tiered_lists(spark: SparkSession, path: str) -> DataFrame:
    """SRC-08: uid and lists pos, fair, neutral, easy from uid;pos;fair;neutral;easy; shorter lines go."""
    parts = F.split("value", ";")
    ints = lambda k: F.transform(F.filter(F.split(parts[k], ","), lambda x: F.trim(x) != ""), lambda x: x.cast("int"))
    rows = spark.read.text(path).where(F.size(parts) >= 5)
    return rows.select(parts[0].cast("int").alias("uid"), *[ints(k).alias(n) for k, n in enumerate(("pos", "fair", "neutral", "easy"), 1)])


def topic_lookup(topics: DataFrame) -> DataFrame:
    """SRC-09: key, topic_id, from rows (topic_id, name, keywords array): the name, its plain form and each keyword; names before keywords, then the smaller id."""
    low = F.lower(F.trim("name"))
    keys = F.concat(F.array(F.struct(F.lit(0).alias("rank"), low.alias("key")), F.struct(F.lit(1).alias("rank"), F.regexp_replace(low, "s$", "").alias("key"))), F.transform("keywords", lambda k: F.struct(F.lit(2).alias("rank"), F.lower(F.trim(k)).alias("key"))))
    each = topics.select("topic_id", F.explode(keys).alias("k")).select("topic_id", "k.rank", "k.key").where("key <> ''")
    return each.groupBy("key").agg(F.min(F.struct("rank", "topic_id"))["topic_id"].alias("topic_id"))


def matrix(spark: SparkSession, path: str, size: int, rows_per_part: int = 10_000) -> DataFrame:
    """SRC-10: row, v of a raw little-endian float32 matrix with rows of `size` numbers, record by record."""
    binary = spark.read.format("binaryFile").load(path)
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                x = np.frombuffer(content, "<f4").reshape(-1, size)
                for at in range(0, len(x), rows_per_part):
                    part = x[at : at + rows_per_part]
                    lists = pa.ListArray.from_arrays(np.arange(0, part.size + 1, size, dtype=np.int32), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part)), pa.int64()), lists], names=["path", "row", "v"])

    return binary.select("path", "content").mapInArrow(run, "path string, row long, v array<float>")


def exists(spark: SparkSession, table: str, column: str | None = None) -> bool:
    """SRC-18: whether a table, or a column of it, is in the catalogue."""
    return spark.catalog.tableExists(table) and (column is None or column in {c.name for c in spark.catalog.listColumns(table)})


def shards(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: the rows of all shard=N folders under path with their shard, to be ordered by it."""
    return spark.read.option("basePath", path).parquet(f"{path}/shard=*")


def in_turn(df: DataFrame, order: str, size: int = 1000):
    """SRC-02: the rows in order, in lists of size, a partition at a time on the driver; for small consumers of a large table."""
    held: list = []
    for row in df.orderBy(order).toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
