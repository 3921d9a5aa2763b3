"""Property-graph steps on edge tables (src, dst, ...) and knowledge-graph triples (h, r, t)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def expanded(frontier: DataFrame, edges: DataFrame, least: float = 0.0, top: int | None = None) -> DataFrame:
    """JOIN-19/21, WIN-03: anchor, dst, score over edges of at least `least`; the top ones of each anchor, ties by dst."""
    out = frontier.select("anchor").join(edges.where(F.col("score") >= least), F.col("anchor") == F.col("src")).select("anchor", "dst", "score")
    if top is None:
        return out
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "dst"))
    return out.withColumn("_r", rank).where(F.col("_r") <= top).drop("_r")


def symmetric_closure(triples: DataFrame, relations: int) -> DataFrame:
    """SET-06: each triple and its inverse, whose relation is higher by the number of relations."""
    return triples.unionByName(triples.select(F.col("t").alias("h"), (F.col("r") + relations).alias("r"), F.col("h").alias("t")))


def sampled(triples: DataFrame, seeds: DataFrame, inner_relation: int) -> DataFrame:
    """JOIN-32: triples that touch a seed, and those of inner_relation between two ends that these reach."""
    first = triples.join(seeds.select(F.col("id").alias("h")), "h", "left_semi").unionByName(triples.join(seeds.select(F.col("id").alias("t")), "t", "left_semi").select(*triples.columns))
    reached = first.select(F.col("h").alias("id")).unionByName(first.select(F.col("t").alias("id"))).distinct()
    second = triples.where(F.col("r") == inner_relation).join(reached.select(F.col("id").alias("h")), "h", "left_semi").join(reached.select(F.col("id").alias("t")), "t", "left_semi")
    return first.select("h", "r", "t").unionByName(second.select("h", "r", "t")).distinct()


def dense_ids(nodes: DataFrame, key: str, offset: int = 0) -> DataFrame:
    """Node keys numbered from offset in order of key: a key's place in its range partition, after all partitions before it."""
    place = F.monotonically_increasing_id()
    ordered = stored(nodes.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key).withColumn("_place", place))
    part = F.shiftright("_place", 33)
    first, at = [], offset
    for r in ordered.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row per partition
        first.append((r["part"], at))
        at += r["count"]
    if not first:
        return ordered.select(key, F.lit(0).cast("long").alias("id"))
    starts = F.broadcast(nodes.sparkSession.createDataFrame(first, "_part long, _first long"))
    return ordered.join(starts, part == F.col("_part")).select(key, (F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"))


def neighbour_sum(edges: DataFrame, features: DataFrame) -> DataFrame:
    """AGG-41: h, dim, value: features (id, dim, value) of neighbours summed by edge weight w."""
    return edges.join(features.withColumnRenamed("id", "t"), "t").groupBy("h", "dim").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
