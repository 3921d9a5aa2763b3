"""Ranking metrics as grouped sums over ranked rows (query_id, rank, relevant 0/1, grade)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored


def ranking_metrics(ranked: DataFrame, k: int) -> DataFrame:
    """AGG-38: query_id, precision, recall, ndcg, ap at k. Gain is 2^grade - 1; the ideal order is by grade."""
    own = Window.partitionBy("query_id")
    rows = ranked.withColumn("hits", F.sum("relevant").over(own.orderBy("rank"))).withColumn("ideal", F.row_number().over(own.orderBy(F.desc("grade"), "rank")))
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    at = lambda place: F.sum(F.when(F.col(place) <= k, gain / F.log2(F.col(place) + 1)).otherwise(0.0))
    top = F.col("rank") <= k
    found = F.sum(F.when(top, F.col("relevant")).otherwise(0))
    sums = rows.groupBy("query_id").agg(
        found.alias("found"), F.sum("relevant").alias("all"), at("rank").alias("dcg"), at("ideal").alias("best"), F.sum(F.when(top & (F.col("relevant") == 1), F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap")
    )
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return sums.select("query_id", (F.col("found") / k).alias("precision"), ratio("found", "all").alias("recall"), ratio("dcg", "best").alias("ndcg"), F.when(F.col("all") > 0, F.col("ap") / F.least("all", F.lit(k))).otherwise(0.0).alias("ap"))


def auc(scored: DataFrame) -> DataFrame:
    """AGG-38: one row, the area under the curve of (score, y) from counts by score: ties count half. Scores are summed up in range partitions, whose totals (a row each) are put in order."""
    by = scored.groupBy("score").agg(F.sum(F.col("y")).alias("p"), F.sum(1 - F.col("y")).alias("n"))
    parts = stored(by.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    first, at = [], 0
    for r in parts.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():
        first.append((r["part"], at))
        at += r["n"]
    offsets = F.broadcast(scored.sparkSession.createDataFrame(first, "part int, before long"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = parts.join(offsets, "part").withColumn("below", F.col("before") + inside)
    return pairs.agg((F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("n"))) / (F.sum("p") * F.sum("n"))).alias("auc"))
