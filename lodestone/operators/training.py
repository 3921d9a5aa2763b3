"""Labels, samples and features for training a ranker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def graded(rows: DataFrame) -> DataFrame:
    """ML-03, RUL-12: label_source, train_y, sample_weight from gold grades 0..2 (2 positive, 1 left out of training) or a weak label."""
    source = F.when(F.col("gold").isNotNull(), "gold").when(F.col("weak").isNotNull(), "weak").otherwise("unlabeled")
    y = F.when(F.col("gold") >= 2, 1).when(F.col("gold") == 0, 0).when(F.col("gold") == 1, None).otherwise(F.col("weak"))
    weight = F.when(F.col("gold") == 1, 0.0).when(F.col("gold").isNotNull(), 1.0).when(F.col("weak").isNotNull(), 0.3).otherwise(0.0)
    return rows.withColumn("label_source", source).withColumn("train_y", y).withColumn("sample_weight", weight)


def _drawn(seed: int, *keys: str) -> Column:
    """A string whose order is as good as random, the same in every run and engine."""
    return F.md5(F.concat_ws("|", F.lit(seed).cast("string"), *[F.col(k).cast("string") for k in keys]))


def tiered_negatives(pool: DataFrame, per_query: int, seed: int = 42) -> DataFrame:
    """ML-01: of each query per_query negatives: 40 % fair, 40 % neutral, 20 % easy; what a tier lacks comes from the next ones."""
    share = F.when(F.col("tier") == "fair", 0.4).when(F.col("tier") == "neutral", 0.4).otherwise(0.2)
    level = F.when(F.col("tier") == "fair", 0).when(F.col("tier") == "neutral", 1).otherwise(2)
    inside = F.row_number().over(Window.partitionBy("query_id", "tier").orderBy(_drawn(seed, "query_id", "author_id"), "author_id"))
    rows = pool.withColumn("in_share", (inside <= F.round(share * per_query)).cast("int")).withColumn("level", level).withColumn("r", inside)
    chosen = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("in_share"), "level", "r", "author_id"))
    return rows.withColumn("n", chosen).where(F.col("n") <= per_query).select("query_id", "author_id", "tier")


def negative_tails(triples: DataFrame, first: int, last: int, seed: int = 42) -> DataFrame:
    """ML-02: for each triple a tail drawn evenly from first..last."""
    return triples.withColumn("negative", F.lit(first) + F.conv(F.substring(_drawn(seed, "h", "r", "t"), 1, 8), 16, 10).cast("long") % (last - first + 1))


def sampled(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """TOP-10: n rows without replacement, the same for the same seed."""
    return df.orderBy(_drawn(seed, key), key).limit(n)


def anchors_mean(jobs: DataFrame) -> DataFrame:
    """ML-06: query_id, v: the mean of the embeddings (query_id, v) of a query's anchor jobs, by position."""
    each = jobs.select("query_id", F.posexplode("v").alias("i", "x")).groupBy("query_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))


def backbone_pool(ranked: DataFrame, size: int = 100, backbone: int = 70, minima: dict[str, int] | None = None) -> DataFrame:
    """TOP-05: of each query the first `backbone`, then each group's best until it has its minimum, then the next best, `size` in all, in base order."""
    least = minima or {"A": 30, "C": 15, "E": 15, "F": 5}
    table = F.create_map(*[F.lit(x) for pair in least.items() for x in pair])
    inside = F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy("base_rank"))
    rows = ranked.withColumn("need", (inside <= F.coalesce(F.try_element_at(table, F.col("bucket")), F.lit(0))).cast("int"))
    tier = F.when(F.col("base_rank") <= backbone, 0).when(F.col("need") == 1, 1).otherwise(2)
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(tier, "base_rank"))
    return rows.withColumn("o", order).where(F.col("o") <= size).select("query_id", "author_id", "bucket", "base_rank")
