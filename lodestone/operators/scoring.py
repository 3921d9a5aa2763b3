"""Scores that pass from works to authors, caps, squashes and normalisations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import weights as W


def split_to_authors(scored: DataFrame, weighted: DataFrame) -> DataFrame:
    """AGG-13, first half: work_id, author_id, share of the work's score by weight, or even if all weights are 0."""
    own = Window.partitionBy("work_id")
    total, n = F.sum("weight").over(own), F.count(F.lit(1)).over(own)
    part = F.when(total > 0, F.col("weight") / total).otherwise(F.lit(1.0) / n)
    parts = weighted.select("work_id", "author_id", part.alias("part"))
    return parts.join(scored, "work_id").groupBy("work_id", "author_id").agg(F.sum(F.col("score") * F.col("part")).alias("share"))


def rank_decayed(shares: DataFrame, most: int = 20, config: Config = DEFAULT) -> DataFrame:
    """AGG-13, second half: author_id, score, papers: the best shares of each author, the later the less."""
    rank = F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc("share"), "work_id"))
    best = shares.withColumn("rn", rank).where(F.col("rn") <= most)
    return best.groupBy("author_id").agg(F.sum(F.col("share") * W.rank_decay(F.col("rn"), config)).alias("score"), F.count(F.lit(1)).alias("papers"))


def term_decayed(hits: DataFrame, base: float = 0.6) -> DataFrame:
    """AGG-14: author_id, term, score: each further hit of a term counts base times the one before."""
    rank = F.row_number().over(Window.partitionBy("author_id", "term").orderBy(F.desc("x"), "work_id"))
    return hits.withColumn("rn", rank).groupBy("author_id", "term").agg(F.sum(F.col("x") * F.pow(F.lit(base), F.col("rn") - 1)).alias("score"))


def share_capped(scores: DataFrame, most: float = 0.25) -> DataFrame:
    """AGG-15: author_id, score: no term gives more than `most` of an author's raw total."""
    total = F.sum("score").over(Window.partitionBy("author_id"))
    return scores.withColumn("s", F.least("score", most * total)).groupBy("author_id").agg(F.sum("s").alias("score"))


def min_max(df: DataFrame, column: str, out: str, epsilon: float = 1e-8) -> DataFrame:
    """AGG-18: over the whole table, by one grouped row that is joined back; 0 where all are 0."""
    ends = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    x = F.when((F.col("_lo") == 0) & (F.col("_hi") == 0), 0.0).otherwise((F.col(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + epsilon))
    return df.crossJoin(F.broadcast(ends)).withColumn(out, x).drop("_lo", "_hi")


def log_min_max(df: DataFrame, column: str, out: str) -> DataFrame:
    """AGG-19: log1p, then to 0..1; a constant column is 0."""
    ends = df.agg(F.min(F.log1p(column)).alias("_lo"), F.max(F.log1p(column)).alias("_hi"))
    x = F.when(F.col("_hi") > F.col("_lo"), (F.log1p(column) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return df.crossJoin(F.broadcast(ends)).withColumn(out, x).drop("_lo", "_hi")


def max_normalised(df: DataFrame, column: str, out: str) -> DataFrame:
    """AGG-20."""
    top = df.agg(F.max(column).alias("_hi"))
    return df.crossJoin(F.broadcast(top)).withColumn(out, W.share_of(F.col(column), F.col("_hi"))).drop("_hi")


def squashed(df: DataFrame, column: str, out: str, at: float = 0.95) -> DataFrame:
    """AGG-16: t tanh(x / t) with the percentile t of all rows."""
    t = df.agg(F.percentile(column, at).alias("_t"))
    return df.crossJoin(F.broadcast(t)).withColumn(out, F.when(F.col("_t") > 0, F.col("_t") * F.tanh(F.col(column) / F.col("_t"))).otherwise(F.col(column))).drop("_t")


def consensus_bonus(df: DataFrame, column: str, out: str, slope: float = 12.0, low: float = 0.82, high: float = 1.15) -> DataFrame:
    """AGG-17: 1 and slope times the distance from the median, clipped."""
    m = df.agg(F.median(column).alias("_m"))
    return df.crossJoin(F.broadcast(m)).withColumn(out, W.clipped(1 + slope * (F.col(column) - F.col("_m")), low, high)).drop("_m")


def percentile_rank(key: Column, position: str, *group: str) -> Column:
    """WIN-07: 1 for the first by key, 0 for the last, ties by position; 1 in a group of one."""
    own = Window.partitionBy(*group)
    rank = F.row_number().over(own.orderBy(key.desc(), position))
    n = F.count(F.lit(1)).over(own)
    return F.when(n == 1, 1.0).otherwise(1 - (rank - 1) / (n - 1))
