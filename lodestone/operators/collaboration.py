"""The co-author network: weighted authorships, direct and indirect scores, and the collaboration query.

Works of one author or of more than ninety-nine take no part, so a work makes at most 4,851 pairs and pair joins grow
with the number of authorships. Pairs of little weight are dropped before they are summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import weights as W
from .products import chained


#: Authorships that a task sorts and counts by work, of more than MANY.
ROWS, MANY = 500_000, 4_000_000


def _dealt(rows: DataFrame, n: int) -> DataFrame:
    """n rows, dealt out by work: partitions that are merged by their size in bytes hold the more rows the better these compress, and a task's memory with them."""
    if n <= MANY:
        return rows
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS)), "work_id")


def weighted_authorships(authorships: DataFrame, works: DataFrame, authors: DataFrame, config: Config = DEFAULT, literal: bool = False) -> DataFrame:
    """work_id, author_id, weight, h_index. One row per work and author (the largest weight); literal keeps repeated rows."""
    weight = W.contribution(F.col("pos_index"), F.col("is_alphabetical"), F.col("is_corresponding")) * W.exponential_decay(F.col("year"), config.as_of_year)
    rows = _dealt(authorships.join(authors.select("author_id", "h_index"), "author_id"), authorships.count())
    rows = rows.join(works.select("work_id", "year"), "work_id").select("work_id", "author_id", weight.alias("weight"), "h_index")
    return rows if literal else rows.groupBy("work_id", "author_id").agg(F.max("weight").alias("weight"), F.max("h_index").alias("h_index"))


def team_sized(weighted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """FLT-07: authorships of works with team_least to team_most of them."""
    n = F.count(F.lit(1)).over(Window.partitionBy("work_id"))
    return weighted.where("work_id is not null").withColumn("_n", n).where(F.col("_n").between(config.team_least, config.team_most)).drop("_n")


def direct_pairs(weighted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """JOIN-05, FLT-24: aid1 < aid2, s_val, h1, h2, a row for each work that both have: chains add up what repeated pairs have."""
    team = team_sized(weighted, config)
    a = team.select("work_id", F.col("author_id").alias("aid1"), F.col("weight").alias("w1"), F.col("h_index").alias("h1"))
    b = team.select("work_id", F.col("author_id").alias("aid2"), F.col("weight").alias("w2"), F.col("h_index").alias("h2"))
    pairs = a.join(b, "work_id").where("aid1 < aid2").withColumn("s_val", F.col("w1") * F.col("w2")).where(F.col("s_val") > config.pair_least)
    return pairs.select("aid1", "aid2", "s_val", "h1", "h2")


def direct_scores(weighted: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """JOIN-05, FLT-24, AGG-10: aid1 < aid2, s_val, h1, h2."""
    return direct_pairs(weighted, config).groupBy("aid1", "aid2").agg(F.sum("s_val").alias("s_val"), F.max("h1").alias("h1"), F.max("h2").alias("h2"))


def indirect_scores(direct: DataFrame, config: Config = DEFAULT, ordered_chain: bool = True) -> DataFrame:
    """JOIN-06, AGG-11: through one author in between, from direct scores or pairs; ordered_chain follows rising ids only, else every chain counts."""
    if not ordered_chain:
        direct = direct.unionByName(direct.select(F.col("aid2").alias("aid1"), F.col("aid1").alias("aid2"), "s_val", F.col("h2").alias("h1"), F.col("h1").alias("h2")))
    return _chains(direct, config, not ordered_chain)


def _chains(direct: DataFrame, config: Config, symmetric: bool, own: bool = False, top: int | None = None) -> DataFrame:
    """aid1, aid2, score over chains of two rows; own adds the direct scores."""
    first = F.col("s_val") / ((F.col("h2") + 1) * F.sqrt(F.col("h1") + 1))
    second = F.col("s_val") / F.sqrt(F.col("h2") + 1)
    edges = direct.select(F.col("aid1").alias("src"), F.col("aid2").alias("dst"), "s_val", "h1", "h2")
    found = chained(edges, first, second, config.indirect, F.col("s_val") if own else None, symmetric, top)
    return found.select(F.col("src").alias("aid1"), F.col("dst").alias("aid2"), F.col("value").alias("score"))


def collaboration(direct: DataFrame, top: int = 100, config: Config = DEFAULT, ordered_chain: bool = True) -> DataFrame:
    """aid1, aid2, score: direct (scores or pairs) and indirect scores added up, the best `top` of each aid1 (ties: the smaller aid2)."""
    if ordered_chain:
        total = _chains(direct, config, False, own=True, top=top)
    else:
        both = direct.select("aid1", "aid2", F.col("s_val").alias("score")).unionByName(indirect_scores(direct, config, False))
        total = both.groupBy("aid1", "aid2").agg(F.sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("aid1").orderBy(F.desc("score"), "aid2"))
    return total.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


def both_ways(network: DataFrame) -> DataFrame:
    """JOIN-13: seed_id, target_id, score in either direction."""
    return network.select(F.col("aid1").alias("seed_id"), F.col("aid2").alias("target_id"), "score").unionByName(network.select(F.col("aid2").alias("seed_id"), F.col("aid1").alias("target_id"), "score"))


def year_counts(authorships: DataFrame, works: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """author_id, n5, n3, p3, latest over authorship rows, for DT-03 and DT-04."""
    year = W.safe_year(F.col("year"), config)
    age = config.as_of_year - year
    return (
        authorships.select("work_id", "author_id").join(works.select("work_id", "year"), "work_id").groupBy("author_id")
        .agg(F.count_if(age < 5).alias("n5"), F.count_if(age < 3).alias("n3"), F.count_if((age >= 3) & (age < 6)).alias("p3"), F.max(year).alias("latest"))
    )


def collaborators(network: DataFrame, seeds: DataFrame, years: DataFrame, limit: int = 20) -> DataFrame:
    """AGG-12, JOIN-14, DT-03, TOP-01: the best collaborators of seed authors (author_id) who are no seeds themselves."""
    edges = both_ways(network).join(F.broadcast(seeds.select(F.col("author_id").alias("seed_id"))), "seed_id", "left_semi")
    edges = edges.join(F.broadcast(seeds.select(F.col("author_id").alias("target_id"))), "target_id", "left_anti")
    sums = edges.groupBy("target_id").agg(F.sum("score").alias("base"), F.max(F.struct("score", "seed_id")).alias("closest"))
    weight = F.coalesce(W.author_time_weight(F.col("n5"), F.col("n3"), F.col("p3")), F.lit(1.0))
    out = sums.join(years, sums.target_id == years.author_id, "left").select(
        F.col("target_id").alias("author_id"), (F.col("base") * weight).alias("collab_score"), F.col("closest.seed_id").alias("closest_seed")
    )
    return out.orderBy(F.desc("collab_score"), "author_id").limit(limit)
