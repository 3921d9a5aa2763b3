"""Queries on the co-author network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..config import DEFAULT
from ..functions import weights as W
from ..operators import collaboration as C
from ..operators.storage import once
from .registry import query

_T = ("works", "authorships", "authors")
_WEIGHTED = """, weighted AS (
    SELECT work_id, author_id, max((1.0 + CASE WHEN pos_index = 1 AND is_alphabetical = 0 THEN 0.5 ELSE 0 END + CASE WHEN is_corresponding = 1 THEN 0.5 ELSE 0 END)
        * exp(-0.1 * greatest(2001 - coalesce(year, 2000), 0))) AS weight, max(h_index) AS h_index
    FROM authorships JOIN works USING (work_id) JOIN authors USING (author_id) GROUP BY work_id, author_id)"""
_TEAM = _WEIGHTED + """, team AS (
    SELECT * FROM weighted WHERE work_id IN (SELECT work_id FROM weighted GROUP BY work_id HAVING count(*) BETWEEN 2 AND 99))"""
_DIRECT = _TEAM + """, direct AS (
    SELECT a.author_id AS aid1, b.author_id AS aid2, sum(a.weight * b.weight) AS s_val, max(a.h_index) AS h1, max(b.h_index) AS h2
    FROM team a JOIN team b ON a.work_id = b.work_id AND a.author_id < b.author_id WHERE a.weight * b.weight > 0.01 GROUP BY 1, 2)"""
_INDIRECT = _DIRECT + """, indirect AS (
    SELECT d1.aid1, d2.aid2, 0.3 * sum(d1.s_val * d2.s_val / ((d1.h2 + 1) * sqrt(d1.h1 + 1) * sqrt(d2.h2 + 1))) AS score
    FROM direct d1 JOIN direct d2 ON d1.aid2 = d2.aid1 WHERE d1.aid1 <> d2.aid2 GROUP BY 1, 2)"""
_NETWORK = _INDIRECT + """, network AS (
    SELECT aid1, aid2, score FROM (
        SELECT aid1, aid2, sum(score) AS score, row_number() OVER (PARTITION BY aid1 ORDER BY sum(score) DESC, aid2) AS rank
        FROM (SELECT aid1, aid2, s_val AS score FROM direct UNION ALL SELECT * FROM indirect) GROUP BY aid1, aid2)
    WHERE rank <= 20)"""
_YEARS = """, years AS (
    SELECT author_id, count(*) FILTER (2001 - y < 5) AS n5, count(*) FILTER (2001 - y < 3) AS n3, count(*) FILTER (2001 - y >= 3 AND 2001 - y < 6) AS p3, max(y) AS latest
    FROM (SELECT author_id, CASE WHEN year IS NULL OR year < 1900 OR year > 2001 THEN 2000 ELSE year END AS y FROM authorships JOIN works USING (work_id)) GROUP BY author_id)"""


def weighted(spark: SparkSession, d: str) -> DataFrame:
    return C.weighted_authorships(X.authorships(spark, d), X.works(spark, d), X.authors(spark, d))


def network(spark: SparkSession, d: str, top: int = 20) -> DataFrame:
    return once(spark, f"network {top}", d, lambda: C.collaboration(C.direct_pairs(weighted(spark, d)), top))


@query("join02_weighted_authorships", _WEIGHTED + " SELECT work_id, author_id, weight, h_index FROM weighted", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return weighted(spark, d).select("work_id", "author_id", "weight", "h_index")


@query("flt07_team_size", _TEAM + " SELECT work_id, author_id FROM team", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.team_sized(weighted(spark, d)).select("work_id", "author_id")


@query("join05_agg10_direct_scores", _DIRECT + " SELECT * FROM direct", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.direct_scores(weighted(spark, d))


@query("join06_agg11_indirect_scores", _INDIRECT + " SELECT * FROM indirect", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.indirect_scores(C.direct_pairs(weighted(spark, d)))


@query("win01_collaboration_network", _NETWORK + " SELECT * FROM network", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return network(spark, d)


@query("dt03_author_time_features", _YEARS + """
    SELECT author_id, n5, n3, p3, 1 + ln(1 + n5) AS activity, least(3.0, (n3 + 1.0) / (p3 + 1.0)) AS momentum,
        (1 + ln(1 + n5)) * ln(1 + least(3.0, (n3 + 1.0) / (p3 + 1.0))) AS weight FROM years""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    years = C.year_counts(X.authorships(spark, d), X.works(spark, d))
    n5, n3, p3 = F.col("n5"), F.col("n3"), F.col("p3")
    return years.select("author_id", "n5", "n3", "p3", W.activity(n5).alias("activity"), W.momentum(n3, p3).alias("momentum"), W.author_time_weight(n5, n3, p3).alias("weight"))


@query("dt04_latest_recency", _YEARS + " SELECT author_id, latest, greatest(0.01, pow(10.0, -pow(greatest(2001 - latest, 0) / 20.0, 2))) AS recency FROM years", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    years = C.year_counts(X.authorships(spark, d), X.works(spark, d))
    return years.select("author_id", "latest", W.latest_recency(F.col("latest")).alias("recency"))


def seed_authors(spark: SparkSession, d: str) -> DataFrame:
    """Authors of the highest h-index stand for those whom another path has found."""
    return X.authors(spark, d).orderBy(F.desc("h_index"), "author_id").select("author_id").limit(5)


def top_collaborators(spark: SparkSession, d: str) -> DataFrame:
    return C.collaborators(network(spark, d), seed_authors(spark, d), C.year_counts(X.authorships(spark, d), X.works(spark, d)))


query("top01_collaborators_of_seeds", _NETWORK + _YEARS + """, seeds AS (SELECT author_id FROM authors ORDER BY h_index DESC, author_id LIMIT 5),
    edges AS (SELECT aid1 AS seed, aid2 AS target, score FROM network UNION ALL SELECT aid2, aid1, score FROM network),
    kept AS (SELECT * FROM edges WHERE seed IN (SELECT author_id FROM seeds) AND target NOT IN (SELECT author_id FROM seeds)),
    sums AS (SELECT target, sum(score) AS base, max(struct_pack(s := score, i := seed)).i AS closest FROM kept GROUP BY target)
    SELECT target AS author_id, base * coalesce((1 + ln(1 + n5)) * ln(1 + least(3.0, (n3 + 1.0) / (p3 + 1.0))), 1.0) AS collab_score, closest AS closest_seed
    FROM sums LEFT JOIN years ON target = years.author_id ORDER BY collab_score DESC, target LIMIT 20""", *_T)(top_collaborators)


@query("join13_both_directions", _NETWORK + " SELECT aid1 AS seed_id, aid2 AS target_id, score FROM network UNION ALL SELECT aid2, aid1, score FROM network", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return C.both_ways(network(spark, d))


@query("agg42_row_normalised", _NETWORK + " SELECT aid1 AS h, aid2 AS t, CASE WHEN sum(score) OVER (PARTITION BY aid1) > 0 THEN score / sum(score) OVER (PARTITION BY aid1) ELSE 0 END AS w FROM network", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return network(spark, d).select(F.col("aid1").alias("h"), F.col("aid2").alias("t"), W.share_of(F.col("score"), F.sum("score").over(Window.partitionBy("aid1"))).alias("w"))


@query("agg01_author_stats", " SELECT author_id, count(work_id) AS works_count, sum(citation_count) AS cited_by FROM authorships JOIN works USING (work_id) GROUP BY author_id", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.authorships(spark, d).join(X.works(spark, d), "work_id").groupBy("author_id").agg(F.count("work_id").alias("works_count"), F.sum("citation_count").alias("cited_by"))


@query("agg02_institution_stats", " SELECT inst_id, count(DISTINCT work_id) AS works_count, sum(citation_count) AS cited_by FROM (SELECT DISTINCT inst_id, work_id, citation_count FROM authorships JOIN works USING (work_id)) GROUP BY inst_id", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.authorships(spark, d).join(X.works(spark, d), "work_id").select("inst_id", "work_id", "citation_count").distinct()
    return rows.groupBy("inst_id").agg(F.count("work_id").alias("works_count"), F.sum("citation_count").alias("cited_by"))


@query("agg03_source_stats", " SELECT type AS source, count(*) AS works_count, sum(citation_count) AS cited_by FROM (SELECT DISTINCT type, work_id, citation_count FROM works) GROUP BY type", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.works(spark, d).select("type", "work_id", "citation_count").distinct().groupBy(F.col("type").alias("source")).agg(F.count("work_id").alias("works_count"), F.sum("citation_count").alias("cited_by"))


@query("agg04_recent_author_stats", """ SELECT author_id, coalesce(n, 0) AS recent_works, coalesce(c, 0) AS recent_citations FROM authors LEFT JOIN (
    SELECT author_id, count(DISTINCT work_id) AS n, sum(citation_count) AS c FROM authorships JOIN works USING (work_id) WHERE year >= 1996 GROUP BY author_id) USING (author_id)""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    recent = X.works(spark, d).where(F.col("year") >= DEFAULT.as_of_year - DEFAULT.recent_years)
    sums = X.authorships(spark, d).join(recent, "work_id").groupBy("author_id").agg(F.countDistinct("work_id").alias("n"), F.sum("citation_count").alias("c"))
    zero = F.lit(0).cast("long")
    return X.authors(spark, d).join(sums, "author_id", "left").select("author_id", F.coalesce("n", zero).alias("recent_works"), F.coalesce("c", zero).alias("recent_citations"))


@query("win02_top_works", """ SELECT author_id, work_id, rn FROM (SELECT author_id, work_id, row_number() OVER (PARTITION BY author_id ORDER BY coalesce(citation_count, -1) DESC, work_id) AS rn
    FROM (SELECT DISTINCT author_id, work_id, citation_count FROM authorships JOIN works USING (work_id))) WHERE rn <= 3""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.authorships(spark, d).join(X.works(spark, d), "work_id").select("author_id", "work_id", "citation_count").distinct()
    rank = F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc(F.coalesce("citation_count", F.lit(-1))), "work_id"))
    return rows.withColumn("rn", rank).where("rn <= 3").select("author_id", "work_id", "rn")


_SPLIT = _WEIGHTED + """, team2 AS (SELECT *, sum(weight) OVER (PARTITION BY work_id) AS total, count(*) OVER (PARTITION BY work_id) AS n FROM weighted),
    shares AS (SELECT author_id, work_id, sum(citation_count * CASE WHEN total > 0 THEN weight / total ELSE 1.0 / n END) AS share FROM team2 JOIN works USING (work_id) GROUP BY author_id, work_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY share DESC, work_id) AS rn FROM shares)"""


@query("agg13_fractional_rank_decay", _SPLIT + """ SELECT author_id, sum(share * CASE rn WHEN 1 THEN 1.0 WHEN 2 THEN 0.55 WHEN 3 THEN 0.30 WHEN 4 THEN 0.18 WHEN 5 THEN 0.10 ELSE 0.06 END) AS score, count(*) AS papers
    FROM ranked WHERE rn <= 20 GROUP BY author_id""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.scoring import rank_decayed, split_to_authors

    return rank_decayed(split_to_authors(X.works(spark, d).select("work_id", F.col("citation_count").cast("double").alias("score")), weighted(spark, d)), 20)


@query("mth15_fan_out", _WEIGHTED + " SELECT work_id, count(*) AS n, greatest(0.72, sqrt(4.0 / greatest(count(*), 4))) AS factor FROM weighted GROUP BY work_id", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return weighted(spark, d).groupBy("work_id").agg(F.count(F.lit(1)).alias("n")).select("work_id", "n", F.greatest(F.lit(0.72), F.sqrt(4.0 / F.greatest("n", F.lit(4)))).alias("factor"))


@query("win10_zipf_weights", _WEIGHTED + """ SELECT work_id, author_id, CASE WHEN min(weight) OVER w = max(weight) OVER w THEN weight
    ELSE weight * (1.0 / row_number() OVER (PARTITION BY work_id ORDER BY weight DESC, author_id)) / h END AS zipf
    FROM (SELECT *, list_sum(list_transform(range(1, count(*) OVER (PARTITION BY work_id) + 1), lambda k: 1.0 / k)) AS h FROM weighted) WINDOW w AS (PARTITION BY work_id)""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    own = Window.partitionBy("work_id")
    rank = F.row_number().over(own.orderBy(F.desc("weight"), "author_id"))
    rows = weighted(spark, d).withColumn("rank", rank).withColumn("h", F.sum(1.0 / F.col("rank")).over(own))
    zipf = F.when(F.min("weight").over(own) == F.max("weight").over(own), F.col("weight")).otherwise(F.col("weight") / F.col("rank") / F.col("h"))
    return rows.select("work_id", "author_id", zipf.alias("zipf"))
