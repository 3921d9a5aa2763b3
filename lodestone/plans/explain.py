"""Queries on explanations: from a query's main anchors over similar terms and works to authors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import explain as E
from ..operators import landing as G
from .label import _T
from .landing import _POOL, relative_similar, top_anchors
from .registry import query
from .stats import work_vocabulary

_WALKS = _POOL + """, nt AS (SELECT work_id, count(*) AS n FROM wv GROUP BY 1), na AS (SELECT DISTINCT work_id, author_id FROM authorships), nn AS (SELECT work_id, count(*) AS n FROM na GROUP BY 1),
    walk AS (SELECT ta.query_id, author_id AS node, strength * static / nt.n / nn.n AS weight, 'SIMILAR:' || anchor_id || '>' || dst || ' TOPIC:' || dst || '>' || wv.work_id || ' AUTHORED:' || wv.work_id || '>' || author_id AS path, wv.work_id
        FROM ta JOIN rel ON src = anchor_id AND r <= 3 JOIN wv ON wv.voc_id = dst JOIN nt ON nt.work_id = wv.work_id JOIN na ON na.work_id = wv.work_id JOIN nn ON nn.work_id = wv.work_id WHERE place <= 8)"""


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Walks from a query's main anchors to similar terms, and edges from terms to works, which weigh the less the more terms the work has."""
    top = top_anchors(spark, d).where(F.col("mode") == G.MAIN).select("query_id", F.col("anchor_id").alias("node"), F.col("strength").alias("weight"))
    near = relative_similar(spark, d).where("r <= 3").select("src", "dst", F.col("static").alias("weight"))
    wv = work_vocabulary(spark, d)
    topics = wv.join(wv.groupBy("work_id").agg(F.count(F.lit(1)).alias("n")), "work_id").select(F.col("voc_id").alias("src"), F.col("work_id").alias("dst"), (1.0 / F.col("n")).alias("weight"))
    return E.step(E.started(top), near, "SIMILAR"), topics


def walks(spark: SparkSession, d: str, merge: bool = False) -> DataFrame:
    """merge: walks to the same work go on as one, for what needs no earlier edges. An authorship weighs the less the more authors the work has."""
    to_terms, topics = _parts(spark, d)
    by = X.authorships(spark, d).select("work_id", "author_id").distinct()
    authored = by.join(by.groupBy("work_id").agg(F.count(F.lit(1)).alias("n")), "work_id").select(F.col("work_id").alias("src"), F.col("author_id").alias("dst"), (1.0 / F.col("n")).alias("weight"))
    # Three terms for each main anchor of a query: few rows, and works stay where they lie.
    to_works = E.step(F.broadcast(to_terms), topics, "TOPIC")
    return E.step(E.merged(to_works) if merge else to_works, authored, "AUTHORED")


@query("rul13_explanations", _WALKS + """ SELECT query_id, node AS author_id, rank, round(weight, 12) AS weight, path FROM (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY round(weight, 12) DESC, path) AS rank FROM walk) WHERE rank <= 3""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    to_terms, topics = _parts(spark, d)
    fans = X.authorships(spark, d).groupBy(F.col("work_id").alias("src")).agg(F.collect_set("author_id").alias("ends")).withColumn("weight", 1.0 / F.size("ends"))
    return E.best_fanned(to_terms, topics, fans, ("TOPIC", "AUTHORED"), 3).select("query_id", F.col("node").alias("author_id"), "rank", F.round("weight", 12).alias("weight"), "path")


@query("rul13_carriers", _WALKS + """, s AS (SELECT query_id, node, work_id, sum(weight) AS w FROM walk GROUP BY 1, 2, 3) SELECT query_id, node AS author_id, work_id, round(w / sum(w) OVER (PARTITION BY query_id, node), 9) AS share FROM s""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return E.carriers(walks(spark, d, merge=True), "TOPIC").select("query_id", F.col("node").alias("author_id"), F.col("via").alias("work_id"), F.round("share", 9).alias("share"))
