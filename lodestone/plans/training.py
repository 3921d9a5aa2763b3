"""Queries on labels, samples, features and scores for training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import weights as W
from ..operators import graph
from ..operators import training as G
from .registry import query

_T = ("works", "authorships", "authors")
_POOL = "SELECT source AS query_id, doc_id AS author_id, CASE doc_id % 3 WHEN 0 THEN 'fair' WHEN 1 THEN 'neutral' ELSE 'easy' END AS tier FROM documents"


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    tier = F.when(F.col("doc_id") % 3 == 0, "fair").when(F.col("doc_id") % 3 == 1, "neutral").otherwise("easy")
    return X.raw(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("author_id"), tier.alias("tier"))


@query("ml03_graded_labels", """SELECT doc_id, CASE WHEN gold IS NOT NULL THEN 'gold' WHEN weak IS NOT NULL THEN 'weak' ELSE 'unlabeled' END AS label_source, CASE WHEN gold >= 2 THEN 1 WHEN gold = 0 THEN 0 WHEN gold = 1 THEN NULL ELSE weak END AS train_y,
    CASE WHEN gold = 1 THEN 0.0 WHEN gold IS NOT NULL THEN 1.0 WHEN weak IS NOT NULL THEN 0.3 ELSE 0.0 END AS sample_weight FROM (SELECT doc_id, quality + toxic AS gold, CASE WHEN n_chars > 5000 THEN 1 WHEN n_chars < 200 THEN 0 END AS weak FROM documents LEFT JOIN labels USING (doc_id))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.raw(spark, d, "documents").join(X.raw(spark, d, "labels"), "doc_id", "left")
    weak = F.when(F.col("n_chars") > 5000, 1).when(F.col("n_chars") < 200, 0)
    return G.graded(rows.select("doc_id", (F.col("quality") + F.col("toxic")).alias("gold"), weak.alias("weak"))).select("doc_id", "label_source", "train_y", "sample_weight")


@query("ml01_tiered_negatives", """WITH t AS (SELECT source AS query_id, doc_id AS author_id, CASE doc_id % 3 WHEN 0 THEN 'fair' WHEN 1 THEN 'neutral' ELSE 'easy' END AS tier FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY md5(concat_ws('|', 42, query_id, author_id)), author_id) AS r, CASE tier WHEN 'fair' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS level FROM t),
    n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY (r <= CASE tier WHEN 'easy' THEN 2 ELSE 4 END) DESC, level, r, author_id) AS n FROM r) SELECT query_id, author_id, tier FROM n WHERE n <= 10""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return G.tiered_negatives(_tiers(spark, d), 10)


@query("ml02_negative_tails", "SELECT l_orderkey AS h, 1 AS r, l_suppkey AS t, 1 + CAST('0x' || substr(md5(concat_ws('|', 42, l_orderkey, 1, l_suppkey)), 1, 8) AS BIGINT) % 100 AS negative FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    triples = X.raw(spark, d, "lineitem").select(F.col("l_orderkey").alias("h"), F.lit(1).alias("r"), F.col("l_suppkey").alias("t"))
    return G.negative_tails(triples, 1, 100)


@query("top10_seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5(concat_ws('|', 42, o_orderkey)), o_orderkey LIMIT 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return G.sampled(X.raw(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


_PO = "WITH b AS (SELECT source AS query_id, doc_id AS author_id, CASE doc_id % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'C' WHEN 2 THEN 'E' ELSE 'F' END AS bucket, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS base_rank FROM documents)"


@query("top05_backbone_pool", _PO + """, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY base_rank) <= CASE bucket WHEN 'A' THEN 3 WHEN 'F' THEN 4 ELSE 0 END AS need FROM b),
    o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN base_rank <= 6 THEN 0 WHEN need THEN 1 ELSE 2 END, base_rank) AS o FROM n) SELECT query_id, author_id, bucket, base_rank FROM o WHERE o <= 12""")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    rows = X.raw(spark, d, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("author_id"), F.when(k == 0, "A").when(k == 1, "C").when(k == 2, "E").otherwise("F").alias("bucket"), rank.alias("base_rank"))
    return G.backbone_pool(rows, 12, 6, {"A": 3, "F": 4})


@query("ml06_anchor_mean", "SELECT label AS query_id, i, avg(x) AS x FROM (SELECT label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    means = G.anchors_mean(X.raw(spark, d, "embeddings").select(F.col("label").alias("query_id"), F.col("embedding").alias("v")))
    return means.select("query_id", F.posexplode("v").alias("i", "x"))


@query("ml08_batched_queries", " SELECT inst_id AS query_id, author_id, rank FROM (SELECT inst_id, author_id, row_number() OVER (PARTITION BY inst_id ORDER BY h_index DESC, author_id) AS rank FROM authors) WHERE rank <= 2", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("inst_id").orderBy(F.desc("h_index"), "author_id"))
    return X.authors(spark, d).withColumn("rank", rank).where("rank <= 2").select(F.col("inst_id").alias("query_id"), "author_id", "rank")


@query("ml04_features", "SELECT s_suppkey, unnest(range(3)) AS i, unnest([s_acctbal / 1000, coalesce(n, 0) / 100.0, CAST(s_nationkey AS DOUBLE)]) AS x FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = X.raw(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = X.raw(spark, d, "supplier").join(n, "s_suppkey", "left")
    vector = F.array(F.col("s_acctbal") / 1000, F.coalesce("n", F.lit(0)) / 100.0, F.col("s_nationkey").cast("double"))
    return rows.select("s_suppkey", F.posexplode(vector).alias("i", "x"))


@query("agg39_masked_evaluation", "WITH r AS (SELECT source AS query_id, quality AS relevant, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id) WHERE doc_id % 5 <> 0) SELECT query_id, sum(relevant) FILTER (WHERE rank <= 5) / 5 AS precision FROM r GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = X.raw(spark, d, "documents")
    train = docs.where("doc_id % 5 = 0").select("doc_id")
    rows = docs.join(train, "doc_id", "left_anti").join(X.raw(spark, d, "labels"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return rows.withColumn("rank", rank).groupBy(F.col("source").alias("query_id")).agg((F.sum(F.when(F.col("rank") <= 5, F.col("quality"))) / 5).alias("precision"))


@query("ml09_ablation_overlap", "WITH a AS (SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 10), b AS (SELECT source, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id % 97, doc_id) AS r FROM documents) WHERE r <= 10) SELECT source, count(*) AS both_ FROM a JOIN b USING (source, doc_id) GROUP BY source")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = X.raw(spark, d, "documents").select("source", "doc_id", "n_chars")
    top = lambda *order: docs.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where("r <= 10").select("source", "doc_id")
    return top(F.desc("n_chars"), "doc_id").join(top(F.col("doc_id") % 97, "doc_id"), ["source", "doc_id"], "left_semi").groupBy("source").agg(F.count(F.lit(1)).alias("both_"))


@query("agg41_neighbour_sum", ", e AS (SELECT work_id AS h, author_id AS t, 1.0 / count(*) OVER (PARTITION BY work_id) AS w FROM authorships) SELECT h, sum(w * h_index) AS value FROM e JOIN authors ON t = author_id GROUP BY h", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    edges = X.authorships(spark, d).select(F.col("work_id").alias("h"), F.col("author_id").alias("t"), (F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("work_id"))).alias("w"))
    features = X.authors(spark, d).select(F.col("author_id").alias("id"), F.lit(0).alias("dim"), F.col("h_index").cast("double").alias("value"))
    return graph.neighbour_sum(edges, features).select("h", "value")


@query("graph_dense_ids", " SELECT author_id, row_number() OVER (ORDER BY author_id) - 1 + 1000 AS id FROM authors", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.dense_ids(X.authors(spark, d), "author_id", 1000)


@query("graph_degrees", " SELECT author_id, count(DISTINCT work_id) AS degree FROM authorships GROUP BY author_id", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.authorships(spark, d).select("author_id", "work_id").distinct().groupBy("author_id").agg(F.count(F.lit(1)).alias("degree"))


@query("agg27_group_merge", "SELECT p_brand, max(p_retailprice) AS best, count(*) AS n, count(DISTINCT p_type) AS types, bool_or(p_size > 45) AS conflict FROM part GROUP BY p_brand")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "part").groupBy("p_brand").agg(F.max("p_retailprice").alias("best"), F.count(F.lit(1)).alias("n"), F.countDistinct("p_type").alias("types"), F.bool_or(F.col("p_size") > 45).alias("conflict"))


@query("agg36_role_sums", "SELECT l_suppkey, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS primary_, sum(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS support, sum(l_quantity) FILTER (WHERE l_returnflag = 'R') / sum(l_quantity) AS share FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    q, r = F.col("l_quantity"), F.col("l_returnflag") == "R"
    return X.raw(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.when(r, q)).alias("primary_"), F.sum(F.when(~r, q)).alias("support"), (F.sum(F.when(r, q)) / F.sum(q)).alias("share"))


@query("agg40_topic_neighbours", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand, p_type) - 1 AS neighbours FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "part").select("p_partkey", (F.count(F.lit(1)).over(Window.partitionBy("p_brand", "p_type")) - 1).alias("neighbours"))


@query("agg45_frequent_keys", "WITH k AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= greatest(3, ceil(0.15 * (SELECT count(*) FROM part)))) SELECT p_partkey, p_type IN (SELECT p_type FROM k) AS near FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    part = X.raw(spark, d, "part")
    n = part.agg(F.count(F.lit(1)).alias("all"))
    keys = part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).where(F.col("n") >= F.greatest(F.lit(3), F.ceil(0.15 * F.col("all")))).select("p_type", F.lit(True).alias("near"))
    return part.join(keys, "p_type", "left").select("p_partkey", F.coalesce("near", F.lit(False)).alias("near"))


@query("win12_family_centrality", "SELECT p_partkey, p_retailprice / max(p_retailprice) OVER (PARTITION BY p_brand) AS centrality FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / F.max("p_retailprice").over(Window.partitionBy("p_brand"))).alias("centrality"))


@query("win14_anchor_ratio", " SELECT author_id, count(DISTINCT work_id) / (SELECT count(DISTINCT work_id) FROM authorships) AS ratio FROM authorships GROUP BY author_id", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    a = X.authorships(spark, d)
    total = a.agg(F.countDistinct("work_id").alias("n"))
    return a.groupBy("author_id").agg(F.countDistinct("work_id").alias("k")).crossJoin(F.broadcast(total)).select("author_id", (F.col("k") / F.col("n")).alias("ratio"))


@query("mth12_bounded_bonuses", "SELECT c_custkey, least(greatest(c_acctbal / 10000, 0), 0.5) AS bonus, 0.4 * coalesce(c_acctbal / 10000, 0) + 0.6 * (c_nationkey / 25.0) AS blended, least(0.40, 0.09 + 0.58 * (c_nationkey / 25.0)) AS synthetic FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    a, n = F.col("c_acctbal") / 10000, F.col("c_nationkey") / 25.0
    return X.raw(spark, d, "customer").select("c_custkey", W.clipped(a, 0.0, 0.5).alias("bonus"), W.blend((0.4, a), (0.6, n)).alias("blended"), F.least(F.lit(0.40), 0.09 + 0.58 * n).alias("synthetic"))


@query("mth25_candidate_features", " SELECT author_id, least(1.0, ln(1 + sum(citation_count)) / 10) AS top_work_quality, count(*) FILTER (WHERE year >= 1999) / count(*) AS activity_match, max(citation_count) / 500.0 AS hit_strength FROM authorships JOIN works USING (work_id) GROUP BY author_id", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.authorships(spark, d).join(X.works(spark, d), "work_id")
    return rows.groupBy("author_id").agg(F.least(F.lit(1.0), F.log1p(F.sum("citation_count")) / 10).alias("top_work_quality"), (F.count_if(F.col("year") >= 1999) / F.count(F.lit(1))).alias("activity_match"), (F.max("citation_count") / 500.0).alias("hit_strength"))


@query("mth31_guardrail", "SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') OR count(*) >= 2 THEN 1.0 ELSE 0.05 END AS guardrail, CASE WHEN bool_or(l_returnflag = 'R') THEN 0.45 ELSE 0.12 END * least(1.0, 0.5 + 0.25 * least(count(*), 3)) AS support FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    r, n = F.bool_or(F.col("l_returnflag") == "R"), F.count(F.lit(1))
    return X.raw(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(r | (n >= 2), 1.0).otherwise(0.05).alias("guardrail"), (F.when(r, 0.45).otherwise(0.12) * F.least(F.lit(1.0), 0.5 + 0.25 * F.least(n, F.lit(3)))).alias("support"))
