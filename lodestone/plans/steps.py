"""Queries on vector expansion, nested values, nodes, work queues and refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import maps as M
from ..operators import tables as B
from ..operators import vectors as V
from ..streaming import sync
from .registry import query
from .retrieval import _DOT


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "embeddings")


@query("vec05_clusters")
def _(spark: SparkSession, d: str) -> DataFrame:
    items = _vectors(spark, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    cents = V.clustered(items, 20).select(F.col("cluster").alias("centroid"), "c")
    return V.nearest_centroids(items, cents, 1).groupBy(F.col("centroid").alias("cluster")).agg(F.count(F.lit(1)).alias("members"))


@query("vec09_cluster_expansion", f"""WITH s AS (SELECT vec_id AS seed, label AS c, embedding, (vec_id % 7 + 1) / 7.0 AS sim FROM embeddings WHERE vec_id % 50 = 0), t AS (SELECT * FROM s ORDER BY sim DESC, seed LIMIT 15),
    p AS (SELECT seed, b.vec_id AS id, sim, {_DOT} AS near FROM t a JOIN embeddings b ON a.c = b.label WHERE b.vec_id % 50 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY near DESC, id) AS r FROM p WHERE near >= 0.1)
    SELECT id, max(0.2 * sim * near) AS score, count(*) AS support FROM r WHERE r <= 5 GROUP BY id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    seeds = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), ((F.col("vec_id") % 7 + 1) / 7.0).alias("sim"))
    members = e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.lit(1.0).alias("score"), F.col("embedding").alias("v"))
    return V.cluster_expansion(seeds, members, least=0.1)


_NEAR = _DOT.replace("a.embedding", "a.anchor")


@query("vec12_dense_expansion", f"""WITH c AS (SELECT label, list(x ORDER BY i) AS anchor FROM (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2)) GROUP BY label),
    s AS (SELECT vec_id, embedding, anchor, vec_id % 3 = 0 AS weak, vec_id % 4 = 0 AS strong FROM embeddings JOIN c USING (label) WHERE vec_id % 50 = 0), p AS (SELECT a.vec_id AS seed, b.vec_id AS id, a.weak, a.strong, {_DOT} AS score, {_NEAR} AS near FROM s a, embeddings b),
    k AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS k FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, id) AS r FROM k WHERE k <= 24 AND score >= CASE WHEN weak THEN 0.84 ELSE 0.80 END AND near >= CASE WHEN weak THEN 0.78 ELSE 0.72 END AND id % 50 <> 0)
    SELECT seed, id, score FROM r WHERE r <= CASE WHEN weak THEN 1 WHEN strong THEN 3 ELSE 2 END""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    cents = V.centroids(e.select("label", F.col("embedding").alias("v")), "label").select("label", F.col("v").alias("anchor"))
    seeds = e.where("vec_id % 50 = 0").join(cents, "label").select(F.col("vec_id").alias("seed"), F.col("embedding").alias("q"), "anchor", F.when(F.col("vec_id") % 3 == 0, "weak").otherwise("normal").alias("tier"), (F.col("vec_id") % 4 == 0).alias("strong"))
    return V.dense_expansion(seeds, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


@query("map04_accumulated", "SELECT c_custkey, '[' || array_to_string(list_sort(list_transform(map_entries(m), lambda x: x.key || '=' || CAST(x.value AS INTEGER))), ', ') || ']' AS total FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN map_from_entries([('a', 1.0 + 2 * c_nationkey), ('b', 2.0)]) ELSE map_from_entries([('a', 1.0), ('b', 2.0), ('c', 2.0 * c_nationkey)]) END AS m FROM customer)")
def _(spark: SparkSession, d: str) -> DataFrame:
    base = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0))
    more = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("a"), F.col("c_nationkey").cast("double"))).otherwise(F.create_map(F.lit("c"), F.col("c_nationkey").cast("double")))
    rows = X.raw(spark, d, "customer").select("c_custkey", M.accumulated(base, more, F.lit(2.0)).alias("m"))
    said = F.array_sort(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("int").cast("string"))))
    return rows.select("c_custkey", F.concat(F.lit("["), F.array_join(said, ", "), F.lit("]")).alias("total"))


@query("map06_nested_values", "SELECT event_id, coalesce(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k'), 'none') AS k, coalesce(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.a.b'), 'none') AS b FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "events").select("event_id", M.nested(F.col("props"), "k", "none").alias("k"), M.nested(F.col("props"), "a.b", "none").alias("b"))


@query("map09_evidence", "SELECT p_partkey, p_name AS term, CASE WHEN p_size > 25 THEN 'core' ELSE 'support' END AS bucket, CASE WHEN p_partkey % 3 = 1 THEN 0.0 ELSE p_size END AS score FROM part WHERE p_partkey % 3 <> 2 OR p_size > 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    bucket = F.when(F.col("p_size") > 25, F.lit("core"))
    one = F.to_json(F.struct(F.col("p_name").alias("term"), bucket.alias("bucket"), F.when(F.col("p_partkey") % 3 != 1, F.col("p_size")).alias("score")))
    k = F.col("p_partkey") % 3
    said = F.when(k == 0, F.concat(F.lit("["), one, F.lit("]"))).when(k == 1, F.concat(F.lit('{"terms": ['), one, F.lit("]}"))).when(F.col("p_size") > 25, F.concat(F.lit('{"term_list": ['), one, F.lit("]}"))).otherwise("{}")
    return X.raw(spark, d, "part").select("p_partkey", F.explode(M.evidence(said)).alias("e")).select("p_partkey", "e.term", "e.bucket", "e.score")


@query("snk11_merged_nodes", "SELECT coalesce(s_suppkey, c_custkey) AS id, coalesce(c_name, s_name) AS name, s_nationkey AS nation, c_mktsegment AS segment FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    base = X.raw(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return B.merged_nodes(base, X.raw(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")))


_STATUS = "SELECT o_custkey AS id, min(CASE o_orderstatus WHEN 'F' THEN 'SUCCESS' WHEN 'O' THEN 'API_ERROR' ELSE 'NOT_FOUND' END) AS status FROM orders GROUP BY 1"


def _statuses(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("o_orderstatus") == "F", "SUCCESS").when(F.col("o_orderstatus") == "O", "API_ERROR").otherwise("NOT_FOUND")
    return X.raw(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min(s).alias("status"))


@query("stm09_pending_repairs", f"SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT id FROM ({_STATUS}) WHERE status <> 'API_ERROR')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.pending(X.raw(spark, d, "customer").select(F.col("c_custkey").alias("id")), _statuses(spark, d), "id")


@query("stm09_status_set", f"SELECT id, CASE WHEN id % 5 = 0 THEN 'SKIPPED' ELSE status END AS status FROM ({_STATUS}) UNION ALL SELECT c_custkey, 'SKIPPED' FROM customer WHERE c_custkey % 5 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    new = X.raw(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("id"), F.lit("SKIPPED").alias("status"))
    return B.status_set(_statuses(spark, d), new, "id")


@query("stm08_refresh_due", "SELECT date_diff('day', max(o_orderdate)::DATE, DATE '2000-01-01') >= 30 AS due FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.due(X.raw(spark, d, "orders"), "o_orderdate", "2000-01-01", 30)


@query("stm07_crawl_state", """SELECT c_custkey AS task, cursor, coalesce(n, 0) AS done, c_nationkey AS total, coalesce(n, 0) >= c_nationkey AS completed FROM customer
    LEFT JOIN (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS cursor, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _(spark: SparkSession, d: str) -> DataFrame:
    pages = X.raw(spark, d, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("page"), F.col("o_totalprice").alias("cursor"))
    return sync.crawl_state(pages, X.raw(spark, d, "customer").select(F.col("c_custkey").alias("task"), F.col("c_nationkey").alias("pages")))
