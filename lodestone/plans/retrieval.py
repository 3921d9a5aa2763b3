"""Queries on vector search, fusion, pools, ranks and evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import weights as W
from ..operators import ann as A
from ..operators import fusion as U
from ..operators import metrics, scoring
from ..operators import vectors as V
from ..operators.storage import new_folder
from .registry import SQL, query

_T = ("works", "authorships", "authors")
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = X.raw(spark, d, "embeddings")
    return e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v"))


@query("vec01_top_k", f"SELECT query_id, item_id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_DOT} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE rank <= 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    return V.top_k(*_vectors(spark, d), 10)


#: Cells of the index for about so many items each, up to MOST_CELLS; the share of true hits for which the number of cells to read is chosen, on a sample of queries.
PER_CELL, RECALL = 64, 0.95


def _index(spark: SparkSession, d: str) -> tuple[DataFrame, A.Index]:
    queries, items = _vectors(spark, d)
    cells = min(A.MOST_CELLS, max(1, round(items.count() / PER_CELL)))
    return queries, A.build(items, new_folder(spark, "index"), cells)


@query("vec01_index_exact", SQL["vec01_top_k"])
def _(spark: SparkSession, d: str) -> DataFrame:
    """The same hits through the index: some cells, then those whose bound reaches a query's tenth best score."""
    return A.exact(*_index(spark, d), 10)


@query("join33_index_search")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Approximate: only each query's nearest cells are read."""
    queries, index = _index(spark, d)
    return A.search(queries, index, 10, A.probes_for(queries, index, 10, RECALL, 512))


@query("vec02_normalised", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 3) AS before, 1.0 AS after FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = X.raw(spark, d, "embeddings")
    return V.normalised(e.withColumn("before", F.round(W.norm(F.col("embedding")), 3))).select("vec_id", "before", F.round(W.norm(F.col("embedding")), 6).alias("after"))


@query("vec04_similarity_edges", f"""WITH p AS (SELECT a.vec_id AS src, b.vec_id AS dst, {_DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.label <> b.label),
    q AS (SELECT *, count(*) FILTER (WHERE score >= 0.25) OVER (PARTITION BY src) AS n, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM p WHERE score >= 0.1)
    SELECT src, dst, score FROM q WHERE score >= 0.25 OR (n < 3 AND r <= 3)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = X.raw(spark, d, "embeddings")
    a = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("src"), F.col("embedding").alias("q"), F.col("label").alias("la"))
    blocks = V.scored_pairs(a, e.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("v"), "label"), 0.1, key="src", k=3, high=0.25, apart=("la", "label"))
    # A source is in one block, so each block's edges are whole.
    return reduce(DataFrame.unionByName, [V.similarity_edges(x, 0.25, 0.1) for x in blocks])


_CENT = """, m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY label, i),
    cent AS (SELECT label, i, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM m)"""


@query("vec06_assigned_to_centroids", "WITH " + _CENT[2:] + """, s AS (SELECT vec_id, c.label AS cluster, sum(e.x * c.x) AS score FROM (SELECT vec_id, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e JOIN cent c USING (i) GROUP BY 1, 2)
    SELECT vec_id, cluster, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cluster) AS r FROM s) WHERE r <= 2 AND score >= 0.3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = X.raw(spark, d, "embeddings")
    cent = V.centroids(e.select("label", F.col("embedding").alias("v")), "label").select(F.col("label").alias("query_id"), F.col("v").alias("q"))
    items = e.select("vec_id", F.col("embedding").alias("v"))
    return V.nearest_centroids(items, cent.select(F.col("query_id").alias("centroid"), F.col("q").alias("c")), 2, 0.3).withColumnRenamed("centroid", "cluster")


@query("vec08_cluster_factor", "WITH " + _CENT[2:] + ", s AS (SELECT vec_id, sum(e.x * c.x) AS sim FROM (SELECT vec_id, label, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e JOIN cent c USING (label, i) GROUP BY 1) SELECT vec_id, 0.9 + 0.1 * pow(least(greatest(sim, 0), 1), 1.5) AS factor FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = X.raw(spark, d, "embeddings")
    cent = F.broadcast(V.centroids(e.select("label", F.col("embedding").alias("v")), "label"))
    return e.join(cent, "label").select("vec_id", (0.9 + 0.1 * F.pow(W.clipped(W.dot(F.col("embedding"), F.col("v")), 0.0, 1.0), F.lit(1.5))).alias("factor"))


@query("agg33_mean_pair_cosine", "SELECT a.label, count(DISTINCT a.vec_id) AS n, avg(" + _DOT + ") AS mean_cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label")
def _(spark: SparkSession, d: str) -> DataFrame:
    return V.mean_pair_cosine(X.raw(spark, d, "embeddings").select("label", F.col("embedding").alias("v")), "label")


@query("vec07_alignment_default", "SELECT d.doc_id, coalesce((1 + list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))) / 2, 0.5) AS alignment FROM documents d LEFT JOIN embeddings a ON a.vec_id = d.doc_id LEFT JOIN embeddings b ON b.vec_id = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = X.raw(spark, d, "embeddings")
    anchor = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))
    rows = X.raw(spark, d, "documents").select("doc_id").join(e.select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left").crossJoin(anchor)
    return rows.select("doc_id", F.coalesce((1 + W.dot(F.col("embedding"), F.col("q"))) / 2, F.lit(0.5)).alias("alignment"))


#: Three lists per query (a nation) from the author table stand for the three paths.
_LISTS = """, lists AS (SELECT inst_id % 5 AS query_id, author_id, h_index, row_number() OVER (PARTITION BY inst_id % 5 ORDER BY h_index DESC, author_id) AS v,
        row_number() OVER (PARTITION BY inst_id % 5 ORDER BY author_id % 7, author_id) AS l, row_number() OVER (PARTITION BY inst_id % 5 ORDER BY author_id % 11 DESC, author_id) AS c FROM authors),
    vec AS (SELECT query_id, author_id, v AS rank, 1.0 / v AS score FROM lists WHERE v <= 12), lab AS (SELECT query_id, author_id, l AS rank, 1.0 / l AS score FROM lists WHERE l <= 12), col AS (SELECT query_id, author_id, c AS rank, 1.0 / c AS score FROM lists WHERE c <= 8),
    pool AS (SELECT query_id, author_id, vec.rank AS vector_rank, lab.rank AS label_rank, col.rank AS collab_rank, vec.rank IS NOT NULL AS from_vector, lab.rank IS NOT NULL AS from_label, col.rank IS NOT NULL AS from_collab,
        (vec.rank IS NOT NULL)::INT + (lab.rank IS NOT NULL)::INT + (col.rank IS NOT NULL)::INT AS path_count FROM vec FULL JOIN lab USING (query_id, author_id) FULL JOIN col USING (query_id, author_id)),
    fused AS (SELECT *, coalesce(2.0 / (60 + vector_rank), 0) + coalesce(3.0 / (60 + label_rank), 0) + coalesce(1.0 / (60 + collab_rank), 0) AS rrf_score FROM pool),
    buck AS (SELECT *, rrf_score * (1 + 0.02 * (path_count - 1)) AS pool_score, CASE WHEN from_vector AND from_label THEN 'A' WHEN from_vector AND from_collab THEN 'B' WHEN from_vector THEN 'C' WHEN from_label AND from_collab THEN 'D' WHEN from_label THEN 'E' ELSE 'F' END AS bucket FROM fused)"""


def pool(spark: SparkSession, d: str) -> DataFrame:
    rows = X.authors(spark, d).withColumn("query_id", F.col("inst_id") % 5)
    own = Window.partitionBy("query_id")

    def ranked(n: int, *order) -> DataFrame:
        rank = F.row_number().over(own.orderBy(*order))
        return rows.withColumn("rank", rank).where(F.col("rank") <= n).select("query_id", "author_id", "rank", (1.0 / F.col("rank")).alias("score"))

    lists = {"vector": ranked(12, F.desc("h_index"), "author_id"), "label": ranked(12, F.col("author_id") % 7, "author_id"), "collab": ranked(8, F.desc(F.col("author_id") % 11), "author_id")}
    return U.bucketed(U.fused(U.merged(lists)))


@query("join15_merged_paths", _LISTS + " SELECT query_id, author_id, vector_rank, label_rank, collab_rank, path_count FROM pool", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).select("query_id", "author_id", "vector_rank", "label_rank", "collab_rank", "path_count")


@query("win06_reciprocal_rank_fusion", _LISTS + " SELECT query_id, author_id, rrf_score, pool_score FROM buck", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).select("query_id", "author_id", "rrf_score", "pool_score")


@query("prj06_buckets", _LISTS + " SELECT query_id, author_id, bucket FROM buck", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).select("query_id", "author_id", "bucket")


@query("top04_bucket_quotas", _LISTS + """ SELECT query_id, author_id, bucket, final_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pool_score DESC, author_id) AS final_rank FROM
    (SELECT *, row_number() OVER (PARTITION BY query_id, bucket ORDER BY pool_score DESC, author_id) AS br FROM buck) WHERE br <= CASE bucket WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'C' THEN 3 WHEN 'D' THEN 2 WHEN 'E' THEN 2 ELSE 0 END) WHERE final_rank <= 10""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return U.quota_top(pool(spark, d), 10, {"A": 4, "B": 3, "C": 3, "D": 2, "E": 2}).select("query_id", "author_id", "bucket", "final_rank")


@query("flt15_hard_filter", _LISTS + " SELECT query_id, author_id, from_vector OR from_label AS passed, CASE WHEN from_vector OR from_label THEN '' WHEN author_id % 3 = 0 THEN 'collab_only,no_works' ELSE 'collab_only' END AS reasons FROM buck", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = pool(spark, d).withColumn("works_count", F.when(F.col("author_id") % 3 != 0, F.lit(10)))
    return U.hard_filtered(rows).select("query_id", "author_id", "passed", F.array_join("reasons", ",").alias("reasons"))


_TIER = """CASE WHEN from_vector AND from_label AND vector_rank <= 50 AND label_rank <= 50 THEN 'strong_consensus' WHEN from_label AND label_rank <= 30 THEN 'strong_label' WHEN from_vector AND vector_rank <= 30 THEN 'strong_vector'
    WHEN (from_vector AND from_label) OR (from_vector AND from_collab) OR (from_label AND from_collab) THEN 'weak_consensus' WHEN from_vector AND NOT from_label AND NOT from_collab AND vector_rank > 100 THEN 'risky_vector'
    WHEN from_label THEN 'weak_label' WHEN from_vector THEN 'weak_vector' ELSE 'other' END"""


@query("rul11_trust_tiers", _LISTS + f" SELECT query_id, author_id, {_TIER} AS tier FROM buck", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).select("query_id", "author_id", U.trust_tier().alias("tier"))


@query("mth23_final_fusion", _LISTS + """ SELECT query_id, author_id, 0.2 * pool_score + 0.2 * least(greatest(0.2 * (path_count - 1) + CASE WHEN from_label THEN 0.1 ELSE 0 END - CASE WHEN NOT from_vector AND NOT from_label THEN 0.3 ELSE 0 END, -0.3), 0.5) AS score FROM buck""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("double")
    return pool(spark, d).select("query_id", "author_id", U.final_score(F.col("pool_score"), none, U.stability()).alias("score"))


@query("win07_percentile_rank", _LISTS + " SELECT query_id, author_id, CASE WHEN count(*) OVER (PARTITION BY query_id) = 1 THEN 1.0 ELSE 1 - (row_number() OVER (PARTITION BY query_id ORDER BY h_index DESC, author_id) - 1) / (count(*) OVER (PARTITION BY query_id) - 1) END AS pr FROM lists", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.authors(spark, d).withColumn("query_id", F.col("inst_id") % 5).select("query_id", "author_id", scoring.percentile_rank(F.col("h_index"), "author_id", "query_id").alias("pr"))


@query("agg18_min_max", "SELECT c_custkey, CASE WHEN lo = 0 AND hi = 0 THEN 0 ELSE (c_acctbal - lo) / (hi - lo + 1e-8) END AS x FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return scoring.min_max(X.raw(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "x").select("c_custkey", "x")


@query("agg19_log_min_max", " SELECT work_id, (ln(1 + citation_count) - lo) / (hi - lo) AS x, 0.0 AS constant FROM works, (SELECT min(ln(1 + citation_count)) AS lo, max(ln(1 + citation_count)) AS hi FROM works)", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.log_min_max(X.works(spark, d).withColumn("one", F.lit(1)), "citation_count", "x")
    return scoring.log_min_max(rows, "one", "constant").select("work_id", "x", "constant")


@query("agg20_max_normalised", " SELECT work_id, citation_count / (SELECT max(citation_count) FROM works) AS x FROM works", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return scoring.max_normalised(X.works(spark, d), "citation_count", "x").select("work_id", "x")


@query("agg16_percentile_squash", " SELECT work_id, t * tanh(citation_count / t) AS x FROM works, (SELECT quantile_cont(citation_count, 0.95) AS t FROM works)", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return scoring.squashed(X.works(spark, d), "citation_count", "x").select("work_id", "x")


@query("agg17_median_bonus", " SELECT work_id, least(greatest(1 + 12.0 * (citation_count / 1000.0 - m), 0.82), 1.15) AS bonus FROM works, (SELECT median(citation_count / 1000.0) AS m FROM works)", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return scoring.consensus_bonus(X.works(spark, d).withColumn("c", F.col("citation_count") / 1000.0), "c", "bonus").select("work_id", "bonus")


@query("flt18_relative_cutoff", " SELECT author_id, best FROM (SELECT author_id, max(citation_count) AS best FROM authorships JOIN works USING (work_id) GROUP BY author_id) WHERE best >= 0.95 * (SELECT max(citation_count) FROM works)", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.authorships(spark, d).join(X.works(spark, d), "work_id").groupBy("author_id").agg(F.max("citation_count").alias("best"))
    return scoring.max_normalised(rows, "best", "x").where("x >= 0.95").select("author_id", "best")


@query("top02_two_phase_limit", " SELECT work_id, citation_count, year FROM (SELECT * FROM works ORDER BY citation_count DESC, work_id LIMIT 200) ORDER BY year DESC, citation_count DESC, work_id LIMIT 20", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    first = X.works(spark, d).select("work_id", "citation_count", "year").orderBy(F.desc("citation_count"), "work_id").limit(200)
    return first.orderBy(F.desc("year"), F.desc("citation_count"), "work_id").limit(20)


@query("top07_tiers", " SELECT work_id, CASE WHEN citation_count > 300 THEN 0 ELSE 1 END AS tier FROM works WHERE year = 2001 ORDER BY tier, citation_count DESC, work_id LIMIT 50", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.works(spark, d).where("year = 2001").withColumn("tier", F.when(F.col("citation_count") > 300, 0).otherwise(1))
    return rows.orderBy("tier", F.desc("citation_count"), "work_id").limit(50).select("work_id", "tier")


@query("top12_representative_work", _LISTS + " SELECT query_id, author_id, coalesce(vector_rank * 1000, label_rank * 100, collab_rank) AS work FROM buck", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).select("query_id", "author_id", F.coalesce(F.col("vector_rank") * 1000, F.col("label_rank") * 100, "collab_rank").alias("work"))


_RANKED = """WITH r AS (SELECT source AS query_id, quality AS relevant, quality + toxic AS grade, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents JOIN labels USING (doc_id)),
    w AS (SELECT *, sum(relevant) OVER (PARTITION BY query_id ORDER BY rank) AS hits, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS ideal FROM r),
    s AS (SELECT query_id, sum(relevant) FILTER (WHERE rank <= 10) AS f, sum(relevant) AS a, coalesce(sum((pow(2.0, grade) - 1) / log2(rank + 1)) FILTER (WHERE rank <= 10), 0) AS dcg,
        coalesce(sum((pow(2.0, grade) - 1) / log2(ideal + 1)) FILTER (WHERE ideal <= 10), 0) AS best, coalesce(sum(hits / rank) FILTER (WHERE rank <= 10 AND relevant = 1), 0) AS ap FROM w GROUP BY query_id)"""


@query("agg38_ranking_metrics", _RANKED + " SELECT query_id, f / 10 AS precision, CASE WHEN a > 0 THEN f / a ELSE 0 END AS recall, CASE WHEN best > 0 THEN dcg / best ELSE 0 END AS ndcg, CASE WHEN a > 0 THEN ap / least(a, 10) ELSE 0 END AS ap FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.raw(spark, d, "documents").join(X.raw(spark, d, "labels"), "doc_id")
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    ranked = rows.select(F.col("source").alias("query_id"), F.col("quality").alias("relevant"), (F.col("quality") + F.col("toxic")).alias("grade"), rank.alias("rank"))
    return metrics.ranking_metrics(ranked, 10)


@query("agg38_auc", "WITH x AS (SELECT n_chars AS score, quality AS y FROM documents JOIN labels USING (doc_id)) SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) / count(*) AS auc FROM x p, x n WHERE p.y = 1 AND n.y = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return metrics.auc(X.raw(spark, d, "documents").join(X.raw(spark, d, "labels"), "doc_id").select(F.col("n_chars").alias("score"), F.col("quality").alias("y")))


@query("prj07_list_to_rows", "SELECT doc_id, unnest(range(1, 4)) AS rank, unnest([lang, source, CAST(n_chars AS VARCHAR)]) AS item FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "documents").select("doc_id", F.posexplode(F.array("lang", "source", F.col("n_chars").cast("string"))).alias("rank", "item")).withColumn("rank", (F.col("rank") + 1).cast("long"))


@query("map10_evidence_rows", _LISTS + " SELECT query_id, author_id, path, rank FROM (SELECT query_id, author_id, 'vector' AS path, vector_rank AS rank FROM buck UNION ALL SELECT query_id, author_id, 'label', label_rank FROM buck UNION ALL SELECT query_id, author_id, 'collab', collab_rank FROM buck) WHERE rank IS NOT NULL", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.col(f"{p}_rank").alias("rank")) for p in U.PATHS])
    return pool(spark, d).select("query_id", "author_id", F.explode(F.filter(each, lambda e: e["rank"].isNotNull())).alias("e")).select("query_id", "author_id", "e.path", "e.rank")
