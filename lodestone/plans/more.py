"""Queries on the remaining filters, aggregates, factors and vector steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import text as T
from ..functions import weights as W
from ..operators import vectors as V
from .registry import query
from .retrieval import _CENT, _DOT, _LISTS, pool

_T = ("works", "authorships", "authors")


@query("flt14_author_domain_filter", " SELECT DISTINCT author_id FROM authorships JOIN works USING (work_id) WHERE len(list_intersect(string_split(domain_ids, '|'), ['3', '5'])) > 0 AND citation_count > 450", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    near = X.works(spark, d).where(F.arrays_overlap(T.domains(F.col("domain_ids")), F.array(F.lit("3"), F.lit("5")))).where("citation_count > 450").select("work_id")
    return X.authorships(spark, d).join(near, "work_id", "left_semi").select("author_id").distinct()


@query("flt16_risk_flags", _LISTS + """ SELECT query_id, author_id, array_to_string(list_filter([CASE WHEN from_label AND NOT from_vector THEN 'label_only' END, CASE WHEN label_rank > 8 THEN 'low_label' END, CASE WHEN path_count = 1 THEN 'single_path' END], lambda x: x IS NOT NULL), ',') AS flags FROM buck""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    flags = F.array_compact(F.array(F.when(F.col("from_label") & ~F.col("from_vector"), F.lit("label_only")), F.when(F.col("label_rank") > 8, F.lit("low_label")), F.when(F.col("path_count") == 1, F.lit("single_path"))))
    return pool(spark, d).select("query_id", "author_id", F.array_join(flags, ",").alias("flags"))


@query("flt22_flt23_edges", "SELECT s_suppkey % 10 AS h, s_nationkey % 10 AS t, sum(s_acctbal) AS w FROM supplier WHERE s_suppkey % 10 <> s_nationkey % 10 AND s_acctbal > 0 GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.raw(spark, d, "supplier").select((F.col("s_suppkey") % 10).alias("h"), (F.col("s_nationkey") % 10).alias("t"), "s_acctbal")
    return rows.where("h <> t and s_acctbal > 0").groupBy("h", "t").agg(F.sum("s_acctbal").alias("w"))


_FRAGMENT = "(lower(trim(s)) LIKE 'the %' OR lower(trim(s)) LIKE 'and %' OR regexp_matches(trim(s), '[.!?]$') OR length(trim(s)) < 3)"


@query("flt25_sentence_fragments", f"SELECT doc_id, count(*) FILTER (WHERE {_FRAGMENT}) AS fragments, count(*) AS parts FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) GROUP BY doc_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = F.trim("s")
    fragment = F.lower(s).startswith("the ") | F.lower(s).startswith("and ") | s.rlike("[.!?]$") | (F.length(s) < 3)
    rows = X.raw(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("s"))
    return rows.groupBy("doc_id").agg(F.count_if(fragment).alias("fragments"), F.count(F.lit(1)).alias("parts"))


@query("join26_domain_names", "SELECT p_partkey, w AS name FROM part, (SELECT unnest(['small', 'red', 'gold', 'wheel', 'ring']) AS w) WHERE contains(lower(p_name), w)")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in ("small", "red", "gold", "wheel", "ring")])
    return X.raw(spark, d, "part").select("p_partkey", F.explode(F.filter(names, lambda w: F.contains(F.lower("p_name"), w))).alias("name"))


@query("join29_cross_anchor_pairs", f"""WITH s AS (SELECT a.vec_id AS a, b.vec_id AS b, {_DOT} AS sim FROM embeddings a, embeddings b WHERE a.label <> b.label AND a.vec_id % 50 = 0)
    SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS r FROM s WHERE sim >= 0.05) WHERE r <= 4""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = X.raw(spark, d, "embeddings")
    left = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("a"), F.col("label").alias("la"), F.col("embedding").alias("q"))
    blocks = V.scored_pairs(left, e.select(F.col("vec_id").alias("b"), "label", F.col("embedding").alias("v")), 0.05, key="a", k=4, apart=("la", "label"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    best = [x.select("a", "b", F.col("score").alias("sim")).withColumn("r", rank).where("r <= 4").drop("r") for x in blocks]
    return reduce(DataFrame.unionByName, best)


@query("agg12_sum_and_max_per_target", "SELECT l_suppkey AS target, sum(m) AS total, max(m) AS best FROM (SELECT l_suppkey, l_partkey, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    best = X.raw(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_quantity").alias("m"))
    return best.groupBy(F.col("l_suppkey").alias("target")).agg(F.sum("m").alias("total"), F.max("m").alias("best"))


@query("agg24_collected_lists", " SELECT work_id, string_agg(author_id || ':' || pos_index, ',' ORDER BY pos_index, author_id) AS authors FROM authorships GROUP BY work_id", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.authorships(spark, d).groupBy("work_id").agg(F.array_sort(F.collect_list(F.struct("pos_index", "author_id"))).alias("a"))
    return rows.select("work_id", F.array_join(F.transform("a", lambda x: F.concat_ws(":", x["author_id"].cast("string"), x["pos_index"].cast("string"))), ",").alias("authors"))


@query("agg34_isolation", f"SELECT a.vec_id, 1 - avg({_DOT}) AS isolation FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = X.raw(spark, d, "embeddings")
    each = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    sums = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda t: t["s"]).alias("sum"))
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    v = F.col("embedding")
    return e.withColumn("n", n).where("n > 1").join(F.broadcast(sums), "label").select("vec_id", (1 - (W.dot(v, F.col("sum")) - W.dot(v, v)) / (F.col("n") - 1)).alias("isolation"))


@query("agg35_distinct_axes", " SELECT author_id, count(DISTINCT type) AS axes, count(DISTINCT year) AS years FROM authorships JOIN works USING (work_id) GROUP BY author_id", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.authorships(spark, d).join(X.works(spark, d), "work_id").groupBy("author_id").agg(F.collect_set("type").alias("t"), F.collect_set("year").alias("y"))
    return rows.select("author_id", F.size("t").cast("long").alias("axes"), F.size("y").cast("long").alias("years"))


@query("agg44_support_only", "SELECT l_orderkey, max(l_quantity) FILTER (WHERE l_returnflag = 'R') AS best_primary, max(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS best_support, bool_or(l_returnflag = 'R') AS any_primary, count(*) FILTER (WHERE l_returnflag = 'R') AS n_primary FROM lineitem GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_returnflag") == "R"
    return X.raw(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(p, q)).alias("best_primary"), F.max(F.when(~p, q)).alias("best_support"), F.bool_or(p).alias("any_primary"), F.count_if(p).alias("n_primary"))


@query("win11_ranks", "SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer ORDER BY rank LIMIT 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    top = X.raw(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100)
    return top.select("c_custkey", F.row_number().over(Window.orderBy(F.desc("c_acctbal"), "c_custkey")).alias("rank"))


@query("top09_light_score", " SELECT author_id, score FROM (SELECT author_id, 0.6 * ln(1 + sum(citation_count)) + 0.4 * count(DISTINCT work_id) / 100.0 AS score FROM authorships JOIN works USING (work_id) GROUP BY author_id) ORDER BY score DESC, author_id LIMIT 20", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.authorships(spark, d).join(X.works(spark, d), "work_id").groupBy("author_id").agg((0.6 * F.log1p(F.sum("citation_count")) + 0.4 * F.countDistinct("work_id") / 100.0).alias("score"))
    return rows.orderBy(F.desc("score"), "author_id").limit(20)


@query("top08_floors_and_fallback", """WITH t AS (SELECT p_brand, p_type, count(*) AS n, avg(p_retailprice) AS score FROM part GROUP BY 1, 2), ok AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY score DESC, p_brand) AS r FROM t WHERE n >= 10)
    SELECT p_brand, p_type FROM ok WHERE r <= 5""")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = X.raw(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("score")).where("n >= 10")
    return t.withColumn("r", F.row_number().over(Window.partitionBy("p_type").orderBy(F.desc("score"), "p_brand"))).where("r <= 5").select("p_brand", "p_type")


@query("mth05_penalties", "SELECT p_partkey, pow(p_size / 50.0, 0.7) * pow(p_retailprice / 2000, 0.3) AS gate, CASE WHEN p_size > 40 THEN 0.5 WHEN p_size > 25 THEN 0.8 ELSE 1.0 END AS generic, least(greatest(1 - 0.3 * p_size / 50.0, 0.2), 1.0) AS external FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return X.raw(spark, d, "part").select(
        "p_partkey", (F.pow(s / 50.0, F.lit(0.7)) * F.pow(F.col("p_retailprice") / 2000, F.lit(0.3))).alias("gate"), F.when(s > 40, 0.5).when(s > 25, 0.8).otherwise(1.0).alias("generic"), W.clipped(1 - 0.3 * s / 50.0, 0.2, 1.0).alias("external")
    )


@query("mth16_structure_multiplier", " SELECT author_id, CASE WHEN n = 1 THEN 0.73 WHEN n < 5 THEN 0.86 ELSE 1.0 END AS papers, 0.9 + 0.1 * least(1.0, n / 20.0) + 0.05 * top / 500.0 AS structure FROM (SELECT author_id, count(DISTINCT work_id) AS n, max(citation_count) AS top FROM authorships JOIN works USING (work_id) GROUP BY author_id)", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.authorships(spark, d).join(X.works(spark, d), "work_id").groupBy("author_id").agg(F.countDistinct("work_id").alias("n"), F.max("citation_count").alias("top"))
    n = F.col("n")
    return rows.select("author_id", F.when(n == 1, 0.73).when(n < 5, 0.86).otherwise(1.0).alias("papers"), (0.9 + 0.1 * F.least(F.lit(1.0), n / 20.0) + 0.05 * F.col("top") / 500.0).alias("structure"))


@query("mth22_domain_fit", _LISTS + " SELECT query_id, author_id, 0.4 * coalesce(1.0 / vector_rank, 0) + 0.3 * coalesce(1.0 / label_rank, 0) + 0.2 * coalesce(1.0 / collab_rank, 0) + 0.1 * path_count / 3.0 AS fit FROM buck", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    parts = [(w, 1.0 / F.col(f"{p}_rank")) for w, p in ((0.4, "vector"), (0.3, "label"), (0.2, "collab"))]
    return pool(spark, d).select("query_id", "author_id", W.blend(*parts, (0.1, F.col("path_count") / 3.0)).alias("fit"))


@query("mth28_grounding", "SELECT doc_id, 0.55 * l + 0.20 * a + 0.25 * x AS grounding FROM (SELECT doc_id, (contains(text, 'the')::INT + contains(text, 'and')::INT) / 2.0 AS l, CASE WHEN lang = 'en' THEN 1.0 ELSE 0.3 END AS a, least(1.0, n_chars / 5000.0) AS x FROM documents)")
def _(spark: SparkSession, d: str) -> DataFrame:
    lexical = (F.col("text").contains("the").cast("int") + F.col("text").contains("and").cast("int")) / 2.0
    return X.raw(spark, d, "documents").select("doc_id", W.blend((0.55, lexical), (0.20, F.when(F.col("lang") == "en", 1.0).otherwise(0.3)), (0.25, F.least(F.lit(1.0), F.col("n_chars") / 5000.0))).alias("grounding"))


_PHRASES = ["metal", "ring", "red ring", "Steel Bolt", "bolt", "hot red gear"]
_LOW = [p.lower() for p in _PHRASES]


@query("str24_phrase_counters", f"""SELECT p_partkey, least(1.0, 0.3 + 0.15 * least(len(list_filter(string_split(low, ' '), lambda w: w <> '')), 6) + 0.55 * (1.0 - len(list_filter({_LOW}, lambda p: p <> low AND length(p) >= length(low) AND contains(p, low))) / 6.0)) AS specificity,
    CASE WHEN place = 0 THEN 0.3 ELSE 0.2 + 0.8 * least(len(list_filter({_LOW}, lambda p: p <> low AND contains(body, p))) / 5.0, 1.0) END AS richness
    FROM (SELECT p_partkey, lower(p_name) AS low, lower('some ' || CASE WHEN p_size > 10 THEN p_name ELSE '' END || ' with red ring and steel bolt') AS body, strpos(body, low) AS place FROM part)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    all_ = F.array(*[F.lit(p) for p in _PHRASES])
    body = F.concat(F.lit("Some "), F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(""), F.lit(" with red ring and steel bolt"))
    return X.raw(spark, d, "part").select("p_partkey", T.phrase_specificity(F.col("p_name"), all_).alias("specificity"), T.phrase_richness(F.col("p_name"), body, all_).alias("richness"))


@query("str25_term_classes", " SELECT voc_id, CASE WHEN length(t) < 2 THEN 'unknown' WHEN t IN ('economy', 'small') THEN 'acronym' WHEN t = 'system' THEN 'generic_task_term' WHEN contains(t, 'engineering') THEN 'application_term' ELSE 'canonical_academic_like' END AS kind FROM (SELECT voc_id, CASE voc_id % 4 WHEN 0 THEN 'system' WHEN 1 THEN term || ' engineering' WHEN 2 THEN substr(term, 1, 1) ELSE term END AS t FROM vocabulary)", "vocabulary")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("voc_id") % 4
    term = F.when(k == 0, "System ").when(k == 1, F.concat("term", F.lit(" Engineering"))).when(k == 2, F.substring("term", 1, 1)).otherwise(F.col("term"))
    return X.vocabulary(spark, d).select("voc_id", T.anchor_type(term, F.array(F.lit("economy"), F.lit("small"))).alias("kind"))


@query("str27_identity_surface", "SELECT p_partkey, p_name || ' (x y) end-to-end' AS raw, lower(p_name) || ' end to end' AS norm, len(string_split(p_name, ' ')) + 3 AS tokens, string_split(lower(p_name), ' ')[1] AS head FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = T.identity_surface(F.concat(F.lit(" "), "p_name", F.lit(" (x y) end-to-end")))
    return X.raw(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", "s.raw", "s.norm", F.size("s.tokens").cast("long").alias("tokens"), "s.head")


@query("vec10_domain_selection", "WITH " + _CENT[2:] + """, s AS (SELECT vec_id, c.label AS domain, sum(e.x * c.x) AS score FROM (SELECT vec_id, unnest(range(1, 65)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) e JOIN cent c USING (i) GROUP BY 1, 2)
    SELECT vec_id AS query_id, domain, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, domain) AS r FROM s) WHERE r <= 3""")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = X.raw(spark, d, "embeddings")
    domains = V.centroids(e.select("label", F.col("embedding").alias("v")), "label").select(F.col("label").alias("centroid"), F.col("v").alias("c"))
    return V.nearest_centroids(e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v")), domains, 3).withColumnRenamed("centroid", "domain")


@query("vec11_filtered_neighbours", f"SELECT query_id, item_id, score FROM (SELECT a.vec_id AS query_id, b.vec_id AS item_id, {_DOT} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_DOT} DESC, b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND b.label % 2 = 0 AND {_DOT} >= 0.1) WHERE r <= 6")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = X.raw(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return V.top_k(queries, e.where("label % 2 = 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("v")), 6, 0.1).select("query_id", "item_id", "score")


@query("vec13_median_split", "WITH s AS (SELECT b.vec_id, " + _DOT + " AS sim FROM embeddings a, embeddings b WHERE a.vec_id = 0) SELECT vec_id, sim >= (SELECT median(sim) FROM s) AS task FROM s")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = X.raw(spark, d, "embeddings")
    anchor = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("q")))
    rows = e.crossJoin(anchor).select("vec_id", W.dot(F.col("q"), F.col("embedding")).alias("sim"))
    return rows.crossJoin(F.broadcast(rows.agg(F.median("sim").alias("m")))).select("vec_id", (F.col("sim") >= F.col("m")).alias("task"))


@query("vec14_shared_queries", "SELECT text, count(*) AS askers, min(doc_id) AS asked_by FROM documents GROUP BY text HAVING count(*) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("askers"), F.min("doc_id").alias("asked_by")).where("askers > 1")
