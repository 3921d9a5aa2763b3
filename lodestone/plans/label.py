"""Queries on the graph path. Jobs are customers, their skills the terms of what they ordered; terms are similar by how often they meet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import weights as W
from ..operators import graph
from ..operators import label as L
from ..operators import statistics as S
from ..operators.reach import reached
from ..operators.storage import few, once
from .registry import query
from .stats import _COOC, _HIST, _WV, cooccurrence, histogram, work_vocabulary, work_words

_T = ("works", "authorships", "authors", "terms", "vocabulary")
_SIM = _WV + _COOC + """, deg AS (SELECT voc_id, count(*) AS degree FROM wv GROUP BY voc_id),
    sim AS (SELECT p.voc_id AS src, p.partner AS dst, freq / sqrt(a.degree * b.degree) AS score FROM partners p JOIN deg a ON a.voc_id = p.voc_id JOIN deg b ON b.voc_id = p.partner)"""
_SKILL = """, skill AS (SELECT DISTINCT o_custkey AS job_id, voc_id FROM orders JOIN wv ON work_id = o_orderkey), jobs AS (SELECT c_nationkey % 5 AS query_id, c_custkey AS job_id FROM customer)"""
_ANCH = _SKILL + """, cov AS (SELECT voc_id, count(DISTINCT job_id) / (SELECT count(DISTINCT job_id) FROM skill) AS coverage FROM skill GROUP BY voc_id),
    anchors AS (SELECT query_id, voc_id, count(DISTINCT job_id) AS job_freq, any_value(coverage) AS coverage FROM jobs JOIN skill USING (job_id) JOIN cov USING (voc_id) WHERE coverage < 0.95 GROUP BY query_id, voc_id)"""
_HITS = """, seeds AS (SELECT query_id, voc_id, job_freq / 10.0 AS score FROM anchors), idfs AS (SELECT voc_id, log10((SELECT count(*) FROM works) / (degree + 1)) AS idf FROM deg WHERE degree / (SELECT count(*) FROM works) < 0.3),
    hits AS (SELECT s.query_id, w.work_id, s.voc_id, idf, year, score FROM seeds s JOIN idfs USING (voc_id) JOIN wv w ON w.voc_id = s.voc_id JOIN works USING (work_id))"""
_PAIRS = """, pairs AS (SELECT query_id, work_id, voc_id, idf, score * idf * CASE WHEN 2001 - year <= 3 THEN 1.0 WHEN 2001 - year <= 6 THEN 0.5 WHEN 2001 - year <= 10 THEN 0.2 ELSE 0.01 END AS value,
        round(idf / sum(idf) OVER (PARTITION BY query_id, work_id), 6) AS grounding, round(score / (SELECT max(s.score) FROM seeds s WHERE s.query_id = hits.query_id), 6) AS align FROM hits),
    gated AS (SELECT query_id, work_id, voc_id, idf, role, value FROM (SELECT *, row_number() OVER (PARTITION BY query_id, voc_id, role ORDER BY value DESC, work_id) AS r FROM (
        SELECT query_id, work_id, voc_id, idf, role, value * CASE WHEN role = 'secondary' THEN 0.65 ELSE 1.0 END AS value FROM (
            SELECT *, CASE WHEN grounding >= 0.12 THEN 'primary' WHEN grounding >= 0.06 AND align >= 0.78 THEN 'secondary' END AS role FROM pairs) WHERE role IS NOT NULL)) WHERE r <= CASE role WHEN 'primary' THEN 15 ELSE 3 END)"""


def skill_words(spark: SparkSession, d: str) -> DataFrame:
    """job_id, word, bits: the skills of jobs, packed."""
    return once(spark, "skill words", d, lambda: _skill_words(spark, d))


def _skill_words(spark: SparkSession, d: str) -> DataFrame:
    orders = X.raw(spark, d, "orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_custkey").alias("job_id"))
    return S.merged(orders.join(work_words(spark, d), "work_id"), "job_id")


def skills(spark: SparkSession, d: str) -> DataFrame:
    return S.spelled(skill_words(spark, d))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("query_id"), F.col("c_custkey").alias("job_id"))


def similar(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, "similar", d, lambda: _similar(spark, d))


def _similar(spark: SparkSession, d: str) -> DataFrame:
    degree = few(S.counted(work_words(spark, d)).withColumnRenamed("n", "degree"))
    p = S.partners(cooccurrence(spark, d)).join(degree, "voc_id").join(degree.select(F.col("voc_id").alias("partner"), F.col("degree").alias("other")), "partner")
    return p.select(F.col("voc_id").alias("src"), F.col("partner").alias("dst"), (F.col("freq") / F.sqrt(F.col("degree") * F.col("other"))).alias("score"))


def anchors(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, "anchors", d, lambda: L.anchors(jobs(spark, d), skill_words(spark, d), 0.95))


@query("join22_anchors", _WV + _ANCH + " SELECT * FROM anchors", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return anchors(spark, d)


@query("mth26_anchor_score", _WV + _ANCH + """, s AS (SELECT *, voc_id % 2 = 0 AS t, voc_id % 3 = 0 AS k, 0.15 * ln(1 + job_freq) + 0.2 * (1 - least(1, coverage)) + 0.1 / 11 + 0.35 * (voc_id % 2 = 0)::INT + 0.35 * (voc_id % 3 = 0)::INT + 0.2 * coverage AS x FROM anchors)
    SELECT query_id, voc_id, CASE WHEN t AND k THEN greatest(x, 0.5) ELSE x END AS score FROM s""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    score = L.anchor_score(F.col("job_freq"), F.col("coverage"), F.lit(None).cast("int"), F.col("voc_id") % 2 == 0, F.col("voc_id") % 3 == 0, F.col("coverage"))
    return anchors(spark, d).select("query_id", "voc_id", score.alias("score"))


@query("join21_similar_terms", _SIM + " SELECT src AS anchor, dst, score FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM sim WHERE score >= 0.1) WHERE r <= 5", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return graph.expanded(X.vocabulary(spark, d).select(F.col("voc_id").alias("anchor")), similar(spark, d), 0.1, 5)


@query("join36_landings", _SIM + _ANCH + """, near AS (SELECT query_id, voc_id AS anchor, dst, score, row_number() OVER (PARTITION BY query_id, voc_id ORDER BY score DESC, dst) AS r FROM anchors JOIN sim ON src = voc_id WHERE score >= 0.1)
    SELECT query_id, dst AS voc_id, max(score) AS sim, count(DISTINCT anchor) AS sources FROM near WHERE r <= 8 GROUP BY 1, 2""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return L.landings(anchors(spark, d), similar(spark, d), 8, 0.1)


def hits(spark: SparkSession, d: str) -> DataFrame:
    terms = anchors(spark, d).select("query_id", "voc_id", (F.col("job_freq") / 10.0).alias("score"))
    return L.hits(terms, work_words(spark, d), X.works(spark, d), 0.3)


def gated(spark: SparkSession, d: str) -> DataFrame:
    """Hits with grounding, a term's share of what a work's hits weigh, and alignment, its jobs against those of the query's first term."""
    most = anchors(spark, d).groupBy("query_id").agg((F.max("job_freq") / 10.0).alias("most"))
    own = Window.partitionBy("query_id", "work_id")
    rows = hits(spark, d).join(F.broadcast(most), "query_id").select(
        "query_id", "work_id", "voc_id", "idf", (F.col("score") * F.col("idf") * W.recency(F.col("year"))).alias("value"), F.round(F.col("idf") / F.sum("idf").over(own), 6).alias("grounding"), F.round(F.col("score") / F.col("most"), 6).alias("align")
    )
    return L.gated(rows, {"primary": 15, "secondary": 3})


@query("join19_term_works", _SIM + _ANCH + _HITS + " SELECT * FROM hits", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d)


@query("flt17_win05_gate_and_cap", _SIM + _ANCH + _HITS + _PAIRS + " SELECT query_id, work_id, voc_id, role, value FROM gated", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return gated(spark, d).select("query_id", "work_id", "voc_id", "role", "value")


_WORKS = """, once AS (SELECT query_id, work_id, voc_id, max(struct_pack(idf := idf, value := value)) AS m FROM gated GROUP BY 1, 2, 3),
    ws AS (SELECT query_id, work_id, count(*) AS n_terms, sum(m.value) AS v FROM once GROUP BY 1, 2)"""


@query("agg26_work_scores", _SIM + _ANCH + _HITS + _PAIRS + _WORKS + " SELECT query_id, work_id, n_terms, v * ln(1 + n_terms) / ln(2.0 + n_terms) AS score FROM ws", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return L.work_scores(gated(spark, d))


_AUTH = """, e AS (SELECT g.query_id, author_id, g.work_id, voc_id, value FROM gated g JOIN (SELECT DISTINCT work_id, author_id FROM authorships) USING (work_id)),
    tr AS (SELECT *, row_number() OVER (PARTITION BY query_id, author_id, voc_id ORDER BY value DESC, work_id) AS r FROM e),
    ts AS (SELECT query_id, author_id, voc_id, sum(value * pow(0.6, r - 1)) AS s FROM tr GROUP BY 1, 2, 3),
    cs AS (SELECT query_id, author_id, sum(c) AS s FROM (SELECT *, least(s, 0.25 * sum(s) OVER (PARTITION BY query_id, author_id)) AS c FROM ts) GROUP BY 1, 2)"""


@query("agg14_agg15_author_scores", _SIM + _ANCH + _HITS + _PAIRS + _AUTH + """ SELECT query_id, author_id, papers, s * CASE WHEN papers = 1 THEN 0.73 ELSE 1.0 END AS score
    FROM cs JOIN (SELECT query_id, author_id, count(DISTINCT work_id) AS papers FROM e GROUP BY 1, 2) USING (query_id, author_id)""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return L.author_scores(gated(spark, d), X.authorships(spark, d))


@query("join20_work_authors", _SIM + _ANCH + _HITS + _PAIRS + " SELECT work_id, array_to_string(list_sort(list(DISTINCT author_id)), ',') AS authors FROM gated JOIN authorships USING (work_id) GROUP BY work_id", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = gated(spark, d).select("work_id").distinct().join(X.authorships(spark, d), "work_id")
    return rows.groupBy("work_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("author_id")), lambda x: x.cast("string")), ",").alias("authors"))


_TERMS = _HIST + ", x AS (SELECT 1 AS query_id, r.voc_id, max(ratio) AS score, any_value(CASE WHEN entity_type = 'concept' THEN 'primary' ELSE 'support' END) AS role, r.voc_id % 4 AS family FROM ratio r JOIN vocabulary USING (voc_id) GROUP BY r.voc_id)"


def _terms(spark: SparkSession, d: str) -> DataFrame:
    ratio = S.domain_ratio(histogram(spark, d))
    rows = ratio.groupBy("voc_id").agg(F.max("ratio").alias("score")).join(X.vocabulary(spark, d), "voc_id")
    return rows.select(F.lit(1).alias("query_id"), "voc_id", "score", F.when(F.col("entity_type") == "concept", "primary").otherwise("support").alias("role"), (F.col("voc_id") % 4).alias("family"))


@query("win13_family_adjusted", _TERMS + """, b AS (SELECT *, max(score) FILTER (WHERE role = 'primary') OVER (PARTITION BY family) AS best FROM x)
    SELECT voc_id, CASE WHEN role = 'primary' AND score = best THEN score * 1.05 WHEN role <> 'primary' AND best IS NOT NULL AND score < 1.10 * best THEN least(score, 0.98 * best) ELSE score END AS score FROM b""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return L.family_adjusted(_terms(spark, d)).select("voc_id", "score")


@query("win08_tail_decay", _TERMS + """, b AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY family) AS n FROM x WINDOW w AS (PARTITION BY family ORDER BY score DESC, voc_id))
    SELECT voc_id, CASE WHEN n <= 3 OR r <= 4 THEN 1.0 ELSE pow(0.85, r - 4) END AS factor FROM b""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return L.tail_decay(_terms(spark, d), "family").select("voc_id", "factor")


@query("mth20_term_score", _TERMS + """, c AS (SELECT voc_id, score, least(greatest(0.90 + 0.12 * least(1.0, (voc_id % 5) / 5.0) + 0.08 * least(1.0, (voc_id % 4) / 3.0), 0.9), 1.1) AS cr,
        least(greatest(0.45 * (1 - score) + 0.25 * (1 - score) + 0.30 / greatest(voc_id % 5, 1), 0.0), 1.0) AS drift FROM x)
    SELECT voc_id, cr AS "cross", drift, 0.88 * least(greatest(0.38 * score + 0.34 * cr + 0.28 * score - 0.42 * drift, 0.0), 1.0) + 0.12 * score AS total FROM c""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    s, v = F.col("score"), F.col("voc_id")
    cross, drift = L.consensus(v % 5, F.lit(5.0), v % 4, 1 - s, s)
    rows = _terms(spark, d).select("voc_id", "score", cross.alias("cross"), drift.alias("drift"))
    return rows.select("voc_id", "cross", "drift", L.term_score(F.col("score"), F.col("cross"), F.col("score"), F.col("drift"), F.col("score")).alias("total"))


@query("join23_job_to_author_path", _SIM + _SKILL + """, st AS (SELECT job_id, voc_id FROM skill WHERE job_id % 50 = 0), hop AS (SELECT job_id, coalesce(dst, voc_id) AS voc_id FROM st LEFT JOIN (SELECT * FROM sim WHERE score > 0.7) ON src = voc_id)
    SELECT job_id, author_id, count(DISTINCT work_id) AS works FROM (SELECT DISTINCT job_id, voc_id FROM hop) JOIN wv USING (voc_id) JOIN authorships USING (work_id) GROUP BY 1, 2""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    # A search: every fiftieth job asks, against all terms, works and authors.
    near = similar(spark, d).where("score > 0.7").select(F.col("src").alias("voc_id"), "dst")
    hop = skills(spark, d).where("job_id % 50 = 0").join(near, "voc_id", "left").select("job_id", F.coalesce("dst", "voc_id").alias("voc_id")).distinct()
    groups = hop.select(F.col("job_id").alias("group"), F.col("voc_id").alias("key"))
    items = work_vocabulary(spark, d).select(F.col("work_id").alias("item"), F.col("voc_id").alias("key"))
    found = reached(groups, items, X.authorships(spark, d).select(F.col("work_id").alias("item"), F.col("author_id").alias("end")))
    return found.select(F.col("group").alias("job_id"), F.col("end").alias("author_id"), F.col("n").alias("works"))


@query("join30_same_anchor_pairs", _SIM + " , t AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM sim) SELECT a.src AS anchor, a.dst AS t1, b.dst AS t2 FROM t a JOIN t b ON a.src = b.src AND a.dst < b.dst WHERE a.r <= 6 AND b.r <= 6", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    top = graph.expanded(X.vocabulary(spark, d).select(F.col("voc_id").alias("anchor")), similar(spark, d), 0.0, 6).select("anchor", "dst")
    return top.select("anchor", F.col("dst").alias("t1")).join(top.select("anchor", F.col("dst").alias("t2")), "anchor").where("t1 < t2")


@query("join32_sampled_triples", """, tr AS (SELECT l_orderkey AS h, 1 AS r, l_suppkey + 10000000 AS t FROM lineitem UNION ALL SELECT s_suppkey + 10000000, 6, s_suppkey + 10000001 FROM supplier), f AS (SELECT * FROM tr WHERE h % 97 = 0 AND h < 10000000),
    ids AS (SELECT h AS id FROM f UNION SELECT t FROM f) SELECT h, r, t FROM f UNION SELECT h, r, t FROM tr WHERE r = 6 AND h IN (SELECT id FROM ids) AND t IN (SELECT id FROM ids)""", "works")
def _(spark: SparkSession, d: str) -> DataFrame:
    triples = X.raw(spark, d, "lineitem").select(F.col("l_orderkey").alias("h"), F.lit(1).alias("r"), (F.col("l_suppkey") + 10000000).alias("t"))
    s = X.raw(spark, d, "supplier").select((F.col("s_suppkey") + 10000000).alias("h"), F.lit(6).alias("r"), (F.col("s_suppkey") + 10000001).alias("t"))
    seeds = X.raw(spark, d, "orders").where("o_orderkey % 97 = 0").select(F.col("o_orderkey").alias("id"))
    return graph.sampled(triples.unionByName(s), seeds, 6)


@query("agg43_payload_summary", _SIM + _ANCH + _HITS + _PAIRS + ", e AS (SELECT author_id, g.work_id, max(value) AS v, bool_or(role = 'primary') AS p FROM gated g JOIN (SELECT DISTINCT work_id, author_id FROM authorships) USING (work_id) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY v DESC, work_id) AS r FROM e) SELECT author_id, count(*) AS papers, max(v) AS top, sum(v) FILTER (WHERE r <= 3) AS top3, count(*) FILTER (WHERE p) AS with_primary, bool_and(NOT p) AS support_only FROM k GROUP BY 1", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    each = gated(spark, d).join(X.authorships(spark, d).select("work_id", "author_id").distinct(), "work_id").groupBy("author_id", "work_id").agg(F.max("value").alias("v"), F.bool_or(F.col("role") == "primary").alias("p"))
    rows = each.withColumn("r", F.row_number().over(Window.partitionBy("author_id").orderBy(F.desc("v"), "work_id")))
    return rows.groupBy("author_id").agg(F.count(F.lit(1)).alias("papers"), F.max("v").alias("top"), F.sum(F.when(F.col("r") <= 3, F.col("v"))).alias("top3"), F.count_if("p").alias("with_primary"), F.bool_and(~F.col("p")).alias("support_only"))
