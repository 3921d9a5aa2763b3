"""Queries on anchors in context. A query's text are the parts that its first customer ordered, an order to a sentence; a term's vector is how its share of each domain differs from the usual."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import roles as R
from ..operators import anchoring as A
from ..operators import statistics as S
from ..operators import vectors as V
from ..operators.storage import few, once, stored
from .label import _ANCH, _SIM, _T, jobs, skill_words
from .landing import relative_similar, top_anchors
from .registry import query
from .stats import _HIST, _WV, histogram


def texts(spark: SparkSession, d: str) -> DataFrame:
    """query_id, text."""
    orders = X.raw(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("job_id"))
    own = jobs(spark, d).join(orders, "job_id")
    first = own.groupBy("query_id").agg(F.min("job_id").alias("job_id"))
    # The orders of one customer a query: lines are read past them, and parts past those lines.
    mine = few(own.join(F.broadcast(first), ["query_id", "job_id"]))
    parts = few(X.raw(spark, d, "lineitem").join(mine, "l_orderkey").select("query_id", "l_orderkey", "l_linenumber", "l_partkey")).join(X.raw(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    lines = parts.groupBy("query_id", "l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))), lambda e: e["p_name"]), ", ").alias("s"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "s"))), lambda e: e["s"]), "。").alias("text"))


def term_vectors(spark: SparkSession, d: str) -> DataFrame:
    """voc_id, v (unit): a term's share of each domain less the mean over all terms."""
    return once(spark, "term vectors", d, lambda: _term_vectors(spark, d))


def _term_vectors(spark: SparkSession, d: str) -> DataFrame:
    ratio = S.domain_ratio(histogram(spark, d)).select("voc_id", "domain_id", "ratio")
    terms = ratio.select("voc_id").distinct()
    domains = ratio.select("domain_id").distinct()
    n = terms.agg(F.count(F.lit(1)).alias("terms"))
    mean = ratio.groupBy("domain_id").agg(F.sum("ratio").alias("s")).crossJoin(F.broadcast(n)).select("domain_id", (F.col("s") / F.col("terms")).alias("mean"))
    # Seventeen domains, broadcast: each term gets a row for each of them.
    full = terms.crossJoin(F.broadcast(domains.join(mean, "domain_id"))).join(ratio, ["voc_id", "domain_id"], "left")
    each = full.select("voc_id", "domain_id", (F.coalesce("ratio", F.lit(0.0)) - F.col("mean")).alias("x"))
    rows = each.groupBy("voc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("domain_id", "x"))), lambda e: e["x"]).alias("v"))
    return V.normalised(rows, "v")


def terms(spark: SparkSession, d: str) -> DataFrame:
    return term_vectors(spark, d).join(X.vocabulary(spark, d), "voc_id")


def job_vectors(spark: SparkSession, d: str) -> DataFrame:
    """query_id, job (unit): the mean vector of a query's anchors."""
    rows = top_anchors(spark, d).join(term_vectors(spark, d).withColumnRenamed("voc_id", "anchor_id"), "anchor_id").select("query_id", "v")
    return V.centroids(rows, "query_id").withColumnRenamed("v", "job")


_COARSE = """, pa AS (SELECT query_id, anchor_id, job_freq, coverage, place, term FROM ta JOIN vocabulary ON voc_id = anchor_id),
    sub AS (SELECT DISTINCT a.query_id, a.anchor_id FROM pa a JOIN pa b ON a.query_id = b.query_id AND length(b.term) > length(a.term) AND contains(b.term, a.term)),
    co AS (SELECT pa.*, s.anchor_id IS NOT NULL AS inside, CASE WHEN s.anchor_id IS NOT NULL THEN 'subsumed' WHEN contains(term, ' ') THEN 'words_technical' WHEN regexp_matches(term, '^[a-z][a-z0-9+-]{1,15}$') THEN 'word_technical' ELSE 'word' END AS reason
        FROM pa LEFT JOIN sub s ON s.query_id = pa.query_id AND s.anchor_id = pa.anchor_id),
    cc AS (SELECT *, CASE reason WHEN 'subsumed' THEN 'generic_risky_candidate' WHEN 'word' THEN 'core_concept_candidate' ELSE 'tool_or_framework_candidate' END AS coarse FROM co)"""
_TA = _SIM + _ANCH + """, ta AS (SELECT query_id, voc_id AS anchor_id, job_freq, coverage, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY job_freq DESC, coverage, voc_id) AS place FROM anchors) WHERE place <= 20)"""


def coarse(spark: SparkSession, d: str) -> DataFrame:
    """query_id, anchor_id, term, job_freq, coarse (struct)."""
    rows = top_anchors(spark, d).join(X.vocabulary(spark, d).select(F.col("voc_id").alias("anchor_id"), "term"), "anchor_id")
    every = F.collect_set("term").over(Window.partitionBy("query_id"))
    return rows.withColumn("_all", every).withColumn("coarse", R.coarse_role(F.col("term"), F.col("_all"), F.array().cast("array<string>"))).drop("_all")


@query("str26_coarse_roles", _TA + _COARSE + " SELECT query_id, anchor_id, term, coarse, reason FROM cc", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return coarse(spark, d).select("query_id", "anchor_id", "term", F.col("coarse.outcome").alias("coarse"), F.col("coarse.reason").alias("reason"))


def layers(spark: SparkSession, d: str) -> DataFrame:
    """Anchors in their layers; those of a query's fewest jobs count as added by its vector."""
    return once(spark, "anchor layers", d, lambda: _layers(spark, d))


def _layers(spark: SparkSession, d: str) -> DataFrame:
    rows = coarse(spark, d).withColumn("coarse", F.col("coarse.outcome"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("job_freq"), "anchor_id"))
    rows = rows.withColumn("source", F.when(place > 16, A.SUPPLEMENT).otherwise("skill_direct")).withColumn("base", F.col("job_freq").cast("double"))
    return A.layered(rows.withColumn("specificity", F.lit(1.0) / F.size(F.split("term", " "))).withColumn("squeeze", F.lit(0.7)))


@query("rul01_anchor_layers", _TA + _COARSE + """, s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY job_freq DESC, anchor_id) > 16 AS added, 1.0 / len(string_split(term, ' ')) AS spec FROM cc),
    r AS (SELECT * REPLACE (CASE WHEN NOT added THEN coarse WHEN coarse = 'generic_risky_candidate' THEN coarse ELSE 'tool_or_framework_candidate' END AS coarse) FROM s),
    l AS (SELECT *, CASE WHEN NOT added AND coarse = 'generic_risky_candidate' AND ((spec < 0.33 AND inside) OR spec < 0.24) THEN 'context_only_anchor' WHEN added OR coarse <> 'core_concept_candidate' THEN 'aux_anchor_candidate' ELSE 'main_anchor_candidate' END AS role FROM r),
    m AS (SELECT *, coalesce(nullif(max(job_freq) FILTER (WHERE role = 'main_anchor_candidate') OVER (PARTITION BY query_id), 0), nullif(max(job_freq) FILTER (WHERE NOT added) OVER (PARTITION BY query_id), 0), 1) AS top FROM l),
    f AS (SELECT *, CASE role WHEN 'context_only_anchor' THEN 0.08 WHEN 'main_anchor_candidate' THEN 1.0 ELSE CASE WHEN coarse = 'generic_risky_candidate' THEN 0.42 ELSE 0.48 END END AS priority,
        CASE WHEN added THEN least(job_freq, 0.38 * top) WHEN role = 'context_only_anchor' THEN least(job_freq, 0.06 * top) WHEN role = 'aux_anchor_candidate' AND coarse = 'generic_risky_candidate' THEN least(job_freq * 0.7, 0.46 * top) ELSE job_freq END AS final_score FROM m)
    SELECT query_id, anchor_id, coarse, role, priority, final_score, row_number() OVER (PARTITION BY query_id ORDER BY CASE role WHEN 'main_anchor_candidate' THEN 0 WHEN 'aux_anchor_candidate' THEN 1 ELSE 2 END, final_score DESC, anchor_id) AS place FROM f""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return layers(spark, d).select("query_id", "anchor_id", "coarse", "role", "priority", "final_score", "place")


@query("rul01_contexts")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Where each anchor stands in its query's text."""
    return A.contexts(layers(spark, d), texts(spark, d)).select("query_id", "anchor_id", "snippet", "local_context", "phrase_context")


def conditioned_anchors(spark: SparkSession, d: str) -> DataFrame:
    """query_id, anchor_id, mode, q."""
    said = stored(texts(spark, d))
    rows = stored(A.contexts(layers(spark, d), said))
    vectors = A.conditioned(rows, A.companions(rows, said), term_vectors(spark, d), job_vectors(spark, d))
    return vectors.join(top_anchors(spark, d).select("query_id", "anchor_id", "mode"), ["query_id", "anchor_id"])


def active_domains(spark: SparkSession, d: str) -> DataFrame:
    """query_id, cand, in_domain, conflict: whether a term's heaviest domain is one of the six of a query's anchors; whether it is the query's least."""
    ratio = S.domain_ratio(histogram(spark, d)).select("voc_id", "domain_id", "ratio")
    mass = top_anchors(spark, d).join(ratio.withColumnRenamed("voc_id", "anchor_id"), "anchor_id").groupBy("query_id", "domain_id").agg(F.round(F.sum("ratio"), 9).alias("mass"))
    own = Window.partitionBy("query_id")
    ranked = mass.withColumn("up", F.row_number().over(own.orderBy(F.desc("mass"), "domain_id"))).withColumn("down", F.row_number().over(own.orderBy("mass", "domain_id")))
    heaviest = ratio.withColumn("_r", F.row_number().over(Window.partitionBy("voc_id").orderBy(F.desc("ratio"), "domain_id"))).where("_r = 1")
    return heaviest.join(ranked, "domain_id").select("query_id", F.col("voc_id").alias("cand"), (F.col("up") <= 6).alias("in_domain"), (F.col("down") == 1).alias("conflict"))


@query("vec11_conditioned_neighbours")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of each anchor's conditioned vector, with the gate that stopped them; main anchors whose pool stayed empty are searched again, wider."""
    near = relative_similar(spark, d).where("r <= 8").select(F.col("src").alias("anchor_id"), F.col("dst").alias("cand"))
    found = A.conditioned_neighbours(conditioned_anchors(spark, d), terms(spark, d).select("voc_id", "v", "entity_type"), near, active_domains(spark, d))
    return found.withColumn("sim", F.round("sim", 7))


_RUL02 = _TA + _HIST[len(_WV):] + """, dm AS (SELECT domain_id, sum(ratio) / (SELECT count(DISTINCT voc_id) FROM ratio) AS mean FROM ratio GROUP BY 1),
    raw AS (SELECT t.voc_id, dm.domain_id, coalesce(ratio, 0.0) - mean AS x FROM (SELECT DISTINCT voc_id FROM ratio) t CROSS JOIN dm LEFT JOIN ratio r ON r.voc_id = t.voc_id AND r.domain_id = dm.domain_id),
    tv AS (SELECT voc_id, domain_id, x / sqrt(sum(x * x) OVER (PARTITION BY voc_id)) AS x FROM raw),
    jm AS (SELECT query_id, domain_id, avg(x) AS x FROM ta JOIN tv ON voc_id = anchor_id GROUP BY 1, 2), jv AS (SELECT query_id, domain_id, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS x FROM jm),
    top AS (SELECT query_id, voc_id, score FROM (SELECT query_id, voc_id, round(s, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, voc_id) AS r FROM (SELECT query_id, voc_id, sum(jv.x * tv.x) AS s FROM jv JOIN tv USING (domain_id) GROUP BY 1, 2)) WHERE r <= 30),
    md AS (SELECT query_id, domain_id FROM (SELECT query_id, domain_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sum(ratio), 9) DESC, domain_id) AS r FROM ta JOIN ratio ON voc_id = anchor_id GROUP BY 1, 2) WHERE r <= 11),
    dr AS (SELECT query_id, voc_id, round(sum(ratio), 9) AS dr FROM md JOIN ratio USING (domain_id) GROUP BY 1, 2),
    cv AS (SELECT voc_id, count(DISTINCT job_id) / (SELECT count(DISTINCT job_id) FROM skill) / 20 AS coverage FROM skill GROUP BY 1),
    b AS (SELECT t.query_id, t.voc_id, score, coalesce(dr, 0.0) AS domain_ratio, CASE WHEN entity_type NOT IN ('concept', 'keyword') THEN 'etype_not_allowed' WHEN coalesce(dr, 0) < 0.6 THEN 'low_domain_ratio' WHEN coverage >= 0.03 THEN 'cov_j_melt' END AS block
        FROM top t JOIN vocabulary USING (voc_id) LEFT JOIN dr ON dr.query_id = t.query_id AND dr.voc_id = t.voc_id LEFT JOIN cv ON cv.voc_id = t.voc_id WHERE NOT EXISTS (SELECT 1 FROM ta WHERE ta.query_id = t.query_id AND ta.anchor_id = t.voc_id)),
    p AS (SELECT * REPLACE (coalesce(block, CASE WHEN row_number() OVER (PARTITION BY query_id, block IS NULL ORDER BY domain_ratio DESC, score DESC, voc_id) > 6 THEN 'enough' END) AS block) FROM b)
    SELECT query_id, voc_id, score, domain_ratio, block, CASE WHEN block IS NULL THEN 0.24 * score * (0.55 + 0.45 * domain_ratio) END AS base FROM p"""


@query("rul02_supplement", _RUL02, *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    """Terms near to the job's own vector that are no anchors; coverage is a twentieth, as few jobs share so few terms here."""
    ratio = S.domain_ratio(histogram(spark, d)).select("voc_id", "domain_id", "ratio")
    mass = top_anchors(spark, d).join(ratio.withColumnRenamed("voc_id", "anchor_id"), "anchor_id").groupBy("query_id", "domain_id").agg(F.round(F.sum("ratio"), 9).alias("mass"))
    active = mass.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("mass"), "domain_id"))).where("_r <= 11").select("query_id", "domain_id")
    inside = active.join(ratio, "domain_id").groupBy("query_id", "voc_id").agg(F.round(F.sum("ratio"), 9).alias("domain_ratio"))
    owned = skill_words(spark, d).where("job_id is not null")
    total = owned.agg(F.countDistinct("job_id").alias("total"))
    cover = S.counted(owned).crossJoin(F.broadcast(total)).select("voc_id", (F.col("n") / F.col("total") / 20).alias("coverage"))
    return A.supplemented(job_vectors(spark, d).select("query_id", F.col("job").alias("q")), terms(spark, d), top_anchors(spark, d), inside.join(cover, "voc_id", "left"), 30)
