"""Queries on the rules of the graph path and of the last ranking. Measures between 0 and 1 come from columns of the tables, scaled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import weights as W
from ..operators import rules as R
from ..operators import statistics as S
from .registry import query
from .retrieval import _LISTS, pool
from .stats import _HIST, histogram

_T = ("works", "terms", "vocabulary")
_A = ("works", "authorships", "authors")
_TERM = _HIST + ", tt AS (SELECT voc_id, sum(n) AS works, count(*) AS span, max(ratio) AS purity, -sum(ratio * ln(ratio)) AS entropy, map_from_entries(list((domain_id, ratio))) AS dist FROM hist JOIN ratio USING (voc_id, domain_id) GROUP BY voc_id)"


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    """voc_id, works, span, dist: a term's number of works and domains, and its share of each domain."""
    hist = histogram(spark, d)
    ratio = S.domain_ratio(hist).groupBy("voc_id").agg(F.map_from_entries(F.collect_list(F.struct("domain_id", "ratio"))).alias("dist"))
    return hist.groupBy("voc_id").agg(F.sum("n").alias("works"), F.count(F.lit(1)).alias("span")).join(ratio, "voc_id")


_IN = "list_sum([coalesce(dist['3'], 0.0), coalesce(dist['5'], 0.0)])"



def _active() -> F.Column:
    return F.array(F.lit("3"), F.lit("5"))


def _inside() -> F.Column:
    return sum((F.coalesce(F.try_element_at("dist", F.lit(k)), F.lit(0.0)) for k in ("3", "5")), F.lit(0.0))


@query("mth06_term_penalties", _TERM + f""", x AS (SELECT *, {_IN} AS fit FROM tt) SELECT voc_id, CASE WHEN works <> 0 THEN 1 / ln(2.0 + works) ELSE 1.0 END / (1 + 0.25 * greatest(span - 1, 0)) AS generic,
    CASE WHEN fit < 0.15 THEN 0.4 ELSE 1.0 END * CASE WHEN fit < 0.05 THEN 0.6 ELSE 1.0 END * CASE WHEN 1 - fit > 0.80 THEN 0.35 ELSE 1.0 END * CASE WHEN 1 - fit > 0.90 THEN 0.5 ELSE 1.0 END AS external,
    pow(purity, 0.8) * purity AS purity, 1 / (1 + 0.8 * entropy) AS entropy FROM x""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    t = term_statistics(spark, d).withColumn("fit", _inside())
    fit, dist = F.col("fit"), F.col("dist")
    return t.select("voc_id", R.generic_penalty(F.col("works"), F.col("span")).alias("generic"), R.external_penalty(fit, fit, 1 - fit, 1 - fit).alias("external"), R.purity_bonus(dist, dist).alias("purity"), R.entropy_penalty(dist, dist).alias("entropy"))


@query("mth07_genericity", _TERM + """ SELECT voc_id, greatest(0.1, CASE WHEN span >= 6 AND works >= 200 THEN 0.4 WHEN span >= 4 AND works >= 100 THEN 0.6 ELSE 1.0 END
    * CASE WHEN contains(t, 'control') AND NOT (contains(t, 'robot') OR contains(t, 'arm')) THEN 0.5 ELSE 1.0 END) AS factor FROM (SELECT voc_id, term || CASE WHEN length(term) % 2 = 0 THEN ' Control' ELSE '' END AS u, lower(u) AS t FROM vocabulary) JOIN tt USING (voc_id)""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    term = F.concat("term", F.when(F.length("term") % 2 == 0, " Control").otherwise(""))
    return term_statistics(spark, d).join(X.vocabulary(spark, d), "voc_id").select("voc_id", R.genericity(term, F.col("span"), F.col("works")).alias("factor"))


@query("mth27_legacy_weight", _TERM + f""" SELECT voc_id, CASE WHEN sim < 0.4 THEN 0.0 ELSE pow(sim, 3) * idf * least(fit, 1.0) * size * (0.35 + 0.65 * pow(sim, 1.5) + 0.15 * pow(fit, 1.1)) * generic END AS weight,
    CASE WHEN works < 10 THEN 1.0 WHEN works < 50 THEN 1 + 0.5 * (works - 10.0) / 40 ELSE 0.9 END AS smoothed FROM (SELECT voc_id, works, purity + 0.3 AS sim, {_IN} AS fit, ln(1 + (SELECT count(*) FROM works) / (1.0 + works)) AS idf, 1 / (1.0 + span) AS size,
    1 / ln(2.0 + works) / (1 + 0.25 * (span - 1)) AS generic FROM tt)""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    n = X.works(spark, d).agg(F.count(F.lit(1)).alias("total"))
    t = term_statistics(spark, d).crossJoin(F.broadcast(n)).withColumn("fit", _inside()).withColumn("sim", R.purity(F.col("dist")) + 0.3).withColumn("idf", W.idf_ln(F.col("total"), F.col("works")))
    anchor = R.anchor_factor(F.col("sim"), F.col("fit"))
    generic = R.generic_penalty(F.col("works"), F.col("span"))
    weight = R.legacy_weight(F.col("sim"), F.col("idf"), F.col("fit"), 1 / (1.0 + F.col("span")), anchor, generic)
    return t.select("voc_id", weight.alias("weight"), R.smoothed_idf(F.col("works")).alias("smoothed"))


@query("mth30_uniqueness_confidence", _TERM + f""" SELECT voc_id, least({_IN} / list_sum(map_values(dist)), 1.0) AS uniqueness, CASE entity_type WHEN 'concept' THEN 0.95 WHEN 'keyword' THEN 0.6 ELSE 0.8 END AS confidence FROM tt JOIN vocabulary USING (voc_id)""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("entity_type") == "concept", " Primary").when(F.col("entity_type") == "keyword", "cooc_expansion").otherwise("other")
    return term_statistics(spark, d).join(X.vocabulary(spark, d), "voc_id").select("voc_id", R.uniqueness(F.col("dist"), _active()).alias("uniqueness"), R.confidence(role, F.lit("similar_to")).alias("confidence"))


@query("flt27_active_domains", _TERM + """ SELECT v.voc_id, dist IS NULL OR (len(list_intersect(map_keys(dist), ['3', '5', '7', '1'])) > 0 AND list_contains(['3', '5', '7', '1'], best)) AS passed FROM vocabulary v LEFT JOIN tt USING (voc_id)
    LEFT JOIN (SELECT voc_id, min(struct_pack(r := -ratio, d := domain_id)).d AS best FROM ratio GROUP BY voc_id) USING (voc_id)""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    active = F.array(*[F.lit(x) for x in "3571"])
    return X.vocabulary(spark, d).select("voc_id").join(term_statistics(spark, d), "voc_id", "left").select("voc_id", R.in_active_domains(F.col("dist"), active).alias("passed"))


@query("mth13_branch_scores", "SELECT l_orderkey, l_linenumber, least(1.0, (0.55 * l_quantity / 50 + 0.2 * coalesce(nullif(l_discount, 0), 0) + 0.15 * l_tax) / 0.9 + least(0.05, 0.012 * greatest(l_linenumber - 1, 0))) AS score FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    score = R.branch_score([(0.55, F.col("l_quantity") / 50), (0.20, F.when(F.col("l_discount") != 0, F.col("l_discount"))), (0.15, F.col("l_tax"))], F.col("l_linenumber"))
    return X.raw(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))


@query("mth14_clause_scores", "SELECT l_orderkey, n, least(0.40, 0.09 + 0.58 * best) AS only, least(0.048, 0.007 * least(n, 6) + 0.022 * best * (0.45 + 0.55 * n / 7.0)) AS bonus FROM (SELECT l_orderkey, count(*) AS n, max(l_quantity) / 50 AS best FROM lineitem GROUP BY 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    hits = X.raw(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), (F.max("l_quantity") / 50).alias("best"))
    n, best = F.col("n"), F.col("best")
    return hits.select("l_orderkey", "n", R.clause_only_score(best).alias("only"), R.clause_bonus(n, best, n / 7.0).alias("bonus"))


_M = "SELECT l_orderkey, l_linenumber, l_quantity / 50 AS s, l_discount * 10 AS a, l_tax * 10 AS i, l_extendedprice / 10000 AS c, l_suppkey, l_partkey, l_returnflag FROM lineitem"


def measured(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("s"), (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("i"), (F.col("l_extendedprice") / 10000).alias("c"), "l_suppkey", "l_partkey", "l_returnflag"
    )


@query("mth21_admission", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_linenumber = 1 THEN 'reject' WHEN s >= 0.68 AND a >= 0.65 AND c >= 0.55 AND i >= 0.18 AND i <= 0.70 AND a <= 0.72 THEN 'normal'
    WHEN s >= 0.55 AND a >= 0.52 AND (c >= 0.45 OR i >= 0.12) THEN 'weak_retain' ELSE 'reject' END AS mode FROM ({_M})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    sane = ~((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1))
    return measured(spark, d).select("l_orderkey", "l_linenumber", R.admission(sane, F.col("s"), F.col("a"), F.col("c"), F.col("i"), F.col("i"), F.col("a")).alias("mode"))


_U = "least(greatest({}, 0), 1)".format


@query("mth21_primary_score", f"""WITH m AS ({_M}), u AS (SELECT l_orderkey, l_linenumber, l_returnflag, {_U('s')} AS s, {_U('a')} AS a, {_U('i')} AS i, {_U('c')} AS c FROM m),
    k AS (SELECT *, CASE WHEN c <= 0 THEN s * 0.65 ELSE {_U('0.45 * s + 0.45 * c + 0.10 * (1 - abs(s - c))')} END AS cc FROM u)
    SELECT l_orderkey, l_linenumber, {_U('''((0.30 * i + 0.26 * cc + 0.24 * a + 0.10 * s + 0.06 * least(l_linenumber, 2) / 2.0 + 0.04 * c) + 0.04 * a + 0.05 * i + 0.05 * c + 0.03 * s)
    * 1.0 * CASE WHEN l_returnflag = 'R' THEN 0.92 ELSE 1.0 END * CASE WHEN l_returnflag = 'N' THEN 0.90 ELSE 1.0 END''')} AS score FROM k""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s, a, i, c = (F.col(x) for x in "saic")
    fits = {"field": a, "subfield": i, "topic": c, "path": s, "specificity": F.lit(None), "span": F.lit(None)}
    score = R.primary_score(s, c, i, a, F.col("l_linenumber"), c, fits, F.col("l_returnflag") == "R", F.col("l_returnflag") == "N")
    return measured(spark, d).select("l_orderkey", "l_linenumber", score.alias("score"))


_CAND = "SELECT l_suppkey % 10 AS query_id, l_partkey AS tid, l_suppkey AS anchor, l_linenumber AS rank, l_returnflag = 'R' AS mainline, l_linestatus = 'O' AS can_expand, l_quantity / 50 AS preference, l_discount AS identity, l_tax AS align, l_extendedprice AS continuity, CASE WHEN l_returnflag = 'A' THEN 'generic' WHEN l_linestatus = 'F' THEN 'near_synonym' ELSE 'exact_like' END AS family_type FROM lineitem"


@query("rul05_merged_primaries", f"""WITH c AS ({_CAND}), m AS (SELECT query_id, tid, array_to_string(list_sort(list(anchor)), ',') AS anchors, count(*) AS support_count, min(rank) AS best_rank, count(*) FILTER (WHERE mainline) AS mainline_hits, bool_or(can_expand) AS can_expand,
        max(preference) AS best_preference, max(continuity) AS best_continuity, max(CASE family_type WHEN 'generic' THEN 3 WHEN 'near_synonym' THEN 2 ELSE 1 END) AS w FROM c GROUP BY 1, 2)
    SELECT query_id, tid, anchors, mainline_hits, can_expand, best_preference, best_continuity, ['exact_like', 'near_synonym', 'generic'][w] AS family_type, least(0.10, 0.03 * (support_count - 1)) * CASE WHEN w >= 3 THEN 0.3 ELSE 1.0 END AS cross_anchor_bonus,
        row_number() OVER (PARTITION BY query_id ORDER BY mainline_hits DESC, support_count DESC, best_rank, can_expand DESC, tid) AS "order" FROM m""")
def _(spark: SparkSession, d: str) -> DataFrame:
    family = F.when(F.col("l_returnflag") == "A", "generic").when(F.col("l_linestatus") == "F", "near_synonym").otherwise("exact_like")
    rows = X.raw(spark, d, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("query_id"), F.col("l_partkey").alias("tid"), F.col("l_suppkey").alias("anchor"), F.col("l_linenumber").alias("rank"), (F.col("l_returnflag") == "R").alias("mainline"), (F.col("l_linestatus") == "O").alias("can_expand"),
        (F.col("l_quantity") / 50).alias("preference"), F.col("l_discount").alias("identity"), F.col("l_tax").alias("align"), F.col("l_extendedprice").alias("continuity"), family.alias("family_type"),
    )
    out = R.merged_primaries(rows).withColumn("anchors", F.array_join(F.transform("anchors", lambda x: x.cast("string")), ","))
    return out.select("query_id", "tid", "anchors", "mainline_hits", "can_expand", "best_preference", "best_continuity", "family_type", "cross_anchor_bonus", "order")


_WORK = "SELECT l_orderkey AS work_id, count(*) FILTER (WHERE l_returnflag = 'R') AS ml, count(*) FILTER (WHERE l_returnflag <> 'R') AS sd, avg(l_discount) * 10 AS g, avg(l_tax) * 12 AS a, max(l_quantity) / 50 AS top FROM lineitem GROUP BY 1"
_HQ = "CASE WHEN ml >= 2 THEN 'mainline_resonance' WHEN ml = 1 AND sd > 0 THEN 'mainline_plus_support' WHEN ml = 1 THEN 'single_hit_mainline' WHEN sd = 1 THEN 'single_hit_side' ELSE 'side_only_or_accidental_multi_hit' END"


def measured_works(spark: SparkSession, d: str) -> DataFrame:
    main = F.col("l_returnflag") == "R"
    rows = X.raw(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("work_id")).agg(F.count_if(main).alias("ml"), F.count_if(~main).alias("sd"), (F.avg("l_discount") * 10).alias("g"), (F.avg("l_tax") * 12).alias("a"), (F.max("l_quantity") / 50).alias("top"))
    ml, sd = F.col("ml"), F.col("sd")
    hq = F.when(ml >= 2, "mainline_resonance").when((ml == 1) & (sd > 0), "mainline_plus_support").when(ml == 1, "single_hit_mainline").when(sd == 1, "single_hit_side").otherwise("side_only_or_accidental_multi_hit")
    return rows.withColumn("hq", hq)


@query("mth19_paper_factor", f"""SELECT work_id, hq, least(greatest(1 + CASE hq WHEN 'mainline_resonance' THEN 0.06 WHEN 'mainline_plus_support' THEN 0.05 WHEN 'single_hit_mainline' THEN 0.04 WHEN 'single_hit_side' THEN -0.045 ELSE -0.055 END
    + 0.014 * least(ml, 3) - 0.009 * least(sd, 3) + 0.018 * least(ml, 2) + least(greatest((g - 0.26) * 0.07, -0.028), 0.028) + least(greatest((a - 0.52) * 0.055, -0.026), 0.026) + least(greatest((top - 1.0) * 0.12, -0.022), 0.022), 0.80), 1.12) AS factor
    FROM (SELECT *, {_HQ} AS hq FROM ({_WORK}))""")
def _(spark: SparkSession, d: str) -> DataFrame:
    factor = R.paper_factor(F.col("hq"), F.col("ml"), F.col("sd"), F.col("ml"), F.col("g"), F.col("a"), F.col("top"))
    return measured_works(spark, d).select("work_id", "hq", factor.alias("factor"))


_AUTHOR = f"""w AS (SELECT *, {_HQ} AS hq FROM ({_WORK})), own AS (SELECT DISTINCT l_suppkey AS author_id, l_orderkey AS work_id FROM lineitem),
    s AS (SELECT author_id, count(*) AS papers, avg((ml > 0)::INT) AS mhr, avg((ml = 0)::INT) AS ssr, max(top) / sum(top) AS dom, count(*) FILTER (WHERE ml >= 2) AS hqm, count(*) FILTER (WHERE ml = 0 AND sd > 1) AS som, max(top) AS top, max(hq) AS hq, count(*) FILTER (WHERE ml > 0 AND g > 0.5) AS pri FROM own JOIN w USING (work_id) GROUP BY 1),
    c AS (SELECT *, CASE WHEN papers = 1 THEN 'single_paper_supported' WHEN mhr = 0 THEN 'side_only_supported' WHEN mhr < 0.5 THEN 'mixed_but_side_heavy' ELSE 'mainline_supported' END AS cls FROM s)"""


def measured_authors(spark: SparkSession, d: str) -> DataFrame:
    own = X.raw(spark, d, "lineitem").select(F.col("l_suppkey").alias("author_id"), F.col("l_orderkey").alias("work_id")).distinct()
    ml, sd = F.col("ml"), F.col("sd")
    rows = own.join(measured_works(spark, d), "work_id").groupBy("author_id").agg(
        F.count(F.lit(1)).alias("papers"), F.avg((ml > 0).cast("int")).alias("mhr"), F.avg((ml == 0).cast("int")).alias("ssr"), (F.max("top") / F.sum("top")).alias("dom"), F.count_if(ml >= 2).alias("hqm"),
        F.count_if((ml == 0) & (sd > 1)).alias("som"), F.max("top").alias("top"), F.max("hq").alias("hq"), F.count_if((ml > 0) & (F.col("g") > 0.5)).alias("pri"),
    )
    m = F.col("mhr")
    return rows.withColumn("cls", F.when(F.col("papers") == 1, "single_paper_supported").when(m == 0, "side_only_supported").when(m < 0.5, "mixed_but_side_heavy").otherwise("mainline_supported"))


@query("mth19_author_factor", f"""WITH {_AUTHOR} SELECT author_id, cls, least(greatest(1 + 0.11 * mhr - 0.09 * ssr + CASE cls WHEN 'mainline_supported' THEN 0.038 WHEN 'mixed_but_side_heavy' THEN -0.028 WHEN 'side_only_supported' THEN -0.048 ELSE -0.055 END - CASE WHEN som > 3 THEN 0.038 ELSE 0 END
    - CASE WHEN cls <> 'mainline_supported' AND dom >= 0.72 THEN 0.055 * least(greatest((dom - 0.52) / 0.48, 0), 1) ELSE 0 END + 0.022 * least(hqm, 2) - 0.016 * least(som, 2), 0.78), 1.10) AS factor FROM c""")
def _(spark: SparkSession, d: str) -> DataFrame:
    factor = R.author_factor(F.col("mhr"), F.col("ssr"), F.col("cls"), F.col("som") > 3, F.col("dom"), F.col("hqm"), F.col("som"))
    return measured_authors(spark, d).select("author_id", "cls", factor.alias("factor"))


@query("rul10_suppression_audit", f"""WITH {_AUTHOR}, g AS (SELECT l_orderkey AS author_id, count(DISTINCT l_suppkey) AS papers, avg((l_returnflag = 'R')::INT) AS mhr, max(l_quantity) / sum(l_quantity) AS dom, count(*) FILTER (WHERE l_discount > 0.09) AS pri, CASE WHEN max(l_linenumber) = 1 THEN 'single_hit_side' ELSE 'other' END AS hq FROM lineitem GROUP BY 1)
    SELECT author_id, CASE WHEN papers <> 1 THEN 'paper_count!=1' WHEN hq <> 'single_hit_side' THEN 'top_paper_hit_quality_class' WHEN mhr > 0.05 THEN 'mainline_support_ratio' WHEN dom < 0.9 THEN 'dominant_term_share' WHEN pri > 0 THEN 'author_primary_evidence_count' END AS failed FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    g = X.raw(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("author_id")).agg(
        F.countDistinct("l_suppkey").alias("papers"), F.avg((F.col("l_returnflag") == "R").cast("int")).alias("mhr"), (F.max("l_quantity") / F.sum("l_quantity")).alias("dom"), F.count_if(F.col("l_discount") > 0.09).alias("pri"),
        F.when(F.max("l_linenumber") == 1, "single_hit_side").otherwise("other").alias("hq"),
    )
    return g.select("author_id", R.suppression_audit(F.col("papers"), F.col("hq"), F.col("mhr"), F.col("dom"), F.col("pri"), F.lit(None).cast("string")).alias("failed"))


@query("mth18_unified_ranking", f"""WITH {_AUTHOR}, q AS (SELECT *, author_id % 5 AS query_id, papers % 2 = 0 AS sup, som > 3 AS broad FROM c), r AS (SELECT *, CASE WHEN max(top) OVER w > min(top) OVER w + 1e-18 THEN (top - min(top) OVER w) / (max(top) OVER w - min(top) OVER w) ELSE 0.5 END AS re FROM q WINDOW w AS (PARTITION BY query_id)),
    u AS (SELECT query_id, author_id, 0.46 * dom + 0.20 * re + 0.10 * mhr + 0.07 * least(1.0, ln(1 + papers) / ln(7)) + 0.06 * least(1.0, hqm / 5.0) + 0.05 * least(1.0, hqm / 2.0) + 0.04 * least(1.0, dom * 3.0) + 0.02 * least(greatest((top - 0.42) / 0.70, 0), 1) - 0.08 * sup::INT - 0.06 * broad::INT AS raw FROM r)
    SELECT query_id, author_id, raw, CASE WHEN max(raw) OVER w > min(raw) OVER w + 1e-18 THEN (raw - min(raw) OVER w) / (max(raw) OVER w - min(raw) OVER w) ELSE raw END AS unified FROM u WINDOW w AS (PARTITION BY query_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = measured_authors(spark, d).select(
        (F.col("author_id") % 5).alias("query_id"), "author_id", F.col("dom").alias("score"), F.col("top").alias("rerank"), F.col("mhr").alias("mainline_ratio"), "papers", F.col("hqm").alias("axes"), F.col("hqm").alias("multi_hits"),
        F.col("dom").alias("primary_score"), F.col("top").alias("structure"), (F.col("papers") % 2 == 0).alias("suppressed"), (F.col("som") > 3).alias("broad"),
    )
    return R.unified_ranking(a).select("query_id", "author_id", "raw", "unified")


@query("win04_newest_works", " SELECT author_id, work_id FROM (SELECT author_id, work_id, row_number() OVER (PARTITION BY author_id ORDER BY year DESC, work_id) AS r FROM (SELECT DISTINCT author_id, work_id, year FROM authorships JOIN works USING (work_id))) WHERE r <= 5", *_A)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.authorships(spark, d).join(X.works(spark, d), "work_id").select("author_id", "work_id", "year").distinct()
    return R.newest(rows, "author_id", 5).select("author_id", "work_id")


@query("win09_family_decay", "SELECT p_partkey, p_retailprice * pow(0.85, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_retailprice DESC, p_partkey) - 1) AS score FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.raw(spark, d, "part").select("p_partkey", "p_brand", "p_type", F.col("p_retailprice").alias("score"))
    return R.family_decayed(rows, "score", "p_type", "p_partkey", "p_brand").select("p_partkey", "score")


@query("top03_best_hundred", "SELECT l_orderkey, l_linenumber, l_extendedprice AS score FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("score")).orderBy(F.desc("score"), "l_orderkey", "l_linenumber").limit(100)


@query("prj05_candidate_records", _LISTS + " SELECT query_id, author_id, from_vector::INT AS from_vector, path_count, bucket AS bucket_type, coalesce(vector_rank, 999) AS vector_rank, coalesce(label_rank, 999) AS label_rank, coalesce(collab_rank, 999) AS collab_rank, pool_score AS candidate_pool_score FROM buck", *_A)
def _(spark: SparkSession, d: str) -> DataFrame:
    return R.candidate_record(pool(spark, d)).select("query_id", "author_id", *[f"recall_features.{c}" for c in ("from_vector", "path_count", "bucket_type", "vector_rank", "label_rank", "collab_rank", "candidate_pool_score")])


@query("prj08_encoded", _LISTS + " SELECT query_id, author_id, CASE bucket WHEN 'A' THEN 0.25 WHEN 'B' THEN 0.35 WHEN 'C' THEN 0.5 WHEN 'D' THEN 0.6 WHEN 'E' THEN 0.75 WHEN 'F' THEN 0.9 END AS bucket, coalesce(1 - least(vector_rank / 500.0, 1), 0) AS vector_rank FROM buck", *_A)
def _(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).select("query_id", "author_id", R.bucket_code(F.col("bucket")).alias("bucket"), R.rank_code(F.col("vector_rank")).alias("vector_rank"))


@query("flt09_qualified", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


@query("join34_lookups", " SELECT work_id, v.voc_id, v.entity_type FROM terms t JOIN vocabulary v ON v.term = t.term AND v.entity_type = t.entity_type", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.terms(spark, d).join(X.vocabulary(spark, d), ["term", "entity_type"]).select("work_id", "voc_id", "entity_type")


@query("str21_selected_clauses")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents as clauses; the first line is the whole query."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return X.raw(spark, d, "documents").select("doc_id", F.array_join(R.selected_clauses(lines, F.array(lines[0])), "\n").alias("clauses"))


@query("rul08_stage3", f"""WITH m AS ({_M}), r AS (SELECT l_orderkey, l_linenumber, l_returnflag, s, a, c, i, CASE WHEN l_linenumber = 7 THEN '' ELSE 't' END AS term, l_linenumber % 3 AS ev, l_suppkey % 3 AS an FROM m)
    SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' AND a > 0.3 THEN 'trusted_primary' WHEN l_returnflag = 'R' THEN 'secondary_primary' ELSE 'support_expansion' END AS entry,
    array_to_string(list_filter([CASE WHEN s > 0.75 THEN 'high_polysemy' END, CASE WHEN a > 0.55 THEN 'object_like' END, CASE WHEN i > 0.55 THEN 'too_generic' END], lambda x: x IS NOT NULL), ',') AS flags,
    CASE WHEN term = '' OR ev <= 0 THEN 'missing_required_stage3_fields' WHEN an <= 1 AND ev <= 1 AND 0.55 * a + 0.35 * i < 0.15 AND l_returnflag <> 'R' THEN 'weak_evidence_noise' END AS rejected FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    m, main = measured(spark, d), F.col("l_returnflag") == "R"
    role, place = F.when(main, " Primary").otherwise("dense_expansion"), F.lit("mainline")
    term = F.when(F.col("l_linenumber") == 7, "").otherwise("t")
    rejected = R.guardrail(F.col("l_partkey"), term, F.col("l_linenumber") % 3, F.col("l_suppkey") % 3, F.lit(None).cast("double"), F.col("a"), F.col("i"), main, F.lit("dense"))
    flags = R.term_flags(F.col("s"), F.col("a"), F.col("i"))
    return m.select("l_orderkey", "l_linenumber", R.entry_group(role, place, F.col("a") > 0.3).alias("entry"), F.array_join(flags, ",").alias("flags"), rejected.alias("rejected"))
