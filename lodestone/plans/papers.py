"""Queries on works that a query's anchors hit: evidence, competition, and authors carried by one broad term. A work's topics are its domains; axes of jobs stand for types of works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import weights as W
from ..operators import label as L
from ..operators import landing as G
from ..operators import papers as P
from ..operators import statistics as S
from ..operators.storage import once, stored, written
from .label import _T
from .landing import _POOL, alignment, relative_similar, top_anchors
from .registry import query
from .stats import histogram, work_words

#: Types of works as axes of jobs (a stand-in: works here have no text to ground axes in).
AXES = {"1-URGENT": "planning_trajectory", "2-HIGH": "estimation", "3-MEDIUM": "control_core", "4-NOT SPECIFIED": "unclassified", "5-LOW": "generic_robot_autonomous_shell"}
#: Works that a selection keeps.
KEPT = 200


def hit_terms(spark: SparkSession, d: str) -> DataFrame:
    """query_id, voc_id and what a hit has from its term alone: ANCHORS rows a query at most."""
    top = top_anchors(spark, d)
    terms = top.select("query_id", F.col("anchor_id").alias("voc_id"), (F.col("job_freq") / 10.0).alias("score"))
    kept = L.specific(terms, work_words(spark, d), X.works(spark, d), 0.3)
    main = top.where(F.col("mode") == G.MAIN).select("query_id", F.col("anchor_id").alias("parent"))
    near = top.where(F.col("mode") != G.MAIN).select("query_id", "anchor_id").join(relative_similar(spark, d).select(F.col("src").alias("anchor_id"), F.col("dst").alias("parent"), "static"), "anchor_id").join(main, ["query_id", "parent"])
    best = near.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "anchor_id").orderBy(F.desc("static"), "parent"))).where("_r = 1")
    behind = best.select("query_id", F.col("anchor_id").alias("voc_id"), "parent", F.lit(False).alias("mainline")).unionByName(main.select("query_id", F.col("parent").alias("voc_id"), "parent", F.lit(True).alias("mainline")))
    names = X.vocabulary(spark, d).select("voc_id", "term", F.col("entity_type").alias("family"))
    rows = kept.join(behind, ["query_id", "voc_id"], "left").join(names, "voc_id").join(alignment(spark, d).select("query_id", F.col("cand").alias("voc_id"), "align"), ["query_id", "voc_id"], "left")
    return once(spark, "hit terms", d, lambda: rows.withColumn("parent", F.col("parent").cast("string")).coalesce(1))


def term_hits(spark: SparkSession, d: str) -> DataFrame:
    """query_id, work_id, voc_id, value and what operators/papers.py wants of a hit. Works meet the few terms as they lie, partitioned by work, and so need no further shuffle by query and work."""
    topics = S.spelled(work_words(spark, d).join(X.works(spark, d).select("work_id", "year"), "work_id"))
    rows = topics.join(F.broadcast(hit_terms(spark, d)), "voc_id").withColumn("value", F.col("score") * F.col("idf") * W.recency(F.col("year")))
    return rows.withColumn("grounding", F.round(F.col("idf") / F.sum("idf").over(Window.partitionBy("query_id", "work_id")), 6))


def evidenced(spark: SparkSession, d: str) -> DataFrame:
    """What the second selection wants of works and their evidence."""
    return written(_evidenced(spark, d).select(*P.KEYS, "n", "mainline", "side", "hit_class", "coherence", "preview", "evidence", "protected", "axes"))


def _evidenced(spark: SparkSession, d: str) -> DataFrame:
    hits = term_hits(spark, d)
    most = hits.groupBy(*P.KEYS).agg(F.sum("value").alias("s")).groupBy("query_id").agg(F.max("s").alias("most"))
    works = P.hit_quality(hits, F.sum("value").alias("s")).join(F.broadcast(most), "query_id")
    works = works.withColumn("score", F.round(F.col("s") / F.col("most"), 6)).drop("s", "most").withColumn("hierarchy", F.lit(None).cast("double"))
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in AXES.items() for x in pair]), F.col("type"))
    split = F.split("domain_ids", r"\|")
    axes = X.works(spark, d).select("work_id", F.when(F.size(split) > 1, F.array(kind, F.lit("simulation_sim2real"))).otherwise(F.array(kind)).alias("axes"))
    return P.evidence(works).join(axes, "work_id")


def topic_mixes(spark: SparkSession, d: str) -> DataFrame:
    """work_id, level, key, share: topics are domains, subfields four of them, fields nine."""
    each = X.works(spark, d).select("work_id", F.explode(F.array_distinct(F.split("domain_ids", r"\|"))).alias("d"), F.size(F.array_distinct(F.split("domain_ids", r"\|"))).alias("n"))
    return _levels(each.withColumn("x", 1.0 / F.col("n")), "work_id")


def _levels(rows: DataFrame, key: str) -> DataFrame:
    number = F.col("d").cast("int")
    three = F.array(*[F.struct(F.lit(lv).alias("level"), k.cast("string").alias("key")) for lv, k in (("topic", number), ("subfield", F.ceil(number / 4)), ("field", F.ceil(number / 9)))])
    each = rows.withColumn("k", F.explode(three)).groupBy(key, "k.level", "k.key").agg(F.sum("x").alias("share"))
    return each.select(key, "level", "key", F.round("share", 6).alias("share"))


def profile(spark: SparkSession, d: str) -> DataFrame:
    """query_id, level, key, share: the domains of a query's anchors."""
    ratio = S.domain_ratio(histogram(spark, d)).select(F.col("voc_id").alias("anchor_id"), F.col("domain_id").alias("d"), "ratio")
    mine = top_anchors(spark, d).join(ratio, "anchor_id").groupBy("query_id", "d").agg(F.sum("ratio").alias("s"))
    n = top_anchors(spark, d).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return _levels(mine.join(n, "query_id").withColumn("x", F.col("s") / F.col("n")), "query_id")


_WORKS = _POOL + """, n AS (SELECT count(*) AS n FROM works), idfs AS (SELECT voc_id, log10(n.n / (degree + 1)) AS idf FROM deg, n WHERE degree / n.n < 0.3),
    h0 AS (SELECT query_id, w.work_id, anchor_id AS voc_id, place <= 8 AS mainline, idf, job_freq / 10.0 * idf * CASE WHEN 2001 - year <= 3 THEN 1.0 WHEN 2001 - year <= 6 THEN 0.5 WHEN 2001 - year <= 10 THEN 0.2 ELSE 0.01 END AS value
        FROM ta JOIN idfs ON idfs.voc_id = anchor_id JOIN wv w ON w.voc_id = anchor_id JOIN works USING (work_id)),
    par AS (SELECT query_id, anchor_id, parent FROM (SELECT a.query_id, a.anchor_id, m.anchor_id AS parent, row_number() OVER (PARTITION BY a.query_id, a.anchor_id ORDER BY static DESC, m.anchor_id) AS r
        FROM ta a JOIN ta m ON a.query_id = m.query_id AND m.place <= 8 AND a.place > 8 JOIN rel ON src = a.anchor_id AND dst = m.anchor_id) WHERE r = 1 UNION ALL SELECT query_id, anchor_id, anchor_id FROM ta WHERE place <= 8),
    h AS (SELECT h0.*, round(idf / sum(idf) OVER (PARTITION BY h0.query_id, work_id), 6) AS grounding, parent, entity_type, align FROM h0 JOIN vocabulary USING (voc_id) LEFT JOIN par ON par.query_id = h0.query_id AND par.anchor_id = h0.voc_id LEFT JOIN al ON al.query_id = h0.query_id AND al.cand = h0.voc_id),
    w0 AS (SELECT query_id, work_id, count(*) AS n, count(*) FILTER (WHERE mainline) AS ml0, count(parent) AS named, count(DISTINCT parent) AS parents, max(grounding) AS grounding, avg(align) AS align, sum(value) AS s FROM h GROUP BY 1, 2),
    w1 AS (SELECT *, n >= 2 AND ml0 = 0 AND named = n AND parents = 1 AS aligned, round(s / max(s) OVER (PARTITION BY query_id), 6) AS score FROM w0),
    w2 AS (SELECT *, CASE WHEN aligned THEN 1 ELSE ml0 END AS mainline, n - CASE WHEN aligned THEN 1 ELSE ml0 END AS side FROM w1),
    q AS (SELECT *, CASE WHEN n = 1 AND mainline = 1 THEN 'single_hit_mainline' WHEN n = 1 THEN 'single_hit_side' WHEN mainline >= 2 THEN 'mainline_resonance' WHEN mainline = 1 THEN 'mainline_plus_support' ELSE 'side_only_or_accidental_multi_hit' END AS hq,
        CASE WHEN n = 1 THEN 0 WHEN mainline >= 1 THEN 2 ELSE 1 END AS strength FROM w2),
    e0 AS (SELECT *, hq = 'single_hit_side' AND mainline = 0 AND side >= 1 AS shrunk, hq IN ('single_hit_side', 'side_only_or_accidental_multi_hit') AS aside, CASE WHEN align IS NULL THEN 0.55 ELSE least(1, greatest(0, align)) END AS near FROM q),
    e1 AS (SELECT *, least(1, greatest(0, 0.42 * CASE hq WHEN 'mainline_resonance' THEN 0.90 WHEN 'mainline_plus_support' THEN 0.84 WHEN 'single_hit_mainline' THEN 0.72 WHEN 'single_hit_side' THEN 0.30 ELSE 0.40 END + 0.22 * least(1, greatest(0, grounding))
        + 0.18 * CASE WHEN shrunk THEN 0.35 * near + 0.325 ELSE near END + 0.04 + CASE WHEN mainline >= 1 THEN 0.06 ELSE 0 END + CASE WHEN n >= 2 THEN 0.04 ELSE 0 END - CASE WHEN side > 0 AND mainline = 0 THEN 0.10 ELSE 0 END
        + CASE WHEN n >= 2 AND mainline >= 2 THEN 0.03 WHEN n >= 2 AND mainline = 1 AND NOT aligned THEN 0.02 ELSE 0 END - CASE WHEN shrunk THEN 0.08 ELSE 0 END)) AS evidence FROM e0),
    e2 AS (SELECT *, CASE WHEN aside OR (mainline = 0 AND side > 0) OR evidence < 0.34 THEN 'fringe_candidate' WHEN evidence >= 0.58 AND mainline >= 1 THEN 'primary_candidate' ELSE 'support_candidate' END AS preview,
        score * least(1.12, greatest(0.80, 1 + CASE hq WHEN 'mainline_resonance' THEN 0.06 WHEN 'mainline_plus_support' THEN 0.05 WHEN 'single_hit_mainline' THEN 0.04 WHEN 'single_hit_side' THEN -0.045 ELSE -0.055 END + 0.014 * least(mainline, 3) - 0.009 * least(side, 3) + 0.018 * least(strength, 2)
            + least(0.028, greatest(-0.028, (grounding - 0.26) * 0.07)) + least(0.026, greatest(-0.026, (coalesce(align, 0.5) - 0.52) * 0.055)))) AS reranked,
        least(1.08, greatest(0.88, 1 + CASE hq WHEN 'mainline_resonance' THEN 0.05 WHEN 'mainline_plus_support' THEN 0.042 WHEN 'single_hit_mainline' THEN 0.034 WHEN 'single_hit_side' THEN -0.038 ELSE -0.048 END + 0.012 * least(mainline, 2) + CASE WHEN coalesce(align, 0.5) >= 0.58 AND mainline >= 1 THEN 0.015 ELSE 0 END
            - CASE WHEN aside AND mainline = 0 AND side >= 1 THEN 0.022 ELSE 0 END - CASE WHEN aside AND grounding < 0.22 THEN 0.018 ELSE 0 END)) AS protection FROM e1),
    ev AS (SELECT *, reranked * protection AS protected FROM e2)"""


@query("rul09_evidence", _WORKS + " SELECT query_id, work_id, hq AS hit_class, mainline, side, strength, round(evidence, 11) AS evidence, preview, round(protection, 11) AS protection, round(protected, 11) AS protected FROM ev", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return _evidenced(spark, d).select("query_id", "work_id", "hit_class", "mainline", "side", "strength", F.round("evidence", 11).alias("evidence"), "preview", F.round("protection", 11).alias("protection"), F.round("protected", 11).alias("protected"))


_COHESION = _WORKS + """, dk AS (SELECT DISTINCT work_id, CAST(unnest(string_split(domain_ids, '|')) AS INTEGER) AS d FROM works), dn AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY work_id) AS x FROM dk),
    lv AS (SELECT work_id, 'topic' AS level, CAST(d AS VARCHAR) AS key, x FROM dn UNION ALL SELECT work_id, 'subfield', CAST(CAST(ceil(d / 4) AS INTEGER) AS VARCHAR), x FROM dn UNION ALL SELECT work_id, 'field', CAST(CAST(ceil(d / 9) AS INTEGER) AS VARCHAR), x FROM dn),
    mx AS (SELECT work_id, level, key, round(sum(x), 6) AS share FROM lv GROUP BY 1, 2, 3),
    pd AS (SELECT query_id, CAST(domain_id AS INTEGER) AS d, sum(ratio) / any_value(k) AS x FROM ta JOIN ratio ON voc_id = anchor_id JOIN (SELECT query_id, count(*) AS k FROM ta GROUP BY 1) USING (query_id) GROUP BY 1, 2),
    pl AS (SELECT query_id, 'topic' AS level, CAST(d AS VARCHAR) AS key, x FROM pd UNION ALL SELECT query_id, 'subfield', CAST(CAST(ceil(d / 4) AS INTEGER) AS VARCHAR), x FROM pd UNION ALL SELECT query_id, 'field', CAST(CAST(ceil(d / 9) AS INTEGER) AS VARCHAR), x FROM pd),
    pr AS (SELECT query_id, level, key, round(sum(x), 6) AS share FROM pl GROUP BY 1, 2, 3),
    mn AS (SELECT work_id, level, key FROM (SELECT *, row_number() OVER (PARTITION BY work_id, level ORDER BY share DESC, key) AS r FROM mx) WHERE r = 1),
    ps AS (SELECT ev.*, s.key AS sk, t.key AS tk, count(*) OVER (PARTITION BY query_id) AS pool_n, count(*) OVER (PARTITION BY query_id, s.key, t.key) - 1 AS neighbours FROM ev JOIN mn s ON s.work_id = ev.work_id AND s.level = 'subfield' JOIN mn t ON t.work_id = ev.work_id AND t.level = 'topic'),
    fq AS (SELECT query_id, level, key, count(*) AS m, any_value(pool_n) AS pn FROM (SELECT query_id, 'subfield' AS level, sk AS key, pool_n FROM ps UNION ALL SELECT query_id, 'topic', tk, pool_n FROM ps) GROUP BY 1, 2, 3),
    ky AS (SELECT query_id, level, key FROM fq WHERE m >= greatest(4, ceil(0.12 * pn)) UNION SELECT query_id, level, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id, level ORDER BY share DESC, key) AS r FROM pr WHERE level <> 'field') WHERE r <= 4),
    cn AS (SELECT query_id, work_id, coalesce(sum(m.share * p.share) FILTER (WHERE level = 'field'), 0) AS fc, coalesce(sum(m.share * p.share) FILTER (WHERE level = 'subfield'), 0) AS sc, coalesce(sum(m.share * p.share) FILTER (WHERE level = 'topic'), 0) AS tc FROM ps JOIN mx m USING (work_id) JOIN pr p USING (query_id, level, key) GROUP BY 1, 2),
    co AS (SELECT ps.*, a.key IS NOT NULL OR b.key IS NOT NULL AS around, coalesce(tc >= 0.032 OR sc >= 0.042 OR (fc >= 0.14 AND greatest(sc, tc) >= 0.018), false) AS overlap, coalesce(greatest(fc, sc, tc) >= 0.038, false) AS agrees, coalesce(0.22 * fc + 0.38 * sc + 0.40 * tc >= 0.048, false) AS detailed
        FROM ps LEFT JOIN ky a ON a.query_id = ps.query_id AND a.level = 'subfield' AND a.key = sk LEFT JOIN ky b ON b.query_id = ps.query_id AND b.level = 'topic' AND b.key = tk LEFT JOIN cn ON cn.query_id = ps.query_id AND cn.work_id = ps.work_id),
    cs AS (SELECT *, (neighbours >= 2)::INT + overlap::INT + around::INT + agrees::INT + detailed::INT AS signals FROM co),
    ch AS (SELECT *, CASE WHEN signals >= 2 THEN 'topic_cohesive_candidate' WHEN signals = 1 OR neighbours = 1 THEN 'topic_weak_candidate' ELSE 'term_only_candidate' END AS cohesion FROM cs),
    ax AS (SELECT o_orderkey AS work_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'planning_trajectory' WHEN '2-HIGH' THEN 'estimation' WHEN '3-MEDIUM' THEN 'control_core' WHEN '4-NOT SPECIFIED' THEN 'unclassified' WHEN '5-LOW' THEN 'generic_robot_autonomous_shell' END AS axis, o_orderkey % 3 = 0 AS two FROM orders),
    k0 AS (SELECT ch.*, axis, two, hq = 'single_hit_side' AND mainline = 0 AS lone, preview = 'fringe_candidate' AS fringe FROM ch JOIN ax USING (work_id)),
    k1 AS (SELECT *, lone AND n = 1 AND fringe AS guard, NOT (lone AND n = 1 AND fringe) AND (mainline >= 1 OR n >= 2 OR NOT fringe) AS keep, lone AND neighbours = 0 AND cohesion = 'term_only_candidate' AS isolated, lone AND fringe AND side >= 1 AND n = 1 AND cohesion = 'topic_cohesive_candidate' AND overlap AS rest,
        CASE WHEN lone AND protected < 0.03 AND fringe THEN 0.93 * protected + 0.07 * evidence ELSE 0.85 * protected + 0.15 * evidence END AS mixed,
        least(1.015, greatest(0.988, CASE hq WHEN 'mainline_resonance' THEN 1.010 WHEN 'mainline_plus_support' THEN 1.010 WHEN 'single_hit_mainline' THEN 1.008 WHEN 'single_hit_side' THEN 0.986 ELSE 0.990 END
            * CASE WHEN hq = 'side_only_or_accidental_multi_hit' THEN CASE WHEN mainline = 0 AND side >= 2 THEN 0.988 ELSE 1 END * 0.996 ELSE 1 END * CASE WHEN two AND mainline >= 1 THEN 1.004 ELSE 1 END)) AS together FROM k0),
    k2 AS (SELECT *, mixed * CASE WHEN guard THEN 0.88 ELSE 1 END * CASE WHEN keep THEN 1.035 ELSE 1 END * CASE WHEN isolated THEN 0.90 ELSE 1 END * CASE WHEN NOT isolated AND NOT keep AND cohesion = 'topic_cohesive_candidate' THEN 1.065 ELSE 1 END * together
        * CASE WHEN rest THEN 0.970 ELSE 1 END AS compete FROM k1),
    k3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(protected, 9) DESC, work_id) AS r1, row_number() OVER (PARTITION BY query_id ORDER BY round(compete, 9) DESC, work_id) AS r2 FROM k2)"""


def competed(spark: SparkSession, d: str) -> DataFrame:
    """What selections and what follows them want of works that competed."""
    rows = lambda: P.compete(P.cohesion(evidenced(spark, d), topic_mixes(spark, d), profile(spark, d)))
    return once(spark, "works competed", d, lambda: rows().select(*P.KEYS, "protected", "mixed", "compete", "hit_class", "axes", "mainline"), keep=written)


@query("rul09_cohesion", _COHESION + " SELECT query_id, work_id, neighbours, around AS in_neighbourhood, overlap, signals, cohesion FROM ch", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    pool = once(spark, "works hit", d, lambda: _evidenced(spark, d).select(*P.KEYS))
    return P.cohesion(pool, topic_mixes(spark, d), profile(spark, d)).select("query_id", "work_id", "neighbours", "in_neighbourhood", "overlap", "signals", "cohesion")


@query("rul09_reselected", _COHESION + f""" SELECT query_id, work_id, round(mixed, 11) AS mixed, round(compete, 11) AS compete, r1 AS first_rank, r2 AS rank, CASE WHEN r1 <= {KEPT} AND r2 <= {KEPT} THEN 'kept' WHEN r2 <= {KEPT} THEN 'in' WHEN r1 <= {KEPT} THEN 'out' END AS moved FROM k3""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = P.reselected(competed(spark, d).select(*P.KEYS, "protected", "mixed", "compete"), KEPT)
    return rows.select("query_id", "work_id", F.round("mixed", 11).alias("mixed"), F.round("compete", 11).alias("compete"), "first_rank", "rank", "moved")


@query("rul10_broad_dominance")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Authors of the works that the second selection keeps: whether one broad term of the main line carries them, why, and the signals."""
    kept = stored(P.selected(competed(spark, d).select(*P.KEYS, "compete", "hit_class", "axes", "mainline"), KEPT))
    # KEPT works a query at most: the rest is read past them.
    by = X.authorships(spark, d).join(F.broadcast(kept), "work_id").select(*kept.columns, "author_id").distinct()
    hits = term_hits(spark, d).join(F.broadcast(kept.select(*P.KEYS)), P.KEYS, "left_semi")
    parts = hits.groupBy(*P.KEYS).agg(F.array_sort(F.collect_list(F.struct("term", "value"))).alias("contributions"))
    every = by.join(parts, P.KEYS)
    keys = ["query_id", "author_id"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("compete"), "work_id"))
    best = every.withColumn("_r", place).where("_r <= 10")
    terms = every.select(*keys, F.explode("contributions").alias("c")).groupBy(*keys, "c.term").agg(F.sum("c.value").alias("v"))
    share = terms.groupBy(*keys).agg(F.round(F.max("v") / F.sum("v"), 6).alias("dominant_share"), F.max_by("term", F.struct("v", "term")).alias("dominant_term"), F.count(F.lit(1)).alias("strong_terms"))
    ratio = every.groupBy(*keys).agg(F.round(F.avg((F.col("mainline") >= 1).cast("double")), 6).alias("mainline_ratio"))
    return P.broad_dominance(share.join(ratio, keys), best.select(*keys, "work_id", F.col("compete").alias("score"), "hit_class", "axes", "contributions")).select(*keys, "hit", "reason", F.array_sort(F.map_keys("signals")).alias("signals"))
