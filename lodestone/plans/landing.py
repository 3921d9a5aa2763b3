"""Queries on candidate pools, landings and seeds. A pool's features come from the graph path: similar terms, their contexts, domains and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..operators import landing as G
from ..operators import rules as R
from ..operators import seeds as E
from ..operators import statistics as S
from ..operators.storage import once
from .label import _ANCH, _SIM, _T, anchors, similar
from .registry import query
from .rules import term_statistics
from .stats import _HIST, _WV, cooccurrence

#: Anchors of a query that go on, of which the first ones are strong; candidates of an anchor by similarity, by context and by family.
ANCHORS, STRONG, NEAR, CONDITIONED, FAMILY = 20, 8, 8, 8, 6


def _round(x: F.Column) -> F.Column:
    """What thresholds are held against, so that the order of a sum doesn't decide."""
    return F.round(x, 6)


def _scaled(x: F.Column, own) -> F.Column:
    """0 for the least of a group, 1 for the largest; 1 if they are the same."""
    low, high = F.min(x).over(own), F.max(x).over(own)
    return _round(F.when(high > low, (x - low) / (high - low)).otherwise(1.0))


def top_anchors(spark: SparkSession, d: str) -> DataFrame:
    """query_id, anchor_id, job_freq, mode, strength."""
    own = Window.partitionBy("query_id")
    place = F.row_number().over(own.orderBy(F.desc("job_freq"), "coverage", "voc_id"))
    rows = anchors(spark, d).withColumn("place", place).where(F.col("place") <= ANCHORS)
    mode = F.when(F.col("place") <= STRONG, G.MAIN).otherwise("aux_weak_process")
    return rows.select("query_id", F.col("voc_id").alias("anchor_id"), "job_freq", mode.alias("mode"), _round(F.col("job_freq") / F.max("job_freq").over(own)).alias("strength"))


def relative_similar(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, static (1 for a term's most similar one, 0 for its least), r."""
    own = Window.partitionBy("src")
    return similar(spark, d).select("src", "dst", _scaled(F.col("score"), own).alias("static"), F.row_number().over(own.orderBy(F.desc("score"), "dst")).alias("r"), "score")


def alignment(spark: SparkSession, d: str) -> DataFrame:
    """query_id, cand, align: mean similarity to a query's anchors by their jobs, 1 for the best term, 0 for the last; its root, so that the thresholds lie inside."""
    linked = top_anchors(spark, d).join(similar(spark, d), F.col("anchor_id") == F.col("src"))
    sums = linked.groupBy("query_id", F.col("dst").alias("cand")).agg(F.sum(F.col("job_freq") * F.col("score")).alias("s"))
    return sums.select("query_id", "cand", _round(F.sqrt(_scaled(F.col("s"), Window.partitionBy("query_id")))).alias("align"))


def words(spark: SparkSession, d: str) -> DataFrame:
    """voc_id, term, entity_type, words: a term's words and its type."""
    return X.vocabulary(spark, d).select("voc_id", "term", "entity_type", F.array_distinct(F.concat(F.split("term", " "), F.array("entity_type"))).alias("words"))


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """query_id, anchor_id, cand, sources, cond: three retrievals of each anchor, merged by candidate."""
    top, rel, w = top_anchors(spark, d).select("query_id", "anchor_id"), relative_similar(spark, d), words(spark, d)
    mine = top.join(rel, F.col("anchor_id") == F.col("src"))
    near = mine.where(F.col("r") <= NEAR).select("query_id", "anchor_id", F.col("dst").alias("cand"), F.lit("similar_to").alias("source"), F.lit(None).cast("double").alias("cond"))
    mixed = mine.select("query_id", "anchor_id", F.col("dst").alias("cand"), "static").join(alignment(spark, d), ["query_id", "cand"])
    mixed = mixed.withColumn("cond", _round(0.6 * F.col("static") + 0.4 * F.col("align")))
    place = F.row_number().over(Window.partitionBy("query_id", "anchor_id").orderBy(F.desc("cond"), "cand"))
    conditioned = mixed.withColumn("_r", place).where(F.col("_r") <= CONDITIONED).select("query_id", "anchor_id", "cand", F.lit("conditioned_vec").alias("source"), "cond")
    a = w.select(F.col("voc_id").alias("anchor_id"), F.explode("words").alias("word"), F.size("words").alias("na"))
    c = w.select(F.col("voc_id").alias("cand"), F.explode("words").alias("word"), F.size("words").alias("nc"))
    shared = top.join(a, "anchor_id").join(c, "word").where("anchor_id <> cand").groupBy("query_id", "anchor_id", "cand", "na", "nc").agg(F.count(F.lit(1)).alias("n"))
    alike = shared.select("query_id", "anchor_id", "cand", _round(F.col("n") / (F.col("na") + F.col("nc") - F.col("n"))).alias("j")).where("j >= 0.3")
    place = F.row_number().over(Window.partitionBy("query_id", "anchor_id").orderBy(F.desc("j"), "cand"))
    family = alike.withColumn("_r", place).where(F.col("_r") <= FAMILY).select("query_id", "anchor_id", "cand", F.lit("family_landing").alias("source"), F.lit(None).cast("double").alias("cond"))
    every = near.unionByName(conditioned).unionByName(family)
    return every.groupBy("query_id", "anchor_id", "cand").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max("cond").alias("cond"))


def pool(spark: SparkSession, d: str) -> DataFrame:
    """A pool as operators/landing.py describes it."""
    return once(spark, "candidate pool", d, lambda: _pool(spark, d), ANCHORS, STRONG, NEAR, CONDITIONED, FAMILY)


def _pool(spark: SparkSession, d: str) -> DataFrame:
    rel, stats, w = relative_similar(spark, d), term_statistics(spark, d), words(spark, d)
    near = rel.where(F.col("r") <= NEAR).groupBy("src").agg(F.collect_set("dst").alias("near"))
    types = rel.where(F.col("r") <= NEAR).join(w.select(F.col("voc_id").alias("dst"), F.col("entity_type").alias("other")), "dst").join(w.select(F.col("voc_id").alias("src"), "entity_type"), "src")
    mixed = types.groupBy("src").agg(_round(F.avg((F.col("other") != F.col("entity_type")).cast("double"))).alias("mixed"))
    of = w.join(stats, "voc_id", "left").join(near, F.col("voc_id") == F.col("src"), "left").drop("src").join(mixed, F.col("voc_id") == F.col("src"), "left").drop("src")
    most = stats.agg(F.max("works").alias("most"))
    of = of.crossJoin(F.broadcast(most)).withColumn("share", F.coalesce(F.col("works"), F.lit(0)) / F.col("most")).drop("most")
    side = lambda key, p: of.select(F.col("voc_id").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("term", "entity_type", "words", "dist", "near", "share", "mixed")])
    rows = candidates(spark, d).join(rel.select(F.col("src").alias("anchor_id"), F.col("dst").alias("cand"), "static"), ["anchor_id", "cand"], "left").join(alignment(spark, d), ["query_id", "cand"], "left")
    rows = rows.join(side("anchor_id", "a"), "anchor_id").join(side("cand", "c"), "cand")
    common = F.size(F.array_intersect("a_words", "c_words"))
    both = F.map_zip_with("a_dist", "c_dist", lambda k, x, y: F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
    rows = rows.withColumn("lexical", _round(common / (F.size("a_words") + F.size("c_words") - common)))
    rows = rows.withColumn("context", _round(F.coalesce(F.least(F.lit(1.0), F.size(F.array_intersect("a_near", "c_near")) / 5.0), F.lit(0.0))))
    rows = rows.withColumn("hier", _round(F.coalesce(F.aggregate(F.map_values(both), F.lit(0.0), lambda s, x: s + x), F.lit(0.0))))
    rows = rows.withColumn("static", F.coalesce("static", F.lit(0.0))).withColumn("align", F.coalesce("align", F.lit(0.0)))
    rows = rows.withColumn("identity", _round(0.4 * F.col("lexical") + 0.35 * F.col("static") + 0.25 * F.col("context"))).withColumn("family", _round(0.4 * F.col("lexical") + 0.4 * F.col("context") + 0.2 * F.col("hier")))
    other = F.col("a_entity_type") != F.col("c_entity_type")
    rows = rows.withColumn("generic", _round(0.6 * F.col("c_share") * F.col("c_share"))).withColumn("polysemy", _round(0.45 * F.coalesce(F.col("c_mixed"), F.lit(0.0)))).withColumn("object", F.when(F.col("c_entity_type") == "keyword", 0.30).otherwise(0.10))
    rows = rows.withColumn("support", F.count(F.lit(1)).over(Window.partitionBy("query_id", "cand")).cast("int"))
    rows = rows.withColumn("family_type", F.when(F.col("lexical") >= 0.6, "near_synonym").when(F.col("c_share") >= 0.9, "generic").when(other, "shifted"))
    rows = rows.withColumn("gap", _round(F.coalesce(F.greatest(F.lit(0.0), F.col("static") - F.col("cond")), F.lit(0.0))))
    retain = R.admission(G.term_sane(F.col("c_term")), F.col("static"), F.col("align"), F.col("context"), F.col("identity"), F.col("object"), F.col("polysemy"))
    rows = rows.select(
        "query_id", "anchor_id", "cand", F.col("c_term").alias("term"), "sources", "static", "cond", "align", "identity", "family", "context", "hier", (F.col("context") >= 0.2).alias("supported"), "generic", "polysemy", "object",
        "support", "family_type", (other & (F.col("context") < 0.2)).alias("shifted"), (F.col("generic") >= 0.5).alias("generic_like"), "gap", retain.alias("retain"),
    )
    ranked = G.relative_scores(rows, ["static", "context", "align", "support", "family", "hier"], ["polysemy", "generic"])
    return ranked.select(*rows.columns, _round(F.col("composite")).alias("score"))


_SCALED = "round(CASE WHEN max({0}) OVER (PARTITION BY {1}) > min({0}) OVER (PARTITION BY {1}) THEN ({0} - min({0}) OVER (PARTITION BY {1})) / (max({0}) OVER (PARTITION BY {1}) - min({0}) OVER (PARTITION BY {1})) ELSE 1.0 END, 6)".format
_POOL = _SIM + _ANCH + _HIST[len(_WV):] + f""", tt AS (SELECT voc_id, sum(n) AS works, count(*) AS span FROM hist GROUP BY voc_id),
    ta AS (SELECT query_id, voc_id AS anchor_id, job_freq, place, round(job_freq / max(job_freq) OVER (PARTITION BY query_id), 6) AS strength FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY job_freq DESC, coverage, voc_id) AS place FROM anchors) WHERE place <= {ANCHORS}),
    rel AS (SELECT src, dst, {_SCALED('score', 'src')} AS static, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS r FROM sim),
    al AS (SELECT query_id, cand, round(sqrt({_SCALED('s', 'query_id')}), 6) AS align FROM (SELECT query_id, dst AS cand, sum(job_freq * score) AS s FROM ta JOIN sim ON src = anchor_id GROUP BY 1, 2)),
    wd AS (SELECT voc_id, term, entity_type, list_distinct(list_append(string_split(term, ' '), entity_type)) AS words FROM vocabulary),
    mine AS (SELECT query_id, anchor_id, dst AS cand, static, r FROM ta JOIN rel ON src = anchor_id),
    cnd AS (SELECT query_id, anchor_id, cand, cond FROM (SELECT *, row_number() OVER (PARTITION BY query_id, anchor_id ORDER BY cond DESC, cand) AS k FROM (SELECT query_id, anchor_id, cand, round(0.6 * static + 0.4 * align, 6) AS cond FROM mine JOIN al USING (query_id, cand))) WHERE k <= {CONDITIONED}),
    fam AS (SELECT query_id, anchor_id, cand FROM (SELECT *, row_number() OVER (PARTITION BY query_id, anchor_id ORDER BY j DESC, cand) AS k FROM (
        SELECT query_id, anchor_id, b.voc_id AS cand, round(len(list_intersect(a.words, b.words)) / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))), 6) AS j FROM ta JOIN wd a ON a.voc_id = anchor_id JOIN wd b ON b.voc_id <> anchor_id) WHERE j >= 0.3) WHERE k <= {FAMILY}),
    src AS (SELECT query_id, anchor_id, cand, list_sort(list(DISTINCT source)) AS sources, max(cond) AS cond FROM (SELECT query_id, anchor_id, cand, 'similar_to' AS source, NULL AS cond FROM mine WHERE r <= {NEAR}
        UNION ALL SELECT query_id, anchor_id, cand, 'conditioned_vec', cond FROM cnd UNION ALL SELECT query_id, anchor_id, cand, 'family_landing', NULL FROM fam) GROUP BY 1, 2, 3),
    nr AS (SELECT src AS voc_id, list(dst) AS near, round(avg(CAST(o.entity_type <> m.entity_type AS DOUBLE)), 6) AS mixed FROM rel JOIN wd o ON o.voc_id = dst JOIN wd m ON m.voc_id = src WHERE r <= {NEAR} GROUP BY src),
    term_of AS (SELECT wd.*, coalesce(works, 0) / (SELECT max(works) FROM tt) AS share, near, coalesce(mixed, 0.0) AS mixed FROM wd LEFT JOIN tt USING (voc_id) LEFT JOIN nr USING (voc_id)),
    hr AS (SELECT x.voc_id AS a, y.voc_id AS b, sum(least(x.ratio, y.ratio)) AS h FROM ratio x JOIN ratio y USING (domain_id) GROUP BY 1, 2),
    p0 AS (SELECT s.query_id, s.anchor_id, s.cand, c.term, s.sources, coalesce(rel.static, 0.0) AS static, s.cond, coalesce(align, 0.0) AS align, round(len(list_intersect(a.words, c.words)) / (len(a.words) + len(c.words) - len(list_intersect(a.words, c.words))), 6) AS lexical,
        round(coalesce(least(1.0, len(list_intersect(a.near, c.near)) / 5.0), 0.0), 6) AS context, round(coalesce(h, 0.0), 6) AS hier, round(0.6 * c.share * c.share, 6) AS generic, round(0.45 * c.mixed, 6) AS polysemy, CASE WHEN c.entity_type = 'keyword' THEN 0.30 ELSE 0.10 END AS object,
        count(*) OVER (PARTITION BY s.query_id, s.cand) AS support, c.share, a.entity_type <> c.entity_type AS other
        FROM src s JOIN term_of a ON a.voc_id = s.anchor_id JOIN term_of c ON c.voc_id = s.cand LEFT JOIN rel ON rel.src = s.anchor_id AND rel.dst = s.cand LEFT JOIN al ON al.query_id = s.query_id AND al.cand = s.cand LEFT JOIN hr ON hr.a = s.anchor_id AND hr.b = s.cand),
    p1 AS (SELECT *, round(0.4 * lexical + 0.35 * static + 0.25 * context, 6) AS identity, round(0.4 * lexical + 0.4 * context + 0.2 * hier, 6) AS family, context >= 0.2 AS supported FROM p0),
    pool AS (SELECT *, CASE WHEN static >= 0.68 AND align >= 0.65 AND context >= 0.55 AND identity >= 0.18 AND object <= 0.70 AND polysemy <= 0.72 THEN 'normal' WHEN static >= 0.55 AND align >= 0.52 AND (context >= 0.45 OR identity >= 0.12) THEN 'weak_retain' ELSE 'reject' END AS retain FROM p1)"""
_RANK = "(1 - (row_number() OVER (PARTITION BY query_id, anchor_id ORDER BY {} NULLS LAST, cand) - 1) / (count(*) OVER (PARTITION BY query_id, anchor_id) - 1))".format
_SCORED = _POOL + f""", scored AS (SELECT *, round(CASE WHEN count(*) OVER (PARTITION BY query_id, anchor_id) > 1 THEN ({' + '.join(_RANK(c + ' DESC') for c in ('static', 'context', 'align', 'support', 'family', 'hier'))} + {_RANK('polysemy')} + {_RANK('generic')}) / 8 ELSE 1.0 END, 6) AS score FROM pool)"""
_FEATURES = _SCORED + """, f0 AS (SELECT * REPLACE (CASE WHEN family > 0 THEN family ELSE identity END AS family), list_contains(sources, 'similar_to') AS has_sim, list_contains(sources, 'conditioned_vec') AS has_cond, list_contains(sources, 'family_landing') AS has_fam,
        least(1, greatest(0, 0.35 * identity + 0.25 * align + 0.20 * context + 0.10 * hier - 0.05 * generic - 0.05 * polysemy)) AS pref, coalesce(cond > 1e-6, false) AS really, CASE WHEN coalesce(cond > 1e-6, false) THEN cond ELSE 0 END AS ctx0, coalesce(cond, context) AS ctx FROM scored),
    f1 AS (SELECT *, has_cond AND NOT has_sim AND NOT has_fam AS cond_only, has_sim AND cond IS NOT NULL AS dual, CASE WHEN static > 0 AND ctx0 > 0 THEN greatest(0, static - ctx0) ELSE 0 END AS drop0, CASE WHEN static > 0 AND ctx > 0 THEN greatest(0, static - ctx) ELSE 0 END AS drp FROM f0),
    f2 AS (SELECT *, really AND ctx0 >= 0.36 AND (static <= 1e-6 OR drop0 <= 0.14) AS ctx_path, support >= 2 AND NOT really AND family >= 0.46 AND static >= 0.38 AS by_anchors, dual AND really AND ctx0 >= 0.34 AND (static <= 1e-6 OR drop0 <= 0.14) AS by_both, greatest(static, ctx0) AS best0, greatest(static, ctx) AS best,
        0.30 * identity + 0.25 * family + 0.20 * align + 0.15 * greatest(0, ctx - least(drp, 0.25)) + 0.10 * pref - (0.45 * object + 0.35 * generic + 0.20 * polysemy) AS mainline,
        (has_sim OR has_cond) AND identity >= 0.20 AND align >= 0.74 AND context >= 0.44 AND polysemy < 0.55 AND object < 0.35 AS technical,
        contains(lower(term), '(management)') AS managerial, identity < 0.28 AND context < 0.50 AND (object >= 0.18 OR polysemy >= 0.45) AND hier < 0.30 AS bad FROM f1),
    f AS (SELECT *, best0 >= 0.38 AND (ctx_path OR by_anchors OR by_both) AS ok, NOT technical AND identity < 0.24 AND (align < 0.76 OR context < 0.46) AS drifting,
        mainline >= 0.52 AND identity >= 0.52 AND family >= 0.48 AND ctx >= 0.42 AND drp <= 0.10 AND generic <= 0.52 AND NOT cond_only AS strong,
        mainline >= 0.42 AND identity >= 0.42 AND family >= 0.38 AND align >= 0.50 AND generic <= 0.58 AND polysemy <= 0.35 AND object <= 0.25 AS middle FROM f2)"""


@query("rul03_relative_ranks", _SCORED + " SELECT query_id, anchor_id, cand, score FROM scored", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return pool(spark, d).select("query_id", "anchor_id", "cand", "score")


@query("rul03_buckets", _FEATURES + """ SELECT query_id, anchor_id, cand, CASE WHEN retain = 'reject' THEN 'reject' WHEN managerial OR bad OR drifting THEN 'reject' WHEN polysemy >= 0.55 AND context < 0.50 THEN 'reject' WHEN NOT ok AND best0 >= 0.36 THEN 'risky_keep' WHEN NOT ok THEN 'reject'
        WHEN object >= 0.55 OR polysemy >= 0.60 THEN 'reject' WHEN strong AND really THEN 'primary_expandable' WHEN strong THEN 'primary_support_keep' WHEN middle AND NOT cond_only AND mainline >= 0.46 AND really THEN 'primary_support_seed' WHEN middle THEN 'primary_support_keep'
        WHEN mainline >= 0.28 AND align >= 0.45 THEN 'primary_support_keep' WHEN best >= 0.36 THEN 'risky_keep' ELSE 'reject' END AS bucket,
    CASE WHEN retain = 'reject' THEN 'retain_mode_reject' WHEN managerial OR bad OR drifting THEN 'obviously_bad_branch' WHEN polysemy >= 0.55 AND context < 0.50 THEN 'polysemous_no_context' WHEN NOT ok AND best0 >= 0.36 THEN 'weak_line_not_primary' WHEN NOT ok THEN 'not_primary_enough'
        WHEN object >= 0.55 OR polysemy >= 0.60 THEN 'object_or_poly_bad' WHEN strong AND really THEN 'axis_strong_mainline' WHEN strong THEN 'no_real_ctx_demote_expandable' WHEN middle AND NOT cond_only AND mainline >= 0.46 THEN CASE WHEN really THEN 'axis_neighbor_weak_seed' ELSE 'no_real_ctx_demote_seed' END
        WHEN middle THEN 'axis_weak_or_conditioned_only' WHEN mainline >= 0.28 AND align >= 0.45 THEN 'axis_keep_no_expand' WHEN best >= 0.36 THEN 'weak_line_not_primary' ELSE 'low_mainline' END AS reason,
    CASE WHEN drifting THEN 'semantic_drift_branch' WHEN bad THEN 'object_or_poly_bad_branch' WHEN managerial THEN 'obviously_bad_branch' WHEN technical THEN 'weak_tech_keep' WHEN NOT supported AND pref < 0.40 THEN 'low_mainline_no_context'
        WHEN identity < 0.45 AND context < 0.55 AND align >= 0.74 AND polysemy < 0.40 AND object < 0.18 THEN 'weak_tech_keep' WHEN NOT supported AND identity < 0.33 THEN 'low_identity_no_context' WHEN polysemy >= 0.55 AND NOT supported AND identity < 0.40 THEN 'polysemous_no_context' ELSE '' END AS precheck FROM f""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = G.bucketed(pool(spark, d))
    return rows.select("query_id", "anchor_id", "cand", F.col("pre.outcome").alias("bucket"), F.col("pre.reason").alias("reason"), F.col("check.reason").alias("precheck"))


_BUCKET = """CASE WHEN retain = 'reject' OR managerial OR bad OR drifting OR (polysemy >= 0.55 AND context < 0.50) OR (NOT ok AND best0 < 0.36) OR (ok AND (object >= 0.55 OR polysemy >= 0.60)) THEN 'reject' WHEN NOT ok THEN 'risky_keep'
    WHEN strong AND really THEN 'primary_expandable' WHEN strong THEN 'primary_support_keep' WHEN middle AND NOT cond_only AND mainline >= 0.46 AND really THEN 'primary_support_seed' WHEN middle OR (mainline >= 0.28 AND align >= 0.45) THEN 'primary_support_keep' WHEN best >= 0.36 THEN 'risky_keep' ELSE 'reject' END"""


@query("rul08_merged_terms", _FEATURES + f""", b AS (SELECT *, {_BUCKET} AS bucket FROM f), m AS (SELECT query_id, cand AS tid, anchor_id, array_to_string(sources, '+') AS source, CASE WHEN bucket = 'risky_keep' THEN 'side' ELSE 'primary' END AS role, score FROM b WHERE bucket <> 'reject')
    SELECT query_id, tid, max(score) AS score, count(*) AS members, array_to_string(list_sort(list(DISTINCT anchor_id)), ',') AS anchors, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, bool_or(role = 'primary') AS "primary", arg_min(anchor_id, (-score, anchor_id)) AS lead,
        string_agg(anchor_id || ':' || source || ':' || role, ',' ORDER BY score DESC, anchor_id) AS provenance FROM m GROUP BY 1, 2""", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = G.bucketed(pool(spark, d)).where(F.col("pre.outcome") != G.REJECT)
    role = F.when(F.col("pre.outcome") == G.RISKY, "side").otherwise("primary")
    out = R.merged_terms(rows.select("query_id", F.col("cand").alias("tid"), "anchor_id", F.array_join("sources", "+").alias("source"), role.alias("role"), "score"))
    told = F.transform("provenance", lambda m: F.concat_ws(":", m["anchor_id"].cast("string"), m["source"], m["role"]))
    return out.select("query_id", "tid", "score", "members", F.array_join(F.transform("anchors", lambda a: a.cast("string")), ",").alias("anchors"), F.array_join("sources", ",").alias("sources"), "primary", "lead", F.array_join(told, ",").alias("provenance"))


def landed(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, "landings", d, lambda: G.selected(pool(spark, d), top_anchors(spark, d)), ANCHORS, STRONG, NEAR, CONDITIONED, FAMILY)


@query("rul04_landings")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate of every anchor with its bucket after all passes, and its anchor's landing state."""
    return landed(spark, d)


def seeds(spark: SparkSession, d: str) -> DataFrame:
    """Landed candidates with their features, as operators/seeds.py wants them."""
    term = X.vocabulary(spark, d).select(F.col("voc_id").alias("anchor_id"), F.col("term").alias("anchor_term"))
    kept = landed(spark, d).where(F.col("bucket").isin(*G.KEPT)).select(*G.KEYS, "cand", "tier", "can_expand", "fallback", "bridge")
    rows = G.features(pool(spark, d)).join(kept, [*G.KEYS, "cand"]).join(term, "anchor_id").join(top_anchors(spark, d).select(*G.KEYS, "mode"), G.KEYS)
    hier, none = F.col("hier"), F.lit(None).cast("double")
    fits = {"field": hier, "subfield": hier, "topic": hier, "path": hier, "specificity": none, "span": none}
    score = R.primary_score(F.col("static"), F.col("context"), F.col("identity"), F.col("align"), F.col("support"), F.col("context"), fits, F.col("retain") == "weak_retain", ~F.col("dual") & ~F.col("supported"))
    return rows.withColumn("score", _round(score)).withColumn("gain", F.when(F.col("cond").isNotNull(), F.col("cond") - F.col("static")).otherwise(0.0))


@query("rul06_seed_eligibility")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each landed candidate's verdict as a seed, with its score, the reason and how many tests it passed before."""
    rows = E.eligible(seeds(spark, d))
    return rows.select("query_id", "anchor_id", "cand", "tier", F.round("seed_score", 9).alias("seed_score"), F.col("verdict.outcome").alias("verdict"), F.col("verdict.reason").alias("reason"), F.size("verdict.passed").alias("passed"))


def support_edges(spark: SparkSession, d: str) -> DataFrame:
    """Gated edges from strong seeds to the terms that co-occur with them: similarities to seed, anchor, shared context and the anchor's landed family."""
    able = E.eligible(seeds(spark, d)).where("verdict.outcome = 'eligible'")
    # A term that several anchors landed is one seed of its query, at its best anchor.
    best = F.row_number().over(Window.partitionBy("query_id", "cand").orderBy(F.desc("seed_score"), "anchor_id"))
    able = able.withColumn("_r", best).where("_r = 1").select("query_id", "anchor_id", "cand", "score", "align", "support", "retain")
    rel, w = relative_similar(spark, d), words(spark, d)
    near = rel.where(F.col("r") <= NEAR).groupBy("src").agg(F.collect_set("dst").alias("near"))
    sim = lambda key, name: rel.select(F.col("src").alias(key), F.col("dst").alias("target"), F.col("static").alias(name))
    edges = able.select("query_id", "anchor_id", "cand").join(S.partners(cooccurrence(spark, d)).select(F.col("voc_id").alias("cand"), F.col("partner").alias("target"), "freq"), "cand")
    edges = edges.join(sim("cand", "primary"), ["cand", "target"], "left").join(sim("anchor_id", "anchor"), ["anchor_id", "target"], "left")
    family = landed(spark, d).where(F.col("bucket").isin(*G.KEPT)).select("query_id", "anchor_id", F.col("cand").alias("member"))
    # A pair of anchor and target is measured once, whatever the number of its seeds; an anchor has a handful of members.
    pairs = edges.select("query_id", "anchor_id", "target").distinct().join(family, ["query_id", "anchor_id"]).join(sim("member", "sim"), ["member", "target"], "left").withColumn("sim", F.coalesce("sim", F.lit(0.0)))
    edges = edges.join(E.family_support(pairs, "query_id", "anchor_id", "target"), ["query_id", "anchor_id", "target"], "left")
    of = w.join(term_statistics(spark, d), "voc_id", "left").join(near, F.col("voc_id") == F.col("src"), "left")
    a = of.select(F.col("voc_id").alias("anchor_id"), F.col("words").alias("a_words"), F.col("near").alias("a_near"), F.col("dist").alias("a_dist"))
    t = of.select(F.col("voc_id").alias("target"), F.col("words").alias("t_words"), F.col("near").alias("t_near"), F.col("dist").alias("t_dist"), F.col("span").cast("int").alias("span"))
    edges = edges.join(a, "anchor_id").join(t, "target")
    common = F.size(F.array_intersect("a_words", "t_words"))
    both = F.map_zip_with("a_dist", "t_dist", lambda k, x, y: F.least(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
    fit = F.aggregate(F.map_values(both), F.lit(0.0), lambda s, x: s + x)
    context = F.least(F.lit(1.0), F.size(F.array_intersect("a_near", "t_near")) / 5.0)
    kept = landed(spark, d).where(F.col("bucket").isin(*G.KEPT)).select("query_id", F.col("cand").alias("target")).distinct().withColumn("landed", F.lit(True))
    edges = edges.join(kept, ["query_id", "target"], "left")
    edges = edges.select(
        "query_id", "cand", "target", "freq", F.coalesce("landed", F.lit(False)).alias("landed"), (F.size(F.array_intersect(F.map_keys("a_dist"), F.map_keys("t_dist"))) > 0).alias("in_domain"), _round(fit).alias("domain_fit"),
        "primary", "anchor", _round(context).alias("context"), _round(F.col("family_support")).alias("family_support"),
        _round(0.4 * common / (F.size("a_words") + F.size("t_words") - common) + 0.6 * F.coalesce(F.col("anchor"), F.lit(0.0))).alias("identity"), "span",
    )
    return E.admitted(E.gated(edges), able)


@query("rul06_cooccurrence_support")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Edges of strong seeds: the first gate that stopped each (null: admitted), how many seeds stand behind its target, and its strength."""
    return support_edges(spark, d).select("query_id", "cand", "target", "freq", "block", "backers", F.round("keep", 9).alias("keep"), "strength")
