"""Rules of the graph path and of the last ranking as column expressions: penalties, weights, admissions, audits, encoders.

Missing numbers count as said in each docstring; everything is a projection or one grouped aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import blend, clipped

# Factors, weights and thresholds of the rules.
ROBOT_WORDS = ("robot", "uav", "ugv", "arm", "manipulator", "kinematic", "trajectory", "motion", "mpc", "lqr", "ilqr", "ddp", "state estimation", "real-time", "realtime")
PAPER_CLASSES = {"mainline_resonance": 0.06, "mainline_plus_support": 0.05, "single_hit_mainline": 0.04, "single_hit_side": -0.045, "side_only_or_accidental_multi_hit": -0.055}
AUTHOR_CLASSES = {"mainline_supported": 0.038, "mixed_but_side_heavy": -0.028, "side_only_supported": -0.048, "single_paper_supported": -0.055}
SIDE_CLASSES = ("side_only_supported", "mixed_but_side_heavy", "single_paper_supported")
PAPER_CLIP, AUTHOR_CLIP = (0.80, 1.12), (0.78, 1.10)
BUCKET_CODES = {"A": 0.25, "B": 0.35, "C": 0.5, "D": 0.6, "E": 0.75, "F": 0.9, "Z": 1.0}
FAMILY_TYPES = ("exact_like", "near_synonym", "generic", "shifted")
CLAUSE_LEAST, CLAUSE_MOST, CLAUSES, CLAUSE_PREFIX = 14, 520, 6, 36


def or_zero(x: Column) -> Column:
    return F.coalesce(x.cast("double"), F.lit(0.0))


def unit(x: Column) -> Column:
    """x between 0 and 1; 0 if missing."""
    return clipped(or_zero(x), 0.0, 1.0)


def _of(x: Column, table: dict[str, float], other: float = 0.0) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(x == k, v).otherwise(out)
    return out


# --- penalties of terms


def generic_penalty(works: Column, span: Column) -> Column:
    """MTH-06: less for terms of very many works and of many domains; no works count as no penalty for works."""
    many = F.when(F.coalesce(works, F.lit(0)) != 0, 1.0 / F.log(2.0 + F.greatest(works, F.lit(0)))).otherwise(1.0)
    return many / (1.0 + 0.25 * F.greatest(F.coalesce(span, F.lit(0)) - 1, F.lit(0)))


def external_penalty(subfield_fit: Column, topic_fit: Column, outside_subfield: Column, outside_topic: Column) -> Column:
    """MTH-06: less for terms whose mass lies outside of the query's fields; what is missing isn't punished."""
    steps = ((subfield_fit < 0.15, 0.4), (topic_fit < 0.05, 0.6), (outside_subfield > 0.80, 0.35), (outside_topic > 0.90, 0.5))
    out = F.lit(1.0)
    for hit, factor in steps:
        out = out * F.when(hit, factor).otherwise(1.0)
    return out


def purity(dist: Column) -> Column:
    """The largest share of a map of shares; 1 for an empty or missing map."""
    return F.coalesce(F.array_max(F.map_values(dist)), F.lit(1.0))


def entropy(dist: Column) -> Column:
    """In nats, of a map of shares; 0 for an empty or missing map."""
    part = F.transform(F.filter(F.map_values(dist), lambda p: p > 0), lambda p: -p * F.log(p))
    return F.coalesce(F.aggregate(part, F.lit(0.0), lambda a, x: a + x), F.lit(0.0))


def purity_bonus(subfields: Column, topics: Column) -> Column:
    return F.pow(purity(subfields), F.lit(0.8)) * purity(topics)


def entropy_penalty(subfields: Column, topics: Column, by_subfield: float = 0.3, by_topic: float = 0.5) -> Column:
    return 1.0 / (1.0 + by_subfield * entropy(subfields) + by_topic * entropy(topics))


def genericity(term: Column, span: Column, works: Column) -> Column:
    """MTH-07: factor for terms of many domains and works, and for 'control' without a word of robotics; an empty term has none."""
    n, w = F.greatest(F.coalesce(span, F.lit(0)), F.lit(1)), F.coalesce(works, F.lit(0))
    broad = F.when((n >= 6) & (w >= 200), 0.4).when((n >= 4) & (w >= 100), 0.6).otherwise(1.0)
    low = F.lower(term)
    robotic = F.exists(F.array(*[F.lit(x) for x in ROBOT_WORDS]), lambda x: F.contains(low, x))
    control = F.when(low.contains("control") & ~robotic, 0.5).otherwise(1.0)
    return F.when(F.trim(F.coalesce(term, F.lit(""))) == "", 1.0).otherwise(F.greatest(F.lit(0.1), broad * control))


def smoothed_idf(degree: Column) -> Column:
    """MTH-03, smoothed: 1 below 10 works, rising to 1.5 at 50, 0.9 from there on."""
    return F.when(degree < 10, 1.0).when(degree < 50, 1.0 + 0.5 * (degree - 10.0) / 40.0).otherwise(0.9)


def anchor_factor(task: Column, carrier: Column, base: float = 0.35, gain: float = 0.65) -> Column:
    """1 if neither similarity is there."""
    near = base + gain * F.pow(unit(task), F.lit(1.5)) + 0.15 * F.pow(unit(carrier), F.lit(1.1))
    return F.when(task.isNull() & carrier.isNull(), 1.0).otherwise(near)


def legacy_weight(sim: Column, idf: Column, purity_: Column, size: Column, anchor: Column, generic: Column, least: float = 0.4, power: float = 3.0) -> Column:
    """MTH-27: sim^3 idf purity size anchor generic; 0 below the least similarity."""
    return F.when(sim < least, 0.0).otherwise(F.pow(F.greatest(sim, F.lit(0.0)), F.lit(power)) * idf * F.least(purity_, F.lit(1.0)) * size * anchor * generic)


def uniqueness(dist: Column, active: Column) -> Column:
    """MTH-30: the share of a term's domain masses that lies in the active domains; 1 without statistics."""
    total = F.aggregate(F.map_values(dist), F.lit(0.0), lambda a, x: a + x)
    inside = F.aggregate(F.map_values(F.map_filter(dist, lambda k, v: F.array_contains(active, k))), F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, clipped(inside / total, 0.0, 1.0)).otherwise(1.0)


def confidence(role: Column, source: Column) -> Column:
    """MTH-30: by a term's role, and a primary's by its source."""
    r, s = F.lower(F.trim(F.coalesce(role, F.lit("")))), F.lower(F.trim(F.coalesce(source, F.lit(""))))
    primary = F.when(s.isin("similar_to", "jd_vector", ""), 0.95).otherwise(0.90)
    return F.when(r == "primary", primary).when(r == "dense_expansion", 0.75).when(r.isin("cluster_expansion", "cooc_expansion"), 0.60).otherwise(0.80)


def in_active_domains(dist: Column, active: Column) -> Column:
    """FLT-27: some domain is active, and the heaviest one is (ties: the smaller id); without statistics or active domains a term passes."""
    best = F.array_sort(F.transform(F.map_entries(dist), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k"))))[0]["k"]
    return F.when(F.coalesce(F.size(active), F.lit(0)) <= 0, True).when(F.coalesce(F.size(dist), F.lit(0)) <= 0, True).otherwise(F.arrays_overlap(F.map_keys(dist), active) & F.array_contains(active, best))


# --- primaries


def context_consistency(sim: Column, context: Column) -> Column:
    s, c = unit(sim), unit(context)
    return F.when(c <= 0, s * 0.65).otherwise(clipped(0.45 * s + 0.45 * c + 0.10 * (1 - F.abs(s - c)), 0.0, 1.0))


def primary_score(sim: Column, context: Column, identity: Column, align: Column, anchors: Column, neighbours: Column, fits: dict[str, Column], weak: Column, unsupported: Column) -> Column:
    """MTH-21. fits: field, subfield, topic, path, specificity, and span (1 if missing); weak: kept weakly; unsupported: similar only, without context."""
    base = blend(
        (0.30, unit(identity)), (0.26, context_consistency(sim, context)), (0.24, unit(align)), (0.10, unit(sim)),
        (0.06, F.least(F.coalesce(anchors, F.lit(0)), F.lit(2)) / 2.0), (0.04, unit(neighbours)),
    )
    bonus = blend(*[(w, unit(fits[k])) for k, w in (("field", 0.04), ("subfield", 0.05), ("topic", 0.05), ("path", 0.03), ("specificity", 0.02))])
    span = 0.95 + 0.05 * unit(F.coalesce(fits["span"], F.lit(1.0)))
    return clipped((base + bonus) * span * F.when(weak, 0.92).otherwise(1.0) * F.when(unsupported, 0.90).otherwise(1.0), 0.0, 1.0)


def admission(term_ok: Column, sim: Column, align: Column, continuity: Column, identity: Column, object_risk: Column, polysemy: Column) -> Column:
    """MTH-21: normal (may be expanded), weak_retain or reject."""
    s, a, c, i = (or_zero(x) for x in (sim, align, continuity, identity))
    normal = (s >= 0.68) & (a >= 0.65) & (c >= 0.55) & (i >= 0.18) & (or_zero(object_risk) <= 0.70) & (or_zero(polysemy) <= 0.72)
    weak = (s >= 0.55) & (a >= 0.52) & ((c >= 0.45) | (i >= 0.12))
    return F.when(~term_ok, "reject").when(normal, "normal").when(weak, "weak_retain").otherwise("reject")


def merged_primaries(candidates: DataFrame, key: str = "query_id") -> DataFrame:
    """RUL-05: over a query's anchors, one row per term.

    candidates: query_id, tid, anchor, rank, mainline, can_expand, preference, identity, align, continuity, family_type.
    The worst family type of a term counts (exact_like is best); its anchors give a bonus of 0.03 each after the first, to 0.10,
    of which generic and shifted terms get three tenths. order: by mainline hits, anchors, rank and expandability, ties by term.
    """
    worst = F.max(F.coalesce(F.array_position(F.array(*[F.lit(x) for x in FAMILY_TYPES]), F.col("family_type")), F.lit(1)))
    best = [F.greatest(F.coalesce(F.max(x), F.lit(0.0)), F.lit(0.0)).alias(f"best_{x}") for x in ("preference", "identity", "align", "continuity")]
    rows = candidates.groupBy(key, "tid").agg(
        F.array_sort(F.collect_list("anchor")).alias("anchors"), F.count(F.lit(1)).alias("support_count"), F.coalesce(F.min("rank"), F.lit(10**9)).alias("best_rank"),
        F.count_if("mainline").alias("mainline_hits"), F.coalesce(F.bool_or("can_expand"), F.lit(False)).alias("can_expand"), *best, worst.alias("_worst"),
    )
    bonus = F.least(F.lit(0.10), 0.03 * (F.col("support_count") - 1)) * F.when(F.col("_worst") >= 3, 0.3).otherwise(1.0)
    rows = rows.withColumn("family_type", F.element_at(F.array(*[F.lit(x) for x in FAMILY_TYPES]), F.col("_worst").cast("int"))).withColumn("cross_anchor_bonus", bonus).drop("_worst")
    order = Window.partitionBy(key).orderBy(F.desc("mainline_hits"), F.desc("support_count"), "best_rank", F.desc("can_expand"), "tid")
    return rows.withColumn("order", F.row_number().over(order))


def merged_terms(candidates: DataFrame, key: str = "query_id") -> DataFrame:
    """RUL-08: one row a term of a query, with all that brought it in: score (the best), members, anchors and sources (sorted, distinct), primary, lead (the anchor of the best member) and provenance.

    candidates: query_id, tid, anchor_id, source, role, score. provenance is an array of struct<score, anchor_id, source, role>, the best first, ties by anchor; a term has as many members as its query has anchors and sources.
    """
    member = F.struct((-F.col("score")).alias("_s"), "anchor_id", "source", "role", "score")
    primary = F.coalesce(F.bool_or(F.lower(F.trim("role")) == "primary"), F.lit(False))
    rows = candidates.groupBy(key, "tid").agg(
        F.max("score").alias("score"), F.count(F.lit(1)).alias("members"), F.array_sort(F.collect_set("anchor_id")).alias("anchors"), F.array_sort(F.collect_set("source")).alias("sources"), primary.alias("primary"), F.array_sort(F.collect_list(member)).alias("_m")
    )
    told = F.transform("_m", lambda m: F.struct(m["score"].alias("score"), m["anchor_id"].alias("anchor_id"), m["source"].alias("source"), m["role"].alias("role")))
    return rows.withColumn("lead", F.get("_m", 0)["anchor_id"]).withColumn("provenance", told).drop("_m")


def family_decayed(df: DataFrame, score: str, family: str, tie: str, *group: str, base: float = 0.85) -> DataFrame:
    """WIN-09: the k-th best of a family counts base^(k - 1), by score, ties by tie."""
    rank = F.row_number().over(Window.partitionBy(*group, family).orderBy(F.desc(score), tie))
    return df.withColumn("family_rank_decay", F.pow(F.lit(base), rank - 1)).withColumn(score, F.col(score) * F.col("family_rank_decay"))


def newest(df: DataFrame, key: str, most: int, year: str = "year", tie: str = "work_id") -> DataFrame:
    """WIN-04: the newest `most` rows of each key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(year), tie))
    return df.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def entry_group(role: Column, in_anchor: Column, can_expand: Column) -> Column:
    """RUL-08: trusted_primary, secondary_primary or support_expansion."""
    primary = F.lower(F.trim(F.coalesce(role, F.lit("")))) == "primary"
    trusted = primary & (F.lower(F.trim(F.coalesce(in_anchor, F.lit("")))) == "mainline") & F.coalesce(can_expand, F.lit(False))
    return F.when(trusted, "trusted_primary").when(primary, "secondary_primary").otherwise("support_expansion")


def term_flags(polysemy: Column, object_risk: Column, generic: Column) -> Column:
    """RUL-08: array of risk flags, in this order."""
    tests = ((polysemy, 0.75, "high_polysemy"), (object_risk, 0.55, "object_like"), (generic, 0.55, "too_generic"))
    return F.array_compact(F.array(*[F.when(or_zero(x) > most, F.lit(name)) for x, most, name in tests]))


def guardrail(tid: Column, term: Column, evidence: Column, anchors: Column, path: Column, topic_fit: Column, subfield_fit: Column, primary: Column, source: Column) -> Column:
    """RUL-08: null for terms that pass, else missing_required_stage3_fields or weak_evidence_noise. A missing path match comes from topic and subfield fits."""
    seen, near = F.coalesce(evidence, F.lit(0)), F.coalesce(anchors, F.lit(0))
    topic = or_zero(F.coalesce(topic_fit, subfield_fit))
    match = F.when(or_zero(path) > 0, path).otherwise(0.55 * topic + 0.35 * or_zero(subfield_fit))
    like = F.coalesce(primary, F.lit(False)) | (F.lower(F.trim(F.coalesce(source, F.lit("")))) == "similar_to") | (near >= 2)
    missing = tid.isNull() | (F.trim(F.coalesce(term, F.lit(""))) == "") | (seen <= 0)
    return F.when(missing, "missing_required_stage3_fields").when((near <= 1) & (seen <= 1) & (match < 0.15) & ~like, "weak_evidence_noise")


# --- papers and authors


def paper_factor(hit_class: Column, mainline: Column, side: Column, multi: Column, grounding: Column, align: Column, hierarchy: Column) -> Column:
    """MTH-19, papers: 1 and small steps, clipped. Missing: alignment 0.5, hierarchy 1, others 0."""
    most = lambda x, n: F.least(F.coalesce(x, F.lit(0)), F.lit(n))
    delta = _of(hit_class, PAPER_CLASSES) + 0.014 * most(mainline, 3) - 0.009 * most(side, 3) + 0.018 * most(multi, 2)
    delta = delta + clipped((or_zero(grounding) - 0.26) * 0.07, -0.028, 0.028) + clipped((F.coalesce(align, F.lit(0.5)) - 0.52) * 0.055, -0.026, 0.026)
    return clipped(1.0 + delta + clipped((F.coalesce(hierarchy, F.lit(1.0)) - 1.0) * 0.12, -0.022, 0.022), *PAPER_CLIP)


def author_factor(mainline: Column, side: Column, support_class: Column, risk: Column, dominant: Column, multi: Column, side_multi: Column) -> Column:
    """MTH-19, authors."""
    most = lambda x, n: F.least(F.coalesce(x, F.lit(0)), F.lit(n))
    heavy = support_class.isin(*SIDE_CLASSES) & (dominant >= 0.72)
    delta = 0.11 * or_zero(mainline) - 0.09 * or_zero(side) + _of(support_class, AUTHOR_CLASSES) - F.when(risk, 0.038).otherwise(0.0)
    delta = delta - F.when(heavy, 0.055 * clipped((dominant - 0.52) / 0.48, 0.0, 1.0)).otherwise(0.0)
    return clipped(1.0 + delta + 0.022 * most(multi, 2) - 0.016 * most(side_multi, 2), *AUTHOR_CLIP)


def unified_ranking(authors: DataFrame, key: str = "query_id") -> DataFrame:
    """MTH-18: authors of a query with `unified`, a linear blend brought to 0..1.

    authors: score, rerank, mainline_ratio, papers, axes, multi_hits, primary_score, structure, suppressed, broad.
    """
    own = Window.partitionBy(key)

    def scaled(x: Column, flat: Column) -> Column:
        low, high = F.min(x).over(own), F.max(x).over(own)
        return F.when(high > low + 1e-18, (x - low) / (high - low)).otherwise(flat)

    # Two steps, as a window can't stand inside of another.
    rows = authors.withColumn("_rerank", scaled(or_zero(F.col("rerank")), F.lit(0.5)))
    one = F.lit(1.0)
    raw = blend(
        (0.46, F.col("score")), (0.20, F.col("_rerank")), (0.10, F.col("mainline_ratio")), (0.07, F.least(one, F.log1p(F.greatest(F.col("papers"), F.lit(0)).cast("double")) / F.log1p(F.lit(6.0)))),
        (0.06, F.least(one, F.col("axes") / 5.0)), (0.05, F.least(one, F.col("multi_hits") / 2.0)), (0.04, F.least(one, F.col("primary_score") * 3.0)),
        (0.02, clipped((F.coalesce(F.col("structure"), one) - 0.42) / 0.70, 0.0, 1.0)), (-0.08, F.col("suppressed").cast("double")), (-0.06, F.col("broad").cast("double")),
    )
    rows = rows.withColumn("raw", raw)
    return rows.withColumn("unified", scaled(F.col("raw"), F.col("raw"))).drop("_rerank")


def suppression_audit(papers: Column, top_class: Column, mainline: Column, dominant: Column, primary_papers: Column, top_role: Column) -> Column:
    """RUL-10: null if an author is a single paper's side hit, else the first test that says otherwise."""
    return (
        F.when(~papers.eqNullSafe(1), "paper_count!=1")
        .when(~top_class.eqNullSafe("single_hit_side"), "top_paper_hit_quality_class")
        .when(or_zero(mainline) > 0.05, "mainline_support_ratio")
        .when(dominant.isNull() | (dominant < 0.9), "dominant_term_share")
        .when(F.coalesce(primary_papers, F.lit(0)) > 0, "author_primary_evidence_count")
        .when(top_role.eqNullSafe("primary_evidence"), "top_paper_primary_evidence")
    )


# --- vector branches and clauses


def branch_score(scores: list[tuple[float, Column]], hits: Column) -> Column:
    """MTH-13: weighted mean over the branches in use (missing scores 0), and 0.012 for each further hit, to 0.05; 1 at most."""
    total = sum(w for w, _ in scores)
    base = blend(*scores) / total if total > 1e-9 else F.lit(0.0)
    return F.least(F.lit(1.0), base + F.least(F.lit(0.05), 0.012 * F.greatest(F.coalesce(hits, F.lit(0)) - 1, F.lit(0))))


def clause_only_score(best: Column) -> Column:
    """MTH-14: of a paper that only clauses found."""
    return F.least(F.lit(0.40), 0.09 + 0.58 * best)


def clause_bonus(hits: Column, best: Column, coverage: Column, cap: float = 0.048) -> Column:
    bonus = 0.007 * F.least(hits, F.lit(6)) + 0.022 * or_zero(best) * (0.45 + 0.55 * or_zero(coverage))
    return F.when(F.coalesce(hits, F.lit(0)) > 0, F.least(bonus, F.lit(cap))).otherwise(0.0)


def selected_clauses(clauses: Column, whole: Column) -> Column:
    """STR-21: of an array of clauses those to search by, in order: 14 to 520 characters, none that equals (without white space and case) an
    earlier one or one of `whole` (an array of texts), none that begins like an earlier one (36 characters), six at most."""
    form = lambda x: F.regexp_replace(F.lower(F.trim(x)), r"\s+", "")
    known = F.transform(F.filter(whole, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), form)
    trimmed = F.transform(F.filter(clauses, lambda x: x.isNotNull()), lambda x: F.trim(x))
    able = F.filter(trimmed, lambda x: F.length(x).between(CLAUSE_LEAST, CLAUSE_MOST) & (F.length(form(x)) >= 12) & ~F.array_contains(known, form(x)))

    def step(out: Column, x: Column) -> Column:
        alike = F.exists(out, lambda y: (form(y) == form(x)) | ((F.least(F.length(x), F.length(y)) >= CLAUSE_PREFIX) & (F.substring(x, 1, CLAUSE_PREFIX) == F.substring(y, 1, CLAUSE_PREFIX))))
        return F.when((F.size(out) >= CLAUSES) | alike, out).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(able, F.expr("cast(array() as array<string>)"), step)


# --- encoders and records


def bucket_code(bucket: Column, missing: str = "D") -> Column:
    """PRJ-08: a bucket as a number; 0.5 for unknown ones."""
    return _of(F.upper(F.trim(F.when(F.coalesce(bucket, F.lit("")) == "", F.lit(missing)).otherwise(bucket))), BUCKET_CODES, 0.5)


def rank_code(rank: Column, most: float = 500.0) -> Column:
    """PRJ-08: 1 for the best rank, 0 for none."""
    return F.when(rank.isNull(), 0.0).otherwise(1.0 - F.least(rank.cast("double") / most, F.lit(1.0)))


def candidate_record(pool: DataFrame) -> DataFrame:
    """PRJ-05: author_id and one structure of recall features; missing ranks are 999, missing numbers 0, a missing bucket Z."""
    rank = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(999)).alias(c)
    recall = F.struct(
        *[F.col(c).cast("int").alias(c) for c in ("from_vector", "from_label", "from_collab")], F.coalesce("path_count", F.lit(0)).alias("path_count"), F.coalesce("bucket", F.lit("Z")).alias("bucket_type"),
        rank("vector_rank"), rank("label_rank"), rank("collab_rank"), or_zero(F.col("pool_score")).alias("candidate_pool_score"),
    )
    return pool.select("query_id", "author_id", recall.alias("recall_features"))
