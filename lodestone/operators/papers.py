"""Works of a query by what hit them (RUL-09): hit quality and evidence, cohesion with the rest of the pool, and a second selection in which the whole pool competes anew; and authors whose rank one broad term carries (RUL-10).

Cohesion is measured by grouped counts: a work's neighbours are those of the same main subfield and topic, so no pairs of
works are formed, however large a pool is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import blend, clipped
from .cascade import Test, judged
from .ranks import placed
from .rules import or_zero, paper_factor, unit
from .storage import stored

KEYS = ["query_id", "work_id"]
RESONANCE, SUPPORTED, SINGLE_MAIN, SINGLE_SIDE, SIDE_ONLY = "mainline_resonance", "mainline_plus_support", "single_hit_mainline", "single_hit_side", "side_only_or_accidental_multi_hit"
MAINLINE_CLASSES = (RESONANCE, SUPPORTED, SINGLE_MAIN)

# Evidence.
BASE = {RESONANCE: 0.90, SUPPORTED: 0.84, SINGLE_MAIN: 0.72, SIDE_ONLY: 0.40, SINGLE_SIDE: 0.30}
BASE_OTHER, ALIGN_MISSING = 0.48, 0.55
PROTECTED = {RESONANCE: 0.050, SUPPORTED: 0.042, SINGLE_MAIN: 0.034, SINGLE_SIDE: -0.038, SIDE_ONLY: -0.048}
PROTECTED_CLIP = (0.88, 1.08)
CARRIER_TERMS = (
    "robotic arm", "robot arm", "robot hand", "robotic hand", "gripper", "end effector", "end-effector", "manipulator", "actuator", "quadcopter", "drone body", "hardware prototype",
)
# Competition.
MIX, MIX_FRINGE, FRINGE_LOW = (0.85, 0.15), (0.93, 0.07), 0.03
FRINGE_GUARD, MAINLINE_BONUS, ISOLATED, COHESIVE = 0.88, 1.035, 0.90, 1.065
COHESION = {RESONANCE: 1.010, SUPPORTED: 1.010, SINGLE_MAIN: 1.008, SINGLE_SIDE: 0.986, SIDE_ONLY: 0.990}
COHESION_SIDE_HEAVY, COHESION_ACCIDENTAL, COHESION_AXES, COHESION_CLIP = 0.988, 0.996, 1.004, (0.988, 1.015)
RESIDUAL_MILD, RESIDUAL_STRONG = 0.975, 0.970
# Topics of a pool.
FREQ_LEAST, FREQ_SHARE, PROFILE_KEYS = 4, 0.12, 4
OVERLAP = {"topic": 0.032, "subfield": 0.042, "field": 0.14, "field_with": 0.018}
CONSENSUS, DETAIL, NEIGHBOURS, SIGNALS = 0.038, 0.048, 2, 2
DETAIL_MIX = {"field": 0.22, "subfield": 0.38, "topic": 0.40}
# Dominance.
DOMINANT, SECOND_SHARE, MAINLINE_SHARE = 0.85, 0.18, 0.42
THICK_AXES = ("dynamics_kinematics", "planning_trajectory", "optimal_control", "estimation", "simulation_sim2real")
BROAD_AXES = ("control_core", "generic_robot_autonomous_shell")
UNCLASSIFIED = "unclassified"


def _c(name: str) -> Column:
    return F.col(name)


def _table(x: Column, values: dict[str, float], other: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), x), F.lit(other))


# --- hits


def hit_quality(hits: DataFrame, *more: Column) -> DataFrame:
    """RUL-09: a row a work: n, mainline, side, hit_class, coherence, strength, families (single_hit, same_family, cross_family, mixed_or_unknown), grounding (the best), align (the mean, null if none), terms.

    hits: query_id, work_id, term, mainline, parent (the primary behind a term), family, grounding, align. Works that one parent primary hit with side terms only count one as mainline. more: further aggregates of a work's hits, named.
    """
    named = F.when(F.trim("parent") != "", F.lower(F.trim("parent")))
    family = F.when(F.trim("family") != "", _c("family"))
    works = hits.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("mainline", F.lit(False))).alias("_ml"), F.count(named).alias("_named"), F.size(F.collect_set(named)).alias("_parents"), F.size(F.collect_set(family)).alias("_families"),
        F.coalesce(F.max("grounding"), F.lit(0.0)).alias("grounding"), F.avg("align").alias("align"), F.array_sort(F.collect_list("term")).alias("terms"), *more,
    )
    carried = [c for c in works.columns if c not in (*KEYS, "n", "_ml", "_named", "_parents", "_families", "grounding", "align", "terms")]
    aligned = (_c("n") >= 2) & (_c("_ml") == 0) & (_c("_named") == _c("n")) & (_c("_parents") == 1)
    works = works.withColumn("aligned", aligned).withColumn("mainline", F.when(_c("aligned"), 1).otherwise(_c("_ml")).cast("int")).withColumn("side", (_c("n") - _c("mainline")).cast("int"))
    one = _c("n") == 1
    quality = judged(
        [
            Test("single mainline hit", one & (_c("mainline") == 1), SINGLE_MAIN),
            Test("single support/side hit", one, SINGLE_SIDE),
            Test("two or more mainline-like hits", _c("mainline") >= 2, RESONANCE),
            Test("axis-aligned complementary multi-hit", (_c("mainline") == 1) & _c("aligned"), SUPPORTED),
            Test("mainline + support complement", _c("mainline") == 1, SUPPORTED),
        ],
        SIDE_ONLY, "multi-hit with no mainline-like term (accidental/side-heavy)",
    )
    families = F.when(one, "single_hit").when(_c("_families") == 0, "mixed_or_unknown").when(_c("_families") == 1, "same_family").otherwise("cross_family")
    out = works.withColumn("_q", quality)
    strength = F.when(one, 0).when(_c("_q.outcome") == SIDE_ONLY, 1).otherwise(2)
    return out.select(*KEYS, F.col("n").cast("int").alias("n"), "mainline", "side", F.col("_q.outcome").alias("hit_class"), F.col("_q.reason").alias("coherence"), strength.alias("strength"), families.alias("families"), "grounding", "align", "terms", *carried)


def evidence(works: DataFrame) -> DataFrame:
    """RUL-09: works with evidence (0..1), preview (primary_, support_ or fringe_candidate), protection (a factor for what is on the main line) and protected, the re-ranked score times it.

    works: hit_quality() with score and hierarchy (a factor about 1, null: unknown).
    """
    shrunk = (_c("hit_class") == SINGLE_SIDE) & (_c("mainline") == 0) & (_c("side") >= 1)
    near = F.when(_c("align").isNull(), ALIGN_MISSING).otherwise(unit(_c("align")))
    near = F.when(shrunk, 0.35 * near + 0.65 * 0.5).otherwise(near)
    hint = F.when(_c("coherence").startswith("two or more"), 0.03).when(_c("coherence").startswith("mainline + support"), 0.02).otherwise(0.0)
    bonus = F.when(_c("hierarchy").isNull(), 0.5).otherwise(unit((_c("hierarchy") - 0.82) / 0.33))
    step = lambda test, x: F.when(test, x).otherwise(0.0)
    score = blend((0.42, _table(_c("hit_class"), BASE, BASE_OTHER)), (0.22, unit(_c("grounding"))), (0.18, near), (0.08, bonus))
    score = score + step(_c("mainline") >= 1, 0.06) + step(_c("n") >= 2, 0.04) - step((_c("side") > 0) & (_c("mainline") == 0), 0.10) + hint - step(shrunk, 0.08)
    rows = works.withColumn("evidence", unit(score))
    fringe = _c("hit_class").isin(SINGLE_SIDE, SIDE_ONLY) | ((_c("mainline") == 0) & (_c("side") > 0)) | (_c("evidence") < 0.34)
    rows = rows.withColumn("preview", F.when(fringe, "fringe_candidate").when((_c("evidence") >= 0.58) & (_c("mainline") >= 1), "primary_candidate").otherwise("support_candidate"))
    rows = rows.withColumn("reranked", _c("score") * paper_factor(_c("hit_class"), _c("mainline"), _c("side"), _c("strength"), _c("grounding"), _c("align"), _c("hierarchy")))
    aside = _c("hit_class").isin(SINGLE_SIDE, SIDE_ONLY)
    low = F.array_join(F.transform("terms", lambda t: F.lower(t)), "\n")
    carrier = F.exists(F.array(*[F.lit(x) for x in CARRIER_TERMS]), lambda x: F.contains(low, x))
    delta = _table(_c("hit_class"), PROTECTED, 0.0) + 0.012 * F.least("mainline", F.lit(2)) + step((F.coalesce("align", F.lit(0.5)) >= 0.58) & (_c("mainline") >= 1), 0.015)
    delta = delta - step(aside & (_c("mainline") == 0) & (_c("side") >= 1), 0.022) - step(aside & carrier, 0.032) - step(aside & (_c("grounding") < 0.22), 0.018)
    rows = rows.withColumn("protection", clipped(1.0 + delta, *PROTECTED_CLIP))
    return rows.withColumn("protected", _c("reranked") * _c("protection"))


# --- cohesion


def cohesion(works: DataFrame, mixes: DataFrame, profile: DataFrame) -> DataFrame:
    """RUL-09: works with neighbours, in_neighbourhood, overlap, signals and cohesion (topic_cohesive_, topic_weak_ or term_only_candidate).

    mixes: work_id, level (field, subfield, topic), key, share, and query_id if a work's mix differs by query; profile: query_id, level, key, share. A neighbourhood are the subfields and topics that many works of the pool have as their main one, and the profile's first four.
    A work's mix is one row and a query's profile one map, so the pool meets them once; what is counted by query, subfield and topic does not grow with works.
    """
    by = [c for c in KEYS if c in mixes.columns]
    main = lambda lv: F.min(F.when(_c("level") == lv, F.struct((-_c("share")).alias("s"), "key")))["key"]
    of = mixes.groupBy(*by).agg(main("subfield").alias("_s"), main("topic").alias("_t"), F.collect_list(F.struct("level", F.concat_ws("\u0001", "level", "key").alias("at"), "share")).alias("_mix"))
    wanted = profile.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "level", "key"), "share"))).alias("_profile"))
    pool = works.join(of, by, "left")
    # A row for each query, subfield and topic, from which the rest is counted.
    counts = stored(pool.groupBy("query_id", "_s", "_t").agg(F.count(F.lit(1)).alias("_c")))
    n = counts.groupBy("query_id").agg(F.sum("_c").alias("_n"))
    same = counts.where("_s is not null and _t is not null").select("query_id", "_s", "_t", (F.col("_c") - 1).alias("neighbours"))
    each = counts.select("query_id", "_c", F.explode(F.array(F.struct(F.lit("subfield").alias("level"), _c("_s").alias("key")), F.struct(F.lit("topic").alias("level"), _c("_t").alias("key")))).alias("k")).select("query_id", "_c", "k.level", "k.key")
    often = each.where("key is not null").groupBy("query_id", "level", "key").agg(F.sum("_c").alias("m")).join(n, "query_id")
    often = often.where(_c("m") >= F.greatest(F.lit(FREQ_LEAST), F.ceil(FREQ_SHARE * _c("_n")))).select("query_id", "level", "key")
    first = F.row_number().over(Window.partitionBy("query_id", "level").orderBy(F.desc("share"), "key"))
    keys = often.unionByName(profile.where(_c("level").isin("subfield", "topic")).withColumn("_r", first).where(_c("_r") <= PROFILE_KEYS).select("query_id", "level", "key")).distinct()
    mine = lambda level, key: keys.where(_c("level") == level).select("query_id", F.col("key").alias(key), F.lit(True).alias(f"{key}_in"))
    pool = pool.join(F.broadcast(same), ["query_id", "_s", "_t"], "left").join(F.broadcast(mine("subfield", "_s")), ["query_id", "_s"], "left").join(F.broadcast(mine("topic", "_t")), ["query_id", "_t"], "left")
    pool = pool.withColumn("neighbours", F.coalesce("neighbours", F.lit(0)).cast("int")).withColumn("in_neighbourhood", F.coalesce("_s_in", F.lit(False)) | F.coalesce("_t_in", F.lit(False)))
    # How far a work's mix agrees with the profile, by level.
    pool = pool.join(F.broadcast(wanted), "query_id", "left")
    agree = lambda lv: F.aggregate(F.filter("_mix", lambda m: m["level"] == lv), F.lit(0.0), lambda s, m: s + F.coalesce(m["share"] * F.try_element_at("_profile", m["at"]), F.lit(0.0)))
    pool = pool.withColumns({f"cons_{lv}": agree(lv) for lv in DETAIL_MIX})
    cons = {lv: F.coalesce(f"cons_{lv}", F.lit(0.0)) for lv in DETAIL_MIX}
    detail = blend(*[(w, cons[lv]) for lv, w in DETAIL_MIX.items()])
    pool = pool.withColumn("overlap", (cons["topic"] >= OVERLAP["topic"]) | (cons["subfield"] >= OVERLAP["subfield"]) | ((cons["field"] >= OVERLAP["field"]) & (F.greatest(cons["subfield"], cons["topic"]) >= OVERLAP["field_with"])))
    tests = (_c("neighbours") >= NEIGHBOURS, _c("overlap"), _c("in_neighbourhood"), F.greatest(*cons.values()) >= CONSENSUS, detail >= DETAIL)
    pool = pool.withColumn("signals", sum((t.cast("int") for t in tests), F.lit(0)))
    kind = F.when(_c("signals") >= SIGNALS, "topic_cohesive_candidate").when((_c("signals") == 1) | (_c("neighbours") == 1), "topic_weak_candidate").otherwise("term_only_candidate")
    return pool.withColumn("cohesion", kind).drop("_s", "_t", "_s_in", "_t_in", "_mix", "_profile", *[f"cons_{lv}" for lv in DETAIL_MIX])


# --- competition


def compete(works: DataFrame) -> DataFrame:
    """RUL-09: works with mixed (old score and evidence), and compete, mixed times the factors of guards, cohesion and what is left of the side; factors says which applied.

    works: evidence() and cohesion(), with axes (array of job axes, may be null).
    """
    side = (_c("hit_class") == SINGLE_SIDE) & (_c("mainline") == 0)
    fringe = _c("preview") == "fringe_candidate"
    limited = side & (_c("protected") < FRINGE_LOW) & fringe
    mixed = F.when(limited, MIX_FRINGE[0] * _c("protected") + MIX_FRINGE[1] * _c("evidence")).otherwise(MIX[0] * _c("protected") + MIX[1] * _c("evidence"))
    guard = side & (_c("n") == 1) & fringe
    main = (_c("mainline") >= 1) | (_c("n") >= 2) | ~fringe
    isolated = side & (_c("neighbours") == 0) & (_c("cohesion") == "term_only_candidate")
    keep = ~guard & main
    # Factors in turn: (name, test, factor); of a pair of alternatives the later test excludes the earlier.
    steps: list[tuple[str, Column, Column | float]] = [
        ("fringe_guard", guard, FRINGE_GUARD), ("mainline_bonus", keep, MAINLINE_BONUS), ("isolated_fringe", isolated, ISOLATED),
        ("topic_cohesive_bonus", ~isolated & ~keep & (_c("cohesion") == "topic_cohesive_candidate"), COHESIVE),
    ]
    own = _table(_c("hit_class"), COHESION, 1.0)
    heavy = F.when((_c("hit_class") == SIDE_ONLY) & (_c("mainline") == 0) & (_c("side") >= 2), COHESION_SIDE_HEAVY).otherwise(1.0)
    chance = F.when((_c("hit_class") == SIDE_ONLY) & _c("coherence").contains("accidental"), COHESION_ACCIDENTAL).otherwise(1.0)
    axes = F.when((F.coalesce(F.size("axes"), F.lit(0)) >= 2) & (_c("mainline") >= 1), COHESION_AXES).otherwise(1.0)
    together = clipped(own * heavy * chance * axes, *COHESION_CLIP)
    left = side & fringe & (_c("side") >= 1) & (_c("n") == 1) & (_c("cohesion") == "topic_cohesive_candidate") & _c("overlap")
    rest = F.when((F.coalesce(F.size("axes"), F.lit(0)) == 1) & (F.get("axes", F.lit(0)) == UNCLASSIFIED) | _c("coherence").contains("single support"), RESIDUAL_STRONG).otherwise(RESIDUAL_MILD)
    steps += [("keep_cohesive", together != 1.0, together), ("residual_side", left, rest)]
    value, names = _c("mixed"), []
    for name, test, factor in steps:
        held = F.coalesce(test, F.lit(False))
        value = value * F.when(held, factor).otherwise(1.0)
        names.append(F.when(held, F.lit(name)))
    return works.withColumn("mixed", mixed).withColumn("compete", value).withColumn("factors", F.array_compact(F.array(*names)))


def reselected(works: DataFrame, most: int) -> DataFrame:
    """RUL-09: works with first_rank (by protected, of the first selection), rank (by compete) and moved: kept, in, out or null for works that neither selection of `most` has; and why, for those that moved the factors above and below one that did it (if works have factors)."""
    rows = placed(placed(works, "query_id", _order("protected"), "first_rank"), "query_id", _order("compete"), "rank")
    was, now = _c("first_rank") <= most, _c("rank") <= most
    rows = rows.withColumn("moved", F.when(was & now, "kept").when(now, "in").when(was, "out"))
    return rows.withColumn("why", F.when(_c("moved").isin("in", "out"), F.array_join("factors", ","))) if "factors" in works.columns else rows


def selected(works: DataFrame, most: int) -> DataFrame:
    """RUL-09: the works that the second selection of `most` has, those that reselected() calls kept or in; each partition sends a query's first ones only."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*_order("compete")))
    return works.withColumn("_rank", place).where(_c("_rank") <= most).drop("_rank")


def _order(score: str) -> list[Column]:
    """Nine digits: the order of a sum must not decide a rank."""
    return [F.round(score, 9).desc(), F.col("work_id").asc()]


# --- authors


def broad_dominance(authors: DataFrame, papers: DataFrame, suppressed: DataFrame | None = None) -> DataFrame:
    """RUL-10: a row an author: hit, reason and signals (a map) of whether one broad term of the main line carries the rank, and not an array of axes.

    authors: query_id, author_id, dominant_share, dominant_term, mainline_ratio, strong_terms; papers: query_id, author_id, work_id, score, hit_class, axes, contributions (array of struct<term, value>), an author's best ones.
    An author of the side-driven audit (suppressed: query_id, author_id) isn't looked at again. The nested record of an author has its best papers, some dozens at most.
    """
    keys = ["query_id", "author_id"]
    order = F.struct((-_c("score")).alias("s"), "work_id", "hit_class", F.coalesce("axes", F.array().cast("array<string>")).alias("axes"), "contributions")
    record = papers.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("papers"))
    rows = authors.join(record, keys, "left").withColumn("_top", F.get("papers", 0))
    union = F.array_sort(F.array_distinct(F.flatten(F.transform("papers", lambda p: p["axes"]))))
    rows = rows.withColumn("axis_union", F.coalesce(union, F.array().cast("array<string>")))
    named = F.filter("axis_union", lambda x: x != UNCLASSIFIED)
    thick = F.size(F.filter("axis_union", lambda x: x.isin(*THICK_AXES)))
    # Contributions of terms over all papers, largest first; the share of the second among the first three.
    parts = F.flatten(F.transform("papers", lambda p: p["contributions"]))
    terms = F.array_distinct(F.transform(parts, lambda c: c["term"]))
    total = lambda t: F.aggregate(F.filter(parts, lambda c: c["term"] == t), F.lit(0.0), lambda s, c: s + F.greatest(c["value"], F.lit(0.0)))
    rows = rows.withColumn("_sums", F.slice(F.array_sort(F.transform(terms, lambda t: F.struct((-total(t)).alias("v"), t.alias("t")))), 1, 3))
    first_three = F.aggregate("_sums", F.lit(0.0), lambda s, x: s - x["v"])
    second = F.when((F.size("_sums") >= 2) & (first_three > 0), -F.get("_sums", 1)["v"] / first_three).otherwise(0.0)
    multi_paper = F.exists("papers", lambda p: F.size(p["contributions"]) >= 2)
    rows = rows.withColumn("second_share", F.coalesce(second, F.lit(0.0)))
    several = (thick >= 2) | ((thick >= 1) & (F.size(named) >= 2)) | (_c("second_share") >= SECOND_SHARE) | (or_zero(_c("mainline_ratio")) >= MAINLINE_SHARE) | (multi_paper & (F.coalesce("strong_terms", F.lit(0)) >= 2))
    own = F.filter(_c("_top.axes"), lambda x: x != UNCLASSIFIED)
    shell = (
        F.when(_c("_top").isNull(), False)
        .when(F.size("_top.axes") == 0, _c("_top.hit_class").isin(*MAINLINE_CLASSES))
        .when(F.size(own) == 0, True)
        .when(F.exists(own, lambda x: x.isin(*THICK_AXES)), False)
        .otherwise(F.forall(own, lambda x: x.isin(*BROAD_AXES)) | F.array_contains(own, BROAD_AXES[1]))
    )
    rows = rows.withColumn("_several", F.coalesce(several, F.lit(False))).withColumn("_shell", F.coalesce(shell, F.lit(False)))
    if suppressed is not None:
        rows = rows.join(suppressed.select(*keys).distinct().withColumn("_done", F.lit(True)), keys, "left")
    else:
        rows = rows.withColumn("_done", F.lit(False))
    verdict = judged(
        [
            Test("skipped_overlaps_side_driven_suppression_audit", _c("_done"), "no"),
            Test("dom_share_below_threshold", _c("dominant_share").isNull() | (_c("dominant_share") < DOMINANT), "no"),
            Test("multi_axis_strength_excluded", _c("_several"), "no"),
            Test("top_paper_single_hit_side_excluded", _c("_top.hit_class") == SINGLE_SIDE, "no"),
            Test("top_paper_not_broad_shell_profile", ~_c("_shell"), "no"),
        ],
        "yes", "broad_mainline_dominance_hit",
    )
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    signals = F.create_map(
        F.lit("dominant_term"), text(_c("dominant_term")), F.lit("axis_union"), F.array_join("axis_union", ","), F.lit("multi_axis"), text(_c("_several")), F.lit("second_term_share"), text(F.round("second_share", 6)),
        F.lit("top_paper"), text(_c("_top.work_id")), F.lit("top_paper_class"), text(_c("_top.hit_class")), F.lit("papers"), text(F.coalesce(F.size("papers"), F.lit(0))),
    )
    return rows.withColumn("_v", verdict).select(*keys, (_c("_v.outcome") == "yes").alias("hit"), F.col("_v.reason").alias("reason"), signals.alias("signals"))
