"""From landed candidates to seeds, and from seeds to the terms that co-occur with them (RUL-06).

A seed passes an ordered table of tests; an edge from a seed to a co-occurring term passes a chain of gates, and the first
that is shut stays on its row. Admission is greedy in the order of seeds: each takes its two best open edges whose target
nobody took before. As a seed can lose two targets at most to each seed before it, the first 2 i edges of the i-th seed
decide, so a query's admission runs over an array whose size its seeds bound, not the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import blend, clipped
from .cascade import Test, first_block, judged
from .landing import MAIN

# Thresholds of seeds.
SCORE_STRONG, SCORE_WEAK, AXIS_STRONG, AXIS_WEAK = 0.50, 0.54, 0.45, 0.50
BRIDGE_SCORE, BRIDGE_AXIS, SOFT = 0.62, 0.43, 0.12
GAIN_STEPS = ((0.03, 0.05), (0.0, 0.02), (-0.05, -0.01), (-0.10, -0.03))
GAIN_REST = -0.06
RISKS = {"generic": 0.55, "polysemy": 0.35, "object": 0.25}
#: Words of an anchor, and words of a term that mean something else beside them.
MISMATCHES = (
    (("动力学", "dynamics"), ("propulsion", "propulsor")),
    (("抓取", "grasping", "manipulation"), ("retrieval", "crawler", "crawling")),
    (("端到端", "end-to-end"), ("principle", "delay", "point-to-point", "end point")),
)
#: Anchors whose very own method is no seed.
OWN_METHODS = ((("强化学习", "reinforcement learning"), ("q-learning",)),)
# Of strong seeds and of edges.
STRONG = {"score": 0.70, "align": 0.82, "support": 2}
EDGE = {"freq": 3, "domain_fit": 0.75, "span": 24, "primary": 0.72, "anchor": 0.70, "context": 0.72, "family": 0.68, "identity": 0.16, "keep": 0.76}
PER_SEED = 2


def _c(name: str) -> Column:
    return F.col(name)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def mismatch(anchor: Column, term: Column) -> Column:
    """Whether the term means something else than its anchor, by words of both."""
    a, t = (F.lower(F.trim(F.coalesce(x, F.lit("")))) for x in (anchor, term))
    some = lambda x, words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(x, w))
    out = F.lit(False)
    for of, words in MISMATCHES:
        out = out | (some(a, of) & some(t, words))
    for of, words in OWN_METHODS:
        out = out | (some(a, of) & t.isin(*words))
    return out


def seed_scores(seeds: DataFrame) -> DataFrame:
    """seeds with seed_score and seed_axis. A weak seed that only the context found counts SOFT less."""
    gain = F.lit(GAIN_REST)
    for least, bonus in reversed(GAIN_STEPS):
        gain = F.when(_zero("gain") >= least, bonus).otherwise(gain)
    raw = blend((0.45, _c("score")), (0.25, _c("identity")), (0.20, _c("align")), (0.10, clipped(_zero("static"), 0.0, 1.0))) + gain
    alone = F.array_contains("sources", "conditioned_vec") & ~F.array_contains("sources", "similar_to") & ~F.array_contains("sources", "family_landing")
    soft = F.when(alone & (_c("tier") == "weak"), SOFT).otherwise(0.0)
    family = F.when(_zero("family") > 0, _zero("family")).otherwise(_zero("identity"))
    out = seeds.withColumn("alone", alone).withColumn("seed_score", F.greatest(F.lit(0.0), clipped(raw, 0.0, 1.0) - soft))
    return out.withColumn("seed_axis", blend((0.35, _c("identity")), (0.30, family), (0.20, _c("align")), (0.15, F.greatest(F.lit(0.0), _zero("pref")))))


def seed_tests() -> list[Test]:
    strong, weak = _c("tier") == "strong", _c("tier") == "weak"
    dual = F.array_contains("sources", "similar_to") & _c("cond").isNotNull()
    like = F.array_contains("sources", "similar_to") | F.array_contains("sources", "family_landing")
    bridge = _c("bridge") & ~_c("alone") & (_c("mode") == MAIN) & dual & like & (_c("seed_score") >= BRIDGE_SCORE) & _c("seed_axis").between(BRIDGE_AXIS, AXIS_WEAK)
    risky = F.lit(False)
    for name, most in RISKS.items():
        risky = risky | (_zero(name) >= most)
    return [
        Test("fallback_primary_no_expand", _c("fallback"), "blocked"),
        Test("stage2a_not_seed", _c("tier") == "none", "blocked"),
        Test("semantic_mismatch_seed", mismatch(_c("anchor_term"), _c("term")), "blocked"),
        Test("blocked_by_2a", ~F.coalesce(_c("can_expand"), F.lit(False)), "blocked"),
        Test("strong_seed_score_low", strong & (_c("seed_score") < SCORE_STRONG), "blocked"),
        Test("strong_seed_axis_low", strong & (_c("seed_axis") < AXIS_STRONG), "blocked"),
        Test("strong", strong, "eligible"),
        Test("weak_seed_score_low", weak & (_c("seed_score") < SCORE_WEAK), "blocked"),
        Test("aux_weak_weak_seed_not_eligible", weak & (_c("mode") == "aux_weak_process"), "blocked"),
        Test("weak_seed_axis_low", weak & (_c("seed_axis") < AXIS_WEAK) & ~F.coalesce(bridge, F.lit(False)), "blocked"),
        Test("weak_seed_risk_high", weak & risky, "blocked"),
        Test("weak_bridge_main_strong_dual_axis_aligned", weak & bridge, "eligible"),
        Test("weak_default_axis_0p50", weak, "eligible"),
    ]


def eligible(seeds: DataFrame) -> DataFrame:
    """RUL-06: seeds with seed_score, seed_axis and verdict (eligible or blocked, the reason, the tests passed).

    seeds: query_id, anchor_id, cand, term, anchor_term, sources, static, cond, score, identity, align, family, pref, gain, generic, polysemy, object, tier, can_expand, fallback, bridge, mode.
    """
    return seed_scores(seeds).withColumn("verdict", judged(seed_tests(), "blocked", "tier_none"))


def family_support(pairs: DataFrame, *keys: str) -> DataFrame:
    """VEC-12: keys, family_support: how far a term is backed by all members of its anchor's family: mean similarity, less a quarter of its spread, in 0..1. pairs: keys and sim, a row for each member."""
    spread = F.max("sim") - F.min("sim")
    return pairs.groupBy(*keys).agg(clipped(F.avg("sim") - 0.25 * spread, 0.0, 1.0).alias("family_support"))


def keep_score(edges: DataFrame) -> DataFrame:
    """edges with keep: how well a term fits its seed, its anchor, their context and family. What an anchor doesn't have (null) counts 1."""
    one = lambda name: F.coalesce(F.col(name).cast("double"), F.lit(1.0))
    drift = F.greatest(F.lit(0.0), _c("primary") - one("family_support"))
    return edges.withColumn("keep", 0.26 * _c("primary") + 0.26 * one("anchor") + 0.22 * one("context") + 0.16 * one("family_support") + 0.10 * _c("identity") - 0.18 * drift)


def edge_gates() -> list[tuple[str, Column]]:
    """The gates of an edge in order; each says what must hold. Similarities that an anchor doesn't have are null and let the edge through."""
    least = lambda name, x: F.col(name).isNull() | (F.col(name) >= x)
    return [
        ("retrieval_empty_or_self", _c("target").isNotNull() & ~_c("target").eqNullSafe(_c("cand"))),
        ("duplicate_or_in_carryover", ~_c("landed")),
        ("freq_below_min", _c("freq") >= EDGE["freq"]),
        ("no_domain_or_topic_fit", _c("in_domain")),
        ("domain_fit_too_low", _c("domain_fit") >= EDGE["domain_fit"]),
        ("missing_candidate_vec", _c("primary").isNotNull()),
        ("low_primary_consistency", _c("primary") >= EDGE["primary"]),
        ("low_anchor_consistency", least("anchor", EDGE["anchor"])),
        ("low_context_stability", least("context", EDGE["context"])),
        ("low_family_support", least("family_support", EDGE["family"])),
        ("low_anchor_identity_support", _c("identity") >= EDGE["identity"]),
        ("keep_score_too_low", _c("keep") >= EDGE["keep"]),
        ("domain_span_extreme", F.coalesce(_c("span"), F.lit(0)) <= EDGE["span"]),
    ]


def gated(edges: DataFrame) -> DataFrame:
    """RUL-06: edges with keep, block (the first gate that is shut, null if none) and backers, how many of its query's seeds have an open edge to the target.

    edges: query_id, cand (the seed), target, freq, landed, in_domain, domain_fit, primary, anchor, context, family_support, identity, span.
    """
    rows = keep_score(edges).withColumn("block", first_block(edge_gates()))
    return rows.withColumn("backers", F.count_if(_c("block").isNull()).over(Window.partitionBy("query_id", "target")))


def admitted(edges: DataFrame, seeds: DataFrame, backers: int = 1, per_seed: int = PER_SEED) -> DataFrame:
    """RUL-06: gated edges of strong seeds with the last gates: too_few_seeds, duplicate_or_in_carryover (an earlier seed took the target), max_keep_reached; strength is min(1, freq / 5).

    seeds: query_id, cand, score, align, support, retain: those of normal admission, score 0.70, alignment 0.82 and two anchors or more are strong, in order of score.
    """
    strong = seeds.where((_c("retain") == "normal") & (_c("score") >= STRONG["score"]) & (_c("align") >= STRONG["align"]) & (_c("support") >= STRONG["support"]))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "cand"))
    strong = strong.groupBy("query_id", "cand").agg(F.max("score").alias("score")).withColumn("place", place).select("query_id", "cand", "place")
    rows = edges.join(strong, ["query_id", "cand"]).withColumn("block", F.when(_c("block").isNull() & (_c("backers") < backers), "too_few_seeds").otherwise(_c("block")))
    best = F.row_number().over(Window.partitionBy("query_id", "cand").orderBy(F.desc("freq"), "target"))
    able = rows.where("block is null").withColumn("_r", best).where(_c("_r") <= per_seed * _c("place"))
    each = able.groupBy("query_id", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "target"))), lambda e: e["target"]).alias("targets"))
    turns = each.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "targets"))).alias("turns"))
    nothing = F.expr("cast(array() as array<struct<place:int, target:bigint>>)")

    def turn(taken: Column, t: Column) -> Column:
        free = F.filter(t["targets"], lambda x: ~F.exists(taken, lambda y: y["target"] == x))
        return F.concat(taken, F.transform(F.slice(free, 1, per_seed), lambda x: F.struct(t["place"].alias("place"), x.cast("bigint").alias("target"))))

    taken = turns.select("query_id", F.explode(F.aggregate("turns", nothing, turn)).alias("t")).select("query_id", F.col("t.target").alias("target"), F.col("t.place").alias("by"))
    out = rows.join(taken, ["query_id", "target"], "left")
    own = _c("by") == _c("place")
    block = F.when(_c("by") < _c("place"), "duplicate_or_in_carryover").when(_c("block").isNotNull(), _c("block")).when(~F.coalesce(own, F.lit(False)), "max_keep_reached")
    return out.withColumn("block", block).withColumn("strength", F.least(F.lit(1.0), _c("freq") / 5.0)).drop("by")


def blocks(edges: DataFrame) -> DataFrame:
    """query_id, block, n: how many edges each gate stopped; admitted ones under 'kept'."""
    return edges.groupBy("query_id", F.coalesce("block", F.lit("kept")).alias("block")).agg(F.count(F.lit(1)).alias("n"))
