"""Buckets, landings and seeds on small pools whose outcome was read off the rules by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cascade, landing, seeds

POOL = (
    "query_id long, anchor_id long, cand long, term string, sources array<string>, static double, cond double, align double, identity double, family double, context double, hier double, supported boolean, "
    "generic double, polysemy double, object double, support int, family_type string, shifted boolean, generic_like boolean, gap double, retain string, score double"
)
BOTH = ["similar_to", "conditioned_vec"]
SOLID = {
    "query_id": 1, "term": "motion planning", "sources": BOTH, "static": 0.9, "cond": 0.88, "align": 0.8, "identity": 0.7, "family": 0.7, "context": 0.7, "hier": 0.7, "supported": True,
    "generic": 0.1, "polysemy": 0.1, "object": 0.05, "support": 1, "family_type": None, "shifted": False, "generic_like": False, "gap": 0.0, "retain": "normal", "score": 0.9,
}
KEEP = {**SOLID, "identity": 0.35, "family": 0.35, "align": 0.6}
RISKY = {**SOLID, "sources": ["similar_to"], "cond": None}
HEARD = {**SOLID, "sources": ["conditioned_vec"], "static": 0.0}
FAILED = {**RISKY, "static": 0.3, "identity": 0.3, "family": 0.3, "align": 0.6, "context": 0.4, "hier": 0.3}
TIED = {**SOLID, "identity": 0.41, "family": 0.30}
MAIN, AUX = "main_strong_process", "aux_weak_process"

#: name: mode and strength of the anchor, its candidates, then bucket and reason of each, state and reason of the landing.
SCENES = {
    "solid": (MAIN, 0.5, [SOLID], [("primary_expandable", "axis_strong_mainline")], "good_landing", "main_strong_normal_retrieval_top1_ok"),
    "solid, minor anchor": (AUX, 0.5, [SOLID], [("primary_support_keep", "weak_landing_demoted_from_expandable_or_seed")], "weak_landing", "aux_weak_seedish_not_main_strong"),
    "turned away": (MAIN, 0.5, [{**SOLID, "retain": "reject"}], [("reject", "retain_mode_reject")], "empty_landing", "no_kept_candidates_after_select"),
    "management": (MAIN, 1.0, [{**SOLID, "term": "control (Management)"}], [("reject", "obviously_bad_branch")], "empty_landing", "no_kept_candidates_after_select"),
    "other sense": (MAIN, 0.5, [{**SOLID, "polysemy": 0.6, "context": 0.4}], [("reject", "polysemous_no_context")], "empty_landing", "no_kept_candidates_after_select"),
    "other sense, context": (MAIN, 0.5, [{**SOLID, "polysemy": 0.6}], [("reject", "object_or_poly_bad")], "empty_landing", "no_kept_candidates_after_select"),
    "family only": (MAIN, 0.5, [{**SOLID, "sources": ["family_landing"], "cond": None, "support": 2}], [("primary_support_keep", "weak_seed_requires_similar_to")], "fallback_only_landing", "family_fallback_only_no_normal_retrieval"),
    "context only": (MAIN, 0.5, [HEARD], [("primary_support_keep", "axis_weak_or_conditioned_only")], "weak_landing", "conditioned_only_weak_grounding_pool"),
    "quotas": (
        MAIN, 0.5, [{**KEEP, "score": s} for s in (0.9, 0.8, 0.7, 0.6)],
        [("primary_support_seed", "no_expandable_and_no_seed_promote_keep_top1"), ("primary_support_keep", "axis_keep_no_expand"), ("dropped", "quota"), ("dropped", "quota")],
        "good_landing", "main_strong_normal_retrieval_top1_ok",
    ),
    "fragment": (
        MAIN, 0.5, [{**RISKY, "term": "Control", "score": 0.9}, {**RISKY, "term": "control theory", "score": 0.2}],
        [("dropped", "quota"), ("primary_support_keep", "promoted_risky_top1_to_support_keep")], "good_landing", "main_strong_normal_retrieval_top1_ok",
    ),
    "risky": (MAIN, 0.5, [{**RISKY, "align": 0.6}], [("risky_keep", "weak_line_not_primary")], "weak_landing", "risky_only_keep"),
    "risky, minor anchor": (AUX, 0.5, [RISKY], [("risky_keep", "weak_line_not_primary")], "weak_landing", "aux_weak_risky_only"),
    "rescued": (MAIN, 0.9, [FAILED, {**FAILED, "family": 0.31}], [("reject", "not_primary_enough"), ("primary_support_keep", "anchor_core_fallback")], "weak_landing", "support_keep_only"),
    "not rescued": (MAIN, 0.8, [FAILED], [("reject", "not_primary_enough")], "empty_landing", "no_kept_candidates_after_select"),
    "bridge": (MAIN, 0.5, [{**SOLID, "static": 0.8, "cond": 0.7, "identity": 0.41, "generic": 0.45, "family_type": "shifted"}], [("primary_support_seed", "weak_landing_seed_bridge")], "weak_landing", "support_keep_only"),
    "no clear first": (
        MAIN, 0.5, [TIED, TIED], [("primary_support_keep", "keep_promote_blocked_group_axis_gap_too_small"), ("primary_support_keep", "keep_promote_blocked_not_group_top1")],
        "good_landing", "main_strong_normal_retrieval_top1_ok",
    ),
    "many by context": (
        MAIN, 0.5, [SOLID, HEARD, {**HEARD, "generic": 0.05}, {**HEARD, "generic": 0.2}],
        [("primary_expandable", "axis_strong_mainline"), ("primary_support_keep", "axis_weak_or_conditioned_only"), ("primary_support_keep", "axis_weak_or_conditioned_only"), ("dropped", "conditioned_quota")],
        "good_landing", "main_strong_normal_retrieval_top1_ok",
    ),
}


@pytest.fixture(scope="module")
def selected(spark):
    names = [f.split()[0] for f in POOL.split(", ")]
    rows = [tuple({**c, "anchor_id": k, "cand": i}[n] for n in names) for k, s in enumerate(SCENES.values()) for i, c in enumerate(s[2])]
    anchors = [(1, k, s[0], s[1]) for k, s in enumerate(SCENES.values())] + [(1, 999, MAIN, 1.0)]
    pool = spark.createDataFrame(rows, POOL)
    out = landing.selected(pool, spark.createDataFrame(anchors, "query_id long, anchor_id long, mode string, strength double")).collect()
    assert len(out) == len(rows) + 1
    return out


@pytest.mark.parametrize("name", SCENES)
def test_scene(selected, name):
    _, _, candidates, want, state, why = SCENES[name]
    mine = sorted((r for r in selected if r.anchor_id == list(SCENES).index(name)), key=lambda r: r.cand)
    assert [(r.bucket, r.reason) for r in mine] == want
    assert {(r.landing_state, r.landing_reason) for r in mine} == {(state, why)}
    assert {r.landing_kept for r in mine} == {sum(b in landing.KEPT for b, _ in want)}
    for r in mine:
        assert r.can_expand == (r.bucket in ("primary_expandable", "primary_support_seed"))
        assert r.tier == {"primary_expandable": "strong", "primary_support_seed": "weak"}.get(r.bucket, "none")
        assert r.layer == {"primary_expandable": "candidate_core", "primary_support_seed": "candidate_support", "primary_support_keep": "candidate_support"}.get(r.bucket, "candidate_noise")


def test_anchor_without_candidates(selected):
    (r,) = [r for r in selected if r.anchor_id == 999]
    assert (r.cand, r.landing_state, r.landing_reason, r.landing_kept) == (None, "empty_landing", "no_candidates_generated", 0)


def test_selection_needs_one_shuffle_of_the_pool(spark):
    names = [f.split()[0] for f in POOL.split(", ")]
    pool = spark.createDataFrame([tuple({**SOLID, "anchor_id": 1, "cand": 1}[n] for n in names)], POOL)
    anchors = spark.createDataFrame([(1, 1, MAIN, 1.0)], "query_id long, anchor_id long, mode string, strength double")
    chosen = landing._closed(landing._state(landing._seeded(landing._limited(landing._settled(landing._ranked(landing.bucketed(pool).join(F.broadcast(anchors), landing.KEYS)))))))
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(query_id") == 1


def test_null_features_count_as_none(spark):
    names = [f.split()[0] for f in POOL.split(", ")]
    empty = dict.fromkeys(names) | {"query_id": 1, "anchor_id": 1, "cand": 1, "sources": []}
    pool = spark.createDataFrame([tuple(empty[n] for n in names)], POOL)
    (r,) = landing.selected(pool, spark.createDataFrame([(1, 1, MAIN, 1.0)], "query_id long, anchor_id long, mode string, strength double")).collect()
    assert (r.bucket, r.reason, r.landing_state) == ("reject", "obviously_bad_branch", "empty_landing")


def test_first_test_decides_and_the_trace_is_kept(spark):
    x = F.col("id")
    got = spark.range(4).select(cascade.judged([cascade.Test("a", x == 0, "A"), cascade.Test("null", F.lit(None).cast("boolean"), "N"), cascade.Test("b", x <= 1, "B"), cascade.Test("c", x <= 2, "C")], "none", "rest").alias("j")).collect()
    assert [tuple(r.j) for r in got] == [("A", "a", []), ("B", "b", ["a", "null"]), ("C", "c", ["a", "null", "b"]), ("none", "rest", ["a", "null", "b", "c"])]
    shut = spark.range(3).select(cascade.first_block([("low", x >= 1), ("odd", F.when(x == 2, True))]).alias("b")).collect()
    assert [r.b for r in shut] == ["low", "odd", None]


def test_relative_scores(spark):
    rows = [(1, 1, 1, 0.5, 0.1), (1, 1, 2, 0.9, 0.3), (1, 1, 3, None, 0.2), (1, 2, 1, 0.4, None)]
    df = landing.relative_scores(spark.createDataFrame(rows, "query_id int, anchor_id int, cand int, s double, r double"), ["s"], ["r"])
    assert [(r.rank_s, r.rank_r, r.composite) for r in df.orderBy("anchor_id", "cand").collect()] == [(0.5, 1.0, 0.75), (1.0, 0.0, 0.5), (0.0, 0.5, 0.25), (1.0, 1.0, 1.0)]


@pytest.mark.parametrize(("term", "want"), [("control", 0.685), ("motion planning", 1.0), ("a b c d e", 0.804), ("h2o", 0.61), ("x_y", 0.61), ("f(x) y", 0.955), ("12", 0.0), ("", 0.0), (None, 0.0)])
def test_naturalness(spark, term, want):
    assert spark.createDataFrame([(term,)], "t string").select(landing.naturalness(F.col("t")).alias("n")).first().n == pytest.approx(want)


SEED = {**SOLID, "anchor_id": 1, "anchor_term": "robot control", "pref": 0.6, "gain": 0.0, "tier": "strong", "can_expand": True, "fallback": False, "bridge": False, "mode": MAIN}
#: Changes of a strong seed, and the verdict.
VERDICTS = [
    ({}, "eligible", "strong"),
    ({"fallback": True}, "blocked", "fallback_primary_no_expand"),
    ({"tier": "none"}, "blocked", "stage2a_not_seed"),
    ({"anchor_term": "Dynamics", "term": "jet Propulsion"}, "blocked", "semantic_mismatch_seed"),
    ({"anchor_term": "强化学习", "term": "Q-learning"}, "blocked", "semantic_mismatch_seed"),
    ({"anchor_term": "强化学习", "term": "deep Q-learning"}, "eligible", "strong"),
    ({"can_expand": False}, "blocked", "blocked_by_2a"),
    ({"score": 0.1, "identity": 0.3, "static": 0.0, "gain": -0.2}, "blocked", "strong_seed_score_low"),
    ({"identity": 0.2, "family": 0.2, "pref": 0.0}, "blocked", "strong_seed_axis_low"),
    ({"tier": "weak"}, "eligible", "weak_default_axis_0p50"),
    ({"tier": "weak", "score": 0.2, "identity": 0.5}, "blocked", "weak_seed_score_low"),
    ({"tier": "weak", "mode": "aux_weak_process"}, "blocked", "aux_weak_weak_seed_not_eligible"),
    ({"tier": "weak", "identity": 0.4, "family": 0.35, "pref": 0.3}, "blocked", "weak_seed_axis_low"),
    ({"tier": "weak", "identity": 0.4, "family": 0.35, "pref": 0.3, "bridge": True}, "eligible", "weak_bridge_main_strong_dual_axis_aligned"),
    ({"tier": "weak", "generic": 0.55}, "blocked", "weak_seed_risk_high"),
    ({"tier": "other"}, "blocked", "tier_none"),
]


def test_seed_verdicts(spark):
    columns = list(SEED)
    schema = POOL.replace(", score double", ", score double, anchor_term string, pref double, gain double, tier string, can_expand boolean, fallback boolean, bridge boolean, mode string")
    names = [f.split()[0] for f in schema.split(", ")]
    assert set(names) == {*columns, "cand"}
    rows = [tuple({**SEED, **change, "cand": k}[n] for n in names) for k, (change, _, _) in enumerate(VERDICTS)]
    got = {r.cand: (r.verdict.outcome, r.verdict.reason) for r in seeds.eligible(spark.createDataFrame(rows, schema)).collect()}
    assert [got[k] for k in range(len(VERDICTS))] == [v[1:] for v in VERDICTS]


EDGES = "query_id long, cand long, target long, freq long, landed boolean, in_domain boolean, domain_fit double, primary double, anchor double, context double, family_support double, identity double, span int"
OPEN = {"query_id": 1, "cand": 1, "target": 50, "freq": 4, "landed": False, "in_domain": True, "domain_fit": 0.9, "primary": 0.9, "anchor": 0.9, "context": 0.9, "family_support": 0.9, "identity": 0.5, "span": 3}
GATES = [
    ({}, None), ({"anchor": None, "context": None, "family_support": None}, None), ({"target": 1}, "retrieval_empty_or_self"), ({"target": None}, "retrieval_empty_or_self"), ({"landed": True}, "duplicate_or_in_carryover"),
    ({"freq": 2}, "freq_below_min"), ({"in_domain": False}, "no_domain_or_topic_fit"), ({"domain_fit": 0.7}, "domain_fit_too_low"), ({"domain_fit": None}, "domain_fit_too_low"), ({"primary": None}, "missing_candidate_vec"),
    ({"primary": 0.7}, "low_primary_consistency"), ({"anchor": 0.69}, "low_anchor_consistency"), ({"context": 0.7}, "low_context_stability"), ({"family_support": 0.6}, "low_family_support"), ({"identity": 0.1}, "low_anchor_identity_support"),
    ({"primary": 0.73, "anchor": 0.71, "context": 0.73, "family_support": 0.69, "identity": 0.2}, "keep_score_too_low"), ({"span": 25}, "domain_span_extreme"), ({"freq": 1, "span": 99}, "freq_below_min"),
]


def test_edge_gates(spark):
    names = [f.split()[0] for f in EDGES.split(", ")]
    rows = [tuple({**OPEN, "query_id": k, **change}[n] for n in names) for k, (change, _) in enumerate(GATES)]
    got = {r.query_id: r.block for r in seeds.gated(spark.createDataFrame(rows, EDGES)).collect()}
    assert [got[k] for k in range(len(GATES))] == [b for _, b in GATES]


@pytest.mark.parametrize("backers", [1, 2])
def test_admission_is_greedy_in_order_of_seeds(spark, backers):
    rng = random.Random(7)
    names = [f.split()[0] for f in EDGES.split(", ")]
    edges = {(q, s, t): rng.randint(1, 9) for q in range(4) for s in range(6) for t in rng.sample(range(100, 112), rng.randint(0, 9))}
    strong = [(q, s, rng.choice([0.7, 0.8, 0.9, 0.6]), 0.9, 2, rng.choice(["normal", "normal", "weak_retain"])) for q in range(4) for s in range(6)]
    want = {}
    for q in range(4):
        held = {t: sum((q, s, t) in edges and edges[q, s, t] >= 3 for s in range(6)) for t in range(100, 112)}
        taken = set()
        for _, s, *_ in sorted((r for r in strong if r[0] == q and r[5] == "normal" and r[2] >= 0.7), key=lambda r: (-r[2], r[1])):
            mine = 0
            for f, t in sorted((-f, t) for (p, u, t), f in edges.items() if (p, u) == (q, s)):
                if t in taken:
                    want[q, s, t] = "duplicate_or_in_carryover"
                elif -f < 3:
                    want[q, s, t] = "freq_below_min"
                elif held[t] < backers:
                    want[q, s, t] = "too_few_seeds"
                elif mine == 2:
                    want[q, s, t] = "max_keep_reached"
                else:
                    want[q, s, t] = None
                    mine += 1
            taken |= {t for t in range(100, 112) if want.get((q, s, t), "") is None}
    rows = [tuple({**OPEN, "query_id": q, "cand": s, "target": t, "freq": f}[n] for n in names) for (q, s, t), f in edges.items()]
    found = seeds.admitted(seeds.gated(spark.createDataFrame(rows, EDGES)), spark.createDataFrame(strong, "query_id long, cand long, score double, align double, support int, retain string"), backers)
    assert {(r.query_id, r.cand, r.target): r.block for r in found.collect()} == want
    assert sum(r.n for r in seeds.blocks(found).collect()) == len(want)


def test_family_support(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.7), (2, 0.5), (3, -0.4)], "t int, sim double")
    assert {r.t: r.family_support for r in seeds.family_support(df, "t").collect()} == pytest.approx({1: 0.75, 2: 0.5, 3: 0.0})
