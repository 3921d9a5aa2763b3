"""Hit quality, evidence, cohesion, competition and broad dominance on small pools whose outcome was worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import papers, rules, vectors

HITS = "query_id int, work_id int, term string, mainline boolean, parent string, family string, grounding double, align double"


def test_hit_quality(spark):
    rows = [
        (1, 1, "a", True, "p", "f", 0.4, 0.8),
        (1, 2, "b", False, "p", "f", 0.1, None),
        (1, 3, "a", True, "p", "f", 0.2, 0.8), (1, 3, "c", True, "q", "f", 0.5, 0.6),
        (1, 4, "a", True, "p", "f", 0.2, 0.8), (1, 4, "b", False, "q", "g", 0.1, 0.4),
        (1, 5, "b", False, " P ", None, None, None), (1, 5, "d", False, "p", "", 0.3, 0.2),
        (1, 6, "b", False, "p", "f", 0.1, 0.1), (1, 6, "d", False, "q", "f", 0.1, 0.3),
        (1, 7, "b", None, None, None, None, None), (1, 7, "d", False, "p", None, 0.1, 0.3),
    ]
    got = {r.work_id: (r.n, r.mainline, r.side, r.hit_class, r.strength, r.families, r.grounding, r.align) for r in papers.hit_quality(spark.createDataFrame(rows, HITS)).collect()}
    assert got[1] == (1, 1, 0, papers.SINGLE_MAIN, 0, "single_hit", 0.4, 0.8)
    assert got[2] == (1, 0, 1, papers.SINGLE_SIDE, 0, "single_hit", 0.1, None)
    assert got[3][:6] == (2, 2, 0, papers.RESONANCE, 2, "same_family") and got[3][7] == pytest.approx(0.7)
    assert got[4][:6] == (2, 1, 1, papers.SUPPORTED, 2, "cross_family")
    assert got[5] == (2, 1, 1, papers.SUPPORTED, 2, "mixed_or_unknown", 0.3, 0.2)
    assert got[6][:6] == (2, 0, 2, papers.SIDE_ONLY, 1, "same_family")
    assert got[7][:6] == (2, 0, 2, papers.SIDE_ONLY, 1, "mixed_or_unknown")


WORKS = "query_id int, work_id int, n int, mainline int, side int, hit_class string, coherence string, strength int, families string, grounding double, align double, terms array<string>, score double, hierarchy double, axes array<string>"
GOOD = (2, 2, 0, papers.RESONANCE, "two or more mainline-like hits", 2, "same_family", 0.4, 0.8, ["a", "b"])
LONE = (1, 0, 1, papers.SINGLE_SIDE, "single support/side hit", 0, "single_hit", 0.1, 0.9, ["robot arm"])
PAIR = (2, 0, 2, papers.SIDE_ONLY, "multi-hit with no mainline-like term (accidental/side-heavy)", 1, "same_family", 0.3, None, ["x", "y"])


def test_evidence(spark):
    rows = [(1, 1, *GOOD, 1.0, 1.0, None), (1, 2, *LONE, 1.0, None, None), (1, 3, *PAIR, 1.0, None, None)]
    got = {r.work_id: r for r in papers.evidence(spark.createDataFrame(rows, WORKS)).collect()}
    assert got[1].evidence == pytest.approx(0.42 * 0.9 + 0.22 * 0.4 + 0.18 * 0.8 + 0.08 * 0.18 / 0.33 + 0.06 + 0.04 + 0.03)
    assert got[1].preview == "primary_candidate" and got[1].protection == pytest.approx(1.08)
    assert got[2].evidence == pytest.approx(0.42 * 0.3 + 0.22 * 0.1 + 0.18 * (0.35 * 0.9 + 0.325) + 0.04 - 0.10 - 0.08)
    assert got[2].preview == "fringe_candidate" and got[2].protection == pytest.approx(1 - 0.038 - 0.022 - 0.032 - 0.018)
    assert got[3].evidence == pytest.approx(0.42 * 0.4 + 0.22 * 0.3 + 0.18 * 0.55 + 0.04 + 0.04 - 0.10)
    assert got[3].protection == pytest.approx(1 - 0.048 - 0.022)
    assert all(r.protected == pytest.approx(r.reranked * r.protection) for r in got.values())


def test_cohesion_counts_neighbours_without_pairs(spark):
    rows = [(1, k, *GOOD, 1.0, None, None) for k in range(1, 7)] + [(2, 9, *GOOD, 1.0, None, None), (2, 10, *GOOD, 1.0, None, None)]
    mixes = [(1, k, lv, key, 1.0) for k in range(1, 6) for lv, key in (("topic", "t1"), ("subfield", "s1"), ("field", "f1"))] + [(1, 6, "topic", "t9", 0.6), (1, 6, "topic", "t1", 0.4), (1, 6, "subfield", "s9", 1.0), (2, 9, "topic", "t1", 1.0), (2, 9, "subfield", "s1", 1.0)]
    profile = [(1, "topic", "t1", 0.03), (1, "topic", "t9", 0.01), (1, "subfield", "s1", 0.01), (1, "field", "f1", 0.2), (2, "topic", "t5", 1.0)]
    got = papers.cohesion(
        spark.createDataFrame(rows, WORKS), spark.createDataFrame(mixes, "query_id int, work_id int, level string, key string, share double"),
        spark.createDataFrame(profile, "query_id int, level string, key string, share double"),
    )
    out = {(r.query_id, r.work_id): (r.neighbours, r.in_neighbourhood, r.overlap, r.signals, r.cohesion) for r in got.collect()}
    assert len(out) == 8
    # Overlap by the field's 0.2 with a topic of 0.03; consensus 0.2; detail 0.22 * 0.2 + 0.38 * 0.01 + 0.4 * 0.03 = 0.06.
    assert all(out[1, k] == (4, True, True, 5, "topic_cohesive_candidate") for k in range(1, 6))
    # Its topic is among the profile's first four; agreement 0.6 * 0.01 + 0.4 * 0.03 is too low for anything else.
    assert out[1, 6] == (0, True, False, 1, "topic_weak_candidate")
    assert out[2, 9] == out[2, 10] == (0, False, False, 0, "term_only_candidate")


def test_competition_and_second_selection(spark):
    base = WORKS + ", evidence double, preview string, protected double, neighbours int, cohesion string, overlap boolean"
    tail = lambda ev, preview, old, near, kind, over: (1.0, None, ["a", "b"], ev, preview, old, near, kind, over)
    rows = [
        (1, 1, *GOOD, *tail(0.8, "primary_candidate", 0.5, 3, "topic_cohesive_candidate", True)),
        (1, 2, *LONE, *tail(0.2, "fringe_candidate", 0.6, 0, "term_only_candidate", False)),
        (1, 3, *PAIR, *tail(0.3, "fringe_candidate", 0.4, 2, "topic_cohesive_candidate", True)),
        (1, 4, *LONE, *tail(0.2, "fringe_candidate", 0.02, 2, "topic_cohesive_candidate", True)),
    ]
    got = {r.work_id: r for r in papers.reselected(papers.compete(spark.createDataFrame(rows, base)), 1).collect()}
    assert got[1].compete == pytest.approx((0.85 * 0.5 + 0.15 * 0.8) * 1.035 * 1.01404) and got[1].factors == ["mainline_bonus", "keep_cohesive"]
    assert got[2].compete == pytest.approx((0.85 * 0.6 + 0.15 * 0.2) * 0.88 * 0.90 * 0.988) and got[2].factors == ["fringe_guard", "isolated_fringe", "keep_cohesive"]
    assert got[3].compete == pytest.approx((0.85 * 0.4 + 0.15 * 0.3) * 1.035 * 0.988) and got[3].factors == ["mainline_bonus", "keep_cohesive"]
    assert got[4].compete == pytest.approx((0.93 * 0.02 + 0.07 * 0.2) * 0.88 * 1.065 * 0.988 * 0.970) and got[4].factors == ["fringe_guard", "topic_cohesive_bonus", "keep_cohesive", "residual_side"]
    assert (got[2].first_rank, got[2].moved, got[2].why) == (1, "out", "fringe_guard,isolated_fringe,keep_cohesive")
    assert (got[1].rank, got[1].moved, got[3].moved, got[4].why) == (1, "in", None, None)


AUTHORS = "query_id int, author_id int, dominant_share double, dominant_term string, mainline_ratio double, strong_terms int"
PAPERS = "query_id int, author_id int, work_id int, score double, hit_class string, axes array<string>, contributions array<struct<term:string,value:double>>"
#: An author's share, ratio and strong terms, best papers (score, class, axes, contributions), and the reason.
CASES = [
    (0.9, 0.1, 1, [(2.0, papers.RESONANCE, ["control_core"], [("a", 9.0)])], "broad_mainline_dominance_hit"),
    (0.8, 0.1, 1, [(2.0, papers.RESONANCE, ["control_core"], [("a", 9.0)])], "dom_share_below_threshold"),
    (None, 0.1, 1, [], "dom_share_below_threshold"),
    (0.9, 0.42, 1, [(2.0, papers.RESONANCE, ["control_core"], [("a", 9.0)])], "multi_axis_strength_excluded"),
    (0.9, 0.1, 1, [(2.0, papers.RESONANCE, ["control_core"], [("a", 8.0)]), (1.0, papers.SINGLE_MAIN, [], [("b", 2.0)])], "multi_axis_strength_excluded"),
    (0.9, 0.1, 2, [(2.0, papers.RESONANCE, ["control_core"], [("a", 9.0), ("b", 0.1)])], "multi_axis_strength_excluded"),
    (0.9, 0.1, 1, [(2.0, papers.RESONANCE, ["control_core"], [("a", 9.0)]), (1.0, papers.SINGLE_MAIN, ["estimation"], [("a", 1.0)])], "multi_axis_strength_excluded"),
    (0.9, 0.1, 1, [(2.0, papers.SINGLE_SIDE, ["control_core"], [("a", 9.0)])], "top_paper_single_hit_side_excluded"),
    (0.9, 0.1, 1, [(2.0, papers.SINGLE_MAIN, ["estimation"], [("a", 9.0)])], "top_paper_not_broad_shell_profile"),
    (0.9, 0.1, 1, [(2.0, papers.SINGLE_MAIN, ["unclassified"], [("a", 9.0)])], "broad_mainline_dominance_hit"),
    (0.9, 0.1, 1, [(2.0, papers.SINGLE_MAIN, None, [("a", 9.0)])], "broad_mainline_dominance_hit"),
    (0.9, 0.1, 1, [(2.0, papers.SIDE_ONLY, [], [("a", 9.0)])], "top_paper_not_broad_shell_profile"),
    (0.9, 0.1, 1, [(2.0, papers.SINGLE_MAIN, ["perception", "generic_robot_autonomous_shell"], [("a", 9.0)])], "broad_mainline_dominance_hit"),
    (0.9, 0.1, 1, [(2.0, papers.SINGLE_MAIN, ["perception"], [("a", 9.0)])], "top_paper_not_broad_shell_profile"),
    (0.9, 0.1, 1, [], "top_paper_not_broad_shell_profile"),
]


def test_broad_dominance(spark):
    authors = spark.createDataFrame([(1, k, c[0], "a", c[1], c[2]) for k, c in enumerate(CASES)] + [(1, 99, 0.9, "a", 0.1, 1)], AUTHORS)
    best = spark.createDataFrame([(1, k, i, *p) for k, c in enumerate(CASES) for i, p in enumerate(c[3])] + [(1, 99, 1, *CASES[0][3][0])], PAPERS)
    done = spark.createDataFrame([(1, 99)], "query_id int, author_id int")
    got = {r.author_id: r for r in papers.broad_dominance(authors, best, done).collect()}
    assert {k: got[k].reason for k in range(len(CASES))} == {k: c[4] for k, c in enumerate(CASES)}
    assert all(r.hit == (r.reason == "broad_mainline_dominance_hit") for r in got.values())
    assert got[99].reason == "skipped_overlaps_side_driven_suppression_audit"
    assert got[4].signals["second_term_share"] == "0.2" and got[6].signals["axis_union"] == "control_core,estimation" and got[0].signals["papers"] == "1"


def test_family_gate_of_dense_expansion(spark):
    at = lambda a: [math.cos(a), math.sin(a)]
    seeds = spark.createDataFrame([(100, at(0.0), at(0.0), "normal", True), (101, at(0.0), at(0.0), "weak", False), (102, at(0.0), at(0.0), "normal", True)], "seed int, q array<double>, anchor array<double>, tier string, strong boolean")
    items = spark.createDataFrame([(1, at(0.3)), (2, at(-0.3)), (3, at(0.1))], "id int, v array<double>")
    # The family stands at 1.0: item 1 is backed by cos 0.7 = 0.765, item 2 by cos 1.3 = 0.267, item 3 by cos 0.9 = 0.622.
    family = spark.createDataFrame([(100, at(1.0)), (101, at(1.0))], "seed int, m array<double>")
    got = {}
    for r in vectors.dense_expansion(seeds, items, 24, family).collect():
        got.setdefault(r.seed, set()).add(r.id)
    assert got == {100: {1}, 101: {1}, 102: {1, 2, 3}}
    spread = spark.createDataFrame([(100, at(1.0)), (100, at(0.3)), (101, at(1.03))], "seed int, m array<double>")
    got = {(r.seed, r.id) for r in vectors.dense_expansion(seeds.where("seed < 102"), items, 24, spread).collect()}
    # Mean (0.765 + 1) / 2 less a quarter of 0.235 backs item 1; item 3 has (0.622 + 0.980) / 2 - 0.09; 0.745 is just enough for a weak seed.
    assert got == {(100, 1), (100, 3), (101, 1)}


def test_merged_terms_carry_their_provenance(spark):
    rows = [(1, 7, 3, "similar_to", "primary", 0.5), (1, 7, 2, "conditioned_vec", "side", 0.9), (1, 7, 1, "similar_to", None, 0.5), (1, 8, 1, "family", "side", None), (2, 7, 3, "cooc", "side", 0.1)]
    got = {(r.query_id, r.tid): r for r in rules.merged_terms(spark.createDataFrame(rows, "query_id int, tid int, anchor_id int, source string, role string, score double")).collect()}
    r = got[1, 7]
    assert (r.score, r.members, r.anchors, r.sources, r.primary, r.lead) == (0.9, 3, [1, 2, 3], ["conditioned_vec", "similar_to"], True, 2)
    assert [tuple(m) for m in r.provenance] == [(0.9, 2, "conditioned_vec", "side"), (0.5, 1, "similar_to", None), (0.5, 3, "similar_to", "primary")]
    assert (got[1, 8].primary, got[1, 8].score, got[2, 7].members) == (False, None, 1)


def test_a_pool_is_not_shuffled_for_each_figure(spark):
    """distinct counts tripled the hits, and mixes were joined for each work and query, then joined back."""
    hits = spark.createDataFrame([("q", 1, "t", True, "p", "f", 0.5, 0.4, 2.0), ("q", 1, "u", False, "p", "f", 0.3, None, 1.0)], "query_id string, work_id long, term string, mainline boolean, parent string, family string, grounding double, align double, value double")
    works = papers.hit_quality(hits, F.sum("value").alias("s"))
    assert works.first().s == 3.0 and "Expand" not in works._jdf.queryExecution().optimizedPlan().toString()
    levels = "work_id long, level string, key string, share double"
    mixes = [(w, lv, k, x) for w in (1, 2, 3) for lv, k, x in (("field", "a", 1.0), ("subfield", "b", 1.0), ("topic", "c" if w < 3 else "d", 0.6), ("topic", "e", 0.4))]
    profile = spark.createDataFrame([("q", "field", "a", 0.5), ("q", "topic", "e", 0.05)], "query_id string, level string, key string, share double")
    pool = spark.createDataFrame([("q", w) for w in (1, 2, 3, 4)], "query_id string, work_id long")
    plain = spark.createDataFrame(mixes, levels)
    found = [papers.cohesion(pool, m, profile) for m in (plain, plain.withColumn("query_id", F.lit("q")))]
    rows = [sorted((r.work_id, r.neighbours, r.overlap, r.in_neighbourhood, r.signals) for r in f.collect()) for f in found]
    assert rows[0] == rows[1] == [(1, 1, True, False, 3), (2, 1, True, False, 3), (3, 0, True, False, 3), (4, 0, False, False, 0)]
