"""Classes of phrases, layers, windows of text, conditioned vectors and their neighbours, read off the rules by hand."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.functions import roles
from lodestone.operators import anchoring

#: A phrase, the phrases beside it, its class and the test that decided.
PHRASES = [
    ("", [], roles.NOISE, "too_short"),
    ("c", [], roles.NOISE, "too_short"),
    ("发表论文", [], roles.VENUE, "preference"),
    ("learning-based", [], roles.GENERIC, "hyphenated"),
    ("移动机器人", [], roles.GENERIC, "carrier_without_task"),
    ("机器人运动控制", [], roles.OBJECT_TASK, "concrete_task"),
    ("规控算法", ["机器人运动控制"], roles.GENERIC, "compressed"),
    ("规控算法", [], roles.CORE, "concrete"),
    ("motion planning", [], roles.OBJECT_TASK, "concrete_task"),
    ("强化学习", [], roles.GENERIC, "side_branch"),
    ("大规模强化学习方法", [], roles.CORE, "concrete"),
    ("云平台", [], roles.TOOL, "platform"),
    ("算法", [], roles.GENERIC, "short_chinese"),
    ("Vision", ["computer vision"], roles.GENERIC, "subsumed"),
    ("apache spark", [], roles.TOOL, "words_technical"),
    ("c++ 17", [], roles.CORE, "words"),
    ("ros", [], roles.TOOL, "abbreviation"),
    ("pytorch", [], roles.TOOL, "word_technical"),
    ("control", [], roles.OBJECT_TASK, "word_task"),
    ("c#.net", [], roles.CORE, "word"),
    ("参数识别", [], roles.OBJECT_TASK, "chinese_task"),
    ("全身协调", [], roles.CORE, "chinese_mainline"),
    ("数据分析", [], roles.GENERIC, "chinese"),
]


def test_coarse_roles(spark):
    df = spark.createDataFrame([(k, p, o) for k, (p, o, _, _) in enumerate(PHRASES)], "k int, p string, o array<string>")
    got = {r.k: (r.c.outcome, r.c.reason) for r in df.select("k", roles.coarse_role(F.col("p"), F.col("o"), F.array(F.lit("ros"))).alias("c")).collect()}
    assert {PHRASES[k][0]: v for k, v in got.items() if v != PHRASES[k][2:]} == {}


def test_layers(spark):
    rows = [
        (1, 1, "motion planning", "skill_direct", roles.OBJECT_TASK, 0.6, 10.0, None),
        (1, 2, "apache spark", "skill_direct", roles.TOOL, 0.6, 9.0, None),
        (1, 3, "vision", "skill_direct", roles.GENERIC, 0.5, 8.0, 0.5),
        (1, 4, "computer vision", "jd_vector_supplement", roles.CORE, 0.6, 20.0, None),
        (1, 5, "ai", "skill_direct", roles.GENERIC, 0.2, 7.0, None),
        (1, 6, "发表", "skill_direct", roles.VENUE, None, 0.3, None),
        (2, 1, "tool", "skill_direct", roles.TOOL, None, 3.0, None),
        (3, 1, "added", "jd_vector_supplement", roles.TOOL, None, 3.0, None),
    ]
    df = spark.createDataFrame(rows, "query_id int, anchor_id int, term string, source string, coarse string, specificity double, base double, squeeze double")
    got = {(r.query_id, r.anchor_id): (r.coarse, r.role, r.priority, round(r.final_score, 9), r.place) for r in anchoring.layered(df).collect()}
    assert got == {
        (1, 1): (roles.OBJECT_TASK, anchoring.MAIN_ROLE, 1.0, 10.0, 1),
        (1, 2): (roles.TOOL, anchoring.AUX_ROLE, 0.48, 9.0, 2),
        (1, 3): (roles.GENERIC, anchoring.AUX_ROLE, 0.42, 4.0, 3),
        (1, 4): (roles.TOOL, anchoring.AUX_ROLE, 0.48, 3.8, 4),
        (1, 5): (roles.GENERIC, anchoring.CONTEXT_ROLE, 0.08, 0.6, 5),
        (1, 6): (roles.VENUE, anchoring.CONTEXT_ROLE, 0.08, 0.3, 6),
        (2, 1): (roles.TOOL, anchoring.AUX_ROLE, 0.48, 3.0, 1),
        (3, 1): (roles.TOOL, anchoring.AUX_ROLE, 0.48, 0.38, 1),
    }


def anchors(spark, rows):
    """query_id, anchor_id, term, role, coarse, final_score, place."""
    return spark.createDataFrame(rows, "query_id int, anchor_id int, term string, role string, coarse string, final_score double, place int")


MAIN = [anchoring.MAIN_ROLE, roles.CORE]


def test_contexts(spark):
    long = "a" * 60 + " Robot arm " + "b" * 60
    said = [(1, "We build a robot arm for labs。Robot arm！Other"), (2, long), (3, None), (4, "robot; arm"), (5, "")]
    rows = anchors(spark, [(q, 1, "robot arm", *MAIN, 1.0, 1) for q in (1, 2, 3, 4, 5)] + [(1, 2, "labs", *MAIN, 1.0, 2), (1, 3, "", *MAIN, 1.0, 3), (1, 4, "missing", *MAIN, 1.0, 4)])
    got = {(r.query_id, r.anchor_id): (r.snippet, r.local_context, r.phrase_context) for r in anchoring.contexts(rows, spark.createDataFrame(said, "query_id int, text string")).collect()}
    assert got[1, 1] == ("Robot arm", "Robot arm", "Robot arm")
    assert got[1, 2] == ("We build a robot arm for labs", "t arm for labs", "We build a robot arm for labs")
    assert got[1, 3] == ("", "", "")
    assert got[1, 4] == ("We build a robot arm for labs。Robot arm！Other",) * 3
    assert got[2, 1] == ("a" * 36 + " Robot arm " + "b" * 37, "a" * 9 + " Robot arm " + "b" * 9, "a" * 36 + " Robot arm " + "b" * 37)
    assert got[3, 1] == got[5, 1] == ("", "", "")
    assert got[4, 1][0] == "robot; arm"


def test_companions(spark):
    generic = [anchoring.AUX_ROLE, roles.GENERIC]
    rows = anchors(
        spark,
        [(1, 1, "alpha", *MAIN, 10.0, 1), (1, 2, "beta", *MAIN, 9.0, 2), (1, 3, "gamma", *MAIN, 1.0, 3), (1, 4, "delta", *generic, 9.0, 4), (1, 5, "noise", anchoring.CONTEXT_ROLE, roles.GENERIC, 9.0, 5), (1, 6, "eps", *generic, 9.0, 6), (1, 7, "far", *MAIN, 9.0, 7)],
    )
    text = "Alpha and beta, gamma, delta, noise, eps" + " " * 200 + "far"
    got = {}
    for r in anchoring.companions(rows, spark.createDataFrame([(1, text)], "query_id int, text string")).collect():
        got.setdefault(r.anchor_id, []).append((r.other, r.phrase, r.co))
    assert sorted(got[1]) == [(2, 1, 1), (3, 2, None), (4, 3, None), (6, 4, None)]
    assert sorted(o for o, _, _ in got[4]) == [1, 2, 3] and 7 not in got
    assert dict((o, c) for o, _, c in got[4]) == {1: 1, 2: 2, 3: 3}


def unit(*x):
    n = math.sqrt(sum(v * v for v in x))
    return [v / n for v in x]


def test_conditioned_vectors(spark):
    terms = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0])], "voc_id int, v array<double>")
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, ""), (1, 3, ""), (1, 9, "x")], "query_id int, anchor_id int, snippet string")
    near = spark.createDataFrame([(1, 1, 2, 1, None), (1, 1, 3, 2, 1), (1, 2, 3, None, 1)], "query_id int, anchor_id int, other int, phrase int, co int")
    job = spark.createDataFrame([(1, [0.0, 0.6, 0.8])], "query_id int, job array<double>")
    got = {r.anchor_id: r.q for r in anchoring.conditioned(rows, near, terms, job).collect()}
    assert got[1] == pytest.approx(unit(0.68, 0.17 * 0.5 + 0.05 * 0.6, 0.17 * 0.5 + 0.10 + 0.05 * 0.8))
    assert got[2] == pytest.approx(unit(0.0, 0.68 + 0.17 + 0.05 * 0.6, 0.10 + 0.05 * 0.8))
    assert got[3] == pytest.approx([0.0, 0.0, 1.0]) and 9 not in got


def test_conditioned_neighbours(spark):
    at = lambda c: [c, math.sqrt(1 - c * c)]
    terms = [(1, [1.0, 0.0], "concept"), (2, at(0.9), "concept"), (3, at(0.79), "keyword"), (4, at(0.785), ""), (5, at(0.85), "industry"), (6, at(0.77), "concept"), (7, at(0.5), "concept"), (8, at(0.95), "concept")]
    pulled = [-1.0, 0.0]
    more = [(20, at(-0.76), "concept"), (21, at(-0.75), "concept")]
    terms = spark.createDataFrame(terms + more, "voc_id long, v array<double>, entity_type string")
    similar = spark.createDataFrame([(1, 3)], "anchor_id long, cand long")
    domains = spark.createDataFrame([(1, 8, False, False), (1, 20, False, False), (1, 21, False, True)], "query_id long, cand long, in_domain boolean, conflict boolean")
    own = spark.createDataFrame([(1, 1, "main_strong_process", [1.0, 0.0]), (1, 30, "main_strong_process", pulled), (1, 31, "aux_weak_process", pulled)], "query_id long, anchor_id long, mode string, q array<double>")
    got = anchoring.conditioned_neighbours(own, terms, similar, domains, 10).collect()
    first = {r.cand: r.block for r in got if r.anchor_id == 1}
    assert first == {1: "anchor_itself", 2: None, 3: None, 4: "too_low_without_similar_to", 5: "entity_type", 6: "similarity_too_low", 7: "similarity_too_low", 8: "outside_of_domains", 20: "similarity_too_low", 21: "similarity_too_low"}
    assert {r.tier for r in got if r.anchor_id == 1} == {"strong_conditioned"} == {r.tier for r in got if r.anchor_id == 31}
    wide = {r.cand: (r.block, r.soft_domain) for r in got if r.anchor_id == 30 and r.tier == "main_strong_retry"}
    assert wide[20] == (None, True) and wide[21] == ("outside_of_domains", True) and wide[7][0] == "similarity_too_low"
    assert {(r.cand, r.supported, r.conditioned_only) for r in got if r.anchor_id == 1 and r.block is None} == {(2, True, True), (3, False, False)}


def test_supplement(spark):
    at = lambda c: [c, math.sqrt(1 - c * c)]
    terms = [(k, f"term{k}", "concept", at(1 - k / 100)) for k in range(1, 11)] + [(11, "x", "concept", at(0.5)), (12, "odd", "industry", at(0.99)), (13, "wide", "concept", at(0.98)), (14, "common", "concept", at(0.97)), (15, "new", "concept", at(0.96))]
    stats = [(1, k, 0.0, 0.9 if k != 3 else 1.0) for k in range(1, 11)] + [(1, 12, 0.0, 1.0), (1, 13, 0.9, 0.5), (1, 14, 0.03, 0.8)]
    got = anchoring.supplemented(
        spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, q array<double>"), spark.createDataFrame(terms, "voc_id int, term string, entity_type string, v array<double>"),
        spark.createDataFrame([(1, 2)], "query_id int, anchor_id int"), spark.createDataFrame(stats, "query_id int, voc_id int, coverage double, domain_ratio double"), 30,
    )
    rows = {r.voc_id: (r.block, r.base) for r in got.collect()}
    assert {k: b for k, (b, _) in rows.items()} == {1: None, 3: None, 4: None, 5: None, 6: None, 7: None, 8: "enough", 9: "enough", 10: "enough", 12: "etype_not_allowed", 13: "low_domain_ratio", 14: "cov_j_melt", 15: "no_stats"}
    assert rows[3][1] == pytest.approx(0.24 * 0.97) and rows[1][1] == pytest.approx(0.24 * 0.99 * (0.55 + 0.45 * 0.9)) and rows[8][1] is None
