"""Candidates of an anchor: features, risks and buckets (RUL-03), then selection in passes to a landing state (RUL-04).

A pool has one row for each (query, anchor, candidate), of which an anchor has as many as its retrieval lets through, some
dozens. Columns of a pool, between 0 and 1 where not said otherwise:

    query_id, anchor_id, cand, term       keys (cand breaks all ties, smaller first) and the candidate's text
    sources                               array of similar_to, conditioned_vec, family_landing
    static, cond                          similarity to the anchor; the same in the anchor's context (null: none)
    align, identity, family, context      to the query; of names; of the family (0: identity counts); of contexts
    hier, supported                       consistency of field, subfield and topic; whether the context is known to support it
    generic, polysemy, object             risks
    support                               number of the query's anchors that bring it in
    family_type, shifted, generic_like    exact_like, near_synonym, generic, shifted or null; two flags
    gap                                   by how much the context is less similar
    retain                                admission: normal, weak_retain or reject
    score                                 the candidate's score in its pool

Anchors: query_id, anchor_id, mode (main_strong_process or aux_weak_process), strength.

The whole selection is windows over (query_id, anchor_id): one shuffle, then sorts within its partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.weights import blend, clipped
from .cascade import Test, judged

KEYS = ["query_id", "anchor_id"]
EXPANDABLE, SEED, KEEP, RISKY, REJECT = "primary_expandable", "primary_support_seed", "primary_support_keep", "risky_keep", "reject"
KEPT = (EXPANDABLE, SEED, KEEP, RISKY)
LAYERS = {EXPANDABLE: "candidate_core", SEED: "candidate_support", KEEP: "candidate_support"}

# Thresholds of the bucket tests.
MIN_SIM, MIN_CTX, MAX_DROP, DUAL_CTX, MULTI_FAMILY, RISKY_SIM = 0.38, 0.36, 0.14, 0.34, 0.46, 0.36
POLY_HARD, CTX_OK = 0.55, 0.50
REJECT_IDENTITY, REJECT_MAINLINE = 0.33, 0.40
BAD = {"identity": 0.28, "context": 0.50, "object": 0.18, "polysemy": 0.45, "hier": 0.30}
TECHNICAL = {"identity": 0.20, "align": 0.74, "context": 0.44, "polysemy": 0.55, "object": 0.35}
WEAK_TECHNICAL = {"identity": 0.45, "context": 0.55, "align": 0.74, "polysemy": 0.40, "object": 0.18}
DRIFT = {"identity": 0.24, "align": 0.76, "context": 0.46}
# Of the selection.
STRONG_AXIS, AXIS_GAP, BRIDGE_AXIS = 0.45, 0.03, 0.50
QUOTAS = {SEED: 2, KEEP: 2, RISKY: 1}
CONDITIONED_QUOTAS = {EXPANDABLE: 2, SEED: 2, KEEP: 2, RISKY: 1}
DRIFT_MOST = {"keep_to_seed": 0.36, "risky_to_keep": 0.38, "good": 0.40, "good_keep_only": 0.32, "pool": 0.44, "bridge": 0.41, "pool_catastrophic": 0.58, "pool_pair": 0.40}
FAMILY_DRIFT = {"shifted": 0.38, "generic": 0.22, "near_synonym": 0.08}
MARKS = r"[()\[\]{}/\\|;:@#]"

MAIN = "main_strong_process"


def _c(name: str) -> Column:
    return F.col(name)


def _u(x: Column) -> Column:
    return clipped(x, 0.0, 1.0)


def _has(source: str) -> Column:
    return F.array_contains("sources", source)


def term_sane(term: Column) -> Column:
    """Not empty, not only digits, 120 characters at most."""
    t = F.trim(F.coalesce(term, F.lit("")))
    return (t != "") & ~t.rlike(r"^\d+$") & (F.length(t) <= 120)


def naturalness(term: Column) -> Column:
    """STR-33: of a phrase: by its number of words, less for digits, marks and length."""
    t = F.trim(F.coalesce(term, F.lit("")))
    n = F.size(F.filter(F.split(F.lower(F.replace(t, F.lit("-"), F.lit(" "))), r"\s+"), lambda w: w != ""))
    words = F.when(n <= 0, 0.0).when(n == 1, 0.55).when(n <= 4, 1.0).when(n == 5, 0.72).otherwise(0.45)
    noise = F.when(t.rlike(r"\d"), 0.25).otherwise(0.0) + F.when(t.contains("_"), 0.25).otherwise(0.0) + F.when(t.rlike(MARKS), 0.15).otherwise(0.0)
    noise = noise + F.when(F.length(t) >= 56, 0.20).when(F.length(t) >= 42, 0.10).otherwise(0.0)
    return F.when(term_sane(term), _u(0.70 * words + 0.30 * (1 - _u(noise)))).otherwise(0.0)


def relative_scores(pool: DataFrame, better: list[str], worse: list[str]) -> DataFrame:
    """pool with rank_<column>, 1 for an anchor's best and 0 for its worst, and composite, their mean. Larger is better, of `worse` smaller; null is worst."""
    own = Window.partitionBy(*KEYS)
    n = F.count(F.lit(1)).over(own)
    for c in (*better, *worse):
        order = F.col(c).desc_nulls_last() if c in better else F.col(c).asc_nulls_last()
        place = F.row_number().over(own.orderBy(order, "cand"))
        pool = pool.withColumn(f"rank_{c}", F.when(n > 1, 1 - (place - 1) / (n - 1)).otherwise(1.0))
    each = [F.col(f"rank_{c}") for c in (*better, *worse)]
    return pool.withColumn("composite", sum(each, F.lit(0.0)) / len(each))


def features(pool: DataFrame) -> DataFrame:
    """pool with what the tests go by: similarities with and without context, consistency of the main line, risks and drift."""
    zero = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("static", "align", "identity", "context", "hier", "generic", "polysemy", "object", "gap", "score")]
    family = F.coalesce(F.col("family").cast("double"), F.lit(0.0))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("supported", "shifted", "generic_like")]
    fixed = {"static", "align", "identity", "context", "hier", "generic", "polysemy", "object", "gap", "score", "family", "supported", "shifted", "generic_like", "support"}
    rest = [c for c in pool.columns if c not in fixed]
    p = pool.select(*rest, *zero, *flags, F.coalesce("support", F.lit(1)).alias("support"), family.alias("family"))
    p = p.withColumn("family", F.when(_c("family") > 0, _c("family")).otherwise(_c("identity")))
    p = p.withColumn("has_sim", _has("similar_to")).withColumn("cond_only", _has("conditioned_vec") & ~_has("similar_to") & ~_has("family_landing"))
    p = p.withColumn("dual", _has("similar_to") & _c("cond").isNotNull()).withColumn("real", F.coalesce(_c("cond") > 1e-6, F.lit(False)))
    pref = 0.35 * _c("identity") + 0.25 * _c("align") + 0.20 * _c("context") + 0.10 * _c("hier") - 0.05 * _c("generic") - 0.05 * _c("polysemy")
    p = p.withColumn("pref", _u(pref))
    drop = lambda ctx: F.when((_c("static") > 0) & (ctx > 0), F.greatest(F.lit(0.0), _c("static") - ctx)).otherwise(0.0)
    p = p.withColumn("ctx0", F.when(_c("real"), _c("cond")).otherwise(0.0)).withColumn("ctx", F.coalesce("cond", "context"))
    p = p.withColumn("drop0", drop(_c("ctx0"))).withColumn("drop", drop(_c("ctx")))
    p = p.withColumn("best0", F.greatest("static", "ctx0")).withColumn("best", F.greatest("static", "ctx"))
    near = (_c("static") <= 1e-6) | (_c("drop0") <= MAX_DROP)
    p = p.withColumn("ctx_path", _c("real") & (_c("ctx0") >= MIN_CTX) & near).withColumn("multi", _c("support") >= 2)
    by_anchors = _c("multi") & ~_c("real") & (_c("family") >= MULTI_FAMILY) & (_c("static") >= MIN_SIM)
    by_both = _c("dual") & _c("real") & (_c("ctx0") >= DUAL_CTX) & near
    p = p.withColumn("similar", _c("best0") >= MIN_SIM)
    p = p.withColumn("primary_ok", _c("similar") & (_c("ctx_path") | by_anchors | by_both))
    tail = F.greatest(F.lit(0.0), _c("ctx") - F.least("drop", F.lit(0.25)))
    line = blend((0.30, _c("identity")), (0.25, _c("family")), (0.20, _c("align")), (0.15, tail), (0.10, _c("pref")))
    p = p.withColumn("mainline", line - (0.45 * _c("object") + 0.35 * _c("generic") + 0.20 * _c("polysemy")))
    return p.withColumn("axis", blend((0.35, _c("identity")), (0.30, _c("family")), (0.20, _c("align")), (0.15, _c("pref")))).withColumn("drift", quality_drift())


def quality_drift() -> Column:
    """How far a candidate's own evidence points away from its anchor."""
    by_type = F.lit(0.0)
    for k, v in FAMILY_DRIFT.items():
        by_type = F.when(_c("family_type") == k, v).otherwise(by_type)
    out = by_type + F.when(_c("shifted"), 0.18).otherwise(0.0) + F.when(_c("generic_like"), 0.12).otherwise(0.0)
    out = out + 0.55 * F.greatest(F.lit(0.0), _c("polysemy") - 0.22) + 0.45 * F.greatest(F.lit(0.0), _c("generic") - 0.42)
    out = out + F.when(_c("gap") > 0.16, F.least(F.lit(0.28), 1.15 * (_c("gap") - 0.16))).otherwise(0.0)
    alone = F.when(_has("conditioned_vec"), 0.14).when(~_has("family_landing"), 0.06).otherwise(0.0)
    return _u(out + F.when(_c("has_sim"), 0.0).otherwise(alone))


def technical() -> Column:
    """Weak, but technical enough to be spared: similar or conditioned, near to the query and its context, little risk."""
    t = TECHNICAL
    own = _c("has_sim") | _has("conditioned_vec") | (F.size("sources") == 0)
    return own & (_c("identity") >= t["identity"]) & (_c("align") >= t["align"]) & (_c("context") >= t["context"]) & (_c("polysemy") < t["polysemy"]) & (_c("object") < t["object"])


def drifting() -> Column:
    return ~technical() & (_c("identity") < DRIFT["identity"]) & ((_c("align") < DRIFT["align"]) | (_c("context") < DRIFT["context"]))


def bad_branch() -> Column:
    """An object or another sense of the word, without a context that says otherwise."""
    risky = (_c("object") >= BAD["object"]) | (_c("polysemy") >= BAD["polysemy"])
    return (_c("identity") < BAD["identity"]) & (_c("context") < BAD["context"]) & risky & (_c("hier") < BAD["hier"])


def managerial() -> Column:
    return F.contains(F.lower(F.coalesce("term", F.lit(""))), F.lit("(management)"))


def precheck() -> Column:
    """RUL-03: class before selection: hard_reject, weak_tech_keep or pass, with reason and trace."""
    w = WEAK_TECHNICAL
    weak = (_c("identity") < w["identity"]) & (_c("context") < w["context"]) & (_c("align") >= w["align"]) & (_c("polysemy") < w["polysemy"]) & (_c("object") < w["object"])
    low_line = ~_c("supported") & (_c("pref") < REJECT_MAINLINE)
    return judged(
        [
            Test("semantic_drift_branch", drifting(), "hard_reject"),
            Test("object_or_poly_bad_branch", bad_branch(), "hard_reject"),
            Test("obviously_bad_branch", managerial(), "hard_reject"),
            Test("weak_tech_keep", technical(), "weak_tech_keep"),
            Test("low_mainline_no_context", low_line, "hard_reject"),
            Test("weak_tech_keep", weak, "weak_tech_keep"),
            Test("low_identity_no_context", ~_c("supported") & (_c("identity") < REJECT_IDENTITY), "hard_reject"),
            Test("polysemous_no_context", (_c("polysemy") >= POLY_HARD) & ~_c("supported") & (_c("identity") < 0.40), "hard_reject"),
        ],
        "pass", "",
    )


def bucket_tests() -> list[Test]:
    """RUL-03: gates that turn a candidate away, then the five buckets by consistency with the main line."""
    strong = (_c("mainline") >= 0.52) & (_c("identity") >= 0.52) & (_c("family") >= 0.48) & (_c("ctx") >= 0.42) & (_c("drop") <= 0.10) & (_c("generic") <= 0.52) & ~_c("cond_only")
    middle = (_c("mainline") >= 0.42) & (_c("identity") >= 0.42) & (_c("family") >= 0.38) & (_c("align") >= 0.50) & (_c("generic") <= 0.58) & (_c("polysemy") <= 0.35) & (_c("object") <= 0.25)
    able = middle & ~_c("cond_only") & (_c("mainline") >= 0.46)
    return [
        Test("retain_mode_reject", _c("retain") == "reject", REJECT),
        Test("obviously_bad_branch", managerial() | bad_branch() | drifting(), REJECT),
        Test("polysemous_no_context", (_c("polysemy") >= POLY_HARD) & (_c("context") < CTX_OK), REJECT),
        Test("weak_line_not_primary", ~_c("primary_ok") & (_c("best0") >= RISKY_SIM), RISKY),
        Test("not_primary_enough", ~_c("primary_ok"), REJECT),
        Test("object_or_poly_bad", (_c("object") >= 0.55) | (_c("polysemy") >= 0.60), REJECT),
        Test("no_real_ctx_demote_expandable", strong & ~_c("real"), KEEP),
        Test("axis_strong_mainline", strong, EXPANDABLE),
        Test("no_real_ctx_demote_seed", able & ~_c("real"), KEEP),
        Test("axis_neighbor_weak_seed", able, SEED),
        Test("axis_weak_or_conditioned_only", middle, KEEP),
        Test("axis_keep_no_expand", (_c("mainline") >= 0.28) & (_c("align") >= 0.45), KEEP),
        Test("weak_line_not_primary", _c("best") >= RISKY_SIM, RISKY),
    ]


#: Reasons for which a candidate takes no part in its anchor's ranking.
GATES = ("retain_mode_reject", "obviously_bad_branch", "polysemous_no_context")


def bucketed(pool: DataFrame) -> DataFrame:
    """RUL-03: features of pool with pre (bucket, reason, passed) and check (class, reason, passed)."""
    p = features(pool)
    return p.withColumn("pre", judged(bucket_tests(), REJECT, "low_mainline")).withColumn("check", precheck())


def _ranked(p: DataFrame) -> DataFrame:
    """Pass 1: local preference and rank within an anchor, among those no gate turned away; whether the first is clearly first."""
    own = Window.partitionBy(*KEYS)
    seen = F.when(_c("primary_ok"), _c("ctx")).otherwise(_c("ctx0"))
    gone = F.when(_c("primary_ok"), _c("drop")).otherwise(_c("drop0"))
    p = p.withColumn("_ctx", seen).withColumn("_drop", gone).withColumn("_in", ~F.coalesce(_c("pre.reason").isin(*GATES), F.lit(False)))
    line = blend((0.44, _u(_c("axis"))), (0.34, _u(_c("pref"))), (0.22, _u(_c("family"))))
    quality = _u(0.50 * _u(_c("_ctx")) + 0.25 * _u(_c("context")) + 0.25 * (1 - _u(_c("_drop") / 0.10)))
    risk = _u(0.45 * _u(_c("generic")) + 0.30 * _u(_c("polysemy")) + 0.25 * _u(_c("object")))
    local = _u(0.46 * line + 0.22 * _u(_c("align")) + 0.20 * quality + 0.12 * naturalness(_c("term")) - 0.22 * risk - F.when(_c("cond_only"), 0.18).otherwise(0.0))
    shell = F.lower(F.trim(F.coalesce("term", F.lit("")))).rlike(r"(^|\s)controllers?$")
    step = lambda test, x: F.when(test, x).otherwise(0.0)
    p = p.withColumn("local", local)
    p = p.withColumn("_order", _c("local") + step(_c("has_sim"), 0.034) + step(_c("dual"), 0.020) - step(_c("cond_only"), 0.048) - step(shell, 0.028))
    order = [F.desc(x) for x in ("_in", "_order", "local", "axis", "pref", "align", "context", "_ctx")]
    p = p.withColumn("group_rank", F.when(_c("_in"), F.row_number().over(own.orderBy(*order, "cand"))))
    strong_a = _c("ctx_path") & _c("dual") & (_c("_ctx") > 0) & (_c("_drop") <= 0.065) & (_c("generic") <= 0.50) & (_c("polysemy") <= 0.26)
    strong_b = _c("primary_ok") & (_c("identity") >= 0.55) & (_c("align") >= 0.50) & (_c("family") >= 0.40) & (_c("_drop") <= 0.065) & (_c("generic") <= 0.50) & (_c("polysemy") <= 0.26)
    strong_c = _c("primary_ok") & _c("multi") & (_c("identity") >= 0.50) & (_c("align") >= 0.50) & (_c("generic") <= 0.45) & (_c("polysemy") <= 0.24)
    base = _c("has_sim") & _c("similar")
    p = p.withColumn("_strong", base & (_c("object") <= 0.20) & (strong_a | strong_b | strong_c))
    p = p.withColumn("_weak", base & _c("primary_ok") & (_c("_ctx") > 0) & (_c("_drop") <= 0.08) & (_c("family") >= 0.36) & (_c("generic") <= 0.58) & (_c("polysemy") <= 0.30) & (_c("object") <= 0.25))
    p = p.withColumn("_still", _c("cond_only") | (_c("generic") > 0.58) | (_c("polysemy") > 0.30) | (_c("object") > 0.25) | ~(_c("_ctx") > 0))
    at = lambda k: F.max(F.when(_c("group_rank") == k, _c("axis"))).over(own)
    p = p.withColumn("_clear", F.coalesce(at(1) - at(2) >= AXIS_GAP, F.lit(True)))
    return p.withColumn("_stable", F.coalesce(F.bool_or((_c("pre.outcome") == EXPANDABLE) & _c("_strong") & (_c("axis") >= STRONG_AXIS)).over(own), F.lit(False)))


def _settled(p: DataFrame) -> DataFrame:
    """Pass 2: promotions and demotions that depend on an anchor's ranking."""
    own = Window.partitionBy(*KEYS)
    held = _c("_strong") & (_c("axis") >= STRONG_AXIS)
    block = F.when(_c("group_rank") != 1, "not_group_top1").when(~_c("_clear"), "group_axis_gap_too_small").when(_c("_stable"), "judge_expandable_stable_exists")
    free = block.isNull()
    pre = lambda b: _c("pre.outcome") == b
    keep = pre(KEEP) & ~_c("_still")
    tests = [
        Test("axis_strong_mainline", pre(EXPANDABLE) & held, EXPANDABLE),
        Test("axis_neighbor_weak_seed", pre(EXPANDABLE) & _c("_weak"), SEED),
        Test("expandable_demote_strong_seed_axis_low", pre(EXPANDABLE) & _c("_strong"), KEEP),
        Test("expandable_demote_axis_not_hard_enough", pre(EXPANDABLE), KEEP),
        Test("seed_promote_to_expandable", pre(SEED) & held & free, EXPANDABLE),
        Test("axis_neighbor_weak_seed", pre(SEED) & _c("_weak"), SEED),
        Test(F.concat(F.lit("seed_promote_blocked_"), F.coalesce(block, F.lit(""))), pre(SEED) & held, KEEP),
        Test("seed_demote_strong_seed_axis_low", pre(SEED) & _c("_strong"), KEEP),
        Test("weak_seed_demote_axis_weak", pre(SEED), KEEP),
        Test("keep_promote_strong_mainline", keep & held & free, EXPANDABLE),
        Test("keep_promote_weak_seed", keep & _c("_weak"), SEED),
        Test(F.concat(F.lit("keep_promote_blocked_"), F.coalesce(block, F.lit(""))), keep & held, KEEP),
    ]
    p = p.withColumn("_now", judged(tests, _c("pre.outcome"), _c("pre.reason")))
    alone = (F.count(F.lit(1)).over(own) == 1) & _c("cond_only") & _c("_now.outcome").isin(EXPANDABLE, SEED)
    p = p.withColumn("bucket", F.when(alone, KEEP).otherwise(_c("_now.outcome"))).withColumn("reason", F.when(alone, "conditioned_only_single_weak_demote").otherwise(_c("_now.reason")))
    return p.drop("_now")


def _any(bucket: str, own) -> Column:
    return F.coalesce(F.bool_or(_c("bucket") == bucket).over(own), F.lit(False))


def _out(p: DataFrame, gone: Column, reason: str) -> DataFrame:
    """Rows of gone leave the selection."""
    gone = F.coalesce(gone, F.lit(False))
    return p.withColumn("_g", gone).withColumn("reason", F.when(_c("_g"), reason).otherwise(_c("reason"))).withColumn("bucket", F.when(_c("_g"), "dropped").otherwise(_c("bucket"))).drop("_g")


def _limited(p: DataFrame) -> DataFrame:
    """Pass 3: without an expandable candidate few of the others stay; where nothing stays, a strong anchor's best of those that failed by little."""
    own = Window.partitionBy(*KEYS)
    by = own.orderBy(F.desc("score"), "cand")
    p = p.withColumn("_e", _any(EXPANDABLE, own)).withColumn("_s", _any(SEED, own) | _any(KEEP, own))
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS, "bucket").orderBy(F.desc("score"), "cand")))
    low = F.lower(F.trim(F.coalesce("term", F.lit(""))))
    p = p.withColumn("_t", low).withColumn("_pool", F.collect_list(F.when(_c("bucket") == RISKY, low)).over(own))
    latin = ~F.col("_t").rlike("[一-鿿]") & (F.length("_t") >= 4)
    longer = F.exists("_pool", lambda o: (F.length(o) >= F.length(_c("_t")) + 3) & F.startswith(o, _c("_t")) & ~o.rlike("[一-鿿]"))
    p = p.withColumn("_whole", ~(latin & longer))
    alone = F.row_number().over(Window.partitionBy(*KEYS, "bucket").orderBy(F.desc("_whole"), F.desc("score"), F.desc(F.length("_t")), "cand"))
    p = p.withColumn("_a", alone)
    over = F.lit(False)
    for bucket, most in QUOTAS.items():
        over = over | ((_c("bucket") == bucket) & (_c("_r") > most) & (_c("_s") | (_c("bucket") != RISKY)))
    p = _out(p, ~_c("_e") & (over | ((_c("bucket") == RISKY) & ~_c("_s") & (_c("_a") > 1))), "quota")
    fits = (_c("family") >= 0.26) & (_c("align") >= 0.58) & (_c("context") >= 0.30) & (_c("hier") >= 0.20) & (_c("generic") <= 0.72) & (_c("object") <= 0.40) & (_c("polysemy") <= 0.62)
    rescue = blend((0.34, _c("family")), (0.24, _c("align")), (0.18, _c("context")), (0.10, _c("hier")), (0.08, _c("static")), (0.06, _c("score")), (-0.08, _c("generic")), (-0.06, _c("object")), (-0.06, _c("polysemy")))
    none = ~F.coalesce(F.bool_or(_c("bucket").isin(*KEPT)).over(own), F.lit(False))
    p = p.withColumn("_fit", _c("_in") & fits).withColumn("_rescue", rescue).withColumn("_none", none)
    p = p.withColumn("_first", F.row_number().over(own.orderBy(F.desc("_fit"), F.desc("_rescue"), "cand")))
    core = _c("_none") & _c("_fit") & (_c("_first") == 1) & (_c("strength") >= 0.90)
    p = p.withColumn("fallback", core).withColumn("bucket", F.when(core, KEEP).otherwise(_c("bucket"))).withColumn("reason", F.when(_c("fallback"), "anchor_core_fallback").otherwise(_c("reason")))
    conditioned = ~_c("has_sim") & _has("conditioned_vec")
    prior = [F.desc("dual"), F.desc("fallback"), F.desc("family"), "generic", "object", "polysemy", F.desc("score"), "cand"]
    p = p.withColumn("_c", conditioned).withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS, "bucket", "_c").orderBy(*prior)))
    over = F.lit(False)
    for bucket, most in CONDITIONED_QUOTAS.items():
        over = over | (_c("_c") & (_c("bucket") == bucket) & (_c("_r") > most))
    p = _out(p, over, "conditioned_quota")
    return p.withColumn("_line", F.row_number().over(own.orderBy(F.desc("pref"), "cand"))).withColumn("_by", F.row_number().over(by))


def _seeded(p: DataFrame) -> DataFrame:
    """Pass 4: without expandable candidate and seed, the first kept one may become the seed; seeds that nothing similar stands behind are only kept."""
    own = Window.partitionBy(*KEYS)
    # A fallback comes behind what was kept before it.
    first = F.row_number().over(Window.partitionBy(*KEYS, "bucket").orderBy("fallback", F.desc("score"), "cand"))
    p = p.withColumn("_r", first).withColumn("_n", ~(_any(EXPANDABLE, own) | _any(SEED, own)))
    able = (_c("has_sim") | _has("family_landing")) & ~_c("cond_only") & (_c("_line") <= 1) & (_c("generic") <= 0.55) & (_c("polysemy") <= 0.28) & (_c("object") <= 0.22)
    able = able & (_c("family") >= 0.34) & (_c("align") >= 0.58) & (_c("context") >= 0.30) & (_c("drift") <= DRIFT_MOST["keep_to_seed"])
    up = _c("_n") & (_c("bucket") == KEEP) & (_c("_r") == 1) & able
    p = p.withColumn("_up", F.coalesce(up, F.lit(False)))
    p = p.withColumn("bucket", F.when(_c("_up"), SEED).otherwise(_c("bucket"))).withColumn("reason", F.when(_c("_up"), "no_expandable_and_no_seed_promote_keep_top1").otherwise(_c("reason")))
    lone = (_c("bucket") == SEED) & ~_c("has_sim") & ~_c("cond_only")
    p = p.withColumn("_lone", F.coalesce(lone, F.lit(False)))
    return p.withColumn("bucket", F.when(_c("_lone"), KEEP).otherwise(_c("bucket"))).withColumn("reason", F.when(_c("_lone"), "weak_seed_requires_similar_to").otherwise(_c("reason")))


def _state(p: DataFrame) -> DataFrame:
    """Pass 5: the anchor's landing state, with one risky candidate that may be kept after all, and the look at the most similar one."""
    own = Window.partitionBy(*KEYS)
    kept = _c("bucket").isin(*KEPT)
    some = lambda test: F.coalesce(F.bool_or(kept & test).over(own), F.lit(False))
    p = p.withColumn("_kept", F.count_if(kept).over(own)).withColumn("_normal", some(_c("has_sim") | _has("conditioned_vec"))).withColumn("_family", some(_has("family_landing")))
    p = p.withColumn("family_only", (_c("_kept") > 0) & ~_c("_normal") & _c("_family"))
    for name, bucket in (("_E", EXPANDABLE), ("_S", SEED), ("_K", KEEP), ("_R", RISKY)):
        p = p.withColumn(name, F.count_if(_c("bucket") == bucket).over(own))
    seedish, main = (_c("_E") > 0) | (_c("_S") > 0), _c("mode") == MAIN
    state = judged(
        [
            Test("no_kept_candidates_after_select", _c("_kept") <= 0, "empty_landing"),
            Test("family_fallback_only_no_normal_retrieval", _c("family_only"), "fallback_only_landing"),
            Test("has_seed_or_expandable", main & seedish, "good_landing"),
            Test("support_keep_only", main & (_c("_K") > 0), "weak_landing"),
            Test("risky_only_keep", main, "weak_landing"),
            Test("aux_weak_seedish_not_main_strong", seedish, "weak_landing"),
            Test("aux_weak_support_keep_only", (_c("_K") > 0) & (_c("_R") == 0), "weak_landing"),
            Test("aux_weak_risky_only", (_c("_R") > 0) & (_c("_K") == 0), "weak_landing"),
        ],
        "weak_landing", "aux_weak_mixed_kept",
    )
    p = p.withColumn("_st", state)
    calm = (_c("generic") <= 0.50) & (_c("polysemy") <= 0.26) & (_c("object") <= 0.20) & (_c("align") >= 0.62) & (_c("family") >= 0.30) & (_c("drift") <= DRIFT_MOST["risky_to_keep"])
    last = main & ~seedish & (_c("_K") == 0) & (_c("_R") == 1) & ~_c("family_only") & (_c("bucket") == RISKY) & _c("has_sim") & calm
    p = p.withColumn("_up", F.coalesce(last, F.lit(False))).withColumn("_ups", F.bool_or("_up").over(own))
    p = p.withColumn("bucket", F.when(_c("_up"), KEEP).otherwise(_c("bucket"))).withColumn("reason", F.when(_c("_up"), "promoted_risky_top1_to_support_keep").otherwise(_c("reason")))
    p = p.withColumn("_state", _c("_st.outcome")).withColumn("_why", F.when(_c("_ups"), "promoted_risky_top1_to_support_keep").otherwise(_c("_st.reason")))
    for name, bucket in (("_K", KEEP), ("_R", RISKY)):
        p = p.withColumn(name, F.count_if(_c("bucket") == bucket).over(own))
    kept = _c("bucket").isin(*KEPT)
    p = p.withColumn("_hard", F.coalesce(F.bool_and(F.when(kept, _c("cond_only"))).over(own), F.lit(False)) & ~_c("family_only"))
    level = F.element_at(F.create_map(*[F.lit(x) for k, b in enumerate(KEPT) for x in (b, k)]), _c("bucket"))
    p = p.withColumn("_l", F.when(kept, level).otherwise(9))
    p = p.withColumn("_top", F.row_number().over(own.orderBy((_c("_l") == 9), F.desc("static"), "_l", "fallback", F.desc("score"), "cand")))
    only_keeps = ~seedish & (_c("_K") > 0)
    most = F.when(only_keeps, DRIFT_MOST["good_keep_only"]).otherwise(DRIFT_MOST["good"])
    good = (_c("static") >= 0.85) & (_c("generic") <= 0.55) & (_c("polysemy") <= 0.30) & (_c("object") <= 0.25) & ((_c("align") >= 0.58) | (_c("family") >= 0.34)) & (_c("drift") <= most) & (_c("bucket") != RISKY)
    p = p.withColumn("_good", F.coalesce(F.bool_or((_c("_top") == 1) & kept & good).over(own), F.lit(False)) & main & ~_c("family_only") & ~_c("_hard"))
    p = p.withColumn("_pool_drift", F.coalesce(F.max(F.when(_c("bucket") == KEEP, _c("drift"))).over(own), F.lit(0.0)))
    drifts = _c("_good") & only_keeps & (_c("_pool_drift") >= DRIFT_MOST["pool"])
    p = p.withColumn("landing_state", F.when(drifts, "weak_landing").when(_c("_good"), "good_landing").otherwise(_c("_state")))
    return p.withColumn("landing_reason", F.when(drifts, "main_strong_sk_only_pool_drift_high").when(_c("_good"), "main_strong_normal_retrieval_top1_ok").otherwise(_c("_why")))


def _closed(p: DataFrame) -> DataFrame:
    """Pass 6: what a weak or empty landing takes back, and the one seed that a weak landing of a main anchor may keep."""
    own = Window.partitionBy(*KEYS)
    seedish = _c("bucket").isin(EXPANDABLE, SEED)
    shut = _c("landing_state").isin("fallback_only_landing", "empty_landing") & seedish
    p = _out(p, shut, "landing_without_seeds")
    down = (_c("landing_state") == "weak_landing") & _c("bucket").isin(EXPANDABLE, SEED)
    p = p.withColumn("_down", F.coalesce(down, F.lit(False)))
    p = p.withColumn("bucket", F.when(_c("_down"), KEEP).otherwise(_c("bucket"))).withColumn("reason", F.when(_c("_down"), "weak_landing_demoted_from_expandable_or_seed").otherwise(_c("reason")))
    p = p.withColumn("_pool_drift", F.coalesce(F.max(F.when(_c("bucket") == KEEP, _c("drift"))).over(own), F.lit(0.0)))
    lone = (_c("_pool_drift") >= DRIFT_MOST["pool_catastrophic"]) & (_c("drift") >= DRIFT_MOST["pool_pair"])
    # That something similar stands behind it: by source, or by a similarity of its own.
    behind = ~_c("cond_only") & (_c("has_sim") | (_c("static") > 0))
    able = behind & (_c("drift") <= DRIFT_MOST["bridge"]) & ~lone & (_c("_line") <= 1) & (_c("generic") <= 0.52) & (_c("polysemy") <= 0.26) & (_c("object") <= 0.20)
    able = able & (_c("family") >= 0.36) & (_c("align") >= 0.58) & (_c("context") >= 0.30) & (_c("axis") >= BRIDGE_AXIS)
    bridge = (_c("landing_state") == "weak_landing") & (_c("mode") == MAIN) & ~_c("family_only") & (_c("bucket") == KEEP) & able
    p = p.withColumn("_able", F.coalesce(bridge, F.lit(False)))
    p = p.withColumn("_r", F.row_number().over(own.orderBy(F.desc("_able"), F.desc("axis"), "drift", F.desc("align"), "cand")))
    p = p.withColumn("bridge", _c("_able") & (_c("_r") == 1))
    p = p.withColumn("bucket", F.when(_c("bridge"), SEED).otherwise(_c("bucket"))).withColumn("reason", F.when(_c("bridge"), "weak_landing_seed_bridge").otherwise(_c("reason")))
    kept = _c("bucket").isin(*KEPT)
    p = p.withColumn("landing_kept", F.count_if(kept).over(own))
    hard = F.coalesce(F.bool_and(F.when(kept, _c("cond_only"))).over(own), F.lit(False)) & ~_c("family_only")
    p = p.withColumn("_hard", hard).withColumn("landing_state", F.when(_c("_hard"), "weak_landing").otherwise(_c("landing_state")))
    return p.withColumn("landing_reason", F.when(_c("_hard"), "conditioned_only_weak_grounding_pool").otherwise(_c("landing_reason")))


def selected(pool: DataFrame, anchors: DataFrame) -> DataFrame:
    """RUL-04: every candidate with pre_bucket, bucket (dropped: turned away by a quota or the landing), reason, group_rank, tier, can_expand, layer, fallback, bridge and its anchor's landing_state, landing_reason, landing_kept.

    An anchor without candidates has one row without cand, of state empty_landing.
    """
    p = bucketed(pool).join(anchors.select(*KEYS, "mode", "strength"), KEYS)
    p = _closed(_state(_seeded(_limited(_settled(_ranked(p))))))
    tier = F.when(_c("bucket") == EXPANDABLE, "strong").when(_c("bucket") == SEED, "weak").otherwise("none")
    layer = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in LAYERS.items() for x in pair]), _c("bucket")), F.lit("candidate_noise"))
    out = p.select(
        *KEYS, "cand", F.col("pre.outcome").alias("pre_bucket"), "bucket", "reason", "group_rank", tier.alias("tier"), _c("bucket").isin(EXPANDABLE, SEED).alias("can_expand"), layer.alias("layer"),
        "fallback", "bridge", "landing_state", "landing_reason", "landing_kept",
    )
    none = anchors.select(*KEYS).join(pool.select(*KEYS).distinct(), KEYS, "left_anti")
    none = none.withColumn("landing_state", F.lit("empty_landing")).withColumn("landing_reason", F.lit("no_candidates_generated")).withColumn("landing_kept", F.lit(0).cast("long"))
    return out.unionByName(none, allowMissingColumns=True)
