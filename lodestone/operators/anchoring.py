"""From a job's terms to anchors in context: layers, text windows, conditioned vectors, their neighbours, and anchors that the job's own vector adds (RUL-01, RUL-02, VEC-11)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import roles as R
from . import vectors as V
from .cascade import Test, first_block, judged
from .landing import MAIN
from .storage import stored

# Roles, priorities and ceilings of scores as shares of the best main anchor.
MAIN_ROLE, AUX_ROLE, CONTEXT_ROLE = "main_anchor_candidate", "aux_anchor_candidate", "context_only_anchor"
SUPPLEMENT = "jd_vector_supplement"
SUPPLEMENT_CAP, CONTEXT_CAP, GENERIC_CAP = 0.38, 0.06, 0.46
SPECIFIC_ALONE, SPECIFIC_PART, SPECIFIC_DEFAULT = 0.24, 0.33, 0.55
# Windows of text in characters.
WINDOW, SNIPPET, TIGHT, NEAR, PHRASES, CO_ANCHORS = 100, 200, 84, 10, 10, 5
SEGMENTS = "[\\n\\r]+|[。；;！!？?●•|]+"
# Shares of anchor, local phrases, co-anchors and job in a conditioned vector.
MIX = (0.68, 0.17, 0.10, 0.05)
# Of the search by conditioned vectors.
NEIGHBOURS, LEAST_NEIGHBOURS, WIDER = 8, 6, 14
LEAST, LEAST_ALONE, LEAST_WIDE, SUPPORTED = 0.78, 0.80, 0.74, 0.80
TYPES = ("concept", "keyword")
# Of the supplement.
SUPPLEMENT_K, SUPPLEMENT_MOST, SUPPLEMENT_ADD, SUPPLEMENT_RATIO, MELT = 10, 30, 6, 0.6, 0.03
SUPPLEMENT_SHARE = 0.24


def _c(name: str) -> Column:
    return F.col(name)


# --- layers


def layered(anchors: DataFrame) -> DataFrame:
    """RUL-01: anchors with coarse (as refined), role, priority, final_score and place in their query: main ones first, then auxiliary ones, then context.

    anchors: query_id, anchor_id, term, source (skill_direct or jd_vector_supplement), coarse, specificity, base, squeeze (factor of generic auxiliary terms, null: 1).
    """
    t = F.lower(F.trim(F.coalesce("term", F.lit(""))))
    own = Window.partitionBy("query_id")
    rows = anchors.withColumn("_t", t).withColumn("_all", F.collect_set("_t").over(own))  # a query has some dozens of anchors
    t = _c("_t")
    folded = R.carrier(t) | R.compressed(t, _c("_all"))
    task = F.when(R.task_like(t), R.OBJECT_TASK).otherwise(R.CORE)
    first = F.when((_c("coarse") == R.GENERIC) & R.concrete(t) & ~folded, task).otherwise(_c("coarse"))
    rows = rows.withColumn("_first", first).withColumn("_added", F.coalesce(_c("source") == SUPPLEMENT, F.lit(False)))
    good = _c("_first").isin(R.CORE, R.OBJECT_TASK)
    coarse = judged(
        [
            Test("supplement", _c("_added") & (good | (_c("_first") == R.TOOL)), R.TOOL),
            Test("supplement", _c("_added"), R.GENERIC),
            Test("side_branch", good & R.side_branch(t), R.GENERIC),
            Test("platform", good & R.platform(t), R.TOOL),
            Test("carrier_or_compressed", good & folded, R.GENERIC),
        ],
        _c("_first"), "",
    )["outcome"]
    rows = rows.withColumn("coarse", coarse).withColumn("specificity", F.coalesce("specificity", F.lit(SPECIFIC_DEFAULT)))
    vague = ~_c("_added") & (_c("coarse") == R.GENERIC) & (((_c("specificity") < SPECIFIC_PART) & R.subsumed(t, _c("_all"))) | (_c("specificity") < SPECIFIC_ALONE))
    role = judged(
        [
            Test("venue_or_noise", _c("coarse").isin(R.VENUE, R.NOISE), CONTEXT_ROLE),
            Test("vague", vague, CONTEXT_ROLE),
            Test("generic_tool_or_added", _c("coarse").isin(R.GENERIC, R.TOOL) | _c("_added"), AUX_ROLE),
        ],
        MAIN_ROLE, "primary",
    )["outcome"]
    rows = rows.withColumn("role", role)
    generic = _c("coarse") == R.GENERIC
    rows = rows.withColumn("priority", F.when(_c("role") == CONTEXT_ROLE, 0.08).when(_c("role") == MAIN_ROLE, 1.0).when(generic, 0.42).otherwise(0.48))
    rows = rows.withColumn("base", F.coalesce("base", F.lit(0.0)))
    best = lambda test: F.max(F.when(test, _c("base"))).over(own)
    rows = rows.withColumn("_main", best(_c("role") == MAIN_ROLE)).withColumn("_direct", best(~_c("_added")))
    rows = rows.withColumn("_top", F.when(_c("_main") > 0, _c("_main")).when(_c("_direct") > 0, _c("_direct")).otherwise(1.0))
    squeezed = _c("base") * F.coalesce("squeeze", F.lit(1.0))
    final = (
        F.when(_c("_added"), F.least("base", SUPPLEMENT_CAP * _c("_top")))
        .when(_c("role") == CONTEXT_ROLE, F.least("base", CONTEXT_CAP * _c("_top")))
        .when((_c("role") == AUX_ROLE) & generic, F.least(squeezed, GENERIC_CAP * _c("_top")))
        .otherwise(_c("base"))
    )
    rows = rows.withColumn("final_score", final)
    level = F.when(_c("role") == MAIN_ROLE, 0).when(_c("role") == AUX_ROLE, 1).otherwise(2)
    rows = rows.withColumn("place", F.row_number().over(own.orderBy(level, F.desc("final_score"), "anchor_id")))
    return rows.drop("_t", "_all", "_first", "_added", "_main", "_direct", "_top")


# --- text windows


def contexts(anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """RUL-01: anchors with snippet (the shortest segment of the job's text that has the term, cut around it), local_context and phrase_context; empty without a text. texts: query_id, text."""
    text, term = F.coalesce("text", F.lit("")), F.lower(F.trim(F.coalesce("term", F.lit(""))))
    rows = anchors.join(texts.select("query_id", "text"), "query_id", "left").withColumn("_x", text).withColumn("_t", term).withColumn("_n", F.length("_t"))
    parts = F.filter(F.transform(F.split("_x", SEGMENTS), lambda s: F.trim(s)), lambda s: F.contains(F.lower(s), _c("_t")))
    # The shortest, then the first: a sort by length and place.
    ordered = F.array_sort(F.transform(parts, lambda s, i: F.struct(F.length(s).alias("n"), i.alias("i"), s.alias("s"))))
    at = F.instr(F.lower("_x"), _c("_t"))
    around = F.trim(F.substring("_x", F.greatest(F.lit(1), at - 36), _c("_n") + 100 + F.least(at - 1, F.lit(36))))
    rows = rows.withColumn("_s", F.coalesce(F.get(ordered, 0)["s"], F.when(at > 0, around), F.trim(F.substring("_x", 1, 120))))
    rows = rows.withColumn("_s", F.trim(F.substring("_s", 1, SNIPPET)))
    place = F.instr(F.lower("_s"), _c("_t"))
    room = TIGHT - _c("_n")
    left = F.greatest(F.lit(1), place - F.floor(room / 2))
    cut = F.substring("_s", left, place + _c("_n") + (room - F.floor(room / 2)) - left)
    rows = rows.withColumn("snippet", F.when(F.length("_s") <= TIGHT, _c("_s")).when((place > 0) & (_c("_n") > 0), F.substring(F.trim(cut), 1, TIGHT)).otherwise(F.substring("_s", 1, TIGHT)))
    rows = rows.withColumn("snippet", F.when(_c("_n") == 0, "").otherwise(F.trim("snippet")))
    place = F.instr(F.lower("snippet"), _c("_t"))
    left = F.greatest(F.lit(1), place - NEAR)
    inside = F.trim(F.substring("snippet", left, place + _c("_n") + NEAR - left))
    rows = rows.withColumn("local_context", F.when(place > 0, inside).otherwise(F.trim(F.substring("snippet", 1, 56))))
    rows = rows.withColumn("phrase_context", F.when(place > 0, F.substring("snippet", 1, 96)).otherwise(F.trim(F.substring("snippet", 1, 72))))
    return rows.drop("text", "_x", "_t", "_n", "_s")


def companions(anchors: DataFrame, texts: DataFrame) -> DataFrame:
    """RUL-01: query_id, anchor_id, other, phrase, co: the query's other terms near an anchor's first place in the text. phrase: place among its local phrases (10 at most), co: among its co-anchors (5 at most), null beyond.

    anchors: layered(), whose place, role, coarse and final_score count. Context-only terms accompany nobody, and generic ones no generic one; co-anchors of a main anchor are of some score.
    """
    of = anchors.select("query_id", F.col("anchor_id").alias("other"), F.lower(F.trim("term")).alias("_u"), F.col("role").alias("_role"), F.col("coarse").alias("_coarse"), F.col("final_score").alias("_score"), F.col("place").alias("_place"))
    mine = anchors.select("query_id", "anchor_id", F.lower(F.trim("term")).alias("_t"), "role", "coarse", "final_score").join(texts.select("query_id", F.lower("text").alias("_x")), "query_id")
    at = F.instr("_x", _c("_t"))
    left = F.greatest(F.lit(1), at - WINDOW)
    mine = mine.where((F.length("_t") > 0) & (at > 0)).withColumn("_w", F.substring("_x", left, at + F.length("_t") + WINDOW - left)).drop("_x")
    # Pairs within a query only, whose anchors are some dozens.
    rows = mine.join(of, "query_id").where((_c("_u") != _c("_t")) & (F.length("_u") > 0) & F.contains("_w", _c("_u")))
    rows = rows.where((_c("_role") != CONTEXT_ROLE) & ~((_c("coarse") == R.GENERIC) & (_c("_coarse") == R.GENERIC)))
    main = _c("role") == MAIN_ROLE
    best = F.max(F.when(_c("_role") == MAIN_ROLE, _c("_score"))).over(Window.partitionBy("query_id"))
    rows = rows.withColumn("_best", F.coalesce(best, F.lit(0.0)))
    weak = (main & (_c("_score") < 0.40 * _c("_best"))) | (main & (_c("_score") < 0.34 * _c("final_score"))) | ((_c("_coarse") == R.GENERIC) & (_c("_role") == AUX_ROLE) & (main | (_c("_score") < 0.48 * _c("final_score"))))
    rows = rows.withColumn("_able", ~weak)
    own = Window.partitionBy("query_id", "anchor_id")
    rows = rows.withColumn("phrase", F.row_number().over(own.orderBy("_place"))).withColumn("co", F.row_number().over(own.orderBy(F.desc("_able"), F.when(_c("_role") == MAIN_ROLE, 0).otherwise(1), F.desc("_score"), "other")))
    rows = rows.withColumn("phrase", F.when(_c("phrase") <= PHRASES, _c("phrase"))).withColumn("co", F.when(_c("_able") & (_c("co") <= CO_ANCHORS), _c("co")))
    return rows.where("phrase is not null or co is not null").select("query_id", "anchor_id", "other", "phrase", "co")


# --- conditioned vectors


def _mean(rows: DataFrame, name: str) -> DataFrame:
    """query_id, anchor_id and the mean of v, by position."""
    each = rows.select("query_id", "anchor_id", F.posexplode("v").alias("i", "x")).groupBy("query_id", "anchor_id", "i").agg(F.avg("x").alias("x"))
    return each.groupBy("query_id", "anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias(name))


def conditioned(anchors: DataFrame, companions_: DataFrame, terms: DataFrame, queries: DataFrame) -> DataFrame:
    """RUL-01: query_id, anchor_id, q: of unit length: the anchor's vector mixed with the means of its five first local phrases and of its co-anchors (else the anchor's own) and the job's vector; the anchor's alone without companions and snippet.

    anchors: query_id, anchor_id, snippet; terms: voc_id, v; queries: query_id, job. Anchors without a vector are left out.
    """
    with_v = companions_.join(terms.select(F.col("voc_id").alias("other"), "v"), "other")
    local, co = _mean(with_v.where("phrase <= 5"), "_l"), _mean(with_v.where("co is not null"), "_o")
    keys = ["query_id", "anchor_id"]
    rows = anchors.select(*keys, "snippet").join(terms.select(F.col("voc_id").alias("anchor_id"), "v"), "anchor_id").join(local, keys, "left").join(co, keys, "left").join(queries.select("query_id", "job"), "query_id", "left")
    alone = _c("_l").isNull() & _c("_o").isNull() & (F.coalesce("snippet", F.lit("")) == "")
    parts = F.arrays_zip("v", F.coalesce("_l", "v").alias("l"), F.coalesce("_o", "v").alias("o"), F.coalesce("job", "v").alias("j"))
    mixed = F.transform(parts, lambda e: MIX[0] * e["v"] + MIX[1] * e["l"] + MIX[2] * e["o"] + MIX[3] * e["j"])
    rows = rows.withColumn("q", F.when(alone, _c("v")).otherwise(mixed))
    return V.normalised(rows.select(*keys, "q"), "q")


def neighbour_gates(wide: bool) -> list[tuple[str, Column]]:
    """VEC-11: what must hold of a neighbour. In the wider search terms outside of the active domains pass, unless they conflict."""
    least = LEAST_WIDE if wide else LEAST
    domain = _c("in_domain") | ~F.coalesce(_c("conflict"), F.lit(False)) if wide else _c("in_domain")
    return [
        ("anchor_itself", _c("cand") != _c("anchor_id")),
        ("entity_type", F.coalesce("entity_type", F.lit("")).isin("", *TYPES)),
        ("similarity_too_low", _c("sim") >= least),
        ("outside_of_domains", domain),
        ("too_low_without_similar_to", _c("similar") | (_c("sim") >= (LEAST_WIDE if wide else LEAST_ALONE))),
    ]


def conditioned_neighbours(anchors: DataFrame, terms: DataFrame, similar: DataFrame, domains: DataFrame, k: int = NEIGHBOURS, search: Callable[[DataFrame, DataFrame, int], DataFrame] = V.top_k) -> DataFrame:
    """VEC-11: query_id, anchor_id, cand, sim, tier, block (the gate that is shut, null for a neighbour), conditioned_only, supported, soft_domain.

    A strong search for all anchors, and a wider one with lower thresholds for just those main anchors whose pool stayed empty. anchors: query_id, anchor_id, mode, q (unit); terms: voc_id, v (unit), entity_type;
    similar: anchor_id, cand; domains: query_id, cand, in_domain, conflict (terms not in it are inside). search(queries, items, k) gives query_id, item_id, score.
    """
    keys = ["query_id", "anchor_id"]
    own = stored(anchors.withColumn("_key", F.concat_ws(":", "query_id", "anchor_id")))
    items = terms.select(F.col("voc_id").alias("item_id"), "v")
    known = similar.select("anchor_id", "cand").distinct().withColumn("similar", F.lit(True))

    def tier(part: DataFrame, name: str, most: int, wide: bool) -> DataFrame:
        hits = search(part.select(F.col("_key").alias("query_id"), "q"), items, most).select(F.col("query_id").alias("_key"), F.col("item_id").alias("cand"), F.col("score"))
        rows = hits.join(part.select("_key", *keys), "_key").withColumn("sim", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round("score", 9))))
        rows = rows.join(terms.select(F.col("voc_id").alias("cand"), "entity_type"), "cand").join(known, ["anchor_id", "cand"], "left").join(domains, ["query_id", "cand"], "left")
        rows = rows.withColumn("similar", F.coalesce("similar", F.lit(False))).withColumn("in_domain", F.coalesce("in_domain", F.lit(True)))
        rows = rows.withColumn("block", first_block(neighbour_gates(wide))).withColumn("tier", F.lit(name))
        return rows.select(*keys, "cand", "sim", "tier", "block", (~_c("similar")).alias("conditioned_only"), (_c("sim") >= SUPPORTED).alias("supported"), (F.lit(wide) & ~_c("in_domain")).alias("soft_domain"))

    strong = stored(tier(own, "strong_conditioned", max(k, LEAST_NEIGHBOURS), False))
    empty = stored(own.where(_c("mode") == MAIN).join(strong.where("block is null").select(*keys).distinct(), keys, "left_anti"))
    return strong.unionByName(tier(empty, "main_strong_retry", max(k, LEAST_NEIGHBOURS) + WIDER, True))


def supplemented(queries: DataFrame, terms: DataFrame, anchors: DataFrame, statistics: DataFrame, k: int = SUPPLEMENT_K, search: Callable[[DataFrame, DataFrame, int], DataFrame] = V.top_k) -> DataFrame:
    """RUL-02: query_id, voc_id, score, domain_ratio, block and base of the terms nearest to a job's own vector that are no anchors of it: those without block are added, six at most, by domain ratio, then score.

    queries: query_id, q (unit); terms: voc_id, term, entity_type, v; anchors: query_id, anchor_id; statistics: query_id, voc_id, coverage, domain_ratio (no row: none are known; a null ratio: no active domains).
    """
    hits = search(queries.select("query_id", "q"), terms.select(F.col("voc_id").alias("item_id"), "v"), min(k, SUPPLEMENT_MOST)).select("query_id", F.col("item_id").alias("voc_id"), F.round("score", 9).alias("score"))
    free = hits.join(anchors.select("query_id", F.col("anchor_id").alias("voc_id")).distinct(), ["query_id", "voc_id"], "left_anti")
    rows = free.join(terms.select("voc_id", "term", F.lower("entity_type").alias("entity_type")), "voc_id").where(F.length("term") >= 2)
    rows = rows.join(statistics.withColumn("_known", F.lit(True)), ["query_id", "voc_id"], "left")
    gates = [
        ("etype_not_allowed", F.coalesce("entity_type", F.lit("")).isin("", *TYPES)),
        ("low_domain_ratio", _c("domain_ratio").isNull() | (_c("domain_ratio") >= SUPPLEMENT_RATIO)),
        ("cov_j_melt", F.coalesce("coverage", F.lit(0.0)) < MELT),
        ("no_stats", _c("_known")),
    ]
    rows = rows.withColumn("block", first_block(gates)).withColumn("domain_ratio", F.coalesce("domain_ratio", F.when(_c("_known"), 1.0).otherwise(0.0)))
    place = F.row_number().over(Window.partitionBy("query_id", F.col("block").isNull()).orderBy(F.desc("domain_ratio"), F.desc("score"), "voc_id"))
    rows = rows.withColumn("block", F.when(_c("block").isNull() & (place > SUPPLEMENT_ADD), "enough").otherwise(_c("block")))
    base = SUPPLEMENT_SHARE * _c("score") * (0.55 + 0.45 * _c("domain_ratio"))
    return rows.select("query_id", "voc_id", "score", "domain_ratio", "block", F.when(_c("block").isNull(), base).alias("base"))
