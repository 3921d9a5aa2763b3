"""The graph path: anchors to terms to works to authors, each step a table keyed by query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import weights as W
from .statistics import counted, packed, spelled
from .storage import few


def anchors(jobs: DataFrame, skills: DataFrame, most_coverage: float) -> DataFrame:
    """L3, JOIN-22: query_id, voc_id, job_freq, coverage: skills of a query's jobs, without those that too many of all jobs have. skills: job_id, voc_id, whose rows may repeat, or packed sets, a row for each job and word.

    A job's skills are one set, so that jobs are counted as they stand and not told apart for each skill. Packed sets are read three times and should be stored.
    """
    own = (skills if "bits" in skills.columns else packed(skills, "job_id")).where("job_id is not null")
    total = own.agg(F.countDistinct("job_id").alias("total"))
    cover = counted(own).crossJoin(F.broadcast(total)).select("voc_id", (F.col("n") / F.col("total")).alias("coverage"))
    mine = counted(jobs.select("query_id", "job_id").distinct().join(own, "job_id"), "query_id").withColumnRenamed("n", "job_freq")
    return mine.join(cover.where(F.col("coverage") < most_coverage), "voc_id").select("query_id", "voc_id", "job_freq", "coverage")


def anchor_score(job_freq, coverage, span, in_text, task_like, sim):
    """L4, MTH-26: six terms, and at least 0.5 for a task that the text names."""
    x = 0.15 * F.log1p(job_freq) + 0.2 * (1 - F.least(F.lit(1.0), coverage)) + 0.1 / (1 + F.coalesce(span, F.lit(10)))
    x = x + 0.35 * in_text.cast("int") + 0.35 * task_like.cast("int") + 0.2 * F.greatest(F.lit(0.0), sim)
    return F.when(in_text & task_like, F.greatest(x, F.lit(0.5))).otherwise(x)


def landings(frontier: DataFrame, similar: DataFrame, k: int, least: float) -> DataFrame:
    """L7, JOIN-36, AGG-28: query_id, voc_id, sim, sources: the k most similar terms of each anchor, merged by term."""
    near = frontier.join(similar.where(F.col("score") >= least), F.col("voc_id") == F.col("src")).select("query_id", F.col("voc_id").alias("anchor"), "dst", "score")
    rank = F.row_number().over(Window.partitionBy("query_id", "anchor").orderBy(F.desc("score"), "dst"))
    best = near.withColumn("r", rank).where(F.col("r") <= k)
    return best.groupBy("query_id", F.col("dst").alias("voc_id")).agg(F.max("score").alias("sim"), F.countDistinct("anchor").alias("sources"))


def specific(terms: DataFrame, has_topic: DataFrame, works: DataFrame, most_degree: float) -> DataFrame:
    """terms (voc_id, ...) that few enough works have, with idf."""
    total = works.agg(F.count(F.lit(1)).alias("total"))
    degree = counted(has_topic).withColumnRenamed("n", "degree").crossJoin(F.broadcast(total)).where(F.col("degree") / F.col("total") < most_degree)
    return terms.join(degree.select("voc_id", W.idf_log10(F.col("total"), F.col("degree")).alias("idf")), "voc_id")


def hits(terms: DataFrame, has_topic: DataFrame, works: DataFrame, most_degree: float) -> DataFrame:
    """L21, JOIN-19, FLT-19: query_id, work_id, voc_id, idf, year, score for terms (query_id, voc_id, score) that few enough works have.

    Works keep their partitioning by work_id; a join by term would put all works of a term into one task.
    """
    kept = few(specific(terms, has_topic, works, most_degree))
    return spelled(has_topic.join(works.select("work_id", "year"), "work_id")).join(kept, "voc_id").select("query_id", "work_id", "voc_id", "idf", "year", "score")


def gated(pairs: DataFrame, caps: dict[str, int]) -> DataFrame:
    """L23, FLT-17, WIN-05: role and weight by two thresholds on grounding and alignment, then the best of each term up to its role's cap."""
    role = F.when(F.col("grounding") >= 0.12, "primary").when((F.col("grounding") >= 0.06) & (F.col("align") >= 0.78), "secondary")
    rows = pairs.withColumn("role", role).where(F.col("role").isNotNull()).withColumn("value", F.col("value") * F.when(F.col("role") == "secondary", 0.65).otherwise(1.0))
    table = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    rank = F.row_number().over(Window.partitionBy("query_id", "voc_id", "role").orderBy(F.desc("value"), "work_id"))
    # By the largest cap, each partition keeps the first ones before it sends them.
    return rows.withColumn("r", rank).where(F.col("r") <= max(caps.values())).where(F.col("r") <= F.coalesce(F.try_element_at(table, F.col("role")), F.lit(0))).drop("r")


def work_scores(pairs: DataFrame) -> DataFrame:
    """L24, AGG-26, MTH-11: query_id, work_id, n_terms, score: a term counts once per work, by its largest idf; more terms, more coverage."""
    once = pairs.groupBy("query_id", "work_id", "voc_id").agg(F.max(F.struct("idf", "value")).alias("m"))
    sums = once.groupBy("query_id", "work_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("m.value").alias("value"))
    return sums.select("query_id", "work_id", "n_terms", (F.col("value") * F.log1p("n_terms") / F.log(2.0 + F.col("n_terms"))).alias("score"))


def consensus(anchor_count, anchors_all, edges, outside, topic_fit):
    """Cross and drift."""
    cross = W.clipped(0.90 + 0.12 * F.least(F.lit(1.0), anchor_count / F.greatest(F.lit(2.0), anchors_all)) + 0.08 * F.least(F.lit(1.0), edges / 3.0), 0.9, 1.1)
    drift = W.clipped(0.45 * outside + 0.25 * (1 - topic_fit) + 0.30 / F.greatest(anchor_count, F.lit(1)), 0.0, 1.0)
    return cross, drift


def term_score(local, cross, backbone, risk, unified):
    """L17, MTH-20."""
    return 0.88 * W.clipped(0.38 * local + 0.34 * cross + 0.28 * backbone - 0.42 * risk, 0.0, 1.0) + 0.12 * unified


def family_adjusted(terms: DataFrame) -> DataFrame:
    """L18, WIN-13: in a family, the best primary gains a twentieth, and supports within a tenth of it stay below it."""
    own = Window.partitionBy("query_id", "family")
    best = F.max(F.when(F.col("role") == "primary", F.col("score"))).over(own)
    rows = terms.withColumn("best", best)
    up = F.when((F.col("role") == "primary") & (F.col("score") == F.col("best")), F.col("score") * 1.05)
    down = F.when((F.col("role") != "primary") & F.col("best").isNotNull() & (F.col("score") < 1.10 * F.col("best")), F.least("score", 0.98 * F.col("best")))
    return rows.withColumn("score", F.coalesce(up, down, F.col("score"))).drop("best")


def tail_decay(terms: DataFrame, group: str, free: int = 4, base: float = 0.85) -> DataFrame:
    """WIN-08/09: factor by rank in the group; groups of three or fewer and the first `free` are spared."""
    own = Window.partitionBy("query_id", group)
    rank = F.row_number().over(own.orderBy(F.desc("score"), "voc_id"))
    n = F.count(F.lit(1)).over(own)
    return terms.withColumn("factor", F.when((n <= 3) | (rank <= free), 1.0).otherwise(F.pow(F.lit(base), rank - free)))


def author_scores(works: DataFrame, authored: DataFrame) -> DataFrame:
    """L28, AGG-14/15: query_id, author_id, score from (query_id, work_id, voc_id, value): decay by term, a cap per term, penalty for one paper."""
    keys = ["query_id", "author_id"]
    each = works.join(authored.select("work_id", "author_id").distinct(), "work_id")
    rank = F.row_number().over(Window.partitionBy(*keys, "voc_id").orderBy(F.desc("value"), "work_id"))
    terms = each.withColumn("r", rank).groupBy(*keys, "voc_id").agg(F.sum(F.col("value") * F.pow(F.lit(0.6), F.col("r") - 1)).alias("s"))
    total = F.sum("s").over(Window.partitionBy(*keys))
    capped = terms.withColumn("s", F.least("s", 0.25 * total)).groupBy(*keys).agg(F.sum("s").alias("s"))
    papers = each.groupBy(*keys).agg(F.countDistinct("work_id").alias("papers"))
    return capped.join(papers, keys).select(*keys, "papers", (F.col("s") * F.when(F.col("papers") == 1, 0.73).otherwise(1.0)).alias("score"))
