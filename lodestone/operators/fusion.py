"""From three ranked lists to a candidate pool: merge, rank fusion, filters, buckets, quotas, trust, final score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BUCKET_QUOTAS, DEFAULT, PATH_WEIGHTS, Config
from ..functions import weights as W

PATHS = ("vector", "label", "collab")


def merged(lists: dict[str, DataFrame]) -> DataFrame:
    """JOIN-15: query_id, author_id and each path's rank and score; lists hold (query_id, author_id, rank, score)."""
    out = None
    for path in PATHS:
        rows = lists[path].select("query_id", "author_id", F.col("rank").alias(f"{path}_rank"), F.col("score").alias(f"{path}_score"))
        out = rows if out is None else out.join(rows, ["query_id", "author_id"], "full_outer")
    for path in PATHS:
        out = out.withColumn(f"from_{path}", F.col(f"{path}_rank").isNotNull())
    return out.withColumn("path_count", sum((F.col(f"from_{p}").cast("int") for p in PATHS), F.lit(0)))


def fused(pool: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """WIN-06: the reciprocal ranks of all paths, weighted, and a little more for each further path."""
    score = sum((W.rrf(F.col(f"{p}_rank"), PATH_WEIGHTS[p], config) for p in PATHS), F.lit(0.0))
    return pool.withColumn("rrf_score", score).withColumn("pool_score", F.col("rrf_score") * (1 + 0.02 * (F.col("path_count") - 1)))


def bucketed(pool: DataFrame) -> DataFrame:
    """PRJ-06: the bucket by which paths found the candidate."""
    v, l, c = (F.col(f"from_{p}") for p in PATHS)  # noqa: E741
    return pool.withColumn("bucket", F.when(v & l, "A").when(v & c, "B").when(v, "C").when(l & c, "D").when(l, "E").when(c, "F").otherwise("Z"))


def hard_filtered(pool: DataFrame) -> DataFrame:
    """FLT-15: passed and reasons; works_count says how many works are known."""
    v, l = F.col("from_vector"), F.col("from_label")  # noqa: E741
    collab_only = ~v & ~l
    no_works = (F.coalesce("works_count", F.lit(0)) == 0) & ~l & ~v
    reasons = F.array_compact(F.array(F.when(collab_only, F.lit("collab_only")), F.when(no_works, F.lit("no_works"))))
    return pool.withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)


def quota_top(pool: DataFrame, top: int = 50, quotas: dict[str, int] = BUCKET_QUOTAS) -> DataFrame:
    """TOP-04: of each query the best of each bucket up to its quota, then the best of these; buckets without a quota go."""
    table = F.create_map(*[F.lit(x) for pair in quotas.items() for x in pair])
    order = [F.desc("pool_score"), "author_id"]
    inside = F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy(*order))
    kept = pool.withColumn("bucket_rank", inside).where(F.col("bucket_rank") <= F.coalesce(F.try_element_at(table, F.col("bucket")), F.lit(0)))
    return kept.withColumn("final_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("final_rank") <= top)


def trust_tier() -> Column:
    """RUL-11: eight tiers, the first that holds."""
    v, l, c = (F.col(f"from_{p}") for p in PATHS)  # noqa: E741
    vr, lr = F.coalesce("vector_rank", F.lit(9999)), F.coalesce("label_rank", F.lit(9999))
    risky = v & ~l & ~c & (vr > 100)
    return (
        F.when(v & l & (vr <= 50) & (lr <= 50), "strong_consensus")
        .when(l & (lr <= 30), "strong_label")
        .when(v & (vr <= 30), "strong_vector")
        .when((v & l) | (v & c) | (l & c), "weak_consensus")
        .when(risky, "risky_vector")
        .when(l, "weak_label")
        .when(v, "weak_vector")
        .otherwise("other")
    )


def stability() -> Column:
    """MTH-24: small bonuses and penalties, clipped."""
    x = F.lit(0.2) * (F.col("path_count") - 1) + F.when(F.col("from_label"), 0.1).otherwise(0.0) - F.when(~F.col("from_vector") & ~F.col("from_label"), 0.3).otherwise(0.0)
    return W.clipped(x, -0.3, 0.5)


def final_score(pool: Column, model: Column, stable: Column) -> Column:
    """MTH-23: without a model's score, pool and stability are left."""
    return W.blend((0.2, pool), (0.6, model), (0.2, stable))
