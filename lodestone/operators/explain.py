"""Why an author was found (RUL-13): the edges that led there, kept through the joins, ranked and cut per author at the end only.

A walk carries its edges as an array of structs on every row, so an explanation is a row and no later search. A step is an
equi-join on the node reached; the walk's weight is the product of its edges'. Only best() groups, by ranks that each
partition limits before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import stored

EDGE = "array<struct<kind:string,src:bigint,dst:bigint,weight:double>>"
#: The paths of retrieval in the order in which their evidence is preferred.
PATHS = ("vector", "label", "collab")


def started(seeds: DataFrame) -> DataFrame:
    """A walk's beginning: query_id, node, weight, chain (empty). seeds: query_id, node, weight; nulls are left out."""
    return seeds.where("query_id is not null and node is not null and weight is not null").select("query_id", F.col("node").cast("long").alias("node"), F.col("weight").cast("double").alias("weight"), F.expr(f"cast(array() as {EDGE})").alias("chain"))


def step(walks: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """walks one edge further: edges: src, dst, weight. Walks that end are gone; of repeated edges each is a walk."""
    e = edges.select(F.col("src").cast("long").alias("_src"), F.col("dst").cast("long").alias("_dst"), F.col("weight").cast("double").alias("_w"))
    edge = F.struct(F.lit(kind).alias("kind"), F.col("_src").alias("src"), F.col("_dst").alias("dst"), F.col("_w").alias("weight"))
    rows = walks.join(e, F.col("node") == F.col("_src"))
    return rows.select("query_id", F.col("_dst").alias("node"), (F.col("weight") * F.col("_w")).alias("weight"), F.concat("chain", F.array(edge)).alias("chain"))


def merged(walks: DataFrame) -> DataFrame:
    """walks of a query whose last edge is of one kind and ends in the same node as one, with their weights' sum; its chain holds that edge alone, without its source."""
    last = F.element_at("chain", -1)["kind"]
    rows = walks.groupBy("query_id", "node", last.alias("_kind")).agg(F.sum("weight").alias("weight"))
    edge = F.struct(F.col("_kind").alias("kind"), F.lit(None).cast("long").alias("src"), F.col("node").alias("dst"), F.lit(None).cast("double").alias("weight"))
    return rows.select("query_id", "node", "weight", F.array(edge).alias("chain"))


def told(chain: Column) -> Column:
    """A chain as text: kind:src>dst, edge after edge."""
    return F.array_join(F.transform(chain, lambda e: F.concat(e["kind"], F.lit(":"), e["src"].cast("string"), F.lit(">"), e["dst"].cast("string"))), " ")


def best(walks: DataFrame, k: int) -> DataFrame:
    """query_id, node, rank, weight, chain, path: the k heaviest walks to each node (ties by path)."""
    rows = walks.withColumn("path", told(F.col("chain")))
    place = F.row_number().over(Window.partitionBy("query_id", "node").orderBy(F.round("weight", 12).desc(), "path"))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "node", "rank", "weight", "chain", "path")


def best_fanned(walks: DataFrame, edges: DataFrame, fans: DataFrame, kinds: tuple[str, str], k: int) -> DataFrame:
    """query_id, node, rank, weight, path as best() has them of walks two edges further, where the last edge of a middle node weighs the same to all its ends; no row for each walk.

    walks: few rows, all of one length of chain. edges: src, dst, weight of the first kind; fans: src, ends (array), weight of the second.
    Walks to a middle node have the same order for all its ends, so its k best go on as one array; an end's k best walks come through
    the k middle nodes whose best walks are best. A walk is known by the place of its text in its query until those are found.
    """
    text = F.concat(told(F.col("chain")), F.when(F.size("chain") > 0, " ").otherwise(""), F.lit(f"{kinds[0]}:"), F.col("node").cast("string"), F.lit(">"))
    begun = stored(walks.withColumn("_text", text).withColumn("_no", F.row_number().over(Window.partitionBy("query_id").orderBy("_text"))).select("query_id", "node", "weight", "_text", "_no"))
    e = edges.select(F.col("src").cast("long").alias("_src"), F.col("dst").cast("long").alias("_mid"), F.col("weight").cast("double").alias("_w"))
    to_middle = e.join(F.broadcast(begun), F.col("node") == F.col("_src")).select("query_id", "_mid", (F.col("weight") * F.col("_w")).alias("w"), "_no")
    ends = fans.select(F.col("src").cast("long").alias("_mid"), "ends", F.col("weight").cast("double").alias("_f"))
    each = to_middle.groupBy("query_id", "_mid").agg(F.collect_list(F.struct("w", "_no")).alias("_all")).join(ends, "_mid")
    ordered = F.array_sort(F.transform("_all", lambda x: F.struct((-F.round(x["w"] * F.col("_f"), 12)).alias("r"), x["_no"].alias("no"), (x["w"] * F.col("_f")).alias("w"))))
    each = each.withColumn("_best", F.slice(ordered, 1, k)).select("query_id", "_mid", "_best", F.explode("ends").alias("node"))
    own, mid = Window.partitionBy("query_id", "node"), F.col("_mid").cast("string")
    first = each.withColumn("_r", F.row_number().over(own.orderBy(F.col("_best")[0]["r"], F.col("_best")[0]["no"], mid))).where(F.col("_r") <= k)
    rows = first.select("query_id", "node", "_mid", F.explode("_best").alias("x")).withColumn("rank", F.row_number().over(own.orderBy("x.r", "x.no", mid))).where(F.col("rank") <= k)
    told_of = begun.select(F.col("query_id").alias("_q"), F.col("_no").alias("_n"), "_text")
    rows = rows.join(F.broadcast(told_of), (F.col("query_id") == F.col("_q")) & (F.col("x.no") == F.col("_n")))
    path = F.concat("_text", mid, F.lit(f" {kinds[1]}:"), mid, F.lit(">"), F.col("node").cast("string"))
    return rows.select("query_id", F.col("node").cast("long").alias("node"), "rank", F.col("x.w").alias("weight"), path.alias("path"))


def carriers(walks: DataFrame, kind: str) -> DataFrame:
    """query_id, node, via, share: how much of a node's weight came through each edge of a kind (by its end), of all walks, not only the best."""
    edge = F.get(F.filter("chain", lambda e: e["kind"] == kind), 0)
    each = walks.withColumn("via", edge["dst"]).where("via is not null").groupBy("query_id", "node", "via").agg(F.sum("weight").alias("w"))
    total = each.groupBy("query_id", "node").agg(F.sum("w").alias("t"))
    return each.join(total, ["query_id", "node"]).select("query_id", "node", "via", F.when(F.col("t") > 0, F.col("w") / F.col("t")).otherwise(0.0).alias("share"))


def representative(evidence: DataFrame) -> DataFrame:
    """query_id, author_id, work_id, title, path, match_type: the work that stands for an author: evidence of the vector path before that of the label path and of collaboration, then the best score; works without title don't count.

    evidence: query_id, author_id, path, work_id, title, score (missing: 0).
    """
    order = F.array_position(F.array(*[F.lit(p) for p in PATHS]), F.lower(F.trim("path")))
    rows = evidence.withColumn("_p", order).where((F.col("_p") > 0) & F.col("work_id").isNotNull() & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    key = F.struct("_p", (-F.coalesce(F.col("score").cast("double"), F.lit(0.0))).alias("s"), "work_id", "title", F.lower(F.trim("path")).alias("path"))
    first = rows.groupBy("query_id", "author_id").agg(F.min(key).alias("x"))
    return first.select("query_id", "author_id", "x.work_id", F.trim("x.title").alias("title"), "x.path", F.concat("x.path", F.lit("_pool_evidence")).alias("match_type"))
