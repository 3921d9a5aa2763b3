"""Table changes as functions from tables to tables: upserts, updates, key migrations, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """SET-05, SNK-01: one row per key, the last by order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c.desc() for c in order]))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upserted(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-01: changes (one row per key) replace rows of base, or join them."""
    return base.join(changes.select(*keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def inserted(base: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-02: rows of new keys only; what is there wins."""
    return base.unionByName(rows.join(base.select(*keys), keys, "left_anti").dropDuplicates(keys), allowMissingColumns=True)


def added(base: DataFrame, changes: DataFrame, keys: list[str], value: str) -> DataFrame:
    """SNK-03: values of equal keys add up."""
    return base.select(*keys, value).unionByName(changes.select(*keys, value)).groupBy(*keys).agg(F.sum(value).alias(value))


def updated(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """SNK-05/06: columns from changes where the key is there, else as they are."""
    new = changes.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = base.join(new, keys, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns])


def migrated(children: DataFrame, mapping: DataFrame, key: str, unique: list[str]) -> DataFrame:
    """SNK-08: key renamed by mapping (old, new); rows that then are the same are one."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    renamed = children.join(m, children[key] == m["_old"], "left").withColumn(key, F.coalesce("_new", key)).drop("_old", "_new")
    return renamed.dropDuplicates(unique)


def linked(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """SNK-12: edges (src, dst, ...) whose two ends exist, one of each pair."""
    known = edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi").join(targets.select(F.col("id").alias("dst")), "dst", "left_semi")
    return known.dropDuplicates(["src", "dst"])


def undirected(edges: DataFrame) -> DataFrame:
    """SNK-13: one edge for each pair, the smaller end first; the largest weight stays."""
    return edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max("weight").alias("weight"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """SET-07: rows of either that the other lacks, with side a or b; repeated rows count."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def demanded(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """FLT-28: df, which fails to be read if a row breaks the condition."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def merged_nodes(base: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """SNK-11: nodes of new keys join base; of known ones the properties that rows give (not null) replace base's, others stay."""
    columns = [c for c in rows.columns if c != key]
    new = rows.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = base.withColumn("_there", F.lit(True)).join(new, key, "full")
    every = [*base.columns, *[c for c in columns if c not in base.columns]]
    return joined.select(*[F.col(c) if c not in columns else (F.coalesce(f"_new_{c}", c) if c in base.columns else F.col(f"_new_{c}")).alias(c) for c in every])


def pending(items: DataFrame, done: DataFrame, key: str, final: tuple[str, ...] = ("SUCCESS", "NOT_FOUND", "SKIPPED")) -> DataFrame:
    """STM-09: items without a final status in done (key, status); API_ERROR is tried again."""
    return items.join(done.where(F.col("status").isin(*final)).select(key).distinct(), key, "left_anti")


def status_set(done: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """STM-09: done with the newest status of each key."""
    return upserted(done, results, [key])


def due(stamps: DataFrame, column: str, now: str, days: int) -> DataFrame:
    """STM-08: one row, due: whether the newest stamp is days old or more, or there is none."""
    last = F.max(column)
    return stamps.agg((last.isNull() | (F.datediff(F.lit(now).cast("date"), last.cast("date")) >= days)).alias("due"))


def swapped(df: DataFrame, table: str) -> None:
    """SNK-21: df in place of a catalogue table, which may be one that df reads, with fresh statistics.

    The old table keeps another name until the new one has its own, so a stop at any point leaves one of them; the next call puts an old one back first.
    """
    spark = df.sparkSession
    made, old = f"{table}_new", f"{table}_old"
    if not spark.catalog.tableExists(table) and spark.catalog.tableExists(old):
        spark.sql(f"alter table {old} rename to {table}")
    df.write.mode("overwrite").saveAsTable(made)
    spark.sql(f"drop table if exists {old}")
    if spark.catalog.tableExists(table):
        spark.sql(f"alter table {table} rename to {old}")
    spark.sql(f"alter table {made} rename to {table}")
    spark.sql(f"analyze table {table} compute statistics")
    spark.sql(f"drop table if exists {old}")
