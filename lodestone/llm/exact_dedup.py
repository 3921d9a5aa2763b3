"""Exact duplicates by deterministic block naming.

A text is cut into fixed-size blocks. Equal blocks get equal integer names: the distinct blocks are sorted and
numbered. Adjacent names of a document are then named as pairs, level by level, until one name is left, so two
documents share it exactly if they have the same blocks in the same order. Names are compared, never digests: a
digest only routes a block to its name, and blocks whose digests collide are joined by their whole content.

Only the distinct blocks (combined on the map side) carry text through a shuffle; occurrences carry a 16-byte route.
Names are fixed by a checkpoint before use, so a lost executor cannot change them.

Defined cases: a null text counts as empty; an empty text is one empty block, so all empty texts are copies; repeated
rows and repeated doc_ids are separate documents; of a group the row with the smallest doc_id stays (null ids last,
then scan order); an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, whole_text, without_ids

BLOCK_CHARS = 2048


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def default_route(block: Column) -> Column:
    return F.unhex(F.md5(block.cast("binary")))


def _blocks(text: Column, size: int) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"(?s).{1,%d}" % size), F.lit(0))
    return F.when(text == "", F.array(F.lit(""))).otherwise(found)


def _numbered(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """distinct sorted in its partitions and numbered from 1, fixed in a checkpoint."""
    return cut(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id() + 1))


def _named_blocks(docs: DataFrame, size: int, route: Callable[[Column], Column]) -> DataFrame:
    """(rid, doc_id, text_sha256 on the first block, pos, name) for every block of every row."""
    norm = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col("doc_id"),
        normalised(whole_text()).alias("norm"),
    )
    blocks = norm.select("rid", "doc_id", F.sha2("norm", 256).alias("sha"), F.posexplode(_blocks(F.col("norm"), size)).alias("pos", "block"))
    blocks = blocks.select("rid", "doc_id", F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "pos", route(F.col("block")).alias("route"), "block")
    # Sorted by content, numbered, and fixed; the block itself is not stored.
    ordered = blocks.select("route", "block").distinct().sortWithinPartitions("block")
    names = cut(ordered.select("route", (F.monotonically_increasing_id() + 1).alias("name")))
    # Stored, so that the join below deals out the occurrences by themselves and Spark can split those of a hot block.
    by_route = cut(names.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name")))
    clash = by_route.where("n > 1").select("route")
    occurrences = blocks.select("rid", "doc_id", "sha", "pos", "route")
    if clash.isEmpty():
        return occurrences.join(by_route.select("route", "name"), "route")
    # Routes that several blocks share: their blocks are named and joined by content.
    clash = cut(clash)
    rest = blocks.join(clash, "route", "left_semi")
    exact = _numbered(rest.select("route", "block").distinct(), ["route", "block"]).withColumn("name", -F.col("name"))
    plain = occurrences.join(by_route.where("n = 1").select("route", "name"), "route")
    return plain.select("rid", "doc_id", "sha", "pos", "name").unionByName(rest.join(exact, ["route", "block"]).select("rid", "doc_id", "sha", "pos", "name"))


def identities(docs: DataFrame, block_chars: int = BLOCK_CHARS, route: Callable[[Column], Column] = default_route) -> DataFrame:
    """rid, doc_id, text_sha256, n_blocks, name: rows have equal (n_blocks, name) exactly if their normalised texts are equal."""
    named = _named_blocks(docs, block_chars, route)
    rows = named.groupBy("rid").agg(
        F.min("doc_id").alias("doc_id"),
        F.max("sha").alias("text_sha256"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"),
    )
    rows = cut(rows.withColumn("n_blocks", F.size("names")))
    done = rows.where("n_blocks = 1").select("rid", "doc_id", "text_sha256", "n_blocks", F.col("names")[0].alias("name"))
    info = rows.where("n_blocks > 1").select("rid", "doc_id", "text_sha256", "n_blocks")
    open_ = rows.where("n_blocks > 1").select("rid", "names")
    final = None
    width = rows.agg(F.max("n_blocks")).first()[0] or 1
    while width > 1:
        # An odd last name is paired with 0, which no name is.
        pairs = F.transform(
            F.sequence(F.lit(0), (F.size("names") - 1).cast("int"), F.lit(2)),
            lambda i: F.struct(F.get("names", i).alias("a"), F.coalesce(F.get("names", i + 1), F.lit(0).cast("long")).alias("b")),
        )
        at = open_.select("rid", F.posexplode(pairs).alias("pos", "pair")).select("rid", "pos", "pair.a", "pair.b")
        names = _numbered(at.select("a", "b").distinct(), ["a", "b"])
        back = at.join(names, ["a", "b"]).groupBy("rid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
        back = cut(back)
        ended = back.where(F.size("names") == 1).select("rid", F.col("names")[0].alias("name"))
        final = ended if final is None else final.unionByName(ended)
        open_ = back.where(F.size("names") > 1)
        width = (width + 1) // 2
    return done if final is None else done.unionByName(info.join(final, "rid").select("rid", "doc_id", "text_sha256", "n_blocks", "name"))


def exact_dedup(docs: DataFrame, block_chars: int = BLOCK_CHARS, route: Callable[[Column], Column] = default_route) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    rows = cut(identities(docs, block_chars, route))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("rid").alias("rid")))
    # Stored, so that the join deals out the rows by themselves and Spark can split a large group's share.
    groups = cut(rows.groupBy("n_blocks", "name").agg(first.alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1"))
    return rows.join(groups, ["n_blocks", "name"], "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("size").isNull() | (F.col("first.rid") == F.col("rid"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that exact_dedup drops."""
    found = cut(exact_dedup(docs.select("doc_id", "text")).select("doc_id", "kept", "text_sha256"))
    # Ids that are null or repeated don't say which of their rows stays; the content does.
    odd = cut(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").select("doc_id"))
    if odd.isEmpty():
        return without_ids(docs, found.where("not kept").select("doc_id"))
    plain = without_ids(docs.where("doc_id is not null"), found.where("not kept").select("doc_id").unionByName(odd).where("doc_id is not null").distinct())
    own, id_, sha, odd_ = (fresh(docs, x) for x in ("_own", "_id", "_sha", "_odd"))
    keep = found.where("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha)).distinct()
    rows = docs.join(odd.select(F.col("doc_id").alias(odd_)), F.col("doc_id").eqNullSafe(F.col(odd_)), "left_semi").withColumn(own, F.sha2(normalised(whole_text()), 256))
    rows = rows.join(keep, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha))).dropDuplicates([id_, sha]).select(*docs.columns)
    return plain.unionByName(rows)
