"""Exact vector search and what is built on it. Queries are a small set of counted size; items of any number.

Items stream past the queries, and each partition keeps its best k per query before anything is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.weights import dot, norm
from .seeds import family_support
from .storage import stored

#: Query vectors sent to all tasks at once; more go in blocks.
BLOCK = 2000


def normalised(df: DataFrame, column: str = "embedding") -> DataFrame:
    """VEC-02: vectors of length 1; a null or zero vector stays as it is."""
    n = norm(F.col(column))
    return df.withColumn("_n", n).withColumn(column, F.when(F.col("_n") > 0, F.transform(column, lambda x: x.cast("double") / F.col("_n"))).otherwise(F.col(column))).drop("_n")


def _met(batches: Iterator[pa.RecordBatch], queries: int, cell: str | None, probed: np.ndarray | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Items and the places of the queries that they meet: all, or those that ask for the items' cell."""
    for b in batches:
        if probed is None:
            yield b, np.arange(queries)
            continue
        own = b.column(cell).to_numpy()
        for c in np.unique(own).tolist():
            met = np.nonzero(probed[:, c])[0]
            if len(met):
                yield b.filter(pa.array(own == c)), met


def _screen(ids: list[int], vectors: list[list[float] | None], groups: list | None, v: str, group: str | None, k: int | None, least: float | None, high: float | None, cell: str | None = None, probed: np.ndarray | None = None, floor: np.ndarray | None = None) -> Callable:
    """Items' rows with _no, the query's number, for pairs that may count: among a query's k best so far or at least `high`, and at least `least`.

    Products of matrices differ from dot() by rounding, within a bound by which what is kept goes too far. Vectors that are null, of
    another length, or not finite and of usual size are kept with all.

    probed: queries by cells, for a column `cell` of items: a query meets just the items of its cells. floor: a query's k-th best score so far.
    """

    def usable(x: list[float] | None) -> bool:
        return x is not None and len(x) > 0 and all(y is not None and abs(y) < 1e100 for y in x)

    sizes = Counter(len(x) for x in vectors if usable(x))
    dim = sizes.most_common(1)[0][0] if sizes else 0
    plain = np.array([usable(x) and len(x) == dim for x in vectors], bool)
    matrix = np.array([x if p else [0.0] * dim for x, p in zip(vectors, plain)], np.float64).reshape(len(vectors), dim)
    names = np.array(ids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = np.sqrt((matrix * matrix).sum(1))
        best = None if k is None else np.full((k, len(names)), -np.inf) if floor is None else np.tile(floor, (k, 1))
        for whole, met in _met(batches, len(names), cell, probed):
            its, size, usual = matrix[met], length[met], plain[met]
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                lists = b.column(v)
                fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False)) & (dim > 0)
                flat = lists.filter(pa.array(fits)).flatten().cast(pa.float64())
                x = np.zeros((b.num_rows, dim))
                x[fits] = np.asarray(pc.fill_null(flat, np.nan)).reshape(-1, dim)
                with np.errstate(invalid="ignore"):
                    fits &= (np.abs(x) < 1e100).all(1)
                x[~fits] = 0
                score = x @ its.T
                slack = 8 * dim * 2.0**-53 * size * np.sqrt((x * x).sum(1)).max(initial=0.0)
                score[:, ~usual] = -np.inf
                score[~fits] = -np.inf
                allowed = np.ones(score.shape, bool)
                if group is not None:
                    mine = b.column(group).to_pylist()
                    theirs = [groups[i] for i in met]
                    place = {g: i for i, g in enumerate(dict.fromkeys(g for g in [*mine, *theirs] if g is not None))}
                    here, there = (np.array([place.get(g, -1) for g in side]) for side in (mine, theirs))
                    allowed = (here[:, None] != there[None, :]) & (here >= 0)[:, None] & (there >= 0)[None, :]
                    score[~allowed] = -np.inf
                keep = np.ones(score.shape, bool) if least is None else score >= least - slack
                if best is not None:
                    some = np.nonzero((score > best[0, met]).any(0))[0]
                    best[:, met[some]] = np.partition(np.concatenate([best[:, met[some]], score[:, some]]), b.num_rows, axis=0)[b.num_rows :]
                    among = score >= best[0, met] - slack
                    keep &= among if high is None else among | (score >= high - slack)
                keep = (keep | ~usual[None, :] | ~fits[:, None]) & allowed
                row, column = np.nonzero(keep)
                for cut in range(0, len(row), 20_000):
                    part = b.take(pa.array(row[cut : cut + 20_000]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names[met[column[cut : cut + 20_000]]])], [*part.schema.names, "_no"])

    return run


def scored_pairs(queries: DataFrame, items: DataFrame, least: float | None = None, key: str = "query_id", q: str = "q", v: str = "v", k: int | None = None, high: float | None = None, apart: tuple[str, str] | None = None) -> Iterator[DataFrame]:
    """All columns of both sides and score, a block of at most about BLOCK counted queries at a time; vectors are dropped. No pair of less than `least`.

    k: pairs that are neither among their query's k best, ties included, nor of at least `high` may be missing; each task finds them by products of matrices, and only what it keeps is scored and shuffled.
    apart: columns of queries and items that must differ.
    """
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    for part in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == part)
        own = stored(own.withColumn("_no", F.monotonically_increasing_id()))
        block = own.select("_no", F.col(q).alias("q"), (F.lit(None) if apart is None else F.col(apart[0])).alias("g")).collect()
        screen = _screen([r["_no"] for r in block], [r["q"] for r in block], [r["g"] for r in block], v, None if apart is None else apart[1], k, least, high)
        schema = StructType([*items.schema.fields, StructField("_no", LongType())])
        pairs = items.mapInArrow(screen, schema).join(F.broadcast(own), "_no").withColumn("score", dot(F.col(q), F.col(v))).drop("_no", q, v)
        yield pairs if least is None else pairs.where(F.col("score") >= least)


def top_k(queries: DataFrame, items: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """VEC-01: query_id, item_id, score, rank: the k items of the largest inner product, ties by item_id. queries and items: (query_id, q) and (item_id, v)."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id"))
    best = [x.select("query_id", "item_id", "score").withColumn("rank", rank).where(F.col("rank") <= k) for x in scored_pairs(queries, items, least, k=k)]
    return reduce(DataFrame.unionByName, best)


def nearest_centroids(items: DataFrame, cents: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """VEC-06, VEC-10: items' columns but v, with centroid and score: the k nearest of each, ties by centroid. cents: (centroid, c).

    Every block of counted centroids is one row that goes to all tasks; an item keeps its best k without a shuffle.
    """
    n = cents.count()
    blocks = max(1, -(-n // BLOCK))
    best = F.expr("cast(array() as array<struct<s:double,centroid:bigint>>)")
    out = items.withColumn("_best", best)
    for part in range(blocks):
        own = cents if blocks == 1 else cents.where(F.pmod(F.xxhash64("centroid"), F.lit(blocks)) == part)
        row = F.broadcast(own.agg(F.collect_list(F.struct(F.col("centroid").cast("long").alias("centroid"), "c")).alias("_cents")))
        found = F.transform("_cents", lambda x: F.struct((-dot(F.col("v"), x["c"])).alias("s"), x["centroid"].alias("centroid")))
        found = found if least is None else F.filter(found, lambda x: x["s"] <= -least)
        out = out.crossJoin(row).withColumn("_best", F.slice(F.array_sort(F.concat("_best", found)), 1, k)).drop("_cents")
    out = out.drop("v").withColumn("_b", F.explode("_best"))
    return out.withColumn("centroid", F.col("_b.centroid")).withColumn("score", -F.col("_b.s")).drop("_b", "_best")


def similarity_edges(pairs: DataFrame, high: float = 0.85, low: float = 0.80, fill: int = 3) -> DataFrame:
    """VEC-04: of scored pairs (src, dst, score) all of at least high, and where a source has fewer than fill of these, the best from low up to fill."""
    own = Window.partitionBy("src")
    rank = F.row_number().over(own.orderBy(F.desc("score"), "dst"))
    rows = pairs.where(F.col("score") >= low).withColumn("n", F.count_if(F.col("score") >= high).over(own)).withColumn("r", rank)
    return rows.where((F.col("score") >= high) | ((F.col("n") < fill) & (F.col("r") <= fill))).select("src", "dst", "score")


def centroids(items: DataFrame, group: str) -> DataFrame:
    """VEC-05, second half: group, v: the normalised mean of each group's vectors, by position."""
    each = items.select(group, F.posexplode("v").alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    means = each.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v"))
    return normalised(means, "v")


def mean_pair_cosine(items: DataFrame, group: str) -> DataFrame:
    """AGG-33: group, n, mean cosine of all pairs of unit vectors, from the length of their sum; no pair is formed."""
    sums = items.select(group, F.posexplode("v").alias("i", "x")).groupBy(group, "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("q"), F.count(F.lit(1)).alias("n"))
    out = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("s"), F.sum("q").alias("q"), F.max("n").alias("n"))
    return out.select(group, "n", F.when(F.col("n") > 1, (F.col("s") - F.col("q")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("mean_cosine"))


def clustered(items: DataFrame, k: int = 700, seed: int = 42, rounds: int = 20) -> DataFrame:
    """VEC-05: cluster, c: normalised centroids of k-means on unit vectors (id, v); k is at most the number of items less one, two at least."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = normalised(items, "v").withColumn("features", array_to_vector(F.transform("v", lambda x: x.cast("double"))))
    n = items.count()
    model = KMeans(k=min(k, max(2, n - 1)), seed=seed, maxIter=rounds).fit(unit.select("features"))
    cents = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return normalised(items.sparkSession.createDataFrame(cents, "cluster long, c array<double>"), "c")


def cluster_expansion(seeds: DataFrame, members: DataFrame, most_seeds: int = 15, least: float = 0.6, top: int = 5, decay: float = 0.2) -> DataFrame:
    """VEC-09: id, score, support of the members that a query's best seeds bring in.

    seeds: id, sim, all of them; members: id, cluster, score, v (unit), a row for each cluster of a term. The most_seeds most similar seeds
    bring in, from their best cluster, their `top` nearest members of inner product `least` or more that are no seeds; a member's score is the
    largest of decay x seed similarity x inner product. Ties go to the smaller id.
    """
    best = Window.partitionBy("id").orderBy(F.desc("score"), "cluster")
    home = members.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("id", F.col("cluster").alias("c"), F.col("v").alias("q"))
    chosen = seeds.orderBy(F.desc("sim"), "id").limit(most_seeds).join(home, "id").select(F.col("id").alias("seed"), "sim", "c", "q")
    others = members.join(seeds.select("id"), "id", "left_anti").select("id", "cluster", "v").distinct()
    pairs = others.join(F.broadcast(chosen), F.col("cluster") == F.col("c")).withColumn("near", dot(F.col("q"), F.col("v"))).where(F.col("near") >= least)
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("near"), "id"))
    kept = pairs.withColumn("_r", rank).where(F.col("_r") <= top).withColumn("score", decay * F.col("sim") * F.col("near")).where("score > 0")
    return kept.groupBy("id").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("support"))


def dense_expansion(seeds: DataFrame, items: DataFrame, k: int = 24, family: DataFrame | None = None) -> DataFrame:
    """VEC-12: seed, id, score: of each seed's k nearest items those near enough to it and to its anchor that are no seeds; 3 of a strong seed, 2 of another, 1 of a weak one.

    seeds: seed, q (unit), anchor (unit vector), tier (weak or not), strong; items: id, v (unit). Least similarity 0.80 and 0.72 to the anchor, 0.84 and 0.78 for weak seeds.
    family: seed, m (unit), a row for each landed member of the seed's anchor: what the family backs with less than 0.68 (weak seeds: 0.74) is left out; seeds without family let all through. A family has a handful of members.
    """
    mine = seeds.select(F.col("seed").alias("query_id"), "q", "anchor", "tier", "strong")
    weak = F.col("tier") == "weak"
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    out = []
    for pairs in scored_pairs(mine, items.withColumn("_v", F.col("v")), k=k):
        near = pairs.withColumn("_near", dot(F.col("anchor"), F.col("_v"))).withColumn("_k", rank).where(F.col("_k") <= k)
        near = near.where((F.col("score") >= F.when(weak, 0.84).otherwise(0.80)) & (F.col("_near") >= F.when(weak, 0.78).otherwise(0.72)))
        free = near.join(seeds.select(F.col("seed").alias("id")), "id", "left_anti")
        if family is not None:
            backed = free.select(F.col("query_id").alias("seed"), "id", "_v").join(family, "seed").select(F.col("seed").alias("query_id"), "id", dot(F.col("_v"), F.col("m")).alias("sim"))
            free = free.join(family_support(backed, "query_id", "id"), ["query_id", "id"], "left")
            free = free.where(F.col("family_support").isNull() | (F.col("family_support") >= F.when(weak, 0.74).otherwise(0.68)))
        keep = F.when(weak, 1).when(F.col("strong"), 3).otherwise(2)
        out.append(free.withColumn("_r", rank).where(F.col("_r") <= keep).select(F.col("query_id").alias("seed"), "id", "score"))
    return reduce(DataFrame.unionByName, out)
