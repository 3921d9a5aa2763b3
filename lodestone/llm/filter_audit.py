"""What each of five text filters removes, alone and after others, and how much of all removals is its own (Shapley value).

Each row gets a mask of the filters that it fails. Per part (a value of source) the counts of at most 32 masks say all
that can be asked: let filter i be applied with probability x_i; the rows that go are on average

    R(x) = sum over masks m of n_m * (1 - product of (1 - x_i) for i in m),

the multilinear extension of "removed by a set of filters". Its coefficients are integers. R at a corner (a set of filters
applied for certain) is the number of rows that this set removes, so differences of corners give what a step of an order
removes; the integral of dR/dx_i along the diagonal, a sum of coefficients over monomials of i divided by their degree, is
the Shapley value of i, which times 5! is what i removes, summed over all orders. The same polynomials over the rows of
good or toxic labels give what is lost of them.

Rows are counted by (part, mask) before they are shuffled, so that a hot part costs nothing. Copies are found by a
256-bit digest of the text, of which only groups of two or more are joined back, broadcast if counted small, else by a
join whose large side is stored, so that Spark can split the share of a hot text.

Defined cases: a null text is empty, a null source the part ''; an empty text fails A only (and E, if repeated); a row of
null doc_id neither fails E nor makes others fail it, and has no label; of repeated doc_ids with one text none is the
smaller; several labels of a doc_id count as 1 if any is 1, null labels as 0; parts without rows, and thus empty tables,
give no rows; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small, whole_text

FILTERS = "ABCDE"
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
#: A part has 600 rows; so many parts are put out at once.
PARTS_AT_ONCE = 32

_WHITE = " \t\n\x0b\x0c\r"


def text_failures(text: Column, words: Column, bare: Column) -> Column:
    """The mask of A to D; words are those of bare, the text without white space at its ends."""
    n = F.when(bare == "", 0).otherwise(F.size(words)).cast("long")
    distinct = F.when(bare == "", 0).otherwise(F.size(F.array_distinct(words))).cast("long")
    capitals = F.regexp_count(text, F.lit("[A-Z]")).cast("long")
    tests = (n < 50, 100 * distinct < 65 * n, 100 * capitals > 5 * F.length(text), text.rlike("[#$%&*|]"))
    return sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit k: fails the k-th of FILTERS) for every row."""
    texts = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), whole_text().alias("x")).withColumn("bare", F.trim("x", F.lit(_WHITE)))
    texts = texts.withColumn("words", F.split("bare", r"[\x20\x09-\x0D]+"))
    own = text_failures(F.col("x"), F.col("words"), F.col("bare")).alias("mask")
    rows = cut(texts.select("doc_id", "part", F.unhex(F.sha2("x", 256)).alias("digest"), own))
    copies = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    repeated = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    found = rows.join(small(copies, copies.count(), 56), "digest", "left")
    return found.select("doc_id", "part", (F.col("mask") + F.when(repeated, 16).otherwise(0)).alias("mask"))


def counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: numbers of rows of each part and mask."""
    marked = labels.groupBy(F.col("doc_id").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    told = cut(marked.where("of is not null and (good = 1 or toxic = 1)"))
    found = rows.join(small(told, told.count(), 40), F.col("doc_id") == F.col("of"), "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return found.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("good"), total("toxic"))


class Removals:
    """Removal polynomials of k filters as integer matrices; sets of filters are masks."""

    def __init__(self, k: int):
        every = range(1 << k)
        size = [m.bit_count() for m in every]
        #: coefficient[m, s]: what a row of mask m adds to the coefficient of the monomial s of 1 - product of (1 - x_i).
        self.coefficient = np.array([[(-1) ** (size[s] + 1) if s and s & m == s else 0 for s in every] for m in every], np.int64)
        #: corner[s, t]: the monomial s where the filters of t are applied.
        self.corner = np.array([[int(s & t == s) for t in every] for s in every], np.int64)
        # dR/dx_i along the diagonal has t ** (|s| - 1) for each monomial s of i, whose integral from 0 to 1 is 1 / |s|.
        scaled = [[math.factorial(k) * Fraction(1, size[s]) if s >> i & 1 else Fraction(0) for i in range(k)] for s in every]
        assert all(f.denominator == 1 for row in scaled for f in row)
        self.share = np.array([[int(f) for f in row] for row in scaled], np.int64)

    def corners(self, n: np.ndarray) -> np.ndarray:
        """Rows removed by each set of filters, for rows of counts by mask."""
        return n @ self.coefficient @ self.corner

    def shapley(self, n: np.ndarray) -> np.ndarray:
        """k! times each filter's Shapley value."""
        return n @ self.coefficient @ self.share


def audit(counted: DataFrame, filters: str = FILTERS) -> DataFrame:
    """AUDIT for each part, each order of the filters (as letters, bit k is the k-th) and each step, from counts()."""
    k = len(filters)
    per_part = counted.groupBy("part").agg(*[F.collect_list(c).alias(c) for c in ("mask", "n", "good", "toxic")])  # at most 2 ** k each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Removals(k)
        orders = list(permutations(range(k)))
        letters = np.repeat([''.join(filters[i] for i in o) for o in orders], k)
        steps = np.tile(np.arange(1, k + 1), len(orders))
        filter_ = np.array(orders).ravel()
        before = np.array([sum(1 << i for i in o[:s]) for o in orders for s in range(k)])
        after = before | 1 << filter_
        full = (1 << k) - 1
        for whole in batches:
            for at in range(0, whole.num_rows, PARTS_AT_ONCE):
                b = whole.slice(at, PARTS_AT_ONCE)
                mask = b.column("mask")
                row = np.repeat(np.arange(b.num_rows), mask.value_lengths().to_numpy())
                place = mask.flatten().to_numpy()
                by_mask = np.zeros((3, b.num_rows, 1 << k), np.int64)
                for j, c in enumerate(("n", "good", "toxic")):
                    by_mask[j, row, place] = b.column(c).flatten().to_numpy()
                gone, good, toxic = (of.corners(n) for n in by_mask)
                removed = gone[:, after] - gone[:, before]
                alone = gone[:, 1 << filter_]
                columns = (
                    by_mask[0].sum(1)[:, None] - gone[:, after], removed, alone - removed, gone[:, [full]] - gone[:, full ^ 1 << filter_],
                    good[:, after] - good[:, before], toxic[:, after] - toxic[:, before], of.shapley(by_mask[0])[:, filter_],
                )
                part = b.column("part").take(pa.array(np.repeat(np.arange(b.num_rows), len(steps))))
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(np.tile(letters, b.num_rows)), pa.array(np.tile(steps, b.num_rows), pa.int32()), *[pa.array(c.ravel()) for c in columns]],
                    names=[f.split()[0] for f in AUDIT.split(", ")],
                )

    return per_part.mapInArrow(run, AUDIT)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of docs (doc_id, text, source) with labels (doc_id, quality, toxic)."""
    return audit(counts(masks(docs), labels))
