"""Product codes of vectors: integer parts, a small codebook for each part position, exact nearest entries.

A component x is the integer floor(4096 x); a vector is cut into equal consecutive parts, each replaced by the index of its
nearest codebook entry. Codebooks are fitted by rounds of assignment and floored means over all rows. Everything that
decides is integer arithmetic, so results don't depend on how rows are dealt out.

Nearest entries are found by screening. With c an entry and x a part, c.c - 2 x.c orders entries as their distances do.
One float32 matrix product per part position gives all x.c; the inner product of w integers, each rounded to float32 and
summed in any order, is off by at most g |x| |c| with g = (w + 2) u / (1 - (w + 2) u), u = 2 ** -24. That and the rounding
of the float64 operations that follow give each entry an interval that holds its true value. Entries whose interval
reaches below the lowest upper end are evaluated anew in int64, and of the lowest the first index is taken. All others
are farther for certain. Distances that are put out are int64 sums, too.

A round is a pass over the table: each task sends one row per used entry (parts x entries at most), Spark adds them up, and
the driver gets the sums of parts x entries. Codebooks travel inside of the function, parts x entries x width numbers.

Defined cases: rows with a null vector, a null or non-finite component are dropped; of null or repeated ids, nulls are
last and repeated ones in the order of their vectors when the first entries are taken; with fewer kept rows than entries
there are as many entries as rows; an empty vector has empty parts, all at distance 0; an empty table gives no rows; null
labels are one group; further columns are ignored. Vectors of different lengths, a length that parts don't divide, and
components whose squared distances don't fit in 64 bits (from about 2 ** 17 for parts of 8 components) raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors worked on at once.
ROWS_AT_ONCE = 8192
CODED = "vec_id long, label {label}, code string, error long"
_SUMS = "part int, entry int, n long, sums array<long>"
_U32, _U64 = 2.0**-24, 2.0**-53


def kept(vectors: DataFrame) -> DataFrame:
    """The rows whose vector and all of its components are there and finite."""
    x = F.col("embedding")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return vectors.where(x.isNotNull() & F.forall(x, finite))


def limit(width: int) -> int:
    """The largest integer component: width squares of twice that fit in 63 bits."""
    return int((((1 << 63) - 1) / max(width, 1)) ** 0.5 / 2) - 1


def integers(column: pa.Array, size: int, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) as rows x parts x width."""
    lengths = column.value_lengths().to_numpy()
    if (lengths != size).any():
        raise ValueError(f"vectors have {size} components, but one has {int(lengths[lengths != size][0])}")
    x = np.floor(column.flatten().to_numpy().astype(np.float64) * scale)
    width = size // parts
    if len(x) and np.abs(x).max() > limit(width):
        raise ValueError(f"components beyond {limit(width)} / {scale} have squared distances of more than 64 bits")
    return x.astype(np.int64).reshape(len(column), parts, width)


def screened(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For parts x (n, w) and entries (e, w): c.c - 2 x.c and the radius of its interval, (n, e), and the squares x.x, c.c in float64."""
    n, w = x.shape
    with np.errstate(under="ignore"):
        dot = (x.astype(np.float32) @ entries.astype(np.float32).T).astype(np.float64)
    xx = np.einsum("ij,ij->i", x, x).astype(np.float64)
    cc = np.einsum("ij,ij->i", entries, entries).astype(np.float64)
    value = cc[None, :] - 2 * dot
    g = (w + 2) * _U32 / (1 - (w + 2) * _U32)
    # Norms are rounded, hence the factor; their product bounds the sum of |x_i c_i| (Cauchy and Schwarz).
    reach = np.sqrt(xx)[:, None] * np.sqrt(cc)[None, :] * (1 + 16 * _U64)
    radius = (2 * g * reach + 8 * _U64 * (cc[None, :] + 2 * (1 + g) * reach)) * (1 + 16 * _U64)
    return value, radius, xx, cc


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The index of each part's nearest entry, the first of equals."""
    value, radius, _, _ = screened(x, entries)
    open_ = value - radius <= (value + radius).min(1)[:, None]
    best = open_.argmax(1)
    rows = np.flatnonzero(open_.sum(1) > 1)
    if len(rows):
        r, c = np.nonzero(open_[rows])
        gap = x[rows[r]] - entries[c]
        exact = np.full((len(rows), len(entries)), np.iinfo(np.int64).max)
        exact[r, c] = np.einsum("ij,ij->i", gap, gap)
        best[rows] = exact.argmin(1)  # the first of the lowest
    return best


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


def _sums(rows: DataFrame, books: np.ndarray, size: int, scale: int) -> list:
    """part, entry, n, sums over all rows, by their nearest entries."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in _slices(batches):
            x = integers(b.column("embedding"), size, parts, scale)
            for p in range(parts):
                best = nearest(x[:, p], books[p])
                n[p] += np.bincount(best, minlength=entries)
                by = np.argsort(best, kind="stable")
                used, first = np.unique(best[by], return_index=True)
                sums[p, used] += np.add.reduceat(x[by, p], first, axis=0)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"]
        )

    total = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(width)]
    return rows.select("embedding").mapInArrow(run, _SUMS).groupBy("part", "entry").agg(F.sum("n").alias("n"), *total).collect()


def codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray | None:
    """parts x entries x width integers fitted to the kept rows; None if there are none."""
    rows = kept(vectors)
    first = rows.select("vec_id", "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).collect()
    if not first:
        return None
    size = len(first[0]["embedding"])
    if size % parts:
        raise ValueError(f"vectors of {size} components don't have {parts} equal parts")
    given = pa.array([list(r["embedding"]) for r in first], pa.list_(pa.float64()))
    books = np.ascontiguousarray(integers(given, size, parts, scale).transpose(1, 0, 2))
    for _ in range(rounds if size else 0):
        new = books.copy()
        for r in _sums(rows, books, size, scale):
            new[r["part"], r["entry"]] = [int(r[f"s{k}"]) // r["n"] for k in range(books.shape[2])]
        books = new
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encoded(vectors: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distance to the decoded vector) of the kept rows."""
    parts, _, width = books.shape
    hexes = np.array([f"{k:02x}" for k in range(256)])
    label = vectors.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            x = integers(b.column("embedding"), parts * width, parts, scale)
            error, code = np.zeros(len(x), np.int64), np.full(len(x), "", f"<U{2 * parts}")
            for p in range(parts):
                best = nearest(x[:, p], books[p])
                gap = x[:, p] - books[p][best]
                part = np.einsum("ij,ij->i", gap, gap)
                if (error > np.iinfo(np.int64).max - part).any():
                    raise ValueError("an error has more than 64 bits")
                error += part
                code = np.char.add(code, hexes[best])
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(code), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return kept(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding").mapInArrow(run, CODED.format(label=label.simpleString()))


def decoded(codes: Column, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vectors that codes stand for, as array<double>: entries in turn, divided by scale."""
    flat = F.array(*[F.array(*[F.array(*[F.lit(int(v) / scale) for v in entry]).cast("array<double>") for entry in book]) for book in books])
    indexes = F.transform(F.sequence(F.lit(0), F.lit(len(books) - 1)), lambda p: F.get(F.get(flat, p), F.conv(F.substring(codes, 2 * p + 1, F.lit(2)), 16, 10).cast("int")))
    return F.flatten(indexes)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the kept rows of vectors (vec_id, embedding, label)."""
    if not 0 < entries <= 256:
        raise ValueError("a part's code has two hex digits: 1 to 256 entries")
    books = codebooks(vectors, parts, entries, rounds, scale)
    if books is None:
        schema = T.StructType([T.StructField(n, t) for n, t in (("vec_id", T.LongType()), ("code", T.StringType()), ("error", T.LongType()), ("label_error", T.LongType()), ("codebooks_sha256", T.StringType()))])
        return vectors.sparkSession.createDataFrame([], schema)
    rows = cut(encoded(vectors, books, scale))
    # Summed before the shuffle and stored; a hot label's share of the join's other side can then be split.
    sums = cut(rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    found = rows.join(small(sums, sums.count(), 32), F.col("label").eqNullSafe(F.col("of")), "left")
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
