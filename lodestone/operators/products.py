"""Products of two sparse matrices kept as rows (row, col, value), in square blocks.

A join on the inner index makes a row of every chain, of which there are many more than cells of the product. Here nodes
are cut into stripes, and a task makes the product of one stripe of rows and one of columns, some rows at a time. A cell
of the factors is sent once for each stripe that meets it, in packed pieces of a few bytes a cell, so what is shuffled
grows with cells times stripes; there are as many stripes as keep what a task holds within bounds. Blocks that no chain
joins are never paired.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import dense_ids
from .storage import few, stored, written

#: Nodes of a stripe at most (columns have 16 bits), and at least, with up to STRIPES of them for the sake of parallel tasks.
WIDEST, SIZE, STRIPES = 1 << 16, 1024, 16
#: Cells of a stripe that a task holds, of each factor, four bytes each or, of many different values, ten. Cells of a packed piece.
HELD, PIECE = 40_000_000, 2_000_000
#: Cells of the product, and chains, that are in memory at once.
CELLS, CHAINS = 1 << 21, 1 << 16
#: Seconds of a chain one by one, of a multiplication in a dense product, and of a cell that is filled in for it: which way is used depends on them, not the result.
CHAIN_S, TIMES_S, FILL_S = 1.6e-8, 8e-11, 2e-9
_PIECES = "p int, q int, at binary, a binary, b binary, own binary"


def _squeezed(*parts: np.ndarray) -> bytes:
    """Arrays as bytes, zstandard; 16-bit ones with all low bytes first."""
    plain = b"".join((x.view(np.uint8).reshape(-1, 2).T if x.dtype == np.uint16 else x).tobytes() for x in parts)
    return np.uint64(len(plain)).tobytes() + pa.compress(plain, codec="zstd", asbytes=True)


def _plain(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int(np.frombuffer(data, np.uint64, 1)[0]), codec="zstd", asbytes=True)


def _short(data: bytes, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=at).reshape(2, -1).T).view(np.uint16).ravel()


def _packed_values(x: np.ndarray) -> bytes:
    """Values as places in a list of the different ones, or, if these are many, as they are."""
    different, places = np.unique(x.view(np.int64), return_inverse=True)
    if len(different) > WIDEST:
        return _squeezed(np.zeros(1, np.int64), x)
    return _squeezed(np.array([len(different)]), different, places.astype(np.uint16))


def _values(data: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    """Different values and places, or values and None."""
    plain = _plain(data)
    n = int(np.frombuffer(plain, np.int64, 1)[0])
    return (np.frombuffer(plain, np.float64, n, 8), _short(plain, 8 + 8 * n)) if n else (np.frombuffer(plain, np.float64, offset=8), None)


def _packed(size: int, most: int) -> Callable:
    """The cells of a block in pieces: how many cells each row has, steps from column to column, left and right factors, the cells' own values. Repeated cells are added up (null: none)."""

    def piece(key: tuple, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        at, places = np.unique(table.column("at").to_numpy(), return_inverse=True)
        columns = (at % size).astype(np.uint16)
        steps = columns.copy()
        steps[1:] -= columns[:-1]
        values = []
        for name in ("a", "b", "own"):
            x = table.column(name).to_numpy().astype(np.float64)
            none = np.isnan(x)
            sums = np.bincount(places, np.where(none, 0.0, x), len(at))
            sums[np.bincount(places, ~none, len(at)) == 0] = np.nan
            values.append(_packed_values(sums))
        rows = np.bincount(at // size, minlength=size).astype(np.uint32)
        return pa.RecordBatch.from_arrays(
            [pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([v], pa.binary()) for v in (_squeezed(rows, steps), *values)], ["p", "q", "at", "a", "b", "own"]
        )

    def block(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.select(["at", "a", "b", "own"]))
            n += batch.num_rows
            if n >= most:
                yield piece(key, held)
                held, n = [], 0
        if n:
            yield piece(key, held)

    return block


class _Piece:
    """Cells of a block by rows."""

    def __init__(self, size: int, at: bytes, values: bytes):
        plain = _plain(at)
        self.start = np.concatenate([[0], np.cumsum(np.frombuffer(plain, np.uint32, size), dtype=np.int64)])
        self.column = np.cumsum(_short(plain, 4 * size), dtype=np.uint16)
        self.x, self.place = _values(values)

    def plain(self) -> bool:
        """Whether all have a value of ordinary size above zero, of which no product vanishes."""
        return bool(len(self.x) and self.x.min() > 1e-100)  # false of nan, too

    def values(self, turned: Callable, at: slice | np.ndarray) -> np.ndarray:
        return turned(self.x[at]) if self.place is None else turned(self.x)[self.place[at]]

    def dense(self, turned: Callable, size: int, r0: int, r1: int) -> np.ndarray:
        first, last = self.start[r0], self.start[r1]
        out = np.zeros((r1 - r0, size))
        out[np.repeat(np.arange(r1 - r0), np.diff(self.start[r0 : r1 + 1])), self.column[first:last]] = self.values(turned, slice(first, last))
        return out


def _add_product(total: np.ndarray, x: _Piece, y: _Piece, turned: Callable, size: int, r0: int, r1: int) -> None:
    """total (rows r0 to r1 of a stripe by size) and the product of these rows of x with y: chain by chain, or dense if chains are many."""
    first, last = int(x.start[r0]), int(x.start[r1])
    if first == last:
        return
    middle = x.column[first:last]
    begin = y.start[middle]
    n = y.start[middle.astype(np.int64) + 1] - begin
    ends = np.cumsum(n)
    if not ends[-1]:
        return
    if ends[-1] * CHAIN_S > (r1 - r0) * size * size * TIMES_S + (r1 - r0 + size) * size * FILL_S:
        left, out = x.dense(turned, size, r0, r1), total.reshape(r1 - r0, size)
        for k in range(0, size, SIZE):
            out += left[:, k : k + SIZE] @ y.dense(turned, size, k, min(k + SIZE, size))
        return
    row = np.repeat(np.arange(r1 - r0, dtype=np.int64) * size, np.diff(x.start[r0 : r1 + 1]))
    a = x.values(turned, slice(first, last))
    shift = begin - (ends - n)
    if ends[-1] > len(y.column):  # each cell is used, so it is unpacked first
        to_column, to_value = y.column.astype(np.int64).take, y.values(turned, slice(None)).take
    else:
        to_column, to_value = lambda at: y.column[at].astype(np.int64), lambda at: y.values(turned, at)
    at = 0
    while at < len(n):
        before, many = int(ends[at] - n[at]), n[at : (to := max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + CHAINS, "right"))))]
        place = np.repeat(shift[at:to], many)
        place += np.arange(before, before + len(place))
        cell, value = to_column(place), to_value(place)
        cell += np.repeat(row[at:to], many)
        value *= np.repeat(a[at:to], many)
        np.add.at(total, cell, value)
        at = to


def _multiplied(size: int, upper: bool, factor: float, top: int | None) -> Callable:
    def block(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = key[0].as_py(), key[1].as_py()
        left: dict[int, list[_Piece]] = {}
        right: dict[int, list[_Piece]] = {}
        own: list[_Piece] = []
        for batch in batches:
            for n in range(batch.num_rows):
                k, at, a, b, o = (batch.column(c)[n].as_py() for c in ("k", "at", "a", "b", "own"))
                for held, values in ((left.setdefault(k, []), a), (right.setdefault(k, []), b), (own, o)):
                    if values is not None:
                        held.append(_Piece(size, at, values))
        pairs = [(x, y) for k in left for x in left[k] for y in right.get(k, [])]
        one, valued = np.ones_like, lambda x: (~np.isnan(x)).astype(np.float64)
        plain = factor > 0 and all(x.plain() for x in (*own, *(x for pieces in (*left.values(), *right.values()) for x in pieces)))
        filled = (lambda x: x) if plain else lambda x: np.where(np.isnan(x), 0.0, x)
        step = max(1, CELLS // size)
        for r0 in range(0, size, step):
            r1 = min(r0 + step, size)
            lines, columns = np.arange(r0, r1)[:, None], np.arange(size)

            def added(turned: Callable, times: float) -> np.ndarray:
                total = np.zeros((r1 - r0) * size)
                for x, y in pairs:
                    _add_product(total, x, y, turned, size, r0, r1)
                total *= times
                if i == j:
                    total.reshape(r1 - r0, size)[lines >= columns if upper else lines == columns] = 0
                for x in own:
                    first, last = x.start[r0], x.start[r1]
                    at = np.repeat(np.arange(r1 - r0) * size, np.diff(x.start[r0 : r1 + 1])) + x.column[first:last]
                    total[at] += x.values(turned, slice(first, last))
                return total.reshape(r1 - r0, size)

            total = added(filled, factor)
            there = total > 0 if plain else added(one, 1.0) > 0
            has = there if plain else added(valued, 1.0) > 0
            if top is not None and top < size:
                # Whatever is as large as a row's top-th value; null is last.
                ranked = np.where(has, total, np.where(there, -np.finfo(float).max, -np.inf))
                there = there & (ranked >= np.partition(ranked, size - top, axis=1)[:, size - top : size - top + 1])
            r, c = np.nonzero(there)
            if len(r):
                value = pa.array(total[r, c], mask=None if plain else ~has[r, c])
                yield pa.RecordBatch.from_arrays([pa.array(r + r0 + i * size), pa.array(c + j * size), value], ["i", "j", "value"])

    return block


def stripe(nodes: int, cells: int) -> int:
    """Nodes of a stripe: the first and the last have up to twice their share of the cells."""
    stripes = max(min(STRIPES, -(-nodes // SIZE)), -(-2 * cells // HELD), -(-nodes // WIDEST), 1)
    return max(1, -(-nodes // stripes))


def chained(edges: DataFrame, left: Column, right: Column, factor: float, own: Column | None = None, upper: bool = False, top: int | None = None, size: int | None = None) -> DataFrame:
    """src, dst, value: factor times the sum of left(first) * right(second) over chains of two edges (src, dst, and the columns used), from a node to another; null if no chain has a value. What repeated edges have is added up.

    own: what an edge itself adds, so that edges without chains are there, too. upper: only src < dst (for edges in both directions).
    top: each src keeps at least its `top` largest values and all ties of the last one, perhaps others: the exact cut follows.
    Nodes are numbered by their order, so nodes that lie close share blocks; size: nodes of a stripe, else as many as a task can hold.
    """
    kept = written(edges.select("src", "dst", left.cast("double").alias("a"), right.cast("double").alias("b"), (F.lit(0.0) if own is None else own).cast("double").alias("own")).where("src is not null and dst is not null"))
    ids = few(dense_ids(kept.select("src").unionByName(kept.select(F.col("dst").alias("src"))), "src"))
    nodes, cells = ids.count(), kept.count()
    size = size or stripe(nodes, cells)
    far = kept.join(ids.select("src", F.col("id").alias("_i")), "src").join(ids.select(F.col("src").alias("dst"), F.col("id").alias("_j")), "dst")
    at = (F.col("_i") % size) * size + F.col("_j") % size
    rows = far.select(F.floor(F.col("_i") / size).cast("int").alias("p"), F.floor(F.col("_j") / size).cast("int").alias("q"), at.alias("at"), "a", "b", "own")
    spread = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-cells // PIECE))
    blocks = stored(rows.repartition(spread, "p", "q").groupBy("p", "q").applyInArrow(_packed(size, PIECE), _PIECES))
    there = blocks.select("p", "q").distinct().collect()  # two numbers a block
    known = F.broadcast(edges.sparkSession.createDataFrame(there, "p int, q int"))
    none = F.lit(None).cast("binary")
    one = blocks.join(known.select(F.col("p").alias("q"), F.col("q").alias("j")), "q").select(F.col("p").alias("i"), "j", F.col("q").alias("k"), "at", "a", none.alias("b"), none.alias("own"))
    two = blocks.join(known.select(F.col("p").alias("i"), F.col("q").alias("p")), "p").select("i", F.col("q").alias("j"), F.col("p").alias("k"), "at", none.alias("a"), "b", none.alias("own"))
    met = one.unionByName(two)
    if own is not None:
        met = met.unionByName(blocks.select(F.col("p").alias("i"), F.col("q").alias("j"), F.lit(-1).alias("k"), "at", none.alias("a"), none.alias("b"), "own"))
    if upper:
        met = met.where("i <= j")
    after: dict[int, set[int]] = {}
    for r in there:
        after.setdefault(r["p"], set()).add(r["q"])
    tasks = sum(len(q.union(*(after.get(k, ()) for k in q))) for q in after.values())
    found = met.repartition(max(1, 2 * tasks), "i", "j").groupBy("i", "j").applyInArrow(_multiplied(size, upper, factor, top), "i long, j long, value double")
    named = found.join(ids.select(F.col("id").alias("i"), "src"), "i").join(ids.select(F.col("id").alias("j"), F.col("src").alias("dst")), "j")
    return named.select("src", "dst", "value")
