"""Best-fit packing of token sequences by large-item matching.

A document is its token ids and one end id; only longer ones than a sequence are cut. Packing needs nothing but the
number of pieces of each length, at most one count per length whatever the input, so the plan is made from that
histogram: pieces above a third of a sequence, of which two at most share one, are matched greedily, largest first
with the largest that still fits; smaller ones go, largest first, into the tightest gap left, and into new sequences
where none is. The plan says for runs of equal pieces, by their rank, which sequences and places they take. Pieces
get ranks from a range sort by (length, doc_id, piece), which splits a length that many pieces share.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions
from .word_bpe import WordBpe
from .words import ragged, release, slices

CAPACITY = 2048
#: Bytes of text worked on at once.
SLICE_BYTES = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

_tokenizers: dict = {}


def word_ids(path: str) -> WordBpe:
    """A worker's tokenizer; what it remembers serves all of the worker's tasks."""
    if path not in _tokenizers:
        _tokenizers[path] = WordBpe(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, remember: bool = True) -> DataFrame:
    """PIECES of every document; tokenizer_path must be there on every executor. remember: workers keep the tokenizer and its words from task to task, else they let go of it, for what else they serve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_ids(tokenizer_path)
        for part in slices(batches, size=SLICE_BYTES):
            flat, offsets = tok.ids(part.column("text"))
            flat = flat.astype("<u4")
            n = np.diff(offsets)
            cuts = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), cuts)
            piece = ragged(cuts)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            at = offsets[:-1][doc] + start
            crc = [zlib.crc32(flat[a : a + k]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )
        if not remember:
            _tokenizers.clear()
            del tok
            release()

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): of the pieces of a length, those ranks take a sequence each from there on."""
    left = {k: n for k, n in counts.items() if n}
    taken: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: runs of (first sequence, number)
    open_gaps: list[int] = []
    out: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, n: int, first: int, gap: int) -> None:
        out.append((length, taken[length], n, first, capacity - gap))
        taken[length] += n
        left[length] -= n

    def freed(gap: int, first: int, n: int) -> None:
        if gap:
            if not gaps[gap]:
                bisect.insort(open_gaps, gap)
            gaps[gap].append((first, n))

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        at = bisect.bisect_right(large, min(length, capacity - length)) - 1
        while left[length]:
            while at >= 0 and not (left[large[at]] > (large[at] == length)):
                at -= 1
            if at < 0:
                n, partner = left[length], 0
            else:
                partner = large[at]
                n = left[length] // 2 if partner == length else min(left[length], left[partner])
            put(length, n, sequences, capacity)
            if partner:
                put(partner, n, sequences, capacity - length)
            freed(capacity - length - partner, sequences, n)
            sequences += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(open_gaps, length)
            if at < len(open_gaps):
                gap = open_gaps[at]
                first, n = gaps[gap].pop()
                k = min(n, left[length])
                if k < n:
                    gaps[gap].append((first + k, n - k))
                elif not gaps[gap]:
                    open_gaps.pop(at)
                put(length, k, first, gap)
                freed(gap - length, first, k)
            else:
                each = capacity // length
                n = max(1, left[length] // each)
                held = min(each, left[length])
                for i in range(held):
                    put(length, n, sequences, capacity - i * length)
                freed(capacity - held * length, sequences, n)
                sequences += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, remember: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    spark = docs.sparkSession
    cut_pieces = cut(pieces(docs, tokenizer_path, capacity, remember))
    ranged = cut_pieces.repartitionByRange(shuffle_partitions(spark), "length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    place = F.monotonically_increasing_id()
    ranged = cut(ranged.withColumn("_place", place))
    part = F.shiftright("_place", 33)
    # One row for each partition and length that it holds: partitions are ranges of length, so few more than partitions and lengths.
    held = ranged.groupBy(part.alias("part"), "length").count().orderBy("part", "length").collect()
    counts: dict[int, int] = defaultdict(int)
    sizes: dict[int, int] = defaultdict(int)
    for r in held:
        counts[r["length"]] += r["count"]
        sizes[r["part"]] += r["count"]
    first_of_part, at = {}, 0
    for p in sorted(sizes):
        first_of_part[p], at = at, at + sizes[p]
    first_of_length, at = {}, 0
    for k in sorted(counts):
        first_of_length[k], at = at, at + counts[k]
    steps = sorted((first_of_length[k] + rank, first, offset) for k, rank, _, first, offset in plan(counts, capacity))
    begins, firsts, offsets = (np.array(x, np.int64) for x in (zip(*steps, strict=True) if steps else ((), (), ())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            place = b.column("_place").to_numpy()
            own = place >> 33
            distinct, inverse = np.unique(own, return_inverse=True)
            g = np.array([first_of_part[int(p)] for p in distinct], np.int64)[inverse] + (place & ((1 << 33) - 1))
            k = np.searchsorted(begins, g, "right") - 1
            more = [pa.array(firsts[k] + g - begins[k]), pa.array(offsets[k])]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(5)] + more, names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranged.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
