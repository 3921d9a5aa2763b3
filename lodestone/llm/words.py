"""Vectorised words for Arrow batches: runs of anything but ASCII white space, A-Z in lower case where asked."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text is worked on in slices of about this many bytes (one document at least), so that memory stays level.
SLICE_BYTES = 2 << 20


def release() -> None:
    """Give memory that is no longer used back to the system; workers go on to other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(lengths), 0
        while at < len(lengths):
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(at, to - at)
            at = to
    release()


def split_words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in turn, and where each text's words begin (one entry more than texts)."""
    texts = pc.fill_null(texts, "")
    texts = pc.ascii_lower(texts) if lower else texts
    lists = pc.ascii_split_whitespace(texts)
    words, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not real.all():  # white space at either end
        before = np.concatenate([[0], np.cumsum(real)])
        words, offsets = words.filter(pa.array(real)), before[offsets]
    return words, offsets


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each word as its place among the distinct words, and these."""
    d = pc.dictionary_encode(words)
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


_FNV, _MIX_1, _MIX_2 = np.uint64(0x100000001B3), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(31))


def hashed(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, the same in every process."""
    if isinstance(distinct, pa.ChunkedArray):
        distinct = distinct.combine_chunks()
    n = len(distinct)
    if n == 0:
        return np.zeros(0, np.uint64)
    import pandas as pd

    return mixed(pd.util.hash_array(np.asarray(distinct.to_pylist(), dtype=object), categorize=False))


def chained(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words that begins at each place but the last n - 1."""
    out = hashes[: max(0, len(hashes) - n + 1)].copy()
    for k in range(1, n):
        out = mixed(out * _FNV + hashes[k : k + len(out)])
    return out


def ragged(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. length - 1 for each length in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
