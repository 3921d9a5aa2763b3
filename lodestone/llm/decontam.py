"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased and stripped to letters and digits. Every run of SEED_WORDS words of a test item is a seed, however
many documents hold it, so an item that leaked into very many documents still has all of its seeds. Where a document has
a seed, the item is aligned to that part of the document by words (match 1, mismatch and gap -0.5), so edited or
paraphrased copies score too. score = best local alignment / words of the item. Parts of documents that share too few
words with the item to reach the threshold are set aside before they are aligned, exactly.

Items come in blocks of at most BLOCK_SEEDS seeds, each a pass over the documents, so what is sent to executors is
bounded however large the benchmark is. Hits of one document never leave its task.

Defined cases: null or empty texts and items match nothing; an item shorter than a seed is one seed; items without an
item_id are matched like others and reported with a null id, the best of them in one row; repeated documents, and rows
that share a doc_id or have none, each get their own rows; a repeated item_id gives one row per document and id, the
best (of equal scores the first in the item's order, then in the text); an empty table gives no rows; further columns
are ignored. The filter drops rows, not ids: it decides on each row's text alone.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, whole_text
from .words import chained, coded, hashed, slices, split_words

SEED_WORDS = 3
THRESHOLD = 0.5
BLOCK_SEEDS = 1_000_000
RESULT = "doc_id long, item_id long, score double, first_word long, last_word long, seeds long"

_MATCH, _OTHER = 1.0, -0.5


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of the texts in turn, and where each text's words begin."""
    words, offsets = split_words(texts, lower=False)
    if not len(words):
        return np.zeros(0, np.uint64), offsets
    codes, distinct = coded(words)
    plain = pc.utf8_lower(pc.replace_substring_regex(distinct, r"[^\pL\pN]+", ""))
    real = pc.greater(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)[codes]
    h = hashed(plain)[codes]
    return h[real], np.concatenate([[0], np.cumsum(real)])[offsets].astype(np.int64)


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """The best local alignment's score, and the first and last word of text in it."""
    at = np.arange(len(text) + 1)
    gap = -_OTHER
    score = np.zeros(len(text) + 1)
    begin = at.copy()
    best = (0.0, 0, 0)
    for w in item:
        diagonal = np.concatenate([[0.0], score[:-1] + np.where(text == w, _MATCH, _OTHER)])
        up = score - gap
        new = np.maximum(diagonal, up)
        source = np.where(diagonal >= up, np.concatenate([[0], begin[:-1]]), begin)
        empty = new <= 0
        new[empty], source[empty] = 0.0, at[empty]
        # A run of gaps in the item: from the place to the left where the score less its gaps is largest.
        slope = new + gap * at
        high = np.maximum.accumulate(slope)
        place = np.maximum.accumulate(np.where(slope == high, at, 0))
        left = high - gap * at
        source = np.where(left > new, source[place], source)
        score, begin = np.maximum(new, left), source
        k = int(score.argmax())
        if score[k] > best[0]:
            best = (float(score[k]), int(begin[k]), k - 1)
    return best


def reachable(item: np.ndarray, text: np.ndarray, threshold: float) -> bool:
    """Whether an alignment's score can be threshold of the item's words: False only if it cannot.

    Each match takes a word of the item and an equal one of the text, so there must be as many of both. A score of that
    much leaves room for at most 2 (matches - score) mismatches and gaps, so they lie within so many words of the text.
    """
    need = threshold * len(item) - 1e-9
    if np.isin(item, text).sum() < need:
        return False
    shared = np.concatenate([[0], np.cumsum(np.isin(text, item))])
    span = min(len(text), math.ceil(3 * len(item) - 2 * need))
    return bool((shared[span:] - shared[: len(shared) - span]).max() >= need)


class Seeds:
    """Items of one block and the places of their seeds."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        hashes, item, at, length = [], [], [], []
        for i, (_, words) in enumerate(items):
            n = min(SEED_WORDS, len(words))
            if n:
                h = chained(words, n)
                hashes.append(h)
                item.append(np.full(len(h), i))
                at.append(np.arange(len(h)))
                length.append(np.full(len(h), n))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        self.hashes, self.item, self.at, self.length = cat(hashes, np.uint64), cat(item, np.int64), cat(at, np.int64), cat(length, np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.item, self.at, self.length = self.hashes[order], self.item[order], self.at[order], self.length[order]
        self.sizes = [int(x) for x in np.unique(self.length)]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The text, the word in it and the first entry of self.hashes for every seed in the texts."""
        text, place, seed = [], [], []
        for n in self.sizes:
            runs = chained(words, n)
            maybe = np.flatnonzero(self.seen[(runs & np.uint64((1 << 20) - 1)).astype(np.int64)])
            k = np.searchsorted(self.hashes, runs[maybe])
            k[k == len(self.hashes)] = 0
            good = (self.hashes[k] == runs[maybe]) & (self.length[k] == n)
            maybe, k = maybe[good], k[good]
            doc = np.searchsorted(offsets, maybe, "right") - 1
            inside = maybe + n <= offsets[doc + 1]
            text.append(doc[inside])
            place.append((maybe - offsets[doc])[inside])
            seed.append(k[inside])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return cat(text), cat(place), cat(seed)

    def aligned(self, words: np.ndarray, hits: list[tuple[int, int]], threshold: float) -> dict[int | None, tuple[float, int, int, int]]:
        """Of one text's hits (word, entry), by item id: score, first and last word and number of seeds where the score is threshold or more."""
        begins: dict[int, list[int]] = defaultdict(list)
        for place, k in hits:
            h = self.hashes[k]
            while k < len(self.hashes) and self.hashes[k] == h:
                begins[int(self.item[k])].append(place - int(self.at[k]))
                k += 1
        best: dict[int | None, tuple[float, int, int, int]] = {}
        for i, starts in sorted(begins.items()):
            name, item = self.items[i]
            starts.sort()
            slack = len(item) // 2 + 2
            group = [starts[0]]
            for s in [*starts[1:], None]:
                if s is not None and s - group[-1] <= slack:
                    group.append(s)
                    continue
                a, z = max(0, group[0] - slack), min(len(words), group[-1] + len(item) + slack)
                if reachable(item, words[a:z], threshold):
                    score, first, last = align(item, words[a:z])
                    got = (score / len(item), a + first, a + last, len(group))
                    if got[0] >= threshold and got[:1] > best.get(name, (0.0,))[:1]:
                        best[name] = got
                group = [s]
        return best

    def found(self, texts: pa.Array, threshold: float) -> Iterator[tuple[int, dict]]:
        """Each text that holds an item of the block, by its place in texts, and what aligned says of it."""
        words, offsets = plain_words(texts)
        text, place, k = self.hits(words, offsets)
        order = np.argsort(text, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(text[order])) + 1):
            if len(own):
                d = int(text[own[0]])
                got = self.aligned(words[offsets[d] : offsets[d + 1]], list(zip(place[own].tolist(), k[own].tolist(), strict=True)), threshold)
                if got:
                    yield d, got


def _blocks(benchmark: DataFrame, block_seeds: int) -> Iterator[Seeds]:
    held: list[tuple[int | None, np.ndarray]] = []
    n = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        words, _ = plain_words(pa.array([r["text"]], pa.string()))
        if len(words):
            held.append((r["item_id"], words))
            n += len(words)
        if n >= block_seeds:
            yield Seeds(held)
            held, n = [], 0
    if held:
        yield Seeds(held)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """RESULT: a row for each document and item of a score of threshold or more; words count from 0, the last included."""
    spark = docs.sparkSession
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    out, blocks = None, 0
    for seeds in _blocks(benchmark, block_seeds):
        sent = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                ids, row = b.column("doc_id"), b.column("row")
                rows = [(row[d].as_py(), ids[d].as_py(), name, *x) for d, got in sent.value.found(b.column("text"), threshold) for name, x in got.items()]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["row", *[x.split()[0] for x in RESULT.split(", ")]])

        got = mine.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"row long, {RESULT}")
        out = got if out is None else out.unionByName(got)
        blocks += 1
    if out is None:
        return spark.createDataFrame([], RESULT)
    if blocks > 1:  # an id whose items are in several blocks
        best = F.max(F.struct("score", (-F.col("first_word")).alias("f"), "last_word", "seeds")).alias("x")
        out = out.groupBy("row", "doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.score", (-F.col("x.f")).alias("first_word"), "x.last_word", "x.seeds")
    return out.select(*[x.split()[0] for x in RESULT.split(", ")])


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_seeds: int = BLOCK_SEEDS) -> DataFrame:
    """The rows that hold no test item; all columns stay. A row's text decides alone, in its own task."""
    spark = docs.sparkSession
    # Texts of another type are cast for the search; the column itself stays as it is.
    text = fresh(docs, "_searched")
    out = docs.withColumn(text, whole_text())
    for k, seeds in enumerate(_blocks(benchmark, block_seeds)):
        # What passed a block is stored before the next, so that a stage's workers hold one block only.
        out = cut(out) if k else out
        sent = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text):
                keep = np.ones(b.num_rows, bool)
                keep[[d for d, _ in sent.value.found(b.column(text), threshold)]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, out.schema)
    return out.select(*docs.columns)
