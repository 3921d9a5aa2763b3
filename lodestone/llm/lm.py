"""LM scoring by deleted interpolation.

The model mixes three maximum-likelihood estimates of a word w after v: c(v w) / c(v), c(w) / N and 1 / (V + 1). The
weights depend on how often v was seen (buckets of powers of two) and are learned by expectation-maximisation on
held-out counts: a tenth of the training texts is scored with its own counts deleted. EM runs on the driver over a
histogram of fixed size (bucket and two logarithms in steps of 1/8), whatever the corpus.

How counts get to texts: n-grams are 64-bit hashes. A task works on blocks of documents; for each block it sends its
sorted distinct n-grams, with counts, as one packed row per range of hashes. A range sums them over all blocks and
sends each block the sums for its own n-grams, in the same order. A common n-gram is one entry per block, so no key is
hot. The block's words travel as places in its word list; nothing is joined row by row.

Defined cases: a null or empty text is the end token alone; repeated rows count and are scored each; a null doc_id is
trained on; with nothing to learn from, every text has the uniform probability; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions
from .words import _FNV, coded, hashed, mixed, slices, split_words

BLOCK_BYTES = 10 << 20
#: N-grams that a range holds on average, up to a gigabyte of text; beyond, ranges grow with the square root of the input, to WIDEST
#: times as many, so that there are fewer rows of a block and a range. A row has an n-gram at least, so rows never outgrow the input.
RANGE_KEYS = 1 << 20
WIDEST = 4
BUCKETS = 48
STEPS = 8
#: Tokens that the weights of all buckets together count for in each.
STRENGTH = 20.0
_BITS = 64
_Q = 64 * STEPS
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_PACKED = "block long, r int, a binary, b binary, c binary, d binary"


def _pack(x: np.ndarray) -> bytes:
    """Length, width and compressed byte planes of an unsigned array."""
    x = np.ascontiguousarray(x)
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + bytes([x.itemsize]) + pa.compress(planes, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    n, width = int.from_bytes(blob[:8], "little"), blob[8]
    if not n:
        return np.zeros(0, f"<u{width}")
    planes = np.frombuffer(pa.decompress(blob[9:], n * width, codec="zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel()


def _pack_sorted(x: np.ndarray) -> bytes:
    return _pack(np.diff(x, prepend=np.uint64(0)))


def _unpack_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_unpack(blob), dtype=np.uint64)


#: Unigram keys are odd, bigram keys even. The start of a text is no word: its key is 0.
_END = (mixed(np.array([0x9E3779B97F4A7C15], np.uint64)) >> np.uint64(64 - _BITS)) | np.uint64(1)


def _word_keys(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) >> np.uint64(64 - _BITS)) | np.uint64(1)


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (mixed(mixed(before) * _FNV + word) >> np.uint64(64 - _BITS)) & ~np.uint64(1)


class Block:
    """Some documents: distinct word keys, each token's place among them, and where documents begin."""

    def __init__(self, words: np.ndarray, places: np.ndarray, offsets: np.ndarray):
        self.words, self.places, self.offsets = words, places, offsets

    @classmethod
    def of(cls, texts: pa.Array) -> Block:
        tokens, offsets = split_words(texts)
        codes, distinct = coded(tokens)
        keys, inverse = np.unique(np.concatenate([_word_keys(hashed(distinct)), _END]), return_inverse=True)
        places = np.insert(inverse[:-1][codes] if len(codes) else codes, offsets[1:], inverse[-1])
        return cls(keys, places.astype(np.uint32), offsets + np.arange(len(offsets)))

    def before(self) -> np.ndarray:
        """The place of the word before each token; len(words) at the start of a text."""
        out = np.empty(len(self.places), np.int64)
        out[1:] = self.places[:-1]
        out[self.offsets[:-1]] = len(self.words)
        return out

    def pairs(self) -> np.ndarray:
        known = np.concatenate([self.words, np.zeros(1, np.uint64)])
        return _pair_keys(known[self.before()], self.words[self.places])

    def per_token(self, per_document: np.ndarray) -> np.ndarray:
        return np.repeat(per_document, np.diff(self.offsets))


def _cuts(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The ranges that sorted keys fall into and where each begins (one more entry)."""
    r = (keys >> np.uint64(_BITS - bits)).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    return r[at], np.concatenate([at, [len(r)]])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, Block]]:
    k = 0
    for b in slices(batches, size=BLOCK_BYTES):
        yield (b.column("part")[0].as_py() << 24) | k, b, Block.of(b.column("text"))
        k += 1


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of _PACKED; what is missing at their ends is null."""
    cols = list(zip(*(x + (None,) * (6 - len(x)) for x in rows), strict=True))
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["block", "r", "a", "b", "c", "d"])


def _sent(bits: int):
    """Per block and range: its n-grams, and how often they are in training texts and in the deleted part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, b, block in _blocks(batches):
            fold = b.column("fold").to_numpy()
            token_fold = block.per_token(fold)
            pairs = block.pairs()
            keys, at = np.unique(np.concatenate([block.words, pairs]), return_inverse=True)
            at = np.concatenate([at[: len(block.words)][block.places], at[len(block.words) :]])
            both = np.concatenate([token_fold, token_fold])
            train = np.bincount(at[both > 0], minlength=len(keys)).astype(np.uint32)
            held = np.bincount(at[both == 2], minlength=len(keys)).astype(np.uint32)
            ranges, cuts = _cuts(keys, bits)
            rows = [(name, int(r), _pack_sorted(keys[i:j]), _pack(train[i:j]), _pack(held[i:j])) for r, i, j in zip(ranges, cuts[:-1], cuts[1:], strict=True)]
            for k in range(0, len(rows), 64):
                yield _rows(rows[k : k + 64])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: each block's own n-grams with their sums over all blocks; and, as block -1, training tokens and distinct words."""
    held: list[tuple] = []
    now = None

    def out() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        keys = [_unpack_sorted(x[1]) for x in held]
        all_keys, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = []
        for k in (2, 3):
            x = np.bincount(at, weights=np.concatenate([_unpack(y[k]) for y in held]), minlength=len(all_keys))
            sums.append(x.astype(np.uint64))
        word = (all_keys & np.uint64(1)) == 1
        total = np.array([sums[0][word].sum(), sums[1][word].sum(), (sums[0][word] > 0).sum()], np.uint64)
        rows, i = [(-1, now, total.tobytes())], 0
        for x, k in zip(held, keys, strict=True):
            own = at[i : i + len(k)]
            i += len(k)
            rows.append((x[0], now, _pack(sums[0][own]), _pack(sums[1][own])))
        held.clear()
        for k in range(0, len(rows), 64):
            yield _rows(rows[k : k + 64])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[1] != now:
                yield from out()
                now = row[1]
            held.append((row[0], row[2], row[3], row[4]))
    yield from out()


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block, before all ranges: ids, folds and sizes of its documents, its words, and the tokens as places."""
    for name, b, block in _blocks(batches):
        ids = b.column("doc_id").fill_null(0).to_numpy().view(np.uint64)
        fold = b.column("fold").to_numpy().astype(np.uint64) + np.uint64(4) * b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        docs = np.concatenate([ids, fold, np.diff(block.offsets).astype(np.uint64)])
        yield _rows([(name, -1, _pack(docs), _pack_sorted(block.words), _pack(block.places))])


def bucket(seen: np.ndarray) -> np.ndarray:
    return np.minimum(BUCKETS - 1, np.ceil(np.log2(seen + 1.0))).astype(np.int64)


def _steps(x: np.ndarray) -> np.ndarray:
    """Logarithms of counts or their ratios in steps of 1/STEPS, from 1; 0 for 0."""
    out = np.zeros(len(x), np.int64)
    some = x > 0
    out[some] = np.clip(np.rint(np.log2(x[some]) * STEPS) + _Q // 2, 1, _Q - 1)
    return out


def _ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block: documents, word counts, tokens and each token's pair count (r 0); the histogram of its deleted part (r 2)."""
    stream, counts = None, []

    def out() -> Iterator[pa.RecordBatch]:
        if stream is None:
            return
        name, _, docs, words, places, _ = stream
        sizes = np.split(_unpack(docs), 3)
        block = Block(_unpack_sorted(words), _unpack(places).astype(np.int64), np.concatenate([[0], np.cumsum(sizes[2].astype(np.int64))]))
        keys, at = np.unique(np.concatenate([block.words, block.pairs()]), return_inverse=True)
        train = np.concatenate([_unpack(x[0]) for x in counts])
        held = np.concatenate([_unpack(x[1]) for x in counts])
        if len(train) != len(keys):
            raise ValueError("a block's n-grams and counts differ: its documents were not read alike twice")
        n = len(block.words)
        pair = train[at[n:]]
        yield _rows([(name, 0, docs, _pack(train[at[:n]]), places, _pack(pair))])
        tokens = np.flatnonzero(block.per_token(sizes[1] & np.uint64(3)) == 2)
        if len(tokens):
            left = (train - held).astype(np.float64)
            known = np.concatenate([left[at[:n]], [0.0]])
            before = block.before()[tokens]
            # How often texts start is not in any block; it is added on the driver.
            start = before == n
            v, w, vw = known[before], known[block.places[tokens]], left[at[n:][tokens]]
            ratio = np.divide(vw, v, out=np.zeros(len(v)), where=v > 0)
            code = (np.where(start, BUCKETS, bucket(v)) * _Q + _steps(np.where(start, vw, ratio))) * _Q + _steps(w)
            distinct, k = np.unique(code, return_counts=True)
            yield _rows([(name, 2, _pack(distinct.astype(np.uint64)), _pack(k.astype(np.uint64)))])

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] == -1:
                yield _rows([row])
            elif row[1] == -1:
                yield from out()
                stream, counts = row, []
            else:
                counts.append((row[2], row[3]))
    yield from out()


def expectation_maximisation(histogram: dict[int, int], tokens: int, distinct: int, starts: int, rounds: int = 60) -> np.ndarray:
    """Weights (bucket, estimate) of pair, word and uniform estimates, from the coded histogram of held-out tokens."""
    weights = np.tile([0.0, 0.5, 0.5], (BUCKETS, 1))
    if not histogram or tokens <= 0:
        return weights
    code = np.array(sorted(histogram), np.int64)
    n = np.array([histogram[int(c)] for c in code], np.float64)
    b, pair, word = code // (_Q * _Q), code // _Q % _Q, code % _Q
    value = lambda x: np.where(x > 0, 2.0 ** ((x - _Q // 2) / STEPS), 0.0)
    p = np.stack([value(pair), value(word) / tokens, np.full(len(code), 1.0 / (distinct + 1))], 1)
    start = b == BUCKETS
    p[start, 0] /= max(1, starts)
    b = np.where(start, bucket(np.array([float(starts)]))[0], b)

    def learned(rows: np.ndarray, before: np.ndarray, strength: float) -> np.ndarray:
        w = before
        for _ in range(rounds):
            mix = p[rows] * w
            w = (n[rows, None] * mix / mix.sum(1, keepdims=True)).sum(0) + strength * before
            w /= w.sum()
        return w

    # A bucket of few tokens stays near the weights of all, and no weight becomes 0.
    even = np.full(3, 1 / 3)
    seen = learned(b > 0, even, 1.0) if (b > 0).any() else even
    for k in range(BUCKETS):
        weights[k] = learned(b == k, seen if k else even, STRENGTH)
    weights[0, 0] = 0.0  # nothing was seen after such a word
    weights[0] /= weights[0].sum()
    return weights


def score(docs: DataFrame, fold: Column) -> DataFrame:
    """RESULT for every row of docs; fold: 0 held out, 1 training, 2 training and the part that weights are learned on."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), fold.cast("int").alias("fold"))
    # The scan's own partition, the same in both readings: a block is named by it and its place in it.
    rows = rows.withColumn("part", F.spark_partition_id().cast("long"))
    size = rows.agg(F.sum(F.octet_length("text")), F.sum((F.col("fold") > 0).cast("long")), F.sum((F.col("fold") == 2).cast("long"))).first()
    text_bytes = size[0] or 0
    wide = min(WIDEST, max(1.0, (text_bytes / 2.0**30) ** 0.5))
    bits = max(0, int(np.ceil(np.log2(max(1.0, text_bytes / 6 / (RANGE_KEYS * wide))))))
    parts = shuffle_partitions(spark)
    sums = rows.mapInArrow(_sent(bits), _PACKED).repartition(parts, "r").sortWithinPartitions("r").mapInArrow(_summed, _PACKED)
    both = sums.unionByName(rows.mapInArrow(_streams, _PACKED)).repartition(parts, "block").sortWithinPartitions("block", "r")
    ready = cut(both.mapInArrow(_ready, _PACKED))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("a").to_pylist()), np.int64).reshape(-1, 3).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in x], names=["x", "y", "z"])

    totals = ready.where("block = -1").select("a").mapInArrow(summed, "x long, y long, z long").agg(F.sum("x"), F.sum("y"), F.sum("z")).first()
    tokens, deleted, distinct = (int(x or 0) for x in totals)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, int] = {}
        for b in batches:
            for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
                for k, n in zip(_unpack(x).tolist(), _unpack(y).tolist(), strict=True):
                    sums[k] = sums.get(k, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], names=["code", "n"])

    coded_rows = ready.where("block >= 0 and r = 2").select("a", "b").mapInArrow(unpacked, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    histogram = {r["code"]: r["n"] for r in coded_rows.collect()}
    starts = int(size[1] or 0)
    weights = expectation_maximisation(histogram, tokens - deleted, distinct, starts - int(size[2] or 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs_, counts, places, pairs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, folds, sizes = np.split(_unpack(docs_), 3)
                seen = _unpack(counts).astype(np.float64)
                block = Block(seen, _unpack(places).astype(np.int64), np.concatenate([[0], np.cumsum(sizes.astype(np.int64))]))
                c = seen[block.places]
                v = np.concatenate([seen, [float(starts)]])[block.before()]
                w = weights[bucket(v)]
                pair = _unpack(pairs).astype(np.float64)
                p = w[:, 0] * np.divide(pair, v, out=np.zeros(len(v)), where=v > 0) + w[:, 1] * (c / max(1, tokens)) + w[:, 2] / (distinct + 1)
                base = np.log10((c + 0.1) / (tokens + 0.1 * (distinct + 1)))
                at = block.offsets[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids.view(np.int64), mask=folds > 3), pa.array((folds & np.uint64(3)) == 0), pa.array(sizes.astype(np.int64)),
                        pa.array(np.add.reduceat((c > 0).astype(np.int64), at)), pa.array(np.full(len(at), tokens, np.int64)),
                        pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at)),
                    ],
                    names=[x.split()[0] for x in RESULT.split(", ")],
                )

    return ready.where("block >= 0 and r = 0").select("a", "b", "c", "d").mapInArrow(run, RESULT)
