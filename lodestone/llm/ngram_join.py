"""N-gram Jaccard self-join by vertical partitioning, and the components of its links.

A document is the set of its distinct n-word shingles (64-bit hashes); equal sets (two 64-bit sums) are one class. One
global order holds for all shingles: by how common one is (a fixed-size sketch of counts over all documents), then by
hash. Pivots cut this order into fragments of about as many occurrences each, and every set into segments. A pair's
overlap is counted in each fragment separately, where only the two segments meet, and summed per pair.

Which pairs are worth counting: sets of a similarity t share one of the first n - ceil(t n) + 1 shingles of the order
(the rarest), so classes meet in the lists of these. Two rounds need no pairs of a whole list. First every class of a
list is compared with one hub, the class in which the shingle comes first (an original has none of its copies' edits,
which are rarer). Then, in lists that the links of the first round leave in several components, classes of different
components meet, in blocks of bounded size; only those pairs leave a block whose lengths, and places of the shingle,
allow the similarity. So no link that could join two components is left out, whatever the list's size.

A list is dealt out by its shingle and, where the sketch says that it is longer than GROUP, by shares of its classes;
each share has its own hub, and these are compared with the first of them.

Defined cases: null and empty texts have no shingle, are linked with nothing and are their own component; texts of
fewer than n words are one shingle; repeated rows are copies; rows that repeat a doc_id with other texts are linked on
their own; a null doc_id links like others, but component_id is the smallest id that isn't null; an empty table gives
no rows; further columns are ignored. Where near duplicates are dropped, the row of the smallest doc_id stays (null
ids last, then the smaller class); rows are told apart by content where ids are null or repeated.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import compact, cut, fresh, shuffle_partitions, small, without_ids
from .components import components
from .words import chained, coded, hashed, mixed, slices, split_words

#: The sketch has 2**SKETCH_BITS counters; it only orders and deals out shingles, so its errors cost time, never links.
SKETCH_BITS = 22
_RANGE_BITS = 14
FRAGMENTS = 8
#: A list's share has about so many occurrences at most.
GROUP = 1 << 14
#: Classes of a list that meet in a block of the second round: as many from either side.
BLOCK = 1024
#: Sizes that a candidate pair is held against before its segments meet: of its shingles by their last bits.
PARTS = 256
#: Classes whose copies a task remembers to send only once.
REMEMBERED = 1 << 20

_LENGTH = (1 << 32) - 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _binary(ids: np.ndarray) -> pa.Array:
    """Rows of two 64-bit numbers as binaries of 16 bytes."""
    k = len(ids)
    return pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer(np.arange(k + 1, dtype=np.int32) * 16), pa.py_buffer(np.ascontiguousarray(ids, np.uint64).tobytes())])


def _numbers(column: pa.Array) -> np.ndarray:
    """_binary's inverse."""
    fixed = column.cast(pa.binary(16))
    return np.frombuffer(fixed.buffers()[1], np.uint64)[2 * fixed.offset : 2 * (fixed.offset + len(fixed))].reshape(-1, 2)


class Sets:
    """The distinct shingles of each text, sorted by hash: of text i those from offsets[i] to offsets[i + 1]."""

    def __init__(self, texts: pa.Array, n: int):
        words, at = split_words(texts)
        codes, distinct = coded(words)
        h = hashed(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
        runs = chained(h, n)
        out, lengths = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= n:
                x = np.sort(runs[a : b - n + 1])
                x = x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif b > a:  # the whole text; its length keeps it apart from runs of n
                x = mixed(chained(h[a:b], b - a) + np.uint64(b - a))
            else:
                x = h[:0]
            out.append(x)
            lengths.append(len(x))
        self.hashes = np.concatenate(out) if out else h[:0]
        self.sizes = np.array(lengths, np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)

    def identities(self) -> np.ndarray:
        """Two independent 64-bit sums over each set: equal for equal sets."""
        full = self.sizes > 0
        out = np.zeros((len(self.sizes), 2), np.uint64)
        for k, seed in enumerate((0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
            if full.any():
                out[full, k] = np.add.reduceat(mixed(self.hashes ^ np.uint64(seed)), self.offsets[:-1][full])
        return mixed(out + self.sizes.astype(np.uint64)[:, None])


class Order:
    """The global order of shingles by level, then by hash, and its fragments of about as many occurrences each."""

    def __init__(self, levels: np.ndarray, bits: int, fragments: int):
        self.levels, self.shift, self.fragments = levels, np.uint64(64 - bits), fragments
        share = np.bincount(levels, minlength=256) * self.count(np.arange(256))
        self.share = share / max(1.0, share.sum())
        self.before = np.cumsum(self.share) - self.share

    @staticmethod
    def count(level: np.ndarray) -> np.ndarray:
        """About how many occurrences a level stands for."""
        return 2.0 ** (level / 4) - 1

    def level(self, hashes: np.ndarray) -> np.ndarray:
        return self.levels[(hashes >> self.shift).astype(np.int64)]

    def fragment(self, hashes: np.ndarray, level: np.ndarray) -> np.ndarray:
        place = self.before[level] + self.share[level] * (hashes / 2.0**64)
        return np.minimum(self.fragments - 1, (place * self.fragments).astype(np.int64))


def _profiles(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """A row per document (doc_id, n, node), and the parts of each task's counters (part, counts)."""
    shift = np.uint64(64 - bits)
    span = min(_RANGE_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        names = ["doc_id", "n", "node", "part", "counts"]
        for b in slices(batches):
            s = Sets(b.column("text"), n)
            # Not np.add.at: bincount is far faster.
            counts += np.bincount((s.hashes >> shift).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            k = len(s.sizes)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.sizes), _binary(s.identities()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        parts = counts.reshape(-1, 1 << span)
        held = np.flatnonzero(parts.any(1))
        for at in np.array_split(held, max(1, len(held) // 16)):
            k = len(at)
            blobs = [zlib.compress(np.ascontiguousarray(parts[i].view(np.uint8).reshape(-1, 4).T).tobytes(), 1) for i in at]
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.array(at.astype(np.int32)), pa.array(blobs, pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id long, n long, node binary, part int, counts binary")


def _levels(parts: DataFrame, bits: int) -> np.ndarray:
    """One byte per counter: about four times the logarithm of its sum over all tasks."""
    span = min(_RANGE_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, blob in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(blob), np.uint8).reshape(4, -1).T
                x = np.ascontiguousarray(x).view(np.uint32).ravel()
                sums[part] = sums[part] + x if part in sums else x.astype(np.uint64)
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.minimum(255, np.rint(4 * np.log2(1.0 + x))).astype(np.uint8).tobytes()], pa.binary())], names=["part", "levels"])

    out = np.zeros((1 << (bits - span), 1 << span), np.uint8)
    spread = parts.repartition(shuffle_partitions(parts.sparkSession), "part")
    for r in spread.mapInArrow(run, "part int, levels binary").collect():
        out[r["part"]] = np.frombuffer(r["levels"], np.uint8)
    return out.ravel()


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (-(-percent * n // 100)) + 1


def possible(na, nb, pa_, pb, percent: int):
    """Lengths and places of the first common shingle allow the similarity; numbers or arrays."""
    need = -(-percent * (na + nb) // (100 + percent))
    return (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (1 + np.minimum(na - 1 - pa_, nb - 1 - pb) >= need)


def _postings(docs: DataFrame, n: int, order, percent: int) -> DataFrame:
    """key, share, node, at: each set's first shingles in the global order; at: place and size, 32 bits each; share: -1 for lists in one piece."""
    group = GROUP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        seen: set[bytes] = set()
        for b in slices(batches):
            s = Sets(b.column("text"), n)
            ids = s.identities()
            level = o.level(s.hashes)
            keys, levels, who, takes = [], [], [], prefix_size(s.sizes, percent)
            for i, (a, z) in enumerate(zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist(), strict=True)):
                name = ids[i].tobytes()
                if a == z or name in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(name)
                # Stable: within a level the hashes stay sorted.
                k = np.argsort(level[a:z], kind="stable")[: int(takes[i])]
                keys.append(s.hashes[a:z][k])
                levels.append(level[a:z][k])
                who.append(i)
            if not who:
                continue
            size = np.array([len(x) for x in keys])
            doc = np.repeat(who, size)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            shares = np.ceil(o.count(np.concatenate(levels)) / group).astype(np.uint64)
            share = np.where(shares > 1, (ids[doc, 0] % np.maximum(shares, 1)).astype(np.int64), -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(keys))), pa.array(share), _binary(ids[doc]), pa.array((place << 32) | s.sizes[doc])], names=["key", "share", "node", "at"])

    return docs.select("text").mapInArrow(run, "key long, share int, node binary, at long")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that begin and end with whole groups of equal keys."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        for k in keys:
            x = b.column(k).to_numpy()
            change[1:] |= x[1:] != x[:-1]
            change[0] |= bool(held) and held[-1].column(k)[-1].as_py() != x[0]
        at = np.flatnonzero(change)
        if len(at):
            last = int(at[-1])
            if got := [x for x in [*held, b.slice(0, last)] if x.num_rows]:
                yield pa.Table.from_batches(got).combine_chunks()
            held = [b.slice(last)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    x = t.column(name)
    return x.chunk(0) if x.num_chunks == 1 else x.combine_chunks()


_MET = "kind int, key long, a binary, b binary, na long, nb long, pos long"
PAIR, MEMBER, HUB = 0, 1, 2


def _met(percent: int):
    """From sorted postings: each list's first class with every other (PAIR), the classes of lists of three or more (MEMBER), and the first class of each share (HUB)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key", "share"]):
            key, share, at = (_column(t, c).to_numpy() for c in ("key", "share", "at"))
            node = _numbers(_column(t, "node"))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (share[1:] != share[:-1])
            once = new.copy()
            once[1:] |= (node[1:] != node[:-1]).any(1)
            key, share, at, node, new = key[once], share[once], at[once], node[once], new[once]
            start = np.flatnonzero(new)
            size = np.diff(np.concatenate([start, [len(key)]]))
            first, many = np.repeat(start, size), np.repeat(size, size)
            n, pos = at & _LENGTH, at >> 32
            pair = np.flatnonzero(~new & possible(n[first], n, pos[first], pos, percent))
            member = np.flatnonzero((many > 2) | (share >= 0))
            hub = np.flatnonzero(new & (share >= 0))
            for kind, rows in ((PAIR, pair), (MEMBER, member), (HUB, hub)):
                if len(rows):
                    k, own = len(rows), first[rows] if kind == PAIR else rows
                    other = [_binary(node[rows]), pa.array(n[rows])] if kind == PAIR else [pa.nulls(k, pa.binary()), pa.nulls(k, pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(k, kind, np.int32)), pa.array(key[rows]), _binary(node[own]), other[0], pa.array(n[own]), other[1], pa.array(pos[own])], names=["kind", "key", "a", "b", "na", "nb", "pos"]
                    )

    return run


def _between(percent: int, block: int = 512):
    """From members sorted by (key, i, j, n): pairs of different components, and of chunks i and j where these differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["key", "i", "j"]):
            key, i, j, chunk, n, pos = (_column(t, c).to_numpy() for c in ("key", "i", "j", "chunk", "n", "pos"))
            node = _numbers(_column(t, "node"))
            _, c = np.unique(_numbers(_column(t, "c")), axis=0, return_inverse=True)
            c = c.ravel()
            start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            for a, z in zip(start.tolist(), [*start[1:].tolist(), len(key)], strict=True):
                apart = i[a] != j[a]
                for x in range(a, z, block):
                    y = min(z, x + block)
                    # Later ones are longer; those too long for all of the block are left out.
                    end = a + int(np.searchsorted(n[a:z], n[y - 1] * 100 // percent, "right"))
                    left, right = np.arange(x, y)[:, None], np.arange(x, end)[None, :]
                    good = (left < right) & (c[left] != c[right]) & possible(n[left], n[right], pos[left], pos[right], percent)
                    if apart:
                        good &= chunk[left] != chunk[right]
                    p, q = np.nonzero(good)
                    if len(p):
                        p, q = p + x, q + x
                        yield pa.RecordBatch.from_arrays([_binary(node[p]), _binary(node[q]), pa.array(n[p]), pa.array(n[q])], names=["a", "b", "na", "nb"])

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, na, nb) with the smaller end first."""
    low = F.col("a") < F.col("b")
    one = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(low, F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(low, F.col("nb")).otherwise(F.col("na")).alias("nb"))
    return one.distinct()


def _segments(docs: DataFrame, n: int, order) -> DataFrame:
    """node, fragment, part: each set cut at the pivots of the global order; fragments without a shingle have no row. Fragment -1 has the set's counts by the last bits of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o = order.value
        for b in slices(batches):
            s = Sets(b.column("text"), n)
            if not len(s.hashes):
                continue
            k = len(s.sizes)
            doc = np.repeat(np.arange(k), s.sizes)
            level = o.level(s.hashes)
            by = np.lexsort((level, doc))  # stable: by hash within a level
            hashes = s.hashes[by]
            fragment = o.fragment(hashes, level[by])
            at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (fragment[1:] != fragment[:-1])]))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([at, [len(hashes)]]).astype(np.int32)), pa.array(_signed(hashes)))
            ids = s.identities()
            yield pa.RecordBatch.from_arrays([_binary(ids[doc[at]]), pa.array(fragment[at].astype(np.int32)), lists, pa.nulls(len(at), pa.binary())], names=["node", "fragment", "part", "counts"])
            counts = np.bincount(doc * PARTS + (s.hashes % np.uint64(PARTS)).astype(np.int64), minlength=k * PARTS).reshape(k, PARTS)
            # Capped counts differ by no more than the counts themselves.
            blobs = [x.tobytes() for x in np.minimum(counts, 255).astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([_binary(ids), pa.array(np.full(k, -1, np.int32)), pa.nulls(k, pa.list_(pa.int64())), pa.array(blobs, pa.binary())], names=["node", "fragment", "part", "counts"])

    return docs.select("text").mapInArrow(run, "node binary, fragment int, part array<long>, counts binary")


def _near_enough(percent: int):
    """Pairs whose counts (x, y) leave room for the similarity: sets differ by at least as many shingles as their counts do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for c in ("x", "y"))
            total = b.column("na").to_numpy() + b.column("nb").to_numpy()
            most = total - 2 * -(-percent * total // (100 + percent))
            keep = pa.array(np.abs(x - y).sum(1, dtype=np.int64) <= most)
            yield b.select(["a", "b", "na", "nb"]).filter(keep)

    return run


def _verified(pairs: DataFrame, docs: DataFrame, profiles: DataFrame, repeated: bool, n: int, order, percent: int) -> DataFrame:
    """Of the pairs (a, b, na, nb) those that are similar, as (a, b). repeated: some id stands for several rows."""
    nodes, n_nodes = compact(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    own = profiles.where("n > 0").join(small(nodes, n_nodes, 32), "node", "left_semi")
    # One text of each class is enough.
    ids, n_ids = compact(own.groupBy("node").agg(F.min("doc_id").alias("_id")).select("_id").distinct())
    mine = docs.join(small(ids, n_ids, 16), docs["doc_id"].eqNullSafe(F.col("_id")), "left_semi")
    parts = _segments(mine, n, order)
    if repeated:  # an id's rows may be of other classes, or copies of one
        parts = parts.join(small(nodes, n_nodes, 32), "node", "left_semi").dropDuplicates(["node", "fragment"])
    parts = cut(parts)
    counts = parts.where("fragment < 0")
    of_a, of_b = (counts.select(F.col("node").alias(x), F.col("counts").alias(y)) for x, y in (("a", "x"), ("b", "y")))
    near = pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "na", "nb", "x", "y").mapInArrow(_near_enough(percent), "a binary, b binary, na long, nb long")
    near, _ = compact(near)
    each = near.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(order.value.fragments - 1)))).select("a", "b", "fragment")
    parts = parts.where("fragment >= 0")
    left = parts.select(F.col("node").alias("a"), "fragment", F.col("part").alias("x"))
    right = parts.select(F.col("node").alias("b"), "fragment", F.col("part").alias("y"))
    # The pairs go to the segments of their first ends, and these to the second.
    partial = left.join(each, ["a", "fragment"]).join(right, ["b", "fragment"]).select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"))
    total = partial.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    return total.join(near, ["a", "b"]).where(f"100 * shared >= {percent} * (na + nb - shared)").select("a", "b")


def _left_over(members: DataFrame, label: DataFrame, n_label: int, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of different components that share a list and that lengths and places allow."""
    named = label.select(F.col("node").alias("a"), F.col("label").alias("c"))
    now = members.join(small(named, n_label, 48), "a", "left").select("key", F.col("a").alias("node"), F.coalesce("c", "a").alias("c"), F.col("na").alias("n"), "pos")
    q = F.ceil(F.count(F.lit(1)) / BLOCK).cast("int")
    mixed_lists, n_lists = compact(now.groupBy("key").agg(q.alias("q"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key", "q"))
    now = now.join(small(mixed_lists, n_lists, 24), "key").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("q")).cast("int"))
    met = now.withColumn("o", F.explode(F.expr("sequence(0, q - 1)"))).select("key", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "node", "c", "n", "pos")
    met = met.repartition(shuffle_partitions(members.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "n", "node")
    return met.mapInArrow(_between(percent), "a binary, b binary, na long, nb long")


def links(docs: DataFrame, profiles: DataFrame, levels: np.ndarray, n: int, percent: int, bits: int, fragments: int) -> DataFrame:
    """node, label: each class that is linked with another, and the smallest class of its component."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(Order(levels, bits, fragments))
    lists = _postings(docs, n, order, percent).repartition(shuffle_partitions(spark), "key", "share").sortWithinPartitions("key", "share", "at", "node")
    met = cut(lists.mapInArrow(_met(percent), _MET))
    members = met.where(f"kind = {MEMBER}").select("key", "a", "na", "pos")
    hubs = met.where(f"kind = {HUB}").select("key", "a", "na", "pos")
    first = hubs.groupBy("key").agg(F.min(F.struct("pos", "na", "a")).alias("f"))
    need = f"ceil({percent} * (na + nb) / {100 + percent})"
    of_hubs = hubs.join(first, "key").select("key", F.col("f.a").alias("a"), F.col("f.na").alias("na"), F.col("f.pos").alias("pa"), F.col("a").alias("b"), F.col("na").alias("nb"), F.col("pos").alias("pb")).where(
        f"a <> b and 100 * least(na, nb) >= {percent} * greatest(na, nb) and 1 + least(na - 1 - pa, nb - 1 - pb) >= {need}"
    )
    pairs, n_pairs = compact(_ordered(met.where(f"kind = {PAIR}").select("a", "b", "na", "nb").unionByName(of_hubs.select("a", "b", "na", "nb"))))
    none = spark.createDataFrame([], "node binary, label binary")
    if not n_pairs:
        return none
    repeated = not profiles.groupBy("doc_id").count().where("count > 1").isEmpty()
    edges = cut(_verified(pairs, docs, profiles, repeated, n, order, percent))
    label, n_label = compact(components(edges))
    more = _ordered(_left_over(members, label, n_label, percent)).join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    more, n_more = compact(more)
    if n_more:
        new = cut(_verified(more, docs, profiles, repeated, n, order, percent))
        label = components(edges.unionByName(new))
    return label


def classed(docs: DataFrame, n: int = 5, percent: int = 80, bits: int = SKETCH_BITS, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n, node, c of every row of docs (doc_id, text): its set's size, class and component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    stored = cut(_profiles(docs, n, bits))
    profiles = stored.where("part is null").select("doc_id", "n", "node")
    levels = _levels(stored.where("part is not null").select("part", "counts"), bits)
    label, n_label = compact(links(docs, profiles, levels, n, percent, bits, fragments))
    return cut(profiles.join(small(label, n_label, 48), "node", "left").select("doc_id", "n", "node", F.coalesce("label", "node").alias("c")))


def ngram_join(docs: DataFrame, n: int = 5, percent: int = 80, bits: int = SKETCH_BITS, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    rows = classed(docs, n, percent, bits, fragments)
    full = rows.where("n > 0")
    low = cut(full.groupBy("c").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("k")).where("k > 1").select("c", "component_id"))
    out = full.join(low, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def with_class(docs: DataFrame, n: int, name: str) -> DataFrame:
    """docs, all columns, and the class of each row's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, _binary(Sets(b.column("text"), n).identities())], names=[*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.BinaryType())]))


def near_deduplicated(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns; of each component one row stays."""
    every = classed(docs, n, percent)
    rows = every.where("n > 0").withColumn("none", F.col("doc_id").isNull())
    first = F.min(F.struct("none", "doc_id", "node")).alias("f")
    groups = cut(rows.groupBy("c").agg(first, F.count(F.lit(1)).alias("k")).where("k > 1"))
    gone = cut(rows.join(groups, "c").where("not (doc_id <=> f.doc_id and node = f.node)").select("doc_id", "node"))
    # Ids that are null or repeated don't say which of their rows go; their sets do.
    odd, n_odd = compact(every.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1 or doc_id is null").select(F.col("doc_id").alias("_odd")))
    if not n_odd:
        return without_ids(docs, gone.select("doc_id"))
    plain = docs.join(small(odd, n_odd, 24), F.col("doc_id").cast("long").eqNullSafe(F.col("_odd")), "left_anti")
    plain = without_ids(plain, gone.where("doc_id is not null").select("doc_id").distinct())
    own, id_, node_ = (fresh(docs, x) for x in ("_own", "_id", "_node"))
    of_odd = docs.join(small(odd, n_odd, 24), F.col("doc_id").cast("long").eqNullSafe(F.col("_odd")), "left_semi")
    of_odd = with_class(of_odd.withColumn("text", F.col("text").cast("string")), n, own)
    lost = gone.distinct().select(F.col("doc_id").alias(id_), F.col("node").alias(node_))
    rest = of_odd.join(lost, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(node_)), "left_anti")
    # Of rows of one id and one set the first stays; texts without a shingle are linked with nothing.
    empty = F.coalesce(F.col("text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$")
    kept = rest.where(~empty).dropDuplicates(["doc_id", own]).unionByName(rest.where(empty))
    return plain.unionByName(kept.select(*docs.columns))
