"""Token ids in binary files that are read document by document.

A file holds the ids of a range of documents in ascending doc_id order, in the public seekable form of zstandard: frames
that are independent of each other, and behind them a table of their sizes and checksums (XXH64, the low 32 bits, of each
frame's content) in a skippable frame, so that any zstandard reader can decompress the file and a reader of this module
only the frames that it needs. A frame holds whole documents of FRAME_IDS ids together at most; a longer document has
frames of its own, of FRAME_IDS ids each. Ids are little-endian, of two bytes where the vocabulary fits, else of four.
Before the seek table, a further skippable frame has the documents' ids and lengths (compressed, with a checksum).

A folder of files becomes a data set by its manifest.json, written last: one entry a file, with the number of ids in the
files before it. Tasks write files of names of their own, so that lost or repeated attempts leave files that no manifest
names; those are removed when the manifest is written.

The table is dealt out by ranges of (doc_id, hash of the text, row), so that neither a hot id nor repeated rows come
together in one task, and is tokenized behind that shuffle: ids never go through one. A task holds a slice of text, one
frame, and 16 bytes for each of its documents. Folders are paths or URIs that driver and executors reach through pyarrow
(file, hdfs, s3, gs); the tokenizer's file must be at the same path on every executor.

Defined cases: a null or empty text is the end id alone; null doc_ids come last; repeated doc_ids are documents each, in
the order of their texts' hashes; an empty table gives a manifest without files and no rows; further columns are ignored.
A frame or index that doesn't match its checksum, and a file that is cut short, raise ValueError.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe
from .common import shuffle_partitions, whole_text
from .words import slices

FRAME_IDS = 1 << 16
LEVEL = 3
#: Fixed values of the public seekable form.
_SKIPPABLE_INDEX, _SKIPPABLE_SEEK, _SEEKABLE, _CHECKED = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_SEEK_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_FOOTER = struct.Struct("<IBI")
#: Our own index frame: mark, bytes of an id, documents, of which so many at the end have no id, XXH64 of what follows unpacked.
_INDEX = struct.Struct("<4sBQQQ")
_MARK = b"LSTK"
#: Bytes of text worked on at once: a piece that comes often is looked up once for all of them.
SLICE_BYTES = 4 << 20
#: Bytes of ids put out at once.
OUT_BYTES = 1 << 21

WRITTEN = "first long, path string, documents long, tokens long, bytes long"
READ = "doc_id long, start long, n_tokens long, ids binary"

_tokenizers: dict[str, ByteBpe] = {}


def _tokenizer(path: str) -> ByteBpe:
    if path not in _tokenizers:
        _tokenizers[path] = ByteBpe(path)
    return _tokenizers[path]


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system of a path or URI, and the path in it."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", folder):
        return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    return pafs.LocalFileSystem(), folder


class Writer:
    """One file: append() documents, then close()."""

    def __init__(self, out, width: int, frame_ids: int = FRAME_IDS):
        import zstandard

        self.out, self.width, self.frame_ids = out, width, frame_ids
        self.packer = zstandard.ZstdCompressor(level=LEVEL)
        self.open: list[np.ndarray] = []
        self.held = 0
        self.frames: list[tuple[int, int, int]] = []
        self.docs: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.nulls = self.bytes = self.tokens = 0

    def _put(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)

    def _frame(self, ids: np.ndarray) -> None:
        import xxhash

        raw = ids.astype(f"<u{self.width}").tobytes()
        packed = self.packer.compress(raw)
        self._put(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def flush(self) -> None:
        if self.held:
            self._frame(np.concatenate(self.open))
            self.open, self.held = [], 0

    def append(self, doc_ids: pa.Array, flat: np.ndarray, offsets: np.ndarray) -> None:
        """Documents whose ids lie in flat, of which each one's begin at its offset (one entry more than documents)."""
        lengths = np.diff(offsets)
        self.docs.append(doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        self.lengths.append(lengths.astype("<i8"))
        self.nulls += doc_ids.null_count
        self.tokens += int(offsets[-1] - offsets[0])
        k, n = 0, len(lengths)
        while k < n:
            if self.held and self.held + lengths[k] > self.frame_ids:
                self.flush()
            if lengths[k] > self.frame_ids:
                for at in range(int(offsets[k]), int(offsets[k + 1]), self.frame_ids):
                    self._frame(flat[at : min(at + self.frame_ids, int(offsets[k + 1]))])
                k += 1
                continue
            to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + self.frame_ids - self.held, "right")) - 1)
            self.open.append(flat[offsets[k] : offsets[to]].copy())
            self.held += int(offsets[to] - offsets[k])
            k = to

    def close(self) -> None:
        import xxhash

        self.flush()
        joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, "<i8")
        docs = joined(self.docs)
        table = docs.tobytes() + joined(self.lengths).tobytes()
        index = _INDEX.pack(_MARK, self.width, len(docs), self.nulls, xxhash.xxh64_intdigest(table)) + self.packer.compress(table)
        self._put(struct.pack("<II", _SKIPPABLE_INDEX, len(index)) + index)
        # The index is a frame without content to those who go by the table.
        seek = np.array([*self.frames, (8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)], _SEEK_ENTRY)
        self._put(struct.pack("<II", _SKIPPABLE_SEEK, seek.nbytes + _FOOTER.size) + seek.tobytes() + _FOOTER.pack(len(seek), _CHECKED, _SEEKABLE))


class Reader:
    """One file, opened for random reads: documents' ids and lengths are read at once, frames when they are asked for."""

    def __init__(self, file, name: str):
        import xxhash
        import zstandard

        self.file, self.name = file, name
        self.unpacker = zstandard.ZstdDecompressor()
        size = file.size()
        self._known(size >= _FOOTER.size, "it is cut short")
        frames, flags, mark = _FOOTER.unpack(self._at(size - _FOOTER.size, _FOOTER.size))
        table = frames * _SEEK_ENTRY.itemsize
        self._known(mark == _SEEKABLE and flags == _CHECKED and frames > 0 and size >= table + _FOOTER.size + 8, "it has no seek table with checksums")
        self.seek = np.frombuffer(self._at(size - _FOOTER.size - table, table), _SEEK_ENTRY)
        self.places = np.concatenate([[0], np.cumsum(self.seek["packed"].astype(np.int64))])
        self._known(self.places[-1] == size - _FOOTER.size - table - 8, "its frames don't fill it")
        index = self._at(int(self.places[-2]) + 8, int(self.seek["packed"][-1]) - 8)
        mark, self.width, n, self.nulls, check = _INDEX.unpack(index[: _INDEX.size])
        self._known(mark == _MARK, "it has no index of documents")
        raw = self.unpacker.decompress(index[_INDEX.size :]) if n else b""
        self._known(len(raw) == 16 * n and xxhash.xxh64_intdigest(raw) == check, "its index has another checksum")
        self.docs, self.lengths = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<i8", n, 8 * n)
        #: Where documents and frames begin in the file's ids.
        self.begins = np.concatenate([[0], np.cumsum(self.lengths)])
        self.frame_begins = np.concatenate([[0], np.cumsum(self.seek["size"][:-1].astype(np.int64) // self.width)])
        self._known(self.begins[-1] == self.frame_begins[-1], "its frames don't hold its documents")
        self.read_frames = 0
        self._last: tuple[int, np.ndarray] = (-1, np.zeros(0))

    def _known(self, good: bool, what: str) -> None:
        if not good:
            raise ValueError(f"{self.name}: {what}")

    def _at(self, place: int, n: int) -> bytes:
        self.file.seek(place)
        raw = self.file.read(n)
        self._known(len(raw) == n, "it is cut short")
        return raw

    def frame(self, k: int) -> np.ndarray:
        import xxhash
        import zstandard

        if self._last[0] != k:
            try:
                raw = self.unpacker.decompress(self._at(int(self.places[k]), int(self.seek["packed"][k])), int(self.seek["size"][k]))
            except zstandard.ZstdError as e:
                raise ValueError(f"{self.name}: frame {k} can't be decompressed") from e
            self._known(len(raw) == self.seek["size"][k] and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF == self.seek["check"][k], f"frame {k} has another checksum")
            self._last = (k, np.frombuffer(raw, f"<u{self.width}").astype("<u4"))
            self.read_frames += 1
        return self._last[1]

    def ids(self, begin: int, n: int) -> np.ndarray:
        """The n ids from begin on; only their frames are read."""
        k = int(np.searchsorted(self.frame_begins, begin, "right")) - 1
        out = []
        while n > 0:
            at = begin - int(self.frame_begins[k])
            part = self.frame(k)[at : at + n]
            out.append(part)
            begin, n, k = begin + len(part), n - len(part), k + 1
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, "<u4")

    def doc_ids(self, first: int, to: int) -> pa.Array:
        known = len(self.docs) - self.nulls
        return pa.array(self.docs[first:to].astype(np.int64), mask=np.arange(first, to) >= known)


@dataclass(frozen=True)
class Shard:
    path: str
    start: int
    documents: int
    tokens: int
    bytes: int


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, frame_ids: int = FRAME_IDS) -> list[Shard]:
    """Writes doc_id, text of docs as a data set into folder, which should be new; each document's ids are followed by end_id."""
    spark = docs.sparkSession
    where, root = filesystem(folder)
    where.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        width = 2 if max(tokenizer.vocabulary, end_id + 1) <= 1 << 16 else 4
        there, base = filesystem(folder)
        name = f"tokens-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.zst"
        first = writer = None
        with there.open_output_stream(f"{base}/{name}", compression=None) as out:
            writer = Writer(out, width, frame_ids)
            for part in slices(batches, size=SLICE_BYTES):
                flat, offsets = tokenizer.ids(part.column("text"), end_id)
                writer.append(part.column("doc_id"), flat, offsets)
            writer.close()
        first = TaskContext.get().partitionId()
        n = sum(map(len, writer.docs))
        yield pa.RecordBatch.from_pylist([{"first": first, "path": name, "documents": n, "tokens": writer.tokens, "bytes": writer.bytes}] if n else [], schema=pa.schema([("first", pa.int64()), ("path", pa.string()), ("documents", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("of", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = (F.col("doc_id").asc_nulls_last(), "of", "row")
    ranged = rows.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    # One row a file: ranges are in order of their partitions.
    written = sorted(ranged.mapInArrow(run, WRITTEN).collect(), key=lambda r: r["first"])
    shards, start = [], 0
    for r in written:
        shards.append(Shard(r["path"], start, r["documents"], r["tokens"], r["bytes"]))
        start += r["tokens"]
    said = {"form": "lodestone tokens 1", "tokenizer": tokenizer_path.rsplit("/", 1)[-1], "end_id": end_id, "documents": sum(s.documents for s in shards), "tokens": start, "files": [vars(s) for s in shards]}
    with where.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(said).encode())
    named = {s.path for s in shards}
    for info in where.get_file_info(pafs.FileSelector(root)):
        if info.base_name.endswith(".zst") and info.base_name not in named:
            where.delete_file(info.path)
    return shards


def manifest(folder: str) -> list[Shard]:
    where, root = filesystem(folder)
    with where.open_input_stream(f"{root}/manifest.json") as f:
        return [Shard(**s) for s in json.loads(f.read())["files"]]


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """place, path, start of each file, one to a task as far as can be."""
    rows = [(k, s.path, s.start) for k, s in enumerate(manifest(folder))]
    return spark.createDataFrame(rows, "place long, path string, start long").repartitionByRange(max(1, len(rows)), "place")


def _documents(folder: str, name: str) -> tuple[Reader, object]:
    there, base = filesystem(folder)
    file = there.open_input_file(f"{base}/{name}")
    return Reader(file, name), file


def _out(doc_ids: pa.Array, starts: np.ndarray, ids: list[np.ndarray]) -> pa.RecordBatch:
    n = np.array([len(x) for x in ids], np.int64)
    raw = pa.array([x.tobytes() for x in ids], pa.binary())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(starts), pa.array(n), raw], names=["doc_id", "start", "n_tokens", "ids"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """READ of every document: start counts the ids of all documents before it, ids are little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                reader, file = _documents(folder, name)
                with file:
                    k, n = 0, len(reader.docs)
                    while k < n:
                        to = max(k + 1, int(np.searchsorted(reader.begins, reader.begins[k] + OUT_BYTES // 4, "right")) - 1)
                        ids = [reader.ids(int(a), int(c)) for a, c in zip(reader.begins[k:to], reader.lengths[k:to], strict=True)]
                        yield _out(reader.doc_ids(k, to), start + reader.begins[k:to], ids)
                        k = to

    return _files(spark, folder).mapInArrow(run, READ)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens of every document, with path, its place in that file's ids and its first frame; no frame is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                reader, file = _documents(folder, name)
                with file:
                    frame = np.searchsorted(reader.frame_begins, reader.begins[:-1], "right") - 1
                for k in range(0, len(reader.docs), 1 << 16):
                    to = min(k + (1 << 16), len(reader.docs))
                    at = reader.begins[k:to]
                    yield pa.RecordBatch.from_arrays(
                        [reader.doc_ids(k, to), pa.array(start + at), pa.array(reader.lengths[k:to].astype(np.int64)), pa.array([name] * (to - k)), pa.array(at), pa.array(frame[k:to])],
                        names=["doc_id", "start", "n_tokens", "path", "place", "frame"],
                    )

    return _files(spark, folder).mapInArrow(run, "doc_id long, start long, n_tokens long, path string, place long, frame long")


def fetch(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """READ of the documents whose doc_id is among wanted's; only their frames are decompressed, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = reader = file = None
        try:
            for b in batches:
                for k in range(b.num_rows):
                    name = b.column("path")[k].as_py()
                    if name != opened:
                        if file is not None:
                            file.close()
                        reader, file = _documents(folder, name)
                        opened = name
                    ids = reader.ids(b.column("place")[k].as_py(), b.column("n_tokens")[k].as_py())
                    yield _out(b.column("doc_id").slice(k, 1), b.column("start").slice(k, 1).to_numpy(), [ids])
        finally:
            if file is not None:
                file.close()

    keys = wanted.select("doc_id").where("doc_id is not null").distinct()
    found = index(spark, folder).join(keys, "doc_id")
    dealt = found.repartition("path", "frame").sortWithinPartitions("path", "place").select("doc_id", "start", "n_tokens", "path", "place")
    return dealt.mapInArrow(run, READ)
