"""Token files: exact round trips, what is read for one document, damage, and another reader's view of the format."""

import io
import json
import os
import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from lodestone.llm import queries, token_files
from lodestone.llm.byte_bpe import ByteBpe, pieces

ODD = [
    "", None, " ", "  ", "a", " a b  c ", "a  b", "a 　b é é x", "don't 's 's' 12 3a  \n x\t y", "he'll, we've. it's!", "<|endoftext|> a <|endoftext|>", "a <|endoftext|> b", "a,<|endoftext|>, b",
    "naïve é à 日本 語   z", "x " * 5 + " ", "a\x85 b \x1c c", "a b c  d", "  a  b", "word, word. (word) \"word\" word-word word/word", "\U0001f600 \U0001f600x", "é é",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


def wanted(library, docs):
    """doc_id, start, n_tokens, crc of each document, ids by the library in one call a text."""
    out, start = [], 0
    for i, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "start", "n_tokens", F.crc32("ids")).collect()), key=lambda r: r[1])


def test_pieces_do_not_change_ids(library):
    rng = random.Random(4)
    bits = ["a", "B", " ", " ", "  ", "\n", "\t", " ", " ", "　", "é", "日", "1", ",", ".", "'", "'s", "'ll", "<|endoftext|>", "\x85", "\x1c", "!", "-", "\U0001f600"]
    texts = ODD + ["".join(rng.choices(bits, k=rng.randint(1, 30))) for _ in range(3000)]
    flat, offsets = ByteBpe(queries.tokenizer_path("byte_bpe_50k.json")).ids(pa.array(texts), 2)
    for k, t in enumerate(texts):
        assert flat[offsets[k] : offsets[k + 1]].tolist() == [*library.encode(t or "", add_special_tokens=False).ids, 2], repr(t)
    found, first = pieces(pa.array(texts).slice(5, 9))
    assert ["".join(found.to_pylist()[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)] == [t or "" for t in texts[5:14]]


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("lodestone.llm.byte_bpe.REMEMBERED", 8)
    b = ByteBpe(queries.tokenizer_path("byte_bpe_50k.json"))
    for k in (0, 3, 6, 2, 0, 9):
        texts = ODD[k : k + 8]
        flat, offsets = b.ids(pa.array(texts), 2)
        assert flat.tolist() == [i for t in texts for i in [*library.encode(t or "", add_special_tokens=False).ids, 2]]


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rng = random.Random(9)
    docs = [(k * 3 - 50, rng.choice(ODD) if k % 5 == 0 else " ".join(rng.choices(["alpha", "beta,", "Gamma", "été", "7"], k=rng.randint(0, 60)))) for k in range(200)]
    docs += [(10_000, "long text " * 2000), (None, "no id"), (7, "twice"), (7, "twice"), (7, "twice more")]
    rng.shuffle(docs)
    folder = str(tmp_path_factory.mktemp("tokens") / "set")
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, of string, `row` int").repartition(3)
    token_files.write(df, queries.tokenizer_path("byte_bpe_50k.json"), folder, end_id=2, frame_ids=256)
    return docs, folder


def test_round_trip(spark, library, written):
    docs, folder = written
    got, want = rows_of(token_files.read(spark, folder)), wanted(library, docs)
    assert [r[:1] for r in got] == [r[:1] for r in want]
    assert sorted((r[0] or 0, r[2], r[3]) for r in got) == sorted((r[0] or 0, r[2], r[3]) for r in want)
    plain = [r for r in want if r[0] != 7]
    assert [r for r in got if r[0] != 7] == plain
    ends = [r[1] + r[2] for r in got]
    assert [r[1] for r in got] == [0, *ends[:-1]]


def test_registered_query(spark, library):
    from tests.oracle import DATA

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_token_files(spark, DATA)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(wanted(library, docs))


def test_only_asked_frames_are_read(spark, written):
    docs, folder = written
    every = {r[1]: r for r in rows_of(token_files.read(spark, folder))}
    ids = [-50, 7, 10_000, 10_000, 999_999, None]
    got = rows_of(token_files.fetch(spark, folder, spark.createDataFrame([(i,) for i in ids], "doc_id long")))
    assert got == [r for r in every.values() if r[0] in (-50, 7, 10_000)]
    shard = max(token_files.manifest(folder), key=lambda s: s.tokens)
    reader, file = token_files._documents(folder, shard.path)
    with file:
        assert len(reader.seek) > 5
        reader.ids(int(reader.begins[1]), int(reader.lengths[1]))
        assert reader.read_frames <= 2
        long = reader.lengths.argmax()
        assert reader.lengths[long] > 256 and len(reader.ids(int(reader.begins[long]), int(reader.lengths[long]))) == reader.lengths[long]


def test_other_readers_see_one_stream(written):
    """By zstandard's own reader, and by walking frame for frame: table, sizes and skippable frames as the public format has them."""
    _, folder = written
    for shard in token_files.manifest(folder):
        raw = open(f"{folder}/{shard.path}", "rb").read()
        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        assert len(stream) == 2 * shard.tokens and len(raw) == shard.bytes
        frames, flags, mark = struct.unpack("<IBI", raw[-9:])
        assert (flags, mark) == (0x80, 0x8F92EAB1)
        table = [struct.unpack_from("<III", raw, len(raw) - 9 - 12 * (frames - k)) for k in range(frames)]
        at = 0
        for packed, size, _ in table:
            magic = struct.unpack_from("<I", raw, at)[0]
            assert magic == (0xFD2FB528 if size else 0x184D2A50)
            at += packed
        assert struct.unpack_from("<II", raw, at) == (0x184D2A5E, 12 * frames + 9) and at + 8 + 12 * frames + 9 == len(raw)
        assert sum(size for _, size, _ in table) == len(stream)


def test_damage_is_noticed(spark, written, tmp_path):
    _, folder = written
    shard = max(token_files.manifest(folder), key=lambda s: s.tokens)
    raw = bytearray(open(f"{folder}/{shard.path}", "rb").read())

    def opened(data):
        (tmp_path / shard.path).write_bytes(data)
        reader, file = token_files._documents(str(tmp_path), shard.path)
        with file:
            return [reader.ids(int(a), int(n)) for a, n in zip(reader.begins, reader.lengths, strict=False)]

    assert opened(bytes(raw))
    for at in (12, 40, len(raw) - 30, len(raw) - 5):
        bad = bytearray(raw)
        bad[at] ^= 0x55
        with pytest.raises((ValueError, zstandard.ZstdError)):
            opened(bytes(bad))
    with pytest.raises(ValueError, match="."):
        opened(bytes(raw[:-20]))


def test_empty_table_and_attempts_that_were_lost(spark, tmp_path):
    folder = str(tmp_path / "none")
    os.makedirs(folder)
    open(f"{folder}/tokens-00000-lost.zst", "wb").write(b"half")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.write(empty, queries.tokenizer_path("byte_bpe_50k.json"), folder, end_id=2) == []
    assert token_files.read(spark, folder).collect() == [] and token_files.read(spark, folder).columns == ["doc_id", "start", "n_tokens", "ids"]
    assert os.listdir(folder) == ["manifest.json"] and json.load(open(f"{folder}/manifest.json"))["tokens"] == 0


def test_very_long_text(spark, library, tmp_path):
    text = "abc def, " * 150_000 + "x" * 100_000
    folder = str(tmp_path / "long")
    token_files.write(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string"), queries.tokenizer_path("byte_bpe_50k.json"), folder, end_id=2)
    assert rows_of(token_files.read(spark, folder)) == wanted(library, [(1, text), (2, None)])
