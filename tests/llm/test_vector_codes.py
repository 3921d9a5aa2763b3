"""Product codes against plain Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts=8, entries=16, rounds=6):
    """Every distance in Python integers."""
    kept = [(i, [math.floor(4096 * float(np.float32(x))) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in sorted(kept)[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda a, book: min(range(len(book)), key=lambda e: (gap(a, book[e]), e))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for _, v, _ in kept:
                of.setdefault(best(cut(v, p), books[p]), []).append(cut(v, p))
            books[p] = [[sum(c) // len(of[e]) for c in zip(*of[e], strict=True)] if e in of else old for e, old in enumerate(books[p])]
    said = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    coded = []
    for i, v, k in kept:
        code = [best(cut(v, p), books[p]) for p in range(parts)]
        coded.append((i, k, "".join(f"{c:02x}" for c in code), sum(gap(cut(v, p), books[p][code[p]]) for p in range(parts))))
    return sorted(((i, code, error, sum(e for _, j, _, e in coded if j == k), said) for i, k, code, error in coded), key=str)


def got(spark, rows, schema=SCHEMA, **kw):
    df = vector_codes.compress(spark.createDataFrame(rows, schema), **kw)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_codes_with_odd_rows_ties_and_repeats(spark):
    rng = random.Random(3)
    grid = lambda: [rng.randint(-3, 3) / 4096 for _ in range(16)]  # noqa: E731  coarse values: many equal distances
    rows = [(k, grid(), rng.choice([0, 1, None])) for k in range(60)]
    rows += [(100 + k, rows[0][1], 2) for k in range(30)]
    rows += [(k, [rng.uniform(-1, 1) for _ in range(16)], 1) for k in range(200, 240)]
    rows += [(-1, None, 0), (-2, [None] * 16, 0), (-3, [float("nan")] + [0.0] * 15, 0), (-4, [0.0] * 15 + [float("inf")], 0)]
    rng.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_fewer_rows_than_entries_and_none(spark):
    rows = [(k, [k / 7, -k / 3] * 4, None) for k in range(5)]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == [] and got(spark, [(1, None, 1)]) == []
    df = vector_codes.compress(spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA))
    assert sorted(tuple(r)[:4] for r in df.collect()) == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]


def test_null_and_repeated_ids_and_further_columns(spark):
    rows = [(None if k % 3 else 1, [float(k)] * 8, k % 2) for k in range(30)]
    ranked = [(i if i is not None else 10**6, v, k) for i, v, k in rows]
    clash = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", of string, code string")
    found = vector_codes.compress(clash)
    want = plain(ranked)
    assert sorted(((r.vec_id or 10**6), *tuple(r)[1:]) for r in found.collect()) == sorted(want)


def test_intervals_hold_the_truth_and_screening_is_exact():
    rng = np.random.default_rng(5)
    for top in (3, 5000, 1 << 22, vector_codes.limit(8)):
        x, c = rng.integers(-top, top + 1, (400, 8)), rng.integers(-top, top + 1, (16, 8))
        c[9] = c[2]
        x[:50] = c[rng.integers(0, 16, 50)] + rng.integers(-1, 2, (50, 8)) * (top > 3)
        x = np.clip(x, -top, top)
        value, radius, _, _ = vector_codes.screened(x, c)
        true = [[sum(int(b) * int(b) for b in e) - 2 * sum(int(a) * int(b) for a, b in zip(v, e, strict=True)) for e in c] for v in x]
        assert all(abs(int(value[i, j]) - true[i][j]) <= math.ceil(radius[i, j]) for i in range(len(x)) for j in range(16))
        far = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, e, strict=True)) for e in c] for v in x]
        assert vector_codes.nearest(x, c).tolist() == [f.index(min(f)) for f in far]


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    rng = random.Random(8)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(16)], 0) for k in range(50)]
    vectors = spark.createDataFrame(rows, SCHEMA)
    books = vector_codes.codebooks(vectors)
    coded = vector_codes.encoded(vectors, books).withColumn("x", vector_codes.decoded(F.col("code"), books))
    of = {i: [math.floor(4096 * x) for x in v] for i, v, _ in vectors.collect()}
    for r in coded.collect():
        assert sum((a - round(4096 * b)) ** 2 for a, b in zip(of[r.vec_id], r.x, strict=True)) == r.error


def test_what_cannot_be_coded_is_refused(spark):
    for rows in ([(1, [1.0] * 8, 0), (2, [1.0] * 16, 0)], [(1, [1.0] * 7, 0)], [(1, [1e30] * 8, 0)]):
        with pytest.raises(Exception, match="components"):
            got(spark, rows)
