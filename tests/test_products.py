"""Products in blocks against every chain by hand."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.operators import collaboration as C
from lodestone.operators import products as P
from lodestone.operators.products import chained


def by_hand(edges, factor, own, upper):
    sums = {}
    for s, m, x, y, _ in edges:
        for m2, t, x2, y2, _ in edges:
            if m == m2 and (s < t if upper else s != t):
                v = None if x is None or y2 is None else factor * x * y2
                old = sums.get((s, t))
                sums[s, t] = old if v is None else v + (old or 0.0)
    if own:
        for s, t, _, _, o in edges:
            sums[s, t] = o + (sums.get((s, t)) or 0.0)
    return sums


@pytest.mark.parametrize(("own", "upper"), [(False, False), (True, False), (False, True)])
def test_products_in_blocks(spark, own, upper):
    r = random.Random(7)
    nodes = [k * k * 1000 for k in range(30)]
    pairs = [(s, t) for s in nodes for t in nodes if (s != t if upper else s < t) and r.random() < 0.3]
    edges = [(s, t, None if r.random() < 0.2 else r.random(), None if r.random() < 0.2 else r.random(), r.random()) for s, t in pairs]
    df = spark.createDataFrame(edges, "src long, dst long, x double, y double, o double")
    got = {(g["src"], g["dst"]): g["value"] for g in chained(df, F.col("x"), F.col("y"), 0.3, F.col("o") if own else None, upper, size=4).collect()}
    said = by_hand(edges, 0.3, own, upper)
    assert set(got) == set(said)
    for k, v in said.items():
        assert (got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, rel_tol=1e-12))
    if own:
        few = chained(df, F.col("x"), F.col("y"), 0.3, F.col("o"), upper, top=2, size=4).collect()
        best = {s: sorted((v is None, -(v or 0.0), t) for (s2, t), v in said.items() if s2 == s)[:2] for s in nodes}
        assert {(s, t) for s, b in best.items() for _, _, t in b} <= {(g["src"], g["dst"]) for g in few}


def test_no_row_for_each_chain(spark):
    """F8: the join on the author in between made a row of each chain; now joins are on blocks."""
    direct = spark.createDataFrame([(a, b, 1.0, a, b) for a in range(60) for b in range(a + 1, 60)], "aid1 long, aid2 long, s_val double, h1 int, h2 int")
    made = []
    real = C.chained
    try:
        C.chained = lambda *a, **k: made.append(real(*a, **k)) or made[-1]
        rows = C.indirect_scores(direct).collect()
    finally:
        C.chained = real
    assert made and len(rows) == 59 * 58 // 2
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "bridge" not in plan
    empty = C.collaboration(direct.limit(0), 5).collect()
    assert empty == []


def _cut(rows, size, most):
    at, a, b, own = (np.array(x) for x in zip(*rows))
    batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + 50]) for x in (at, a, b, own)], ["at", "a", "b", "own"]) for k in range(0, len(at), 50)]
    return [r for batch in P._packed(size, most)((pa.scalar(0), pa.scalar(0)), iter(batches)) for r in batch.to_pylist()]


@pytest.mark.parametrize("most", [10_000, 60])
@pytest.mark.parametrize("chain_s", [0.0, 1.0])
def test_pieces_and_both_ways_of_a_product(monkeypatch, most, chain_s):
    """Cells took 28 bytes each, sent for each pair of blocks; packed pieces give the same product chain by chain and dense."""
    monkeypatch.setattr(P, "CHAIN_S", chain_s)
    monkeypatch.setattr(P, "CHAINS", 100)
    r, size = np.random.default_rng(3), 40
    rows = [(int(r.integers(size * size)), *r.choice([0.5, 1.0, 2.25], 3)) for _ in range(400)]
    want = np.zeros((2, size * size))
    for at, a, b, _ in rows:
        want[0, at] += a
        want[1, at] += b
    left, right = want.reshape(2, size, size)
    pieces = _cut(rows, size, most)
    assert len(pieces) == (1 if most > 400 else 4)
    total = np.zeros((size, size))
    for r0 in range(0, size, 16):
        for x in pieces:
            for y in pieces:
                P._add_product(total[r0 : r0 + 16].reshape(-1), P._Piece(size, x["at"], x["a"]), P._Piece(size, y["at"], y["b"]), lambda v: v, size, r0, min(r0 + 16, size))
    assert np.allclose(total, left @ right, rtol=1e-13)


def test_cells_are_sent_in_few_bytes():
    """on a graph without order every block meets every other, and 24 bytes of a cell were sent each time."""
    r, size = np.random.default_rng(4), 1024
    at = r.choice(size * size, 50_000, replace=False)
    [piece] = _cut([(int(k), *r.choice(np.arange(1, 400) / 7, 3)) for k in at], size, 1_000_000)
    assert max(len(piece["at"]) + len(piece[k]) for k in ("a", "b", "own")) < 5 * len(at)


def test_repeated_edges_add_up_and_results_are_not_shuffled(spark):
    """the product's rows were shuffled twice to get their names. Pairs of authors may come once for each work."""
    r = random.Random(9)
    pairs = [(a, b, r.choice([0.5, 1.0]), a % 4, b % 4) for a in range(0, 90, 3) for b in range(a + 3, 90, 3) for _ in range(r.randrange(3))]
    each = spark.createDataFrame(pairs, "aid1 long, aid2 long, s_val double, h1 int, h2 int")
    direct = each.groupBy("aid1", "aid2").agg(F.sum("s_val").alias("s_val"), F.max("h1").alias("h1"), F.max("h2").alias("h2"))
    for make in (C.indirect_scores, lambda rows: C.collaboration(rows, 5)):
        one, two = ({(x["aid1"], x["aid2"]): x["score"] for x in make(rows).collect()} for rows in (each, direct))
        assert one.keys() == two.keys() and all(math.isclose(one[k], two[k], rel_tol=1e-12) for k in one)
    assert "SortMergeJoin" not in C.indirect_scores(each)._jdf.queryExecution().executedPlan().toString()
    assert P.stripe(60_000, 81_000_000) == 3750 and P.stripe(1000, 10**6) == 1000 and P.stripe(360_000, 486_000_000) == 14_400
