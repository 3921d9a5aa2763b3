"""Searches that screen pairs by products of matrices, against every pair by hand."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import vectors


def dot(a, b):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


@pytest.mark.parametrize("block", [2000, 4])
def test_screened_pairs_have_all_that_count(spark, monkeypatch, block):
    """Most pairs are never rows; ties, copies and odd vectors are as they were."""
    monkeypatch.setattr(vectors, "BLOCK", block)
    r = random.Random(4)
    some = [[r.gauss(0, 1) for _ in range(7)] for _ in range(60)]
    items = [(i, some[i % 60], i % 4) for i in range(300)] + [(300, None, 1), (301, [1.0, 2.0], 2), (302, [None] * 7, 3), (303, [], 0), (304, [1e200] * 7, 1), (305, some[0], None)]
    queries = [(i, some[i], i % 4) for i in range(0, 40, 4)] + [(900, None, 1), (901, [3.0, 1.0], 0)]
    a, b = spark.createDataFrame(queries, "query_id int, q array<double>, la int"), spark.createDataFrame(items, "item_id int, v array<double>, label int")
    want = {}
    for q, x, _ in queries:
        hits = sorted(((dot(x, y), i) for i, y, _ in items), key=lambda s: (s[0] is None, -(s[0] or 0.0), s[1]))[:8]
        want |= {(q, k): (i, s) for k, (s, i) in enumerate(hits, 1)}
    found = vectors.top_k(a.drop("la"), b.drop("label"), 8)
    assert {(x.query_id, x.rank): (x.item_id, x.score) for x in found.collect()} == want
    pairs = [x for f in vectors.scored_pairs(a, b, 1.0, k=2, high=4.0, apart=("la", "label")) for x in f.collect()]
    got = {(x.query_id, x.item_id): x.score for x in pairs}
    for q, x, g in queries:
        every = sorted(((-dot(x, y), i) for i, y, h in items if h is not None and g != h and (dot(x, y) or 0) >= 1.0))
        assert {(q, i) for s, i in every[:2]} | {(q, i) for s, i in every if -s >= 4.0} <= set(got)
        assert all(i in {e[1] for e in every} for q2, i in got if q2 == q)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Cross" not in plan


def test_cross_anchor_pairs_are_screened(spark, tmp_path):
    """what the query ranks are the pairs that tasks kept, not all pairs."""
    from lodestone.plans import more  # noqa: F401
    from lodestone.plans.registry import QUERIES

    r = random.Random(6)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], i % 3) for i in range(101)]
    spark.createDataFrame(rows, "vec_id int, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = QUERIES["join29_cross_anchor_pairs"](spark, str(tmp_path))
    assert "MapInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.groupBy("a").count().orderBy("a").collect() == [(0, 4), (50, 4), (100, 4)]
