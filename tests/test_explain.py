"""Walks, their ranks and the works that stand for authors, on small tables."""

import itertools
import random

from lodestone.operators import explain


def test_walks_against_all_combinations(spark):
    rng = random.Random(3)
    seeds = [(q, n, rng.choice([0.5, 1.0])) for q in (1, 2) for n in rng.sample(range(6), 3)]
    first = [(a, 10 + b, rng.choice([0.25, 0.5])) for a in range(6) for b in rng.sample(range(5), 2)]
    second = [(10 + a, 20 + b, rng.choice([0.5, 1.0])) for a in range(5) for b in rng.sample(range(4), 2)]
    want = {}
    for (q, n, w), (a, b, x), (c, d, y) in itertools.product(seeds, first, second):
        if n == a and b == c:
            want.setdefault((q, d), []).append((-w * x * y, f"A:{a}>{b} B:{c}>{d}"))
    frame = lambda rows: spark.createDataFrame(rows, "src int, dst int, weight double")
    walks = explain.step(explain.step(explain.started(spark.createDataFrame([*seeds, (None, 1, 1.0), (1, None, 1.0), (1, 1, None)], "query_id int, node int, weight double")), frame(first), "A"), frame(second), "B")
    got = {}
    for r in explain.best(walks, 2).collect():
        got.setdefault((r.query_id, r.node), {})[r.rank] = (-r.weight, r.path)
        assert [e.kind for e in r.chain] == ["A", "B"] and r.chain[0].dst == r.chain[1].src and r.chain[1].dst == r.node
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: sorted(v)[:2] for k, v in want.items()}
    shares = {}
    for r in explain.carriers(walks, "A").collect():
        shares[r.query_id, r.node] = shares.get((r.query_id, r.node), 0) + r.share
    assert set(shares) == set(want) and all(abs(s - 1) < 1e-9 for s in shares.values())
    assert explain.best(explain.step(walks, frame([]), "C"), 2).collect() == []


def test_representative_work(spark):
    rows = [
        (1, 1, "label", 10, "L", 9.0), (1, 1, "Vector ", 11, " V ", 0.1), (1, 1, "vector", 12, "", 5.0), (1, 1, "vector", 13, "W", None),
        (1, 2, "collab", 20, "C", 1.0), (1, 2, "label", None, "N", 3.0), (1, 2, "label", 22, "B", 1.0), (1, 2, "label", 21, "A", 1.0),
        (1, 3, "other", 30, "X", 1.0), (1, 4, "collab", 40, None, 1.0), (1, 5, "collab", 50, "Z", 0.0),
    ]
    got = explain.representative(spark.createDataFrame(rows, "query_id int, author_id int, path string, work_id int, title string, score double")).collect()
    assert {r.author_id: (r.work_id, r.title, r.path, r.match_type) for r in got} == {1: (11, "V", "vector", "vector_pool_evidence"), 2: (21, "A", "label", "label_pool_evidence"), 5: (50, "Z", "collab", "collab_pool_evidence")}


def test_merged_walks_carry_the_same_shares(spark):
    """each walk to a work went on to each of its authors with all of its edges."""
    rows = [("q", 1, 0.5), ("q", 2, 0.25), ("r", 1, 1.0)]
    start = explain.started(spark.createDataFrame(rows, "query_id string, node long, weight double"))
    topic = spark.createDataFrame([(1, 10, 0.5), (2, 10, 0.5), (1, 11, 1.0)], "src long, dst long, weight double")
    wrote = spark.createDataFrame([(10, 7, 0.5), (10, 8, 0.5), (11, 7, 1.0)], "src long, dst long, weight double")
    works = explain.step(start, topic, "TOPIC")
    every, few = (explain.step(w, wrote, "AUTHORED") for w in (works, explain.merged(works)))
    assert (every.count(), few.count()) == (8, 6)
    told = [sorted((*r[:3], round(r.share, 12)) for r in explain.carriers(x, "TOPIC").collect()) for x in (every, few)]
    assert told[0] == told[1] and len(told[0]) == 6


def test_fanned_walks_are_those_of_all_walks(spark):
    """the best walks of an author without a row for each walk, ties and all."""
    rng = random.Random(11)
    frame = lambda rows: spark.createDataFrame(rows, "src int, dst int, weight double")
    seeds = explain.started(spark.createDataFrame([(q, n, rng.choice([0.5, 1.0])) for q in (1, 2) for n in range(6)], "query_id int, node int, weight double"))
    begun = explain.step(seeds, frame([(a, 10 * b, rng.choice([0.25, 0.5])) for a in range(6) for b in rng.sample(range(1, 13), 4)]), "A")
    edges = frame([(10 * b, w, 1.0 / rng.choice([1, 2, 4])) for b in range(1, 13) for w in rng.sample(range(90, 130), 12)])
    ends = {w: rng.sample(range(8), 1 + w % 3) for w in range(90, 125)}
    fans = spark.createDataFrame([(w, e, 1.0 / len(e)) for w, e in ends.items()], "src int, ends array<int>, weight double")
    every = explain.step(explain.step(begun, edges, "B"), frame([(w, a, 1.0 / len(e)) for w, e in ends.items() for a in e]), "C")
    key = lambda r: (r.query_id, r.node, r.rank, r.weight, r.path)
    for k in (1, 3):
        want = sorted(key(r) for r in explain.best(every, k).collect())
        assert sorted(key(r) for r in explain.best_fanned(begun, edges, fans, ("B", "C"), k).collect()) == want and len(want) == 16 * k
