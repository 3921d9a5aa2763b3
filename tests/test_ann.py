"""The inverted-file index against the exact search."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ann
from lodestone.operators.vectors import top_k

from .oracle import DATA


def clustered(rng, n, centres, dim=16, noise=0.15):
    out = []
    for k in range(n):
        c = centres[rng.randrange(len(centres))]
        out.append((k, [x + rng.gauss(0, noise) for x in c]))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = clustered(rng, 1500, centres) + [(5000 + k, centres[0]) for k in range(700)]
    items = spark.createDataFrame(rows, "item_id long, v array<double>").repartition(5)
    queries = items.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("v").alias("q"))
    return queries, items


@pytest.fixture(scope="module")
def index(tables, tmp_path_factory):
    return ann.build(tables[1], str(tmp_path_factory.mktemp("ann") / "index"), 24)


def rows(df):
    return sorted((r.query_id, r.rank, r.item_id, round(r.score, 9)) for r in df.collect())


def test_all_items_are_in_their_nearest_cell(spark, tables, index):
    held, cents = index.items(spark), index.centroids(spark).collect()
    assert held.count() == 2200 and {r.cell for r in held.select("cell").distinct().collect()} == {c.cell for c in cents}
    assert sum(c.n for c in cents) == 2200
    for r in held.where("item_id % 97 = 0").collect():
        gaps = {c.cell: sum((a - b) ** 2 for a, b in zip(r.v, c.c, strict=True)) for c in cents}
        assert gaps[r.cell] <= min(gaps.values()) + 1e-9
        assert gaps[r.cell] ** 0.5 <= next(c.radius for c in cents if c.cell == r.cell) + 1e-9


def test_exact_mode_equals_full_search(tables, index):
    assert rows(ann.exact(tables[0], index, 10, probes=2)) == rows(top_k(*tables, 10))


def test_recall_over_all_queries(tables, index):
    probes = ann.probes_for(tables[0], index, 10, 0.9, sample=16)
    assert 1 <= probes <= 6
    each = ann.recall(ann.search(tables[0], index, 10, probes), top_k(*tables, 10)).agg(F.avg("recall")).first()[0]
    assert each >= 0.9


def test_recall_of_the_registered_search(spark):
    from lodestone.plans.registry import QUERIES

    got = ann.recall(QUERIES["join33_index_search"](spark, DATA), QUERIES["vec01_top_k"](spark, DATA))
    assert got.agg(F.avg("recall")).first()[0] >= 0.9


def test_only_probed_cells_are_scanned(spark, tables, index):
    one = tables[0].where("query_id = 50")
    plan = ann.search(one, index, 5, 2)._jdf.queryExecution().toString()
    scan = [line for line in plan.splitlines() if "PartitionFilters" in line and "cell" in line]
    assert scan and "cell#" in scan[-1].split("PartitionFilters")[1] and "IN (" in scan[-1].split("PartitionFilters")[1]
    read = ann._hits(ann.stored(ann.ranked_cells(one, index).where("place <= 2").select("query_id", "q", "cell")), index)
    assert read.count() < 2200


def test_defined_cases(spark, tmp_path):
    nothing = spark.createDataFrame([], "item_id long, v array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [float("nan"), 1.0])], "query_id long, q array<double>")
    empty = ann.build(nothing, str(tmp_path / "a"), 4)
    assert ann.search(asked, empty, 3, 2).collect() == [] and ann.exact(asked, empty, 3).collect() == []
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("inf"), 0.0]), (5, [0.0, 1.0])], "item_id long, v array<double>")
    few = ann.build(items, str(tmp_path / "b"), 10)
    assert few.cells == 2
    assert [r[2] for r in rows(ann.exact(asked, few, 3))] == [1, 2, 2]
    assert [r[2] for r in rows(ann.search(asked, few, 9, 1))] == [1, 2, 2]


def test_only_what_may_count_becomes_a_row(tables, index, monkeypatch):
    """every query and item of a probed cell was a row, and every query and cell one with the query's vector."""
    order = ann.stored(ann.cell_order(tables[0], index))
    assert order.count() == tables[0].count()
    cells = order.withColumn("cells", ann._cells(F.col("cells")))
    every = tables[0].count() * 2200
    assert ann._hits(cells, index).count() == every
    assert ann._hits(cells, index, 10).where("query_id < 5000").count() < 0.2 * tables[0].where("query_id < 5000").count() * 2200
    monkeypatch.setattr(ann, "BLOCK", 9)
    assert rows(ann.exact(tables[0], index, 10, probes=2)) == rows(top_k(*tables, 10))


def test_learning_is_bounded(spark):
    from lodestone.plans import retrieval

    asked = []
    keep, ann.build = ann.build, lambda items, path, cells: asked.append(cells)
    most, ann.MOST_CELLS = ann.MOST_CELLS, 3
    try:
        retrieval._index(spark, DATA)
    finally:
        ann.build, ann.MOST_CELLS = keep, most
    assert asked == [3]
