"""Places that no task counts alone, and cuts that are made before rows are sent."""

import random

from pyspark.sql import functions as F

from lodestone.operators import label, papers
from lodestone.operators.ranks import placed


def test_places_are_those_of_a_window(spark):
    """ties, a null group and a group in many ranges."""
    r = random.Random(2)
    rows = [(r.choice([1, 1, 1, 2, None]), r.randrange(20) / 4, k) for k in range(600)]
    df = spark.createDataFrame(rows, "query_id int, x double, work_id int").repartition(7)
    found = placed(df, "query_id", [F.desc("x"), F.asc("work_id")], "place")
    assert found.columns == ["query_id", "x", "work_id", "place"] and "Window" not in found.drop("place")._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for q in (1, 2, None):
        for at, (_, _, k) in enumerate(sorted((x for x in rows if x[0] == q), key=lambda x: (-x[1], x[2])), 1):
            want[k] = at
    assert {x.work_id: x.place for x in found.collect()} == want
    assert placed(df.where("x > 9"), "query_id", [F.desc("x"), F.asc("work_id")], "place").count() == 0


def test_ranks_and_selection_send_little(spark):
    """no window holds all works of a query."""
    works = spark.createDataFrame([(q, w, (w * 7 % 13) / 13, (w * 5 % 11) / 11) for q in (1, 2) for w in range(60)], "query_id int, work_id int, protected double, compete double")
    rows = papers.reselected(works, 5)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    kept = papers.selected(works, 5)
    assert "WindowGroupLimit" in kept._jdf.queryExecution().executedPlan().toString()
    key = lambda r: (r.query_id, r.work_id)
    assert sorted(map(key, kept.collect())) == sorted(key(r) for r in rows.where("moved in ('kept', 'in')").collect())


def test_gate_cuts_before_it_sends(spark):
    """A term's works don't all go to one task."""
    pairs = spark.createDataFrame([(1, w, w % 2, 0.5, 1.0 / (w + 1), 0.2, 0.9) for w in range(40)], "query_id int, work_id int, voc_id int, idf double, value double, grounding double, align double")
    rows = label.gated(pairs, {"primary": 15, "secondary": 3})
    assert "WindowGroupLimit" in rows._jdf.queryExecution().executedPlan().toString() and rows.count() == 30
