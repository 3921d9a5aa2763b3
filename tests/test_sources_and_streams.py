"""Readers, writers, table changes and streams on small files."""

import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import skills, text
from lodestone.operators import rules, storage, tables, training
from lodestone.operators.graph import dense_ids
from lodestone.sources import readers, writers
from lodestone.streaming import sync

from .oracle import DATA


def test_csv_and_triples(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,x\n1,one,0.5\n2,two,\n")
    assert [tuple(r) for r in readers.csv(spark, str(tmp_path / "a.csv"), "id int, name string, x double", ["id", "x"]).collect()] == [(1, 0.5), (2, None)]
    df = spark.createDataFrame([(1, 2, 3, 0.5), (4, 5, 6, 1.0)], readers.TRIPLES)
    writers.triples(df, str(tmp_path / "kg"))
    assert sorted(tuple(r) for r in readers.triples(spark, str(tmp_path / "kg")).collect()) == [(1, 2, 3, 0.5), (4, 5, 6, 1.0)]


def test_json(spark, tmp_path):
    (tmp_path / "o.json").write_text(json.dumps({"a": "1", "b": "2"}))
    assert sorted(tuple(r) for r in readers.json_object(spark, str(tmp_path / "o.json")).collect()) == [("a", "1"), ("b", "2")]
    (tmp_path / "l.jsonl").write_text('{"k": 1}\n{broken\n{"k": 2}\n')
    assert sorted(r.k for r in readers.json_lines(spark, str(tmp_path / "l.jsonl"), "k int").collect()) == [1, 2]


def test_tiered_lists(spark, tmp_path):
    (tmp_path / "cf.txt").write_text("7;1,2;3;;4,5\nshort;1\n")
    assert [tuple(r) for r in readers.tiered_lists(spark, str(tmp_path / "cf.txt")).collect()] == [(7, [1, 2], [3], [], [4, 5])]


def test_matrix(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(4, 3)
    (tmp_path / "m.bin").write_bytes(x.tobytes())
    got = readers.matrix(spark, str(tmp_path / "m.bin"), 3).orderBy("row").collect()
    assert [list(r.v) for r in got] == x.tolist()


def test_topic_lookup(spark):
    topics = spark.createDataFrame([(2, "Graphs", ["nets"]), (1, "Nets", ["graph"])], "topic_id int, name string, keywords array<string>")
    assert dict(tuple(r) for r in readers.topic_lookup(topics).collect()) == {"graphs": 2, "graph": 2, "nets": 1, "net": 1}


def test_snapshot(spark, tmp_path):
    a = spark.range(5).toDF("id")
    first = writers.snapshot(a, str(tmp_path / "s"), a)
    again = writers.snapshot(a.where("false"), str(tmp_path / "s"), a)
    assert first.count() == again.count() == 5
    assert writers.snapshot(a.where("id > 1"), str(tmp_path / "s"), a.where("id > 1")).count() == 3


def test_contract_fails_loudly(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    with pytest.raises(PySparkException):
        tables.demanded(spark.range(3), F.col("id") < 2, "too large").collect()


def test_dense_ids(spark):
    df = spark.range(100).selectExpr("concat('k', lpad(id * 7 % 100, 3, '0')) as k")
    got = dense_ids(df, "k", 10).orderBy("id").collect()
    assert [r.id for r in got] == list(range(10, 110)) and [r.k for r in got] == sorted(r.k for r in got)
    assert dense_ids(df.where("false"), "k").count() == 0


def test_sample_is_stable(spark):
    df = spark.range(1000).toDF("k")
    assert training.sampled(df, "k", 10).collect() == training.sampled(df.repartition(7), "k", 10).collect()


def test_stream_restarts_without_double_counts(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.repartition(3, "event_id").write.parquet(str(tmp_path / "in"))
    run = lambda: sync.synchronised(sync.source(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), lambda df: df.where("event_type <> 'error'"))
    run().awaitTermination()
    n = events.where("event_type <> 'error'").count()
    assert spark.read.parquet(str(tmp_path / "out")).count() == n
    events.limit(5).write.mode("append").parquet(str(tmp_path / "in"))
    run().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == n + events.limit(5).where("event_type <> 'error'").count()


def test_running_sums(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    events.unionByName(events.limit(10)).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = sync.accumulated(sync.source(spark, str(tmp_path / "in")), ["event_type"], "value", "40 days").writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.event_type: r["count"] for r in events.groupBy("event_type").count().collect()}
    assert {r.event_type: r.n for r in spark.sql("select * from sums").collect()} == want


def test_windows(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(str(tmp_path / "in"))
    q = sync.windowed(sync.source(spark, str(tmp_path / "in")), ["event_type"], "value").writeStream.outputMode("append").format("memory").queryName("days").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select * from days").count() > 0


def test_markers_shards_and_turns(spark, tmp_path):
    path = str(tmp_path / "marker")
    read = lambda: [r.marker for r in sync.stored_marker(spark, path).collect()]
    assert read() == ["1970-01-01"]
    sync.marker_set(spark, path, "2001-02-03")
    assert read() == ["2001-02-03"]
    sync.marker_set(spark, path, None)
    sync.marker_set(spark, path, None)
    assert read() == ["1970-01-01"]
    df, out = spark.range(100).withColumn("x", F.col("id") * 2), str(tmp_path / "shards")
    assert sync.in_shards(df, "id", 4, out) == [0, 1, 2, 3] and sync.in_shards(df, "id", 4, out) == []
    got = readers.shards(spark, out)
    assert sorted(r.id for r in got.collect()) == list(range(100)) and {r.shard for r in got.select("shard").distinct().collect()} == {0, 1, 2, 3}
    turns = list(readers.in_turn(df, "id", 30))
    assert [len(t) for t in turns] == [30, 30, 30, 10] and [r.id for t in turns for r in t] == list(range(100))


def test_swapped_table(spark):
    spark.range(5).write.mode("overwrite").saveAsTable("swap_me")
    tables.swapped(spark.table("swap_me").where("id > 2"), "swap_me")
    assert sorted(r.id for r in spark.table("swap_me").collect()) == [3, 4]
    # A stop between the two renames: the old table is there under its other name, and the next swap puts it back first.
    spark.sql("alter table swap_me rename to swap_me_old")
    spark.range(7, 9).write.saveAsTable("swap_me_new")
    tables.swapped(spark.range(10, 12), "swap_me")
    assert sorted(r.id for r in spark.table("swap_me").collect()) == [10, 11] and not spark.catalog.tableExists("swap_me_old")
    spark.sql("drop table swap_me")


def test_stored_tables_follow_their_input(spark, tmp_path):
    path = str(tmp_path / "in")
    count = lambda *settings: storage.once(spark, "n", path, lambda: spark.read.parquet(path).groupBy().count(), *settings).first()[0]
    spark.range(5).write.parquet(path)
    assert count() == 5
    spark.range(9).write.mode("overwrite").parquet(path)
    assert count() == 9
    made = []
    storage.once(spark, "n", path, lambda: made.append(1) or spark.range(1), 10)
    storage.once(spark, "n", path, lambda: made.append(2) or spark.range(1), 20)
    storage.once(spark, "n", path, lambda: made.append(3) or spark.range(1), 20)
    assert made == [1, 2]
    storage.forget("n", path)
    storage.once(spark, "n", path, lambda: made.append(4) or spark.range(1), 20)
    assert made == [1, 2, 4]


def test_markers_survive_a_stop(spark, tmp_path):
    path = str(tmp_path / "marker")
    sync.marker_set(spark, path, "2001-01-01")
    sync.marker_set(spark, path, "2001-02-02")
    (tmp_path / "marker" / "v=9").mkdir()  # begun, never finished
    assert sync.stored_marker(spark, path).first().marker == "2001-02-02"
    sync.marker_set(spark, path, "2001-03-03")
    assert sync.stored_marker(spark, path).first().marker == "2001-03-03"


def test_shards_are_written_in_one_reading(spark, tmp_path):
    path, df = str(tmp_path / "shards"), spark.range(3)
    assert sync.in_shards(df, "id", 8, path) == list(range(8)) and sync.in_shards(df, "id", 8, path) == []
    assert sorted(r.id for r in spark.read.schema("id long").parquet(path).collect()) == [0, 1, 2]
    held = next(k for k in range(8) if list((tmp_path / "shards" / f"shard={k}").glob("*.parquet")))
    shutil.rmtree(tmp_path / "shards" / f"shard={held}")
    assert sync.in_shards(df, "id", 8, path) == [held]
    assert sorted(r.id for r in spark.read.schema("id long").parquet(path).collect()) == [0, 1, 2]


def test_skills_need_compatibility_composition(spark):
    """Full-width letters and marks, and rules of a skill's normal form by hand."""
    texts = ["熟悉Ｐｙｔｈｏｎ（３）", "掌握 深度学习 框架；推动项目落地", None, "", "C++、Ｃ", "mujoco 等机器人常用开发库"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", skills.extracted(F.col("t")).alias("s")).collect()}
    assert got == {0: ["python"], 1: ["深度学习"], 2: [], 3: [], 4: ["c"], 5: ["mujoco"]}


def test_clauses_by_hand(spark):
    long = "x" * 40
    said = ["short", "a clause that is long enough", "A CLAUSE that is  long enough", long + " one", long + " two", "the whole query itself", None, *[f"clause number {k} is here" for k in range(9)]]
    df = spark.createDataFrame([(said, ["The whole query itself", None])], "c array<string>, w array<string>")
    got = df.select(rules.selected_clauses(F.col("c"), F.col("w")).alias("s")).first().s
    assert got == ["a clause that is long enough", long + " one", *[f"clause number {k} is here" for k in range(4)]]


#: A query text, then its lexical terms and acronyms as read off the rule by a person.
SURFACES = [
    ("We use SLAM and ROS2", [], ["SLAM", "We", "ROS2"]),
    ("MPC/iLQR", ["MPC/iLQR"], ["MPC", "iLQR"]),
    ("the cat, THE dog", ["cat", "dog"], ["THE"]),
    ("机器人控制 PyTorch1", ["PyTorch1", "机器人控制"], ["PyTorch1"]),
    ("aB x9 a9b", [], ["x9", "a9b", "aB"]),
    ("GPU+CPU", ["GPU+CPU"], ["GPU", "CPU", "GPU+CPU"]),
    ("", [], []),
    (None, [], []),
]


def test_surface_terms_by_hand(spark):
    none = F.lit(None).cast("string")
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(SURFACES)], "i int, t string")
    got = {r.i: (r.s.lexical, r.s.acronym, r.s.method) for r in df.select("i", text.surface_terms(F.col("t"), none, none, none).alias("s")).collect()}
    for i, (said, lexical, acronym) in enumerate(SURFACES):
        assert got[i] == (lexical, acronym, []), said
    many = spark.createDataFrame([(" ".join(f"Word{k}x" for k in range(150)),)], "t string").select(text.surface_terms(F.col("t"), none, none, none).alias("s")).first().s
    assert len(many.acronym) == 64 and many.lexical == [f"Word{k}x" for k in range(96)]

