"""Weighted authorships and teams."""

from lodestone.operators import collaboration as C


def test_many_authorships_are_dealt_out_by_number(spark, monkeypatch):
    """partitions were merged by their compressed size, and a task sorted and counted millions of rows."""
    rows = [(w, a % 7, a, 0, 0) for w in range(200) for a in range(1 + w % 4)]
    authorships = spark.createDataFrame([*rows, *rows[:40]], "work_id long, author_id long, pos_index int, is_corresponding int, is_alphabetical int")
    works = spark.createDataFrame([(w, 1990 + w % 10) for w in range(190)], "work_id long, year int")
    authors = spark.createDataFrame([(a, a) for a in range(7)], "author_id long, h_index int")
    plain = C.weighted_authorships(authorships, works, authors)
    want, teams = sorted(map(tuple, plain.collect())), sorted(map(tuple, C.team_sized(plain).collect()))
    assert {r[0] for r in teams} == {w for w in range(190) if w % 4}
    monkeypatch.setattr(C, "ROWS", 20)
    monkeypatch.setattr(C, "MANY", 100)
    dealt = C.weighted_authorships(authorships, works, authors)
    assert dealt.rdd.getNumPartitions() == -(-authorships.count() // 20)
    assert sorted(map(tuple, dealt.collect())) == want and sorted(map(tuple, C.team_sized(dealt).collect())) == teams
    assert C.team_sized(dealt)._jdf.queryExecution().optimizedPlan().toString().count("Join") == plain._jdf.queryExecution().optimizedPlan().toString().count("Join")
