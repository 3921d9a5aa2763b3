"""Expressions name what they compute once: a copy for each use multiplies the work."""

from pyspark.sql import functions as F

from lodestone.functions import skills, text


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_skill_is_normalised_once(spark):
    """each test on a skill held the whole normal form anew."""
    df = spark.createDataFrame([("熟悉Python，C",)], "t string").select(skills.extracted(F.col("t"), compose=False).alias("s"))
    assert df.first().s == ["c", "python"]
    assert plan(df).count("任职要求● ".rstrip("● ") + "|岗位职责|核心要求|加分项|基本要求|工作职责|职位描述)[") == 1
    one = spark.createDataFrame([("熟练使用  Git ",), ("熟练使用",), ("x熟练使用 y",)], "t string").select(skills.normalised(F.col("t"), compose=False).alias("s"))
    assert [r.s for r in one.collect()] == ["git", "", "x熟练使用 y"]


def test_acronyms_are_found_once(spark):
    """the list of acronyms was in the test on each lexical term, and all lists in each field read."""
    none = F.lit(None).cast("string")
    found = spark.createDataFrame([("We use SLAM and ROS2",)], "t string").select(text.surface_terms(F.col("t"), none, none, none).alias("s"))
    df = found.select("s.lexical", "s.acronym", "s.method")
    assert tuple(df.first()) == ([], ["SLAM", "We", "ROS2"], [])
    assert plan(df).count("[A-Z]{2,}") == 1
