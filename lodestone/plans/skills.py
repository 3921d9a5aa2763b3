"""Queries on skills in job texts. The texts are phrases that the rules tell apart, by number of customer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import skills as K
from .registry import query

PHRASES = [
    "熟悉Python", "掌握 深度学习 框架", "C", "具备良好的沟通能力", "motion control", "精通Linux开发经验", "推动项目落地", "ROS2", "从设计到交付", "对系统进行优化", "学历不限", "isaac sim robot learning framework",
    "we are looking for people who like to build things", "mujoco 等机器人常用开发库", "扎实的数学基础", "状态估计", "SLAM (simultaneous localization)", "2024届", "c++17", "包括但不限于 mpc", "包括各种", "最优控制算法研发", "全身控制算法的设计与部署", "五险一金", "x",
    "机器学习算法", "任职要求● 掌握 强化学习", "系统的平滑性", "高性能", "a b c d", "熟练使用Git", "线性代数", "Kubernetes.", "形成知识沉淀", "gazebo等平台搭建仿真环境", "trajectory optimization", "averyveryverylongsinglewordthatgoeson here", "教授", "5G", "论文",
]
_N = len(PHRASES)
_MARKS = ["，", "、", ";", "/"]


def _phrase(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (k % _N + 1).cast("int"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    mark = F.element_at(F.array(*[F.lit(m) for m in _MARKS]), (k % 4 + 1).cast("int"))
    return X.raw(spark, d, "customer").select("c_custkey", _phrase(k).alias("p"), F.concat(_phrase(k), mark, _phrase(k * 7 + 3), mark, F.lit(" "), _phrase(k * 3 + 11)).alias("text"))


def _list(x: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in x) + "]"


_TEXTS = f"""t AS (SELECT *, p || m || {_list(PHRASES)}[(c_custkey * 7 + 3) % {_N} + 1] || m || ' ' || {_list(PHRASES)}[(c_custkey * 3 + 11) % {_N} + 1] AS text
    FROM (SELECT c_custkey, {_list(PHRASES)}[c_custkey % {_N} + 1] AS p, {_list(_MARKS)}[c_custkey % 4 + 1] AS m FROM customer))"""


def _any(x: str, tests: list[K.Test]) -> str:
    def one(t: K.Test) -> str:
        parts = [f"length({x}) >= {t.least}", *[f"regexp_matches({x}, '{p}')" for p in t.match], *[f"NOT regexp_matches({x}, '{p}')" for p in t.miss]]
        return "(" + " AND ".join(parts if t.most is None else [*parts, f"length({x}) <= {t.most}"]) + ")"

    return "(" + " OR ".join(map(one, tests)) + ")"


def _norm(x: str) -> str:
    out = f"lower(trim({x}))"
    for p in (K.HEADER, K.BULLET, K.PREFIX):
        out = f"regexp_replace({out}, '{p}', '')"
    out = f"regexp_replace({out}, '^熟练使用 *', '')"
    out = f"regexp_replace(regexp_replace({out}, '{K.SUFFIX}', ''), '[(（].*?[)）]', '', 'g')"
    return f"regexp_replace(trim(regexp_replace({out}, '\\s+', ' ', 'g')), '^[.,;；。:：]+|[.,;；。:：]+$', '', 'g')"


def _in(x: str, words: list[str]) -> str:
    return f"list_contains({_list(words)}, {x})"


def _bad(x: str) -> str:
    digits = f"(regexp_matches({x}, '[0-9]') AND NOT {_in(x, K.DIGIT_SKILLS)} AND NOT regexp_matches({x}, '(?i)^[a-z+]+[0-9.+\\-]+$'))"
    long = f"(length({x}) > 25 AND NOT ({_any(x, K.PRESERVED)} AND length({x}) <= 60))"
    return f"({_any(f'trim({x})', K.FRAGMENT)} OR {_in(x, K.NO_SKILLS)} OR {_any(x, K.BAD)} OR {_any(x, K.GENERIC)} OR {digits} OR {long} OR (length({x}) <= 1 AND NOT {_in(x, K.SHORT_SKILLS)}))"


_SHORT = f"""CASE WHEN length(n) > 15 AND contains(n, ' ') AND NOT {_any('n', K.PRESERVED)} AND NOT regexp_matches(n, '[\\x{{4e00}}-\\x{{9fff}}]')
    AND (len(w) >= 6 OR length(n) > 60 OR (len(w) >= 4 AND len(list_filter(w, lambda y: NOT regexp_matches(y, '^[a-zA-Z][a-zA-Z0-9+\\-./]{{1,17}}$'))) > 0) OR len(list_filter(w, lambda y: length(y) > 18)) > 0) AND length(w[1]) <= 20 THEN w[1] ELSE n END"""
_TOOL = f"nullif(regexp_extract(n, '{K.TOOL_LISTING}', 1), '')"


@query("str04_normalised_skills", f"WITH {_TEXTS} SELECT c_custkey, {_norm('p')} AS skill FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("c_custkey", K.normalised(F.col("p")).alias("skill"))


@query("str05_extracted_skills", f"""WITH {_TEXTS}, s AS (SELECT c_custkey, unnest(regexp_split_to_array(text, '{K.SPLIT}')) AS part FROM t), n AS (SELECT *, {_norm('part')} AS n FROM s WHERE trim(part) <> ''),
    o AS (SELECT c_custkey, trim(part) AS raw, {_SHORT} AS n FROM (SELECT *, string_split(n, ' ') AS w FROM n)),
    k AS (SELECT c_custkey, raw, n, {_TOOL} AS tool FROM o WHERE n <> '' AND NOT {_any('trim(n)', K.FRAGMENT)} AND NOT {_any('raw', K.FRAGMENT)})
    SELECT DISTINCT c_custkey, coalesce(tool, n) AS skill FROM k WHERE NOT {_bad('coalesce(tool, n)')}""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("c_custkey", F.explode(K.extracted(F.col("text"))).alias("skill"))


@query("str06_bad_skills", f"WITH {_TEXTS}, n AS (SELECT c_custkey, {_norm('p')} AS n FROM t) SELECT c_custkey, {_bad('n')} AS bad FROM n")
def _(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("c_custkey", K.is_bad(K.normalised(F.col("p"))).alias("bad"))


@query("str07_generic_fragments", f"WITH {_TEXTS} SELECT c_custkey, {_any('text', K.GENERIC)} AS whole, {_any('p', K.GENERIC)} AS part FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("c_custkey", K.is_generic(F.col("text")).alias("whole"), K.is_generic(F.col("p")).alias("part"))


@query("str08_peeled_and_shortened", f"WITH {_TEXTS}, n AS (SELECT c_custkey, n, string_split(n, ' ') AS w FROM (SELECT c_custkey, {_norm('p')} AS n FROM t)) SELECT c_custkey, {_SHORT} AS short, {_TOOL} AS tool FROM n")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = texts(spark, d).select("c_custkey", K.normalised(F.col("p")).alias("n"))
    return n.select("c_custkey", K.shortened(F.col("n")).alias("short"), K.peeled(F.col("n")).alias("tool"))


@query("str09_sentence_fragments", f"WITH {_TEXTS} SELECT c_custkey, {_any('trim(p)', K.FRAGMENT)} AS fragment FROM t")
def _(spark: SparkSession, d: str) -> DataFrame:
    return texts(spark, d).select("c_custkey", K.is_fragment(F.col("p")).alias("fragment"))
