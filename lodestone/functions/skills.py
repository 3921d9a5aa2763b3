"""Skills out of job texts: normal form, predicates on what is no skill, and the extraction (STR-03 to STR-09).

A predicate is a list of tests, and holds if one of them does; a test is data, so the same list reads as a column
expression here and as SQL elsewhere.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class Test:
    """All of `match` are found, none of `miss`, and the length lies between least and most."""

    match: tuple[str, ...] = ()
    miss: tuple[str, ...] = ()
    least: int = 0
    most: int | None = None


# Patterns and words of the rules.
SPLIT = r"[，,、/|;；+&\\。！!：:]"
HEADER = r"^(任职要求|岗位职责|核心要求|加分项|基本要求|工作职责|职位描述)[\s●▪•·]*"
BULLET = r"^[\s.()（）●▪•·\x{2022}\x{2023}\x{2043}\x{00b7}]+"
PREFIX = r"^(发表|要求|需|需要|熟悉|了解|掌握|精通|具备|能够|可以|负责|参与|从事|有|具有|擅长|使用|应用|在|利用|调研|对|研发与优化|建立|推动|开展|持续关注|包括但不限于|针对|确保)"
SUFFIX = r"(开发经验|项目经验|相关经验|实践经验|研究经验|经验|能力|背景|优先|编程|框架|专家|工程师|研究员|总裁|总监|经理|产品|职称|为主|技术员|顾问|领军人物|企业|行业|工作|证书|职位|主任|招聘|优秀论文|论文|竞赛|奖|等)$"
NOISE = r"(专业|学历|论文|竞赛|获奖|五险|出差|销售|工作语言|团队|沟通|表达|责任心|执行力|学习能力|抗压|汇报|学校|负责人|相关|经验|经验者|任职要求|岗位职责|核心要求|加分项|基本要求|工作职责|职位描述)"
NO_SKILLS = (
    "不限 其他 相关 方向 经验 能力 背景 周末双休 年终奖 企业 行业核心期刊发表过文章 小学生 五险一金 五险 一金 社保 公积金 "
    "高端人才 教授 副教授 助理教授 讲师 研究员 往届生 应届生 职称 应聘者 博士 硕士 研究生 本科 中共党员 "
    "公立学校 事业单位 科研机构 甲方公司 双休 职业与技能培训类 技术类 管理类 高性能 系统架构"
).split()
SHORT_SKILLS = "c c++ go r py js sql".split()
DIGIT_SKILLS = (
    "5g 3d ros2 python3 java8 java11 c++11 c++14 c++17 c++20 vue2 vue3 react16 react18 angular2+ angular4+ tensorflow2 pytorch1 "
    "hadoop2 hadoop3 spark2 spark3 http2 http3 ipv4 ipv6 4k 8k 1080p 720p 2d 4d 2.5d 2.4g 5.8g 2.4ghz 5ghz"
).split()
_CJK, _LATIN = r"[\x{4e00}-\x{9fff}]", r"(?i)[a-z]{2,}"
_JUDGED = "(高要求|优秀|扎实|良好)"
_ACTION = "^(推动|提升|形成|开展|确保|调研)"
TOOL_LISTING = r"(?i)^([a-z][a-z0-9+\-./]*)\s*(等机器人常用开发库|等平台搭建仿真环境)"
_TOKEN = r"[a-zA-Z][a-zA-Z0-9+\-./]{1,17}"
_WHOLE = rf"^{_TOKEN}( {_TOKEN}){{1,4}}$"

#: STR-09: remains of sentences.
FRAGMENT = [Test(("^进行.",)), Test(("从.+到",)), Test(("对.+进行",)), Test(("^推动.",)), Test(("实现与落地",))]
#: STR-07: general remarks of more than five characters.
GENERIC = [
    Test(("的$",), least=6), Test(("的.*的",), least=6), Test(("的",), least=19), Test(("与可执行性",), least=6), Test(("系统的平滑性",), least=6), Test(("扎实", "工程实现"), least=6),
    Test((_ACTION,), least=8), Test((_ACTION, _JUDGED), least=6), Test((_ACTION, "的"), least=6), Test((_JUDGED,), least=8), Test((_JUDGED, "工程"), least=6),
    Test(("(鲁棒性|可执行性|平滑性|系统化思维|沟通协作能力)$",), least=6),
]
#: Phrases with spaces that stay whole.
PRESERVED = [Test((" ", _CJK)), Test((_WHOLE,), most=60)]


#: STR-06, but for the words and the parts that other predicates give.
BAD = [
    Test(("的",), least=21), Test(("(等相关|等工具|等库|等常见)",)), Test((NOISE,)), Test(("能力",), least=7), Test(("类$",)), Test(("(发表|参加|参与|获得|承担).*(论文|竞赛|比赛|奖)",)),
    Test(("^(对系统|建立高|技术追踪|建立高性能|构建高性能|实现高性能)",)), Test(("(技术文档|有高要求)$",)),
    Test(("(前沿研究|一致性优化|全流程开发|进行调研|进行约束|仿真到实机|平台构建与验证|及规划领域|领域的前沿)",)), Test(("^包括",), (_LATIN,)),
    Test(("形成知识沉淀",)), Test(("技术创新", "并形成")), Test(("(算法开发|算法研发)$",), least=10), Test(("全身控制算法",), least=12), Test(("模块$",), least=12),
    Test(("(扎实|优秀|良好|深厚).{0,4}数学基础",)), Test((_LATIN, "(等机器人常用开发库|等平台搭建仿真环境)")), Test((r"[()（）]",)),
]


def holds(term: Column, tests: list[Test]) -> Column:
    out = F.lit(False)
    for t in tests:
        one = F.length(term) >= t.least
        for p in t.match:
            one = one & term.rlike(p)
        for p in t.miss:
            one = one & ~term.rlike(p)
        out = out | (one if t.most is None else one & (F.length(term) <= t.most))
    return out


@F.pandas_udf(StringType())
def nfkc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode's compatibility composition, which has no built-in function; texts that have it already pass as they are."""
    for s in texts:
        yield s.map(lambda x: x if x is None or unicodedata.is_normalized("NFKC", x) else unicodedata.normalize("NFKC", x))


def normalised(part: Column, compose: bool = True) -> Column:
    """STR-04; compose=False leaves out NFKC, for texts known to have it."""
    x = F.lower(F.trim(part))
    x = nfkc(x) if compose else x
    for p in (r"[\x{200b}\x{200c}\x{200d}]", HEADER, BULLET, PREFIX):
        x = F.regexp_replace(x, p, "")
    # One expression that names x once: trim takes blanks only.
    x = F.regexp_replace(x, r"(?s)\A熟练使用 *(.*?) *\z", "$1")
    x = F.regexp_replace(F.regexp_replace(x, SUFFIX, ""), r"[(（].*?[)）]", "")
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.regexp_replace(x, r"^[.,;；。:：]+|[.,;；。:：]+$", "")


def is_fragment(term: Column) -> Column:
    """STR-09."""
    return holds(F.trim(term), FRAGMENT)


def is_generic(term: Column) -> Column:
    """STR-07."""
    return holds(term, GENERIC)


def is_preserved(term: Column) -> Column:
    return holds(term, PRESERVED)


def shortened(term: Column) -> Column:
    """STR-08: of long narrative phrases the first word, if it has 20 characters at most."""
    words = F.split(term, " ")
    long = F.exists(words, lambda w: F.length(w) > 18)
    odd = F.exists(words, lambda w: ~w.rlike(f"^{_TOKEN}$"))
    narrative = (F.size(words) >= 6) | (F.length(term) > 60) | ((F.size(words) >= 4) & odd) | long
    drop = (F.length(term) > 15) & term.contains(" ") & ~is_preserved(term) & ~term.rlike(_CJK) & narrative
    return F.when(drop & (F.length(words[0]) <= 20), words[0]).otherwise(term)


def peeled(term: Column) -> Column:
    """STR-08: the tool in front of a listing ('x and other libraries'); null if the term is none."""
    tool = F.lower(F.regexp_extract(term, TOOL_LISTING, 1))
    return F.when(tool.rlike(f"^{_TOKEN}$"), tool)


def is_bad(term: Column) -> Column:
    """STR-06."""
    digits = term.rlike(r"\p{Nd}") & ~term.isin(DIGIT_SKILLS) & ~term.rlike(r"(?i)^[a-z+]+[\p{Nd}.+\-]+$")
    long = (F.length(term) > 25) & ~(is_preserved(term) & (F.length(term) <= 60))
    short = (F.length(term) <= 1) & ~term.isin(SHORT_SKILLS)
    return is_fragment(term) | term.isin(NO_SKILLS) | holds(term, BAD) | is_generic(term) | digits | long | short


def extracted(text: Column, compose: bool = True) -> Column:
    """STR-05: the distinct skills of a text, sorted; none for a null text. Parts are normalised one by one, after a split of the whole."""
    split = F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda p: F.trim(p) != "")
    # The normal form of parts is that of their text with marks between: NFKC never joins across a line break.
    whole = F.array_join(split, "\n")
    composed = F.split(nfkc(F.lower(whole)), "\n") if compose else F.split(F.lower(whole), "\n")
    raw = F.transform(split, lambda p: F.trim(p))

    # A step at a time, so that each has the last one's value and not its expression once more.
    terms = F.transform(F.transform(composed, lambda p: normalised(p, compose=False)), shortened)

    def kept(term: Column, said: Column) -> Column:
        none = (term == "") | is_fragment(term) | is_fragment(said)
        return F.when(none, F.lit(None)).otherwise(F.coalesce(peeled(term), term))

    return F.array_sort(F.array_distinct(F.filter(F.zip_with(terms, raw, kept), lambda x: ~is_bad(x))))
