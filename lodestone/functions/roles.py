"""What kind of phrase a job's term is, by its form and by the other phrases beside it (STR-26)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.cascade import Test, judged

CORE, OBJECT_TASK, TOOL, VENUE, GENERIC, NOISE = (
    "core_concept_candidate", "object_or_task_candidate", "tool_or_framework_candidate", "venue_or_preference_candidate", "generic_risky_candidate", "noise_fragment_candidate",
)


def _word(x: str) -> str:
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{x})(?![\p{{L}}\p{{N}}_])"


# Words and endings of the classes.
TASK_WORDS = ("运动学", "动力学", "trajectory", "轨迹", "planning", "规划", "仿真", "simulation", "识别", "estimation", "估计", "control", "控制", "优化", "optimization", "参数")
CARRIERS = rf"(?i)(机器人|机械臂|双臂|真机|robot|robotic|manipulator|{_word('arm')})"
CHAINS = rf"(?i)(运动控制|路径规划|轨迹规划|运动规划|全身控制|状态估计|动力学|运动学|运控|规控|仿真到实机|motion|planning|trajectory|kinematic|kinematics|dynamics|estimation|{_word('control')})"
MAINLINE = (
    rf"(?i)(robot|robotic|manipulator|{_word('arm')}|机械臂|机器人|双臂|真机|motion|trajectory|trajectories|planning|{_word('plan')}|{_word('control')}|controller|servo|"
    r"kinematic|kinematics|dynamics|estimation|轨迹|路径|规划|控制|运动|运控|规控|全身|状态估计|动力学|运动学|仿真到实机|sim-to-real|simulation-to-real|sim2real)"
)
PREFERENCES = r"(发表|优先|顶会|期刊|会议|ccf|分区|任职|资格|学历|薪资|福利|五险一金|质量要求|招聘要求|任职要求)"
HYPHENATED = r"(?i)-(based|centric|oriented|agnostic|driven|free)$"
HYPHENATED_RESEARCH = r"(?i)-(based|centric|oriented|agnostic|driven)$"
LEARNING = r"(?i)(学习|learning)$"
FLAVOUR = r"(智能|范式|理论)$"
PLATFORM = r"(?i)(平台|生态|基础设施|中间件|云原生|platform|stack|ecosystem|middleware)$"
TECHNICAL = r"(?i)^[a-z][a-z0-9+\-]{1,15}$"
_HAN = r"[\x{4e00}-\x{9fff}]"
SHELL = rf"^{_HAN}{{2}}算法$"


def han(t: Column) -> Column:
    """Number of Chinese characters."""
    return F.regexp_count(t, F.lit(_HAN))


def _tokens(t: Column) -> Column:
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def task_like(t: Column) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in TASK_WORDS]), lambda w: F.contains(F.lower(t), w))


def concrete(t: Column) -> Column:
    """A whole phrase of a skill: long, or with a chain of tasks, or of two words of the main line."""
    short = ((han(t) >= 4) & t.rlike(CHAINS)) | (F.regexp_count(t, F.lit(MAINLINE)) >= 2) | ((han(t) >= 5) & t.rlike(MAINLINE)) | ((F.size(_tokens(t)) >= 2) & (han(t) == 0) & task_like(t))
    return F.when(han(t) >= 6, ~t.rlike(LEARNING) | t.rlike(CARRIERS)).otherwise(short)


def side_branch(t: Column) -> Column:
    """A direction of research rather than a skill."""
    by_form = t.rlike(HYPHENATED_RESEARCH) | t.rlike(LEARNING) | ((han(t) <= 5) & t.rlike(FLAVOUR))
    return ~concrete(t) & ~t.rlike(MAINLINE) & by_form


def platform(t: Column) -> Column:
    return t.rlike(PLATFORM)


def carrier(t: Column) -> Column:
    """Names what acts, not what is done."""
    return (han(t) >= 4) & t.rlike(CARRIERS) & ~t.rlike(CHAINS)


def shell(t: Column) -> Column:
    return t.rlike(SHELL)


def richer_peer(t: Column, phrases: Column) -> Column:
    """Whether one of the phrases is concrete and longer, or as long and no shell where t is one. t and phrases in lower case."""
    return F.exists(phrases, lambda u: (u != t) & concrete(u) & ((F.length(u) > F.length(t)) | ((F.length(u) == F.length(t)) & shell(t) & ~shell(u))))


def subsumed(t: Column, phrases: Column) -> Column:
    """Whether a longer phrase contains t, which isn't concrete."""
    return ~concrete(t) & F.exists(phrases, lambda u: (F.length(u) > F.length(t)) & F.contains(u, t))


def compressed(t: Column, phrases: Column) -> Column:
    return shell(t) & richer_peer(t, phrases)


def coarse_role(term: Column, phrases: Column, abbreviations: Column) -> Column:
    """STR-26: struct of outcome (the class), reason and passed. phrases: the job's other phrases; abbreviations: in lower case."""
    t = F.lower(F.trim(F.coalesce(term, F.lit(""))))
    others = F.filter(F.transform(phrases, lambda p: F.lower(F.trim(p))), lambda p: p != "")
    words, latin, task = _tokens(t), han(t) == 0, task_like(t)
    several, one = latin & (F.size(words) >= 2), latin & (F.size(words) == 1)
    technical = F.forall(words, lambda w: w.rlike(TECHNICAL))
    return judged(
        [
            Test("too_short", F.length(t) < 2, NOISE),
            Test("preference", t.rlike(PREFERENCES), VENUE),
            Test("hyphenated", t.rlike(HYPHENATED), GENERIC),
            Test("carrier_without_task", carrier(t), GENERIC),
            Test("compressed", compressed(t, others), GENERIC),
            Test("concrete_task", concrete(t) & task, OBJECT_TASK),
            Test("concrete", concrete(t), CORE),
            Test("side_branch", side_branch(t), GENERIC),
            Test("platform", platform(t), TOOL),
            Test("short_chinese", ~latin & (F.length(t) <= 2), GENERIC),
            Test("subsumed", subsumed(t, others), GENERIC),
            Test("words_task", several & task, OBJECT_TASK),
            Test("words_technical", several & technical, TOOL),
            Test("words", several, CORE),
            Test("abbreviation", one & (F.length(t) <= 5) & F.array_contains(abbreviations, t), TOOL),
            Test("word_technical", one & technical & ~task, TOOL),
            Test("word_task", one & task, OBJECT_TASK),
            Test("word", one, CORE),
            Test("chinese_task", (han(t) >= 4) & task, OBJECT_TASK),
            Test("chinese_mainline", (han(t) >= 4) & t.rlike(MAINLINE), CORE),
        ],
        GENERIC, "chinese",
    )
