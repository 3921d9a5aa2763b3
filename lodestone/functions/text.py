"""Text and multi-value strings as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_EMPTY = "cast(array() as array<string>)"


def parsed_terms(x: Column) -> Column:
    """STR-01: parts between |, ; and commas, trimmed, lower-cased, distinct, none blank."""
    parts = F.transform(F.split(x, "[|;,]"), lambda p: F.lower(F.trim(p)))
    return F.coalesce(F.array_distinct(F.filter(parts, lambda p: p != "")), F.expr(_EMPTY))


def domains(x: Column) -> Column:
    """STR-02: domain ids between bars, commas and blanks; none for null, empty and "0"."""
    parts = F.filter(F.split(x, r"[|,\s]+"), lambda p: F.trim(p) != "")
    return F.when(x.isNull() | (F.trim(x) == "0") | (F.trim(x) == ""), F.expr(_EMPTY)).otherwise(F.array_distinct(parts))


def url_tail(x: Column) -> Column:
    """STR-11."""
    return F.element_at(F.split(x, "/"), -1)


def fallback_id(id_: Column, doi: Column, content: Column) -> Column:
    """STR-12: the id's tail, else the doi's, else one made from the content."""
    tail = lambda c: F.when(F.coalesce(c, F.lit("")) != "", url_tail(c))
    return F.coalesce(tail(id_), tail(doi), F.concat(F.lit("TMP_"), F.substring(F.md5(content.cast("binary")), 1, 16)))


def variants(term: Column) -> Column:
    """STR-13: the term and its forms without brackets, version, -based or -oriented, and plural ending."""
    low = F.lower(F.trim(term))
    bare = F.trim(F.regexp_replace(low, r"\s*\([^)]*\)", ""))
    unversioned = F.trim(F.regexp_replace(bare, r"\s*v?\d+(\.\d+)*$", ""))
    rooted = F.regexp_replace(unversioned, r"[- ](based|oriented)$", "")
    singular = (
        F.when(rooted.endswith("ies") & (F.length(rooted) > 4), F.regexp_replace(rooted, "ies$", "y"))
        .when(rooted.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(rooted, "es$", ""))
        .when(rooted.endswith("s") & ~rooted.endswith("ss"), F.regexp_replace(rooted, "s$", ""))
        .otherwise(rooted)
    )
    return F.array_distinct(F.filter(F.array(low, bare, unversioned, rooted, singular), lambda t: t != ""))


def head_and_tail(x: Column, most: int = 4000, part: int = 2000) -> Column:
    """STR-14."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, part), F.lit(" "), F.right(x, F.lit(part)))).otherwise(x)


def shortened(x: Column, most: int) -> Column:
    """STR-15."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def restored(index: Column) -> Column:
    """STR-17: the text of a map from word to positions; words stand in order of position, gaps are passed over."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(at), lambda e: e["w"]), " ")


def mentions(title: Column, term: Column) -> Column:
    """STR-19: a short alphabetic term as a whole word, others anywhere."""
    short = term.rlike("^[a-z]{1,5}$")
    return F.when(short, F.rlike(F.lower(title), F.concat(F.lit(r"\b"), term, F.lit(r"\b")))).otherwise(F.contains(F.lower(title), term))


def bound(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x with x evaluated once, however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def has_cjk(x: Column) -> Column:
    return x.rlike("[一-鿿]")


def word_bounded(x: Column, term: str) -> Column:
    """STR-23: term in x with no letter or digit on either side."""
    import re

    return x.rlike(r"(?<![\p{Alnum}])" + re.escape(term) + r"(?![\p{Alnum}])")


def jaccard(a: Column, b: Column) -> Column:
    """AGG-32: of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def coverage(text: Column, terms: list[str]) -> Column:
    """STR-20: the share of terms that text contains."""
    return sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms), F.lit(0)) / float(max(1, len(terms)))


def strip_prefix(x: Column, prefix: str) -> Column:
    """SNK-07."""
    return F.when(F.startswith(x, F.lit(prefix)), F.substring(x, len(prefix) + 1, 1 << 20)).otherwise(x)


def lexical_faults(term: Column) -> dict[str, Column]:
    """STR-28: what is wrong with a vocabulary term."""
    return {
        "multi_space": term.rlike(r"\s{2,}"),
        "punctuated": term.rlike(r"[,;:!?]"),
        "has_digit": term.rlike(r"\d"),
        "too_long": F.length(term) > 30,
        "one_letter": F.length(F.trim(term)) <= 1,
        "stop_word": F.lower(F.trim(term)).isin("the", "of", "and", "or", "in", "for", "to", "with"),
    }


# Words that are no surface terms, generic and applied words of anchors.
SURFACE_STOP = "the and for with this that from have has are was were been being not but you all can her she may use any our out".split()
GENERIC_WORDS = "算法 模型 方法 系统 开发 技术 学习 研究 research algorithm model method system framework learning optimization".split()
APPLIED_WORDS = "应用 开发 工程 implementation application engineering".split()
#: Characters on either side of a phrase in which other phrases count.
CONTEXT = 120


def surface_terms(raw: Column, compressed: Column, task: Column, method: Column) -> Column:
    """STR-18: struct of lexical (96 at most), acronym (64) and method (64) terms of a query's texts, distinct, in order of pattern, then of place.

    Lexical: Latin words of three characters or more but stop words, then runs of 2 to 8 CJK characters; without short ones that are acronyms.
    Acronyms: capitals, letters with digits or capitals inside, and parts between slashes and commas with a capital. Each list takes the first 96 first.
    """
    text = lambda *xs: F.concat_ws(" ", *[F.when(F.trim(F.coalesce(x, F.lit(""))) != "", F.trim(x)) for x in xs])
    every = lambda t, p: F.regexp_extract_all(t, F.lit(p), F.lit(0))
    latin, cjk = r"[A-Za-z][A-Za-z0-9/+.\-]{2,}", r"[\x{4e00}-\x{9fff}]{2,8}"
    word = lambda p: rf"(?<![\p{{L}}\p{{N}}_])(?:{p})(?![\p{{L}}\p{{N}}_])"
    first = lambda *xs: F.slice(F.array_distinct(F.filter(F.concat(*xs), lambda x: F.length(x) >= 2)), 1, 96)
    blob, methods = text(raw, compressed, task, method), text(method, compressed)
    parts = F.filter(F.split(blob, r"[/，,;\s]+"), lambda p: p.rlike(r"^[A-Za-z0-9+\-]{2,16}$") & p.rlike("[A-Z]"))
    lexical = first(F.filter(every(blob, latin), lambda w: ~F.lower(w).isin(SURFACE_STOP)), every(blob, cjk))
    mixed = every(blob, word(r"[A-Za-z]{1,3}\d+[A-Za-z0-9]*") + "|" + word(r"[A-Za-z]*[A-Z][a-z0-9]+[A-Za-z0-9]*"))
    acronym = first(every(blob, word("[A-Z]{2,}")), mixed, parts)
    # Bound, or the acronyms would be found anew for each lexical term, and all three lists for each field that is read.
    both = F.struct(lexical.alias("lexical"), acronym.alias("acronym"), F.slice(first(every(methods, latin), every(methods, cjk)), 1, 64).alias("method"))

    def told(s: Column) -> Column:
        kept = bound(F.transform(s["acronym"], lambda a: F.lower(a)), lambda low: F.filter(s["lexical"], lambda x: (F.length(x) > 4) | ~F.array_contains(low, F.lower(x))))
        return F.struct(kept.alias("lexical"), F.slice(s["acronym"], 1, 64).alias("acronym"), s["method"].alias("method"))

    return bound(both, told)


def phrase_specificity(phrase: Column, phrases: Column) -> Column:
    """STR-24: more for phrases of many words that few others, as long or longer, contain; 0.5 for none."""
    low = F.lower(F.trim(phrase))
    all_ = F.transform(phrases, lambda p: F.lower(F.trim(p)))
    inside = F.size(F.filter(all_, lambda p: (p != low) & (F.length(p) >= F.length(low)) & F.contains(p, low)))
    words = F.size(F.filter(F.split(low, r"\s+"), lambda w: w != ""))
    spec = 0.3 + 0.15 * F.least(words, F.lit(6)) + 0.55 * (1.0 - inside / F.greatest(F.size(phrases), F.lit(1)))
    return F.when((F.coalesce(low, F.lit("")) == "") | (F.coalesce(F.size(phrases), F.lit(0)) <= 0), 0.5).otherwise(F.least(F.lit(1.0), spec))


def phrase_richness(phrase: Column, text: Column, phrases: Column) -> Column:
    """STR-24: how many other phrases stand within CONTEXT characters of the phrase's first place; 0.3 where it isn't there, 0.5 for no phrase or text."""
    low, body = F.lower(F.trim(phrase)), F.lower(text)
    at = F.instr(body, low)
    begin = F.greatest(F.lit(0), at - 1 - CONTEXT)
    window = F.substring(body, begin + 1, at - 1 + F.length(phrase) + CONTEXT - begin)
    near = F.size(F.filter(phrases, lambda p: (F.trim(p) != "") & (F.lower(F.trim(p)) != low) & F.contains(window, F.lower(F.trim(p)))))
    none = (F.coalesce(low, F.lit("")) == "") | (F.coalesce(text, F.lit("")) == "") | (F.coalesce(F.size(phrases), F.lit(0)) <= 0)
    return F.when(none, 0.5).when(at == 0, 0.3).otherwise(0.2 + 0.8 * F.least(near / 5.0, F.lit(1.0)))


def anchor_type(term: Column, abbreviations: Column) -> Column:
    """STR-25: acronym, generic_task_term, application_term, canonical_academic_like; unknown below two characters. abbreviations: lower-case array."""
    low = F.lower(F.trim(term))
    applied = F.exists(F.array(*[F.lit(w) for w in APPLIED_WORDS]), lambda w: F.contains(low, w))
    return F.when(F.length(F.coalesce(low, F.lit(""))) < 2, "unknown").when(F.array_contains(abbreviations, low), "acronym").when(low.isin(GENERIC_WORDS), "generic_task_term").when(applied, "application_term").otherwise("canonical_academic_like")


def identity_surface(term: Column) -> Column:
    """STR-27: struct of raw, norm (lower case, without parentheses and hyphens), tokens and head, the first token."""
    raw = F.trim(F.coalesce(term, F.lit("")))
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(raw), r"\s*\([^)]*\)\s*", " "), "-", " "), r"\s+", " "))
    tokens = F.filter(F.split(norm, " "), lambda t: t != "")
    return F.struct(raw.alias("raw"), norm.alias("norm"), tokens.alias("tokens"), F.coalesce(F.get(tokens, 0), F.lit("")).alias("head"))
