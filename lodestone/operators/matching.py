"""Terms in titles by n-grams: a join on equal strings instead of one automaton."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grams(words: Column, most: int) -> Column:
    """All runs of one to most words, joined by a blank."""
    starts = F.sequence(F.lit(0), F.size(words) - 1)
    run = lambda n: F.transform(F.filter(starts, lambda i: i + n <= F.size(words)), lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), " "))
    return F.when(F.size(words) > 0, F.array_distinct(F.flatten(F.array(*[run(n) for n in range(1, most + 1)])))).otherwise(F.array().cast("array<string>"))


def title_terms(titles: DataFrame, vocabulary: DataFrame, most: int = 4) -> DataFrame:
    """JOIN-27: work_id, voc_id: terms of up to most words that stand in the title between other letters and digits."""
    words = F.filter(F.split(F.lower("title"), r"[^\p{L}\p{N}#+.]+"), lambda w: w != "")
    each = titles.select("work_id", F.explode(grams(words, most)).alias("term"))
    return each.join(vocabulary.select("term", "voc_id"), "term").select("work_id", "voc_id").distinct()
