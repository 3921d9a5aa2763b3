"""Weights and scores as column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, HALF_LIFE, TITLE_FACTORS, Config


def contribution(pos_index: Column, is_alphabetical: Column, is_corresponding: Column) -> Column:
    """MTH-01: 1, and half more each for a first author by rank and for the corresponding one."""
    first = F.when((pos_index == 1) & (is_alphabetical == 0), 0.5).otherwise(0.0)
    return 1.0 + first + F.when(is_corresponding == 1, 0.5).otherwise(0.0)


def citation_factor(citations: Column) -> Column:
    """MTH-02."""
    return F.sqrt(F.log(citations + 2.71828))


def safe_year(year: Column, config: Config = DEFAULT) -> Column:
    """DT-01: the year, or 2000 if it is missing, before 1900 or to come."""
    return F.when(year.isNull() | (year < 1900) | (year > config.as_of_year), 2000).otherwise(year)


def recency(year: Column, config: Config = DEFAULT) -> Column:
    """DT-02: steps by age in years."""
    age = config.as_of_year - safe_year(year, config)
    return F.when(age <= 3, 1.0).when(age <= 6, 0.5).when(age <= 10, 0.2).otherwise(0.01)


def activity(recent5: Column) -> Column:
    return 1.0 + F.log1p(recent5)


def momentum(recent3: Column, before3: Column) -> Column:
    return F.least(F.lit(3.0), (recent3 + 1.0) / (before3 + 1.0))


def author_time_weight(recent5: Column, recent3: Column, before3: Column) -> Column:
    """DT-03: activity times the logarithm of momentum, from counts of works of the last five, the last three and the three years before these."""
    return activity(recent5) * F.log1p(momentum(recent3, before3))


def latest_recency(latest: Column, config: Config = DEFAULT) -> Column:
    """DT-04: by the age of the latest work; 1 without any."""
    age = F.greatest(config.as_of_year - latest, F.lit(0))
    return F.when(latest.isNull(), 1.0).otherwise(F.greatest(F.lit(0.01), F.pow(F.lit(10.0), -F.pow(age / 20.0, F.lit(2.0)))))


def half_life(domains: Column, config: Config = DEFAULT) -> Column:
    """The longest half-life of an array of domains."""
    table = F.create_map(*[F.lit(x) for pair in HALF_LIFE.items() for x in pair])
    lives = F.transform(domains, lambda d: F.coalesce(F.try_element_at(table, d), F.lit(config.default_half_life)))
    return F.when(F.size(domains) == 0, config.default_half_life).otherwise(F.array_max(lives))


def half_life_decay(year: Column, domains: Column, config: Config = DEFAULT) -> Column:
    """DT-05."""
    age = F.greatest(config.as_of_year - F.coalesce(year, F.lit(2000)), F.lit(0))
    return F.pow(F.lit(0.5), age / half_life(domains, config))


def exponential_decay(year: Column, base_year: int) -> Column:
    """DT-06: not rounded."""
    return F.exp(-0.1 * F.greatest(F.lit(base_year) - F.coalesce(year, F.lit(2000)), F.lit(0)))


def type_decay(title: Column) -> Column:
    """STR-10: the product of the factors of the patterns that the title matches."""
    out = F.lit(1.0)
    for pattern, factor in TITLE_FACTORS.items():
        out = out * F.when(title.rlike(f"(?i){pattern}"), factor).otherwise(1.0)
    return out


def rank_decay(rank: Column, config: Config = DEFAULT) -> Column:
    """What the rank-th best item counts (from 1)."""
    out = F.lit(config.decay_rest)
    for k in range(len(config.decay), 0, -1):
        out = F.when(rank == k, config.decay[k - 1]).otherwise(out)
    return out


def rrf(rank: Column, weight: float = 1.0, config: Config = DEFAULT) -> Column:
    """WIN-06: reciprocal rank; nothing for no rank."""
    return F.coalesce(F.lit(weight) / (config.rrf + rank), F.lit(0.0))


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def blend(*parts: tuple[float, Column]) -> Column:
    """A weighted sum; missing parts count 0."""
    return reduce(add, [F.lit(w) * F.coalesce(c, F.lit(0.0)) for w, c in parts])


def idf_log10(total: Column, degree: Column) -> Column:
    return F.log10(total / (degree + 1))


def idf_ln(total: Column, degree: Column) -> Column:
    return F.log(1 + total / (1 + degree))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def share_of(part: Column, whole: Column) -> Column:
    """PRJ-03: part / whole, 0 where whole isn't positive."""
    return F.when(whole > 0, part / whole).otherwise(0.0)
