"""Ordered, named tests as data: the first that holds decides, and those before it are kept as the trace.

A table of tests is read from top to bottom. Conditions that are null don't hold. Where a table has several outcomes for
one state of affairs, the narrower test stands above the wider one, so that each line can be read without the others.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Test:
    """If `when` holds and no test above did: outcome `then`, for the reason `name` (a text, or a column of texts)."""

    name: str | Column
    when: Column
    then: str | Column

    __test__ = False  # not one of pytest's


def _column(x: str | Column) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _place(tests: list[Test]) -> Column:
    """The first test's number that holds, from 1; one more than there are if none does."""
    return reduce(lambda out, k: F.when(F.coalesce(tests[k].when, F.lit(False)), k + 1).otherwise(out), reversed(range(len(tests))), F.lit(len(tests) + 1))


def judged(tests: list[Test], then: str | Column, name: str | Column) -> Column:
    """struct of outcome, reason and passed (array of the names of the tests before the one that held); then and name stand for none."""
    place = _place(tests)
    pick = lambda values: F.element_at(F.array(*[_column(v) for v in values]), place)
    names = F.array(*[_column(t.name) for t in tests])
    return F.struct(pick([*[t.then for t in tests], then]).alias("outcome"), pick([*[t.name for t in tests], name]).alias("reason"), F.slice(names, F.lit(1), place - 1).alias("passed"))


def first_block(gates: list[tuple[str, Column]]) -> Column:
    """The name of the first gate that is shut (its condition doesn't hold, null counts as shut); null if all are open."""
    return reduce(lambda out, g: F.when(~F.coalesce(g[1], F.lit(False)), F.lit(g[0])).otherwise(out), reversed(gates), F.lit(None).cast("string"))
