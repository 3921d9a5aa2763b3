"""Nested values: weighted maps, safe paths, evidence in either of two shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TERMS = "array<struct<term:string,bucket:string,score:double>>"


def accumulated(total: Column, more: Column, weight: Column) -> Column:
    """MAP-04: total and weight times more, key by key; a missing map is empty."""
    none = F.expr("cast(map() as map<string,double>)")
    return F.map_zip_with(F.coalesce(total, none), F.coalesce(more, none), lambda k, a, b: F.coalesce(a, F.lit(0.0)) + weight * F.coalesce(b, F.lit(0.0)))


def nested(text: Column, path: str, default: str | None = None) -> Column:
    """MAP-06: the value at a dotted path of a JSON text, or default where a step is missing or the text is none."""
    found = F.get_json_object(text, "$." + path)
    return found if default is None else F.coalesce(found, F.lit(default))


def evidence(text: Column) -> Column:
    """MAP-09: terms (term, bucket, score) out of JSON evidence that is a list of them or has one under terms or term_list; else none."""
    listed = F.when(F.trim(text).startswith("["), text).otherwise(F.coalesce(F.get_json_object(text, "$.terms"), F.get_json_object(text, "$.term_list")))
    rows = F.coalesce(F.from_json(listed, _TERMS), F.expr(f"cast(array() as {_TERMS})"))
    bucket = lambda x: F.when(F.coalesce(x["bucket"], F.lit("")) == "", "support").otherwise(x["bucket"])
    return F.transform(F.filter(rows, lambda x: x.isNotNull()), lambda x: F.struct(x["term"].alias("term"), bucket(x).alias("bucket"), F.coalesce(x["score"], F.lit(0.0)).alias("score")))
