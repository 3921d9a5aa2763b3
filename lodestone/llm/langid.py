"""Language ID by rank-order profiles.

A language's profile is its most frequent character n-grams (one to three letters of lower-cased words, each word
with a blank before and after) over all training texts, in order of frequency. A text is ranked likewise and gets the
language with the smallest out-of-place distance: the sum, over the text's n-grams, of how far apart the two ranks
are, and the profile's size where the language doesn't have the n-gram.

Counts cover all training texts. Profiles are the only thing sent to executors: PROFILE n-grams a language, whatever
the input. Score: 1 - distance / (profile size x n-grams of the text).

Defined cases: null texts, empty ones and those without a letter are `und` with score 0; so is everything if nothing
was learnt; rows without a language are not learnt from; equal counts rank by n-gram code, equal distances by
language name; repeated rows, and rows that share a doc_id or have none, are each decided by their own text; an empty
table gives no rows; further columns stay as they are, but ones of the names that are added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .words import slices

PROFILE = 300
#: A text's n-grams are sorted in runs of about this many characters, cut between words, so that very long texts need little memory.
CHUNK = 1 << 20
#: Of texts in none of the languages (random letters, languages that weren't learnt) most score 0.19 to 0.28; of texts in one of
#: them, junk lines and all, none of 4,000 scored less than 0.39.
LEAST = 0.3
BLANK = (1 << 21) - 1
#: Shares of a language's n-grams that are ranked apart before the driver merges them.
SHARES = 16

_letters: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Each code point's lower-case letter, 0 if it is none."""
    if not _letters:
        t = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                t[i] = ord(low[0]) if low[0].isalpha() else i
        _letters.append(t)
    return _letters[0]


def letters(text: str) -> np.ndarray:
    """Lower-cased letters with one 0 before, between and after words; empty if there is no letter."""
    x = _table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    x = np.concatenate([np.zeros(1, np.uint32), x, np.zeros(1, np.uint32)])
    x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
    return x if len(x) > 2 else x[:0]


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x.sort()
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(np.concatenate([first, [len(x)]]))


def _merged(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def _chunks(text: str) -> Iterator[str]:
    """text in pieces of CHUNK characters or more, cut where no word is parted."""
    at = 0
    while at < len(text):
        end = at + CHUNK
        while end < len(text) and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes (21 bits a character) of all n-grams but the blank alone, and their counts."""
    all_codes, all_counts = [], []
    for chunk in _chunks(text):
        x = letters(chunk).astype(np.int64)
        if not len(x):
            continue
        blank = x == 0
        x[blank] = BLANK  # no 0 in front, so n-grams of different lengths have different codes
        two = (x[:-1] << 21) | x[1:]
        three = (two[:-1] << 21) | x[2:]
        # None goes over a blank, so counts are the same wherever a text is cut between words.
        codes, counts = _counted(np.concatenate([x[~blank], two, three[~blank[1:-1]]]))
        all_codes.append(codes)
        all_counts.append(counts)
    if not all_codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return (all_codes[0], all_counts[0]) if len(all_codes) == 1 else _merged(np.concatenate(all_codes), np.concatenate(all_counts))


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The codes of the size most frequent n-grams, most frequent first; codes must come sorted."""
    if len(codes) > 4 * size:  # all that can be among the first
        keep = counts >= np.partition(counts, len(counts) - size)[len(counts) - size]
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")[:size]]


def learn(docs: DataFrame, size: int = PROFILE) -> dict[str, list[int]]:
    """Each language's ranked n-gram codes, from the text and lang of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                codes, counts = _merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])
            held.clear()

        waiting = 0
        for part in slices(batches):
            by: dict[str, list[str]] = {}
            for text, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                # A character that is no letter keeps the texts apart.
                got = ngrams("\n".join(texts))
                held.setdefault(lang, []).append(got)
                waiting += len(got[0])
                if len(held[lang]) > 8:
                    held[lang] = [_merged(np.concatenate([p[0] for p in held[lang]]), np.concatenate([p[1] for p in held[lang]]))]
            if waiting > 4_000_000:
                yield from out()
                waiting = 0
        yield from out()

    rows = docs.where("text is not null and lang is not null").select("text", "lang")
    sums = rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # Shares of a language are ranked in parallel; at most SHARES x size rows a language reach the driver.
    own = Window.partitionBy("lang", F.pmod(F.xxhash64("code"), F.lit(SHARES))).orderBy(F.desc("n"), "code")
    best: dict[str, list] = {}
    for r in sums.withColumn("r", F.row_number().over(own)).where(F.col("r") <= size).select("lang", "code", "n").collect():
        best.setdefault(r["lang"], []).append((-r["n"], r["code"]))
    return {k: [code for _, code in sorted(v)[:size]] for k, v in sorted(best.items())}


class Model:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(profiles), size
        self.codes = np.array(sorted({c for v in profiles.values() for c in v}), np.int64)
        self.ranks = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int64)
        for k, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.codes, np.array(profiles[lang], np.int64)), k] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs:
            return "und", 0.0
        mine = ranked(*ngrams(text), self.size)
        if not len(mine):
            return "und", 0.0
        at = np.searchsorted(self.codes, mine)
        at[at == len(self.codes)] = 0
        at[self.codes[at] != mine] = len(self.codes)
        there = self.ranks[at]
        out = np.where(there < 0, self.size, np.abs(there - np.arange(len(mine))[:, None])).sum(0)
        k = int(out.argmin())
        return self.langs[k], float(1 - out[k] / (self.size * len(mine)))


def predict(docs: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the language and the score added under two names; columns that already have these names are replaced."""
    model = Model(profiles, size)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in {x.lower() for x in names}])
    columns = [*docs.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            got = [model.predict(x) for x in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=columns)

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs, all columns, without those in no language: und, or a score below least. Learns from every row that has a language."""
    names = (fresh(docs, "_lang_pred"), fresh(docs, "_lang_score"))
    found = predict(docs, learn(docs), names=names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= least)).select(*docs.columns)


def of_training(docs: DataFrame) -> DataFrame:
    return docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 != 2")
