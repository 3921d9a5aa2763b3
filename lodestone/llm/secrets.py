"""Secret scans over an incremental blob ledger.

Every version of every file is addressed by the SHA-256 of its content. The ledger remembers which (blob, rule,
rule version) triples were scanned and what they gave. A scan takes only unseen triples, and findings go back to
all paths by a join on the address. Copies are therefore scanned once, and a new rule version rescans old blobs
for that rule alone.

Spans come from one pass of the rule's pattern: the pieces between matches and the matches themselves alternate, so
running sums of their lengths are the code-point positions. Everything is DataFrame functions; nothing runs in Python.

Defined cases: a null text counts as empty, an empty text has no spans; repeated rows each get the findings of their
blob; an empty table gives an empty result; further columns (also ones called blob, rule or spans) are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has least code points or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    #: Texts that match this cannot be without a match of pattern, and the other way about; None: pattern itself.
    hint: str | None = None


_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Listed in the order in which spans that start together are reported.
BASE_RULES = (
    Rule("assign", 1, _ASSIGN, group=2, least=6),
    # A run that is too short holds no long enough match, so the least length can be part of these two patterns.
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
EXTRA_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"),
    Rule("ghtoken", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + EXTRA_RULES

#: Spans of a text that are gathered at a time.
RUN = 512

LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


def _spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    held = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.split(text, rule.pattern, -1)
    parts = F.zip_with(F.zip_with(between, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("hit"))), held, lambda x, y: F.struct(x["gap"].alias("gap"), x["hit"].alias("hit"), F.length(y).alias("held")))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    # Spans are gathered in runs, as adding to an array copies it.
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<struct<start:int,end:int>>>)").alias("runs"), empty.alias("run"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.coalesce(x["gap"], F.lit(0))
        end = begin + F.coalesce(x["hit"], F.lit(0))
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        good = x["hit"].isNotNull() & (F.coalesce(x["held"], F.lit(0)) >= max(rule.least, 1))
        full = F.size(acc["run"]) >= RUN
        runs = F.when(full, F.concat(acc["runs"], F.array(acc["run"]))).otherwise(acc["runs"])
        run = F.when(full, empty).otherwise(acc["run"])
        return F.struct(end.alias("at"), runs.alias("runs"), F.when(good, F.concat(run, span)).otherwise(run).alias("run"))

    whole = F.aggregate(parts, start, step, lambda acc: F.concat(F.flatten(acc["runs"]), acc["run"]))
    return F.when(text.rlike(rule.pattern), whole).otherwise(empty)


def versions(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, blob: the address of each version's content."""
    return files.select(F.col(path).alias("path"), F.sha2(whole_text(text), 256).alias("blob"))


def scan(files: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New ledger rows (LEDGER): the unseen (blob, rule, version) triples of files, one row each, spans empty if clean."""
    content = files.select(whole_text(text).alias("text")).select(F.sha2("text", 256).alias("blob"), "text")
    blobs = content.groupBy("blob", "text").agg(F.lit(1).alias("_once")).select("blob", "text")
    kinds = {r.kind: r for r in rules}
    if ledger is None:
        due = blobs.withColumn("known", F.expr("cast(array() as array<string>)"))
    else:
        key = F.concat_ws("@", "rule", F.col("version").cast("string"))
        seen = ledger.groupBy("blob").agg(F.collect_set(key).alias("known"))
        due = blobs.join(seen, "blob", "left").withColumn("known", F.coalesce("known", F.expr("cast(array() as array<string>)")))
        every = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
        due = due.where(F.size(F.array_except(every, "known")) > 0)
    results = F.array(
        *[
            F.when(
                ~F.array_contains("known", f"{r.kind}@{r.version}"),
                F.struct(F.lit(k).alias("rule"), F.lit(r.version).alias("version"), _spans(F.col("text"), r).alias("spans")),
            )
            for k, r in kinds.items()
        ]
    )
    # Blobs stay one row until the text is gone.
    rows = due.select("blob", F.filter(results, lambda x: x.isNotNull()).alias("r"))
    return rows.select("blob", F.explode("r").alias("r")).select("blob", "r.rule", "r.version", "r.spans")


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans array<struct<start, rank, kind, end>> ordered by start and rule, for blobs with findings under these rules."""
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("rule") == r.kind) & (F.col("version") == r.version))
    rank = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule"))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank.alias("rank"), F.col("rule").alias("kind"), s["end"].alias("end")))
    hits = ledger.where(now & (F.size("spans") > 0)).select("blob", spans.alias("s"))
    return hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans"))


def report(files: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text") -> DataFrame:
    """path, blob, spans for every version of files; spans is empty, never null."""
    found = findings(ledger, rules).withColumnRenamed("blob", "_blob")
    none = F.expr("cast(array() as array<struct<start:int,rank:bigint,kind:string,end:int>>)")
    at = versions(files, path, text)
    return at.join(found, F.col("blob") == F.col("_blob"), "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def scan_all(files: DataFrame, rules: tuple[Rule, ...] = RULES, path: str = "path", text: str = "text", increment: Column | None = None, increments: int = 1) -> DataFrame:
    """All of files through one ledger, an increment (0 to increments - 1, null: 0, any other number: the last) after the other: each scans what those before it left unseen.

    The ledger keeps clean triples, too, so a blob that came before is not scanned again, whatever it gave.
    """
    ledger = None
    own = F.lit(0) if increment is None else F.coalesce(increment, F.lit(0))
    last = increments - 1
    own = F.when(own.between(0, last), own).otherwise(last)
    for k in range(increments):
        part = files if increment is None or increments == 1 else files.where(own == k)
        new = cut(scan(part, ledger, rules, text))
        ledger = new if ledger is None else ledger.unionByName(new)
    return report(files, ledger, rules, path, text)
