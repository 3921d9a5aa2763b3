"""A training corpus from documents: language ID, exact and near duplicates, decontamination, packing.

Each stage works on all rows that its predecessor kept; all but the last return the columns of documents.

Defined cases: rows without a letter go in the first stage, null and empty texts with them; of copies and near copies the
row of the smallest doc_id stays, null ids last; repeated and null ids are told apart by content, and decontamination
decides on each row's own text; further columns, whatever their names, pass through unchanged until the last stage, which
ignores them; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, exact_dedup, langid, ngram_join, packing
from lodestone.llm.common import ensure_checkpoint_dir, table
from lodestone.llm.queries import tokenizer_path


#: Bytes of text that JVM and worker pass to each other at once; each holds several times as much.
ARROW_BATCH = "8m"
_ARROW_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.near_deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers serve all stages: what one of them remembers would stay beside what the others need.
    return packing.pack(docs, tokenizer_path(), remember=False)


def _bounded(stage):
    """stage in a session with small Arrow batches: workers live on from stage to stage, and so does what they once held.

    A stage's rows are computed when they are written, after the call, so the setting outlives the call; run() puts it back.
    """

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set(_ARROW_CONF, ARROW_BATCH)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [
    ("language_id", _bounded(language)),
    ("exact_dedup", _bounded(exact)),
    ("ngram_jaccard_join", _bounded(near)),
    ("decontamination", _bounded(decontaminate)),
    ("best_fit_packing", _bounded(pack)),
]

#: Profiles, n-gram links and alignments are beyond SQL.
ORACLE_SQL = None


def _gone(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each stage's rows are a table in the shared folder that spark.checkpoint.dir names, dropped when the next one is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    before = spark.conf.get(_ARROW_CONF)
    docs, last = table(spark, sf_dir, "documents"), None
    try:
        for k, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            if last is not None:
                _gone(spark, last)
            last = path
    finally:
        spark.conf.set(_ARROW_CONF, before)
    return docs
