"""The registered queries of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_dedup, filter_audit, html_extract, langid, licenses, lm, ngram_join, packing, quality, secrets, token_files, vector_codes
from .common import ensure_checkpoint_dir, table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 10"), F.lit(1))
    # Of the training texts, those of remainder 1 are the ones on which the weights are learned.
    fold = F.when(part == 0, 0).when(part == 1, 2).otherwise(1)
    return lm.score(table(spark, sf_dir, "documents"), fold)


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two increments of a ledger, by source: blobs of the second that the first has seen are not scanned again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    base = tuple(r.kind for r in secrets.BASE_RULES)
    every = tuple(r.kind for r in secrets.RULES)
    found = secrets.scan_all(docs, path="doc_id", increment=F.expr("crc32(cast(source as binary)) % 2"), increments=2)
    return found.select(
        F.col("path").alias("doc_id"),
        *[secrets.count(F.col("spans"), k).alias(f"n_{k}") for k in base],
        F.sha2(secrets.joined(F.col("spans"), base), 256).alias("base_sha256"),
        secrets.joined(F.col("spans"), every).alias("spans"),
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)"
    model = quality.learn(docs.where(f"not {held}"), labels.where(f"not {held}").select("doc_id", "quality"))
    found = quality.scored(docs, model)
    return found.select("doc_id", F.expr(held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = langid.learn(langid.of_training(docs))
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"), F.lit(False)).alias("held_out")
    return langid.predict(docs.select("doc_id", held, "text"), profiles).drop("text")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree of one to three levels, by source and remainders of doc_id."""
    docs = table(spark, sf_dir, "documents")
    below = F.expr("case doc_id % 3 when 0 then '' when 1 then concat('/', doc_id % 7) else concat('/', doc_id % 7, '/', doc_id % 11) end")
    path = F.concat(F.lit("/"), F.coalesce("source", F.lit("none")), below, F.lit("/"), F.col("doc_id"), F.lit(".txt"))
    found = licenses.scan(docs.select(path.alias("path"), "text"))
    return found.select(F.regexp_extract("path", r"(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), "path", "license", "origin", "score", "from_dir")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files stay in the shared folder: the rows are read from them whenever they are asked for."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4()}"
    token_files.write(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), folder, end_id=2)
    return token_files.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_secret_scan": op3_secret_scan,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_html_extraction": op5_html_extraction,
    "op6_quality": op6_quality,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_vector_codes": op11_vector_codes,
    "op12_token_files": op12_token_files,
    "op13_filter_audit": op13_filter_audit,
}

def _secret_sql() -> str:
    """The spans of every rule from the pieces between its matches and these, as in the operator."""
    kinds = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS ord, '{r.kind}' AS kind, {max(r.least, 1)} AS least, regexp_extract_all(x, p) AS hits, regexp_extract_all(x, p, {r.group}) AS held, string_split_regex(x, p) AS gaps"
        f" FROM (SELECT *, '{r.pattern.replace(chr(39), chr(39) * 2)}' AS p FROM t)"
        for k, r in enumerate(secrets.RULES)
    )
    base = ", ".join(f"'{r.kind}'" for r in secrets.BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in secrets.BASE_RULES)
    said = "string_agg(concat_ws(':', kind, start, start + n), ',' ORDER BY start, ord)"
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), k AS ({kinds}),
            s AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM k WHERE len(hits) > 0),
            p AS (SELECT doc_id, ord, kind, least, length(hits[i]) AS n, length(held[i]) AS m,
                CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS start FROM s),
            f AS (SELECT * FROM p WHERE m >= least)
        SELECT t.doc_id, {counts}, sha256(coalesce({said} FILTER (WHERE kind IN ({base})), '')) AS base_sha256, coalesce({said} FILTER (WHERE kind IS NOT NULL), '') AS spans
        FROM t LEFT JOIN f ON t.doc_id = f.doc_id GROUP BY t.doc_id"""


def _vector_sql() -> str:
    """Rounds of assignment and means one after the other, each over (vector, part, entry)."""
    p, n = vector_codes.PARTS, vector_codes.ENTRIES
    steps = [
        "v AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"i AS (SELECT vec_id, label, list_transform(e, lambda x: CAST(floor(CAST(x AS DOUBLE) * {vector_codes.SCALE}) AS BIGINT)) AS z, len(e) // {p} AS w FROM v)",
        f"x AS MATERIALIZED (SELECT vec_id, label, part, z[part * w + 1:part * w + w] AS a FROM i, (SELECT unnest(range({p})) AS part))",
        f"c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, a AS c FROM x QUALIFY entry < {n})",
    ]
    near = "SELECT vec_id, any_value(label) AS label, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(a) AS a FROM (SELECT x.vec_id, x.label, x.part, x.a, entry, CAST(coalesce(list_sum(list_transform(list_zip(a, c), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 0) AS BIGINT) AS d FROM x JOIN c{} c ON x.part = c.part) GROUP BY vec_id, part"
    for k in range(vector_codes.ROUNDS):
        steps += [
            f"a{k} AS MATERIALIZED ({near.format(k)})",
            f"s{k} AS (SELECT part, entry, pos, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT part, entry, unnest(a) AS v, unnest(range(1, len(a) + 1)) AS pos FROM a{k}) GROUP BY part, entry, pos)",
            f"m{k} AS (SELECT part, entry, list((s - ((s % n + n) % n)) // n ORDER BY pos) AS c FROM s{k} GROUP BY part, entry)",
            f"c{k + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(m.c, o.c) AS c FROM c{k} o LEFT JOIN m{k} m ON o.part = m.part AND o.entry = m.entry)",
        ]
    last = vector_codes.ROUNDS
    return f"""
        WITH {", ".join(steps)}, f AS MATERIALIZED ({near.format(last)}),
            h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{last}),
            r AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r, h"""


def _audit_sql() -> str:
    """Each step of each order counted by masks; shares summed over all orders."""
    orders = ", ".join(f"('{''.join(o)}')" for o in permutations(filter_audit.FILTERS))
    return rf"""
        WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
            w AS (SELECT *, regexp_extract_all(x, '[^ 	-]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
            l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
            d AS (SELECT part, CAST(len(words) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INT)
                + 4 * CAST(100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) AS INT) + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS INT)
                + 16 * CAST(coalesce(w.doc_id > first, false) AS INT) AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
            m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, mask),
            o AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
                coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS before
                FROM (VALUES {orders}) v(filter_order), (SELECT CAST(unnest(range(1, 6)) AS INT) AS step)),
            r AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE mask & (before | own) = 0) AS kept,
                sum(n) FILTER (WHERE mask & before = 0 AND mask & own > 0) AS removed, sum(n) FILTER (WHERE mask & before > 0 AND mask & own > 0) AS redundant,
                sum(n) FILTER (WHERE mask = own) AS unique_fails, sum(good) FILTER (WHERE mask & before = 0 AND mask & own > 0) AS good_lost,
                sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own > 0) AS toxic_lost FROM m, o GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
            CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley FROM r"""


SQL: dict[str, str] = {
    "op11_vector_codes": _vector_sql(),
    "op13_filter_audit": _audit_sql(),
    "op3_secret_scan": _secret_sql(),
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
            FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, text_sha256
        FROM t""",
}
