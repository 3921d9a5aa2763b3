"""Queries on text, dates and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import text as T
from ..functions import weights as W
from .registry import query


def docs(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "documents")


@query("str01_parsed_terms", "SELECT doc_id, unnest(list_distinct(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), ';'), '[|;,]'), lambda p: lower(trim(p))), lambda p: p <> ''))) AS term FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.explode(T.parsed_terms(F.translate("text", "\n", ";"))).alias("term"))


@query("str02_domains", "SELECT o_orderkey, unnest(list_distinct(string_split(CAST(o_custkey % 17 + 1 AS VARCHAR) || '|' || CAST(o_orderkey % 3 + 1 AS VARCHAR), '|'))) AS domain FROM orders WHERE o_orderkey % 5 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 5 == 0, F.lit("0")).otherwise(F.concat_ws(" | ", (F.col("o_custkey") % 17 + 1).cast("string"), (F.col("o_orderkey") % 3 + 1).cast("string")))
    return X.raw(spark, d, "orders").select("o_orderkey", F.explode(T.domains(said)).alias("domain"))


@query("str03_skill_split", "SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[,.;:|!\\n]+'), lambda p: trim(p) <> '')) AS skills FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.size(F.filter(F.split("text", r"[,.;:|!\n]+"), lambda p: F.trim(p) != "")).alias("skills"))


@query("str10_type_decay", "SELECT p_partkey, CASE WHEN regexp_matches(t, '(?i)(survey|overview|review|handbook|textbook)') THEN 0.1 ELSE 1.0 END * CASE WHEN regexp_matches(t, '(?i)(data from:|dataset:|supplementary data)') THEN 0.05 ELSE 1.0 END AS decay FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' Survey' WHEN 1 THEN ' Dataset: x' ELSE '' END AS t FROM part)")
def _(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, " Survey").when(F.col("p_partkey") % 4 == 1, " Dataset: x").otherwise(""))
    return X.raw(spark, d, "part").select("p_partkey", W.type_decay(title).alias("decay"))


@query("str11_url_tail", "SELECT page_id, list_last(string_split(url, '/')) AS tail, regexp_extract(url, '//([^/]+)', 1) AS host FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "pages").select("page_id", T.url_tail(F.col("url")).alias("tail"), F.regexp_extract("url", "//([^/]+)", 1).alias("host"))


@query("str12_fallback_id", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN list_last(string_split(url, '/')) WHEN page_id % 3 = 1 THEN 'd' || page_id ELSE 'TMP_' || substr(md5(url), 1, 16) END AS id FROM pages")
def _(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("page_id") % 3 == 0, F.col("url"))
    doi = F.when(F.col("page_id") % 3 == 1, F.concat(F.lit("10.1/d"), "page_id"))
    return X.raw(spark, d, "pages").select("page_id", T.fallback_id(own, doi, F.col("url")).alias("id"))


_VARIANTS = r"""WITH t AS (SELECT p_partkey, lower(trim(p_name || CASE p_partkey % 5 WHEN 0 THEN ' (abc)' WHEN 1 THEN ' v2.0' WHEN 2 THEN '-based' WHEN 3 THEN 'ies' ELSE 's' END)) AS low FROM part),
    a AS (SELECT *, trim(regexp_replace(low, '\s*\([^)]*\)', '', 'g')) AS bare FROM t), b AS (SELECT *, trim(regexp_replace(bare, '\s*v?\d+(\.\d+)*$', '', 'g')) AS unv FROM a), c AS (SELECT *, regexp_replace(unv, '[- ](based|oriented)$', '', 'g') AS root FROM b)
    SELECT p_partkey, unnest(list_distinct([low, bare, unv, root, CASE WHEN root LIKE '%ies' AND length(root) > 4 THEN regexp_replace(root, 'ies$', 'y') WHEN regexp_matches(root, '(s|x|z|ch|sh)es$') THEN regexp_replace(root, 'es$', '')
        WHEN root LIKE '%s' AND root NOT LIKE '%ss' THEN regexp_replace(root, 's$', '') ELSE root END])) AS variant FROM c"""


@query("str13_term_variants", _VARIANTS)
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    name = F.concat("p_name", F.when(k == 0, " (abc)").when(k == 1, " v2.0").when(k == 2, "-based").when(k == 3, "ies").otherwise("s"))
    return X.raw(spark, d, "part").select("p_partkey", F.explode(T.variants(name)).alias("variant"))


@query("str14_head_and_tail", "SELECT doc_id, md5(CASE WHEN length(text) > 4000 THEN left(text, 2000) || ' ' || right(text, 2000) ELSE text END) AS digest, CASE WHEN length(text) > 50 THEN left(text, 50) || '...' ELSE text END AS short FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.md5(T.head_and_tail(F.col("text")).cast("binary")).alias("digest"), T.shortened(F.col("text"), 50).alias("short"))


@query("str16_abbreviations", " SELECT v.voc_id, v.term || coalesce(' | ' || string_agg(n_name, ' | ' ORDER BY n_name), '') AS expanded FROM vocabulary v LEFT JOIN nation ON n_nationkey % 47 + 1 = v.voc_id GROUP BY v.voc_id, v.term", "vocabulary")
def _(spark: SparkSession, d: str) -> DataFrame:
    short = X.raw(spark, d, "nation").groupBy((F.col("n_nationkey") % 47 + 1).alias("voc_id")).agg(F.array_join(F.array_sort(F.collect_list("n_name")), " | ").alias("s"))
    return X.vocabulary(spark, d).join(short, "voc_id", "left").select("voc_id", F.concat_ws(" | ", "term", "s").alias("expanded"))


@query("str17_restored_text", "SELECT p_partkey, p_name || ' ' || split_part(p_name, ' ', 1) AS text FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)")
def _(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    part = X.raw(spark, d, "part").where(words[0] != words[1])
    index = F.map_from_arrays(words, F.array(F.array(F.lit(0), F.lit(5)), F.array(F.lit(2))))
    return part.select("p_partkey", T.restored(index).alias("text"))


@query("str18_surface_terms")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Documents as raw queries."""
    none = F.lit(None).cast("string")
    found = docs(spark, d).select("doc_id", T.surface_terms(F.col("text"), none, none, none).alias("s"))
    return found.select("doc_id", *[F.array_join(f"s.{k}", "|").alias(k) for k in ("lexical", "acronym", "method")])


@query("str19_title_mentions", r"SELECT doc_id, n_name FROM documents, (SELECT lower(n_name) AS n_name FROM nation UNION ALL SELECT 'the' UNION ALL SELECT 'license') WHERE CASE WHEN regexp_matches(n_name, '^[a-z]{1,5}$') THEN regexp_matches(lower(text), '\b' || n_name || '\b') ELSE contains(lower(text), n_name) END")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = X.raw(spark, d, "nation").select(F.lower("n_name").alias("n_name")).unionByName(spark.sql("select 'the' as n_name union all select 'license'"))
    return docs(spark, d).crossJoin(F.broadcast(names)).where(T.mentions(F.col("text"), F.col("n_name"))).select("doc_id", "n_name")


@query("str20_coverage", "SELECT doc_id, (contains(lower(text), 'the')::INT + contains(lower(text), 'license')::INT + contains(lower(text), 'que')::INT + contains(lower(text), 'und')::INT) / 4.0 AS coverage FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.coverage(F.col("text"), ["the", "license", "que", "und"]).alias("coverage"))


@query("str22_character_classes", "SELECT doc_id, regexp_matches(text, '[\\x{4e00}-\\x{9fff}]') AS cjk, regexp_matches(text, '[A-Za-z]{12,}') AS long_latin, regexp_matches(text, '[0-9]') AS digits FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", T.has_cjk(F.col("text")).alias("cjk"), F.col("text").rlike("[A-Za-z]{12,}").alias("long_latin"), F.col("text").rlike("[0-9]").alias("digits"))


@query("str23_word_bounded", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '(^|[^\pL0-9])the([^\pL0-9]|$)')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).where(F.col("text").rlike(r"(^|[^\p{L}0-9])the([^\p{L}0-9]|$)")).select("doc_id")


@query("str29_keywords", "SELECT lang, word, n FROM (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS r FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents) GROUP BY 1, 2) WHERE r <= 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    words = docs(spark, d).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return words.withColumn("r", rank).where("r <= 10").drop("r")


@query("str30_explanations", "SELECT s_suppkey, format('{} from {} has {} lines', s_name, n_name, n) AS said FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = X.raw(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"))
    s = X.raw(spark, d, "supplier").join(F.broadcast(X.raw(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey")).join(n, "s_suppkey")
    return s.select("s_suppkey", F.format_string("%s from %s has %d lines", "s_name", "n_name", "n").alias("said"))


@query("str31_keyword_factors", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 0.5 ELSE 1.0 END * CASE WHEN contains(lower(text), 'password') THEN 0.2 ELSE 1.0 END AS factor FROM documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = F.lit(1.0)
    for word, factor in {"license": 0.5, "password": 0.2}.items():
        out = out * F.when(F.lower("text").contains(word), factor).otherwise(1.0)
    return docs(spark, d).select("doc_id", out.alias("factor"))


@query("agg32_token_jaccard", "SELECT conv_id, turn, len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) AS jaccard FROM (SELECT conv_id, turn, list_distinct(string_split(lower(text), ' ')) AS a, lag(list_distinct(string_split(lower(text), ' '))) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE b IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    rows = X.raw(spark, d, "conversations").withColumn("a", F.array_distinct(F.split(F.lower("text"), " ")))
    rows = rows.withColumn("b", F.lag("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")
    return rows.select("conv_id", "turn", T.jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query("dt01_safe_year", "SELECT o_orderkey, CASE WHEN y < 1900 OR y > 2001 THEN 2000 ELSE y END AS year FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 0 THEN 1 WHEN o_orderkey % 7 = 0 THEN 3000 ELSE year(o_orderdate) END AS y FROM orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    y = F.when(F.col("o_orderkey") % 6 == 0, F.lit("no year")).when(F.col("o_orderkey") % 7 == 0, F.lit("3000")).otherwise(F.year("o_orderdate").cast("string"))
    return X.raw(spark, d, "orders").select("o_orderkey", W.safe_year(y.try_cast("int")).alias("year"))


@query("dt07_formatted", "SELECT event_id, strftime(ts, '%Y-%m') AS month, CAST(strftime(ts, '%H') AS INTEGER) AS hour FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM").alias("month"), F.hour("ts").alias("hour"))


@query("dt08_days_between", "SELECT event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 86400000000.0 AS days FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "events").select("event_id", ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 86400000000.0).alias("days"))


@query("map01_json_maps", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_id % 3 <> 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 3 == 0, F.lit("{broken")).otherwise(F.col("props"))
    parsed = F.coalesce(F.from_json(text, "map<string,double>"), F.expr("cast(map() as map<string,double>)"))
    return X.raw(spark, d, "events").select("event_id", F.explode(parsed).alias("key", "k")).select("event_id", "k")


@query("map02_rekeyed", "SELECT event_type, k, sum(n) AS n FROM (SELECT event_type, unnest(['all', CAST(json_extract(props, '$.k') AS VARCHAR)]) AS k, 1 AS n FROM events) GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("|", F.lit("all"), F.get_json_object("props", "$.k"))
    return X.raw(spark, d, "events").select("event_type", F.explode(F.split(key, r"\|")).alias("k")).groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"))


@query("map05_argmax", "SELECT event_type, min(struct_pack(n := -n, k := k)).k AS k FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    counts = X.raw(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("event_type").agg(F.min(F.struct((-F.col("n")).alias("n"), "k"))["k"].alias("k"))


@query("map07_sorted_lists", "SELECT user_id, array_to_string(list_slice(list_sort(list(DISTINCT event_type)), 1, 3), ',') AS kinds FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "events").groupBy("user_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("event_type")), 1, 3), ",").alias("kinds"))


@query("stm01_marker_scan", "SELECT event_id, ts FROM events WHERE ts > (SELECT max(ts) FROM events WHERE event_id < 5000) ORDER BY ts, event_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.sync import after_marker

    e = X.raw(spark, d, "events")
    marker = e.where("event_id < 5000").agg(F.max("ts").alias("marker"))
    return after_marker(e.select("event_id", "ts"), marker, "ts", "event_id")


@query("stm04_accumulated", "SELECT event_type, sum(value) AS v, count(*) AS n FROM events GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.tables import added

    e = X.raw(spark, d, "events")
    chunks = [e.where(f"event_id % 4 = {k}").groupBy("event_type").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("n")) for k in range(4)]
    v, n = (chunks[0].select("event_type", c) for c in ("v", "n"))
    for c in chunks[1:]:
        v, n = added(v, c, ["event_type"], "v"), added(n, c, ["event_type"], "n")
    return v.join(n, "event_type")


@query("stm05_unseen_events", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id < 40)")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = X.raw(spark, d, "events")
    return e.join(e.where("event_id < 40").select("user_id"), "user_id", "left_anti").select("event_id")
