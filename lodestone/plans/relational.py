"""Queries on table scans, filters, joins, table changes and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import text as T
from ..functions import weights as W
from ..operators import tables as B
from .registry import query

_T = ("works", "authorships", "authors")


@query("src01_filtered_scan", " SELECT work_id, year, citation_count FROM works WHERE year >= 1999 AND citation_count > 100", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.works(spark, d).where("year >= 1999 and citation_count > 100").select("work_id", "year", "citation_count")


@query("src03_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "orders").where("o_orderkey > 1000").select("o_orderkey", "o_custkey").orderBy("o_orderkey").limit(500)


@query("src19_two_databases", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    nation, region = X.raw(spark, d, "nation"), X.raw(spark, d, "region")
    return nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select("n_name", "r_name")


@query("flt01_in_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark: SparkSession, d: str) -> DataFrame:
    ids = X.raw(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return X.raw(spark, d, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey")


_NULLS = "CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 11 = 0 THEN 'N/A' ELSE o_orderstatus END"


@query("flt02_null_or_empty", f"SELECT o_orderkey, (s IS NULL OR s = '') AS missing, s NOT IN ('N/A', 'NOT_FOUND') AS usable FROM (SELECT o_orderkey, {_NULLS} AS s FROM orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.raw(spark, d, "orders").select("o_orderkey", F.expr(_NULLS).alias("s"))
    return rows.select("o_orderkey", (F.col("s").isNull() | (F.col("s") == "")).alias("missing"), (~F.col("s").isin("N/A", "NOT_FOUND")).alias("usable"))


@query("flt03_prefixes", "SELECT p_partkey FROM part WHERE p_type ILIKE 'sm%' OR p_brand NOT LIKE 'Brand#1%'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "part").where(F.col("p_type").ilike("sm%") | ~F.col("p_brand").like("Brand#1%")).select("p_partkey")


@query("flt04_three_valued_exclusion", f"SELECT o_orderkey, lower(coalesce(s, '')) <> 'f' AS kept_if_null, s FROM (SELECT o_orderkey, {_NULLS} AS s FROM orders) WHERE s <> 'O'")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.raw(spark, d, "orders").select("o_orderkey", F.expr(_NULLS).alias("s"))
    return rows.where("s <> 'O'").select("o_orderkey", (F.lower(F.coalesce("s", F.lit(""))) != "f").alias("kept_if_null"), "s")


@query("flt05_recent", " SELECT work_id FROM works WHERE year >= 2001 - 5", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.works(spark, d).where("year >= 2001 - 5").select("work_id")


@query("flt06_stale", " SELECT work_id, date_diff('day', publication_date, DATE '2001-08-01') AS days FROM works WHERE date_diff('day', publication_date, DATE '2001-08-01') > 2000 OR publication_date IS NULL", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    days = F.datediff(F.lit("2001-08-01").cast("date"), "publication_date")
    return X.works(spark, d).where((days > 2000) | F.col("publication_date").isNull()).select("work_id", days.cast("long").alias("days"))


@query("flt20_title_words", "SELECT doc_id FROM documents WHERE contains(lower(text), 'retraction') OR contains(lower(text), 'license')")
def _(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower("text")
    return X.raw(spark, d, "documents").where(low.contains("retraction") | low.contains("license")).select("doc_id")


@query("flt21_date_guard", "SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS x FROM orders) WHERE x <= DATE '1999-12-31'")
def _(spark: SparkSession, d: str) -> DataFrame:
    said = F.when(F.col("o_orderkey") % 9 == 0, F.lit("not a date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return X.raw(spark, d, "orders").where(F.try_to_timestamp(said, F.lit("yyyy-MM-dd")) < F.lit("2000-01-01").cast("timestamp")).select("o_orderkey")


@query("prj02_computed", " SELECT work_id, author_id, 1.0 + CASE WHEN pos_index = 1 AND is_alphabetical = 0 THEN 0.5 ELSE 0.0 END + CASE WHEN is_corresponding = 1 THEN 0.5 ELSE 0.0 END AS w, pos_index FROM authorships", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.authorships(spark, d).select("work_id", "author_id", W.contribution(F.col("pos_index"), F.col("is_alphabetical"), F.col("is_corresponding")).alias("w"), "pos_index")


@query("prj03_guarded_ratio", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey / c_acctbal ELSE 0 END AS r FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "customer").select("c_custkey", W.share_of(F.col("c_nationkey"), F.col("c_acctbal")).alias("r"))


@query("prj04_defaults", "SELECT c_custkey, CASE WHEN c_nationkey IS NULL OR c_nationkey = 0 THEN 99 ELSE c_nationkey END AS nation FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("c_nationkey")
    return X.raw(spark, d, "customer").select("c_custkey", F.when(n.isNull() | (n == 0), 99).otherwise(n).alias("nation"))


@query("join01_inner", " SELECT a.work_id, a.author_id, w.year FROM authorships a JOIN works w USING (work_id)", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.authorships(spark, d).join(X.works(spark, d), "work_id").select("work_id", "author_id", "year")


@query("join07_anti", " SELECT author_id FROM authors WHERE author_id NOT IN (SELECT author_id FROM authorships JOIN works USING (work_id) WHERE citation_count > 498)", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    great = X.authorships(spark, d).join(X.works(spark, d).where("citation_count > 498"), "work_id")
    return X.authors(spark, d).join(great, "author_id", "left_anti").select("author_id")


@query("join08_unseen_ids", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def _(spark: SparkSession, d: str) -> DataFrame:
    seen = X.raw(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return X.raw(spark, d, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey")


@query("join09_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = X.raw(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return X.raw(spark, d, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


@query("join10_exists", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = X.raw(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return X.raw(spark, d, "customer").join(orders, "c_custkey", "left_semi").select("c_custkey")


@query("join16_left_enrichment", """SELECT s_suppkey, n_name, coalesce(k, 0) AS lines, p FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
    LEFT JOIN (SELECT l_suppkey, count(*) AS k FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey LEFT JOIN (SELECT l_suppkey AS x, max(l_extendedprice) AS p FROM lineitem WHERE l_quantity > 49 GROUP BY 1) ON x = s_suppkey""")
def _(spark: SparkSession, d: str) -> DataFrame:
    s, n, l = X.raw(spark, d, "supplier"), X.raw(spark, d, "nation"), X.raw(spark, d, "lineitem")  # noqa: E741
    counts = l.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("k"))
    best = l.where("l_quantity > 49").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.max("l_extendedprice").alias("p"))
    out = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").join(counts, "s_suppkey", "left").join(best, "s_suppkey", "left")
    return out.select("s_suppkey", "n_name", F.coalesce("k", F.lit(0).cast("long")).alias("lines"), "p")


@query("join17_full_outer_flags", """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.doc_id IS NOT NULL AS recalled, l.quality AS gold FROM (SELECT doc_id FROM documents WHERE n_chars > 2000) d
    FULL JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    docs = X.raw(spark, d, "documents").where("n_chars > 2000").select("doc_id", F.lit(True).alias("there"))
    return docs.join(X.raw(spark, d, "labels"), "doc_id", "full_outer").select("doc_id", F.coalesce("there", F.lit(False)).alias("recalled"), F.col("quality").alias("gold"))


@query("join18_gold_over_weak", "SELECT d.doc_id, coalesce(quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) AS grade, CASE WHEN quality IS NULL THEN 'weak' ELSE 'gold' END AS source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.raw(spark, d, "documents").join(X.raw(spark, d, "labels"), "doc_id", "left")
    weak = F.when(F.col("n_chars") > 1000, 1).otherwise(0)
    return rows.select("doc_id", F.coalesce("quality", weak).cast("long").alias("grade"), F.when(F.col("quality").isNull(), "weak").otherwise("gold").alias("source"))


@query("join24_contains_any", "SELECT p_partkey, n_name FROM part, nation WHERE contains(lower(p_name), lower(n_name[-2:]))")
def _(spark: SparkSession, d: str) -> DataFrame:
    # The names are a table of fixed size; it goes to every task.
    short = F.broadcast(X.raw(spark, d, "nation").select("n_name", F.lower(F.substring("n_name", -2, 2)).alias("s")))
    return X.raw(spark, d, "part").join(short, F.contains(F.lower("p_name"), F.col("s"))).select("p_partkey", "n_name")


_WORDS = "[('and', '1'), ('der', '2'), ('les', '3'), ('que', '4'), ('license', '5')]"


@query("join25_keyword_domains", "SELECT doc_id, string_agg(DISTINCT d, '|' ORDER BY d) AS domains FROM documents, (VALUES ('and', '1'), ('der', '2'), ('les', '3'), ('que', '4'), ('license', '5')) t(w, d) WHERE contains(lower(text), w) GROUP BY doc_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    known = [("and", "1"), ("der", "2"), ("les", "3"), ("que", "4"), ("license", "5")]
    low = F.lower("text")
    found = F.array_sort(F.array_compact(F.array(*[F.when(low.contains(w), k) for w, k in known])))
    rows = X.raw(spark, d, "documents").select("doc_id", found.alias("f"))
    return rows.where(F.size("f") > 0).select("doc_id", F.array_join("f", "|").alias("domains"))


@query("join27_title_terms", """, w AS (SELECT o_orderkey AS work_id, lower(unnest(string_split(p_name, ' '))) AS gram FROM (SELECT DISTINCT l_orderkey AS o_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey))
    SELECT DISTINCT work_id, voc_id FROM w JOIN vocabulary ON gram = term""", "vocabulary")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.matching import title_terms

    titles = X.raw(spark, d, "lineitem").join(X.raw(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("work_id"), F.col("p_name").alias("title")).distinct()
    return title_terms(titles, X.vocabulary(spark, d))


@query("join28_first_variant", """SELECT p_partkey, CASE WHEN EXISTS (SELECT 1 FROM nation WHERE n_nationkey = p_partkey % 40) THEN 1 ELSE 2 END AS choice, coalesce(a.n_name, b.r_name) AS name
    FROM part LEFT JOIN nation a ON a.n_nationkey = p_partkey % 40 LEFT JOIN region b ON b.r_regionkey = p_partkey % 5""")
def _(spark: SparkSession, d: str) -> DataFrame:
    part = X.raw(spark, d, "part").select("p_partkey", F.posexplode(F.array((F.col("p_partkey") % 40).cast("string"), F.concat(F.lit("r"), F.col("p_partkey") % 5))).alias("pos", "key"))
    known = X.raw(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.col("n_name").alias("name"))
    known = known.unionByName(X.raw(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("key"), F.col("r_name").alias("name")))
    first = part.join(F.broadcast(known), "key").groupBy("p_partkey").agg(F.min(F.struct("pos", "name")).alias("m"))
    return first.select("p_partkey", (F.col("m.pos") + 1).alias("choice"), F.col("m.name").alias("name"))


@query("snk01_upsert", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT c_custkey + 10000000, c_acctbal FROM customer WHERE c_custkey % 100 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    base = X.raw(spark, d, "customer").select("c_custkey", "c_acctbal")
    changes = base.where("c_custkey % 10 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal")).unionByName(base.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), "c_acctbal"))
    return B.upserted(base, changes, ["c_custkey"])


@query("snk02_insert_or_ignore", "SELECT c_custkey, c_acctbal FROM customer UNION ALL SELECT c_custkey + 10000000, c_acctbal FROM customer WHERE c_custkey % 100 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    base = X.raw(spark, d, "customer").select("c_custkey", "c_acctbal")
    rows = base.where("c_custkey % 10 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")).unionByName(base.where("c_custkey % 100 = 0").select((F.col("c_custkey") + 10000000).alias("c_custkey"), "c_acctbal"))
    return B.inserted(base, rows, ["c_custkey"])


@query("snk03_additive_upsert", "SELECT o_custkey, sum(v) AS v FROM (SELECT o_custkey, o_totalprice AS v FROM orders UNION ALL SELECT o_custkey, 1.0 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = X.raw(spark, d, "orders")
    return B.added(orders.select("o_custkey", F.col("o_totalprice").alias("v")), orders.where("o_orderstatus = 'F'").select("o_custkey", F.lit(1.0).alias("v")), ["o_custkey"], "v")


@query("snk05_update_join", "SELECT s_suppkey, s_name, coalesce(n, -1) AS s_nationkey FROM (SELECT s_suppkey, s_name, CASE WHEN c IS NULL THEN s_nationkey ELSE c END AS n FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS c FROM lineitem WHERE l_quantity > 45 AND l_suppkey % 2 = 0 GROUP BY 1) ON l_suppkey = s_suppkey)")
def _(spark: SparkSession, d: str) -> DataFrame:
    base = X.raw(spark, d, "supplier").select("s_suppkey", "s_name", F.col("s_nationkey").cast("long").alias("s_nationkey"))
    stats = X.raw(spark, d, "lineitem").where("l_quantity > 45 and l_suppkey % 2 = 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("s_nationkey"))
    return B.updated(base, stats, ["s_suppkey"], ["s_nationkey"])


@query("snk07_strip_prefix", "SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#') THEN p_brand[7:] ELSE p_brand END AS brand FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "part").select("p_partkey", T.strip_prefix(F.col("p_brand"), "Brand#").alias("brand"))


@query("snk08_key_migration", " SELECT DISTINCT CASE WHEN work_id % 4 = 0 THEN work_id + 1 ELSE work_id END AS work_id, author_id FROM authorships", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    mapping = X.works(spark, d).where("work_id % 4 = 0").select(F.col("work_id").alias("old"), (F.col("work_id") + 1).alias("new"))
    return B.migrated(X.authorships(spark, d).select("work_id", "author_id"), mapping, "work_id", ["work_id", "author_id"])


@query("snk09_cascaded_delete", " SELECT a.work_id, a.author_id FROM authorships a WHERE work_id NOT IN (SELECT work_id FROM works WHERE type = '5-LOW')", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    gone = X.works(spark, d).where("type = '5-LOW'").select("work_id")
    return X.authorships(spark, d).join(gone, "work_id", "left_anti").select("work_id", "author_id")


@query("snk10_rebuild_part", "SELECT term, entity_type FROM (SELECT DISTINCT term, entity_type FROM (SELECT lower(p_brand) AS term, 'keyword' AS entity_type FROM part)) UNION ALL SELECT DISTINCT 'x ' || lower(p_type), 'industry' FROM part")
def _(spark: SparkSession, d: str) -> DataFrame:
    part = X.raw(spark, d, "part")
    kept = X.vocabulary(spark, d).where("entity_type = 'keyword'").select("term", "entity_type")
    return kept.unionByName(part.select(F.concat(F.lit("x "), F.lower("p_type")).alias("term"), F.lit("industry").alias("entity_type")).distinct())


@query("snk12_linked_edges", " SELECT DISTINCT work_id AS src, author_id AS dst FROM authorships WHERE work_id IN (SELECT work_id FROM works WHERE year > 1998) AND author_id IN (SELECT author_id FROM authors WHERE h_index > 3)", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    edges = X.authorships(spark, d).select(F.col("work_id").alias("src"), F.col("author_id").alias("dst"))
    return B.linked(edges, X.works(spark, d).where("year > 1998").select(F.col("work_id").alias("id")), X.authors(spark, d).where("h_index > 3").select(F.col("author_id").alias("id")))


@query("snk13_undirected_edges", "SELECT least(l_partkey, l_suppkey) AS src, greatest(l_partkey, l_suppkey) AS dst, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.undirected(X.raw(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("weight")))


@query("snk19_quality_buckets", " SELECT term, regexp_matches(term, '\\s{2,}') AS multi_space, regexp_matches(term, '[,;:!?]') AS punctuated, regexp_matches(term, '\\d') AS has_digit, length(term) > 30 AS too_long, length(trim(term)) <= 1 AS one_letter, lower(trim(term)) IN ('the', 'of', 'and', 'or', 'in', 'for', 'to', 'with') AS stop_word FROM vocabulary", "vocabulary")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.vocabulary(spark, d).select("term", *[c.alias(k) for k, c in T.lexical_faults(F.col("term")).items()])


@query("snk18_top_lists", " SELECT * FROM (SELECT 'length' AS list, term, length(term) AS n FROM vocabulary ORDER BY n DESC, term LIMIT 10) UNION ALL SELECT * FROM (SELECT 'kind', entity_type, count(*) FROM vocabulary GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)", "vocabulary")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = X.vocabulary(spark, d)
    long = v.select(F.lit("length").alias("list"), "term", F.length("term").cast("long").alias("n")).orderBy(F.desc("n"), "term").limit(10)
    return long.unionByName(v.groupBy(F.col("entity_type").alias("term")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("kind").alias("list"), "term", "n").orderBy(F.desc("n"), "term").limit(10))


@query("snk23_stamped", "SELECT r_regionkey, TIMESTAMP '2001-08-01 00:00:00' AS last_updated FROM region")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "region").select("r_regionkey", F.lit("2001-08-01 00:00:00").cast("timestamp").alias("last_updated"))


@query("set01_union_all", "SELECT o_custkey AS id FROM orders UNION ALL SELECT c_custkey FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "orders").select(F.col("o_custkey").alias("id")).unionByName(X.raw(spark, d, "customer").select(F.col("c_custkey").alias("id")))


@query("set02_union", "SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "orders").select(F.col("o_custkey").alias("id")).unionByName(X.raw(spark, d, "customer").select(F.col("c_custkey").alias("id"))).distinct()


@query("set03_difference", "SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "customer").select(F.col("c_custkey").alias("id")).subtract(X.raw(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("set04_intersection", "SELECT c_custkey AS id FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.raw(spark, d, "customer").select(F.col("c_custkey").alias("id")).intersect(X.raw(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("set05_keep_latest", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.latest(X.raw(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("set06_symmetric_closure", "SELECT l_orderkey AS h, 1 AS r, l_suppkey AS t FROM lineitem UNION ALL SELECT l_suppkey, 7, l_orderkey FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.graph import symmetric_closure

    return symmetric_closure(X.raw(spark, d, "lineitem").select(F.col("l_orderkey").alias("h"), F.lit(1).alias("r"), F.col("l_suppkey").alias("t")), 6)


@query("set07_differences", "(SELECT s_nationkey AS n, 'a' AS side FROM supplier EXCEPT ALL SELECT c_nationkey, 'a' FROM customer) UNION ALL (SELECT c_nationkey, 'b' FROM customer EXCEPT ALL SELECT s_nationkey, 'b' FROM supplier)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.differences(X.raw(spark, d, "supplier").select(F.col("s_nationkey").alias("n")), X.raw(spark, d, "customer").select(F.col("c_nationkey").alias("n")))


@query("flt28_contract", "SELECT count(*) AS rows FROM labels WHERE quality IN (0, 1)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return B.demanded(X.raw(spark, d, "labels"), F.col("quality").isin(0, 1), "quality must be 0 or 1").agg(F.count(F.lit(1)).alias("rows"))


@query("agg22_counts_by_type", " SELECT type, count(*) AS n FROM works GROUP BY type ORDER BY n DESC, type", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.works(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type")


@query("agg23_scalars", " SELECT count(*) AS n, CAST(max(publication_date) AS VARCHAR) AS last, count(DISTINCT type) AS types FROM works", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.works(spark, d).agg(F.count(F.lit(1)).alias("n"), F.max("publication_date").cast("string").alias("last"), F.countDistinct("type").alias("types"))


@query("agg25_two_coauthors", " SELECT work_id, array_to_string(list_sort(list(DISTINCT name))[1:2], '; ') AS names FROM authorships JOIN authors USING (author_id) GROUP BY work_id", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = X.authorships(spark, d).join(X.authors(spark, d).select("author_id", "name"), "author_id")
    return rows.groupBy("work_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 2), "; ").alias("names"))


@query("agg21_most_common", "SELECT l_shipdate, n, n / 10.0 AS dominance FROM (SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, l_shipdate LIMIT 10")
def _(spark: SparkSession, d: str) -> DataFrame:
    counts = X.raw(spark, d, "lineitem").groupBy(F.to_date("l_shipdate").cast("string").alias("l_shipdate")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "l_shipdate").limit(10).withColumn("dominance", F.col("n") / 10.0)


@query("agg37_funnel", "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_totalprice > 100000) AS large, count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderstatus = 'F') AS both_ FROM orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    f, large = F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000
    return X.raw(spark, d, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_if(f).alias("f"), F.count_if(large).alias("large"), F.count_if(f & large).alias("both_"))


@query("map08_explode_affiliations", " SELECT work_id, author_id, inst FROM (SELECT work_id, author_id, unnest(CASE WHEN n = 0 THEN [NULL] ELSE list_transform(range(n), lambda k: inst_id + k) END) AS inst FROM (SELECT *, pos_index % 3 AS n FROM authorships))", *_T)
def _(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("pos_index") % 3
    insts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda k: (F.col("inst_id") + k).cast("long")))
    return X.authorships(spark, d).select("work_id", "author_id", F.explode_outer(insts).alias("inst"))
