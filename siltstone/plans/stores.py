"""Registered queries on stores that batches write, on table functions, and on histograms of streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import finance, table_functions
from siltstone.functions.scalars import keyed_hash
from siltstone.operators import dense_index, lexical_index
from siltstone.plans.catalog import SQL, query, table
from siltstone.sources.folders import shared_folder
from siltstone.sources.ledger import Ledger
from siltstone.streaming import jobs


@query("SELECT p_partkey AS doc_id, CAST(0 AS INTEGER) AS pos, p_name AS section, p_brand AS text FROM part UNION ALL SELECT p_partkey, 1, p_type, CAST(p_size AS VARCHAR) FROM part WHERE p_size % 3 > 0 UNION ALL SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 2 ELSE 1 END, '3', 'end' FROM part")
def t1_sections_in_sql(spark, d):
    """Pages of three headings; the second section is empty for every third size."""
    table_functions.register(spark)
    body = F.when(F.col("p_size") % 3 > 0, F.col("p_size").cast("string")).otherwise(" ")
    table(spark, d, "part").select("p_partkey", F.concat(F.lit("# "), "p_name", F.lit("\n"), "p_brand", F.lit("\n##  "), "p_type", F.lit(" #\n"), body, F.lit("\n### 3\nend\n")).alias("md")).createOrReplaceTempView("part_pages")
    return spark.sql("SELECT p_partkey AS doc_id, s.pos, s.section, s.text FROM part_pages, LATERAL text_sections(md) AS s")


@query("SELECT conv_id, turn, CAST(0 AS INTEGER) AS pos, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations WHERE length(text) <= 512 AND text NOT LIKE '%' || chr(10) || '%' AND trim(text) <> ''")
def t6_chunks_in_sql(spark, d):
    """Texts of one paragraph that fits are a chunk each."""
    table_functions.register(spark)
    table(spark, d, "conversations").createOrReplaceTempView("conversation_rows")
    return spark.sql("SELECT conv_id, turn, c.pos, c.text FROM conversation_rows, LATERAL text_chunks(text, 512, 64) AS c WHERE length(conversation_rows.text) <= 512 AND NOT contains(conversation_rows.text, '\n')")


_INNER, _OUTER = ("".join(f"\\x{b ^ pad:02X}" for b in b"audit key".ljust(64, b"\0")) for pad in (0x36, 0x5C))


@query(f"SELECT event_id, substr(sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || encode(CAST(user_id AS VARCHAR))))), 1, 24) AS client FROM events WHERE event_type <> 'view'")
def p18_client_hashes(spark, d):
    return table(spark, d, "events").filter("event_type <> 'view'").select("event_id", keyed_hash("user_id", "audit key").alias("client"))


@query("""WITH w AS (SELECT event_type, value, date_trunc('hour', ts) - to_hours(k) AS start FROM events CROSS JOIN (SELECT unnest(range(24)) AS k) x WHERE value > 0)
SELECT start, event_type, count(*) AS n, true AS within FROM w GROUP BY ALL""")
def x1_sliding_p95(spark, d):
    """Windows of a day, moved by an hour: the histogram's percentile lies within its bound of the exact one."""
    events = table(spark, d, "events")
    rows = jobs.windowed_p95(events)
    exact = finance.nearest_rank(events.filter("value > 0").select(F.window("ts", "24 hours", "1 hour").getField("start").alias("start"), "event_type", "value"), "value", 0.95, "start", "event_type")
    within = (F.col("p95") >= F.col("p") * (1 - 1e-6)) & (F.col("p95") <= F.col("p") * jobs.GROWTH * (1 + 1e-6))
    return rows.join(exact.drop("n"), ["start", "event_type"]).select("start", "event_type", "n", within.alias("within"))


@query("""WITH c AS (SELECT o_custkey AS cache_key, max(o_orderkey) AS newest FROM orders GROUP BY o_custkey), l AS (SELECT cache_key, newest FROM c JOIN orders ON newest = o_orderkey WHERE o_orderdate > TIMESTAMP '1998-01-01'),
r AS (SELECT cache_key, newest, CAST(i AS INTEGER) AS i, CASE WHEN i = 0 THEN 'dated' WHEN i = 1 THEN 'stale' ELSE 'undated' END AS date_status, CASE WHEN i = 0 THEN 0.28 WHEN i = 1 THEN -0.02 ELSE 0.0 END AS rank_score FROM l CROSS JOIN (SELECT unnest(range(3)) AS i) x)
SELECT cache_key, newest, i, date_status, round(CAST(rank_score AS DOUBLE), 6) AS rank_score FROM r""")
def s11_x4_cache(spark, d):
    """Search results cached in three batches, one of which comes twice: the latest of a key replaces the others, and is judged at read."""
    orders = table(spark, d, "orders")
    day = lambda text: F.lit(text).cast("string")
    results = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit("t").alias("title"), F.col("o_orderkey").cast("string").alias("url"), F.lit("s").alias("snippet"), published.alias("published_at"), F.lit(tier).alias("trust_tier"), F.lit(0.0).alias("score")) for i, (published, tier) in enumerate([(day("1997-12-01"), 1), (day("1990-01-01"), 2), (F.lit(None).cast("string"), 3), (day("1999-01-01"), 1)])])
    # cached in the order of keys: a microsecond each
    found = orders.select(F.col("o_custkey").cast("string").alias("cache_key"), F.lit("latest revenue").alias("query"), F.timestamp_micros(F.col("o_orderkey").cast("long")).alias("cached_at"), F.col("o_orderdate").cast("timestamp").alias("expires_at"), results.alias("results"), "o_orderkey")
    cache = Ledger(spark, shared_folder(spark, "cache"), jobs.CACHE)
    for number in (0, 1, 1, 2):
        jobs.cache_batch(found.filter(F.col("o_orderkey") % 3 == number).drop("o_orderkey"), number, cache)
    now = F.lit("1998-01-01").cast("timestamp")
    got = jobs.cached_results(jobs.cache_rows(cache), found.select("cache_key"), now)
    return got.select(F.col("query_id").cast("long").alias("cache_key"), F.col("url").cast("long").alias("newest"), F.col("pos").alias("i"), "date_status", F.round("rank_score", 6).alias("rank_score"))


@query("SELECT conv_id AS document_id, sha256(text) AS content_hash, CAST(min(turn) AS INTEGER) AS page, count(DISTINCT text) AS indexed FROM (SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations WHERE length(text) <= 512 AND text NOT LIKE '%' || chr(10) || '%' AND text NOT LIKE '%|%' AND text NOT LIKE '%#%' AND trim(text) <> '') x GROUP BY conv_id, text")
def x7_ingested_chunks(spark, d):
    """Conversations as pages, in three batches of which two overlap and one comes twice: each content of a document is stored and indexed once."""
    rows = table(spark, d, "conversations").filter("length(text) <= 512 and not contains(text, '\n') and not contains(text, '|') and not contains(text, '#')")
    pages = rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), "text")
    store = shared_folder(spark, "ingested")
    chunks, index = Ledger(spark, f"{store}/chunks", jobs.CHUNKS), Ledger(spark, f"{store}/index", jobs.INDEX)
    for number, part in ((0, "doc_id % 3 <> 2"), (1, "doc_id % 3 <> 0"), (1, "doc_id % 3 <> 0"), (2, "true")):
        jobs.ingest_batch(pages.filter(part), number, chunks, index)
    held = index.read().groupBy("id").agg(F.count("*").alias("indexed"))
    return jobs.stored_chunks(chunks).join(held, "id", "left").select("document_id", "content_hash", "page", "indexed")


@query(SQL["r1_bm25"])
def r1_indexed_bm25(spark, d):
    """r1_bm25 from a stored index."""
    path = shared_folder(spark, "lexical-index")
    lexical_index.build(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), path)
    queries = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = lexical_index.search(spark, path, queries, 5)
    return rows.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@query(SQL["r3_dense_topk"])
def r3_indexed_dense(spark, d):
    """r3_dense_topk from a stored index."""
    path = shared_folder(spark, "dense-index")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    dense_index.build(vectors, path)
    return dense_index.search(spark, path, vectors.filter("id % 100 = 0").withColumnRenamed("id", "query_id"), 10)
