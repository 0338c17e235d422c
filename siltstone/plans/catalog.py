"""Registered queries: each applies an operator to the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import finance, scalars
from siltstone.operators import chunks, evidence, graph, merge, retrieval, telemetry
from siltstone.streaming import jobs

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_D6 = lambda c: F.round(c.cast("double"), 6)

# -- identifiers, links, texts ------------------------------------------------------------------------------------


@query("SELECT page_id, 'src_' || substr(sha256('web' || chr(31) || url || chr(31) || 'None'), 1, 24) AS id FROM pages WHERE url IS NOT NULL")
def p1_stable_id(spark, d):
    return table(spark, d, "pages").filter("url is not null").select("page_id", scalars.stable_id("src", F.lit("web"), "url", F.lit(None)).alias("id"))


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www[.]', '')"


@query(f"SELECT page_id, {_HOST} AS host, CASE WHEN regexp_matches({_HOST}, '(^|[.])example[.]com$') THEN 1 WHEN regexp_matches({_HOST}, '(^|[.])example[.]net$') THEN 2 ELSE 3 END AS tier FROM pages")
def p2_p3_trust_tier(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.hostname("url").alias("host"), scalars.trust_tier("url", ["example.com"], ["example.net"]).alias("tier"))


@query("SELECT page_id, CASE WHEN url LIKE 'https://%' THEN url ELSE '' END AS link FROM pages")
def p4_safe_link(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.safe_url("url", https_only=True).alias("link"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(latest|recent|current|progress|as of)') THEN 1 ELSE 0 END AS time_sensitive, CASE WHEN regexp_matches(lower(text), '(roe|roa|compare|growth|margin|ratio)') THEN 1 ELSE 0 END AS calculation FROM documents")
def p6_intent_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.is_time_sensitive("text").cast("int").alias("time_sensitive"), scalars.needs_calculation("text").cast("int").alias("calculation"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+(?:[._%-][a-z0-9]+)*')) AS INTEGER) AS n_tokens FROM documents")
def p15_lexical_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(scalars.lexical_tokens("text")).alias("n_tokens"))


@query("SELECT event_id, CAST(round_even(CAST((k * 0.1 + (2 * k) * 0.4 + k * 1.0) / 1000000 AS DECIMAL(18,10)), 8) AS DOUBLE) AS cost FROM (SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS DECIMAL(18,0)) AS k FROM events) x")
def p17_usage_cost(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.regexp_extract("props", r"(\d+)", 1).cast("long"))
    return rows.select("event_id", scalars.usage_cost("k", F.col("k") * 2, "k", F.lit("0.1"), F.lit("0.4"), F.lit("1.0")).cast("double").alias("cost"))


@query("SELECT doc_id, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS snippet, substr(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), 1, 80) AS title FROM documents")
def p20_bounded_text(spark, d):
    return table(spark, d, "documents").select("doc_id", scalars.bounded("text", 300).alias("snippet"), scalars.title_of("text").alias("title"))


# -- texts to rows ------------------------------------------------------------------------------------------------


@query()
def t1_sections(spark, d):
    return chunks.sections(_pages(spark, d))


@query()
def t5_sentences(spark, d):
    return chunks.sentences(table(spark, d, "documents"))


def _pages(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), "text")


@query()
def t8_chunk_documents(spark, d):
    return chunks.chunk_documents(_pages(spark, d))


@query("SELECT page_id, CAST(n - 1 AS INTEGER) AS pos, links[n] AS link FROM (SELECT page_id, links, unnest(range(1, len(links) + 1)) AS n FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS links FROM pages) a) b")
def t11_page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "link"))


# -- facts --------------------------------------------------------------------------------------------------------

_FACTS_SQL = """
lines AS (SELECT n.n_name AS company, year(o.o_orderdate) || ' Q' || quarter(o.o_orderdate) AS period, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS price, CAST(l.l_extendedprice * l.l_discount AS DECIMAL(18,4)) AS cost
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
facts AS (SELECT company, period, sum(price) AS revenue, sum(cost) AS cost FROM lines GROUP BY company, period)"""


def _facts(spark, d) -> DataFrame:
    """company (nation), period (quarter), revenue, cost."""
    t = lambda n: table(spark, d, n)
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    period = F.concat(F.year("o_orderdate").cast("string"), F.lit(" Q"), F.quarter("o_orderdate").cast("string"))
    money = lambda c: c.cast("decimal(18,2)")
    return rows.select(F.col("n_name").alias("company"), period.alias("period"), money(F.col("l_extendedprice")).alias("price"), (F.col("l_extendedprice") * F.col("l_discount")).cast("decimal(18,4)").alias("c")).groupBy("company", "period").agg(F.sum("price").alias("revenue"), F.sum("c").alias("cost"))


@query(f"""WITH {_FACTS_SQL}, q AS (SELECT *, CAST(substr(period, 1, 4) AS INTEGER) * 4 + CAST(substr(period, 7, 1) AS INTEGER) AS i FROM facts)
SELECT a.company, a.period, round(CAST((a.revenue - b.revenue) AS DOUBLE) / CAST(b.revenue AS DOUBLE) * 100, 4) AS qoq, round(CAST((a.revenue - y.revenue) AS DOUBLE) / CAST(y.revenue AS DOUBLE) * 100, 4) AS yoy
FROM q a LEFT JOIN q b ON a.company = b.company AND b.i = a.i - 1 LEFT JOIN q y ON a.company = y.company AND y.i = a.i - 4""")
def w5_growth_series(spark, d):
    rows = evidence.growth_series(_facts(spark, d).select("company", "period", F.col("revenue").alias("value")), "company")
    return rows.select("company", "period", F.round(F.col("qoq").cast("double"), 4).alias("qoq"), F.round(F.col("yoy").cast("double"), 4).alias("yoy"))


@query(f"WITH {_FACTS_SQL} SELECT company, period, round(CAST(revenue - cost AS DOUBLE) / CAST(revenue AS DOUBLE) * 100, 6) AS gross_margin FROM facts")
def p23_gross_margin(spark, d):
    return _facts(spark, d).select("company", "period", _D6(finance.gross_margin("revenue", "cost")).alias("gross_margin"))


@query(f"WITH {_FACTS_SQL} SELECT period FROM facts GROUP BY period HAVING count(DISTINCT company) = (SELECT count(DISTINCT company) FROM facts)")
def u1_common_periods(spark, d):
    return evidence.common_periods(_facts(spark, d).select("company", "period"))


@query(f"WITH {_FACTS_SQL}, t AS (SELECT company, sum(revenue) AS r, sum(cost) AS c FROM facts GROUP BY company) SELECT company, round(CAST(r - c AS DOUBLE) / CAST(r AS DOUBLE) * 100, 6) AS gross_margin FROM t")
def a15_peer_comparison(spark, d):
    rows = _facts(spark, d).select("company", F.explode(F.create_map(F.lit("revenue"), "revenue", F.lit("cost"), "cost")).alias("metric", "value")).groupBy("company", "metric").agg(F.sum("value").alias("value"))
    return evidence.compare_companies(rows).select("company", _D6(F.col("gross_margin")).alias("gross_margin"))


@query("""WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice, 0) AS BIGINT) AS v FROM orders), l AS (SELECT l_orderkey, CAST(round(sum(l_extendedprice), 0) AS BIGINT) AS v FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS order_key, CAST(2 AS BIGINT) AS n_values FROM o JOIN l ON o_orderkey = l_orderkey WHERE o.v <> l.v""")
def a2_fact_conflicts(spark, d):
    number = lambda c: F.round(c, 0).cast("long").cast("string").alias("value")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), number(F.col("o_totalprice")))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("v")).select("k", number(F.col("v")))
    both = orders.withColumn("source_id", F.lit("order")).unionByName(lines.withColumn("source_id", F.lit("lines")))
    facts = both.select(F.col("k").cast("string").alias("company"), "k", F.lit("total").alias("metric"), F.lit("FY").alias("period"), F.lit("USD").alias("unit"), F.lit(None).cast("string").alias("currency"), "value", "source_id")
    return evidence.fact_conflicts(facts).select(F.col("k").alias("order_key"), "n_values").distinct()


@query("SELECT o_custkey AS cust_key, max(o_totalprice) AS newest_max, min(CAST(substr(o_orderpriority, 1, 1) AS INTEGER)) AS tier FROM orders GROUP BY o_custkey")
def s6_upsert_least(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("cust_key"), F.col("o_totalprice").alias("newest_max"), F.substring("o_orderpriority", 1, 1).cast("int").alias("tier"), F.col("o_totalprice").alias("at"))
    return merge.upsert(rows.filter("tier <= 2"), rows.filter("tier > 2"), ["cust_key"], {"newest_max": merge.NEWEST, "tier": merge.LEAST}, "at").select("cust_key", F.col("at").alias("newest_max"), "tier")


@query("SELECT url, sha256(html) AS content_hash, min(page_id) AS first_page FROM pages WHERE url <> '' GROUP BY url, sha256(html)")
def s10_first_snapshots(spark, d):
    rows = table(spark, d, "pages").select("url", F.col("html").alias("snippet"), F.col("page_id").alias("retrieved_at"))
    return merge.first_snapshots(rows.limit(0).withColumn("content_hash", F.lit("")), rows).select("url", "content_hash", F.col("retrieved_at").alias("first_page"))


# -- retrieval ----------------------------------------------------------------------------------------------------

_TOK = "regexp_extract_all(lower({t}), '[a-z0-9]+(?:[._%-][a-z0-9]+)*')"


@query(f"""WITH dt AS (SELECT doc_id, {_TOK.format(t="text")} AS t FROM documents), st AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS avgdl FROM dt),
q AS (SELECT DISTINCT item_id, unnest({_TOK.format(t="text")}) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM dt) a WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), dl AS (SELECT doc_id, len(t) AS l FROM dt),
s AS (SELECT item_id, tf.doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avgdl))) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN dl ON tf.doc_id = dl.doc_id CROSS JOIN st GROUP BY item_id, tf.doc_id)
SELECT item_id, doc_id, CAST(r AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS r FROM s) x WHERE r <= 5""")
def r1_bm25(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    rows = retrieval.bm25(q, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 5)
    return rows.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


def _dense(spark, d, k: int, query_id: str = "vec_id") -> DataFrame:
    """Every vector whose id is divisible by 100 asks all vectors."""
    v = table(spark, d, "embeddings")
    asked = v.filter("vec_id % 100 = 0").select(F.expr(query_id).alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense(asked, v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), k)


@query("""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.id AS query_id, v.id AS id, coalesce(round(list_cosine_similarity(q.e, v.e), 4), 0.0) AS score FROM v AS q CROSS JOIN v WHERE q.id % 100 = 0)
SELECT query_id, id, score + 0.0 AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) x WHERE rank <= 10""")
def r3_dense_topk(spark, d):
    return _dense(spark, d, 10)


@query()
def r6_fusion(spark, d):
    """The query vectors, numbered from 0, go with the benchmark texts of these ids; what has no partner is ranked by its own side alone."""
    dense = _dense(spark, d, 20, "vec_id div 100")
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    lexical = retrieval.bm25(q, table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 20)
    routes = q.select("query_id", scalars.route("query").alias("route"))
    kinds = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, "text").otherwise("table").alias("chunk_type"))
    return retrieval.fuse(dense, lexical, routes, kinds)


@query("""SELECT item_id, CAST(count(d.doc_id) AS BIGINT) AS matched FROM benchmark b LEFT JOIN documents d ON contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g'))) GROUP BY item_id""")
def j13_retrieval_hits(spark, d):
    flat = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("name"), flat("text").alias("alias"), F.lit(0).alias("pos"))
    hits = graph.mentions(table(spark, d, "documents").select("doc_id", flat("text").alias("text")), items, "doc_id").groupBy("name").agg(F.count("*").alias("matched"))
    return items.select("name").join(hits, "name", "left").fillna(0, ["matched"]).withColumnRenamed("name", "item_id")


# -- conversations, graph, telemetry ------------------------------------------------------------------------------


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) x WHERE r <= 3")
def w1_last_messages(spark, d):
    return telemetry.last_messages(table(spark, d, "conversations"), 3).select("conv_id", "turn", "role", "text")


@query("SELECT conv_id, substr(trim(regexp_replace(arg_min(text, turn), '[ \\t\\n\\r]+', ' ', 'g')), 1, 48) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
def w2_titles(spark, d):
    return telemetry.titles(table(spark, d, "conversations"))


@query("SELECT conv_id, string_agg('## ' || role || chr(10) || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def s13_markdown_export(spark, d):
    return telemetry.markdown_export(table(spark, d, "conversations"))


@query("SELECT conv_id AS answer_id, string_agg(text, '' ORDER BY turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY conv_id HAVING trim(string_agg(text, '' ORDER BY turn)) <> ''")
def a17_assembled_answers(spark, d):
    rows = table(spark, d, "conversations").filter("role = 'assistant'")
    return telemetry.assemble_answers(rows.select(F.col("conv_id").alias("answer_id"), F.col("turn").alias("seq"), F.col("text").alias("token")))


@query("SELECT event_type AS tool, count(*) AS n, CAST(round_even(CAST(avg(CAST(value AS DECIMAL(20,6))) AS DECIMAL(20,6)), 2) AS DOUBLE) AS mean, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def a4_a8_tool_summary(spark, d):
    return finance.summary(table(spark, d, "events").withColumnRenamed("event_type", "tool"), "value", "tool").withColumn("mean", F.col("mean").cast("double"))


@query("""WITH r AS (SELECT event_type AS path, round(value, 1) AS ms FROM events WHERE value IS NOT NULL), x AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ms) - 1 AS i, count(*) OVER (PARTITION BY path) AS n FROM r)
SELECT path, round(quantile_cont(ms, 0.5), 2) AS median_ms, round(max(CASE WHEN i = least(n - 1, n * 95 // 100) THEN ms END), 2) AS p95_ms, round(max(ms), 2) AS max_ms FROM x GROUP BY path""")
def a9_route_latency(spark, d):
    return telemetry.route_latency(table(spark, d, "events").filter("value is not null").select(F.col("event_type").alias("path"), F.round("value", 1).alias("ms")))


@query("SELECT user_id AS run_id, count(*) FILTER (event_type = 'click') AS model_calls, count(*) FILTER (event_type = 'view') AS tool_calls, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'error' ELSE 'success' END AS status FROM events GROUP BY user_id")
def a6_run_rollup(spark, d):
    kind = F.when(F.col("event_type") == "click", "model").when(F.col("event_type") == "view", "tool").when(F.col("event_type") == "error", "final").otherwise("other")
    rows = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "ts", kind.alias("kind"), (F.col("event_type") != "error").alias("ok"), F.lit(1).alias("prompt"), F.lit(1).alias("completion"), F.col("value").alias("latency_ms"), F.lit(None).cast("string").alias("status"))
    return telemetry.run_rollup(rows).select("run_id", "model_calls", "tool_calls", "status")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2")
def x1_hourly_metrics(spark, d):
    return jobs.windowed_metrics(table(spark, d, "events")).select("start", "event_type", "n", F.round("total", 6).alias("total"), "errors")


@query()
def x2_limiter(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.unix_timestamp("ts").cast("double").alias("ts"))
    return jobs.limit_batch(rows, 3, 86_400.0)


@query("SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, greatest(0, least(100, CAST(floor(arg_max(value, event_id)) AS INTEGER))) AS progress FROM events WHERE value IS NOT NULL GROUP BY user_id")
def x5_job_states(spark, d):
    rows = table(spark, d, "events").filter("value is not null").select(F.col("user_id").alias("job_id"), F.lit(0).alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.col("event_type").alias("stage"), F.floor("value").cast("int").alias("progress"))
    return jobs.job_states(rows).select("job_id", "status", "progress")


@query("SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS orphans")
def j12_orphans(spark, d):
    return telemetry.orphans(table(spark, d, "lineitem"), table(spark, d, "orders"), "l_orderkey", "o_orderkey")


@query("SELECT count(*) AS rows, count(*) FILTER (NOT (l_quantity >= 0)) AS negative, (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) x) AS duplicate_keys, '' AS missing_columns FROM lineitem")
def a18_table_contract(spark, d):
    return telemetry.table_contract(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], {"l_quantity": "double"}, {"negative": "l_quantity >= 0"})


@query("SELECT DISTINCT d.doc_id, CAST(b.item_id AS VARCHAR) AS name FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(substr(b.text, 1, 24)))")
def j4_j5_mentions(spark, d):
    """Documents that mention a benchmark item by its first letters."""
    aliases = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("name"), F.substring("text", 1, 24).alias("alias"), F.col("item_id").alias("pos"))
    return graph.mentions(table(spark, d, "documents"), aliases, "doc_id").select("doc_id", "name")


@query("SELECT lower(trim(p_name)) AS alias_key, min(p_partkey) AS node_id, count(DISTINCT p_partkey) AS claims FROM part WHERE trim(p_name) <> '' GROUP BY lower(trim(p_name))")
def w6_alias_index(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("alias"), F.col("p_partkey").alias("pos"))
    index, collisions = graph.alias_index(rows)
    return index.join(collisions, "alias_key", "left").fillna(1, ["claims"])


@query("SELECT count(DISTINCT source) AS sources, count(*) FILTER (lang = 'en') AS english FROM documents")
def a1_corpus_stats(spark, d):
    return table(spark, d, "documents").agg(F.countDistinct("source").alias("sources"), F.count_if(F.col("lang") == "en").alias("english"))


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def k1_newest_orders(spark, d):
    return telemetry.newest(table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"), 100, "o_orderdate", "o_orderkey")


@query("""WITH r AS (SELECT page_id, url, DATE '2026-09-11' - CAST(page_id * 7 AS INTEGER) AS day FROM pages), s AS (SELECT page_id, CASE WHEN date_diff('day', day, DATE '2026-09-11') > 550 THEN 'stale' ELSE 'dated' END AS date_status FROM r)
SELECT page_id, date_status, round(CAST(page_id % 10 AS DOUBLE) / 10 + CASE WHEN date_status = 'stale' THEN -0.10 ELSE 0.08 END, 6) AS rank_score FROM s""")
def k2_web_policy(spark, d):
    day = F.date_sub(F.lit("2026-09-11").cast("date"), (F.col("page_id") * 7).cast("int")).cast("string")
    rows = table(spark, d, "pages").select("page_id", F.pmod("page_id", F.lit(97)).alias("query_id"), F.lit("latest results").alias("query"), F.col("page_id").alias("pos"), day.alias("published_at"), F.lit(3).alias("trust_tier"), (F.col("page_id") % 10 / 10).alias("score"))
    return evidence.assess_results(rows, F.lit("2026-09-11").cast("date")).select("page_id", "date_status", F.round("rank_score", 6).alias("rank_score"))
