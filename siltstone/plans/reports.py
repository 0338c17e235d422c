"""Registered queries on what is shown or written at the end: contexts, timelines, dashboards, records, result pages, indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.operators import chunks, evidence, merge, telemetry
from siltstone.plans.catalog import SQL, _FACTS_SQL, _facts, query, table
from siltstone.sources.folders import shared_folder

SQL["t5_sentences"] = r"""WITH p AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^。！？.!?\n]*[。！？.!?\n]|[^。！？.!?\n]+') AS a FROM documents),
s AS (SELECT doc_id, unnest(range(len(a))) AS k, a[unnest(range(len(a))) + 1] AS u FROM p), c AS (SELECT doc_id, k, CASE WHEN k = 0 THEN u ELSE regexp_replace(u, '^\s+', '') END AS sentence FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS pos, sentence FROM c WHERE regexp_matches(sentence, '\S')"""

SQL["t1_sections"] = r"""WITH p AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), h AS (SELECT doc_id, list_prepend('正文', [trim(x, '# ' || chr(9)) FOR x IN regexp_extract_all(t, '(?m)^#{1,3}\s+.+$')]) AS heads, regexp_split_to_array(t, '(?m)^#{1,3}\s+.+$') AS bodies FROM p),
u AS (SELECT doc_id, unnest(range(len(bodies))) AS k, heads[unnest(range(len(bodies))) + 1] AS section, regexp_replace(bodies[unnest(range(len(bodies))) + 1], '^\s+|\s+$', '', 'g') AS text FROM h)
SELECT doc_id, 1 AS page, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS pos, section, text FROM u WHERE text <> ''"""


@query(f"""WITH {_FACTS_SQL}, a AS (SELECT company, period, unnest([0, 1, 2, 3]) AS kind FROM facts WHERE period = '1996 Q2')
SELECT request_id, company, period, status FROM (SELECT 'r' || kind || company AS request_id, company, unnest(CASE kind WHEN 0 THEN ['1996 Q2', 'FY1996'] WHEN 1 THEN ['2031 Q1', 'FY1996'] WHEN 2 THEN ['2031 Q1'] ELSE ['FY1996'] END) AS period,
unnest(CASE kind WHEN 0 THEN ['found', 'missing'] WHEN 1 THEN ['-', 'annual'] WHEN 2 THEN ['missing'] ELSE ['annual'] END) AS status FROM a) x WHERE status <> '-'""")
def j7_context_periods(spark, d):
    """Four requests for each nation: a quarter with the year, a missing one with it, a missing one alone, none; of three companies the first two count."""
    quarters = _facts(spark, d).select("company", "period")
    companies = table(spark, d, "nation").select(F.col("n_name").alias("company"))
    # the second company is in no registry, the third is past the limit
    asked = [["1996 Q2", "FY1996"], ["2031 Q1", "FY1996"], ["2031 Q1"], []]
    periods = F.array(*[F.array(*map(F.lit, a)).cast("array<string>") for a in asked])
    held = companies.join(quarters.filter("period = '1996 Q2'"), "company", "left_semi")
    requests = held.select(F.posexplode(periods).alias("kind", "periods"), "company").select(F.concat(F.lit("r"), "kind", "company").alias("request_id"), F.array("company", F.lit("nobody"), F.lit("FRANCE")).alias("companies"), "periods")
    return evidence.context_periods(requests, quarters, companies.withColumn("year", F.lit(1996)))


@query(f"""WITH {_FACTS_SQL} SELECT company, lower(company) AS name_en, period, period AS date, lower(company) || ' ' || period || ' results' AS title,
printf('Revenue USD %.2fbn · gross margin %.1f%%', round(CAST(revenue AS DOUBLE), 2), round(CAST(cost AS DOUBLE), 0)) AS summary, 'report' AS source_title, 'https://example.org/' || lower(left(company, 1)) AS source_url
FROM facts JOIN nation ON n_name = company WHERE n_nationkey < 3 ORDER BY period DESC, company DESC LIMIT 12""")
def j10_watchlist_events(spark, d):
    points = _facts(spark, d).select("company", F.lower("company").alias("name_en"), "period", F.round(F.col("revenue").cast("double"), 2).alias("revenue"), F.round(F.col("cost").cast("double"), 0).alias("gross_margin"))
    points = points.withColumns({"published_at": F.col("period"), "source_title": F.lit("report"), "source_url": F.concat(F.lit("https://example.org/"), F.lower(F.substring("company", 1, 1)))})
    watched = table(spark, d, "nation").filter("n_nationkey < 3").select(F.col("n_name").alias("company"))
    return evidence.watchlist_events(points, watched, "en")


@query("""SELECT o_custkey AS answer_id, count(*) FILTER (o_orderkey % 4 = 1) AS tier_1, count(*) FILTER (o_orderkey % 4 = 2) AS tier_2, count(*) FILTER (o_orderkey % 4 = 3) AS tier_3, count(*) FILTER (o_orderstatus = 'O') AS undated, count(*) FILTER (o_orderstatus = 'F') AS stale,
o_custkey % 3 = 0 AS time_sensitive FROM orders GROUP BY o_custkey""")
def a14_source_mix_by_question(spark, d):
    orders = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "undated").when(F.col("o_orderstatus") == "F", "stale").otherwise("dated")
    cited = orders.select(F.col("o_custkey").alias("answer_id"), F.lit("web").alias("source_type"), (F.col("o_orderkey") % 4).alias("trust_tier"), status.alias("date_status"))
    asked = table(spark, d, "customer").select(F.col("c_custkey").alias("answer_id"), F.when(F.col("c_custkey") % 3 == 0, "the latest yield").otherwise("what is a wafer").alias("query"))
    return evidence.source_mix(cited, queries=asked)


@query(f"""WITH {_FACTS_SQL}, n AS (SELECT company, count(*) AS periods FROM facts WHERE period IN (SELECT period FROM facts GROUP BY period HAVING count(DISTINCT company) = (SELECT count(DISTINCT company) FROM facts)) GROUP BY company)
SELECT company, periods, CAST(n_nationkey AS DOUBLE) AS capex_intensity, 'Report ' || n_nationkey AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'https://example.org/r' ELSE '' END AS url FROM n JOIN nation ON n_name = company""")
def a19_dashboard_sources(spark, d):
    quarters = _facts(spark, d).select("company", "period", F.explode(F.create_map(F.lit("revenue"), F.col("revenue").cast("double"), F.lit("gross_margin"), F.col("cost").cast("double"))).alias("metric", "value"))
    key = F.col("n_nationkey")
    annual = table(spark, d, "nation").select(F.col("n_name").alias("company"), key.cast("double").alias("capex_intensity"), F.concat(F.lit("Report "), key.cast("string")).alias("source_title"), F.lit("p").alias("source_publisher"), F.lit("2026").alias("source_published_at"), F.when(key % 2 == 0, "https://example.org/r").otherwise("javascript:x").alias("source_url"))
    mix = annual.select("company", F.lit("n3").alias("process"), F.lit("~12%").alias("share"))
    out = evidence.dashboard(quarters, mix, annual)
    return out.select("company", F.size("series").cast("long").alias("periods"), "capex_intensity", "annual_source.title", "annual_source.url")


@query("""WITH s AS (SELECT conv_id, turn, '1. **WEB** [Page](https://example.org/' || turn || ') - Host | Tier 2' || chr(10) || '   > a b' || chr(10) || chr(10) || '2. **DOCUMENT** File' AS t FROM conversations WHERE role = 'assistant'),
p AS (SELECT c.conv_id, string_agg('## ' || CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Analysis' WHEN 'system' THEN 'System' ELSE role END || chr(10) || chr(10) || coalesce(text, '') || CASE WHEN t IS NULL THEN '' ELSE chr(10) || chr(10) || '### Sources' || chr(10) || chr(10) || t END, chr(10) || chr(10) ORDER BY c.turn) AS body
FROM conversations c LEFT JOIN s ON s.conv_id = c.conv_id AND s.turn = c.turn GROUP BY c.conv_id)
SELECT conv_id, '# ' || CASE WHEN conv_id % 2 = 0 THEN 'Talk' ELSE 'Untitled research' END || chr(10) || chr(10) || '> Exported: 2026-01-01' || chr(10) || chr(10) || body || chr(10) || chr(10) || '---' || chr(10) || chr(10) || 'End' || chr(10) AS markdown FROM p""")
def s13_research_records(spark, d):
    """Each answer cites a page and a file; every other conversation has no title."""
    messages = table(spark, d, "conversations")
    conversations = messages.select("conv_id").distinct().withColumn("title", F.when(F.col("conv_id") % 2 == 0, "Talk"))
    none = F.lit(None).cast("string")
    web = F.struct(F.lit(0).alias("pos"), F.lit("WEB").alias("icon"), F.lit("Page").alias("display"), F.concat(F.lit("https://example.org/"), F.col("turn").cast("string")).alias("url"), F.lit("Host").alias("publisher"), none.alias("published_at"), F.lit(2).alias("trust_tier"), F.lit("web").alias("source_type"), F.lit("a\nb ").alias("snippet"))
    file = F.struct(F.lit(1).alias("pos"), F.lit("DOCUMENT").alias("icon"), F.lit("File").alias("display"), F.lit("").alias("url"), none.alias("publisher"), none.alias("published_at"), F.lit(1).alias("trust_tier"), F.lit("document").alias("source_type"), none.alias("snippet"))
    cited = messages.filter("role = 'assistant'").select("conv_id", "turn", F.inline(F.array(file, web)))
    return telemetry.research_records(conversations, messages, cited, "2026-01-01", "End", "en")


@query("SELECT page_id, CAST(0 AS INTEGER) AS pos, 'It''s & \"it\" ' || page_id AS title, url, 'A & b' AS snippet, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www[.]', '') AS publisher, '' AS published_at, 3 AS trust_tier FROM pages WHERE url <> '' UNION ALL SELECT page_id, CAST(1 AS INTEGER), 'Last', 'https://example.org/x', '', 'example.org', '', 3 FROM pages WHERE url <> ''")
def t11_search_results(spark, d):
    """A result page made of each page's address: a result, one without a link, one without a snippet, and one past the limit."""
    block = lambda title, url, snippet: F.concat(F.lit('<div class="result results_links web"><h2 class="result__title"><a rel="n" href="'), url, F.lit('">'), title, F.lit("</a></h2>"), snippet, F.lit("</div> </div>\n"))
    first = block(F.concat(F.lit(" It&#x27;s &amp; <b>&quot;it&quot;</b> "), F.col("page_id").cast("string")), F.col("url"), F.lit('<a class="result__snippet" href="u">A <b>&amp;\n</b>b</a>'))
    first = F.replace(first, F.lit("&amp;\n</b>"), F.lit("&amp;</b> "))
    other = [block(F.lit(t), F.lit(u), F.lit("")) for t, u in (("No link", ""), ("Last", "https://example.org/x"), ("Past", "https://example.org/y"))]
    pages = table(spark, d, "pages").filter("url <> ''").select("page_id", F.concat(F.lit("<body>"), first, *other, F.lit("</body>")).alias("html"))
    return evidence.search_results(pages, max_results=3)


@query("SELECT count(DISTINCT source) AS doc_count, count(*) FILTER (doc_id % 5 <> 0) AS text_chunks, count(*) FILTER (doc_id % 5 = 0) AS table_chunks FROM documents")
def a1_index_stats(spark, d):
    kind = F.when(F.col("doc_id") % 5 == 0, "table").when(F.col("doc_id") % 5 == 1, "text")  # null: a text
    return merge.index_stats(table(spark, d, "documents").select("source", kind.alias("chunk_type")))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'table' ELSE 'text' END AS sink, count(*) AS n FROM documents WHERE doc_id % 3 <> 1 GROUP BY ALL")
def s12_written_index(spark, d):
    """All documents twice, of which a third is in the index already, written into two sinks and counted."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") % 5 == 0, "table").otherwise("text").alias("chunk_type"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"))
    rows = merge.new_index_rows(docs, docs.filter("id % 3 = 1").select("id").distinct())
    return merge.write_index(rows, shared_folder(spark, "index"))


@query("""WITH t AS (SELECT doc_id, unnest([1, 1, 3]) AS page, unnest([0, 1, 2]) AS n FROM documents)
SELECT substr(md5(CAST(doc_id AS VARCHAR) || '_table_' || page || '_' || n), 1, 12) AS id, doc_id, page, '[表格 ' || (n + 1) || '] 来源: ' || doc_id || ', 第 ' || page || ' 页' || chr(10) || '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| ' || n || ' | x |' AS text, CAST(n AS INTEGER) AS table_index, 1 AS rows, 2 AS cols FROM t""")
def t7_table_chunks(spark, d):
    """Two tables on the first page of each document and one on the third."""
    grid = lambda n: f"| a | b |\n|---|---|\n| {n} | x |\n"
    pages = F.array(F.struct(F.lit(1).alias("page"), F.lit(f"see\n{grid(0)}\nand\n{grid(1)}").alias("text")), F.struct(F.lit(3).alias("page"), F.lit(grid(2)).alias("text")))
    found = chunks.tables(table(spark, d, "documents").select("doc_id", F.inline(pages)))
    return chunks.numbered_table_chunks(found).select("id", "doc_id", "page", "text", "metadata.table_index", "metadata.rows", "metadata.cols")
