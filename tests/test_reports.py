"""Contexts, timelines, dashboards, records, result pages, indexes and metadata on small tables."""

import datetime
import hashlib
import json

from pyspark.sql import functions as F

from siltstone.operators import chunks, evidence, merge, telemetry
from siltstone.sources import registries


def quarter(revenue, margin, day, url="https://x.org/q"):
    return {"source_title": f"Q {day}", "source_url": url, "source_publisher": "P", "source_published_at": day, "metrics": {"revenue_usd_billion": revenue, "gross_margin_pct": margin}}


REGISTRY = {
    "companies": {
        "甲": {"name_en": "A", "year": 2025, "source_title": "Annual A", "source_url": "javascript:x", "source_publisher": "A Co", "source_published_at": "2026-01-02", "capex": {"intensity_pct": 33.4}, "capacity": {"process_mix": {"3nm": "24%", "old": "~76%"}}, "quarterly": {"2025 Q4": quarter(33.73, 62.3, "2026-01-15"), "2026 Q1": quarter(35.0, 63.0, "2026-04-16"), "2026 Q2": quarter(36.0, 64.0, "2026-07-16")}},
        "乙": {"name_en": "B", "year": 2025, "source_title": "Annual B", "source_url": "https://b.org/a", "source_publisher": "B Co", "source_published_at": "2026-02-02", "capex": {"intensity_pct": 20}, "capacity": {"process_mix": {"7nm": "10%"}}, "quarterly": {"2025 Q4": quarter(2.5, 20.0, "2026-02-10", "ftp://x"), "2026 Q1": quarter(2.25, 19.5, "2026-04-16")}},
    }
}


def companies(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(REGISTRY, ensure_ascii=False), encoding="utf-8")
    return registries.read_companies(spark, f"{tmp_path}/c.json")


def test_timeline_of_the_registry(spark, tmp_path):
    points = registries.timeline_points(companies(spark, tmp_path))
    watched = spark.createDataFrame([("甲",), ("乙",), ("丙",)], "company string")
    got = [(r.company, r.period, r.title, r.summary, r.source_url) for r in evidence.watchlist_events(points, watched, limit=3).collect()]
    assert got == [  # of one day the company that sorts later goes first; 2026 Q2 isn't known for both
        ("甲", "2026 Q1", "甲 2026 Q1 业绩", "营收 35.00 十亿美元 · 毛利率 63.0%", "https://x.org/q"),
        ("乙", "2026 Q1", "乙 2026 Q1 业绩", "营收 2.25 十亿美元 · 毛利率 19.5%", "https://x.org/q"),
        ("乙", "2025 Q4", "乙 2025 Q4 业绩", "营收 2.50 十亿美元 · 毛利率 20.0%", ""),
    ]
    english = evidence.watchlist_events(points, watched.filter("company = '乙'"), "en").collect()
    assert [(r.title, r.summary) for r in english] == [("B 2026 Q1 results", "Revenue USD 2.25bn · gross margin 19.5%"), ("B 2025 Q4 results", "Revenue USD 2.50bn · gross margin 20.0%")]
    assert evidence.watchlist_events(points, watched.limit(0)).count() == 0


def test_dashboard_with_sources(spark, tmp_path):
    own = companies(spark, tmp_path)
    quarters = registries.timeline_points(own).select("company", "period", F.explode(F.create_map(F.lit("revenue"), "revenue", F.lit("gross_margin"), "gross_margin")).alias("metric", "value"))
    got = {r.company: r for r in evidence.dashboard(quarters, registries.process_mix(own), registries.annual_sources(own)).collect()}
    assert [(x.period, x.revenue, x.gross_margin) for x in got["乙"].series] == [("2025 Q4", 2.5, 20.0), ("2026 Q1", 2.25, 19.5)] and len(got["甲"].series) == 2
    assert (got["甲"].capex_intensity, got["甲"].annual_source.title, got["甲"].annual_source.url) == (33.4, "Annual A", "")
    assert got["乙"].annual_source.url == "https://b.org/a" and [(m.process, m.percent, m.rough) for m in got["甲"].mix] == [("3nm", 24.0, False), ("old", 76.0, True)]


def test_context_never_serves_a_year_for_a_quarter(spark):
    quarters = spark.createDataFrame([("A", "2025 Q4"), ("B", "2026 Q1"), ("C", "2025 Q4")], "company string, period string")
    years = spark.createDataFrame([("A", 2025), ("B", 2025), ("C", 2025)], "company string, year int")
    asked = [(1, ["A", "B", "C"], ["2025 Q4"]), (2, ["A"], []), (3, ["A"], None), (4, ["A", "X"], ["FY2025", "2030 Q1"]), (5, ["B"], ["FY2024"]), (6, ["A"], ["2025 Q4", "FY2025"]), (7, [], ["2025 Q4"]), (8, None, None)]
    got = evidence.context_periods(spark.createDataFrame(asked, "request_id int, companies array<string>, periods array<string>"), quarters, years).collect()
    assert sorted((r.request_id, r.company, r.period, r.status) for r in got) == [
        (1, "A", "2025 Q4", "found"), (1, "B", "2025 Q4", "missing"),
        (2, "A", "FY2025", "annual"), (3, "A", "FY2025", "annual"), (4, "A", "FY2025", "annual"), (5, "B", "FY2024", "missing"),
        (6, "A", "2025 Q4", "found"), (6, "A", "FY2025", "missing"),
    ]


def test_source_mix_of_a_question(spark):
    cited = spark.createDataFrame([(1, "web", 1, "dated"), (1, "web", 3, "stale"), (1, "document", 1, "dated"), (2, "web", 2, "undated")], "answer_id int, source_type string, trust_tier int, date_status string")
    asked = spark.createDataFrame([(1, "the latest capacity"), (2, None)], "answer_id int, query string")
    got = {r.answer_id: (r.tier_1, r.tier_2, r.tier_3, r.undated, r.stale, r.time_sensitive) for r in evidence.source_mix(cited, queries=asked).collect()}
    assert got == {1: (1, 0, 1, 0, 1, True), 2: (0, 1, 0, 1, 0, False)}


def test_research_record(spark):
    talks = spark.createDataFrame([(1, "T"), (2, ""), (3, None)], "conv_id int, title string")
    said = spark.createDataFrame([(1, 0, "user", "q?"), (1, 1, "assistant", "a[1]"), (2, 0, "tool", None)], "conv_id int, turn int, role string, text string")
    cited = spark.createDataFrame([(1, 1, 5, None, "", "javascript:x", None, "2026", 1, "web", "s\nt"), (1, 1, 2, "DOCUMENT", "f.pdf", "https://f.org", "F", None, 1, "document", None)], "conv_id int, turn int, pos int, icon string, display string, url string, publisher string, published_at string, trust_tier int, source_type string, snippet string")
    got = {r.conv_id: r.markdown for r in telemetry.research_records(talks, said, cited, "now", "end").collect()}
    assert got[1] == "# T\n\n> 导出时间: now\n\n## 用户\n\nq?\n\n## 分析\n\na[1]\n\n### 来源\n\n1. **DOCUMENT** [f.pdf](https://f.org) - F\n\n2. **SOURCE** Source - 2026 | Tier 1\n   > s t\n\n---\n\nend\n"
    assert got[2] == "# 未命名研究\n\n> 导出时间: now\n\n## tool\n\n\n\n---\n\nend\n" and got[3] == "# 未命名研究\n\n> 导出时间: now\n\n---\n\nend\n"


def test_result_pages(spark):
    block = '<div class="result results_links"><h2 class="result__title"><a href="{}">{}</a></h2>{}</div></div>'
    page = block.format(" https://www.x.org/1 ", "\n<b>T</b> &amp; &quot;u&quot;\n", '<a class="result__snippet">s &amp; <i>t</i></a>') + block.format("https://y.org", " ", "") + block.format("https://z.org", "Z", "")
    rows = spark.createDataFrame([(1, page), (2, None), (3, "<p>")], "page_id int, html string")
    got = [(r.page_id, r.pos, r.title, r.url, r.snippet, r.publisher, r.trust_tier) for r in evidence.search_results(rows).orderBy("pos").collect()]
    assert got == [(1, 0, 'T & "u"', "https://www.x.org/1", "s & t", "x.org", 3), (1, 1, "Z", "https://z.org", "", "z.org", 3)]
    assert evidence.search_results(rows, max_results=2).count() == 1


def test_tables_of_a_document_are_numbered_through(spark):
    grid = "| a | b |\n|---|---|\n| 1 | 2 |"
    found = spark.createDataFrame([(7, 2, 0, grid, 1, 2, "r.pdf", [0.0, 1.0]), (7, 1, 0, grid, 1, 2, "r.pdf", None)], "doc_id long, page int, table_index int, markdown string, rows int, cols int, source string, bbox array<double>")
    first, second = chunks.numbered_table_chunks(found).orderBy("page").collect()
    assert first.text == f"[表格 1] 来源: r.pdf, 第 1 页\n{grid}" and first.section == "表格" and first.id == hashlib.md5(b"r.pdf_table_1_0").hexdigest()[:12] and first.char_count == len(first.text)
    assert (second.metadata.table_index, second.metadata.bbox, second.metadata.rows, second.metadata.cols) == (1, [0.0, 1.0], 1, 2)
    assert [r.sentence for r in chunks.sentences(spark.createDataFrame([(1, "\n\t a. b\n \n\n c"), (2, None)], "doc_id int, text string")).orderBy("pos").collect()] == ["a.", "b\n", "c"]


def test_index_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", "table", "s"), ("b", None, "text", "s"), ("c", "yy", None, "t")], "id string, text string, chunk_type string, source string")
    assert {(r.sink, r.n) for r in merge.write_index(rows, f"{tmp_path}/index").collect()} == {("table", 1), ("text", 2)}
    back = {r.id: (r.char_count, r.chunk_type) for r in spark.read.parquet(f"{tmp_path}/index").collect()}
    assert back == {"a": (1, "table"), "b": (None, "text"), "c": (2, None)}
    assert merge.index_stats(rows).first() == (2, 2, 1) and merge.index_stats(rows.limit(0)).first() == (0, 0, 0)


def test_metadata_as_a_store_takes_it(spark):
    row = spark.range(1).select(F.struct(F.lit(1).alias("n"), F.lit(None).cast("string").alias("none"), F.array(F.lit(1), F.lit(None)).alias("list"), F.to_date(F.lit("2026-01-02")).alias("day"), F.struct(F.lit(2).alias("z"), F.create_map(F.lit("k"), F.lit(1), F.lit("b"), F.lit(2)).alias("m"), F.lit(None).cast("int").alias("a")).alias("inner")).alias("meta"))
    got = registries.stored_metadata(row, "meta").first().meta
    assert (got.n, got.none, got.list, got.day, got.inner) == (1, None, ["1", "None"], str(datetime.date(2026, 1, 2)), '{"a":null,"m":{"b":2,"k":1},"z":2}')


def test_files_against_a_manifest(spark):
    body = {n: f"%PDF-{n}".encode() for n in "abc"}
    files = spark.createDataFrame([(f"/in/{n}.pdf", bytearray(b), len(b)) for n, b in body.items()], "path string, content binary, length long")
    manifest = spark.createDataFrame([("a.pdf", hashlib.sha256(body["a"]).hexdigest().upper()), ("b.pdf", "0" * 64)], "name string, sha256 string")
    ready = files.limit(0).select(F.lit("").alias("sha256"))
    assert {r.name for r in registries.accepted_files(files, ready, manifest=manifest).collect()} == {"a.pdf", "c.pdf"}
