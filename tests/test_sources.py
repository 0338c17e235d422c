"""Readers of registries and files, the hybrid search, rules that need no table, and one semantics at every size."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalars
from siltstone.operators import graph, merge, retrieval
from siltstone.sources import registries


SOURCE = {"source_title": "4Q report", "source_url": "https://a.example/q4", "source_publisher": "A", "source_published_at": "2026-01-15"}
REGISTRY = {
    "_meta": {"version": "1"},
    "companies": {
        "甲": {
            "name_en": "A", "ticker": "A.X", "year": 2025, "currency": "USD", "unit": "billion", **SOURCE,
            "revenue": {"value": 122.42, "yoy_growth_pct": 35.9, "note": "n"}, "gross_margin": {"value": 59.9, "trend": "t"}, "net_margin": {"value": 45.1, "trend": "t"},
            "capex": {"value": 40.9, "intensity_pct": 33.4, "trend": "t"}, "rd_expense": {"value": 8.5, "rd_ratio": 7.0},
            "capacity": {"monthly_wafer_12inch_equiv": 1, "utilization_rate": 96.0, "process_mix": {"3nm": "24%", "old": "~76%"}}, "evidence_scope": "s",
            "quarterly": {"2025 Q4": {**SOURCE, "source_url": "https://a.example/q", "metrics": {"revenue_usd_billion": 33.73, "gross_margin_pct": 62.3, "operating_margin_pct": 54.0, "usd_ntd_exchange_rate": 31.0, "other": 1, "operating_profit_usd_billion": None}}},
        },
        "乙": {"name_en": "B", "year": 2025, "currency": "USD", "revenue": {"value": 9.327}, "quarterly": {"2026 Q2": {"metrics": {"revenue_usd_billion": 2.2, "operating_profit_usd_billion": 0.3}}}},
    },
}


def test_registries(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(REGISTRY, ensure_ascii=False), encoding="utf-8")
    companies = registries.read_companies(spark, f"{tmp_path}/c.json")
    facts = registries.registry_facts(companies).collect()
    assert {(r.metric, r.value, r.unit, r.currency) for r in facts if (r.company, r.period) == ("A", "2025 Q4")} == {("revenue", "33.73", "billion", "USD"), ("gross_margin", "62.3", "percent", None), ("operating_margin", "54.0", "percent", None), ("usd_ntd_exchange_rate", "31.0", "NTD_per_USD", None)}
    assert {r.metric: (r.value, r.unit) for r in facts if (r.company, r.period) == ("A", "FY2025")} == {"revenue": ("122.42", "billion"), "revenue_yoy": ("35.9", "percent"), "gross_margin": ("59.9", "percent"), "net_margin": ("45.1", "percent"), "capex": ("40.9", "billion"), "capex_intensity": ("33.4", "percent"), "rd_intensity": ("7.0", "percent"), "capacity_utilization": ("96.0", "percent")}
    assert {(r.metric, r.period) for r in facts if r.company == "B"} == {("revenue", "FY2025"), ("revenue", "2026 Q2"), ("operating_profit", "2026 Q2")}
    assert all(r.trust_tier == 1 and r.source_id.startswith("src_") for r in facts) and len({r.source_id for r in facts if r.company == "A"}) == 2
    assert {(r.company, r.process, r.share) for r in registries.process_mix(companies).collect()} == {("甲", "3nm", "24%"), ("甲", "old", "~76%")}
    (tmp_path / "m.json").write_text('{"metrics": {"revenue": {"label": "Revenue"}}}')
    assert registries.read_metrics(spark, f"{tmp_path}/m.json").first().metric == "revenue"
    (tmp_path / "none.json").write_text('{"metrics": {}}')
    with pytest.raises(ValueError, match="no metrics"):
        registries.read_metrics(spark, f"{tmp_path}/none.json")


def test_cases(spark, tmp_path):
    case = {"id": "c1", "language": "zh", "query": "毛利率?", "expected": [{"source": "r.pdf", "page": 3}, {"contains": "x"}]}
    for k, text in enumerate((json.dumps({"dataset": "d", "cases": [case], "documents": []}), json.dumps([case]))):
        (tmp_path / f"{k}.json").write_text(text)
        cases = registries.read_cases(spark, f"{tmp_path}/{k}.json")
        assert [(r.case_id, r.language, r.query) for r in cases.collect()] == [("c1", "zh", "毛利率?")]
        assert [(r.case_id, r.expectation, r.page, r.contains) for r in registries.expectations(cases).orderBy("expectation").collect()] == [("c1", 0, 3, None), ("c1", 1, None, "x")]
    (tmp_path / "x.json").write_text("{}")
    with pytest.raises(ValueError, match="no cases"):
        registries.read_cases(spark, f"{tmp_path}/x.json")


def test_files_and_metadata(spark):
    rows = [("/a/b?c.pdf", bytearray(b"%PDF-1"), 6), ("/a/d.pdf", bytearray(b"%PDF-1"), 6), ("/a/e.txt", bytearray(b"%PDF-2"), 6), ("/a/f.pdf", bytearray(b"hello"), 5), ("/a/g.PDF", bytearray(b"%PDF-3"), 60 << 20)]
    files = spark.createDataFrame(rows, "path string, content binary, length long")
    got = registries.accepted_files(files, files.limit(0).select(F.lit("").alias("sha256"))).collect()
    assert [(r.name, r.length) for r in got] == [("b_c.pdf", 6)]
    flat = spark.range(1).select(registries.flat_metadata(F.struct(F.lit(1).alias("a"), F.array(F.lit("x")).alias("b"), F.lit(None).cast("string").alias("c"))).alias("m")).first().m
    assert flat == {"a": "1", "b": '["x"]'}


def test_metric_text(spark):
    show = lambda key, v: spark.range(1).select(scalars.metric_display(F.lit(key), F.lit(v)).alias("x")).first().x
    assert show("revenue_usd_billion", 123.456789) == "123.457 USD billion" and show("revenue_usd_billion", 40.2) == "40.2 USD billion" and show("revenue_usd_billion", 0.0) == "0 USD billion"
    assert show("gross_margin_pct", 56.25) == "56.3%" or show("gross_margin_pct", 56.25) == "56.2%"


def test_mentions_do_not_depend_on_the_block(spark):
    texts = spark.createDataFrame([(1, "the party (EUV)"), (2, None), (3, "Artful")], "query_id long, text string")
    aliases = spark.createDataFrame([("a", "art", 1), ("e", "(EUV)", 0), ("a", "party", 2), ("n", "", 0)], "name string, alias string, pos int")
    want = {(1, "a", 1), (1, "e", 0), (3, "a", 1)}
    for block in (1, 2, 10_000):
        assert {tuple(r) for r in graph.mentions(texts, aliases, block=block).collect()} == want


def test_hybrid_query(spark):
    chunks = spark.createDataFrame([(1, "alpha beta", "tsmc report", "text"), (2, "alpha gamma", "smic report", "text"), (3, "alpha table", "other", "table")], "id long, text string, source string, chunk_type string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "id long, vector array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])], "query_id long, vector array<double>")
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "alpha of SMIC"), (3, "  ")], "query_id long, query string")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.hybrid_query(queries, chunks, vectors, asked, 2).collect()}
    assert got[1, 1] == 1 and {k: v for k, v in got.items() if k[0] == 2} == {(2, 1): 2} and not any(q == 3 for q, _ in got)
    score = F.pandas_udf(lambda q, t: t.str.contains("table").astype(float), "double")
    best = retrieval.hybrid_query(queries, chunks, vectors, asked, 1, score).filter("query_id = 1")
    text, table = retrieval.split_kinds(best)
    assert text.count() == 0 and table.first().id == 3
    assert retrieval.hybrid_query(queries, chunks, vectors, asked, 0).count() == 0


def test_upserts_keep_metadata(spark):
    rows = spark.createDataFrame([("web", "u", "t1", "m1", 2, 1), ("web", "u", "t2", "m2", 3, 2)], "source_type string, url string, title string, metadata string, trust_tier int, retrieved_at int")
    old = merge.upsert_sources(rows.limit(0).withColumn("id", F.lit("")), rows.filter("retrieved_at = 1"))
    got = merge.upsert_sources(old, rows).collect()
    assert len(got) == 1 and (got[0].title, got[0].metadata, got[0].trust_tier) == ("t2", "m2", 2)


def test_upserts_keep_what_changes_do_not_hold(spark):
    old = spark.createDataFrame([("web", "u", "t1", "m1", "pub", "h", 2, 1, 1)], "source_type string, url string, title string, metadata string, publisher string, content_hash string, trust_tier int, created_at int, retrieved_at int")
    old = merge.upsert_sources(old.limit(0), old)
    got = merge.upsert_sources(old, spark.createDataFrame([("web", "u", "t2", 3, 2)], "source_type string, url string, title string, trust_tier int, retrieved_at int")).first()
    assert (got.title, got.metadata, got.publisher, got.content_hash, got.trust_tier, got.created_at) == ("t2", "m1", "pub", "h", 2, 1)
    chunk = spark.createDataFrame([(1, "h", "id1", "text", 5, "sec", 1)], "document_id long, content_hash string, id string, text string, page int, section string, created_at int")
    got = merge.upsert_chunks(chunk, spark.createDataFrame([(1, "h", 6, 2), (2, "h", 7, 2)], "document_id long, content_hash string, page int, created_at int")).orderBy("document_id").collect()
    assert [(r.id, r.text, r.page, r.section) for r in got] == [("id1", "text", 6, "sec"), (None, None, 7, None)]
    fact = spark.createDataFrame([("c", "m", "p", "s", "1", "u", "q", 0.5, 1)], "company string, metric string, period string, source_id string, value string, unit string, quote string, confidence double, updated_at int")
    got = merge.upsert_facts(fact.drop("quote"), fact.withColumn("updated_at", F.lit(2))).first()
    assert (got.quote, got.confidence, got.updated_at) == ("q", 0.5, 2)
