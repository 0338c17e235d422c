"""Golden values of the scalar functions, ratios, policy and evaluation jobs."""

from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import finance, scalars
from siltstone.operators import chunks, evaluation, evidence, graph, merge, retrieval
from siltstone.plans import catalog
from siltstone.streaming import jobs


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text, period",
    [("2025Q3", "2025 Q3"), ("2025年 Q3", "2025 Q3"), ("Q3 2025", "2025 Q3"), ("3Q-2025", "2025 Q3"), ("2025年第三季度", "2025 Q3"), ("2025", "FY2025"), ("fy2025", "FY2025"), ("soon", "SOON")],
)
def test_periods(spark, text, period):
    assert one(spark, scalars.normalize_period("t"), t=text) == period


def test_periods_in_query(spark):
    have = F.array(*[F.lit(f"{y} Q{q}") for y in (2024, 2025) for q in range(1, 5)])
    assert one(spark, scalars.periods_in(F.lit("2025 Q3 和 2025年第四季度"), have)) == ["2025 Q3", "2025 Q4"]
    assert len(one(spark, scalars.periods_in(F.lit("2024年和2025年各季度"), have))) == 8
    assert one(spark, scalars.periods_in(F.lit("2026 Q3"), have)) == []


def test_links(spark):
    tiers = {"https://www.tsmc.com/x": 1, "https://pr.tsmc.com": 1, "https://reuters.com/a": 2, "https://tsmc.com.attacker.example/": 3, "nonsense": 3}
    for url, tier in tiers.items():
        assert one(spark, scalars.trust_tier("u"), u=url) == tier
    assert one(spark, scalars.hostname("u"), u="https://WWW.TSMC.com/x") == "tsmc.com"
    assert one(spark, scalars.safe_url("u"), u="javascript:alert(1)") == ""
    assert one(spark, scalars.preferred_domains(F.lit("smic annual report"))) == ["smic.com", "hkexnews.hk"]


@pytest.mark.parametrize("text, day", [("2025-03-11T23:30:00Z", "2025-03-11"), ("Tue, 11 Mar 2025 08:00:00 GMT", "2025-03-11"), ("on 2025/3/11.", "2025-03-11"), ("2025-13-40", None), ("soon", None)])
def test_source_dates(spark, text, day):
    got = one(spark, scalars.source_date("t"), t=text)
    assert (str(got) if got else None) == day


def test_values(spark):
    assert one(spark, scalars.canonical_value("v"), v=" 33.10 ") == one(spark, scalars.canonical_value("v"), v="33.1") == "33.1"
    assert one(spark, scalars.canonical_value("v"), v="N/A") == "n/a"
    cost = scalars.usage_cost(F.lit(1000000), F.lit(2000000), F.lit(500000), F.lit(".10"), F.lit(".40"), F.lit("1.00"))
    assert one(spark, cost) == Decimal("1.40000000")
    assert one(spark, scalars.usage_cost(F.lit(1), F.lit(1), F.lit(1), F.lit("x"), F.lit("1"), F.lit("1"))) is None
    assert one(spark, scalars.lexical_tokens(F.lit("台积电 N3E 33.7%"))) == ["n3e", "33.7", "台积电", "台积", "积电", "台积电"]
    assert one(spark, scalars.percent_value(F.lit("~18%"))) == 18.0


def test_calculations(spark):
    cases = [("yoy_growth", {"current": 120.0, "previous": 100.0}, 20.0), ("qoq_growth", {"current": 33.73, "previous": 33.1}, 1.9), ("gross_margin", {"revenue": 100.0, "cost": 43.8}, 56.2), ("pe_ratio", {"price": 120.0, "eps": 6.0}, 20.0), ("difference", {"left": 62.3, "right": 59.5}, 2.8), ("ratio", {"numerator": 25.0, "denominator": 100.0}, 0.25), ("roe", {"net_income": 1.0, "equity": 0.0}, None)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases] + [("what", {"a": 1.0}), ("roa", {"assets": 1.0})], "operation string, operands map<string,double>")
    out = finance.calculate(rows).collect()
    for (_, _, want), row in zip(cases, out, strict=False):
        assert row.error is None and (None if row.shown is None else float(row.shown)) == want
    assert "unknown" in out[-2].error and "net_income" in out[-1].error


def test_conflicts(spark):
    rows = [("c", "m", "p", v, "pct", None, s) for v, s in (("33.10", "a"), ("33.1", "b"))]
    schema = "company string, metric string, period string, value string, unit string, currency string, source_id string"
    assert evidence.fact_conflicts(spark.createDataFrame(rows, schema)).count() == 0
    assert evidence.fact_conflicts(spark.createDataFrame([*rows, ("c", "m", "p", "34.0", "pct", None, "n")], schema)).count() == 3


def test_upsert_twice_changes_nothing(spark):
    rows = spark.createDataFrame([("k", "new", None, 3, 2), ("k", "old", "x", 2, 1)], "id string, title string, publisher string, tier int, at int")
    policy = {"title": merge.NEWEST, "publisher": merge.KNOWN, "tier": merge.LEAST}
    once = merge.upsert(rows.limit(0), rows, ["id"], policy, "at")
    assert once.collect() == merge.upsert(once, rows, ["id"], policy, "at").collect()
    assert once.first().asDict() == {"id": "k", "title": "new", "publisher": "x", "tier": 2, "at": 2}


def test_evaluation(spark):
    answers = spark.createDataFrame([(1, "a [1] b [3]", 1), (2, "none", 0)], "case_id int, answer string, available int")
    got = {r.case_id: r for r in evaluation.citation_integrity(answers).collect()}
    assert (got[1].validity, got[1].invalid, got[2].validity) == (0.5, [3], 1.0)
    results = spark.createDataFrame([(1, 1, "x", "s", 1, "t"), (1, 2, "y", "s", 2, "Hit  here")], "case_id int, rank int, id string, source string, page int, text string")
    wants = spark.createDataFrame([(1, 0, None, None, None, "hit here"), (1, 1, "z", None, None, None)], "case_id int, expectation int, id string, source string, page int, contains string")
    row = evaluation.retrieval_scores(results, wants).first()
    assert (row.recall, row.reciprocal_rank) == (0.5, 0.5)


def test_ranking(spark):
    r = "query_id int, id string, rank int"
    a = spark.createDataFrame([(1, "shared", 1), (1, "first", 2)], r)
    b = spark.createDataFrame([(1, "second", 1), (1, "shared", 2)], r)
    assert {x.id for x in retrieval.merge_rankings(a, b, 10).collect()} == {"shared", "first", "second"}
    docs = spark.createDataFrame([(7, "先进制程 收入"), (8, "台积电 第四季度 毛利率 62%")], "id long, text string")
    top = retrieval.bm25(spark.createDataFrame([(1, "台积电毛利率")], "query_id int, query string"), docs, 5).collect()
    assert top[0].id == 8 and top[0].score > 0


def test_dense_takes_queries_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    v = np.random.default_rng(0).normal(size=(40, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<double>")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in retrieval.dense(rows.filter("id < 7").withColumnRenamed("id", "query_id"), rows, 5).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(unit[:7] @ unit.T, 4)
    best = np.lexsort((np.broadcast_to(np.arange(40), s.shape), -s), axis=1)[:, :5]
    assert got == {(q, k + 1): (i, s[q, i]) for q in range(7) for k, i in enumerate(best[q].tolist())}


def test_registered_searches_ask_all_their_queries(spark, tmp_path):
    v = np.random.default_rng(1).normal(size=(2201, 4))
    spark.createDataFrame([(i, x.tolist(), i % 10) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"term{i}") for i in range(30)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"term{i}") for i in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.query_id for r in catalog.r3_dense_topk(spark, str(tmp_path)).collect()} == set(range(0, 2201, 100))
    fused = {(r.query_id, r.id) for r in catalog.r6_fusion(spark, str(tmp_path)).collect()}
    assert {(i, i) for i in range(30)} <= fused and all((q, 100 * q) in fused for q in range(23))


def test_chunks(spark):
    text = "One sentence here. " * 60
    parts = chunks.pack(text)
    assert all(len(p) <= 600 for p in parts) and len(parts) > 1
    pages = spark.createDataFrame([(1, 1, "# Revenue\nUp."), (1, 2, "# Margin\nFlat.\n\n| a | b |\n| --- | --- |\n| 1 | 2 |")], "doc_id long, page int, text string")
    got = chunks.chunk_documents(pages).collect()
    assert {r.page for r in got} == {1, 2} and {r.chunk_type for r in got} == {"text", "table"}
    assert sorted(r.id for r in got) == sorted(r.id for r in chunks.chunk_documents(pages).collect())


def test_limiter(spark):
    rows = spark.createDataFrame([("k", i, float(t)) for i, t in enumerate((100, 101, 102, 161))], "key string, seq long, ts double")
    assert [r.allowed for r in jobs.limit_batch(rows, 2, 60.0).orderBy("seq").collect()] == [True, True, False, True]


def test_limiter_carries_stamps_over_batches(spark):
    rows = [(k, i, float((i * 7) % 40)) for k in ("a", "b", "c", None) for i in range(40)]
    want = set()
    for k in ("a", "b", "c", None):
        kept: list[float] = []
        for _, seq, ts in sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])):
            kept, ok, wait = jobs._allow(kept, ts, 3, 10.0)
            want.add((k, seq, ok, wait))
    events = spark.createDataFrame(rows, "key string, seq long, ts double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = jobs.limit_batch(events, 3, 10.0)
        assert {(r.key, r.seq, r.allowed, r.retry_after) for r in out.collect()} == want
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()  # no group is one table
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_graph(spark):
    terms = spark.createDataFrame([("EUV (光刻)", "Extreme / Soft", ["CoWoS", "Unknown"], ["ASML"], 0), ("CoWoS", None, ["EUV", "CoWoS"], ["asml"], 1)], "name string, english string, related array<string>, companies array<string>, pos int")
    firms = spark.createDataFrame([("ASML", "asml", 0)], "name string, alias string, pos int")
    nodes, index, edges = graph.build_graph(terms, firms)
    audit = graph.graph_audit(nodes, edges, {"related_to": "related_to", "made_by": "makes"}).first()
    assert audit.passed and audit.nodes == 4


def test_bm25_against_brute_force(spark, monkeypatch):
    """Every block and step size gives the ranking of a plain loop; ids may be texts, and ties go to the lower one."""
    import math
    import random
    import re
    from collections import Counter

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    draw = lambda n: " ".join(rnd.choices(words, [1 / (i + 1) for i in range(40)], k=n))
    docs = [(f"d{i:03}", draw(rnd.randint(0, 30))) for i in range(120)] + [("d900", None), ("d901", "")]
    docs += [(f"e{i:03}", docs[i][1]) for i in range(20)]  # copies: ties
    asked = [(i, draw(rnd.randint(1, 8))) for i in range(15)] + [(50, None), (51, "unheard")]
    tokens = {i: re.findall(r"[a-z0-9]+", t or "") for i, t in docs}
    avg = max(1.0, sum(map(len, tokens.values())) / len(docs))
    expected = []
    for q, text in asked:
        scores = []
        for i, own in tokens.items():
            tf, s = Counter(own), 0.0
            for term in set((text or "").split()) & tf.keys():
                df = sum(term in t for t in tokens.values())
                s += math.log1p((len(docs) - df + 0.5) / (df + 0.5)) * tf[term] * 2.5 / (tf[term] + 1.5 * (0.25 + 0.75 * len(own) / avg))
            if s:
                scores.append((-round(s, 9), i))
        expected += [(q, i, n + 1) for n, (_, i) in enumerate(sorted(scores)[:7])]
    chunks, queries = spark.createDataFrame(docs, "id string, text string"), spark.createDataFrame(asked, "query_id int, query string")
    for terms, cells in ((500_000, 1 << 21), (10, 30)):
        monkeypatch.setattr(retrieval, "TERM_BLOCK", terms)
        monkeypatch.setattr(retrieval, "SCORES", cells)
        rows = retrieval.bm25(queries, chunks, 7).orderBy("query_id", "rank").collect()
        assert [(r["query_id"], r["id"], r["rank"]) for r in rows] == expected
    assert retrieval.bm25(queries, chunks.limit(0), 7).count() == 0
    assert retrieval.bm25(queries.limit(0), chunks, 7).count() == 0
    assert retrieval.bm25(queries, chunks, 0).count() == 0
