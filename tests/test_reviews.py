"""Citations, reranking, order by evidence and requested quarters on small cases with known results."""

import pytest
from pyspark.sql import functions as F

from siltstone.operators import evaluation, evidence, graph, retrieval


def test_citation_quality(spark):
    answer = "A is so[1]. B is wrong[2]. C has no mark."
    answers = spark.createDataFrame([("m", answer, 2)], "case_id string, answer string, available int")
    claims = spark.createDataFrame([("m", 0, "A is so[1]", [1], None), ("m", 1, "B is wrong[2]", [1], True), ("m", 2, "C has no mark", [2], True), ("m", 3, "not there[1]", [1], False)], "case_id string, claim int, text string, supported_by array<int>, required boolean")
    got = evaluation.citation_quality(answers, claims).first()
    assert (got.citation_precision, got.marker_validity) == (0.5, 1.0) and got.claim_coverage == pytest.approx(1 / 3)
    gates = {r.metric: r.passed for r in evaluation.gates(evaluation.citation_quality(answers, claims), {"citation_precision": 0.95, "marker_validity": 1.0}).collect()}
    assert gates == {"citation_precision": False, "marker_validity": True}
    broken = evaluation.citation_integrity(spark.createDataFrame([("x", "right[1], broken[3].", 1)], "case_id string, answer string, available int")).first()
    assert broken.validity == 0.5 and broken.invalid == [3]


def test_rerank_and_order_by_evidence(spark):
    hits = spark.createDataFrame([(1, "a", "q", "first", 1), (1, "b", "q", "best", 2), (1, "c", "q", "third", 3)], "query_id int, id string, query string, text string, rank int")
    scores = F.pandas_udf(lambda q, t: t.map({"first": 0.1, "best": 0.9, "third": 0.4}), "double")
    assert [(r.id, r["rank"]) for r in retrieval.rerank(hits, scores, 2).orderBy("rank").collect()] == [("b", 1), ("c", 2)]
    assert [r.id for r in retrieval.rerank(hits, None, 1).collect()] == ["a"]
    rows = spark.createDataFrame([(1, "other", "What was the gross margin?", "It did well that year.", 1), (1, "answer", "What was the gross margin?", "Gross margin rose to 21%.", 2)], "query_id int, id string, query string, text string, rank int")
    assert [r.id for r in retrieval.by_coverage(rows).orderBy("rank").collect()] == ["answer", "other"]


def test_scope_to_named_companies(spark):
    hits = spark.createDataFrame([(1, "TSMC-2025-report.pdf"), (1, "SMIC-2025-report.pdf"), (2, "TSMC-2025-report.pdf")], "query_id int, origin string")
    asked = spark.createDataFrame([(1, "中芯国际毛利率"), (2, "no company")], "query_id int, query string")
    assert {(r.query_id, r.origin[:4]) for r in retrieval.scope_to_named(hits, asked).collect()} == {(1, "SMIC"), (2, "TSMC")}


def test_requested_quarter_with_a_null_value_is_found(spark):
    facts = spark.createDataFrame([("A", "2025 Q1", None), ("A", "2025 Q2", 1.0)], "company string, period string, value double")
    asked = spark.createDataFrame([("A", "2025 Q1"), ("A", "2025 Q2"), ("A", "2025 Q3")], "company string, period string")
    assert {r.period: r.status for r in evidence.requested_quarters(asked, facts).collect()} == {"2025 Q1": "found", "2025 Q2": "found", "2025 Q3": "missing"}


def test_graph_counts(spark):
    nodes = spark.createDataFrame([("1", "term"), ("2", "term"), ("3", "company")], "node_id string, type string")
    edges = graph.build_edges(spark.createDataFrame([("1", "3", "made_by", 0)], "source string, target string, type string, pos int"), {"made_by": "makes"})
    collisions = spark.createDataFrame([("x", 2)], "alias_key string, claims int")
    assert {tuple(r) for r in graph.graph_counts(nodes, edges, collisions).collect()} == {("node", "term", 2), ("node", "company", 1), ("edge", "made_by", 1), ("inverse", "makes", 1), ("collision", "alias", 1)}
