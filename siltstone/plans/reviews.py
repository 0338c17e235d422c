"""Registered queries on what reviews a result: citations, order after a scorer, the graph by types."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import evaluation, graph, retrieval
from siltstone.plans.catalog import query, table


@query("""WITH o AS (SELECT o_orderkey % 3 AS r FROM orders)
SELECT round(CAST(sum(CASE WHEN r = 1 THEN 2 ELSE 1 END) AS DOUBLE) / (2 * count(*)), 9) AS citation_precision, round(CAST(count(*) FILTER (r = 1) + count(*) FILTER (r <> 2) AS DOUBLE) / (count(*) + count(*) FILTER (r <> 2)), 9) AS claim_coverage,
round(CAST(sum(CASE WHEN r < 2 THEN 2 ELSE 1 END) AS DOUBLE) / (2 * count(*)), 9) AS marker_validity FROM o""")
def a12_citation_quality(spark, d):
    """Each order an answer of two marks and two sources; the second mark is right, wrong or out of range, the first claim isn't always required."""
    r = F.col("o_orderkey") % 3
    second = F.concat(F.lit("Status["), (r + 1).cast("string"), F.lit("]"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("Total[1]. "), second, F.lit(".")).alias("answer"), F.lit(2).alias("available"), second.alias("second"), r.alias("r"))
    first = rows.select("case_id", F.lit(0).alias("claim"), F.lit("Total[1]").alias("text"), F.array(F.lit(1)).alias("supported_by"), (F.col("r") != 2).alias("required"))
    other = rows.select("case_id", F.lit(1).alias("claim"), F.col("second").alias("text"), F.array(F.lit(2)).alias("supported_by"), F.lit(None).cast("boolean").alias("required"))
    out = evaluation.citation_quality(rows.select("case_id", "answer", "available"), first.unionByName(other))
    return out.select(*[F.round(c, 9).alias(c) for c in ("citation_precision", "claim_coverage", "marker_validity")])


@query("""WITH h AS (SELECT o_custkey AS query_id, o_orderkey AS id, o_orderpriority AS text, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders)
SELECT query_id, id, CAST(length(text) AS DOUBLE) AS rerank_score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY length(text) DESC, rank) AS r FROM h) x WHERE r <= 3""")
def r8_reranked(spark, d):
    """The three hits of each customer that a scorer likes best; of equal ones the former order stays."""
    hits = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text"), F.lit("any").alias("query"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id")))

    @F.pandas_udf("double")
    def long(asked: pd.Series, text: pd.Series) -> pd.Series:
        return text.str.len().astype(float)

    return retrieval.rerank(hits, long, 3).select("query_id", "id", "rerank_score", "rank")


@query("""SELECT 'node' AS kind, p_brand AS type, count(*) AS n FROM part GROUP BY p_brand UNION ALL SELECT 'edge', 'made_of', count(DISTINCT (p_partkey, p_size)) FROM part WHERE p_size <> p_partkey UNION ALL SELECT 'inverse', 'makes', count(DISTINCT (p_partkey, p_size)) FROM part WHERE p_size <> p_partkey
UNION ALL SELECT 'collision', 'alias', count(*) FROM (SELECT 1 FROM part WHERE trim(p_name) <> '' GROUP BY lower(trim(p_name)) HAVING count(DISTINCT p_partkey) > 1) x HAVING count(*) > 0""")
def a16_graph_counts(spark, d):
    part = table(spark, d, "part")
    _, collisions = graph.alias_index(part.select(F.col("p_partkey").alias("node_id"), F.col("p_name").alias("alias"), F.col("p_partkey").alias("pos")))
    edges = graph.build_edges(part.select(F.col("p_partkey").cast("string").alias("source"), F.col("p_size").cast("string").alias("target"), F.lit("made_of").alias("type"), F.col("p_partkey").alias("pos")), {"made_of": "makes"})
    return graph.graph_counts(part.select(F.col("p_brand").alias("type")), edges, collisions)
