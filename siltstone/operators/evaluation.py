"""Scores of retrieval and of inline citations against golden cases; citation numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import words as W


def _flat(c):
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def retrieval_hits(results: DataFrame, expectations: DataFrame) -> DataFrame:
    """case_id, expectation, best_rank: results (case_id, rank, id, source, page, text) against expectations (case_id, expectation, id, source, page, contains).

    Every criterion given must hold; an expectation without any never matches.
    """
    want = expectations.select("case_id", "expectation", *[F.col(c).alias(f"w_{c}") for c in ("id", "source", "page", "contains")])
    rows = results.join(want, "case_id")
    some = F.coalesce("w_id", "w_source", F.col("w_page").cast("string"), "w_contains").isNotNull()
    holds = some & (F.col("w_id").isNull() | (F.col("id") == F.col("w_id"))) & (F.col("w_source").isNull() | (F.col("source") == F.col("w_source")))
    holds = holds & (F.col("w_page").isNull() | (F.col("page") == F.col("w_page"))) & (F.col("w_contains").isNull() | F.contains(_flat(F.col("text")), _flat(F.col("w_contains"))))
    return rows.filter(holds).groupBy("case_id", "expectation").agg(F.min("rank").alias("best_rank"))


def retrieval_scores(results: DataFrame, expectations: DataFrame) -> DataFrame:
    """Per case: expected, matched, recall, reciprocal_rank (best rank over all expectations; 0 for none)."""
    hits = retrieval_hits(results, expectations)
    cases = expectations.select("case_id", "expectation").join(hits, ["case_id", "expectation"], "left").groupBy("case_id").agg(F.count("*").alias("expected"), F.count("best_rank").alias("matched"), F.min("best_rank").alias("best"))
    return cases.select("case_id", "expected", "matched", (F.col("matched") / F.col("expected")).alias("recall"), F.coalesce(1.0 / F.col("best"), F.lit(0.0)).alias("reciprocal_rank"))


def retrieval_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("cases"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall"), F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)).alias("mrr"))


def markers(answers: DataFrame, text: str = "answer") -> DataFrame:
    """Inline [n] marks of an answer as rows: pos, n."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\[(\d+)\]"), F.lit(1))
    return answers.select("*", F.posexplode(found).alias("pos", "mark")).withColumn("n", F.col("mark").try_cast("int")).drop("mark")


def citation_integrity(answers: DataFrame) -> DataFrame:
    """Per answer (case_id, answer, available): markers, valid ones, invalid list, validity (1 where there are none), distinct cited."""
    rows = markers(answers.select("case_id", "answer", "available"))
    good = (F.col("n") >= 1) & (F.col("n") <= F.col("available"))
    per = rows.groupBy("case_id").agg(F.count("*").alias("markers"), F.count_if(good).alias("valid"), F.sort_array(F.collect_set(F.when(~good, F.col("n")))).alias("invalid"), F.countDistinct(F.when(good, F.col("n"))).alias("cited"))
    out = answers.select("case_id", "available").join(per, "case_id", "left").fillna(0, ["markers", "valid", "cited"])
    return out.withColumns({"invalid": F.coalesce("invalid", F.array().cast("array<int>")), "validity": F.when(F.col("markers") > 0, F.col("valid") / F.col("markers")).otherwise(1.0)})


def citation_quality(answers: DataFrame, claims: DataFrame) -> DataFrame:
    """One row: citation_precision (over all markers), claim_coverage (over required claims), marker_validity.

    answers: case_id, answer, available.  claims: case_id, claim (place), text, supported_by, required (null is true).
    """
    rows = claims.join(answers.select("case_id", "answer"), "case_id").withColumn("present", F.contains("answer", F.col("text")))
    marks = F.when(F.col("present"), F.transform(F.regexp_extract_all("text", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("ok", F.size(F.filter(marks, lambda m: F.array_contains("supported_by", m))))
    rows = rows.withColumn("required", F.coalesce("required", F.lit(True)))
    per = rows.groupBy("case_id").agg(F.sum("ok").alias("ok"), F.count_if("required").alias("required"), F.count_if(F.col("required") & (F.col("ok") > 0)).alias("covered"))
    all_ = citation_integrity(answers).join(per, "case_id", "left").fillna(0, ["ok", "required", "covered"])
    share = lambda a, b: F.coalesce(F.try_divide(F.sum(a), F.sum(b)), F.lit(0.0))
    return all_.agg(share(F.least("ok", "markers"), "markers").alias("citation_precision"), share("covered", "required").alias("claim_coverage"), share("valid", "markers").alias("marker_validity"))


def gates(scores: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """metric, value, threshold, passed, and all_passed, from a one-row frame of scores."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(float(t)).alias("threshold")) for m, t in thresholds.items()])
    rows = scores.select(F.inline(pairs)).withColumn("passed", F.col("value") >= F.col("threshold"))
    return rows.withColumn("all_passed", F.min("passed").over(Window.partitionBy(F.lit(1))))


def number_citations(citations: DataFrame, key: str = "answer_id") -> DataFrame:
    """First of equal citations kept and numbered from 1 in order of arrival (pos).

    Equal: same type, source and page; for financial ones also same period and title.
    """
    same = [key, "source_type", "source", F.coalesce("page", F.lit(0)), *[F.when(F.col("source_type") == "financial", F.coalesce(F.col(c), F.lit(""))).otherwise("") for c in ("period", "title")]]
    once = citations.withColumn("__n", F.row_number().over(Window.partitionBy(*same).orderBy("pos"))).filter("__n = 1").drop("__n")
    return once.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("pos")))


def budget_plans(plans: DataFrame, limits: dict[str, int] = W.TOOL_LIMITS, most: int = W.MAX_TOOLS) -> DataFrame:
    """Planned calls (plan_id, pos, tool, args as JSON with sorted keys) that stay: known tools, each call once, within the limits.

    The first calls stay; the sequential rule equals three row numbers one after another.
    """
    allowed = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    rows = plans.withColumn("limit", allowed[F.col("tool")]).filter("limit is not null and args is not null")

    def first(rows: DataFrame, keys: list[str], limit) -> DataFrame:
        return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))).filter(F.col("nth") <= limit).drop("nth")

    rows = first(first(first(rows, ["plan_id", "tool", "args"], F.lit(1)), ["plan_id", "tool"], F.col("limit")), ["plan_id"], F.lit(most))
    return rows.drop("limit")
