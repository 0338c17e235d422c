"""A training corpus from `documents`, in five stages; each works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, line_dedup, near_duplicates, sentencepieces, toxicity
from siltstone.llm.common import stored
from siltstone.llm.dataset_files import tokenizer_path

#: Similarity in per cent from which documents are near duplicates here.
SIMILAR = 80


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the lexicon model rejects; it learns from the labelled rows as op2 does."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, toxicity.training_labels(spark, sf_dir)))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document has; documents that consisted of nothing else go, n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    nothing_left = (F.col("n_removed") > 0) & (F.trim("text") == "")
    return out.filter(~nothing_left).withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id."""
    return near_duplicates.one_of_each(docs, SIMILAR)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that contain an item of the benchmark."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to it."""
    return sentencepieces.round_trips(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxic), ("line dedup", lines), ("near duplicates", near_copies), ("decontamination", leaks), ("sentencepieces", pieces)]

#: No SQL can replay the learned lexicon or the alignment; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
