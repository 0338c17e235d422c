"""Idempotent upserts: one union and one aggregation per key, with a policy for each column.

newest: value of the latest row.  known: latest value that isn't null.  least, first: smallest value, value of the earliest row.
A second run over the same rows changes nothing.  Each policy has map-side partial sums, so a key with many rows is no hot spot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scalars import stable_id

NEWEST, KNOWN, LEAST, FIRST = "newest", "known", "least", "first"


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str], policy: dict[str, str], at: str, seq: str | None = None) -> DataFrame:
    """stored and changes hold keys, `at` (time of the row) and columns of the policy; seq breaks ties within a time.

    A column that only one side has is kept: the other side's rows don't know it, and under NEWEST a row that lacks the column leaves
    what is stored.  Columns that neither side has are left out.
    """
    both = {*stored.columns, *changes.columns}
    lacking = {c for c in policy if c not in changes.columns}
    policy = {c: (KNOWN if p == NEWEST and c in lacking else p) for c, p in policy.items() if c in both}
    order = F.struct(*[F.col("__side"), F.col(at), *([F.col(seq)] if seq else [])])
    rows = stored.withColumn("__side", F.lit(0)).unionByName(changes.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    rule = {
        NEWEST: lambda c: F.max_by(c, order),
        KNOWN: lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), order)),
        LEAST: lambda c: F.min(c),
        FIRST: lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)) if c in lacking or c not in stored.columns else F.min_by(c, order),
    }
    return rows.groupBy(*keys).agg(*[rule[p](c).alias(c) for c, p in policy.items()], F.max(at).alias(at))


def upsert_sources(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """Sources by kind and url (title where there is none): newest title and metadata, known publisher and day, least tier."""
    changes = changes.withColumn("id", stable_id("src", "source_type", F.coalesce(F.nullif(F.col("url"), F.lit("")), F.col("title"))))
    policy = {"source_type": FIRST, "url": FIRST, "title": NEWEST, "metadata": NEWEST, "publisher": KNOWN, "published_at": KNOWN, "content_hash": KNOWN, "trust_tier": LEAST, "created_at": FIRST}
    return upsert(stored, changes, ["id"], policy, "retrieved_at")


def upsert_documents(stored: DataFrame, changes: DataFrame) -> DataFrame:
    policy = {"id": FIRST, "name": NEWEST, "page_count": NEWEST, "status": NEWEST, "error": NEWEST, "report_period": KNOWN, "created_at": FIRST}
    return upsert(stored, changes, ["sha256"], policy, "updated_at")


def upsert_chunks(stored: DataFrame, changes: DataFrame) -> DataFrame:
    policy = {"id": FIRST, "text": FIRST, "page": NEWEST, "section": NEWEST, "chunk_type": NEWEST, "metadata": NEWEST}
    return upsert(stored, changes, ["document_id", "content_hash"], policy, "created_at")


FACT_KEY = ["company", "metric", "period", "source_id", "value", "unit"]


def upsert_facts(stored: DataFrame, changes: DataFrame) -> DataFrame:
    policy = {"confidence": NEWEST, "metadata": NEWEST, "document_id": KNOWN, "currency": KNOWN, "page": KNOWN, "quote": KNOWN}
    return upsert(stored, changes, FACT_KEY, policy, "updated_at")


def first_snapshots(stored: DataFrame, results: DataFrame) -> DataFrame:
    """New snapshots only: the earliest row of each (url, hash of the snippet) that isn't stored; rows without a url are left out."""
    rows = results.filter(F.coalesce("url", F.lit("")) != "").withColumn("content_hash", F.sha2(F.coalesce("snippet", F.lit("")), 256))
    payload = [c for c in rows.columns if c not in ("url", "content_hash")]
    firsts = rows.groupBy("url", "content_hash").agg(F.min(F.struct("retrieved_at", *[c for c in payload if c != "retrieved_at"])).alias("r")).select("url", "content_hash", "r.*")
    return firsts.join(stored.select("url", "content_hash"), ["url", "content_hash"], "left_anti")


def cached(cache: DataFrame, keys: DataFrame, now) -> DataFrame:
    """Cache rows of the keys asked for that haven't run out: strictly later than now."""
    return cache.join(keys.select("cache_key").distinct(), "cache_key", "left_semi").filter(F.col("expires_at") > now)


def watchlist(changes: DataFrame) -> DataFrame:
    """Keys watched after all changes (key, watched, seq), with the place of the first add since the last removal."""
    key = F.substring(F.trim(F.regexp_replace("key", r"\s+", " ")), 1, 80)
    rows = changes.withColumn("key", key).filter("key <> ''")
    removed = rows.filter("not watched").groupBy("key").agg(F.max("seq").alias("gone"))
    live = rows.filter("watched").join(removed, "key", "left").filter(F.col("gone").isNull() | (F.col("seq") > F.col("gone")))
    return live.groupBy("key").agg(F.min("seq").alias("seq"))


def new_index_rows(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """Rows to add to the index: the first of repeated ids (by pos), without ids that it has."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return chunks.withColumn("__n", nth).filter("__n = 1").drop("__n").join(indexed.select("id"), "id", "left_anti")


def write_index(rows: DataFrame, path: str) -> DataFrame:
    """Writes index rows (id, text, chunk_type, ...) below path, tables and texts each into a folder of their own, and counts them: sink, n.

    Whatever isn't a table goes with the texts.  The counts are those of the written rows.
    """
    sink = F.when(F.col("chunk_type") == "table", "table").otherwise("text")
    rows.withColumns({"sink": sink, "char_count": F.length("text")}).write.partitionBy("sink").parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy("sink").agg(F.count("*").alias("n"))


def index_stats(rows: DataFrame) -> DataFrame:
    """One row: doc_count (distinct sources), text_chunks, table_chunks of an index (source, chunk_type)."""
    table = F.coalesce(F.col("chunk_type") == "table", F.lit(False))
    return rows.agg(F.countDistinct("source").alias("doc_count"), F.count_if(~table).alias("text_chunks"), F.count_if(table).alias("table_chunks"))
