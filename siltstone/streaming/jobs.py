"""Structured Streaming jobs over event tables, each with its batch twin."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.functions.scalars import keyed_hash
from siltstone.operators import evidence, merge
from siltstone.operators.chunks import chunk_documents
from siltstone.sources.ledger import Ledger


def windowed_metrics(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and event type (ts, event_type, value), for a stream or a table alike; late rows are dropped by the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total", "errors")


def _allow(kept: list[float], now: float, limit: int, window: float) -> tuple[list[float], bool, int]:
    kept = [t for t in kept if t > now - window]
    if len(kept) >= limit:
        return kept, False, max(1, int(window - (now - kept[0])))
    return [*kept, now], True, 0


#: Ratio between the bounds of neighbouring ranges of values: a percentile is known to within it.
GROWTH = 1.01


def windowed_p95(events: DataFrame, length: str = "24 hours", slide: str | None = "1 hour", late: str = "10 minutes", share: float = 0.95) -> DataFrame:
    """start, end, event_type, n, p95 of the positive values (ts, event_type, value) in sliding windows, for a stream or a table alike.

    The state of a window is a histogram: counts in ranges whose bounds grow by GROWTH, which sum up in any order.  p95 is the upper
    bound of the range that holds the nearest rank: the exact value or up to GROWTH times that.
    """
    rows = events.filter("value > 0")
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    counts = rows.groupBy(window.alias("w"), "event_type", F.ceil(F.log(F.col("value")) / F.log(F.lit(GROWTH)) - 1e-9).alias("range")).agg(F.count("*").alias("k"))
    # some thousands of ranges at most hold all doubles of a window
    held = counts.groupBy("w", "event_type").agg(F.sum("k").alias("n"), F.sort_array(F.collect_list(F.struct("range", "k"))).alias("h"))
    rank = F.expr(f"greatest(1, (n * {round(share * 1_000_000)} + 999999) div 1000000)")
    found = F.aggregate("h", F.struct(F.lit(0).cast("long").alias("upto"), F.lit(None).cast("long").alias("range")), lambda s, x: F.struct((s.upto + x.k).alias("upto"), F.when(s.upto < rank, x.range).otherwise(s.range).alias("range")))
    return held.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", F.pow(F.lit(GROWTH), found["range"]).alias("p95"))


LIMITER = "key string, seq long, ts double, allowed boolean, retry_after int"


def _limit_rows(key: str, rows: pd.DataFrame, kept: list[float], limit: int, window: float) -> tuple[pd.DataFrame, list[float]]:
    out = []
    for seq, now in rows.sort_values(["ts", "seq"])[["seq", "ts"]].itertuples(index=False):
        kept, ok, wait = _allow(kept, now, limit, window)
        out.append((key, seq, now, ok, wait))
    return pd.DataFrame(out, columns=["key", "seq", "ts", "allowed", "retry_after"]), kept


def limit_batch(events: DataFrame, limit: int, window: float) -> DataFrame:
    """Sliding-window limiter over a table (key, seq, ts in seconds): refused events leave no trace, so it isn't a window function.

    A key's events must be taken in turn, as Spark's sort within a partition deals them out in batches; the state is the key
    and at most `limit` stamps.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, []
        for batch in batches:
            for key, rows in batch.groupby("key", sort=False, dropna=False):
                key = None if pd.isna(key) else key
                out, kept = _limit_rows(key, rows, kept if key == last else [], limit, window)
                last = key
                yield out

    rows = events.select(F.col("key").cast("string").alias("key"), "seq", "ts").repartition("key").sortWithinPartitions("key", "ts", "seq")
    return rows.mapInPandas(run, LIMITER)


def limit_stream(events: DataFrame, limit: int, window: float) -> DataFrame:
    """The same for a stream; the state of a key ends when it has been silent for the window."""

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        for rows in batches:
            out, kept = _limit_rows(key[0], rows, kept, limit, window)
            yield out
        state.update((kept,))
        state.setTimeoutDuration(int(window * 1000) + 1000)

    return events.select("key", "seq", "ts").groupBy("key").applyInPandasWithState(run, LIMITER, "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def expired_requests(requests: DataFrame, starts: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests (request_id, ts) without a start (request_id, start_ts) within the seconds: one cancelled row each."""
    begun = starts.select("request_id", "start_ts")
    ok = requests.join(begun, "request_id").filter(F.col("start_ts").between(F.col("ts"), F.col("ts") + F.make_dt_interval(secs=F.lit(seconds)))).select("request_id").distinct()
    return requests.join(ok, "request_id", "left_anti").select("request_id", "ts", F.lit("cancelled").alias("status"))


def expired_stream(requests: DataFrame, starts: DataFrame, seconds: int = 60, late: str = "10 seconds") -> DataFrame:
    """The same for two streams: an outer join with a time bound, whose unmatched rows come out once the watermark has passed."""
    r = requests.withWatermark("ts", late)
    s = starts.select(F.col("request_id").alias("started"), "start_ts").withWatermark("start_ts", late)
    bound = F.expr(f"started = request_id AND start_ts >= ts AND start_ts <= ts + INTERVAL {seconds} SECONDS")
    return r.join(s, bound, "leftOuter").filter("started is null").select("request_id", "ts", F.lit("cancelled").alias("status"))


def first_snapshots(results: DataFrame, late: str = "1 day") -> DataFrame:
    """The first row of equal (url, hash of the snippet), whole: for a stream (within the watermark) or a table (by time, then by the other columns)."""
    rows = results.filter(F.coalesce("url", F.lit("")) != "").withColumn("content_hash", F.sha2(F.coalesce("snippet", F.lit("")), 256))
    if rows.isStreaming:
        return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["url", "content_hash"])
    first = F.min(F.struct("ts", *[c for c in rows.columns if c not in ("url", "content_hash", "ts")])).alias("first")
    return rows.groupBy("url", "content_hash").agg(first).select("url", "content_hash", "first.*")


def job_states(progress: DataFrame) -> DataFrame:
    """Latest status, stage and progress (0 to 100) of each job (job_id, ts, seq, status, stage, progress), in update mode for a stream."""
    latest = F.max_by(F.struct("status", "stage", "progress"), F.struct("ts", "seq")).alias("l")
    return progress.groupBy("job_id").agg(latest).select("job_id", "l.status", "l.stage", F.greatest(F.lit(0), F.least(F.lit(100), F.col("l.progress"))).alias("progress"))


def audit_feed(requests: DataFrame, path: str, checkpoint: str, secret: str):
    """Starts an append-only feed of mutating requests, partitioned by day; clients are kept as keyed hashes."""
    from siltstone.operators.telemetry import audit_rows

    rows = audit_rows(requests).withColumns({"client": keyed_hash("client", secret), "day": F.to_date("ts")})
    return rows.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").start()


# -- ingestion ----------------------------------------------------------------------------------------------------

CHUNKS = "document_id long, content_hash string, id string, text string, page int, chunk_type string, created_at long"


def stored_chunks(chunks: Ledger) -> DataFrame:
    """The chunks as all batches leave them: by (document_id, content_hash), first id and text, newest page and kind."""
    rows = chunks.read()
    return merge.upsert_chunks(rows.limit(0), rows)


def ingest_batch(pages: DataFrame, number: int, chunks: Ledger, index: Ledger) -> None:
    """Takes one batch of pages (doc_id, page, text) into the chunk store and the index, once however often it comes.

    Pages are cut into sections, texts and tables; of equal content in a document the first place counts.  Chunks that the store
    has just so are not written again, and ids that the index has aren't indexed again, so overlapping batches leave both as they were.
    """
    if not chunks.has(number):
        cut = chunk_documents(pages).select(F.col("doc_id").alias("document_id"), F.sha2("text", 256).alias("content_hash"), "id", "text", "page", "chunk_type")
        once = cut.groupBy("document_id", "content_hash").agg(F.min(F.struct("page", "id", "text", "chunk_type")).alias("c")).select("document_id", "content_hash", "c.id", "c.text", "c.page", "c.chunk_type")
        same = ["document_id", "content_hash", "page", "chunk_type"]
        fresh = once.join(stored_chunks(chunks).select(*same), same, "left_anti")
        chunks.append(number, fresh.withColumn("created_at", F.lit(number).cast("long")).select(*[c.split()[0] for c in CHUNKS.split(", ")]))
    own = stored_chunks(chunks).join(chunks.read(number).select("document_id", "content_hash"), ["document_id", "content_hash"], "left_semi")
    index.append(number, merge.new_index_rows(own.withColumn("pos", F.col("created_at")), index.read()).select("id", "chunk_type", "text"))


INDEX = "id string, chunk_type string, text string"


def ingest(pages: DataFrame, store: str, checkpoint: str):
    """Starts incremental ingestion of a stream of pages into the ledgers `store`/chunks and `store`/index, each batch under its own number."""
    spark = pages.sparkSession
    chunks, index = Ledger(spark, f"{store}/chunks", CHUNKS), Ledger(spark, f"{store}/index", INDEX)
    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: ingest_batch(batch, number, chunks, index)).start()


# -- search cache -------------------------------------------------------------------------------------------------

CACHE = "cache_key string, query string, cached_at timestamp, expires_at timestamp, results array<struct<pos:int,title:string,url:string,snippet:string,published_at:string,trust_tier:int,score:double>>"


def cache_batch(found: DataFrame, number: int, cache: Ledger) -> None:
    """Adds one batch of search results (CACHE) to the cache, once; within a batch the latest row of a key counts."""
    names = [c.split()[0] for c in CACHE.split(", ")[:4]] + ["results"]
    latest = found.groupBy("cache_key").agg(F.max(F.struct("cached_at", "expires_at", "query", "results")).alias("r"))
    cache.append(number, latest.select("cache_key", "r.*").select(*names))


def cache_rows(cache: Ledger) -> DataFrame:
    """The rows that stand: the latest of each key replaces all earlier ones."""
    rows = cache.read()
    return rows.groupBy("cache_key").agg(F.max(F.struct("cached_at", "expires_at", "query", "results")).alias("r")).select("cache_key", "r.*")


def cached_results(rows: DataFrame, keys: DataFrame, now) -> DataFrame:
    """The results kept for the keys asked for, as rows, of entries that haven't run out, judged anew as of the day of `now`."""
    live = merge.cached(rows, keys, now)
    hits = live.select(F.col("cache_key").alias("query_id"), "query", F.inline("results"))
    return evidence.assess_results(hits, F.to_date(now))


def cache_stream(found: DataFrame, path: str, checkpoint: str):
    """Starts a feed of search results (CACHE) into the cache ledger at path."""
    cache = Ledger(found.sparkSession, path, CACHE)
    return found.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, number: cache_batch(batch, number, cache)).start()
