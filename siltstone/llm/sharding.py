"""Shards of near-equal bytes by histogram sort, with DataFrame operations only.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together and any order of ids balances.
Rounds of exact byte counts below candidate boundaries narrow each splitter; then one range exchange puts the
rows in that order, and slots follow from counts per (partition, shard).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bare, fresh_names, partitions, stored

#: Candidate boundaries that one round puts into each interval still open.
PROBES = 64
#: A splitter is settled when the bytes below it are this near (share of a shard) to the wanted number.
TOLERANCE = 0.002
_LOW, _HIGH = -(1 << 63), 1 << 63


def _below(keyed: DataFrame, column: str, probes: list[int], where: Column | None = None) -> dict[int, int]:
    """Exact bytes of the rows whose key is below each probe: each partition counts its own, one sum joins them.

    The result has one number for each probe, whatever the table holds.
    """
    edges = F.array(*[F.lit(p) for p in probes])
    rows = keyed if where is None else keyed.filter(where)
    steps = ",".join(str(1 << k) for k in reversed(range(len(probes).bit_length())))  # binary search for the probes passed
    slot = F.expr(f"aggregate(array({steps}), 0, (n, step) -> if(coalesce(get(edges, n + step - 1) <= {column}, false), n + step, n))")
    found = rows.withColumn("edges", edges).groupBy(slot.alias("slot")).agg(F.sum("size").alias("b")).collect()
    counts, total, out = {r["slot"]: r["b"] for r in found}, 0, {}
    for i, p in enumerate(probes):
        total += counts.get(i, 0)
        out[p] = total
    return out


def _refine(keyed, column, targets, low, high, tolerance, where=None):
    """For each target: the boundary with the bytes below it nearest to the target, and the last key not beyond it.

    Returns {target: ((boundary, bytes below), (last key with at most target bytes below, those bytes))}.
    """
    open_at = {t: ((low, 0), high) for t in targets}
    best: dict[int, tuple[int, int]] = {}
    settled = {}
    while open_at:
        probes = sorted({lo + (hi - lo) * k // (PROBES + 1) for (lo, _), hi in open_at.values() for k in range(1, PROBES + 1)})
        below = _below(keyed, column, probes, where)
        for t, ((lo, lo_bytes), hi) in list(open_at.items()):
            for p in probes:
                if lo <= p <= hi:
                    if t not in best or abs(below[p] - t) < abs(best[t][1] - t):
                        best[t] = (p, below[p])
                    if below[p] <= t:
                        lo, lo_bytes = p, below[p]
                    else:
                        hi = p
                        break
            open_at[t] = ((lo, lo_bytes), hi)
            if abs(best[t][1] - t) <= tolerance or hi - lo <= 1:
                settled[t] = (best[t], (lo, lo_bytes))
                del open_at[t]
    return settled


def splitters(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int | None]]:
    """Boundaries (hash, doc_id or None): a shard takes the rows below its boundary in the order of (hash, doc_id).

    A boundary inside one hash value (a large group of equal texts) is refined by doc_id within that value.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [(_HIGH - 1, None)] * (shards - 1)
    targets = sorted({total * k // shards for k in range(1, shards)})
    near = max(1, int(total / shards * tolerance))
    coarse = _refine(keyed, "key", targets, _LOW, _HIGH, near)
    out = {t: (at[0], None) for t, (at, _) in coarse.items()}
    astride = {t: last for t, (at, last) in coarse.items() if abs(at[1] - t) > near}
    if astride:
        keys = keyed.filter(F.col("key").isin(sorted({k for k, _ in astride.values()})))
        spans = {r["key"]: r for r in keys.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()}
        for t, (key, bytes_below) in astride.items():
            span = spans.get(key)
            if span and span["lo"] is not None and span["lo"] < span["hi"]:
                (at, _) = _refine(keyed, "doc_id", [t - bytes_below], span["lo"], span["hi"] + 1, near, F.col("key") == key)[t - bytes_below]
                if abs(at[1] + bytes_below - t) < abs(coarse[t][0][1] - t):
                    out[t] = (key, at[0])
    return sorted((out[total * k // shards] for k in range(1, shards)), key=lambda b: (b[0], _LOW if b[1] is None else b[1]))


def sort_into_shards(docs: DataFrame, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds size, text_crc32, shard (0..shards-1) and slot (gapless from 0 in each shard, in the order of the sort).

    docs: doc_id (unique, not null for the balance within equal texts), text, and further columns, which move along
    in the one exchange, whatever their names; those named size, text_crc32, shard or slot are replaced.  A null text has size 8 and
    crc32 0 of no bytes; a null doc_id sorts first among equal texts; repeated rows get slots of their own.
    An empty table gives an empty result.  Equal texts stand together; a boundary cuts such a group only where
    keeping it whole would miss the tolerance.
    """
    (row,) = fresh_names(docs, "row")
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    keyed = docs.select(F.struct("*").alias(row), "doc_id", (F.length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key"))
    out = exchange(keyed, shards, tolerance)
    own = [F.col(f"{row}.`{c}`") for c in docs.columns if c.lower() not in ("size", "text_crc32", "shard", "slot")]
    return out.select(*own, "size", "text_crc32", "shard", "slot")


def exchange(keyed: DataFrame, shards: int, tolerance: float = TOLERANCE) -> DataFrame:
    """The sort of rows that have key, size and doc_id, and none of this job's own columns (edges, part, nth, shift)."""
    spark = keyed.sparkSession
    slim = stored(keyed.select("key", "doc_id", F.col("size").cast("long").alias("size")), "shard-keys")
    bounds = splitters(slim, shards, tolerance)
    edges = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(d).cast("long").alias("d")) for k, d in bounds]) if bounds else F.array()
    passed = F.expr("aggregate(edges, 0, (n, e) -> n + cast(key > e.k or (key = e.k and (e.d is null or doc_id >= e.d)) as int))")
    shard = passed if bounds else F.lit(0)
    placed = (
        keyed.withColumn("edges", edges)
        .withColumn("shard", shard.cast("int"))
        .drop("edges")
        .repartitionByRange(max(shards, partitions(spark)), "shard", "key", "doc_id")
        .sortWithinPartitions("shard", "key", "doc_id")
        .withColumns({"part": F.spark_partition_id(), "nth": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    placed = stored(placed, "shards")
    runs = placed.groupBy("shard", "part").agg(F.min("nth").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each (shard, partition) that meet: at most partitions + shards rows
    starts = runs.select("shard", "part", (before - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(starts), ["shard", "part"]).withColumn("slot", F.col("nth") + F.col("shift")).drop("part", "nth", "shift")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law `bytes`."""
    docs = bare(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    raw = F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))
    slim = docs.select("doc_id", (F.length(raw).cast("long") + 8).alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key"))
    out = exchange(slim, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
