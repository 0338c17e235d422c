"""Near-duplicate documents by HyperMinHash.

A document's set of five-word shingles is sketched in REGISTERS buckets; a register keeps the leading zeros of the bucket's
smallest hash and ten bits of mantissa after them (16 bits in all).  Empty buckets borrow from others in an order fixed for each
bucket.  Bands of registers are hashed into candidates; the Jaccard estimate, corrected for chance collisions of registers, sorts
out most of them; what is left is confirmed on the full sets.

Equal sets are one class from the start.  In each bucket of a band all members are first compared with the bucket's lowest member
only, so copies of one document make as many pairs as there are copies.  Buckets in which several components are left are
then compared across components, in blocks of bounded size; a pair is looked at in the first band that it shares, and only
pairs that pass are emitted.  At a similarity of 0.85 a pair shares no band with a probability of 2e-9 (0.8: 3e-6).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bare, fresh_names, mix, shingle_sets, stored, utf8

WIDTH = 5
PERCENT = 85
REGISTERS = 256
MANTISSA = 10
ROWS_OF_BAND, BANDS = 6, 42
#: Standard deviations by which an estimate may fall short of the threshold.
MARGIN = 4.0
#: Hashes of a set (the smallest ones, 32 bits each) that go with it into the second round; smaller sets go whole.
FINE = 512
#: Members of a bucket in one block.
BLOCK = 2000
# Fixed value: the collision constant of the HyperMinHash estimate.
_COLLISIONS = 0.169919487159739

_PERMUTED = np.argsort(mix(np.arange(REGISTERS * REGISTERS, dtype=np.uint64)).reshape(REGISTERS, REGISTERS), axis=1).astype(np.int16)
_EDGES = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(56)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of 64-bit hashes that isn't empty."""
    at = np.searchsorted(shingles, _EDGES)
    least = shingles[np.minimum(at, len(shingles) - 1)]
    full = (at < len(shingles)) & (least >> np.uint64(56) == np.arange(REGISTERS, dtype=np.uint64))
    rest = least << np.uint64(8) | np.uint64(1)
    top = np.frexp(rest.astype(np.float64))[1] - 1
    top -= (rest >> np.minimum(top, 63).astype(np.uint64)) == 0
    zeros = 63 - top
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    registers = (zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _PERMUTED[empty]
        donors = order[np.arange(len(empty)), np.argmax(full[order], axis=1)]
        registers[empty] = registers[donors]
    return registers


def estimate(a: np.ndarray, b: np.ndarray, n_a, n_b) -> np.ndarray:
    """Jaccard similarity from registers (last axis), less the share of registers that agree by chance."""
    agree = (a == b).mean(-1)
    ratio = np.asarray(n_a, float) / n_b
    chance = _COLLISIONS * 4 * ratio / (1 + ratio) ** 2 / 2**MANTISSA
    return (agree - chance) / (1 - chance)


def least_estimate(percent: int, n) -> np.ndarray:
    """What an estimate must reach for sets of n shingles: the buckets that they fill decide its spread."""
    t = percent / 100
    filled = REGISTERS * (1 - np.exp(-np.asarray(n, float) / REGISTERS))
    return t - MARGIN * np.sqrt(t * (1 - t) / np.maximum(filled, 1))


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on sorted sets: 100 * intersection >= percent * union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _band_keys(registers: np.ndarray) -> np.ndarray:
    """Keys of all bands (columns) for rows of registers."""
    parts = registers[:, : ROWS_OF_BAND * BANDS].reshape(-1, BANDS, ROWS_OF_BAND).astype(np.uint64)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(registers), 1))
    for j in range(ROWS_OF_BAND):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys.view(np.int64)


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), "<u2").reshape(-1, REGISTERS)


# -- Spark jobs ---------------------------------------------------------------------------------------------------


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), sketch and fine hashes of every whole text; null for an empty set."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for batch in batches:
            rows = []
            for doc, s in zip(batch["doc_id"], shingle_sets(utf8(batch["text"]), WIDTH), strict=True):
                rows.append((doc, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, sketch(s).astype("<u2").tobytes() if len(s) else None, (s[:FINE] >> np.uint64(32)).astype("<u4").tobytes() if len(s) else None))
            yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "digest", "sketch", "fine"])

    return bare(docs, "doc_id", "text").filter("doc_id is not null").mapInPandas(run, "doc_id long, n_shingles long, digest binary, sketch binary, fine binary")


def _full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id, n, members (sorted 64-bit hashes) of the documents named in ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = list(shingle_sets(utf8(batch["text"]), WIDTH))
            yield pd.DataFrame({"id": batch["doc_id"], "members": [s.astype("<u8").tobytes() for s in sets]})

    return bare(docs, "doc_id", "text").join(ids, F.col("doc_id") == F.col("id"), "left_semi").mapInPandas(run, "id long, members binary")


def confirmed(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(batch["ma"], batch["mb"], strict=True)]
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = stored(_full_sets(docs, ids), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("id").alias("b"), F.col("members").alias("mb")), "b")
    return both.mapInPandas(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) for every end of an edge (a, b); links move to stars in rounds."""
    links = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    before = None
    while True:
        # large star: higher neighbours of u move to the lowest of its neighbourhood
        around = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = around.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        links = around.join(low, "x").filter("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: u and its lower neighbours move to the lowest of them
        low = links.groupBy("u").agg(F.min("v").alias("m"))
        links = links.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        links = stored(links, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())


def _across(key, block: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Pairs of different components in a block of a bucket that pass size and estimate and share no earlier band."""
    bucket, i, j = key
    registers = _registers(block["sketch"])
    n, comp, ids, part = (block[c].to_numpy(np.int64) for c in ("n", "component", "id", "block"))
    keys = _band_keys(registers)
    fine = [np.frombuffer(x, "<u4") for x in block["fine"]]
    band = int(np.flatnonzero(keys[0] == bucket)[0])
    out = []
    left = np.flatnonzero(part == i)
    for a in left:
        others = np.flatnonzero((comp != comp[a]) & (part == j) & ((ids > ids[a]) | (i != j)))
        others = others[(100 * np.minimum(n[others], n[a]) >= percent * np.maximum(n[others], n[a]))]
        if not len(others):
            continue
        good = estimate(registers[others], registers[a], n[others], n[a]) >= least_estimate(percent, np.minimum(n[others], n[a]))
        others = others[good]
        if band and len(others):
            others = others[~(keys[others, :band] == keys[a, :band]).any(1)]
        for b in others:
            if n[a] <= FINE and n[b] <= FINE:  # whole sets: only links pass, one hash of slack for 32 bits that agree by chance
                both = len(np.intersect1d(fine[a], fine[b], assume_unique=True)) + 1
                if 100 * both < percent * (n[a] + n[b] - both):
                    continue
            out.append((int(ids[a]), int(ids[b])))
    return out


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links of this similarity), kept (doc_id = component_id).

    docs: doc_id (unique), text.  A null text, or one without words, is linked with nothing.  Rows without doc_id are left out.
    """
    signed = stored(signatures(docs), "signatures")
    own = signed.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("fine").alias("fine"))
    classes = stored(own, "classes")

    def bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                keys = _band_keys(_registers(batch["sketch"]))
                yield pd.DataFrame({"bucket": keys.ravel(), "id": np.repeat(batch["id"].to_numpy(np.int64), BANDS)})

    rows = classes.select("id", "sketch").mapInPandas(bands, "bucket long, id long")
    shared = rows.groupBy("bucket").agg(F.min("id").alias("lead"), F.count("*").alias("size")).filter("size > 1")
    members = stored(rows.join(shared, "bucket"), "buckets")

    # first round: every member against the lowest of its bucket
    stars = members.filter("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    slim = classes.select("id", "n", "sketch")
    named = lambda x: slim.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def estimated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                na, nb = batch["na"].to_numpy(np.int64), batch["nb"].to_numpy(np.int64)
                fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                fits &= estimate(_registers(batch["sa"]), _registers(batch["sb"]), na, nb) >= least_estimate(percent, np.minimum(na, nb))
                yield batch.loc[fits, ["a", "b"]]

    likely = stars.join(named("a"), "a").join(named("b"), "b").mapInPandas(estimated, "a long, b long")
    links = stored(confirmed(docs, stored(likely, "pairs"), percent), "links-1")

    # second round: buckets in which several components are left
    labels = components(links)
    placed = members.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    placed = stored(placed, "placed")
    open_ = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("bucket")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK).cast("int"))
    rest = placed.join(open_, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    # each block meets itself and every other one once
    meets = "transform(sequence(0, blocks - 1), k -> struct(least(k, block) as i, greatest(k, block) as j))"
    rest = rest.withColumn("m", F.explode(F.expr(meets))).select("bucket", "m.i", "m.j", "block", "id", "component").join(classes.select("id", "n", "sketch", "fine"), "id")

    def across(key, block: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_across(key, block, percent), columns=["a", "b"], dtype=np.int64)

    more = stored(rest.groupBy("bucket", "i", "j").applyInPandas(across, "a long, b long").distinct(), "pairs-2")
    found = links.unionByName(stored(confirmed(docs, more, percent), "links-2"))
    final = components(found)
    ids = classes.select("digest", "id").join(final, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(ids, "digest", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, percent: int) -> DataFrame:
    """The documents that stay when each component keeps its smallest doc_id, with their own columns; rows without an id stay."""
    (own,) = fresh_names(docs, "gone")
    gone = near_duplicates(docs, percent).filter("not kept").select(F.col("doc_id").alias(own))
    return docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")


def op7_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), PERCENT)
