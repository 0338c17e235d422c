"""Helpers that several corpus operators share: stored stages, blocks of documents, vectorised word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of bytes other than these (the same class in every operator).
WORD_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text that one vectorised pass takes at a time (a longer text is taken alone).
PASS_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  Only a local session (tests) that names none gets an own one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bare(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that further ones (with clashing names too) can do no harm."""
    return docs.select(*columns)


def fresh_names(docs: DataFrame, *names: str) -> list[str]:
    """Names for internal columns that docs doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def is_held(column: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder


def with_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Adds `block`: an even, repeatable split of the documents into groups of about block_bytes of text.

    Documents get a block by the hash of their id, so a block's size doesn't depend on sources or copies.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes), partitions(docs.sparkSession))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int"))


# -- vectorised words ---------------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[list(WORD_SPACE)] = True


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    if len(_powers.get(name, ())) < n:
        steps = np.full(max(n, PASS_BYTES + 65536), base, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, "up", n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _power(_INVERSE, "down", n + 1)[starts])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def passes(texts: list[bytes], most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together hold about `most` bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def utf8(texts) -> list[bytes]:
    """UTF-8 of each text; a missing text is empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


_SHINGLE = mix(np.arange(1, 1025, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: of `width` words, or of all words where there are fewer.

    Only A-Z are lower-cased.  A text without words has an empty set.
    """
    for lo, hi in passes(texts):
        data = np.frombuffer(b"\n".join(t.lower() for t in texts[lo:hi]) + b"\n", np.uint8)
        starts, ends = word_bounds(data)
        words = span_hashes(data, starts, ends)
        limits = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
        cuts = np.searchsorted(starts, limits)
        count = max(0, len(words) - width + 1)
        rolled = np.zeros(count, np.uint64)
        for j in range(width):
            rolled += words[j : j + count] * _SHINGLE[j]
        rolled = mix(rolled)
        begin = 0
        for end in cuts:
            n = end - begin
            if n >= width:
                yield np.unique(rolled[begin : end - width + 1])
            elif n:
                total = _SHINGLE[width + n : width + n + 1].copy()
                for j in range(n):
                    total += words[begin + j : begin + j + 1] * _SHINGLE[j]
                yield mix(total)
            else:
                yield np.empty(0, np.uint64)
            begin = end
