"""Document fingerprints from content-defined chunks.

A gear hash rolls over the UTF-8 bytes; a boundary falls where its masked bits are zero, with a stricter mask before
the wanted chunk size and a looser one after it (normalised chunking).  The fingerprint is the set of chunk digests
with their bytes.  Likeness is containment: the bytes of shared chunks over the bytes of the smaller fingerprint.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import bare, mix, partitions, stored, utf8

#: Bytes of a chunk: least, wanted, most.
LEAST, WANTED, MOST = 8, 24, 96
#: Gear hash bits that must be zero before and after the wanted size.
STRICT = np.uint32(0b111111 << 26)
LOOSE = np.uint32(0b111 << 26)
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
#: Bytes of the rolling window: a 32-bit hash has shifted older ones out.
_WINDOW = 32


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """hash[i] = sum of gear[data[i-j]] << j over the window, by doubling its length five times."""
    h = _GEAR[data]
    step = 1
    while step < _WINDOW:
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        step *= 2
    return h


def boundaries(text: bytes) -> list[int]:
    """Ends of the chunks; the last is the end of the text."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    h = gear_hashes(np.frombuffer(text, np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = ((h[loose] & STRICT) == 0).tolist()
    ends, start = [], 0
    for p, hard in zip(loose.tolist(), strict, strict=True):
        size = p + 1 - start
        while size > MOST:
            start += MOST
            ends.append(start)
            size -= MOST
        if size >= WANTED or (hard and size >= LEAST):
            start = p + 1
            ends.append(start)
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunks(text: bytes) -> dict[int, int]:
    """Digest -> bytes of the distinct chunks."""
    out, start = {}, 0
    for end in boundaries(text):
        piece = text[start:end]
        out[zlib.crc32(piece)] = end - start
        start = end
    return out


def render(parts: dict[int, int]) -> bytes:
    """Ascending digests, each four bytes and then one for its length; shown as hex digits.  Empty for an empty text."""
    return b"".join([(d << 8 | n).to_bytes(5, "big") for d, n in sorted(parts.items())])


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Containment by bytes, 0 to 1.  Two empty texts are alike, an empty and another are not."""
    if not a or not b:
        return float(not a and not b)
    shared = sum(a[d] for d in a.keys() & b.keys())
    return shared / min(sum(a.values()), sum(b.values()))


def _edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _row(doc: int, text: str, own: dict[int, int], following: str, other: dict[int, int]) -> tuple:
    import hashlib

    edited = _edited(text, following)
    raw = edited.encode("utf-8", "surrogatepass")
    parts = own if edited == text else chunks(raw)
    return doc, len(text), hashlib.sha256(raw).hexdigest(), render(own), render(parts), likeness(own, parts), likeness(own, other)


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_COLUMNS = [c.split()[0] for c in _OUT.split(", ")]
_STEP = _OUT + ", part int, edge string, edge_id long, edge_text string"


def _chunks_of(text: str) -> dict[int, int]:
    return chunks(text.encode("utf-8", "surrogatepass"))


def _finish(first_id: int, first_text: str, own_id: int, own_text: str) -> tuple:
    return _row(own_id, own_text, _chunks_of(own_text), first_text, _chunks_of(first_text))


def _packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts for the shuffle, each compressed."""
    import zstandard

    for batch in texts:
        squeeze = zstandard.ZstdCompressor(level=6, write_content_size=True)
        yield pd.Series([squeeze.compress(t) for t in utf8(batch)], dtype=object)


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edits by the next document in ascending doc_id.

    docs: doc_id (unique), text.  A null text counts as empty.  Rows without doc_id are left out, as they have no place
    in the order.  One document is its own next.  An empty table gives an empty result.  Rows of equal doc_id, which the input
    shouldn't hold, each give a row and follow one another in no set order.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard
        from pyspark import TaskContext

        part, held, rows = TaskContext.get().partitionId(), None, []

        def edge(kind, doc, text):
            return (*[None] * len(_COLUMNS), part, kind, doc, text)

        def table():
            return pd.DataFrame(rows, columns=[*_COLUMNS, "part", "edge", "edge_id", "edge_text"]).astype({"doc_id": "Int64", "n_chars": "Int64", "edge_id": "Int64"})

        loosen = zstandard.ZstdDecompressor()
        for batch in batches:
            for doc, packed in zip(batch["doc_id"], batch["packed"], strict=True):
                text = loosen.decompress(bytes(packed)).decode("utf-8", "surrogatepass")
                parts = _chunks_of(text)
                if held is None:
                    rows.append(edge("first", doc, text))
                else:
                    rows.append((*_row(*held, text, parts), part, None, None, None))
                held = doc, text, parts
                if len(rows) >= 500:
                    yield table()
                    rows = []
        if held is not None:
            rows.append(edge("last", held[0], held[1]))
        if rows:
            yield table()

    packed = bare(docs, "doc_id", "text").filter("doc_id is not null").select("doc_id", F.pandas_udf(_packed, "binary")("text").alias("packed"))
    ordered = packed.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    step = stored(ordered.mapInPandas(walk, _STEP), "fingerprints")
    # the last document of each partition still waits for the first of the next one: one such pair for each partition
    firsts = step.filter("edge = 'first'").select("part", F.col("edge_id").alias("first_id"), F.col("edge_text").alias("first_text"))
    ring = Window.orderBy("part")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follow = firsts.select("part", F.coalesce(F.lead("part").over(ring), F.first("part").over(whole)).alias("next_part"))
    lasts = step.filter("edge = 'last'").select("part", F.col("edge_id").alias("own_id"), F.col("edge_text").alias("own_text")).join(follow, "part").drop("part")
    pairs = lasts.join(firsts.withColumnRenamed("part", "next_part"), "next_part").select("first_id", "first_text", "own_id", "own_text")

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([_finish(*r) for r in batch.itertuples(index=False)], columns=_COLUMNS)

    out = step.filter("edge is null").select(*_COLUMNS).unionByName(pairs.mapInPandas(close, _OUT))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
