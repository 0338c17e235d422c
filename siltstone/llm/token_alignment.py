"""Alignment of the tokens that two tokenizers cut from the same text, by pointer jumping.

Both tokenizations tile the bytes of a text.  Every token points to the token of the other side that overlaps it and reaches farthest
to the right, or to itself if none reaches farther; of two that end at the same byte the second tokenizer's is the last.  Doubling
all pointers at once (the successor of the successor) until nothing moves takes each token to the last token of its
component, whose number is the group.  Many texts are laid out one after the other; ends of texts are common ends.

Within a group every token of one side is linked with every token of the other.  In how many documents an id pair is linked is counted
in blocks first: a block's rows name its distinct pairs once, so that neither the counts nor their way back move a row for
each document and pair.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import bare, passes, stored, utf8
from siltstone.llm.dataset_files import tokenizer_path

#: Bytes of text whose distinct pairs are counted together, and pieces (about 150 bytes each) that a worker remembers.
BLOCK_BYTES, CACHE_PIECES = 8 << 20, 400_000
#: Links of a group beyond which equal ids of a side are taken together first.
LARGE_GROUP = 4096

COLUMNS = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, held binary, times binary, pairs array<long>, holders array<int>"


# -- tokenizers ---------------------------------------------------------------------------------------------------


def _of(kind: str) -> str:
    """Letters up to U+024F whose category begins so, as the inside of a class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


# Fixed value: how byte-level vocabularies cut a text, here for texts of _PLAIN alone.
_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_of('L')}]+| ?[{_of('N')}]+| ?[^\s{_of('L')}{_of('N')}]+|\s+(?!\S)|\s+")
#: Latin letters and common signs; what letters, numbers and white space are among others depends on the library.
_PLAIN = re.compile("[\x00-\x1b\x20-ɏ‐-‧‰-⁞€™]*")


class ByteLevel:
    """Ids and bytes of a byte-level vocabulary.  Each distinct piece is encoded once; texts with unusual letters go whole through the library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        letters = {chr(b): b for b in printable} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in printable)}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.pieces: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known = self.pieces
        if len(known) > CACHE_PIECES:
            known.clear()
        cut = [_CUT.findall(t) if _PLAIN.fullmatch(t) else None for t in texts]
        new = list(set().union(*(c for c in cut if c is not None)).difference(known))
        known.update(zip(new, self._library(new), strict=True))
        whole = iter(self._library([t for t, c in zip(texts, cut, strict=True) if c is None]))
        return [np.frombuffer(next(whole) if c is None else b"".join(map(known.__getitem__, c)), "<u4") for c in cut]

    def forget(self) -> None:
        self.pieces.clear()


class Marked:
    """Ids and bytes of a sentence-piece vocabulary, by its library."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(self.model.get_piece_size())
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i in ids for p in (self.model.id_to_piece(i),)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, "<u4") for ids in self.model.encode(texts, num_threads=1)]

    def forget(self) -> None:
        pass


# -- alignment ----------------------------------------------------------------------------------------------------


def token_groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the groups, from left to right, of the tokens that end at these bytes; both sides tile the same bytes."""
    n = len(ends_a)
    to_b = np.searchsorted(ends_b, ends_a)  # the token that holds the last byte of this one reaches farthest
    to_a = np.searchsorted(ends_a, ends_b)
    last = ends_a[to_a] == ends_b if n else np.zeros(0, bool)
    successor = np.concatenate((n + to_b, np.where(last, n + np.arange(len(ends_b)), to_a)))
    while True:
        farther = successor[successor]
        if (farther == successor).all():
            break
        successor = farther
    group = (np.cumsum(last) - 1)[successor - n] if n else successor
    return group[:n], group[n:]


def group_links(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, pair (id of a << 32 | id of b) and number of all links; a large group's equal links are counted together."""
    groups = group_a[-1] + 1 if len(group_a) else 0
    size_a, size_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    first_a, first_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    n_links = size_a * size_b
    small = np.where(n_links <= LARGE_GROUP, n_links, 0)
    owner = np.repeat(np.arange(groups), small)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(small) - small, small)
    width = size_b[owner]
    pairs = a[first_a[owner] + number // width].astype(np.int64) << 32 | b[first_b[owner] + number % width]
    parts = [(owner, pairs, np.ones(len(owner), np.int64))]
    for g in np.flatnonzero(n_links > LARGE_GROUP).tolist():
        ids_a, times_a = np.unique(a[first_a[g] : first_a[g] + size_a[g]], return_counts=True)
        ids_b, times_b = np.unique(b[first_b[g] : first_b[g] + size_b[g]], return_counts=True)
        parts.append((np.full(len(ids_a) * len(ids_b), g), (ids_a.astype(np.int64)[:, None] << 32 | ids_b[None, :]).ravel(), (times_a[:, None] * times_b[None, :]).ravel()))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Aligner:
    """Texts -> per text (n_a, n_b, n_groups, n_links, groups, distinct pairs, links of each)."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Marked(path_b)
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        # a token as text with what follows it: within its side of the group, or at the side's end
        self.written = [f"{i}{c}" for c in ",|" for i in range(len(self.size_a))] + [f"{i}{c}" for c in ",;" for i in range(len(self.size_b))]

    def align(self, texts: list[bytes]) -> list[tuple]:
        plain = [t.decode("utf-8", "surrogatepass") for t in texts]
        own_a, own_b = self.a.encode([" " + t for t in plain]), self.b.encode(plain)
        bytes_a, bytes_b = self.a.bytes, self.b.bytes
        fits = [bool(t) and b"".join(map(bytes_a.__getitem__, x.tolist())) == b" " + t == b"".join(map(bytes_b.__getitem__, y.tolist())) for t, x, y in zip(texts, own_a, own_b, strict=True)]
        none = np.empty(0, np.uint32)
        own_a, own_b = ([x if ok else none for x, ok in zip(side, fits, strict=True)] for side in (own_a, own_b))
        a, b = np.concatenate([*own_a, none]), np.concatenate([*own_b, none])
        stop_a, stop_b = np.cumsum([0, *map(len, own_a)]), np.cumsum([0, *map(len, own_b)])
        group_a, group_b = token_groups(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        n_groups = int(group_a[-1]) + 1 if len(a) else 0
        cuts = np.searchsorted(group_a, np.arange(n_groups + 1)), np.searchsorted(group_b, np.arange(n_groups + 1))  # where each group begins
        text_groups = np.concatenate((group_a, [n_groups]))[stop_a]  # where each text's groups begin
        # tokens in the order of the written form: a group's first side, then its second
        codes = np.empty(len(a) + len(b), np.int64)
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[cuts[0][1:] - 1] = end_b[cuts[1][1:] - 1] = 1
        codes[np.arange(len(a)) + cuts[1][group_a]] = a + end_a * len(self.size_a)
        codes[np.arange(len(b)) + cuts[0][group_b + 1]] = b + end_b * len(self.size_b) + 2 * len(self.size_a)
        owner, pairs, times = group_links(a, b, group_a, group_b)
        text = np.searchsorted(text_groups, owner, "right") - 1
        distinct, at = np.unique(pairs, return_inverse=True)
        keys, where = np.unique(text * max(len(distinct), 1) + at, return_inverse=True)
        links = np.bincount(where, times, len(keys)).astype(np.int64)
        bounds = np.searchsorted(keys, np.arange(len(texts) + 1) * max(len(distinct), 1))
        held = distinct[keys % max(len(distinct), 1)]
        out, stops, written = [], (stop_a + stop_b).tolist(), self.written
        for k in range(len(texts)):
            lo, hi = bounds[k], bounds[k + 1]
            form = "".join(map(written.__getitem__, codes[stops[k] : stops[k + 1]].tolist()))[:-1]
            out.append((len(own_a[k]), len(own_b[k]), int(text_groups[k + 1] - text_groups[k]), int(links[lo:hi].sum()), form, held[lo:hi], links[lo:hi]))
        return out

    def forget(self) -> None:
        self.a.forget()


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner for each pair of vocabularies and worker; what it remembers serves one task."""
    if (path_a, path_b) not in _aligners:
        _aligners[path_a, path_b] = Aligner(path_a, path_b)
    return _aligners[path_a, path_b]


# -- Spark jobs ---------------------------------------------------------------------------------------------------


def align(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document its numbers and `groups` (`a1,a2|b1;...`, ids of both sides), and a row for each block of documents.

    docs: doc_id, text; further columns are ignored.  A text that is null, empty, or isn't what its tokens of both sides join to has no
    tokens: zeros and an empty `groups`.  Every row is a document: repeated ones, and those without doc_id, too; an empty table gives none.

    A document names its distinct pairs (`held`, places in its block's `pairs`) with the links of each (`times`); a block's row has
    `pairs` and in how many of its documents each is linked (`holders`).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tool, block = aligner(path_a, path_b), TaskContext.get().partitionId() << 32
        try:
            for batch in batches:
                texts, ids = utf8(batch["text"]), batch["doc_id"].tolist()
                for lo, hi in passes(texts, block_bytes):
                    rows = [row for x, y in passes(texts[lo:hi]) for row in tool.align(texts[lo:hi][x:y])]
                    pairs, at, holders = np.unique(np.concatenate([r[5] for r in rows]), return_inverse=True, return_counts=True)
                    stops = np.cumsum([0, *(len(r[5]) for r in rows)])
                    out = [(block, None if i is None or i != i else int(i), *r[:5], at[p:q].astype("<u4").tobytes(), r[6].astype("<u4" if r[3] < 1 << 32 else "<u8").tobytes(), None, None) for i, r, p, q in zip(ids[lo:hi], rows, stops, stops[1:])]
                    out.append((block, None, *[None] * 7, pairs, holders.astype(np.int32)))
                    frame = pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")])
                    for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links"):
                        frame[c] = frame[c].astype("Int64")
                    yield frame
                    block += 1
        finally:
            tool.forget()

    return bare(docs, "doc_id", "text").mapInPandas(run, COLUMNS)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs (documents in which it is linked), best (no pair with the same first id is linked in more)."""
    named = aligned.filter("pairs is not null").select(F.explode(F.arrays_zip("pairs", "holders")).alias("x"))
    counts = named.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("n_docs"))
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n_docs").alias("top"))
    return counts.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "n_docs", (F.col("n_docs") == F.col("top")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, *keep: str) -> DataFrame:
    """The documents with n_best (links of best pairs) and count_sum (n_docs over all links), and the columns named."""
    schema = T.StructType([*aligned.select("doc_id", *keep).schema, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])

    def sums(docs: pd.DataFrame, judged: pd.DataFrame) -> pd.DataFrame:
        n_docs, best = np.zeros(len(judged), np.int64), np.zeros(len(judged), np.int64)
        n_docs[judged["pos"]], best[judged["pos"]] = judged["n_docs"], judged["best"]
        at = [np.frombuffer(x, "<u4") for x in docs["held"]]
        times = [np.frombuffer(x, "<u4" if len(x) == len(h) else "<u8").astype(np.int64) for x, h in zip(docs["times"], docs["held"], strict=True)]
        return docs[["doc_id", *keep]].assign(n_best=[int(best[i] @ t) for i, t in zip(at, times, strict=True)], count_sum=[int(n_docs[i] @ t) for i, t in zip(at, times, strict=True)])

    judged = aligned.filter("pairs is not null").select(F.col("block").alias("of"), F.posexplode("pairs").alias("pos", "pair")).join(counts, "pair").select("of", "pos", "n_docs", "best")
    docs = aligned.filter("pairs is null").select("block", "doc_id", *keep, "held", "times")
    return docs.groupBy("block").cogroup(judged.groupBy("of")).applyInPandas(sums, schema)


def op12_token_alignment(spark, sf_dir: str, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    aligned = align(docs, path_a or tokenizer_path("byte_bpe_50k.json"), path_b or tokenizer_path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = stored(aligned.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    counts = stored(pair_counts(aligned), "pair-counts")
    return with_counts(aligned, counts, "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
