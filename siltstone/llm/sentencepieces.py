"""SentencePiece encoding and decoding of whole texts by a forward pass that words with a common beginning share.

A text is marked (each space becomes U+2581, one is put in front) and cut into marked words.  The distinct words of a
batch are sorted, which lays out their trie; a depth-first walk keeps the forward table of the current beginning and
computes new cells only for letters that the previous word didn't have.

For a unigram vocabulary a cell holds the best score and last piece (Viterbi).  For a byte-pair vocabulary the sum of
scores isn't what the encoder maximises, so a cell holds the one last piece that the merges leave for that beginning: the
longest piece that stays apart from the last piece before it when both are merged together.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bare, passes
from siltstone.llm.dataset_files import tokenizer_path

MARK = "▁"
#: Words (some 220 bytes each) and pairs of pieces (100) that a worker remembers; this bounds memory only.
CACHE_WORDS, CACHE_PAIRS = 350_000, 400_000
#: Bytes of text whose distinct words are sorted together.
STEP_BYTES = 4 << 20
#: Instead of a piece: none yet, or a letter that no piece covers.
NONE, OTHER = -1, -2
#: A marked word: its marks with the letters up to the next mark.
_MARKED = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
# Fixed values of the model file: kind of the model, kinds of pieces.
_UNIGRAM, _NORMAL, _UNKNOWN, _BYTE, _USER = 1, 1, 2, 6, 4


def piece_trie(ids: dict[str, int]) -> tuple[list[dict[str, int]], list[int]]:
    """Letters below each node, and the piece that ends at it (or NONE)."""
    below: list[dict[str, int]] = [{}]
    ends = [NONE]
    for piece, i in ids.items():
        node = 0
        for c in piece:
            if c not in below[node]:
                below[node][c] = len(below)
                below.append({})
                ends.append(NONE)
            node = below[node][c]
        ends[node] = i
    return below, ends


class Vocabulary:
    """Pieces of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.unigram = proto.trainer_spec.model_type == _UNIGRAM
        kinds = [p.type for p in proto.pieces]
        self.score = {p: model.get_score(i) for i, p in enumerate(pieces) if kinds[i] in (_NORMAL, _USER)}
        self.score_of = [model.get_score(i) for i in range(len(pieces))]
        self.id = {p: i for i, p in enumerate(pieces) if kinds[i] in (_NORMAL, _USER)}
        self.bytes = {int(p[1:-1], 16): i for i, p in enumerate(pieces) if kinds[i] == _BYTE}
        self.text = [p.encode() if k in (_NORMAL, _USER) else bytes([int(p[1:-1], 16)]) if k == _BYTE else b"" for p, k in zip(pieces, kinds, strict=True)]
        self.below, self.ends = piece_trie(self.id)
        self.name = pieces
        self.unknown = kinds.index(_UNKNOWN)
        self.worst = min(self.score.values()) - 10
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.known: dict[int, bool] = {}

    def fallback(self, letter: str) -> list[int]:
        """Ids of a letter that no piece covers: its bytes, or unknown."""
        return [self.bytes[b] for b in letter.encode("utf-8", "surrogatepass")] if self.bytes else [self.unknown]

    def merged(self, text: str) -> list[str]:
        """Pieces by merging, always the best-scored neighbours first and the leftmost of equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def apart(self, left: int, right: int) -> bool:
        """Whether the merges leave these two pieces side by side as they are; left may be OTHER, a letter that no piece covers."""
        if len(self.known) > CACHE_PAIRS:
            self.known.clear()
        parts = [self.name[right]] if left == OTHER else [self.name[left], self.name[right]]
        out = self.known[left << 32 | right] = self.merged("".join(parts)) == parts
        return out


class SharedPrefixEncoder:
    """Encodes sorted distinct words; a cell of the forward table belongs to a beginning and serves all words under it."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.word = ""
        # per beginning: score of the best cut, its last piece (NONE at the begin, OTHER for a letter without a piece),
        # where that starts, and (start, trie node) of all pieces that may still grow, the longest first
        self.score, self.last, self.start = [0.0], [NONE], [0]
        self.growing: list[list[tuple[int, int]]] = [[]]

    def encode(self, word: str) -> list[int]:
        keep = len(commonprefix((self.word, word)))
        del self.score[keep + 1 :], self.last[keep + 1 :], self.start[keep + 1 :], self.growing[keep + 1 :]
        (self._unigram if self.v.unigram else self._pairs)(word, keep)
        self.word = word
        out: list[int] = []
        last, start, end = self.last, self.start, len(word)
        while end:
            if last[end] >= 0:
                out.append(last[end])
            else:
                out.extend(reversed(self.v.fallback(word[end - 1])))
            end = start[end]
        out.reverse()
        return out

    def _unigram(self, word: str, keep: int) -> None:
        below, ends, score = self.v.below, self.v.ends, self.v.score_of
        for end in range(keep, len(word)):
            c, growing = word[end], []
            best, piece, at = self.score[end] + self.v.worst, OTHER, end
            for start, node in (*self.growing[end], (end, 0)):
                node = below[node].get(c)
                if node is not None:
                    growing.append((start, node))
                    p = ends[node]
                    if p >= 0 and self.score[start] + score[p] > best:
                        best, piece, at = self.score[start] + score[p], p, start
            self.score.append(best)
            self.last.append(piece)
            self.start.append(at)
            self.growing.append(growing)

    def _pairs(self, word: str, keep: int) -> None:
        below, ends, known, last = self.v.below, self.v.ends, self.v.known, self.last
        for end in range(keep, len(word)):
            c, growing, piece, at = word[end], [], OTHER, end
            for start, node in self.growing[end]:
                node = below[node].get(c)
                if node is not None:
                    growing.append((start, node))
                    if piece == OTHER and (p := ends[node]) >= 0:
                        before = last[start]
                        if before == NONE:
                            piece, at = p, start
                        else:
                            free = known.get(before << 32 | p)
                            if free or (free is None and self.v.apart(before, p)):
                                piece, at = p, start
            node = below[0].get(c)
            if node is not None:
                growing.append((end, node))
                if piece == OTHER:
                    piece = ends[node] if ends[node] >= 0 else OTHER
            last.append(piece)
            self.score.append(0.0)
            self.start.append(at)
            self.growing.append(growing)


class Codec:
    """encode(text) and decode(ids) of one vocabulary, with a memory of words."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.memory: dict[str, bytes] = {}

    def marked(self, text: str) -> list[str]:
        return _MARKED.findall((MARK if self.v.prefix else "") + text.replace(" ", MARK)) if text else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.marked(t) for t in texts]
        distinct = set().union(*split)
        if len(self.memory) > CACHE_WORDS:  # what these texts need stays
            self.memory = {w: self.memory[w] for w in distinct if w in self.memory}
        memory = self.memory
        walk = SharedPrefixEncoder(self.v)
        for word in sorted(distinct.difference(memory)):
            ids = walk.encode(word)
            memory[word] = struct.pack(f"<{len(ids)}I", *ids)
        return [np.frombuffer(b"".join(map(memory.__getitem__, words)), "<u4") for words in split]

    def steps(self, texts) -> Iterator[tuple[list[str], list[np.ndarray]]]:
        """The texts (a missing one is empty) and their ids, about STEP_BYTES at a time."""
        raw = [t if isinstance(t, str) else "" for t in texts]
        for lo, hi in passes(raw, STEP_BYTES):
            yield raw[lo:hi], self.encode(raw[lo:hi])

    def forget(self) -> None:
        """Empties the memories at the end of a task: workers live on, and other stages need their room."""
        self.memory = {}
        self.v.known.clear()

    def decode(self, ids) -> str:
        text = b"".join(map(self.v.text.__getitem__, ids)).decode("utf-8", "surrogatepass").replace(MARK, " ")
        return text[1:] if self.v.prefix and text.startswith(" ") else text


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each vocabulary and worker; its memory serves one task."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the ids of every whole text.  A null or empty text has no ids; other columns stay (one named as `ids` is replaced).

    Repeated rows are encoded each, an empty table gives an empty one.
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model)
        try:
            for batch in texts:
                yield pd.Series([x for _, ids in c.steps(batch) for x in ids], dtype=object)
        finally:
            c.forget()

    return docs.withColumn(ids, F.pandas_udf(run, "array<int>")(F.col(text)))


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Adds the text of every list of ids.  A missing list gives an empty text, a missing id no letters; an empty table stays empty."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = codec(model)
        for batch in batches:
            yield pd.Series([c.decode([int(i) for i in x if i == i and i is not None]) if x is not None else "" for x in batch], dtype=object)

    return rows.withColumn(text, F.pandas_udf(run, "string")(F.col(ids)))


def round_trips(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_ids, ids_crc32 (ids as little-endian 32-bit), text_crc32 of the decoded text, round_trip.

    Encodes and decodes within one pass over the texts, without a shuffle.  A null text counts as empty and has no ids.  Repeated
    rows and null doc_ids each give a row, an empty table gives none, further columns are ignored.
    """
    schema = "n_ids long, ids_crc32 long, text_crc32 long, round_trip boolean"

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = codec(model)
        try:
            for batch in texts:
                rows = []
                for own, coded in c.steps(batch):
                    for text, ids in zip(own, coded, strict=True):
                        back = c.decode(ids.tolist())
                        rows.append((len(ids), zlib.crc32(ids.tobytes()), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == text))
                yield pd.DataFrame(rows, columns=["n_ids", "ids_crc32", "text_crc32", "round_trip"])
        finally:
            c.forget()

    return bare(docs, "doc_id", "text").withColumn("coded", F.pandas_udf(run, schema)("text")).select("doc_id", "coded.*")


def op1_sentencepieces(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    return round_trips(spark.read.parquet(f"{sf_dir}/documents.parquet"), model or tokenizer_path("piece_bpe_32k.model"))
