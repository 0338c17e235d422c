"""Token ids as grammar-compressed shard files: encode, write, read back.

Each shard holds the ids of some thousand consecutive documents.  Re-Pair runs on the shard: frequent adjacent id
pairs become nonterminals, again and again, until no pair is frequent.  A file row keeps the rules, the expansion
length of every nonterminal and the reduced sequence, so any document can be decoded without the others.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.common import bare, mix, partitions, passes, stored, utf8

END_ID = 2
#: Ids of a shard (a longer document makes a longer shard).
SHARD_TOKENS = 1 << 18
#: A pair is frequent, and replaced, while it occurs so often in the shard.  A rule and its length take the bytes of four symbols; files are smallest at 6 (0.7 % below 8, which takes a tenth less time).
MIN_PAIR = 8
#: First nonterminal; every id of a vocabulary is below it.
FIRST_RULE = 1 << 17
#: Words that aren't plain, and pieces of plain ones, whose ids a worker remembers from task to task, about 200 bytes each; this bounds memory only.
CACHE_WORDS, CACHE_PIECES = 200_000, 600_000
#: Shards up to which their begins (some 30 bytes each) are broadcast to the readers; beyond it the payloads are shuffled to them.
BROADCAST_SHARDS = 500_000
#: Bytes of text that are encoded at a time.
STEP_BYTES = 16 << 20
_MAGIC = b"RPGS1\0\0\0"

FILE_SCHEMA = "part int, seq int, first_doc long, n_docs int, n_tokens long, payload binary"


# -- grammar ------------------------------------------------------------------------------------------------------


def _sorted_pairs(left: np.ndarray, right: np.ndarray, places: np.ndarray, most: int, n: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Pairs (left << bits | right) in ascending order with their places, of equal pairs in the order of place, and bits; repeated places count once.

    Symbols are most at most, places below n.
    """
    bits, shift = most.bit_length(), np.uint64(n.bit_length())
    if 2 * bits + n.bit_length() > 64:
        pairs = left.astype(np.uint64) << np.uint64(32) | right
        order = np.lexsort((places, pairs))
        pairs, places = pairs[order], places[order]
        once = np.concatenate(([True], places[1:] != places[:-1]))
        return pairs[once], places[once], np.uint64(32)
    # pair and place in one number, which sorts several times faster
    keys = left.astype(np.uint64)
    keys <<= np.uint64(bits)
    keys |= right
    keys <<= shift
    keys |= places.view(np.uint64)
    keys.sort()
    once = np.ones(len(keys), bool)
    np.not_equal(keys[1:], keys[:-1], out=once[1:])
    if not once.all():
        keys = keys[once]
    places = (keys & np.uint64((1 << int(shift)) - 1)).view(np.int64)
    keys >>= shift
    return keys, places, np.uint64(bits)


def compress(ids: np.ndarray, min_pair: int = MIN_PAIR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair in rounds: (rules as rows of two symbols, ids to which each rule expands, reduced sequence).

    A round counts the pairs and replaces all frequent ones that don't compete: a symbol may be the left half of chosen
    pairs or the right half, not both, so that no two chosen occurrences overlap.  The rounds end when no pair occurs
    min_pair times any more.  A pair of old symbols never gains occurrences, so a place whose pair was rare once is looked at
    again only after one of its symbols was replaced.
    """
    n = len(ids)
    seq = np.append(ids, 0).astype(np.uint32)
    # neighbours of the symbols that are left; place n is behind the end
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    gone = np.zeros(n + 1, bool)
    places = np.arange(n - 1)
    made, rules, spans = 0, [], np.ones(1024, np.int64)  # spans: of any id, then of each rule
    while len(places) >= min_pair:
        pairs, places, bits = _sorted_pairs(seq[places], seq[after[places]], places, FIRST_RULE + made, n)
        edge = np.concatenate(([0], np.flatnonzero(pairs[1:] != pairs[:-1]) + 1, [len(pairs)]))
        counts = np.diff(edge)
        frequent = counts >= min_pair
        kinds = pairs[edge[:-1]][frequent]
        places = places[np.repeat(frequent, counts)]
        counts = counts[frequent]
        if not len(kinds):
            break
        slot = np.repeat(np.arange(len(kinds)), counts)
        left, right = (kinds >> bits).astype(np.uint32), (kinds & np.uint64((1 << int(bits)) - 1)).astype(np.uint32)
        # a symbol takes the side on which its frequent pairs weigh more, and changes sides from round to round where they weigh alike
        symbols, side = np.unique(np.concatenate((left, right)), return_inverse=True)
        more = np.bincount(side[: len(left)], counts, len(symbols)) - np.bincount(side[len(left) :], counts, len(symbols))
        opens = (more > 0) | ((more == 0) & (mix(symbols.astype(np.uint64) << np.uint64(32) | np.uint64(made)) & np.uint64(1) == 0))
        chosen = opens[side[: len(left)]] & ~opens[side[len(left) :]]
        if not chosen.any():  # all sides agree, as for runs of one symbol: take the most frequent pair alone
            chosen[np.argmax(counts)] = True
        hit = chosen[slot]
        at, slot = places[hit], slot[hit]
        if left[chosen][0] == right[chosen][0]:  # a pair of one symbol overlaps itself: every second start of a run
            run = np.concatenate(([0], np.cumsum(after[at[:-1]] != at[1:])))
            second = (np.arange(len(at)) - np.searchsorted(run, run)) % 2 == 0
            if second.sum() < min_pair:  # too rare without overlaps
                places = places[~hit]
                continue
            at, slot = at[second], slot[second]
        fresh = np.column_stack((left[chosen], right[chosen]))
        seq[at] = (FIRST_RULE + made + (np.cumsum(chosen) - 1)[slot]).astype(np.uint32)
        if made + len(fresh) >= len(spans):
            spans = np.concatenate((spans, np.ones(made + len(fresh), np.int64)))
        spans[made + 1 : made + 1 + len(fresh)] = spans[np.maximum(fresh.astype(np.int64) - (FIRST_RULE - 1), 0)].sum(1)
        rules.append(fresh)
        made += len(fresh)
        gone[after[at]] = True
        after[at] = after[after[at]]
        before[after[at]] = at
        places = np.concatenate((places[~(hit | gone[places])], at[after[at] < n], (ahead := before[at])[ahead >= 0]))
    return np.concatenate((np.empty((0, 2), np.uint32), *rules)), spans[1 : made + 1], seq[:n][~gone[:n]]


def expand(rules: np.ndarray, spans: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """The ids that a sequence of symbols stands for: the expansions of all rules are laid out once, then copied."""
    if not len(rules):
        return seq
    begins = np.cumsum(spans) - spans
    table = np.repeat(np.arange(FIRST_RULE, FIRST_RULE + len(rules), dtype=np.uint32), spans)  # first symbol of what is still to open
    open_ = np.arange(len(rules), dtype=np.int64)
    at = begins
    while len(open_):  # a round opens the symbols at these places of the table by one step
        left, right = rules[open_, 0], rules[open_, 1]
        skip = np.where(left < FIRST_RULE, 1, spans[np.maximum(left.astype(np.int64) - FIRST_RULE, 0)])
        table[at], table[at + skip] = left, right
        at, symbols = np.concatenate((at, at + skip)), np.concatenate((left, right))
        more = symbols >= FIRST_RULE
        at, open_ = at[more], symbols[more].astype(np.int64) - FIRST_RULE
    rule = np.where(seq >= FIRST_RULE, seq.astype(np.int64) - FIRST_RULE, -1)
    size = np.where(rule >= 0, spans[rule], 1)
    ends = np.cumsum(size)
    source = np.where(rule >= 0, begins[rule], len(table) + np.arange(len(seq)))
    return np.concatenate((table, seq))[np.repeat(source - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


# -- file format --------------------------------------------------------------------------------------------------


def pack(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """A shard: head, doc ids, ends of the documents in ids, rules, lengths of the rules, reduced sequence."""
    rules, spans, seq = compress(ids)
    head = _MAGIC + struct.pack("<4q", len(doc_ids), len(ids), len(rules), len(seq))
    return head + doc_ids.astype("<i8").tobytes() + ends.astype("<i8").tobytes() + rules.astype("<u4").tobytes() + spans.astype("<i8").tobytes() + seq.astype("<u4").tobytes()


class Shard:
    """A packed shard, read by the places of its parts."""

    def __init__(self, payload: bytes):
        if payload[:8] != _MAGIC:
            raise ValueError("not a shard of token ids")
        docs, self.n_tokens, rules, seq = struct.unpack_from("<4q", payload, 8)
        at = 40
        self.doc_ids = np.frombuffer(payload, "<i8", docs, at)
        self.ends = np.frombuffer(payload, "<i8", docs, at := at + 8 * docs)
        self.rules = np.frombuffer(payload, "<u4", 2 * rules, at := at + 8 * docs).reshape(-1, 2)
        self.spans = np.frombuffer(payload, "<i8", rules, at := at + 8 * rules)
        self.seq = np.frombuffer(payload, "<u4", seq, at + 8 * rules)

    def all(self) -> np.ndarray:
        return expand(self.rules, self.spans, self.seq)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document: only the symbols that cover it are expanded."""
        size = np.ones(len(self.seq), np.int64)
        nonterminal = self.seq >= FIRST_RULE
        size[nonterminal] = self.spans[self.seq[nonterminal] - FIRST_RULE]
        stops = np.cumsum(size)
        lo, hi = (self.ends[k - 1] if k else 0), self.ends[k]
        first, last = np.searchsorted(stops, lo, "right"), np.searchsorted(stops, hi, "left")
        skip = lo - (stops[first] - size[first]) if first < len(stops) else 0
        return expand(self.rules, self.spans, self.seq[first : last + 1])[skip : skip + hi - lo]


# -- words --------------------------------------------------------------------------------------------------------

# Fixed values of the tokenizer file whose words are encoded once each: how it cuts a text, and the end of a word.
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"
#: Words of letters that have one form and one lower case each (ASCII, Latin-1 and Latin Extended-A), digits and signs ...
_PLAIN = "^[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-įĲ-ſ]+$"
#: ... and the same cut for them, once they are in lower case, with a line end after each.
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-ſ]+|[0-9]|[^a-z0-9\xdf-\xf6\xf8-ſ\n]+|\n")
#: Stands for the line end among ids; no vocabulary has it.
_MARK = 0xFFFFFFFF


def _byte_letters() -> dict[int, int]:
    """Letters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in printable)}


class _Pieces(dict):
    """Ids of the pieces of words, from the tokenizer's model, as little-endian 32-bit bytes."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.letters = tokenizer.model, _byte_letters()

    def __missing__(self, piece: str) -> bytes:
        tokens = self.model.tokenize(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters))
        self[piece] = out = struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return out

    def of(self, lines: str) -> np.ndarray:
        """Ids of plain words, each on a line of its own that ends, with _MARK after those of each word."""
        if len(self) > CACHE_PIECES:
            self.clear()
        self["\n"] = struct.pack("<I", _MARK)
        return np.frombuffer(b"".join(map(self.__getitem__, _PIECE.findall(lines.lower()))), "<u4")


def _lines(words) -> str:
    """The words of an Arrow array (those of one step, so below 2 GB), a line end after each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), "\n")[0].as_py()
    return joined + "\n" if len(words) else ""


class WordEncoder:
    """Texts in UTF-8 -> ids as little-endian 32-bit bytes, as the tokenizer gives them without special tokens added.

    Where the tokenizer drops white space and never joins across it (the word vocabulary), each distinct word is encoded once: plain
    words from their pieces, which many words share and which are remembered, all others through the library, and are remembered.
    Other tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        cut = json.dumps(file.get("pre_tokenizer")) if file.get("pre_tokenizer") else ""
        self.by_words = json.dumps(_CUT)[1:-1] in cut and file["model"].get("end_of_word_suffix") == _WORD_END
        self.special = re.compile("|".join(re.escape(t["content"]) for t in file.get("added_tokens", [])) or r"(?!)")
        self.words: dict[str, bytes] = {}
        self.pieces = _Pieces(self.tokenizer)

    def _library(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _others(self, words: list[str]) -> list[bytes]:
        """Ids of words that aren't plain."""
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        self.words.update(zip(new, self._library([w.encode() for w in new]), strict=True))
        return [self.words[w] for w in words]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return self._library(texts)
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.ascii_split_whitespace(pa.array([t.decode("utf-8", "replace") for t in texts], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        plain = pc.match_substring_regex(distinct, _PLAIN).to_numpy(zero_copy_only=False)
        signed = np.flatnonzero(pc.match_substring(distinct, "<").to_numpy(zero_copy_only=False))
        plain[[k for k in signed.tolist() if self.special.search(distinct[k].as_py())]] = False
        marked = self.pieces.of(_lines(distinct.filter(pa.array(plain))))
        others = self._others(distinct.filter(pa.array(~plain)).to_pylist())
        ids = np.concatenate((marked, np.frombuffer(b"".join(others), "<u4")))
        # where a word's ids begin, and how many they are
        first, sizes = np.empty((2, len(distinct)), np.int64)
        marks = np.flatnonzero(marked == _MARK)
        first[plain] = np.concatenate(([0], marks[:-1] + 1)) if len(marks) else 0
        sizes[plain] = marks - first[plain]
        other = np.fromiter(map(len, others), np.int64, len(others)) >> 2
        first[~plain], sizes[~plain] = len(marked) + np.cumsum(other) - other, other
        begins, n = first[at], sizes[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        out = ids[np.repeat(begins - ends[:-1], n) + np.arange(ends[-1])].tobytes()
        bounds = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]


#: Encoders of this worker, by vocabulary: what they remember serves all its tasks.
_encoders: dict[str, WordEncoder] = {}


def word_encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


# -- Spark jobs ---------------------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Rows of the file format, in ascending doc_id order over (part, seq).

    docs: doc_id, text; further columns are ignored.  A null or empty text is the end id alone; an empty table gives no shard.
    Rows without doc_id have no place in the order and are left out.  Rows of equal doc_id are documents of their own, in no fixed order.
    """

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode, part, seq = word_encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        ids: list[int] = []
        runs: list[bytes] = []
        held = 0

        def flush() -> pd.DataFrame:
            nonlocal ids, runs, held, seq
            sizes = np.array([len(r) // 4 for r in runs], np.int64)
            payload = pack(np.array(ids, np.int64), np.cumsum(sizes), np.frombuffer(b"".join(runs), "<u4"))
            row = pd.DataFrame({"part": [part], "seq": [seq], "first_doc": [ids[0]], "n_docs": [len(ids)], "n_tokens": [int(sizes.sum())], "payload": [payload]})
            ids, runs, held, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            texts = utf8(batch["text"])
            for lo, hi in passes(texts, STEP_BYTES):
                for doc, run in zip(batch["doc_id"][lo:hi], encode(texts[lo:hi]), strict=True):
                    ids.append(doc)
                    runs.append(run + end)
                    held += len(run) // 4 + 1
                    if held >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()

    ordered = bare(docs, "doc_id", "text").filter("doc_id is not null").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInPandas(build, FILE_SCHEMA)


def read_shards(files: DataFrame) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row for each part
    earlier = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.select("part", earlier.alias("before_part"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = files.select("part", "seq", within.alias("before_shard")).join(F.broadcast(parts), "part").select("part", "seq", (F.col("before_part") + F.col("before_shard")).alias("begin"))
    # three numbers for each shard: beside its payload of 100,000 bytes and more that is little enough to broadcast up to some millions of shards
    few = files.count() <= BROADCAST_SHARDS

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for begin, payload in zip(batch["begin"], batch["payload"], strict=True):
                shard = Shard(payload)
                ids, ends = memoryview(shard.all().astype("<u4").tobytes()), shard.ends
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
                yield pd.DataFrame({"doc_id": shard.doc_ids, "start": begin + starts, "n_tokens": ends - starts, "ids_crc32": crc})

    rows = files.select("part", "seq", "payload").join(F.broadcast(begins) if few else begins, ["part", "seq"]).select("begin", "payload")
    return rows.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """All documents as token files in the shared folder, and the digests that reading them back gives."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(stored(write_shards(docs, tokenizer or tokenizer_path("word_bpe_49k.json")), "token-shards"))


def tokenizer_path(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)
