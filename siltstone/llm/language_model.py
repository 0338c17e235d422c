"""Language-model scores by context-tree weighting over bytes.

A text is modelled as its lower-cased tokens: the bytes of a word and a space, at last one end byte.  The next byte is
decomposed into eight bits; each of its 255 bit nodes has a context tree whose first symbol is a class of documents and whose
further ones are the last DEPTH bytes of the token (the bytes before the token's begin are spaces).  Every tree node keeps a
Krichevsky-Trofimov estimate, and the weighting mixes all depths: Pw = (Pe + product of the children's Pw) / 2.  Learning is
frozen before scoring, so a token's probability within a class is a function of its bytes.  Classes are the languages of the
training documents; the text's own is never looked at: a text's probability mixes the classes anew over each CHUNK tokens.

Counts follow from the distinct tokens, so the corpus is read once for them.  The contexts that share class and two bytes
are weighted together, one of the eight bits after the other, what lies above them with group-bys and joins.  Nothing that
grows with the vocabulary is broadcast: blocks of documents (and blocks of the vocabulary) ask for the distinct tokens
(and contexts) that they hold.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bare, is_held, partitions, stored, utf8, with_blocks

DEPTH = 5
#: Symbols (class, two bytes) of the contexts at which the tree is cut in two.
CUT = 3
#: Classes at most; the rarer languages share the last one.
CLASSES = 12
#: Tokens over which the classes keep their weights, and the share of the weights that is dealt anew after them.
CHUNK, SHARE = 16, 0.02
#: Bytes of text in one block of documents, and tokens in one block of the vocabulary.
BLOCK_BYTES = 20 << 20
BLOCK_TOKENS = 50_000
#: Tokens (their first bytes) for each block of the vocabulary from which the blocks' bounds are taken; they decide sizes, never a result.
SAMPLE_TOKENS, SAMPLE_BYTES = 32, 1024
_LN10 = float(np.log(10))


def tokens_of(text: bytes) -> list[bytes]:
    """Lower-cased words, then one end, which is the empty token."""
    words = text.lower().split()
    words.append(b"")
    return words


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x >= 0.5: Stirling's series at x + 8, stepped back."""
    shift = np.ones_like(x)
    for k in range(8):
        shift = shift * (x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with so many zeros and ones."""
    a, b = np.asarray(zeros, float), np.asarray(ones, float)
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1) - float(np.log(np.pi))


def _bytes_and_contexts(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For all bytes of the tokens in turn: context << 8 | byte, and the token's number.  The latest byte of a context is its lowest."""
    pad = b" " * DEPTH
    data = np.frombuffer(b"".join([pad + t + b" " if t else pad + b"\0" for t in tokens]), np.uint8).astype(np.int64)
    sizes = np.array([len(t) + 1 for t in tokens])
    owner = np.repeat(np.arange(len(tokens)), sizes + DEPTH)
    starts = np.cumsum(sizes + DEPTH) - (sizes + DEPTH)
    real = np.arange(len(data)) - starts[owner] >= DEPTH
    at = np.flatnonzero(real)
    grams = data[at].copy()
    for j in range(1, DEPTH + 1):
        grams |= data[at - j] << (8 * j)
    return grams, owner[real]


# -- the tree -----------------------------------------------------------------------------------------------------


class _Levels:
    """The tree levels from the leaves up to depth CUT for the k-th bit of the grams given, of all classes.

    Nodes of different bits share nothing, so a bucket's bits are weighted in turn, in an eighth of the memory.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, k: int):
        """grams: context << 8 | byte.  counts: a column for each class."""
        classes = counts.shape[1]
        keys = np.repeat(grams, classes)
        contexts = (keys >> 8) << 8 | np.tile(np.arange(classes), len(grams))
        byte = keys & 255
        self.bit = (byte >> (7 - k)) & 1
        n = counts.ravel().astype(float)
        self.keys, self.at = np.unique(contexts << 8 | 1 << k | byte >> (8 - k), return_inverse=True)
        zeros, ones = (np.bincount(self.at, n * (self.bit == b), len(self.keys)) for b in (0, 1))
        log_pw = log_kt(zeros, ones)
        #: from the leaves: (weight of stopping here, estimate, place of each node's parent)
        self.levels = [(np.ones(len(self.keys)), (ones + 0.5) / (zeros + ones + 1))]
        self.parents = []
        keys = self.keys
        for depth in range(DEPTH, CUT - 1, -1):
            keys, place = np.unique((keys >> 8 & ((1 << 8 * depth) - 1)) << 8 | keys & 255, return_inverse=True)
            self.parents.append(place)
            zeros, ones, below = (np.bincount(place, x, len(keys)) for x in (zeros, ones, log_pw))
            log_pe = log_kt(zeros, ones)
            self.levels.append((1 / (1 + np.exp(np.minimum(below - log_pe, 700))), (ones + 0.5) / (zeros + ones + 1)))
            log_pw = np.logaddexp(log_pe, below) - np.log(2)
        self.top, self.zeros, self.ones, self.log_pw = keys, zeros, ones, log_pw

    def log_p(self, p: np.ndarray, left: np.ndarray) -> np.ndarray:
        """ln probability of the bit of each gram in each class; p and left are what the levels above CUT give the top nodes."""
        for (weight, kt), place in zip(reversed(self.levels), [None, *reversed(self.parents)], strict=True):
            if place is not None:
                p, left = p[place], left[place]
            p, left = p + left * weight * kt, left * (1 - weight)
        p = p[self.at]
        return np.log(np.where(self.bit == 1, p, 1 - p))


def _weigh(zeros: pd.Series, ones: pd.Series, below: pd.Series) -> pd.DataFrame:
    a, b, c = (x.to_numpy(float) for x in (zeros, ones, below))
    log_pe = log_kt(a, b)
    return pd.DataFrame({"log_pw": np.logaddexp(log_pe, c) - np.log(2), "weight": 1 / (1 + np.exp(np.minimum(c - log_pe, 700))), "kt": (b + 0.5) / (a + b + 1)})


def context_tree(grams: DataFrame, classes: int) -> DataFrame:
    """grams: gram (context << 8 | byte), c0, c1, ... counts by class.  Returns gram, log_p: ln probabilities by class.

    Grams without counts are not learnt from, but get their probabilities too.
    """
    columns = [f"c{k}" for k in range(classes)]
    parts = partitions(grams.sparkSession)
    # contexts of equal last two bytes together
    dealt = grams.withColumn("bucket", F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))), F.lit(parts)).cast("int"))

    def up(key, batch: pd.DataFrame) -> pd.DataFrame:
        tops = []
        for k in range(8):
            x = _Levels(batch["gram"].to_numpy(np.int64), batch[columns].to_numpy(np.int64), k)
            tops.append(pd.DataFrame({"bucket": np.full(len(x.top), key[0], np.int32), "context": x.top >> 8, "node": x.top & 255, "zeros": x.zeros, "ones": x.ones, "log_pw": x.log_pw}))
        return pd.concat(tops)

    top = stored(dealt.groupBy("bucket").applyInPandas(up, "bucket int, context long, node int, zeros double, ones double, log_pw double"), "tree-top")
    weigh = F.pandas_udf(_weigh, "log_pw double, weight double, kt double")
    levels, below = [], top
    for depth in range(CUT - 1, -1, -1):
        parent = F.col("context").bitwiseAND(F.lit((1 << (8 * depth)) - 1).cast("long"))
        sums = below.groupBy(parent.alias("context"), "node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_pw").alias("below"))
        below = stored(sums.withColumn("w", weigh("zeros", "ones", "below")).select("context", "node", "zeros", "ones", "w.*"), f"tree-{depth}")
        levels.append(below)
    down = levels[-1].select("context", "node", (F.col("weight") * F.col("kt")).alias("p"), (1 - F.col("weight")).alias("left"))
    for depth in range(1, CUT):
        parent = F.col("context").bitwiseAND(F.lit((1 << (8 * (depth - 1))) - 1).cast("long"))
        child = levels[CUT - 1 - depth].select("context", "node", "weight", "kt", parent.alias("parent"))
        down = child.join(down.withColumnRenamed("context", "parent"), ["parent", "node"]).select("context", "node", (F.col("p") + F.col("left") * F.col("weight") * F.col("kt")).alias("p"), (F.col("left") * (1 - F.col("weight"))).alias("left"))
    parent = F.col("context").bitwiseAND(F.lit((1 << (8 * (CUT - 1))) - 1).cast("long"))
    above = top.select("bucket", "context", "node", parent.alias("parent")).join(down.withColumnRenamed("context", "parent"), ["parent", "node"]).select("bucket", "context", "node", "p", "left")

    def finish(batch: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame({"gram": [], "log_p": []})
        grams, counts = batch["gram"].to_numpy(np.int64), batch[columns].to_numpy(np.int64)
        keys, p, left = tops["context"].to_numpy(np.int64) << 8 | tops["node"].to_numpy(np.int64), tops["p"].to_numpy(float), tops["left"].to_numpy(float)
        order = np.argsort(keys)
        keys, p, left = keys[order], p[order], left[order]
        total = np.zeros(len(grams) * classes)
        for k in range(8):
            own = (keys & 255) >> k == 1
            total += _Levels(grams, counts, k).log_p(p[own], left[own])
        return pd.DataFrame({"gram": batch["gram"], "log_p": list(total.reshape(-1, classes))})

    return dealt.groupBy("bucket").cogroup(above.groupBy("bucket")).applyInPandas(finish, "gram long, log_p array<double>")


def vocabulary_bounds(sample: list[bytes], parts: int) -> list[bytes]:
    """First tokens of all blocks of the vocabulary but the first one: ranges that hold about as many bytes each.

    Tokens with a common begin have most contexts in common, so a range asks for half as many as a block dealt by hashes.
    """
    tokens = sorted(sample)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    return [tokens[k] for k in np.unique(np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts, "right"))] if tokens else []


# -- corpus -------------------------------------------------------------------------------------------------------


def _packed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Texts for the shuffle by blocks, each compressed."""
    import zstandard

    for batch in texts:
        squeeze = zstandard.ZstdCompressor(level=6, write_content_size=True)
        yield pd.Series([squeeze.compress(t.lower()) for t in utf8(batch)], dtype=object)


def unpacked(column) -> list[bytes]:
    import zstandard

    loosen = zstandard.ZstdDecompressor()
    return [loosen.decompress(bytes(p)) for p in column]


def _classes(rows: DataFrame) -> list:
    """Languages of the training documents, the most frequent first; rarer ones and nulls share a last class (None)."""
    found = rows.filter("not held_out").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(CLASSES).collect()
    named = [r["lang"] for r in found if r["lang"] is not None]
    others = len(named) < len(found) or len(named) == CLASSES
    return [*named[: CLASSES - 1], None] if others or not named else named


def mixed(chunks: np.ndarray, counts: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """ln probability of each text from the ln probabilities of its chunks (rows) in each class (columns).

    After each chunk the weights follow Bayes, and SHARE of them is dealt anew by the prior.
    """
    first = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    total, weights = np.zeros(len(counts)), np.tile(prior, (len(counts), 1))
    for step in range(int(counts.max(initial=0))):
        live = order[: np.searchsorted(-counts[order], -step)]
        joint = np.log(weights[live]) + chunks[first[live] + step]
        peak = joint.max(1, keepdims=True)
        raw = np.exp(joint - peak)
        sums = raw.sum(1, keepdims=True)
        total[live] += (peak + np.log(sums))[:, 0]
        weights[live] = (1 - SHARE) * raw / sums + SHARE * prior
    return total


def score(docs: DataFrame, held_out, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Learns from the rows where held_out (a condition on doc_id) is false and scores all.

    docs: doc_id, text, lang.  A null or empty text is the end alone; a null lang is a class of its own.  Without training
    rows V and N are 0 and the base of any token is 1.  Repeated rows count each.  An empty table gives an empty result.
    Where the condition is null (a null doc_id), the row is held out.  bits_per_byte: the model's code length of a text over
    the bytes that it models, those of the lower-cased tokens and one after each.
    """
    rows = with_blocks(bare(docs, "doc_id", "text", "lang").withColumn("held_out", F.coalesce(held_out, F.lit(True))), block_bytes)
    names = _classes(rows)
    rows = rows.withColumn("packed", F.pandas_udf(_packed, "binary")("text")).drop("text")
    classes = len(names)
    columns = [f"c{k}" for k in range(classes)]
    fields = ", ".join(f"{c} long" for c in columns)
    place = {name: k for k, name in enumerate(names)}

    def count(key, batch: pd.DataFrame) -> pd.DataFrame:
        """Distinct tokens of a block of documents, with their counts in its training texts."""
        seen, learnt = Counter(), [Counter() for _ in names]
        for text, lang, held in zip(unpacked(batch["packed"]), batch["lang"], batch["held_out"], strict=True):
            (seen if held else learnt[place.get(lang, classes - 1)]).update(tokens_of(text))
        tokens = sorted(set().union(seen, *learnt))
        return pd.DataFrame({"block": np.full(len(tokens), key[0], np.int32), "k": np.arange(len(tokens), dtype=np.int32), "token": tokens} | {c: [n[t] for t in tokens] for c, n in zip(columns, learnt, strict=True)})

    def gram_counts(key, batch: pd.DataFrame) -> pd.DataFrame:
        grams, owner = _bytes_and_contexts([bytes(t) for t in batch["token"]])
        kinds, at = np.unique(grams, return_inverse=True)
        return pd.DataFrame({"part": np.full(len(kinds), key[0], np.int32), "gram": kinds} | {c: np.bincount(at, batch[c].to_numpy(float)[owner], len(kinds)).astype(np.int64) for c in columns})

    def token_scores(batch: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(batch):
            return pd.DataFrame({"token": [], "n": [], "log_p": []})
        grams, owner = _bytes_and_contexts([bytes(t) for t in batch["token"]])
        order = np.argsort(known["gram"].to_numpy(np.int64))
        place = order[np.searchsorted(known["gram"].to_numpy(np.int64)[order], grams)]
        values = np.stack(known["log_p"].to_numpy())
        sums = np.column_stack([np.bincount(owner, values[place, k], len(batch)) for k in range(classes)])
        return pd.DataFrame({"token": batch["token"], "n": batch[columns].sum(axis=1), "log_p": [x.tobytes() for x in sums.astype("<f4")]})

    asked = stored(rows.groupBy("block").applyInPandas(count, f"block int, k int, token binary, {fields}"), "tokens")
    vocabulary = stored(asked.groupBy("token").agg(*[F.sum(c).alias(c) for c in columns]), "vocabulary")
    every = sum((F.col(c) for c in columns), F.lit(0))
    sums = vocabulary.agg(F.count("*").alias("all"), F.sum((every > 0).cast("long")).alias("v"), *[F.sum(c).alias(c) for c in columns]).first()
    by_class = np.array([sums[c] or 0 for c in columns], float)
    n_train, v_train = int(by_class.sum()), int(sums["v"] or 0)
    prior = (by_class + 1) / (by_class + 1).sum()
    parts = max(1, -(-sums["all"] // BLOCK_TOKENS), partitions(docs.sparkSession))
    sample = vocabulary.sample(min(1.0, SAMPLE_TOKENS * parts / max(sums["all"], 1)), seed=0).select(F.substring("token", 1, SAMPLE_BYTES).alias("t"))
    bounds = vocabulary_bounds([bytes(r["t"]) for r in sample.toLocalIterator()], parts)

    def part_of(tokens: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(bounds, bytes(t)) for t in tokens], dtype="int32")

    vocabulary = vocabulary.withColumn("part", F.pandas_udf(part_of, "int")("token"))
    held = stored(vocabulary.groupBy("part").applyInPandas(gram_counts, f"part int, gram long, {fields}"), "grams")
    grams = stored(held.groupBy("gram").agg(*[F.sum(c).alias(c) for c in columns]), "gram-sums")
    told = held.select("part", "gram").join(context_tree(grams, classes), "gram")
    scored = vocabulary.groupBy("part").cogroup(told.groupBy("part")).applyInPandas(token_scores, "token binary, n long, log_p binary")
    # a block knows its k-th token, so the answer needs no text
    answers = asked.select("block", "k", "token").join(scored, "token").select("block", "k", "n", "log_p")

    def finish(batch: pd.DataFrame, tokens: pd.DataFrame) -> pd.DataFrame:
        out = ["n_tokens", "n_known", "train_tokens", "base_score"]
        if not len(batch):
            return pd.DataFrame({c: [] for c in ["doc_id", "held_out", *out, "score", "bits_per_byte"]})
        # texts are split twice, as a block's words at once would take many times the space of its texts
        texts = unpacked(batch["packed"])
        distinct: set[bytes] = set()
        for text in texts:
            distinct.update(tokens_of(text))
        at_token = {t: k for k, t in enumerate(sorted(distinct))}
        del distinct
        order = np.argsort(tokens["k"].to_numpy())
        counts = tokens["n"].to_numpy(np.int64)[order]
        base = np.log10((counts + 1) / (n_train + 1 * (v_train + 1)))
        model = np.frombuffer(b"".join(tokens["log_p"]), "<f4").reshape(-1, classes)[order].astype(float)
        size = np.fromiter((len(t) + 1 for t in at_token), np.int64)
        out_rows, chunks, modelled = [], [], []
        for text in texts:
            at = np.fromiter(map(at_token.__getitem__, tokens_of(text)), np.int64)
            out_rows.append((len(at), int((counts[at] > 0).sum()), n_train, float(base[at].sum())))
            chunks.append(np.add.reduceat(model[at], np.arange(0, len(at), CHUNK)))
            modelled.append(size[at].sum())
        total = mixed(np.concatenate(chunks), np.array([len(c) for c in chunks]), prior)
        table = pd.DataFrame(out_rows, columns=out).assign(score=total / _LN10, bits_per_byte=-total / np.log(2) / np.array(modelled))
        return pd.concat([batch[["doc_id", "held_out"]].reset_index(drop=True), table], axis=1)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(finish, schema)


def op6_language_model(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), is_held("doc_id", 7, 2))
