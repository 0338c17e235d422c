"""Language of a text by cross-parsing: which language's own text makes it up of the fewest phrases.

For every language a suffix automaton holds all substrings of a sample of its labelled texts.  A text is parsed from left to right
into phrases, each the longest match that the automaton still knows; a letter that it doesn't know is a phrase by itself.  c
phrases of a text of m letters, against a sample of n letters, cost c * log2(n) / m bits a letter, an estimate of the
cross entropy; the language of the least cost wins.

Letters are lower-cased, a run of anything else is one space, and automata work on UTF-8 bytes, so that one small table serves every
script.  All automata walk many texts at once, one letter of each at a step; for this a text is parsed in stretches of
STRETCH bytes, at whose ends phrases end too, whatever the language.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bare, is_held, passes

#: Letters of the sample of one language, and of all languages together: with few languages each has its whole share.
SAMPLE_LETTERS, ALL_LETTERS = 1 << 16, 1 << 19
#: A text gives a sample so many letters at most, from a place that its hash chooses.
PIECE_LETTERS = 1500
#: Languages that can be learnt: those with the most labelled texts.
MOST_LANGUAGES = 128
#: Bytes of a text that are parsed in one go, and stretches that walk side by side.
STRETCH, LANES = 2048, 4096
#: Phrases of evidence that count as one in the score: neighbouring phrases aren't independent.
SHARED_EVIDENCE = 4.0
NO_LANGUAGE = "und"

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """Lower-case letters in UTF-8 with one space for everything between them; empty without letters."""
    return _OTHER.sub(" ", text.lower()).strip().encode("utf-8", "surrogatepass") if text else b""


# -- suffix automaton ---------------------------------------------------------------------------------------------


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of every state; a string leads from state 0 to a state exactly if it occurs in the symbols."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        state = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] == length[p] + 1:
                link[state] = q
            else:  # the longer strings of q keep it, the others get a copy
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[state] = copy
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
        last = state
    return moves


class Model:
    """The automata of all languages in one table: a row for each state, a column for each byte that occurs."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.samples = {k: v for k, v in sorted(samples.items()) if any(v)}
        self.languages = list(self.samples)
        used = sorted(set().union(*(t for v in self.samples.values() for t in v), b" "))
        # column 0: a byte that occurs nowhere; the last one: an end of a sample's text, which no text holds
        self.columns = len(used) + 2
        self.column = np.zeros(256, np.uint8 if self.columns < 256 else np.uint16)
        self.column[used] = np.arange(1, len(used) + 1)
        rows, roots = [], []
        for texts in self.samples.values():
            joined: list[int] = []
            for t in texts:
                joined += [*self.column[np.frombuffer(b" " + t + b" ", np.uint8)].tolist(), self.columns - 1]
            root = sum(map(len, rows))
            roots.append(root)
            moves = suffix_automaton(joined)
            table = np.full((len(moves), self.columns), -1, np.int32)
            for s, own in enumerate(moves):
                table[s, list(own)] = np.fromiter(own.values(), np.int32, len(own)) + root
            rows.append(table)
        self.roots = np.array(roots, np.int32)
        self.table = np.concatenate(rows).ravel() if rows else np.empty(0, np.int32)
        self.bits = np.log2([sum(map(len, v)) + 1 for v in self.samples.values()])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases (rows: texts, columns: languages) of texts in the form of `letters`."""
        owner, begin, size = [], [], []
        data = self.column[np.frombuffer(b"".join(b" " + t + b" " for t in texts) + b" ", np.uint8)]
        at = 0
        for k, t in enumerate(texts):
            stops = range(0, len(t) + 2, STRETCH)
            owner += [k] * len(stops)
            begin += [at + s for s in stops]
            size += [min(STRETCH, len(t) + 2 - s) for s in stops]
            at += len(t) + 2
        owner, begin, size = np.array(owner, np.int64), np.array(begin, np.int64), np.array(size, np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        order = np.argsort(-size, kind="stable")
        for lo in range(0, len(order), LANES):
            lanes = order[lo : lo + LANES]
            counts = self._walk(data, begin[lanes], size[lanes])
            np.add.at(out, owner[lanes], counts.T)
        return out

    def _walk(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Phrases (rows: languages) of the stretches, the longest first; at each step every stretch that isn't over moves by one byte."""
        roots, width = self.roots[:, None], self.columns
        counts = np.zeros((len(roots), len(at)), np.int32)
        state = np.repeat(roots, len(at), 1)
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left").tolist()  # stretches longer than each step
        for step, n in enumerate(active):
            if n < state.shape[1]:
                state = state[:, :n]
            c = data[at[:n] + step].astype(np.int64)
            to = self.table.take(state.astype(np.int64) * width + c)
            lost = to < 0
            # the phrase is over: the next one begins with this byte, which is one by itself if the language hasn't got it
            fresh = self.table.take(roots.astype(np.int64) * width + c[None, :])
            counts[:, :n] += lost | (state == roots)
            state = np.where(lost, np.where(fresh < 0, roots, fresh), to)
        return counts

    def judge(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; NO_LANGUAGE and 0 without letters, or where nothing was learnt."""
        plain = [letters(t) for t in texts]
        if not self.languages:
            return [(NO_LANGUAGE, 0.0)] * len(texts)
        counts = self.phrases(plain)
        cost = counts * self.bits
        best = cost.argmin(1)  # of equal costs the first language
        gap = (cost - cost.min(1, keepdims=True)) / SHARED_EVIDENCE
        score = 1 / np.exp2(-gap).sum(1)
        return [(self.languages[k], float(s)) if p else (NO_LANGUAGE, 0.0) for p, k, s in zip(plain, best, score, strict=True)]


# -- Spark jobs ---------------------------------------------------------------------------------------------------


def sample(docs: DataFrame, most: int = SAMPLE_LETTERS) -> dict[str, list[bytes]]:
    """Some `most` letters of each language, from pieces of distinct texts in the order of their hashes.

    docs: text, lang.  Texts are chosen by their own hash, so copies of one text count once.  The driver gets the pieces that are used
    and no others: a first pass measures each language, then a share of the hashes is read that holds enough.
    """
    labelled = docs.select("lang", "text", F.xxhash64("text").alias("h")).filter("lang is not null and text is not null")
    piece = F.substring("text", F.expr(f"cast(1 + pmod(h, greatest(length(text) - {PIECE_LETTERS}, 0) + 1) as int)"), F.lit(PIECE_LETTERS))
    measured = labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("texts"), F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    most = min(most, ALL_LETTERS // max(len(measured), 1))
    out: dict[str, list[bytes]] = {}
    open_ = {r.lang: max(1.0, r.texts * PIECE_LETTERS / (4 * most)) for r in measured}  # one text in so many
    while open_:
        keep = F.coalesce(*[F.when(F.col("lang") == k, F.pmod(F.xxhash64("h"), F.lit(1 << 40)) < int((1 << 40) / part)) for k, part in open_.items()], F.lit(False))
        rows = labelled.filter(keep).groupBy("lang", "h").agg(F.first(piece).alias("piece")).select("lang", F.xxhash64("h").alias("h"), "piece")
        by: dict[str, list[tuple[int, str]]] = {}
        for r in rows.toLocalIterator():
            by.setdefault(r.lang, []).append((r.h % (1 << 40), r.piece))
        for k in list(open_):
            texts, held = [], 0
            for _, t in sorted(by.get(k, [])):
                if held >= most:
                    break
                texts.append(letters(t)[: most - held])
                held += len(texts[-1])
            if held >= most or open_[k] == 1.0:
                out[k] = texts
                del open_[k]
            else:  # short texts: look at four times as many
                open_[k] = max(1.0, open_[k] / 4)
    return out


def fit(docs: DataFrame) -> Model:
    """A model of the languages in docs (text, lang); rows without either are left out."""
    return Model(sample(docs))


_models: dict[str, Model] = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    docs: doc_id, text; further columns are ignored.  A text that is null or has no letter is NO_LANGUAGE with a score of 0, as are all
    texts if nothing was learnt.  Every row gives a row: repeated ones, and those without doc_id, too; an empty table gives none.
    Only the samples, at most ALL_LETTERS letters and some, go to the workers, which build the automata once each.
    """
    samples, key = docs.sparkSession.sparkContext.broadcast(model.samples), uuid.uuid4().hex

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if key not in _models:
            _models.clear()
            _models[key] = Model(samples.value)
        judge = _models[key].judge
        for batch in texts:
            raw = [t if isinstance(t, str) else None for t in batch]
            rows = [x for lo, hi in passes([t or "" for t in raw], 16 << 20) for x in judge(raw[lo:hi])]
            yield pd.DataFrame(rows, columns=["lang_pred", "score"])

    return bare(docs, "doc_id", "text").withColumn("found", F.pandas_udf(run, "lang_pred string, score double")("text")).select("doc_id", "found.*")


def op13_language_id(spark, sf_dir: str) -> DataFrame:
    """Learns from labelled rows outside the held-out fold (rows without doc_id are in no fold and aren't learnt from)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = is_held("doc_id", 4, 2)
    found = identify(docs, fit(docs.filter(~held)))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")
