"""Toxicity of whole texts from a learned lexicon, matched with misspellings and judged by its surroundings.

The lexicon (words and word beginnings that mark toxic documents) is kept as a trie.  A Levenshtein automaton runs over
a word and the trie together; their product is made deterministic as words need it, so that a word costs one table
step for each letter.  A hit inside quotation marks or after a word of reporting counts as quoted; words of reporting are
those that stand before hits of clean training documents.  How far each kind of hit (whole word or beginning, edits, quoted)
marks toxic documents is measured on the training rows.  The strongest kind gives a document's rate; the log odds of all its
hits, for the words it has, order the documents of equal rates.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bare, fresh_names, is_held

#: The lexicon is fitted on about so many labelled documents at most, chosen by a hash of their id.
MAX_TRAINING_DOCS = 20_000
#: Lengths of word beginnings that may become terms.
BEGINNINGS = range(4, 9)
#: A term stands in so many toxic training documents at least, ...
LEAST_DOCS = 5
#: ... is toxic in this share of its documents at least, and has this log-likelihood gain over the base rate.
LEAST_SHARE, LEAST_GAIN = 0.8, 12.0
#: A term in this share of the toxic training documents is no accident of copies.
COMMON_SHARE = 0.1
#: Letters of a term from which one edit is allowed; the first letter must agree.
FUZZY_FROM, FUZZY_BEGINNING_FROM = 5, 7
#: Characters on each side that decide whether a hit is quoted.
WINDOW = 80
#: Words whose result a worker remembers (150 bytes each) before it starts anew; this bounds memory only.
CACHE_WORDS = 300_000
_WORD = re.compile(r"[^\W\d_]+")
#: Words before a hit among which a word of reporting is looked for; share of clean documents among those with the word there.
REPORT_WITHIN, REPORT_SHARE = 3, 0.8
# Quotation marks.
_QUOTES = "\"“”„«»‹›"


class Matcher:
    """Best lexicon term for a word: fewest edits, then the longest term, then the first in order."""

    def __init__(self, terms: list[str]):
        """terms: whole words, or beginnings that end in `*`."""
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[dict[bool, str]] = [{}]
        self.reach = [0]
        for term in terms:
            open_, letters = term.endswith("*"), term.rstrip("*")
            node, path = 0, [0]
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append({})
                    self.reach.append(0)
                node = self.children[node][c]
                path.append(node)
            self.ends[node][open_] = term
            for n in path:
                self.reach[n] = max(self.reach[n], self.limit(term))
        self.states: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.results: list[tuple[int, str] | None] = []
        self.start = self._state({0: 0}, None)

    @staticmethod
    def limit(term: str) -> int:
        """Edits allowed for a term."""
        letters = len(term.rstrip("*"))
        return int(letters >= (FUZZY_BEGINNING_FROM if term.endswith("*") else FUZZY_FROM))

    @staticmethod
    def _better(a, b):
        return b if a is None or (b is not None and (b[0], -len(b[1]), b[1]) < (a[0], -len(a[1]), a[1])) else a

    def _state(self, nodes: dict[int, int], kept) -> int:
        """nodes: trie node -> edits so far.  kept: best beginning passed.  Letters missing from the word are skipped here."""
        todo = list(nodes)
        while todo:
            n = todo.pop()
            if n and nodes[n] < self.reach[n]:
                for child in self.children[n].values():
                    if nodes[n] + 1 < nodes.get(child, 9) and nodes[n] + 1 <= self.reach[child]:
                        nodes[child] = nodes[n] + 1
                        todo.append(child)
        for n, e in nodes.items():
            term = self.ends[n].get(True)
            if term and e <= self.limit(term):
                kept = self._better(kept, (e, term))
        key = (frozenset(nodes.items()), kept)
        if key not in self.states:
            best = kept
            for n, e in nodes.items():
                term = self.ends[n].get(False)
                if term and e <= self.limit(term):
                    best = self._better(best, (e, term))
            self.states[key] = len(self.sets)
            self.sets.append((dict(nodes), kept))
            self.steps.append({})
            self.results.append(best)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        nodes, kept = self.sets[state]
        out: dict[int, int] = {}
        for n, e in nodes.items():
            for letter, child in self.children[n].items():
                cost = e + (letter != c)
                if (n or letter == c) and cost <= self.reach[child] and cost < out.get(child, 9):
                    out[child] = cost
            if n and e < self.reach[n] and e + 1 < out.get(n, 9):
                out[n] = e + 1
        return self._state(out, kept)

    def match(self, word: str) -> tuple[int, str] | None:
        state, steps = self.start, self.steps
        for c in word:
            to = steps[state].get(c)
            if to is None:
                to = steps[state][c] = self._step(state, c)
            state = to
            if not self.sets[state][0]:
                break
        return self.results[state]


class _Memory(dict):
    def __init__(self, matcher: Matcher):
        super().__init__()
        self.matcher = matcher

    def __missing__(self, word: str):
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = found = self.matcher.match(word)
        return found


def words_before(text: str, start: int) -> list[str]:
    """The last words of the line before a place, within the window."""
    return _WORD.findall(text[max(0, start - WINDOW) : start].rpartition("\n")[2])[-REPORT_WITHIN:]


def quoted(text: str, start: int, end: int, reporting: set[str]) -> bool:
    """Whether the place stands between quotation marks of its line, or close after a word of reporting."""
    before, after = text[max(0, start - WINDOW) : start].rpartition("\n")[2], text[end : end + WINDOW].partition("\n")[0]
    if sum(map(before.count, _QUOTES)) % 2 and any(q in after for q in _QUOTES):
        return True
    return bool(reporting) and any(w in reporting for w in words_before(text, start))


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    #: (is a beginning, edits, quoted) -> probability that a document with such a hit is toxic
    rates: dict[tuple[bool, int, bool], float] = field(default_factory=dict)
    #: the same for a document without hits
    base: float = 0.0
    #: words that introduce what others said
    reporting: set[str] = field(default_factory=set)

    def scorer(self):
        memory = _Memory(Matcher(self.terms))

        def hits(text: str) -> dict[str, tuple[bool, int, bool]]:
            """Kind of the strongest hit for each term found; unquoted and fewer edits are stronger."""
            low = text.lower()
            if not any(map(memory.__getitem__, set(_WORD.findall(low)))):
                return {}
            out: dict[str, tuple[bool, int, bool]] = {}
            for m in _WORD.finditer(low):
                if found := memory[m[0]]:
                    kind = (found[1].endswith("*"), found[0], quoted(low, *m.span(), self.reporting))
                    out[found[1]] = min(out.get(found[1], kind), kind, key=lambda k: (k[2], k[1]))
            return out

        return hits

    def score(self, hits: dict, n_words: int) -> float:
        """The rate of the most telling kind of hit, raised towards the next higher rate (but not over 0.5) by further evidence.

        The evidence is the sum of the hits' log odds over the base, for the square root of the words: many weak hits in a
        long text never count as much as one telling hit.
        """
        rate = max((self.rates.get(kind, self.base) for kind in hits.values()), default=self.base)
        above = min((r for r in (*self.rates.values(), 1.0) if r > rate), default=1.0)
        if rate < 0.5:
            above = min(above, 0.5)
        odds = sum(max(0.0, _logit(self.rates.get(kind, self.base)) - _logit(self.base)) for kind in hits.values())
        evidence = odds / math.sqrt(max(1, n_words))
        return rate + 0.9 * (above - rate) * evidence / (1 + evidence)


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def _terms_of(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "*" for w in words for k in BEGINNINGS if len(w) > k}


def telling(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Terms that mark toxic documents, with the share of their documents that are toxic."""
    base, out = n_toxic / max(1, n_toxic + n_clean), {}
    for term, t in toxic.items():
        c = clean.get(term, 0)
        share = t / (t + c)
        gain = t * math.log(share / base) + (c * math.log((1 - share) / (1 - base)) if c else 0)
        if t >= LEAST_DOCS and share >= LEAST_SHARE and gain >= LEAST_GAIN:
            out[term] = share
    return out


def choose_terms(documents: list[list[str]], share: dict[str, float]) -> list[str]:
    """Terms that explain the toxic documents, the one that explains most of those left first.

    documents: the telling terms of each toxic document.  Words that merely stand in copies of a document which a
    real term explains are never needed.  A term in COMMON_SHARE of the documents stays even so.  Of equal terms the more exact, then the whole word, then the longer wins.
    """
    holders: dict[str, set[int]] = {}
    for i, terms in enumerate(documents):
        for t in terms:
            holders.setdefault(t, set()).add(i)
    common = sorted((t for t, d in holders.items() if len(d) >= COMMON_SHARE * len(documents)), key=lambda t: (-len(holders[t]), t.endswith("*"), -len(t), t))
    chosen = []
    while holders:
        best = max(holders, key=lambda t: (len(holders[t]) * share[t], not t.endswith("*"), len(t), t))
        done = holders.pop(best)
        chosen.append(best)
        for t in list(holders):
            holders[t] -= done
            if len(holders[t]) < LEAST_DOCS:
                del holders[t]
    for term in common:
        letters = term.rstrip("*")
        if not any(c.startswith(letters) or letters.startswith(c.rstrip("*")) for c in chosen):
            chosen.append(term)
    return sorted(chosen)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Model:
    """Learns from the given labelled rows, about max_docs of them at most; rows without a label or a text teach nothing."""
    labels = bare(labels, "doc_id", "toxic").filter("toxic is not null and doc_id is not null").dropDuplicates(["doc_id"])
    n = labels.count()
    if n > max_docs:
        labels = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(n)) < max_docs)
    # at most about max_docs ids: a bounded side
    rows = bare(docs, "doc_id", "text").filter("text is not null").join(F.broadcast(labels), "doc_id").select("text", "toxic").persist()
    sizes = {r["toxic"] > 0: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic:
        rows.unpersist()
        return Model()

    def counted(known: set[str] | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            n = Counter()
            for batch in batches:
                for text in batch["text"]:
                    found = _terms_of(text)
                    n.update(found if known is None else found & known)
            if n:
                yield pd.DataFrame({"term": list(n), "n": list(n.values())})

        return run

    def totals(part: DataFrame, known=None, least=1) -> dict[str, int]:
        # terms in several documents of a bounded sample: a bounded number
        return {r["term"]: r["n"] for r in part.mapInPandas(counted(known), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).collect()}

    toxic = totals(rows.filter("toxic > 0"), least=LEAST_DOCS)
    clean = totals(rows.filter("toxic = 0"), set(toxic))
    share = telling(toxic, clean, n_toxic, n_clean)

    def marked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([sorted(_terms_of(t) & share.keys()) for t in batch])

    known = [r["terms"] for r in rows.filter("toxic > 0").select(F.pandas_udf(marked, "array<string>")("text").alias("terms")).collect()]
    model = Model(choose_terms(known, share))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory, seen = _Memory(Matcher(model.terms)), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                low = text.lower()
                near = {w for m in _WORD.finditer(low) if memory[m[0]] for w in words_before(low, m.start()) if not memory[w]}
                seen.update((w, int(label > 0)) for w in near)
        if seen:
            yield pd.DataFrame([(w, label, n) for (w, label), n in seen.items()], columns=["word", "label", "n"])

    around = rows.mapInPandas(contexts, "word string, label int, n long").groupBy("word").agg(F.sum(F.expr("if(label = 0, n, 0)")).alias("clean"), F.sum("n").alias("n"))
    # words of a bounded sample that stand before hits of several clean documents
    model.reporting = {r["word"] for r in around.filter((F.col("clean") >= LEAST_DOCS) & (F.col("clean") >= REPORT_SHARE * F.col("n"))).collect()}

    def observe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, seen = model.scorer(), Counter()
        for batch in batches:
            for text, label in zip(batch["text"], batch["toxic"], strict=True):
                for kind in set(hits(text).values()) or {None}:
                    seen[kind, int(label > 0)] += 1
        if seen:
            yield pd.DataFrame([(*map(int, kind or (-1, -1, -1)), label, n) for (kind, label), n in seen.items()], columns=["open", "edits", "quoted", "label", "n"])

    kinds: dict = {}
    for r in rows.mapInPandas(observe, "open int, edits int, quoted int, label int, n long").groupBy("open", "edits", "quoted", "label").agg(F.sum("n").alias("n")).collect():
        kinds.setdefault(None if r["open"] < 0 else (bool(r["open"]), r["edits"], bool(r["quoted"])), {})[r["label"]] = r["n"]
    rows.unpersist()
    base = n_toxic / (n_toxic + n_clean)
    rate = {k: (v.get(1, 0) + base) / (sum(v.values()) + 1) for k, v in kinds.items()}
    model.base = rate.pop(None, base)
    model.rates = rate
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score (0 to 1), n_hits, n_quoted and predicted (score >= 0.5); columns of these names are replaced, others stay.

    A null or empty text has no hits and the score of a text without any.  Repeated rows are scored each, an empty table stays empty.
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hits = model.scorer()
        for batch in texts:
            found = [hits(t) if isinstance(t, str) else {} for t in batch]
            yield pd.DataFrame({"score": [model.score(h, len(t.split()) if h else 0) for h, t in zip(found, batch, strict=True)], "n_hits": [len(h) for h in found], "n_quoted": [sum(k[2] for k in h.values()) for h in found]})

    scored = F.pandas_udf(run, "score double, n_hits int, n_quoted int")
    (found,) = fresh_names(docs, "found")
    out = docs.drop("score", "n_hits", "n_quoted", "predicted").withColumn(found, scored(F.col("text")))
    return out.select(*[F.col(f"`{c}`") for c in out.columns if c != found], f"{found}.*").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't reject, with their own columns, whatever their names."""
    (kept,) = fresh_names(docs, "kept")
    text = docs.select(F.struct("*").alias(kept), "text")
    return score(text, model).filter("predicted = 0").select(f"{kept}.*")


def training_labels(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~is_held("doc_id", 5, 0))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = bare(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    out = score(docs, fit(docs, training_labels(spark, sf_dir)))
    return out.select("doc_id", is_held("doc_id", 5, 0).alias("held_out"), "score", "predicted", "n_hits", "n_quoted")
