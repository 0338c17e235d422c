"""Periodic runs of words, found with an enhanced suffix array.

The words of many texts are laid out one after the other, each text with symbols of its own, and their suffixes are sorted
by doubling; the ranks of every doubling are kept, so that any two stretches are compared, and any two suffixes extended, by
powers of two.  The intervals of the LCP array are taken from its minima alone, without building nodes.

Where an interval of depth d splits, the suffixes i of the smaller side are looked up: if suffix i + d (or i - d) lies on the
other side, the words i .. i + 2d (or i - d .. i + d) are a square that no next word continues, a branching tandem repeat.  A
run of period q ends in exactly one such square of depth q; rotating the square to the left while the word before it stands d
words later too gives the run's first word.  Squares of a multiple of the period give the same stretch, of which the smallest stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bare, passes, utf8

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Suffixes of smaller sides that are looked up at a time.
STEP_SUFFIXES = 1 << 20

RUNS = "array<struct<start:long,length:long,period:long>>"


# -- suffix array -------------------------------------------------------------------------------------------------


def doubled_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """ranks[k][i]: the place of the first suffix that begins with the same 2**k symbols as suffix i, until all suffixes differ.

    Suffixes must all differ before they reach the end of the array, as those of texts with symbols of their own do.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.concatenate(([True], symbols[order[1:]] != symbols[order[:-1]]))
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = head, -1
    ranks, step = [rank], 1
    slots = np.arange(n)
    while True:
        # slots whose suffix isn't alone yet
        alone = first & np.concatenate((first[1:], [True]))
        slots, order, head = slots[~alone], order[~alone], head[~alone]
        if not len(slots):
            return ranks
        key = head << 32 | (rank[np.minimum(order + step, n)] + 1)
        by = np.argsort(key, kind="stable")
        key, order = key[by], order[by]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        head = slots[np.maximum.accumulate(np.where(first, np.arange(len(slots)), 0))]
        rank = rank.copy()
        rank[order] = head
        ranks.append(rank)
        step *= 2


def common_prefixes(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Symbols that the suffixes a and b (a differs from b) share."""
    n, out = len(ranks[0]) - 1, np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        out += (ranks[k][np.minimum(a + out, n)] == ranks[k][np.minimum(b + out, n)]).astype(np.int64) << k
    return out


def smaller_neighbours(lcp: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the nearest one to its left with a smaller value, and to its right with a smaller or equal one.

    lcp begins and ends with -1.  Minima over powers of two are kept, and a search leaps over what isn't small enough.
    """
    minima = [lcp]
    while 2 ** len(minima) <= len(lcp):
        m, half = minima[-1], 2 ** (len(minima) - 1)
        minima.append(np.minimum(m[: len(m) - half], m[half:]))  # minima[k][i]: of lcp[i : i + 2**k]
    left, right, own = at.copy(), at.copy(), lcp[at]
    for k in range(len(minima) - 1, -1, -1):
        width, m = 2**k, minima[k]
        leap = (left >= width) & (m[np.maximum(left - width, 0)] >= own)
        left -= leap * width
        leap = (right + width < len(lcp)) & (m[np.minimum(right + 1, len(m) - 1)] > own)
        right += leap * width
    return left - 1, right + 1


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner, and number within the owner, of sum(counts) elements."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def branching_squares(ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts i and depths d of all squares i .. i + 2d that the next symbol doesn't continue."""
    place = ranks[-1][:-1]
    n = len(place)
    suffix = np.empty(n, np.int64)
    suffix[place] = np.arange(n)
    near = np.flatnonzero(ranks[0][suffix[1:]] == ranks[0][suffix[:-1]]) + 1  # splits of an interval that isn't the root
    lcp = np.zeros(n + 1, np.int64)
    lcp[0] = lcp[n] = -1
    lcp[near] = common_prefixes(ranks, suffix[near - 1], suffix[near])
    left, right = smaller_neighbours(lcp, near)
    starts, depths = [], []
    # the split at `near` has the suffixes at left .. near - 1 on one side and near .. right - 1 on the other
    small_left = near - left <= right - near
    sizes = np.where(small_left, near - left, right - near)
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(STEP_SUFFIXES, sizes.sum() + STEP_SUFFIXES, STEP_SUFFIXES), "right")
    for lo, hi in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(near)]))):
        if hi <= lo:
            continue
        owner, number = _spread(sizes[lo:hi])
        owner += lo
        small, depth = small_left[owner], lcp[near[owner]]
        i = suffix[np.where(small, left[owner], near[owner]) + number]
        other_lo, other_hi = np.where(small, near[owner], left[owner]), np.where(small, right[owner], near[owner])
        for shift in (depth, -depth):
            j = i + shift
            fits = (j >= 0) & (j < n)
            p = place[np.where(fits, j, 0)]
            fits &= (p >= other_lo) & (p < other_hi)
            starts.append(np.minimum(i, j)[fits])
            depths.append(depth[fits])
    return np.concatenate(starts or [np.empty(0, np.int64)]), np.concatenate(depths or [np.empty(0, np.int64)])


def runs(symbols: np.ndarray, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period; see doubled_ranks for what symbols must hold."""
    if not len(symbols):
        return np.empty((0, 3), np.int64)
    ranks = doubled_ranks(symbols)
    # a run of 24 words repeats 16 of them one period later, so texts without two equal stretches of that length have none
    if least * (periods - 1) // periods >= 1 << (len(ranks) - 1):
        return np.empty((0, 3), np.int64)
    start, depth = branching_squares(ranks)
    end = start + 2 * depth
    for k in range(len(ranks) - 1, -1, -1):  # rotate to the left by powers of two; all stretches of the highest differ
        to = start - (1 << k)
        start = np.where((to >= 0) & (ranks[k][np.maximum(to, 0)] == ranks[k][np.maximum(to + depth, 0)]), to, start)
    long = end - start >= np.maximum(least, periods * depth)
    found = np.column_stack((start, end - start, depth))[long]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    again = (found[1:, :2] == found[:-1, :2]).all(1)  # a multiple of the period
    found = found[np.concatenate(([True], ~again))[: len(found)]]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


# -- Spark jobs ---------------------------------------------------------------------------------------------------


def _symbols(texts: list[list[bytes]]) -> np.ndarray:
    """Numbers of the words, each text with numbers of its own."""
    out, base = [], 0
    for words in texts:
        own: dict[bytes, int] = {}
        out.append(np.fromiter([own.setdefault(w, len(own)) for w in words], np.int64, len(words)) + base)
        base += len(own)
    return np.concatenate(out or [np.empty(0, np.int64)])


def _left(words: list[bytes], runs_: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, runs_[:, 0] + runs_[:, 2], 1)
    np.add.at(depth, runs_[:, 0] + runs_[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, edit: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start and period), collapsed (the words left, by one space).

    docs: doc_id, text; further columns are ignored.  `edit` may change the words of a document before they are searched.  A word is
    left out of `collapsed` if a run holds it after the run's first period.  A null or empty text has no words, no runs and
    an empty `collapsed`.  Every row gives a row: repeated ones, and those without doc_id, too; an empty table gives none.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raw, ids = utf8(batch["text"]), batch["doc_id"].tolist()
            for lo, hi in passes(raw):
                words = [t.split() for t in raw[lo:hi]]  # of bytes: at space and \x09 to \x0d
                own = [None if i is None or i != i else int(i) for i in ids[lo:hi]]
                if edit is not None:
                    words = [edit(i, w) for i, w in zip(own, words, strict=True)]
                begins = np.cumsum([0, *map(len, words)])
                found = runs(_symbols(words))
                cuts = np.searchsorted(found[:, 0], begins).tolist()
                spans = [[] for _ in words]
                for k in np.unique(np.searchsorted(begins, found[:, 0], "right") - 1).tolist():
                    part = found[cuts[k] : cuts[k + 1]] - [begins[k], 0, 0]
                    spans[k] = list(map(tuple, part.tolist()))
                    words[k] = _left(words[k], part)
                yield pd.DataFrame({"doc_id": pd.array(own, "Int64"), "n_words": np.diff(begins), "runs": spans, "collapsed": [b" ".join(w).decode("utf-8", "surrogatepass") for w in words]})

    return bare(docs, "doc_id", "text").mapInPandas(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's words: one document in ten (by crc32 of its id) repeats some of its words from a place on to its end."""
    import zlib

    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def op11_word_runs(spark, sf_dir: str) -> DataFrame:
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), planted)
    # runs are in order of start and period, so that of equal ratios the first one stays
    best = F.expr(f"reduce(runs, cast(null as {RUNS[6:-1]}), (best, r) -> if(best is null or r.length * best.period > best.length * r.period, r, best))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
