"""Line deduplication by pairwise alignment.

A later document overlaps an earlier one where both hold a telling window: the fewest consecutive lines that have LEAST_WORDS
words together, counted on from a line or back from it, so that every block of so many words consists of windows.  The nth
occurrence of a window in a document is led back to the first document that holds it n times at least.  So a line that
thousands of documents share makes one pair for each of them and each further occurrence, never pairs among them.

Rare windows (in RARE_DOCS documents at most) choose the partners first.  A frequent one leads to a partner only for
documents in which the alignments with those partners left it, so no repeated window stays without a pair.

A pair is aligned by patience diff over line hashes: lines that stand once in both are anchors, their ordered chain with most
words is kept, and the gaps between its anchors are aligned the same way; in a gap without such lines the nth occurrences are the anchors.
Common blocks of the alignment go from the later document.  What crosses the chain isn't aligned and stays, unless it is
a moved passage: a common block of MOVED_WORDS words at least.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bare, fresh_names, mix, stored

#: Words of a window that can lead to an earlier document, and so of a block that may be deleted.
LEAST_WORDS = 5
#: Documents that a rare window stands in at most.
RARE_DOCS = 8
#: Words of a common block that is deleted although it stands in another order than its surroundings.
MOVED_WORDS = 50
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _lines(text: str = "text"):
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


#: A line's key: its words, whatever white space stands between them.
_KEY = r"transform(lines, l -> trim(regexp_replace(l, '[ \\t\\r\\x0b\\f]+', ' ')))"


def chain(pairs: list[tuple[int, int]], weights: list[int]) -> list[tuple[int, int]]:
    """Heaviest run of pairs (ascending in the first) that ascends in the second too; the first found of equal ones."""
    ranks = {b: k + 1 for k, b in enumerate(sorted({b for _, b in pairs}))}
    # best[r]: (weight, pair) of the heaviest run that ends at one of the ranks which the node covers
    best: list[tuple[int, int]] = [(0, -1)] * (len(ranks) + 1)
    back: list[int] = []
    top = (0, -1)
    for k, (_, b) in enumerate(pairs):
        r, before = ranks[b] - 1, (0, -1)
        while r > 0:
            if best[r][0] > before[0]:
                before = best[r]
            r &= r - 1
        back.append(before[1])
        own, r = (before[0] + weights[k], k), ranks[b]
        while r < len(best):
            if own[0] > best[r][0]:
                best[r] = own
            r += r & -r
        if own[0] > top[0]:
            top = own
    out, k = [], top[1]
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def windows(words: np.ndarray, ends: np.ndarray, least_words: int = LEAST_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First and last lines of the windows of documents whose lines stand one after another, up to ends; sorted, each once."""
    total = np.cumsum(words)
    before = total - words
    filled = np.flatnonzero(words > 0)
    if not len(filled):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    document = np.searchsorted(ends, filled, "right")
    last = np.searchsorted(total, before[filled] + least_words, "left")
    first = np.searchsorted(before, total[filled] - least_words, "right") - 1
    on, back = last < ends[document], first >= np.concatenate(([0], ends))[document]
    both = np.unique(np.stack((np.concatenate((filled[on], first[back])), np.concatenate((last[on], filled[back])))), axis=1)
    return both[0], both[1]


def _anchors(earlier: list[int], later: list[int], words: list[int], span: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """Anchor chain (later place, earlier place) of a gap: lines that stand once in both, or else their nth occurrences."""
    e_lo, e_hi, l_lo, l_hi = span
    where: dict[int, list[int]] = {}
    at: dict[int, list[int]] = {}
    for i in range(e_lo, e_hi):
        where.setdefault(earlier[i], []).append(i)
    for j in range(l_lo, l_hi):
        if later[j] in where:
            at.setdefault(later[j], []).append(j)
    single = [(j[0], where[h][0]) for h, j in at.items() if len(j) == len(where[h]) == 1]
    pairs = sorted(single or [pair for h, j in at.items() for pair in zip(j, where[h], strict=False)])
    return chain(pairs, [words[j] + 1 for j, _ in pairs])


def patience(earlier: list[int], later: list[int], words: list[int]) -> list[tuple[int, int]]:
    """Aligned places (later, earlier) in ascending order, by patience diff; words: of the later lines, which the chain weighs."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(earlier), 0, len(later))]
    while gaps:
        e_lo, e_hi, l_lo, l_hi = gaps.pop()
        while e_lo < e_hi and l_lo < l_hi and earlier[e_lo] == later[l_lo]:
            out.append((l_lo, e_lo))
            e_lo, l_lo = e_lo + 1, l_lo + 1
        while e_lo < e_hi and l_lo < l_hi and earlier[e_hi - 1] == later[l_hi - 1]:
            e_hi, l_hi = e_hi - 1, l_hi - 1
            out.append((l_hi, e_hi))
        if e_lo == e_hi or l_lo == l_hi:
            continue
        for j, i in (anchors := _anchors(earlier, later, words, (e_lo, e_hi, l_lo, l_hi))):
            gaps.append((e_lo, i, l_lo, j))
            e_lo, l_lo = i + 1, j + 1
        out.extend(anchors)
        if anchors:
            gaps.append((e_lo, e_hi, l_lo, l_hi))
    return sorted(out)


def aligned(earlier: np.ndarray, later: np.ndarray, words: np.ndarray, least_words: int = LEAST_WORDS, moved_words: int = MOVED_WORDS) -> np.ndarray:
    """Which lines of the later document stand in common blocks with the earlier one.

    words: words of the later document's lines.  A block that is aligned goes from least_words words on, a moved one from moved_words on.
    """
    gone = np.zeros(len(later), bool)
    total = np.concatenate(([0], np.cumsum(words)))
    earlier, later = np.asarray(earlier).tolist(), np.asarray(later).tolist()
    free_e, free_l = bytearray(b"\1" * len(earlier)), bytearray(b"\1" * len(later))
    pairs = patience(earlier, later, np.asarray(words).tolist())
    begin = 0
    for k in range(1, len(pairs) + 1):
        if k == len(pairs) or pairs[k] != (pairs[k - 1][0] + 1, pairs[k - 1][1] + 1):
            first, last = pairs[begin][0], pairs[k - 1][0]
            if total[last + 1] - total[first] >= least_words:
                gone[first : last + 1] = True
                for j, i in pairs[begin:k]:
                    free_l[j] = free_e[i] = 0
            begin = k
    _moved(earlier, later, np.asarray(words), free_e, free_l, gone, moved_words)
    return gone


def _free_windows(keys: np.ndarray, words: np.ndarray, free: bytearray, least_words: int) -> tuple[list[int], list[int], list[int]]:
    """First line, end and hash of the windows of least_words words that begin at a line with words and hold free lines alone."""
    total = np.concatenate(([0], np.cumsum(words)))
    first = np.flatnonzero(words > 0)
    end = np.searchsorted(total, total[first] + least_words)
    first, end = first[end <= len(words)], end[end <= len(words)]
    taken = np.concatenate(([0], np.cumsum(np.frombuffer(bytes(free), np.uint8) == 0)))
    whole = taken[first] == taken[end]
    first, end = first[whole], end[whole]
    up, down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(keys), x, np.uint64)))) for x in (_BASE, _INVERSE))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(keys * up[:-1], dtype=np.uint64)))
    return first.tolist(), end.tolist(), mix((sums[end] - sums[first]) * down[first]).tolist()


def _moved(earlier: list[int], later: list[int], words: np.ndarray, free_e: bytearray, free_l: bytearray, gone: np.ndarray, moved_words: int) -> None:
    """Marks moved passages: common blocks of lines that are still free in both, from the later document's begin on.

    A block of so many words begins with a window of them, which the earlier document has too.  Of the places of a window there the first
    one that is still free counts; one that isn't never will be again, so each place is looked at once.
    """
    own = dict(zip(later, words.tolist(), strict=True))
    keys_e, keys_l = (np.array(x, np.int64).view(np.uint64) for x in (earlier, later))
    for i, h in enumerate(earlier):
        if h not in own:
            free_e[i] = 0
    places: dict[int, deque[tuple[int, int]]] = {}
    for i, end, key in zip(*_free_windows(keys_e, np.array([own.get(h, 0) for h in earlier], np.int64), free_e, moved_words), strict=True):
        places.setdefault(key, deque()).append((i, end))
    for j, end, key in zip(*_free_windows(keys_l, words, free_l, moved_words), strict=True):
        if key not in places or free_l.find(0, j, end) >= 0:
            continue
        at = places[key]
        while at and free_e.find(0, *at[0]) >= 0:
            at.popleft()
        if not at or earlier[at[0][0] : at[0][1]] != later[j:end]:
            continue
        i = at[0][0]
        while i and j and free_e[i - 1] and free_l[j - 1] and earlier[i - 1] == later[j - 1]:  # lines without words before it
            i, j = i - 1, j - 1
        n = 0
        while j + n < len(later) and i + n < len(earlier) and free_l[j + n] and free_e[i + n] and later[j + n] == earlier[i + n]:
            n += 1
        gone[j : j + n] = True
        free_l[j : j + n] = free_e[i : i + n] = bytes(n)


def _telling(batch: pd.DataFrame, least_words: int) -> pd.DataFrame:
    """doc_id, line (a key for each window and its nth occurrence in the document), first and last line of the window."""
    sizes = batch["words"].str.len().to_numpy(np.int64)
    ends = np.cumsum(sizes)
    first, last = windows(np.concatenate(batch["words"].to_numpy()).astype(np.int64), ends, least_words)
    hashes = np.concatenate(batch["hashes"].to_numpy()).astype(np.int64).view(np.uint64)
    up, down = (np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(hashes), x, np.uint64)))) for x in (_BASE, _INVERSE))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(hashes * up[:-1], dtype=np.uint64)))
    keys, owner = mix((sums[last + 1] - sums[first]) * down[first]), np.searchsorted(ends, first, "right")
    order = np.lexsort((first, keys, owner))
    keys, owner = keys[order], owner[order]
    fresh = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])))) if len(keys) else np.empty(0, np.int64)
    nth = np.arange(len(keys)) - np.repeat(fresh, np.diff(np.concatenate((fresh, [len(keys)]))))
    offset = (np.concatenate(([0], ends))[:-1])[owner]
    return pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[owner], "line": mix(keys + nth.astype(np.uint64) * _BASE).view(np.int64), "first": first[order] - offset, "last": last[order] - offset})


def line_hashes(docs: DataFrame) -> DataFrame:
    """doc_id, hashes and words of the lines of each document."""
    lines = bare(docs, "doc_id", "text").filter("doc_id is not null").select("doc_id", _lines().alias("lines")).select("doc_id", F.expr(_KEY).alias("keys"))
    return lines.select("doc_id", F.expr("transform(keys, k -> xxhash64(k))").alias("hashes"), F.expr("transform(keys, k -> if(k = '', 0, size(split(k, ' '))))").alias("words"))


def _aligned_pairs(lines: DataFrame, pairs: DataFrame, least_words: int) -> DataFrame:
    """later, gone: places of the lines that the alignment of each pair deletes; only pairs that delete some."""

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, np.flatnonzero(aligned(e, h, np.asarray(w), least_words)).tolist()) for d, e, h, w in zip(*(batch[c] for c in batch.columns), strict=True)]
            yield pd.DataFrame([r for r in rows if r[1]], columns=["later", "gone"])

    early = lines.select(F.col("doc_id").alias("earlier"), F.col("hashes").alias("early"))
    late = lines.select(F.col("doc_id").alias("later"), "hashes", "words")
    both = pairs.join(early, "earlier").join(late, "later").select("later", "early", "hashes", "words")
    return both.mapInPandas(align, "later long, gone array<int>")


def _places(gone: DataFrame) -> DataFrame:
    """All deleted places of each document; they are bounded by the document itself."""
    return gone.select("later", F.explode("gone").alias("at")).groupBy("later").agg(F.collect_set("at").alias("gone"))


def repeated_lines(docs: DataFrame, least_words: int = LEAST_WORDS, rare_docs: int = RARE_DOCS) -> DataFrame:
    """later, gone: the places (from 0) of lines to delete, for each document that repeats earlier ones."""

    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield _telling(batch, least_words)

    lines = stored(line_hashes(docs), "lines")
    telling = stored(lines.mapInPandas(tell, "doc_id long, line long, first int, last int"), "telling")
    # stored, so that a frequent line's rows can be split in the join
    firsts = stored(telling.groupBy("line").agg(F.min("doc_id").alias("earlier"), F.count("*").alias("n")).filter("n > 1"), "first-lines")
    led = stored(telling.join(firsts, "line").filter("doc_id <> earlier").select(F.col("doc_id").alias("later"), "earlier", "n", "first", "last"), "led")
    rare = led.filter(F.col("n") <= rare_docs).select("later", "earlier").distinct()
    by_rare = stored(_aligned_pairs(lines, rare, least_words), "aligned-rare")
    # windows that are still there lead to their own first holder, unless that pair was aligned already
    left = led.filter(F.col("n") > rare_docs).join(_places(by_rare), "later", "left")
    left = left.filter(F.expr("gone is null or exists(sequence(first, last), x -> not array_contains(gone, x))")).select("later", "earlier").distinct()
    more = left.join(rare, ["later", "earlier"], "left_anti")
    return _places(by_rare.unionByName(_aligned_pairs(lines, more, least_words)))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs with the repeated blocks deleted from text, and n_lines, n_removed (columns of these names are replaced).

    docs: doc_id, text and others, which stay, whatever their names.  The order is that of doc_id: the earlier document keeps its
    lines.  Rows that share a doc_id aren't compared with each other.  A null text stays null; a text of which all lines go is empty.
    Rows without doc_id are left as they are, an empty table stays empty.
    """
    later, gone, lines = fresh_names(docs, "later", "gone", "lines")
    found = repeated_lines(docs, least_words).select(F.col("later").alias(later), F.col("gone").alias(gone))
    out = docs.drop("n_lines", "n_removed").join(found, F.col("doc_id") == F.col(later), "left").withColumn(lines, _lines())
    keep = F.expr(f"array_join(filter(`{lines}`, (l, i) -> not array_contains(`{gone}`, i)), '\n')")
    out = out.withColumns({"text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(keep), "n_lines": F.size(lines), "n_removed": F.coalesce(F.array_size(gone), F.lit(0))})
    return out.drop(later, gone, lines)


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: lines, deleted lines, and digests of what is left."""
    docs = bare(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    left = F.coalesce(F.col("text"), F.lit(""))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length(left).cast("long").alias("n_chars"), F.sha2(left, 256).alias("text_sha256"))
