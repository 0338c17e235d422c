"""Periodic runs of words against brute force."""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pytest

from siltstone.llm import word_runs


def brute(w: list, least: int = 24, periods: int = 3) -> list:
    """Maximal stretches of every period; of equal stretches the one of the smallest period."""
    best = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q:
                best.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted([(s, n, q) for (s, n), q in best.items() if n >= max(least, periods * q)], key=lambda x: (x[0], x[2]))


def edited(doc_id: int, w: list) -> list:
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not w:
        return w
    a, p = (h // 10) % len(w), 1 + (len(w) - (h // 10) % len(w)) // (3 + h // 10 % 8)
    return [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    r = np.random.default_rng(seed)
    for _ in range(40):
        texts = []
        for _ in range(r.integers(1, 5)):
            n = int(r.integers(0, 90))
            w = [str(x).encode() for x in r.integers(0, r.choice([1, 2, 3, 6, 40]), n)]
            if n and r.random() < 0.6:
                a = int(r.integers(n))
                p = 1 + (n - a) // int(r.integers(3, 11))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        for least, periods in ((24, 3), (6, 2), (10, 3)):
            want, base = [], 0
            for w in texts:
                want += [(s + base, n, q) for s, n, q in brute(w, least, periods)]
                base += len(w)
            assert list(map(tuple, word_runs.runs(word_runs._symbols(texts), least, periods).tolist())) == want


def test_query_against_brute_force(spark, tmp_path):
    r = np.random.default_rng(7)
    texts = {i: "\t ".join(str(x) for x in r.integers(0, r.choice([2, 5, 300]), r.integers(0, 200))) for i in range(150)}
    texts |= {200: None, 201: "", 202: " \n", 203: "é " * 30, 204: "a b " * 20 + "x " + "c d e " * 9, 205: " ".join(map(str, range(2000))) + " z" * 1500}
    rows = [(i, t, 1, "mine") for i, t in texts.items()] + [(3, texts[3], 1, "mine"), (None, "q " * 40, 1, "mine")]
    spark.createDataFrame(rows, "doc_id long, text string, n_runs int, collapsed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = word_runs.op11_word_runs(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and [x.length for x in got if x.doc_id is None] == [40]
    for x in got:
        if x.doc_id is None:
            continue
        w = edited(x.doc_id, (texts[x.doc_id] or "").encode().split())
        found = brute(w)
        top = min(found, key=lambda s: (-Fraction(s[1], s[2]), s[0], s[2]), default=(None,) * 3)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        assert (x.n_runs, x.start, x.length, x.period) == (len(found), *top)
        assert x.exponent_milli == (1000 * top[1] // top[2] if found else None)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(b" ".join(t for k, t in enumerate(w) if k not in gone)).hexdigest()
    assert sum(x.n_runs > 0 for x in got) > 10
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert word_runs.op11_word_runs(spark, f"{tmp_path}/none").count() == 0


def test_runs_and_collapsed_text(spark):
    d = spark.createDataFrame([(1, "say " + "go on " * 12 + "now"), (2, "plain words")], "doc_id long, text string")
    got = {x.doc_id: x for x in word_runs.periodic_runs(d).collect()}
    assert [tuple(s) for s in got[1].runs] == [(1, 24, 2)] and got[1].collapsed == "say go on now" and got[1].n_words == 26
    assert got[2].runs == [] and got[2].collapsed == "plain words"
