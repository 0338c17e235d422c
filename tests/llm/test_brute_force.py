"""Near-duplicates, fingerprints and the fuzzy lexicon against plain recounts."""

import hashlib
import re
import zlib

import numpy as np

from siltstone.llm import fingerprints, near_duplicates, toxicity


def brute_components(rows: list[tuple], percent: int) -> dict:
    """doc_id -> (shingles, smallest id reachable), by all pairs of sets."""
    sets = {}
    for i, text in rows:
        w = [x for x in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    """Copies, edits around the threshold, chains of edits, short and empty texts; blocks of a few members, so that buckets are split."""
    monkeypatch.setattr(near_duplicates, "BLOCK", 3)
    r = np.random.default_rng(31)
    pool = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for family in range(12):
        base = [pool[k] for k in r.integers(0, len(pool), int(r.integers(30, 400)))]
        for step in range(16):
            text = list(base)
            for at in r.integers(0, len(text), int(r.integers(0, 1 + len(text) // 30))):
                text[at] = pool[r.integers(len(pool))]
            if family % 3 == 0:
                base = text  # a chain: its ends share less than its neighbours
            rows.append((n, " ".join(text) if step % 4 else "\n".join(text).upper()))
            n += 1
    rows += [(n + k, t) for k, t in enumerate(["a b", "A\tb ", "a b c d e", "a b c d e f", None, "", " \n", "é b", "É b", "a b c"])]
    rows += [(n + 10 + k, rows[0][1]) for k in range(20)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 85).collect()
    want = brute_components(rows, 85)
    assert len({c for _, c in want.values()}) not in (len(rows), 1)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == want and all(x.kept == (x.doc_id == x.component_id) for x in got)


def plain_chunks(data: bytes) -> dict:
    """The same boundaries byte by byte: distinct digests with their lengths."""
    out, start, h = {}, 0, 0
    cut = lambda end: out.__setitem__(zlib.crc32(data[start:end]), end - start)
    gear = [int(g) for g in fingerprints._GEAR]
    for p, byte in enumerate(data):
        h = (h * 2 + gear[byte]) % 2**32
        size = p + 1 - start
        soft, hard = h & int(fingerprints.LOOSE) == 0, h & int(fingerprints.STRICT) == 0
        # a piece at its greatest length ends there, whatever its hash
        if (size >= fingerprints.WANTED and soft) or (size >= fingerprints.LEAST and hard) or size == fingerprints.MOST:
            cut(p + 1)
            start = p + 1
    if start < len(data):
        cut(len(data))
    return out


def test_fingerprints_against_brute_force(spark):
    r = np.random.default_rng(32)
    letters = list("abcdefgh \n") + ["é", "漢", "\U0001f600"]
    text = lambda n: "".join(letters[k] for k in r.integers(0, len(letters), n))
    shared = text(600)
    rows = [(int(i), t) for i, t in zip(r.permutation(400)[:60] - 100, [None, "", "a", "abcd", shared, shared, *(text(int(r.integers(0, 900))) for _ in range(52)), text(40_000), "x" * 5000], strict=True)]
    frame = spark.createDataFrame([(i, t, "k") for i, t in rows] + [(None, "no place", "k")], "doc_id long, text string, fingerprint string").repartition(7)
    got = {x.doc_id: x for x in fingerprints.with_next(frame).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert sorted(got) == [i for i, _ in order]
    weigh = lambda a, b: float(not a and not b) if not a or not b else sum(a[d] for d in a.keys() & b.keys()) / min(sum(a.values()), sum(b.values()))
    for (i, own), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        n = len(own) // 4
        edited = own[: len(own) - n] + following[:n]
        a, b, c = (plain_chunks(x.encode()) for x in (own, edited, following))
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(x.near_edited - weigh(a, b)) < 1e-12 and abs(x.near_next - weigh(a, c)) < 1e-12
        for shown, parts in ((x.fingerprint, a), (x.edited_fingerprint, b)):
            assert shown == "".join(f"{d:08x}{k:02x}" for d, k in sorted(parts.items()))
    assert fingerprints.with_next(frame.limit(0)).count() == 0
    alone = fingerprints.with_next(frame.filter("doc_id is not null and length(text) > 100").limit(1)).first()
    assert alone.near_next == 1.0


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_matcher_against_edit_distances():
    r = np.random.default_rng(33)
    word = lambda low, high: "".join("abc"[k] for k in r.integers(0, 3, int(r.integers(low, high))))
    terms = sorted({word(2, 9) + ("*" if k % 3 == 0 else "") for k in range(40)})
    matcher = toxicity.Matcher(terms)
    found = 0
    for w in {word(1, 12) for _ in range(9000)}:
        best = None
        for term in terms:
            t, limit = term.rstrip("*"), matcher.limit(term)
            heads = [w[:k] for k in range(1, len(w) + 1)] if term.endswith("*") else [w]
            cost = min((edits(t[1:], x[1:]) for x in heads if x[0] == t[0]), default=9)
            if cost <= limit:
                best = min(best or (9, 0, ""), (cost, -len(term), term))
        got = matcher.match(w)
        assert got == (None if best is None else (best[0], best[2])), (w, got, best)
        found += got is not None and got[0] == 1
    assert found > 100
