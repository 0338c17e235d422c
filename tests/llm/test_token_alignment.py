"""Aligned tokens against brute force over byte ranges."""

import hashlib
import random
from collections import Counter

import numpy as np

from siltstone.llm import token_alignment
from siltstone.llm.dataset_files import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def brute(texts: list) -> list:
    """Per text: tokens of both sides, groups as lists of token numbers, from the libraries and the common ends."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    with open(A, encoding="utf-8") as f:
        name = {i: k for k, i in json.load(f)["model"]["vocab"].items()}
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in keep)}
    p = sentencepiece.SentencePieceProcessor(model_file=B)
    out = []
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = p.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in name[i]) if i in name else b"" for i in a]
        bytes_b = [bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode() for i in b]
        whole = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            out.append(([], [], []))
            continue
        ends_a, ends_b = (np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b))
        groups, begin = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            groups.append(([i for i, e in enumerate(ends_a) if begin < e <= end], [i for i, e in enumerate(ends_b) if begin < e <= end]))
            begin = end
        out.append((a, b, groups))
    return out


TEXTS = ["the cat sat", "", None, "naïve Übergröße l'été 12345 6,7", "日本語のテキスト 漢字", "a▁b", "<|endoftext|> <s> </s> <unk> <0x41>", "  two  spaces\n\n\tand\r\nlines   ", "😀😀 é ́", "aaaa" * 40, "x\x00y\x1cz\x85\xa0w", "the cat sat", "don't they'll I'VE ’s"]


def test_alignment_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    common = "the of and a in to is was la le der die und de que el information Zeitung niño".split()
    texts = TEXTS + [" ".join(r.choice(common) + r.choice(["", ",", "ing", "\n", "9"]) for _ in range(r.randrange(60))) for _ in range(40)] + [" ".join(r.choice(common) for _ in range(3500))]
    rows = [(i, t, 5, "mine") for i, t in enumerate(texts)] + [(None, "the cat", 5, "mine"), (3, texts[3], 5, "mine")]
    spark.createDataFrame(rows, "doc_id long, text string, n_a int, pair string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute([t for _, t, *_ in rows])
    links = [Counter((a[x], b[y]) for g, h in groups for x in g for y in h) for a, b, groups in want]
    held = Counter(p for x in links for p in x)
    top = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    expected = []
    for (i, *_), (a, b, groups), x in zip(rows, want, links, strict=True):
        form = ";".join(",".join(str(a[k]) for k in g) + "|" + ",".join(str(b[k]) for k in h) for g, h in groups)
        expected.append((str(i), len(a), len(b), len(groups), sum(x.values()), sum(n for p, n in x.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in x.items()), hashlib.sha256(form.encode()).hexdigest() if a else ""))
    got = token_alignment.op12_token_alignment(spark, str(tmp_path)).collect()
    assert sorted((str(x.doc_id), x.n_a, x.n_b, x.n_groups, x.n_links, x.n_best, x.count_sum, x.groups_sha256) for x in got) == sorted(expected)
    assert expected[4][1] > 0 and expected[6][1] > 0 and expected[5][1] == 0  # U+2581 doesn't come back
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert token_alignment.op12_token_alignment(spark, f"{tmp_path}/none").count() == 0


def test_pieces_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    side, r = token_alignment.ByteLevel(A), random.Random(1)
    letters = [chr(c) for c in (*range(0x250), *range(0x2010, 0x2060), 0x20AC, 0x2122, 0x3000, 0x4E00, 0x1F600)] + list(" \n\t's") * 40
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(80))) for _ in range(1500)]
    assert [x.tolist() for x in side.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_groups_by_pointer_jumping():
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(1, 60))
        a, b = (np.unique(np.append(r.integers(1, n + 1, r.integers(1, 30)), n)) for _ in range(2))
        group_a, group_b = token_alignment.token_groups(a, b)
        common = np.intersect1d(a, b)
        assert (group_a == np.searchsorted(common, a)).all() and (group_b == np.searchsorted(common, b)).all()


def test_large_groups_are_counted_together(monkeypatch):
    r = np.random.default_rng(3)
    a, b = r.integers(0, 3, 50).astype(np.uint32), r.integers(0, 4, 30).astype(np.uint32)
    group_a, group_b = np.repeat([0, 1], [10, 40]), np.repeat([0, 1], [5, 25])

    def totals():
        out = Counter()
        for g, p, n in zip(*token_alignment.group_links(a, b, group_a, group_b), strict=True):
            out[int(g), int(p)] += int(n)
        return out

    plain = totals()
    monkeypatch.setattr(token_alignment, "LARGE_GROUP", 100)
    assert totals() == plain and sum(plain.values()) == 1050
