"""Corpus operators on small tables, against brute force, exact round trips and planted cases."""

import functools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import common, dataset_files, decontamination, fingerprints, html_text, language_model, line_dedup, near_duplicates, sentencepieces, sharding, toxicity

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{r.integers(50)}" for i in r.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    base = words(1, 120)
    near = " ".join([*base.split()[:60], "changed", *base.split()[61:]])  # 111 of 121 shingles shared
    rows = [(1, base), (2, base), (3, near), (4, words(2, 80)), (5, None), (6, ""), (7, "one two"), (8, "one two"), (9, words(3, 3000)), (10, "É\n \t x")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_near_duplicates(docs):
    got = {r.doc_id: r for r in near_duplicates.near_duplicates(docs, 85).collect()}
    assert {i: r.component_id for i, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10}
    assert got[5].n_shingles == 0 and got[7].n_shingles == 1 and got[5].kept and not got[8].kept
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_estimate_of_sketches():
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate((a[:1800], r.integers(0, 1 << 63, 200, dtype=np.uint64))))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(near_duplicates.estimate(near_duplicates.sketch(a), near_duplicates.sketch(b), len(a), len(b)) - j) < 0.1


def test_sharding(docs):
    rows = sharding.sort_into_shards(docs, 3).collect()
    assert len(rows) == 10
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.sort_into_shards(docs.limit(0), 3).count() == 0


def test_sharding_against_brute_force(spark):
    rows = [(i, words(i, 40) if i % 3 else "the same text " * 20, "k", 1, 2, 3, "e") for i in range(600)] + [(None, "no id", "k", 1, 2, 3, "e"), (700, None, "k", 1, 2, 3, "e")]
    d = spark.createDataFrame(rows, "doc_id long, text string, key string, shift int, part int, nth int, edges string").repartition(7)
    got = sharding.sort_into_shards(d, 8, 0.02).collect()
    want = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == want and all((r.key, r.shift, r.part, r.nth, r.edges) == ("k", 1, 2, 3, "e") for r in got)
    held = {s: [r for r in got if r.shard == s] for s in range(8)}
    mean = sum(n for n, _ in want.values()) / 8
    assert all(sorted(r.slot for r in x) == list(range(len(x))) and abs(sum(r["size"] for r in x) - mean) < 700 for x in held.values())


def test_token_files(docs):
    files = common.stored(dataset_files.write_shards(docs, dataset_files.tokenizer_path("word_bpe_49k.json"), shard_tokens=500), "t")
    got = {r.doc_id: r for r in dataset_files.read_shards(files).collect()}
    from tokenizers import Tokenizer

    t, start = Tokenizer.from_file(dataset_files.tokenizer_path("word_bpe_49k.json")), 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip(seed):
    r = np.random.default_rng(seed)
    ids = r.integers(0, 4, 3000).astype(np.uint32) if seed else np.zeros(1000, np.uint32)
    payload = dataset_files.pack(np.arange(3), np.array([10, 10, len(ids)]), ids)
    shard = dataset_files.Shard(payload)
    assert (shard.all() == ids).all() and (shard.document(0) == ids[:10]).all() and not len(shard.document(1)) and (shard.document(2) == ids[10:]).all()
    assert len(payload) < 40 + 4 * len(ids)


def test_sentencepieces_equal_the_library(docs):
    import sentencepiece

    path = dataset_files.tokenizer_path("piece_bpe_32k.model")
    p, c = sentencepiece.SentencePieceProcessor(model_file=path), sentencepieces.codec(path)
    texts = ["", " ", "The  cat\nsat", "é 日本語 \U0001f600", "aaaa aaaaaaa", *(words(i, 50) for i in range(20))]
    assert [x.tolist() for x in c.encode(texts)] == p.encode(texts)
    assert [c.decode(x.tolist()) for x in c.encode(texts)] == texts
    assert all(r.round_trip for r in sentencepieces.round_trips(docs, path).collect())


def test_re_pair_runs_to_its_end():
    from collections import Counter

    r = np.random.default_rng(3)
    for least in (2, 3, 5, 16):
        for n in (0, 1, 2, 50, 3000):
            ids = r.integers(0, r.integers(1, 9), n).astype(np.uint32)
            rules, spans, seq = dataset_files.compress(ids, least)
            assert (dataset_files.expand(rules, spans, seq) == ids).all()
            assert [len(dataset_files.expand(rules, spans, np.array([dataset_files.FIRST_RULE + k], np.uint32))) for k in range(len(rules))] == spans.tolist()
            left = Counter(zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True))
            assert all(k < least for (a, b), k in left.items() if a != b)


def test_words_equal_the_tokenizer():
    from tokenizers import Tokenizer

    texts = ["", "foo<|endoftext|>bar <|startoftext|>", "İstanbul ﬁne ŉ ſx it's They'LL 12a3 ß ẞ Σας ς é", "a\u00a0b\u2003“x” «y» ª º µm \x01\x02 a\x1cb", "漢字 e\u0301 \u0301x $$$ <b>", *(words(i, 50) for i in range(5))]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = dataset_files.tokenizer_path(name)
        t, e = Tokenizer.from_file(path), dataset_files.WordEncoder(path)
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        for _ in range(2):  # new words, then remembered ones
            assert [np.frombuffer(x, "<u4").tolist() for x in e.encode([x.encode() for x in texts])] == want
        assert e.by_words == (name == "word_bpe_49k.json")


def test_unigram_walk_is_the_best_segmentation():
    class V:
        unigram, score, worst = True, {"a": -1.0, "b": -1.5, "ab": -1.8, "abc": -4.0, "c": -1.0, "bc": -1.2}, -20.0
        id = {p: i for i, p in enumerate(score)}
        below, ends = sentencepieces.piece_trie(id)
        score_of = list(score.values())
        fallback = staticmethod(lambda c: [99])

    def best(w):
        return max(((s + best(w[k:])[0], (w[:k], *best(w[k:])[1])) for k in range(1, len(w) + 1) if (s := V.score.get(w[:k], V.worst if k == 1 else None)) is not None), default=(0.0, ())) if w else (0.0, ())

    walk = sentencepieces.SharedPrefixEncoder(V)
    for w in sorted(["a", "ab", "abc", "abcab", "bcab", "cxa"]):
        assert walk.encode(w) == [V.id.get(p, 99) for p in best(w)[1]]


def test_toxicity_keeps_clashing_columns(spark):
    model = toxicity.Model(["idiot"], {(False, 0, False): 0.9, (False, 0, True): 0.2, (False, 1, False): 0.7}, 0.1, {"wrote"})
    texts = ["you idiot", "he wrote idiot to us", "plain words", None, "", "you idoit and idiot " + "word " * 3000]
    d = spark.createDataFrame([(i, t, "mine", 7, "k") for i, t in enumerate(texts)], "doc_id long, text string, score string, n_hits int, kept string")
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert [got[i].predicted for i in range(6)] == [1, 0, 0, 0, 0, 1] and got[2].score == got[3].score == 0.1 < got[1].score < 0.5
    kept = {r.doc_id: r for r in toxicity.without_toxic(d, model).collect()}
    assert set(kept) == {1, 2, 3, 4} and kept[1].score == "mine" and kept[1].kept == "k"
    assert toxicity.score(d.limit(0), model).count() == 0


def test_levenshtein_trie():
    m = toxicity.Matcher(["idiot", "lowei*", "vequ*", "bad"])
    assert m.match("idiot") == (0, "idiot") and m.match("idot") == (1, "idiot") and m.match("idioot") == (1, "idiot") and m.match("idxxt") is None
    assert m.match("loweischaft") == (0, "lowei*") and m.match("bat") is None and m.match("idiotic") is None


def test_toxicity(spark):
    rows = [(i, f"{words(i, 30)} {'you idiot' if i % 4 == 0 else ''}", int(i % 4 == 0)) for i in range(80)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, labels)).collect()}
    assert all(got[i].predicted == x for i, _, x in rows) and got[900].predicted == 0
    assert toxicity.score(d, toxicity.fit(d, labels.limit(0))).filter("score > 0").count() == 0


def test_quoted():
    t = 'he was "an idiot here" today'
    assert toxicity.quoted(t, t.index("idiot"), t.index("idiot") + 5, set())
    assert not toxicity.quoted("what an idiot", 8, 13, set())
    assert toxicity.quoted("she wrote an idiot", 13, 18, {"wrote"}) and not toxicity.quoted("she wrote\nan idiot", 13, 18, {"wrote"})


def test_html(spark):
    nav = "<nav><a>Home</a></nav>"
    rows = [(1, "http://h/1", f"<html>{nav}<article><h1>A &amp; B</h1><p>x <b>y</b><p>z<aside>no</aside></article><footer>f</footer>"), (2, "http://h/2", None), (3, None, "<p>plain")]
    rows += [(10 + i, f"http://k/{i}", f"<div>{words(i, 12)}</div><div>welcome to the very best site of all</div>") for i in range(3)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "A & B\n\nx y\n\nz" and got[2] == "" and got[3] == "plain"
    assert got[11] == words(1, 12)


def test_html_drops_only_what_a_host_repeats(spark):
    shared, notice = words(60, 30), words(61, 10)
    rows = [(i, f"http://ads-track{i}.example.org/", f"<div>{words(i, 12)}</div><div>{shared}</div>") for i in range(4)]  # one text on several hosts
    rows += [(10 + i, f"http://k/{i}", f"<div>{shared}</div>") for i in range(4)]  # one page at several addresses
    rows += [(20 + i, f"http://m/{i}", f"<div>{words(20 + i, 12)}</div><div>{shared if i < 3 else notice}</div>") for i in range(8)]  # quoted by three of eight pages
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"{words(i, 12)}\n\n{shared}" for i in range(4)) and all(got[10 + i] == shared for i in range(4))
    assert all(got[20 + i] == (f"{words(20 + i, 12)}\n\n{shared}" if i < 3 else words(20 + i, 12)) for i in range(8))


def test_html_keeps_articles_with_telling_names():
    long = words(70, 40)
    for page in (
        f"<article class='widget'><p>{long}</p></article>",
        f"<div class='main-content has-sidebar'><p>{long}</p></div><div class='sidebar'>{words(71, 20)}</div>",
        f"<main><section id='search'><p>{long}</p></section></main>",
        f"<article><p class='share-price'>{long}</p><div class='ad-slot-2 x'>{words(72, 20)}</div></article>",
        f"<div class='post related-work'>{long}</div><ul class='share_buttons'><li>{words(73, 9)}</li></ul>",
        f"<div class='social-sciences'>{long}</div><div role='search'>{words(74, 9)}</div>",
    ):
        assert [t for p, t in html_text.blocks(page) if p != html_text.OUTSIDE] == [long]


def test_html_leaves_readers_and_forms_out():
    kept = lambda page: [t for p, t in html_text.blocks(page) if p != html_text.OUTSIDE]
    story, said, long = words(90, 30), words(91, 12), words(92, 300)
    assert kept(f"<main><p>{story}</p><article class='comment'>{said}</article></main>") == [story]
    assert kept(f"<div id='main'><p>{story}</p></div><article class='comment'>{said}</article>") == [story]
    assert kept(f"<form id='f'><input><article><p>{story}</p></article></form>") == [story]
    assert kept(f"<div><p>{story}</p></div><form><p>{said}</p><label>name</label></form>") == [story]
    assert kept(f"<article><p>{story}</p><div class='comments'>{long}</div></article>") == [story]
    assert kept(f"<article><p>{story}</p></article><div class='sidebar'>{long}</div>") == [story]
    assert kept(f"<div>{story}</div><section class='comments'><article>{long}</article></section>") == [story]
    for name in ("cookie-message", "user-comment", "comment-body", "author-comments", "reader-responses", "comment_text-12"):
        assert kept(f"<article><p>{story}</p><div class='{name}'>{said}</div></article>") == [story]
    assert kept("<article><p>let <math><mi>x</mi></math> be</p><p><label>a label</label></p></article>") == ["let x be", "a label"]
    assert kept(f"<article><p>{long}</p></article><article><p>{said}</p></article>") == [long]
    assert kept(f"<div class='sidebar'>{said}</div>") == [said]  # there is nothing else


def _brute_runs(pages):
    """Windows of RUN words that so many distinct pages of one host hold."""
    held = {}
    for i, page in enumerate(dict.fromkeys(pages)):
        w = page.split()
        for k in range(len(w) - html_text.RUN + 1):
            held.setdefault(tuple(w[k : k + html_text.RUN]), set()).add(i)
    n = len(set(pages))
    return {k for k, x in held.items() if len(x) >= max(html_text.LEAST_PAGES, html_text.SHARE * n)}


def test_html_repeats_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(5)
    shared = [words(80 + k, int(r.integers(4, 25))) for k in range(6)]
    pages = []
    for i in range(60):
        lines = [words(2000 + i, int(r.integers(20, 40))), *(shared[k] for k in range(6) if r.random() < 0.15 * (k + 1))]
        pages.append([lines[k] for k in r.permutation(len(lines))])
    pages += pages[:5]  # repeated pages count once
    rows = [(i, f"http://h/{i}", "<article>" + "".join(f"<p>{t}</p>" for t in x) + "</article>") for i, x in enumerate(pages)]
    d = spark.createDataFrame([(*x, "mine") for x in rows], "page_id long, url string, html string, host string")
    repeated = _brute_runs([" ".join(x) for x in pages])
    want = {}
    for i, x in enumerate(pages):
        w, owner = " ".join(x).split(), [k for k, t in enumerate(x) for _ in t.split()]
        covered = [False] * len(w)
        for k in range(len(w) - html_text.RUN + 1):
            if tuple(w[k : k + html_text.RUN]) in repeated:
                covered[k : k + html_text.RUN] = [True] * html_text.RUN
        whole = {k for k in range(len(x)) if all(c for c, o in zip(covered, owner, strict=True) if o == k)}
        fits = sum(len(x[k].split()) for k in whole) <= html_text.MOST * len(w)
        want[i] = "\n\n".join(t for k, t in enumerate(x) if not (fits and k in whole))
    assert any(len(want[i]) < len("\n\n".join(x)) for i, x in enumerate(pages))
    for array_pages in (2000, 7):  # one array for the host, and many that are merged
        assert {r.page_id: r.text for r in html_text.main_text(d, array_pages).collect()} == want
    assert html_text.main_text(d.limit(0)).count() == 0
    # the array decides: out of order it finds nothing that holds on three pages
    hosts, streams = np.zeros(60, np.int64), np.arange(60)
    kept = [([html_text.KEPT] * len(x), x) for x in pages[:60]]
    assert html_text.Streams(hosts, streams, kept).repeated().any()
    monkeypatch.setattr(html_text, "suffix_order", lambda t, depth: (np.random.default_rng(0).permutation(len(t)), np.arange(len(t))))
    assert not html_text.Streams(hosts, streams, kept).repeated().any()


def test_line_dedup(spark):
    passage = words(5, 60)
    d = spark.createDataFrame([(1, f"{words(1, 9)}\n{passage}\nend"), (2, f"{passage}\n{words(2, 9)}"), (3, words(3, 9)), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(d).collect()}
    assert passage in got[1] and got[2] == words(2, 9) and got[3] == words(3, 9) and got[4] is None


def test_line_dedup_finds_what_any_earlier_document_holds(spark):
    line, short = words(5, 8), "ab cd\nef\n\ngh ij"
    texts = [f"{line}\nx", f"{line}\n{words(1, 9)}\n{line}", f"{line}\n{words(2, 9)}\n{line}\ny", f"{short}\nz", f"q\n{short}", f"ab cd\n{words(3, 9)}", f"{words(3, 9)}\n{short}\nq", "u v\ngh ij"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(d).collect()}
    assert got[1].count(line) == 1 and got[2] == f"{words(2, 9)}\ny"
    assert (got[0], got[3], got[4], got[5], got[6], got[7]) == (texts[0], texts[3], "q", texts[5], "q", texts[7])


def test_line_dedup_aligns_one_chain(spark):
    six = [words(i, 9) for i in range(20, 26)]
    one, other = words(30, 60), words(31, 60)
    texts = ["\n".join(six), "\n".join(six[::-1]), f"{words(32, 9)}\n{one}\n{words(33, 9)}\n{other}", f"{other}\n{words(34, 9)}\n{one}"]
    d = spark.createDataFrame([(i, t, "mine", "mine too") for i, t in enumerate(texts)], "doc_id long, text string, later string, n_lines string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert got[1].n_removed == 1  # a chain of patience diff holds one of reversed lines
    assert got[3].text == words(34, 9) and got[3].later == "mine" and got[3].n_lines == 3  # long passages go though they cross
    assert line_dedup.dedup_lines(d.limit(0)).count() == 0


def test_line_dedup_against_brute_force(spark):
    r = np.random.default_rng(11)
    pool = [words(1000 + k, int(r.integers(5, 12))) for k in range(60)]
    held = [np.sort(r.choice(60, int(r.integers(1, 12)), replace=False)) for _ in range(60)]  # one order, so that nothing crosses
    d = spark.createDataFrame([(i, "\n".join(pool[k] for k in own)) for i, own in enumerate(held)], "doc_id long, text string").repartition(5)
    seen, want = set(), {}
    for i, own in enumerate(held):
        want[i] = "\n".join(pool[k] for k in own if k not in seen)
        seen.update(own.tolist())
    for rare in (0, 2, 1000):
        gone = {x.later: set(x.gone) for x in line_dedup.repeated_lines(d, rare_docs=rare).collect()}
        assert {i: "\n".join(pool[k] for n, k in enumerate(own) if n not in gone.get(i, ())) for i, own in enumerate(held)} == want


def test_line_dedup_of_long_documents():
    r = np.random.default_rng(12)
    n = 20_000
    one, two = (r.integers(-(2**62), 2**62, 2 * n) for _ in range(2))
    one[1::2] = two[1::2] = 7  # a blank line after each
    filled = np.where(np.arange(2 * n) % 2, 0, 9)
    two[1000:1020], two[30_000:30_020] = one[25_000:25_020], one[5_000:5_020]  # 90 words each; the second crosses the first
    gone = line_dedup.aligned(one, two, filled)
    assert set(np.flatnonzero(gone[::2]) * 2) == {*range(1000, 1020, 2), *range(30_000, 30_020, 2)}


def test_dropped_copies_and_leaks_with_clashing_columns(spark):
    base, item = words(95, 60), words(96, 20)
    d = spark.createDataFrame([(1, base, "a", "b", "c"), (2, base, "a", "b", "c"), (3, f"{words(97, 9)} {item}", "a", "b", "c"), (None, base, "a", "b", "c")], "doc_id long, text string, gone string, leak string, __gone string")
    assert sorted(map(str, (r.doc_id for r in near_duplicates.one_of_each(d, 80).collect()))) == ["1", "3", "None"]
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    left = decontamination.without_leaks(d.withColumnRenamed("__gone", "__leak"), items).collect()
    assert sorted(map(str, (r.doc_id for r in left))) == ["1", "2", "None"] and left[0].leak == "b"
    assert near_duplicates.one_of_each(d.limit(0), 80).count() == decontamination.without_leaks(d.limit(0), items).count() == 0


def test_decontamination(spark):
    item = words(6, 20)
    d = spark.createDataFrame([(1, f"{words(1, 500)} {item} {words(2, 500)}"), (2, words(3, 500)), (3, " ".join(item.split()[:18])), (4, " ".join(item.split()[:8])), (5, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item.upper()), (8, None), (9, "too short")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, items).collect()} == {(1, 7), (3, 7)}


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.with_next(docs).collect()}
    assert len(got) == 10 and got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0
    assert 0.6 < got[9].near_edited < 1 and got[9].near_next < 0.1
    text = words(9, 400).encode()
    assert fingerprints.likeness(fingerprints.chunks(text), fingerprints.chunks(b"shift " + text)) > 0.95


def test_language_model(docs):
    rows = language_model.score(docs, common.is_held("doc_id", 7, 2)).collect()
    assert len(rows) == 10 and all(r.score < 0 for r in rows)
    assert {r.train_tokens for r in rows} == {sum(len((r.text or "").lower().split()) + 1 for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2)}


def test_language_model_counts_and_base(spark, docs):
    """All counts and the base against a plain recount: nulls, repeated rows, a null id, a clashing column, a long text."""
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()] + [(i, words(i, 40) + f" Only{i}", None if i % 2 else "de") for i in range(11, 40)] + [(11, "twice"), (11, "twice"), (None, "nobody learns this"), (60, words(60, 6000))]
    rows = [(*r, "en")[:3] for r in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit("clash"))
    is_held = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").lower().split(), ""]
    learnt = Counter(t for i, text, _ in rows if not is_held(i) for t in tokens(text))
    n, v = sum(learnt.values()), len(learnt)
    want = sorted((i or -1, is_held(i), len(tokens(t)), sum(learnt[x] > 0 for x in tokens(t)), n, round(sum(math.log10((learnt[x] + 1) / (n + v + 1)) for x in tokens(t)), 6)) for i, t, _ in rows)
    got = language_model.score(frame, common.is_held("doc_id", 7, 2), block_bytes=4000).collect()
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert any(is_held(i) for i, _, _ in rows if i) and all(r.bits_per_byte > 0 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert math.isclose(by_id[60].bits_per_byte, -by_id[60].score * math.log2(10) / sum(len(t.encode()) + 1 for t in tokens(rows[-1][1])))
    assert language_model.score(frame.limit(0), common.is_held("doc_id", 7, 2)).count() == 0


def test_tree_against_recursion(spark):
    """Context-tree weighting by recursion over all contexts; the result doesn't follow how contexts are dealt."""
    rng, depth = np.random.default_rng(5), language_model.DEPTH
    grams = sorted({sum(int(x) << 8 * j for j, x in enumerate(rng.choice([97, 98, 195], depth + 1))) for _ in range(150)})
    counts = rng.integers(0, 4, (len(grams), 2))
    held: dict = {}
    for g, own in zip(grams, counts, strict=True):
        for c, n in enumerate(own):
            symbols = (c, *((g >> 8 * j) & 255 for j in range(1, depth + 1)))
            for k in range(8):
                for d in range(depth + 2):
                    at = held.setdefault((symbols[:d], 1 << k | (g & 255) >> (8 - k)), [0, 0, set()])
                    at[(g >> (7 - k)) & 1] += int(n)
                    if d <= depth:
                        at[2].add(symbols[: d + 1])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def weighted(context, node):
        a, b, children = held[context, node]
        if len(context) == depth + 1:
            return kt(a, b), -math.inf
        below = sum(float(np.logaddexp(*weighted(x, node)) - math.log(2)) if len(x) <= depth else weighted(x, node)[0] for x in children)
        return kt(a, b), below

    def one(symbols, node):
        left, p = 1.0, 0.0
        for d in range(depth + 2):
            a, b, _ = held[symbols[:d], node]
            pe, below = weighted(symbols[:d], node)
            w = 1 / (1 + math.exp(below - pe)) if d <= depth else 1.0
            p, left = p + left * w * (b + 0.5) / (a + b + 1), left * (1 - w)
        return p

    frame = spark.createDataFrame([(g, *map(int, c)) for g, c in zip(grams, counts, strict=True)], "gram long, c0 long, c1 long")
    got = {r.gram: r.log_p for r in language_model.context_tree(frame, 2).collect()}
    for g in grams:
        for c in range(2):
            symbols = (c, *((g >> 8 * j) & 255 for j in range(1, depth + 1)))
            ps = [(one(symbols, 1 << k | (g & 255) >> (8 - k)), (g >> (7 - k)) & 1) for k in range(8)]
            assert math.isclose(got[g][c], sum(math.log(p if bit else 1 - p) for p, bit in ps), rel_tol=1e-7)


def test_tree_is_a_distribution(spark):
    """The probabilities of all bytes after a context sum to one."""
    grams = np.arange(256, dtype=np.int64) | (int.from_bytes(b"abcd", "big") << 8)
    rows = [(int(g), 3 if g & 255 == 97 else 0) for g in grams]
    out = language_model.context_tree(spark.createDataFrame(rows, "gram long, c0 long"), 1).collect()
    assert abs(sum(np.exp(r.log_p[0]) for r in out) - 1) < 1e-9


def test_vocabulary_is_dealt_by_ranges_of_bytes(spark, monkeypatch):
    rng = np.random.default_rng(5)
    begins = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(40)]
    words = [b + e for b in begins for e in ("", "ab", "cd", "ef", "gh", "ij", "kl", "mn", "op", "qr")]
    docs = spark.createDataFrame([(i, " ".join(rng.permutation(words)[:200]), "en") for i in range(6)], "doc_id long, text string, lang string")
    kept = {}
    monkeypatch.setattr(language_model, "stored", lambda df, label, put=language_model.stored: kept.setdefault(label, put(df, label)))
    whole = {r.doc_id: r.score for r in language_model.score(docs, F.lit(False)).collect()}
    kept.clear()
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 10)
    assert {r.doc_id: r.score for r in language_model.score(docs, F.lit(False)).collect()} == pytest.approx(whole, rel=1e-12)
    tokens = [bytes(r.token) for r in kept["vocabulary"].collect()]
    size = lambda part: len(np.unique(language_model._bytes_and_contexts(part)[0]))
    anyhow = sum(size([tokens[k] for k in part]) for part in np.array_split(rng.permutation(len(tokens)), len(tokens) // 10))
    assert kept["grams"].count() < 0.6 * anyhow
    bounds = language_model.vocabulary_bounds([b"x" * 99] + [b"a%d" % k for k in range(100)], 4)
    assert 1 <= len(bounds) <= 3 and bounds == sorted(bounds) and language_model.vocabulary_bounds([], 4) == [] and language_model.vocabulary_bounds([b""], 1) == []


def test_pairs_are_sorted_with_their_places():
    rng = np.random.default_rng(2)
    for most, n in (((1 << 17) + 5, 1 << 18), (1 << 30, 1 << 20)):  # in one number, and in two
        left, right = rng.integers(most - 3, most + 1, (2, 500)).astype(np.uint32)
        places = rng.permutation(n)[:500]
        again = np.concatenate((np.arange(500), np.arange(0, 500, 7)))  # repeated places count once
        pairs, at, bits = dataset_files._sorted_pairs(left[again], right[again], places[again], most, n)
        got = list(zip((pairs >> bits).tolist(), (pairs & np.uint64((1 << int(bits)) - 1)).tolist(), at.tolist(), strict=True))
        assert got == sorted(zip(left.tolist(), right.tolist(), places.tolist(), strict=True))
    ids = np.tile(np.arange(3000), 40)  # more rules than the first table of lengths has room for
    rules, spans, seq = dataset_files.compress(ids.astype(np.uint32))
    assert len(rules) > 2000 and len(spans) == len(rules) and (dataset_files.expand(rules, spans, seq) == ids).all() and len(seq) < 100
