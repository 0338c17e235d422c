"""Cross-parsing against brute force, and languages of held-out texts."""

import zlib

import numpy as np

from siltstone.llm import language_id
from siltstone.llm.language_id import NO_LANGUAGE, Model, letters

VOWELS = {"aa": "aeiou", "bb": "yåäö", "cc": "éèâî"}


def speak(lang: str, seed: int, n: int) -> str:
    r = np.random.default_rng([seed, len(lang), ord(lang[0])])
    own = np.random.default_rng(ord(lang[0]))
    lexicon = ["".join(own.choice(list("bcdfglmnprst")) + own.choice(list(VOWELS[lang])) for _ in range(own.integers(1, 4))) for _ in range(80)]
    return " ".join(r.choice(lexicon, n))


def brute(text: bytes, samples: list) -> int:
    """Phrases of the greedy parse, by searching the sample."""
    joined, data, n = b"\xff".join(b" " + x + b" " for x in samples), b" " + text + b" ", 0
    for begin in range(0, len(data), language_id.STRETCH):
        part, i = data[begin : begin + language_id.STRETCH], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in joined:
                j += 1
            i, n = max(j - 1, i + 1), n + 1
    return n


def test_phrases_equal_brute_force(monkeypatch):
    samples = {k: [letters(speak(k, 100 + i, 30)) for i in range(3)] for k in VOWELS} | {"none": [b"", b""]}
    model = Model(samples)
    assert model.languages == ["aa", "bb", "cc"]
    texts = [letters(speak(k, i, n)) for i, n in enumerate((0, 1, 5, 40, 900)) for k in VOWELS] + [letters("zzz жук qué aaaaaa"), b""]
    want = [[brute(t, samples[k]) for k in model.languages] for t in texts]
    assert model.phrases(texts).tolist() == want
    monkeypatch.setattr(language_id, "LANES", 3)
    assert model.phrases(texts).tolist() == want


def test_automaton_holds_all_substrings():
    r = np.random.default_rng(4)
    for _ in range(30):
        s = r.integers(0, 3, int(r.integers(1, 25))).tolist()
        moves = language_id.suffix_automaton(s)
        held = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        seen, todo = set(), [((), 0)]
        while todo:
            t, state = todo.pop()
            for c, to in moves[state].items():
                seen.add((*t, c))
                todo.append(((*t, c), to))
        assert seen == held


def test_languages_of_held_out_texts(spark, tmp_path):
    rows = [(i, speak(k, i, 5 + i % 60), k, "s", "mine") for i in range(240) for k in [list(VOWELS)[i % 3]]]
    rows += [(1000 + i, rows[0][1], "aa", "hot", "mine") for i in range(100)]  # copies don't fill the sample
    odd = [(2000, None), (2001, ""), (2002, "12 -- 34!"), (2003, speak("bb", 9, 4000)), (2004, "ж")]
    rows += [(i, t, None, None, "mine") for i, t in odd] + [(None, speak("cc", 5, 20), "aa", "s", "mine"), (5, rows[5][1], "cc", "s", "mine")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = language_id.op13_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(0 <= x.score <= 1 for x in got)
    held = [x for x in got if x.held_out and x.doc_id < 1000]
    assert held and all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert sum(x.lang_pred == list(VOWELS)[x.doc_id % 3] for x in held) >= 0.98 * len(held)
    by = {x.doc_id: x for x in got}
    assert [by[i].lang_pred for i in (2000, 2001, 2002, 2003, None)] == [NO_LANGUAGE] * 3 + ["bb", "cc"] and by[2000].score == 0 and by[2004].lang_pred in VOWELS
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert language_id.op13_language_id(spark, f"{tmp_path}/none").count() == 0
    nothing = spark.createDataFrame([(1, "plain text", None)], "doc_id long, text string, lang string")
    assert [tuple(x) for x in language_id.identify(nothing, language_id.fit(nothing)).collect()] == [(1, NO_LANGUAGE, 0.0)]


def test_sample_is_bounded_and_of_distinct_texts(spark):
    rows = [("aa", f"{speak('aa', i, 400)}") for i in range(60)] + [("aa", "same words here")] * 500 + [("bb", speak("bb", 1, 50))]
    got = language_id.sample(spark.createDataFrame(rows, "lang string, text string").repartition(4), 5000)
    assert set(got) == {"aa", "bb"} and 4990 <= sum(map(len, got["aa"])) <= 5000 and got["aa"].count(b"same words here") <= 1
    assert got == language_id.sample(spark.createDataFrame(rows[::-1], "lang string, text string"), 5000)
