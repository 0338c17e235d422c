"""The pipeline's five stages on planted documents, against brute force."""

import zlib

import corpus_pipeline
import numpy as np

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{r.integers(50)}" for i in r.integers(0, len(WORDS), n))


def shingles(text: str) -> set:
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute(docs: dict, items: list) -> dict:
    docs = {i: t for i, t in docs.items() if "idiot" not in t}
    seen, kept = set(), {}
    for i, t in sorted(docs.items()):
        lines = t.split("\n")
        left = [x for x in lines if x not in seen or len(x.split()) < 5]
        seen.update(lines)
        if left:
            kept[i] = "\n".join(left)
    once = {}
    for i, t in kept.items():
        if all(len(shingles(t) & shingles(u)) < 0.8 * len(shingles(t) | shingles(u)) for u in once.values()):
            once[i] = t
    return {i: t for i, t in once.items() if not any(x in t for x in items)}


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = {i: f"{words(i, 30)} {'you idiot' if i % 4 == 0 else ''}".strip() for i in range(80)}
    passage, base, item = words(205, 60), words(206, 120).split(), words(207, 20)
    docs |= {100: f"{words(200, 9)}\n{passage}", 101: f"{passage}\n{words(201, 9)}", 102: passage}
    docs |= {110: " ".join(base), 111: " ".join([*base[:60], "changed", *base[61:]]), 112: f"{words(208, 20)} you idiot"}
    docs |= {120: f"{words(202, 40)} {item} {words(203, 40)}", 121: words(204, 100)}
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute(docs, [item])
    assert not {0, 102, 111, 112, 120} & set(want) and want[101] == words(201, 9)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: r.text_crc32 for i, r in got.items()} == {i: zlib.crc32(t.encode()) for i, t in want.items()}
    assert all(r.round_trip for r in got.values())
