"""Ledgers, ingestion and cache over batches that come again; selection, keyed hashes, streams against their batch twins."""

import hashlib
import hmac
import math
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import finance, scalars, table_functions
from siltstone.operators import chunks, dense_index, graph, lexical_index, retrieval
from siltstone.sources.ledger import Ledger
from siltstone.streaming import jobs


def run(stream):
    stream.processAllAvailable()
    stream.stop()


def test_ledger(spark, tmp_path):
    ledger = Ledger(spark, f"{tmp_path}/t", "x int")
    one = lambda *x: spark.createDataFrame([(v,) for v in x], "x int")
    assert ledger.read().count() == 0 and ledger.append(0, one(1, 2)) and not ledger.append(0, one(9))
    one(7).write.parquet(f"{tmp_path}/t/parts/5-lost")  # a batch that broke off before its commit
    (tmp_path / "t/commits/5/_temporary").mkdir(parents=True)
    assert sorted(r.x for r in ledger.read().collect()) == [1, 2] and ledger.append(5, one(3))
    assert sorted(r.x for r in ledger.read().collect()) == [1, 2, 3] and [r.x for r in ledger.read(5).collect()] == [3]
    ledger.append(6, one(8), whole=True)
    ledger.append(7, one(4))
    assert sorted(r.x for r in Ledger(spark, f"{tmp_path}/t", "x int").read().collect()) == [4, 8]


def test_ingest_survives_restart_and_overlap(spark, tmp_path):
    schema = "doc_id long, page int, text string"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    table = "# T\nbefore\n| a | b |\n| --- | --- |\n| 1 | 2 |\nafter"
    put(0, [(1, 1, "# A\nalpha text"), (1, 2, table)])
    start = lambda check: run(jobs.ingest(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/{check}"))
    start("check")
    held, index = Ledger(spark, f"{tmp_path}/store/chunks", jobs.CHUNKS), Ledger(spark, f"{tmp_path}/store/index", jobs.INDEX)
    counts = lambda: (jobs.stored_chunks(held).count(), held.read().count(), index.read().count())
    first = counts()
    assert first[0] == first[1] == first[2] >= 3 and {r.chunk_type for r in index.read().collect()} == {"text", "table"}
    put(1, [(1, 1, "# A\nalpha text"), (2, 1, "alpha text")])  # a page again, and its text in another document
    start("check")
    assert counts() == tuple(n + 1 for n in first)
    start("lost-checkpoint")  # all files again, as batch 0: nothing is written twice
    assert counts() == tuple(n + 1 for n in first)
    pages = spark.createDataFrame([(2, 9, "alpha text")], schema)
    jobs.ingest_batch(pages, 100, held, index)  # the same content on another page: newest page, old id
    row = jobs.stored_chunks(held).filter("document_id = 2").first()
    assert row.page == 9 and counts() == (first[0] + 1, first[1] + 2, first[2] + 1)


def test_cache_replaces_and_judges_at_read(spark, tmp_path):
    t = datetime(2026, 9, 1)
    hit = lambda url, day: [(0, "t", url, "s", day, 1, 0.5), (1, "t", "future", "s", "2030-01-01", 1, 0.9)]
    rows = lambda *x: spark.createDataFrame(x, jobs.CACHE)
    cache = Ledger(spark, f"{tmp_path}/c", jobs.CACHE)
    for number in (0, 1, 1):
        found = rows(("k", "latest news", t, t + timedelta(days=2), hit("old", "2026-08-30")), ("gone", "q", t, t + timedelta(hours=1), hit("x", None))) if not number else rows(("k", "latest news", t + timedelta(hours=1), t + timedelta(days=3), hit("new", "2024-01-01")))
        jobs.cache_batch(found, number, cache)
    keys = spark.createDataFrame([("k",), ("gone",), ("none",)], "cache_key string")
    read = lambda now: [(r.url, r.date_status) for r in jobs.cached_results(jobs.cache_rows(cache), keys, F.lit(now).cast("timestamp")).collect()]
    assert read(str(t + timedelta(days=1))) == [("new", "stale")] and read(str(t + timedelta(days=3))) == []
    assert sorted(read(str(t + timedelta(minutes=5)))) == [("new", "stale"), ("x", "undated")]


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_nearest_rank(spark, rounds):
    r = random.Random(rounds)
    groups = {"even": list(range(1000)), "one": [7.0], "same": [3.0] * 50, "wild": [r.expovariate(1) ** 9 for _ in range(3000)], "low": [-1e300, 1e300, 0.0, 0.0]}
    rows = spark.createDataFrame([(g, float(v)) for g, x in groups.items() for v in x] + [("none", None)], "g string, v double")
    for share in (0.5, 0.95, 1.0):
        got = {x.g: (x.n, x.p) for x in finance.nearest_rank(rows, "v", share, "g", rounds=rounds).collect()}
        assert got == {g: (len(x), sorted(x)[max(1, math.ceil(len(x) * round(share * 100) / 100 - 1e-9)) - 1]) for g, x in groups.items()}
    assert finance.nearest_rank(rows.filter("g = 'even'"), "v", 0.95, rounds=rounds).first().p == 949
    assert finance.summary(rows.filter("g = 'none'"), "v").first().n == 0


def test_nearest_rank_of_a_million_values(spark):
    rows = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).cast("double").alias("v"))
    got = finance.nearest_rank(rows, "v", 0.95).first()
    assert (got.n, got.p) == (1_000_000, sorted(i * 7919 % 1_000_003 for i in range(1_000_000))[949_999])


def test_keyed_hash_is_hmac(spark, tmp_path):
    names = ["", "10.0.0.1", "é", "x" * 300]
    for secret in ("k", "秘" * 40):
        got = spark.createDataFrame([(n,) for n in names], "a string").select(scalars.keyed_hash("a", secret).alias("h")).collect()
        assert [r.h for r in got] == [hmac.new(secret.encode(), n.encode(), hashlib.sha256).hexdigest()[:24] for n in names]
    rows = [(datetime(2026, 1, 1), "POST", 403, "10.0.0.1"), (datetime(2026, 1, 1), "GET", 200, "10.0.0.2"), (datetime(2026, 1, 2), "DELETE", 200, None)]
    for part in (rows[:2], rows[2:]):  # the feed goes on where it stopped
        spark.createDataFrame(part, "ts timestamp, method string, status int, client string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("ts timestamp, method string, status int, client string").parquet(f"{tmp_path}/in")
        run(jobs.audit_feed(stream, f"{tmp_path}/out", f"{tmp_path}/check", "k"))
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {(r.outcome, r.client, str(r.day)) for r in got} == {("denied", scalars_hash("10.0.0.1"), "2026-01-01"), ("success", scalars_hash("None"), "2026-01-02")} and len(got) == 2


def scalars_hash(a: str) -> str:
    return hmac.new(b"k", a.encode(), hashlib.sha256).hexdigest()[:24]


def test_sliding_p95_of_a_stream(spark, tmp_path):
    r, t = random.Random(3), datetime(2026, 1, 1)
    rows = [(t + timedelta(minutes=r.randrange(60 * 30)), r.choice("ab"), r.choice([r.random() * 100, r.expovariate(0.01), -1.0])) for _ in range(2000)]
    schema = "ts timestamp, event_type string, value double"
    spark.createDataFrame(sorted(rows), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    batch = jobs.windowed_p95(spark.read.parquet(f"{tmp_path}/in"))
    whole = {(x.start, x.event_type): x for x in batch.collect()}
    for (start, kind), x in whole.items():
        own = sorted(v for ts, k, v in rows if k == kind and v > 0 and start <= ts < start + timedelta(hours=24))
        exact = own[math.ceil(0.95 * len(own) - 1e-9) - 1]
        assert x.n == len(own) and exact * (1 - 1e-6) <= x.p95 <= exact * jobs.GROWTH * (1 + 1e-6)
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    start_ = lambda: run(jobs.windowed_p95(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").start())
    start_()
    for late in ([(t + timedelta(days=9), "a", 1.0)], [(t, "a", 1e9)], [(t + timedelta(days=20), "a", 1.0)]):  # moves the watermark; a late row; ends the rest
        spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        start_()
    got = {(x.start, x.event_type): x for x in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert all(got[k].n == x.n and got[k].p95 == x.p95 for k, x in whole.items())


def test_limiter_of_a_stream(spark, tmp_path):
    schema = "key string, seq long, ts double"
    rows = [("a", 1, 100.0), ("a", 2, 101.0), ("a", 3, 102.0), ("a", 4, 161.0), ("b", 5, 102.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.limit_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2, 60.0)
    query = stream.writeStream.outputMode("append").format("memory").queryName("limited").option("checkpointLocation", f"{tmp_path}/check").start()
    end = time.time() + 60  # a timeout by the clock keeps a query busy for ever
    while spark.table("limited").count() < 5 and time.time() < end:
        time.sleep(0.5)
    query.stop()
    want = {(r.seq, r.allowed) for r in jobs.limit_batch(spark.createDataFrame(rows, schema), 2, 60.0).collect()}
    assert {(r.seq, r.allowed) for r in spark.table("limited").collect()} == want == {(1, True), (2, True), (3, False), (4, True), (5, True)}


def test_first_snapshots_keep_the_row(spark):
    rows = spark.createDataFrame([("u", "s", datetime(2026, 1, 2), "later"), ("u", "s", datetime(2026, 1, 1), "first"), (None, "s", datetime(2026, 1, 1), "x")], "url string, snippet string, ts timestamp, title string")
    assert [(r.url, r.title) for r in jobs.first_snapshots(rows).collect()] == [("u", "first")]


def test_table_functions(spark):
    table_functions.register(spark)
    got = spark.sql("SELECT d.id, s.* FROM VALUES (1, 'a\n# H #\nb\n## E\n'), (2, NULL), (3, '#\n\nx') AS d(id, text), LATERAL text_sections(text) AS s ORDER BY id, pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, "正文", "a"), (1, 1, "H", "b")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM text_chunks('one\n\ntwo', 4, 2)").collect()] == [(0, "one", 3), (1, "netwo", 5)]


def test_pack_against_a_plain_walk():
    """Units one after the other, each added while there is room."""
    r = random.Random(8)
    for _ in range(300):
        size, overlap = r.choice([(20, 5), (40, 0), (12, 30)])
        paragraphs = ["".join(r.choice("ab.! ") for _ in range(r.randrange(60))) for _ in range(r.randrange(6))]
        text, want, held = "\n\n".join(paragraphs), [], ""
        for p in (x.strip() for x in text.split("\n\n")):
            parts = [s for s in chunks._SENTENCE.split(p) if s.strip()] if len(p) > size else [p] if p else []
            for k, s in enumerate(parts):
                if len(p) > size and not k and held:
                    want, held = [*want, held], ""
                if held and len(held) + len(s) > size:
                    want.append(held)
                    before = parts[parts.index(s) - 1] if parts.index(s) else ""
                    held = (before if len(p) > size else held)[-overlap:] if overlap else ""
                held += s
        assert chunks.pack(text, size, overlap) == want + ([held] if held.strip() else [])


def test_mentions_with_any_keys(spark):
    texts = spark.createDataFrame([(2**60 + 1, "an Apple pie"), (None, "APPLE"), (2**60 + 1, "pie")], "k long, text string")
    aliases = spark.createDataFrame([(1, "apple", 5), (1, "pie", 3), (2, "apple", None), (3, "zzz", 1)], "n int, alias string, pos int")
    got = {tuple(x) for x in graph.mentions(texts, aliases, "k", by="n").collect()}
    assert got == {(2**60 + 1, 1, 3), (2**60 + 1, 2, None), (None, 1, 5), (None, 2, None)}
    assert graph.mentions(texts, aliases.limit(0), "k", by="n").count() == 0 and graph.mentions(texts.limit(0), aliases, "k", by="n").count() == 0


def test_index_gives_what_bm25_gives(spark, tmp_path):
    r = random.Random(11)
    lexicon = [f"w{i}" for i in range(80)]
    text = lambda n: " ".join(lexicon[min(79, int(r.expovariate(0.08)))] for _ in range(n))
    rows = [(i, text(r.choice([3, 10, 40, 200]))) for i in range(700)] + [(900 + i, "w1 w2 w3") for i in range(200)] + [(2000, None), (2001, ""), (None, text(30))]
    d = spark.createDataFrame(rows, "id long, text string").repartition(3)
    q = spark.createDataFrame([(1, "w1 w2 w2 w70"), (2, "w0"), (3, "nothing"), (4, text(20)), (None, "w1"), (5, None)], "query_id long, query string")
    lexical_index.build(d, f"{tmp_path}/i")
    for k, first in ((3, 1), (10, 4), (2000, 2)):
        want = {(x.query_id, x.id): (x["rank"], round(x.score, 6)) for x in retrieval.bm25(q, d, k).collect()}
        assert {(x.query_id, x.id): (x["rank"], round(x.score, 6)) for x in lexical_index.search(spark, f"{tmp_path}/i", q, k, first).collect()} == want and want
    lexical_index.build(d.limit(0), f"{tmp_path}/none")
    assert lexical_index.search(spark, f"{tmp_path}/none", q, 3).count() == 0


def test_dense_index_gives_what_dense_gives(spark, tmp_path):
    rng = np.random.default_rng(3)
    spots = rng.normal(size=(40, 16))
    rows = np.concatenate([np.repeat(spots, 50, 0) + rng.normal(scale=0.05, size=(2000, 16)), np.repeat(spots[:1], 1000, 0), np.zeros((3, 16))])
    asked = np.concatenate([spots[:20] + rng.normal(scale=0.05, size=(20, 16)), rng.normal(size=(5, 16)), -spots[:1], np.zeros((1, 16))])
    frame = lambda name, values: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], f"{name} long, vector array<double>")
    v, q = frame("id", rows), frame("query_id", asked)
    dense_index.build(v.union(spark.sql("SELECT 99999L, CAST(NULL AS array<double>)")), f"{tmp_path}/i", cell_bytes=16 * 8 * 16)
    cells = spark.read.parquet(f"{tmp_path}/i/cells")
    assert cells.agg(F.sum("n")).first()[0] == len(rows) and cells.agg(F.max("n")).first()[0] <= 16
    get = lambda found: {(r.query_id, r.id): (r["rank"], r.score) for r in found.collect()}
    for k in (1, 7):
        found, read = dense_index._search(spark, f"{tmp_path}/i", q, k)
        assert get(found) == get(retrieval.dense(q, v, k)) and found.count() == k * len(asked)
    near = read.filter("query_id between 1 and 19").count()  # queries beside a spot of few rows
    assert near < 0.2 * 19 * cells.count(), (near, 19 * cells.count())
    assert get(dense_index.search(spark, f"{tmp_path}/i", q.filter("query_id = 2"), 5000)) == get(retrieval.dense(q.filter("query_id = 2"), v, 5000))
    dense_index.build(v.limit(0), f"{tmp_path}/none")
    assert dense_index.search(spark, f"{tmp_path}/none", q, 3).count() == 0


def test_passes_one_after_the_other(spark, monkeypatch):
    v = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(50)], "id long, vector array<double>")
    q = spark.createDataFrame([(i, [1.0, float(i), 0.5], f"w{i} w{i + 1}") for i in range(9)], "query_id long, vector array<double>, query string")
    t = spark.createDataFrame([(i, f"w{i % 8} w{i % 5} other") for i in range(40)], "id long, text string")
    rows = lambda: ({tuple(r) for r in retrieval.dense(q, v, 4).collect()}, {tuple(r) for r in retrieval.bm25(q, t, 4).collect()})
    want = rows()
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 4)
    monkeypatch.setattr(retrieval, "TERM_BLOCK", 5)
    assert rows() == want and all(want)
