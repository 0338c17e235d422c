"""Rows of registered queries whose faults showed on larger tables only."""

import random
import tracemalloc

import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from siltstone.functions import scalars, table_functions
from siltstone.operators import chunks, graph, lexical_index, retrieval
from siltstone.plans import more


def test_first_snapshots_have_the_columns_of_their_sql(spark, tmp_path):
    part = [(1, "B", "t", "name"), (2, "B", "t", "name"), (3, "B", "t", "other")]
    spark.createDataFrame(part, "p_partkey int, p_brand string, p_type string, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = more.x4_first_snapshots(spark, str(tmp_path))
    assert got.columns == ["url", "content_hash", "ts"]
    assert sorted(r.s for r in got.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("s")).collect()) == ["2024-01-01 00:00:01", "2024-01-01 00:00:03"]


def test_days_before_year_zero(spark):
    rows = spark.createDataFrame([(1, "-0123-02-28"), (2, "-0123-02-28T10:00:00Z"), (3, "+12026-01-31"), (4, "-0123-02-30"), (5, "12-0123-02-28")], "id int, t string")
    got = {r.id: r.day for r in rows.select("id", scalars.source_date("t").cast("string").alias("day")).collect()}
    assert got == {1: "-0123-02-28", 2: "-0123-02-28", 3: "+12026-01-31", 4: None, 5: None}


def test_scoped_pairs_are_not_shuffled(spark):
    companies = spark.createDataFrame([("A", "<a>", 0), ("B", "<b>", 0), ("B", "<bb>", 1), ("C", "<c>", 0)], "name string, alias string, pos int")
    queries = spark.createDataFrame([(1, "of <a> and <b>"), (2, "<c> <BB>"), (3, "none"), (4, "<a>"), (5, None)], "query_id int, query string")
    reports = spark.createDataFrame([(10, "<A> <b>"), (11, "<bb>"), (12, "x"), (13, "<c>"), (14, "<a> <c>")], "source int, title string")
    got = graph.scoped_sources(queries, companies, reports)
    assert sorted(map(tuple, got.collect())) == [(1, 10), (1, 11), (1, 14), (2, 10), (2, 11), (2, 13), (2, 14), (4, 10), (4, 14)]
    many = spark.range(300).select("id", F.lit("<a>").alias("t"))
    wide = graph.scoped_sources(many.select(F.col("id").alias("query_id"), F.col("t").alias("query")), companies, many.select(F.col("id").alias("source"), F.col("t").alias("title")))
    text = wide._jdf.queryExecution().optimizedPlan().toString()
    assert wide.count() == 90_000 and "Generate explode(sources" in text.split("Aggregate")[0]  # nothing after the pairs exist


def test_scoped_pairs_take_little_room_in_tasks_of_a_bounded_size(spark, tmp_path, monkeypatch):
    """300 queries by 20,000 reports of one company: a query's reports fill a page of a file, so their order decides what a pair takes."""
    monkeypatch.setattr(graph, "TASK_PAIRS", 1 << 20, raising=False)
    companies = spark.createDataFrame([("A", "<a>", 0)], "name string, alias string, pos int")
    named = lambda n, key, text: spark.range(n).select(F.col("id").alias(key), F.lit("<a>").alias(text))
    graph.scoped_sources(named(300, "query_id", "query"), companies, named(20_000, "source", "title")).write.parquet(f"{tmp_path}/pairs")
    files = list(tmp_path.glob("pairs/*.parquet"))
    rows = spark.read.parquet(f"{tmp_path}/pairs").groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("d"), F.max("source").alias("most")).collect()
    assert len(rows) == 300 and {(r.n, r.d, r.most) for r in rows} == {(20_000, 20_000, 19_999)}
    assert sum(f.stat().st_size for f in files) < 0.2 * 6_000_000, sum(f.stat().st_size for f in files)
    assert len(files) > 4  # more than there are shuffle partitions


def test_scoped_lists_are_bounded_and_keep_null_ids(spark, monkeypatch):
    monkeypatch.setattr(graph, "LISTED", 50, raising=False)
    companies = spark.createDataFrame([("A", "<a>", 0), ("B", "<b>", 0)], "name string, alias string, pos int")
    queries = [(i, "<a>") for i in range(400)] + [(None, "<b>")]
    reports = [(i, "<a>") for i in range(300)] + [(None, "<a> <b>"), (900, "<b>")]
    got = graph.scoped_sources(spark.createDataFrame(queries, "query_id int, query string"), companies, spark.createDataFrame(reports, "source int, title string"))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(q, r) for q, asked in queries for r, held in reports if asked in held}
    assert plan.split("Aggregate")[0].count("explode") == 4  # lists meet, not a query and all its reports


def test_scores_of_frequent_terms_stay_within_bounds(spark, monkeypatch):
    """600 queries of the same 40 terms against 400 chunks that hold them all: 9.6 million sums, not held at once."""

    class Captured:
        columns, schema = ["id", "text"], StructType([StructField("id", LongType()), StructField("text", StringType())])

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    monkeypatch.setattr(retrieval, "SCORES", 1 << 15)
    monkeypatch.setattr(retrieval, "PART_TOKENS", 1 << 12, raising=False)
    block = [(q, f"w{t}", 400) for q in range(600) for t in range(40)]
    run = retrieval._bm25_pass(block, 800, 40.0, Captured(), 3, LongType())
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([[f"w{t}" for t in range(40)]] * 400)], ["id", "t"])
    tracemalloc.start()
    (got,) = run(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 1800 and set(got.column(1).to_pylist()) == {0, 1, 2}
    assert peak < 30e6, peak


def test_a_task_holds_a_slice_of_the_chunks_it_cuts(spark, monkeypatch):
    """Texts of one batch are handed on in several pieces, and null texts and keys give what they gave."""
    pages = spark.createDataFrame([(i, 1, "# H\n" + "word. " * 300) for i in range(40)] + [(40, 1, None), (41, None, "only")], "doc_id long, page int, text string").coalesce(1)
    want = sorted(map(str, chunks.chunk_documents(pages).collect()))
    monkeypatch.setattr(chunks, "SLICE", 5_000)
    whole = DataFrame.mapInArrow

    def counted(self, run, schema):
        return whole(self, lambda batches: (pa.RecordBatch.from_pylist([{"n": b.num_rows}], pa.schema([("n", pa.int64())])) for b in run(batches)), "n long")

    assert sorted(map(str, chunks.chunk_documents(pages).collect())) == want
    monkeypatch.setattr(DataFrame, "mapInArrow", counted)
    monkeypatch.setattr(DataFrame, "mapInPandas", lambda self, run, schema: counted(self, lambda batches: (pa.RecordBatch.from_pandas(p) for p in run(b.to_pandas() for b in batches)), schema))
    sizes = [r.n for r in chunks.sections(pages).collect()]
    assert sum(sizes) == 41 and max(sizes) <= 3


def test_text_sections_run_in_spark_and_cut_like_python(spark):
    r = random.Random(4)
    parts = ["# A", "##\tB #", "#### no", "\n", "\n\n", "\r\n", " ", "\u3000", "\x1c", "\x85", "word", "#", "###\u00a0x\u2028", "'\\", "\u200b"]
    texts = [None, "", *("".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(1500))]
    table_functions.register(spark)
    spark.createDataFrame(list(enumerate(texts)), "id int, t string").createOrReplaceTempView("section_texts")
    got = spark.sql("SELECT id, s.* FROM section_texts, LATERAL text_sections(t) AS s")
    assert "UDTF" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [(i, *row) for i, t in enumerate(texts) for row in chunks.cut_sections(t)]


def test_rankings_of_suppliers_are_dealt_once(spark, tmp_path, monkeypatch):
    lines = spark.range(3000).selectExpr("id % 40 AS l_suppkey", "id % 700 AS l_partkey", "CAST(id % 50 AS DOUBLE) AS l_extendedprice")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(more, "_RANKED_ROWS", 100, raising=False)
    for query in (more.r4_hybrid_dense, more.r5_merged_rankings):
        plan = query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == plan.count("Exchange hashpartitioning(l_suppkey") == 2  # grouped, ranked and merged where they are
        assert plan.count(", 30), REPARTITION_BY_NUM") == 2  # and in more parts for more lines


def test_hybrid_search_reads_the_texts_once_and_carries_none(spark, monkeypatch):
    texts = ["tsmc gross margin of the fab", "capacity of the fab", "margin and revenue", "毛利率 gross margin", "other words"] * 6
    held = spark.createDataFrame([(i, f"{t} {i}", f"s{i % 3}", "text" if i % 2 else "table") for i, t in enumerate(texts)], "id long, text string, source string, chunk_type string")
    vectors = spark.createDataFrame([(i, [1.0, float(i % 5), float(i % 7)]) for i in range(30)], "id long, vector array<double>")
    queries = spark.createDataFrame([(1, "gross margin"), (2, "毛利率"), (3, "fab capacity"), (4, " ")], "query_id long, query string")
    asked = spark.createDataFrame([(i, [1.0, float(i), 2.0]) for i in (1, 2, 3)], "query_id long, vector array<double>")
    calls, whole, seen, scope = [], retrieval.bm25, [], retrieval.scope_to_named
    monkeypatch.setattr(retrieval, "bm25", lambda *a: calls.append(a) or whole(*a))
    monkeypatch.setattr(retrieval, "scope_to_named", lambda hits, *a: seen.append(hits.columns) or scope(hits, *a))
    rows = retrieval.hybrid_query(queries, held, vectors, asked, 4).collect()
    assert len(calls) == 1 and "text" not in seen[0]
    assert {r.query_id for r in rows} == {1, 2, 3} and all(r.text == f"{texts[r.id]} {r.id}" for r in rows)
    scored = retrieval.hybrid_query(queries, held, vectors, asked, 4, F.pandas_udf(lambda q, t: t.str.len() * 1.0, "double")).collect()
    assert len(scored) == len(rows) == 12


def test_index_cuts_each_text_once_and_keeps_chunks_apart(spark, tmp_path, monkeypatch):
    rows = [(i % 290 + (1 << 60), f"w{i % 7} w{i % 7} w{i % 11} x{i}") for i in range(300)]  # ten ids twice
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: read.add(1) or t, "string")
    held = spark.createDataFrame([*rows, (None, "w1 w2 w3"), (5, ""), (6, None)], "id long, text string").repartition(3)
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3 w10 x7 x297"), (3, "x299 none"), (4, "none")], "query_id int, query string")
    lexical_index.build(held.select("id", seen("text").alias("text")), f"{tmp_path}/i")
    assert read.value == 303
    get = lambda found: sorted((r.query_id, r["rank"], r.id, r.score) for r in found.collect())
    want = get(retrieval.bm25(asked, held, 9))
    assert get(lexical_index.search(spark, f"{tmp_path}/i", asked, 9)) == want and {r[0] for r in want} == {1, 2, 3}
    monkeypatch.setattr(retrieval, "TERM_BLOCK", 2)  # several passes
    assert get(lexical_index.search(spark, f"{tmp_path}/i", asked, 9, 1)) == want
    assert lexical_index.search(spark, f"{tmp_path}/i", asked, 0).count() == 0
