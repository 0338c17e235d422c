"""Benchmark decontamination: short test items found inside long documents, with DataFrame operations only.

An item is contained in a document if the document holds at least CONTAINMENT of its distinct five-word shingles.  The items are
partitioned by size; an item's sketch keeps the smallest hashes of its set under the MinHash order, as many as its
partition needs: of the k = floor((1 - c) n) + 1 smallest of n hashes a document with containment c must hold one, however
long it is, so the search misses nothing.  Candidates are verified on the shingles themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import bare, fresh_names, stored

WIDTH = 5
CONTAINMENT = 0.8
#: Sketch rows up to which the benchmark's side is broadcast (16 bytes each); beyond it both sides are shuffled.
BROADCAST_ROWS = 200_000


def _words(text: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"filter(split(translate({text}, '{upper}', '{lower}'), '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def _once(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value: a lambda variable is evaluated once, a projected column again at each use."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _shingles(text: str, width: int) -> str:
    """Distinct shingles as text; fewer words than width make one shingle of all."""
    many = f"array_distinct(transform(sequence(0, size(w) - {width}), i -> concat_ws(' ', slice(w, i + 1, {width}))))"
    return _once(_words(text), "w", f"case when size(w) >= {width} then {many} when size(w) > 0 then array(concat_ws(' ', w)) else cast(array() as array<string>) end")


def _hashes(text: str, width: int) -> str:
    """Hash of the shingle at each place, from the hashes of its words; the same rule on both sides."""
    parts = ", ".join(f"h[i + {j}]" for j in range(width))
    body = f"case when size(h) >= {width} then transform(sequence(0, size(h) - {width}), i -> xxhash64({parts})) when size(h) > 0 then array(xxhash64(h, {width})) else cast(array() as array<long>) end"
    return _once(f"transform({_words(text)}, w -> xxhash64(w))", "h", body)


def _sized(containment: float) -> Column:
    """Sketch size of an item's size partition (a power of two): enough for its largest member."""
    top = F.pow(F.lit(2.0), F.ceil(F.log2("n_shingles"))) if containment < 1 else F.col("n_shingles")
    return F.least(F.floor(top * (1 - containment) + 1e-9).cast("int") + 1, F.col("n_shingles"))


def contaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, width: int = WIDTH) -> DataFrame:
    """Pairs doc_id, item_id, n_shingles (of the item), n_shared, containment for all contained items.

    docs: doc_id, text.  items: item_id, text.  Null and empty texts hold nothing.  An item with fewer words than a shingle is
    found only in a document that is the same few words.  Repeated rows of documents or items give repeated pairs' keys once.
    """
    tests = bare(items, "item_id", "text").filter("item_id is not null").dropDuplicates(["item_id"]).select("item_id", F.expr(_shingles("text", width)).alias("s"), F.expr(_hashes("text", width)).alias("h"))
    tests = stored(tests.select("item_id", "s", F.array_distinct("h").alias("h"), F.size("s").alias("n_shingles")).filter("n_shingles > 0"), "items")
    # the MinHash order is that of a second hash, which nothing else uses
    order = "transform(array_sort(transform(h, x -> struct(xxhash64(x, 7) as o, x as x))), y -> y.x)"
    sketches = tests.select("item_id", F.explode(F.slice(F.expr(order), F.lit(1), _sized(containment))).alias("hash"))
    sketches = stored(sketches, "sketches")
    texts = bare(docs, "doc_id", "text").filter("doc_id is not null and text is not null")
    # the outer form, for which no filter that computes the hashes once more is put below it
    probes = texts.select("doc_id", F.explode_outer(F.expr(_hashes("text", width))).alias("hash"))
    small = sketches.count() <= BROADCAST_ROWS
    found = probes.join(F.broadcast(sketches) if small else sketches, "hash").select("doc_id", "item_id").distinct()
    found = stored(found, "candidates")
    few = tests.count() <= BROADCAST_ROWS // 100
    held = texts.join(found, "doc_id").select("doc_id", "item_id", "text").join(F.broadcast(tests.select("item_id", "s", "n_shingles")) if few else tests.select("item_id", "s", "n_shingles"), "item_id")
    exact = held.select("doc_id", "item_id", "n_shingles", F.size(F.array_intersect("s", F.expr(_shingles("text", width)))).alias("n_shared"))
    return exact.filter(F.col("n_shared") >= containment * F.col("n_shingles") - 1e-9).withColumn("containment", F.col("n_shared") / F.col("n_shingles")).dropDuplicates(["doc_id", "item_id"])


def without_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents in which no item is contained, with their own columns."""
    (own,) = fresh_names(docs, "leak")
    leaks = contaminated(docs, items, containment).select(F.col("doc_id").alias(own)).distinct()
    return docs.join(leaks, F.col("doc_id") == F.col(own), "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, items)
