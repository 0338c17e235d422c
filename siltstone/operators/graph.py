"""Mentions of companies and terms in texts; the terminology graph: aliases, edges, audit, context."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.functions.scalars import stable_id

#: Aliases, and letters of them, in one automaton; larger tables take several, each in a pass of its own over the texts.
ALIAS_BLOCK, ALIAS_LETTERS = 300_000, 1 << 23

#: Ids in a list of queries, or of reports, that name the same companies; pairs that a task writes (both about), and tasks at most.
LISTED, TASK_PAIRS, TASKS = 2048, 1 << 25, 1 << 14

#: Queries and reports of such lists that are paired at a time.
QUERY_RUN, REPORT_RUN = 16, 128

#: The automaton that this worker holds, by the pass it belongs to.
_automata: dict = {}


def _scan(low: DataFrame, found: DataFrame, rows: list) -> DataFrame:
    """key, by, pos of low (key, text in lower case) for the alias rows (name, alias, pos) that stand in a text, each once for a text."""
    spark, schema = low.sparkSession, found.schema
    forms = sorted({r[1] for r in rows})
    names, places = ([r[k] for r in rows] for k in (0, 2))
    owners: dict[str, list[int]] = {}
    for n, r in enumerate(rows):
        owners.setdefault(r[1], []).append(n)
    shared, mark = spark.sparkContext.broadcast((forms, [owners[f] for f in forms], names, places)), uuid.uuid4().hex
    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        if mark not in _automata:
            _automata.clear()
            built = ahocorasick.Automaton()
            for n, form in enumerate(shared.value[0]):
                built.add_word(form, n)
            built.make_automaton()
            _automata[mark] = built, pa.array(shared.value[2], types[1]), pa.array(shared.value[3], types[2])
        built, name, pos = _automata[mark]
        own = shared.value[1]
        for batch in batches:
            at, hit = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                for form in {f for _, f in built.iter(text)}:
                    hit += own[form]
                at += [n] * (len(hit) - len(at))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), name.take(pa.array(hit, pa.int64())), pos.take(pa.array(hit, pa.int64()))], schema.names)

    return low.mapInArrow(run, schema)


def mentions(texts: DataFrame, aliases: DataFrame, key: str = "query_id", text: str = "text", by: str = "name", block: int = ALIAS_BLOCK) -> DataFrame:
    """key, name, pos: every name of which an alias stands in the text (case aside), with the lowest place of such an alias.

    aliases: name, alias, pos.  All aliases are looked for at once, by an Aho-Corasick automaton that each worker builds from the
    broadcast aliases: one pass over the texts for each `block` aliases (or ALIAS_LETTERS letters of them), whatever their number of matches.
    """
    a = aliases.select(by, F.lower("alias").alias("alias"), "pos").filter("alias <> ''")
    low = texts.select(key, F.lower(F.coalesce(text, F.lit(""))).alias("low"))
    size = a.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("alias")), F.lit(0)).alias("letters")).first()
    blocks = max(1, -(-size["n"] // block), -(-size["letters"] // ALIAS_LETTERS))
    dealt = a.withColumn("block", F.pmod(F.xxhash64("alias"), F.lit(blocks)))
    out = low.select(key).join(a.select(by, "pos").limit(0))  # names and types of the rows to come
    dealt_rows = (dealt.filter(F.col("block") == k).drop("block").collect() for k in range(blocks))
    found = [_scan(low, out, rows) for rows in dealt_rows if rows]
    return reduce(DataFrame.unionByName, found or [out]).groupBy(key, by).agg(F.min("pos").alias("pos"))


def _listed(rows: DataFrame, key: str, names: str, sizes: DataFrame) -> DataFrame:
    """names, `key`_list, ids: the keys of the rows that hold the same names, in lists of about LISTED at most.  sizes: names, rows that hold them."""
    dealt = rows.join(sizes.toDF(names, "n"), names).withColumn(f"{key}_list", F.pmod(F.xxhash64(key), F.ceil(F.col("n") / LISTED)))
    return dealt.groupBy(names, f"{key}_list").agg(F.sort_array(F.flatten(F.collect_list(F.array(key)))).alias("ids"))  # with null, which a list of keys leaves out


def scoped_sources(queries: DataFrame, companies: DataFrame, reports: DataFrame) -> DataFrame:
    """query_id, source: reports (source, title) whose name or title holds an alias of a company that the query names, each once.

    companies: name, alias, pos.  Queries without such a company have no rows.  Queries and reports go by the set of companies that they
    name: which sets meet is settled once for all rows that hold them, and lists of queries meet lists of reports in tasks whose number grows
    with the pairs.  The pairs themselves are written out as they come, never shuffled: a few reports for all queries of a list, then the next
    few, so the same ids return at short distance and a file of columns stores a pair in a fraction of a byte.
    """
    names = F.sort_array(F.collect_set("name"))
    asked = mentions(queries, companies, "query_id", "query").groupBy("query_id").agg(names.alias("asked"))
    held = mentions(reports.select("source", F.concat_ws(" ", "source", "title").alias("text")), companies, "source").groupBy("source").agg(names.alias("held"))
    askers, holders = asked.groupBy("asked").agg(F.count("*").alias("askers")), held.groupBy("held").agg(F.count("*").alias("holders"))
    sets = lambda rows, c: rows.select(c, F.explode(c).alias("name"))
    meet = sets(askers, "asked").join(sets(holders, "held"), "name").select("asked", "held").distinct()
    pairs = meet.join(askers, "asked").join(holders, "held").agg(F.sum(F.col("askers").cast("double") * F.col("holders"))).first()[0] or 0
    blocks = _listed(asked, "query_id", "asked", askers).withColumnRenamed("ids", "queries").join(meet, "asked").join(_listed(held, "source", "held", holders).withColumnRenamed("ids", "sources"), "held")
    tasks = blocks.repartition(min(TASKS, 1 + int(pairs / TASK_PAIRS)), "asked", "query_id_list", "held", "source_list")
    runs = lambda c, n: F.explode(F.transform(F.sequence(F.lit(1), F.size(c), F.lit(n)), lambda at: F.slice(c, at, n))).alias(c)
    few = tasks.select("queries", runs("sources", REPORT_RUN)).select(runs("queries", QUERY_RUN), "sources")
    return few.select(F.explode("queries").alias("query_id"), "sources").select("query_id", F.explode("sources").alias("source"))


def term_aliases(name, english):
    """Sorted aliases of a term: both names, parts around ` / `, and both halves of `X (Y)`."""
    forms = F.array_compact(F.array(name, english))

    def pieces(form):
        inner = r"^(.*?)\s*[(（](.*?)[)）]\s*$"
        halves = F.when(form.rlike(inner), F.array(F.trim(F.regexp_extract(form, inner, 1)), F.trim(F.regexp_extract(form, inner, 2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.trim(form)), F.transform(F.split(form, " / "), lambda x: F.trim(x)), halves)

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(forms, pieces)), lambda x: x != "")))


def alias_index(registrations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias_key -> node_id, the first registered wins; collisions: keys that more than one node claimed).

    registrations: node_id, alias, pos (place of the registration).
    """
    rows = registrations.select(F.lower(F.trim("alias")).alias("alias_key"), "node_id", "pos").filter("alias_key <> ''")
    per = rows.groupBy("alias_key").agg(F.min_by("node_id", F.struct("pos", "node_id")).alias("node_id"), F.countDistinct("node_id").alias("claims"))
    return per.select("alias_key", "node_id"), per.filter("claims > 1").select("alias_key", "claims")


def build_edges(references: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """source, target, type, inferred_inverse: the references and their inverses, no self-loops, the first of equal ones kept.

    references: source, target, type, pos.
    """
    names = F.create_map(*[F.lit(x) for pair in inverse.items() for x in pair])
    straight = references.select("source", "target", "type", F.lit(False).alias("inferred_inverse"), "pos")
    back = references.select(F.col("target").alias("source"), F.col("source").alias("target"), names[F.col("type")].alias("type"), F.lit(True).alias("inferred_inverse"), "pos").filter("type is not null")
    rows = straight.unionByName(back).filter("source <> target")
    return rows.groupBy("source", "target", "type").agg(F.min(F.struct("pos", "inferred_inverse")).alias("f")).select("source", "target", "type", F.col("f.inferred_inverse").alias("inferred_inverse"), F.col("f.pos").alias("pos"))


def build_graph(terms: DataFrame, companies: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, alias index, edges) of terms (name, english, related, companies, pos) and companies (name, alias, pos).

    Related names resolve through the alias index, or become concept nodes; companies go by their canonical name.
    """
    node = lambda kind, name: stable_id("node", F.lit(kind), name, length=16)
    term_nodes = terms.select(node("term", F.col("name")).alias("node_id"), F.lit("term").alias("type"), "name", term_aliases(F.col("name"), F.col("english")).alias("aliases"), "pos")
    index, _ = alias_index(term_nodes.select("node_id", F.explode("aliases").alias("alias"), "pos"))
    related = terms.select(node("term", F.col("name")).alias("source"), F.posexplode("related").alias("k", "ref"), "pos").select("source", F.lower(F.trim("ref")).alias("alias_key"), "ref", F.struct("pos", F.lit(0).alias("side"), "k").alias("pos"))
    targets = related.join(index, "alias_key", "left").withColumn("target", F.coalesce("node_id", node("concept", F.col("alias_key"))))
    concepts = targets.filter("node_id is null").groupBy(F.col("target").alias("node_id")).agg(F.min_by("ref", "pos").alias("name")).select("node_id", F.lit("concept").alias("type"), "name")
    named = terms.select(node("term", F.col("name")).alias("source"), F.posexplode("companies").alias("k", "ref"), "pos").select("source", F.lower(F.trim("ref")).alias("alias_key"), "ref", F.struct("pos", F.lit(1).alias("side"), "k").alias("pos"))
    canonical = companies.groupBy(F.lower("alias").alias("alias_key")).agg(F.min_by("name", "pos").alias("canonical"))
    firms = named.join(canonical, "alias_key", "left").withColumn("firm", F.coalesce("canonical", "ref")).withColumn("target", node("company", F.lower("firm")))
    firm_nodes = firms.groupBy(F.col("target").alias("node_id")).agg(F.min_by("firm", "pos").alias("name")).select("node_id", F.lit("company").alias("type"), "name")
    references = targets.select("source", "target", F.lit("related_to").alias("type"), "pos").unionByName(firms.select("source", "target", F.lit("made_by").alias("type"), "pos"))
    edges = build_edges(references, {"related_to": "related_to", "made_by": "makes"})
    nodes = term_nodes.select("node_id", "type", "name").unionByName(concepts).unionByName(firm_nodes)
    return nodes, index, edges


def neighbours(names: DataFrame, index: DataFrame, edges: DataFrame, relation: str | None = None) -> DataFrame:
    """Targets of the named nodes in the order of edges.  names: name."""
    ids = names.select("name", F.lower(F.trim("name")).alias("alias_key")).join(index, "alias_key").select("name", F.col("node_id").alias("source"))
    rows = edges if relation is None else edges.filter(F.col("type") == relation)
    return ids.join(rows, "source").select("name", "type", "target", "pos")


def graph_audit(nodes: DataFrame, edges: DataFrame, inverse: dict[str, str]) -> DataFrame:
    """One row: nodes, edges, edges with a missing end, edges without an inverse, passed."""
    names = F.create_map(*[F.lit(x) for pair in {**inverse, **{v: k for k, v in inverse.items()}}.items() for x in pair])
    ids = nodes.select(F.col("node_id").alias("__id")).distinct()
    lost = edges.select(F.explode(F.array("source", "target")).alias("end")).join(ids, F.col("end") == F.col("__id"), "left_anti").agg(F.count("*").alias("missing_ends"))
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), names[F.col("type")].alias("type"))
    alone = back.join(edges, ["source", "target", "type"], "left_anti").agg(F.count("*").alias("without_inverse"))
    counts = nodes.agg(F.count("*").alias("nodes")).join(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each
    return counts.join(F.broadcast(lost)).join(F.broadcast(alone)).withColumn("passed", (F.col("missing_ends") == 0) & (F.col("without_inverse") == 0))


def graph_counts(nodes: DataFrame, edges: DataFrame, collisions: DataFrame) -> DataFrame:
    """kind (node, edge, inverse, collision), type, n: how many there are of each type; collisions: alias keys that several nodes claim."""
    parts = [
        nodes.select(F.lit("node").alias("kind"), "type"),
        edges.select(F.when(F.col("inferred_inverse"), "inverse").otherwise("edge").alias("kind"), "type"),
        collisions.select(F.lit("collision").alias("kind"), F.lit("alias").alias("type")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "type").agg(F.count("*").alias("n"))


def term_context(matched: DataFrame, neighbours_of: DataFrame, n: int = 5, each: int = 8) -> DataFrame:
    """query_id, name, related: the longest n matched terms, each with its first neighbours.  matched: query_id, name; neighbours_of: name, target, pos."""
    top = matched.withColumn("__n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.length("name").desc(), "name"))).filter(F.col("__n") <= n)
    few = neighbours_of.withColumn("__k", F.row_number().over(Window.partitionBy("name").orderBy("pos"))).filter(F.col("__k") <= each)
    lists = few.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("__k", "target"))), lambda x: x.target).alias("related"))
    return top.join(lists, "name", "left").select("query_id", "name", F.col("__n").alias("rank"), "related")
