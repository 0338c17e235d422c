"""Readers of nested registries, golden cases and incoming files; all give plain rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.scalars import stable_id
from siltstone.operators.evidence import common_periods

#: Keys of the maps are data, so their types are declared instead of inferred.  Figures are read as text, which keeps their digits.
_SOURCE = "source_title: string, source_url: string, source_publisher: string, source_published_at: string"
COMPANY = f"""name_en: string, ticker: string, year: int, currency: string, unit: string, {_SOURCE},
    revenue: struct<value: string, yoy_growth_pct: string, note: string>, gross_margin: struct<value: string, trend: string>, net_margin: struct<value: string, trend: string>,
    capex: struct<value: string, intensity_pct: string, trend: string>, rd_expense: struct<value: string, rd_ratio: string>,
    capacity: struct<utilization_rate: string, process_mix: map<string, string>>, evidence_scope: string,
    quarterly: map<string, struct<{_SOURCE}, metrics: map<string, string>>>"""
COMPANIES = f"companies map<string, struct<{COMPANY}>>"
# Annual figures (metric, place, unit; None is the company's own unit) and quarterly keys (metric, unit, currency).
ANNUAL = (
    ("revenue", "revenue.value", None),
    ("revenue_yoy", "revenue.yoy_growth_pct", "percent"),
    ("gross_margin", "gross_margin.value", "percent"),
    ("net_margin", "net_margin.value", "percent"),
    ("capex", "capex.value", None),
    ("capex_intensity", "capex.intensity_pct", "percent"),
    ("rd_intensity", "rd_expense.rd_ratio", "percent"),
    ("capacity_utilization", "capacity.utilization_rate", "percent"),
)
QUARTERLY = {
    "revenue_usd_billion": ("revenue", "billion", "USD"),
    "gross_margin_pct": ("gross_margin", "percent", None),
    "operating_margin_pct": ("operating_margin", "percent", None),
    "operating_profit_usd_billion": ("operating_profit", "billion", "USD"),
    "usd_ntd_exchange_rate": ("usd_ntd_exchange_rate", "NTD_per_USD", None),
}
MAX_BYTES = 50 << 20


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """One row for each company of the nested financial registry at path: company and the columns of COMPANY."""
    return spark.read.schema(COMPANIES).option("multiLine", True).json(path).select(F.explode("companies").alias("company", "r")).select("company", "r.*")


def quarter_rows(companies: DataFrame) -> DataFrame:
    """company, period, metric (the registry's key), value (text) and source of the quarterly figures; null figures are left out."""
    rows = companies.select("company", F.explode("quarterly").alias("period", "q")).select("company", "period", F.explode("q.metrics").alias("metric", "value"), "q.*")
    return rows.drop("metrics").filter("value is not null")


def annual_rows(companies: DataFrame) -> DataFrame:
    """company, period (FY and the year), metric, value (text), unit and source of the annual figures; null ones are left out."""
    figures = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"), (F.coalesce("unit", F.lit("billion")) if u is None else F.lit(u)).alias("unit")) for m, c, u in ANNUAL])
    source = [c for c in companies.columns if c.startswith("source_")]
    rows = companies.select("company", F.concat(F.lit("FY"), "year").alias("period"), "currency", F.explode(figures).alias("f"), *source)
    return rows.select("company", "period", "f.*", "currency", *source).filter("value is not null")


def registry_facts(companies: DataFrame) -> DataFrame:
    """All known figures as facts: company (its English name), metric, period, value (text as disclosed), unit, currency, source_id, trust_tier, source.

    An official source by its address stands behind each period; quarterly keys that QUARTERLY doesn't name are left out.
    """
    named = companies.withColumn("company", F.col("name_en"))
    known = F.create_map(*[x for key, own in QUARTERLY.items() for x in (F.lit(key), F.struct(*[F.lit(o).cast("string").alias(n) for n, o in zip(("metric", "unit", "currency"), own, strict=True)]))])
    quarters = quarter_rows(named).withColumn("k", known[F.col("metric")]).filter("k is not null")
    quarters = quarters.drop("metric").select("*", "k.*").drop("k")
    rows = annual_rows(named).unionByName(quarters)
    source = stable_id("src", F.lit("official"), F.coalesce(F.nullif(F.col("source_url"), F.lit("")), F.col("source_title")))
    return rows.withColumns({"source_id": source, "trust_tier": F.lit(1)})


def annual_sources(companies: DataFrame) -> DataFrame:
    """company, capex_intensity (per cent) and the annual source, as `dashboard` takes them."""
    return companies.select("company", F.col("capex.intensity_pct").cast("double").alias("capex_intensity"), "source_title", "source_publisher", "source_published_at", "source_url")


def timeline_points(companies: DataFrame) -> DataFrame:
    """company, name_en, period, revenue, gross_margin, published_at, source_title, source_url of the quarters that all companies have."""
    rows = companies.select("company", "name_en", F.explode("quarterly").alias("period", "q"))
    number = lambda key: F.col("q.metrics")[key].cast("double")
    points = rows.select("company", "name_en", "period", number("revenue_usd_billion").alias("revenue"), number("gross_margin_pct").alias("gross_margin"), F.col("q.source_published_at").alias("published_at"), "q.source_title", "q.source_url")
    return points.join(common_periods(points), "period", "left_semi")


def process_mix(companies: DataFrame) -> DataFrame:
    """company, process, share (text, as disclosed)."""
    return companies.select("company", F.explode("capacity.process_mix").alias("process", "share"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """metric and its definition; a registry without metrics is an error."""
    rows = spark.read.schema("metrics map<string, map<string, string>>").option("multiLine", True).json(path).select(F.explode("metrics").alias("metric", "definition"))
    if rows.isEmpty():
        raise ValueError(f"no metrics in {path}")
    return rows


CASE = "id string, language string, query string, expected array<struct<id: string, source: string, page: int, contains: string>>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, language, query, expected of golden cases: an object with a list of cases, or the list itself, in one read."""
    case = T.StructType.fromDDL(CASE)
    rows = spark.read.schema(T.StructType([T.StructField("cases", T.ArrayType(case)), *case])).option("multiLine", True).json(path)
    bare = F.when(F.col("id").isNotNull() | F.col("query").isNotNull(), F.array(F.struct("id", "language", "query", "expected")))
    listed = rows.select(F.explode(F.coalesce("cases", bare)).alias("c")).select(F.col("c.id").alias("case_id"), "c.language", "c.query", "c.expected")
    if listed.isEmpty():
        raise ValueError(f"no cases in {path}")
    return listed


def expectations(cases: DataFrame) -> DataFrame:
    """case_id, expectation (place), and what each one asks for."""
    rows = cases.select("case_id", F.posexplode("expected").alias("expectation", "e"))
    return rows.select("case_id", "expectation", "e.id", "e.source", "e.page", "e.contains")


def clean_name(name) -> Column:
    """A file's own name with anything but word characters, space, dot and hyphen replaced."""
    return F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"[^\p{L}\p{N}_. -]", "_")


def accepted_files(files: DataFrame, ready: DataFrame, max_bytes: int = MAX_BYTES, manifest: DataFrame | None = None) -> DataFrame:
    """name, sha256, length of new files (path, content, length): .pdf in name and content, not too long, not among ready digests (sha256).

    manifest: name, sha256.  A file that it names must have a digest that it gives for that name.
    """
    good = F.lower("path").endswith(".pdf") & (F.col("length") <= max_bytes) & (F.substring("content", 1, 5) == F.lit("%PDF-").cast("binary"))
    rows = files.filter(good).select(clean_name(F.col("path")).alias("name"), F.sha2("content", 256).alias("sha256"), "length")
    if manifest is not None:
        known = manifest.groupBy("name").agg(F.collect_set(F.lower("sha256")).alias("digests"))  # a file's own digests
        rows = rows.join(known, "name", "left").filter(F.col("digests").isNull() | F.array_contains("digests", F.col("sha256"))).drop("digests")
    return rows.groupBy("sha256").agg(F.min("name").alias("name"), F.min("length").alias("length")).join(ready.select("sha256"), "sha256", "left_anti")


def flat_metadata(metadata) -> Column:
    """map<string, string> of a struct column: lists and structs as JSON, other values as text; nulls are left out."""
    return F.map_filter(F.from_json(F.to_json(metadata), "map<string,string>"), lambda k, v: v.isNotNull())


def _sorted_keys(value: Column, kind: T.DataType) -> Column:
    """The value with the fields of all structs and the keys of all maps in ascending order."""
    if isinstance(kind, T.StructType):
        fields = [_sorted_keys(value.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted_keys(x, kind.elementType))
    if isinstance(kind, T.MapType):
        pairs = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e.key.cast("string").alias("key"), _sorted_keys(e.value, kind.valueType).alias("value"))), lambda a, b: F.when(a.key < b.key, -1).when(a.key > b.key, 1).otherwise(0))
        return F.map_from_entries(pairs)
    return value


def _list_item(kind: T.DataType):
    """Text of a list's item: JSON with sorted keys of what is nested, `None` for null."""
    if isinstance(kind, T.StructType | T.MapType | T.ArrayType):
        return lambda x: F.coalesce(F.to_json(_sorted_keys(x, kind), {"ignoreNullFields": "false"}), F.lit("None"))
    return lambda x: F.coalesce(x.cast("string"), F.lit("None"))


def stored_metadata(rows: DataFrame, column: str) -> DataFrame:
    """rows with the struct `column` in the form that a vector store takes: scalars stay, lists become lists of text, structs and maps
    JSON text with sorted keys (nulls inside them kept), everything else text."""
    fields = []
    for f in rows.schema[column].dataType:
        value, kind = F.col(column).getField(f.name), f.dataType
        if isinstance(kind, T.StructType | T.MapType):
            value = F.to_json(_sorted_keys(value, kind), {"ignoreNullFields": "false"})
        elif isinstance(kind, T.ArrayType):
            value = F.transform(value, _list_item(kind.elementType))
        elif not isinstance(kind, T.StringType | T.BooleanType | T.NumericType):
            value = value.cast("string")
        fields.append(value.alias(f.name))
    return rows.withColumn(column, F.struct(*fields))
