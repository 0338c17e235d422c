"""Facts, conflicts, growth series, comparisons, source policy: jobs over facts and web results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.finance import growth, ratio
from siltstone.functions.scalars import canonical_value, hostname, is_time_sensitive, percent_is_rough, percent_value, safe_url, source_date, stable_id, trust_tier

STALE_DAYS = 550


def find_facts(facts: DataFrame, sources: DataFrame, company: str, metric: str | None = None, period: str | None = None) -> DataFrame:
    """Facts of a company with their source, newest period first, then metric."""
    rows = facts.filter(F.col("company") == company)
    for column, value in (("metric", metric), ("period", period)):
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows.join(sources, "source_id").orderBy(F.desc("period"), "metric", "source_id")


CONFLICT_KEY = ["company", "metric", "period", "unit", "currency"]


def fact_conflicts(facts: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Facts of the groups that hold more than one canonical value, with the number of them.

    Two steps: the few conflicting keys are found with partial aggregates, then joined back, so clean groups are never gathered.
    asked: (company, period) pairs to which the search is limited.
    """
    rows = facts if asked is None else facts.join(asked, ["company", "period"], "left_semi")
    rows = rows.withColumns({"unit": F.lower("unit"), "currency": F.lower(F.coalesce("currency", F.lit(""))), "canonical": canonical_value(F.col("value"))})
    keys = rows.groupBy(*CONFLICT_KEY).agg(F.countDistinct("canonical").alias("n_values")).filter("n_values > 1")
    return rows.join(keys, CONFLICT_KEY)


def period_index(period: str) -> Column:
    """Quarters since year 0 of `2025 Q3`; null for anything else."""
    return F.regexp_extract(period, r"^(\d{4}) Q([1-4])$", 1).try_cast("int") * 4 + F.regexp_extract(period, r"^(\d{4}) Q([1-4])$", 2).try_cast("int") - 1


def growth_series(values: DataFrame, *keys: str) -> DataFrame:
    """Adds qoq and yoy growth (per cent) to rows of keys, period, value; only where that exact earlier period exists."""
    rows = values.withColumn("q", period_index("period"))
    # one window by quarter number: exactly one and exactly four quarters back
    by = Window.partitionBy(*keys).orderBy("q")
    back = lambda k: F.when(F.col("q").isNotNull(), F.max("value").over(by.rangeBetween(-k, -k)))
    out = rows.withColumns({"prior_quarter": back(1), "prior_year": back(4)})
    return out.withColumns({"qoq": growth("value", "prior_quarter"), "yoy": growth("value", "prior_year")}).drop("q", "prior_quarter", "prior_year")


def compare_companies(facts: DataFrame) -> DataFrame:
    """One wide row per company with the ratios whose inputs it has.  facts: company, metric, value."""
    names = ["revenue", "cost", "net_income", "equity", "rd_expense", "liabilities", "assets"]
    wide = facts.groupBy("company").pivot("metric", names).agg(F.first("value"))
    return wide.select(
        "company",
        ratio(F.col("revenue").try_cast("decimal(20,6)") - F.col("cost").try_cast("decimal(20,6)"), "revenue", 100).alias("gross_margin"),
        ratio("net_income", "revenue", 100).alias("net_margin"),
        ratio("net_income", "equity", 100).alias("roe"),
        ratio("rd_expense", "revenue", 100).alias("rd_ratio"),
        ratio("liabilities", "assets", 100).alias("debt_ratio"),
    )


def common_periods(rows: DataFrame) -> DataFrame:
    """Periods that all companies have.  rows: company, period."""
    n = rows.agg(F.countDistinct("company").alias("n"))  # one row
    per = rows.groupBy("period").agg(F.countDistinct("company").alias("k"))
    return per.join(F.broadcast(n), F.col("k") == F.col("n")).select("period")


def chunks_with_provenance(chunks: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks (document_id, ...) with title and publisher of their document's source; chunks without either are left out.

    Plain equi-joins: Spark broadcasts documents or sources where its statistics allow that.
    """
    return chunks.join(documents.select("document_id", "source_id"), "document_id").join(sources.select("source_id", "title", "publisher"), "source_id")


def facts_of_records(quarters: DataFrame, metrics: DataFrame) -> DataFrame:
    """Facts (company, metric, period, value, unit, source_id, trust_tier) of registry rows (company, period, metric key, value).

    metrics: key, metric, unit.  Each company and period is a source of its own, of the first tier.
    """
    rows = quarters.withColumnRenamed("metric", "key").join(F.broadcast(metrics), "key")  # a dictionary of some dozens of keys
    source = stable_id("src", F.lit("registry"), F.concat_ws(" ", "company", "period"))
    return rows.select("company", "metric", "period", F.col("value").cast("string").alias("value"), "unit", source.alias("source_id"), F.lit(1).alias("trust_tier"))


def dashboard(quarters: DataFrame, mix: DataFrame, annual: DataFrame | None = None) -> DataFrame:
    """company, series, mix: revenue and margin of the periods that all companies have, and the process mix with rough shares marked.

    quarters: company, period, metric, value.  mix: company, process, share (text).  annual: company, capex_intensity, source_title,
    source_publisher, source_published_at, source_url; with it come capex_intensity and annual_source, whose link is empty unless safe.
    """
    shown = quarters.join(common_periods(quarters), "period", "left_semi")
    wide = shown.groupBy("company", "period").pivot("metric", ["revenue", "gross_margin"]).agg(F.first("value"))
    series = wide.groupBy("company").agg(F.sort_array(F.collect_list(F.struct("period", "revenue", "gross_margin"))).alias("series"))
    shares = mix.groupBy("company").agg(F.sort_array(F.collect_list(F.struct("process", percent_value("share").alias("percent"), percent_is_rough("share").alias("rough")))).alias("mix"))
    out = series.join(shares, "company", "left")
    if annual is None:
        return out
    source = F.struct(F.col("source_title").alias("title"), F.col("source_publisher").alias("publisher"), F.col("source_published_at").alias("published_at"), safe_url("source_url").alias("url"))
    return out.join(annual.select("company", "capex_intensity", source.alias("annual_source")), "company", "left")


def requested_quarters(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """company, period, value, status for each requested quarter: `found` (also with a null value), or `missing`, never the annual figure instead."""
    rows = requests.join(facts.select("company", "period", "value", F.lit(True).alias("__held")), ["company", "period"], "left")
    return rows.withColumn("status", F.when(F.col("__held"), "found").otherwise("missing")).drop("__held")


def context_periods(requests: DataFrame, quarters: DataFrame, years: DataFrame, max_companies: int = 2) -> DataFrame:
    """request_id, company, period, status of the figures that a request gets.

    requests: request_id, companies (array, in the order of mention), periods (array; null or empty: none named).  quarters: company,
    period (one row each).  years: company, year.  Only the first max_companies count, and those that years doesn't hold get nothing.

    `found` and `missing` are quarters; `annual` is the year's row, served only where no asked quarter exists and either its own FY
    period or nothing was asked for.  So annual figures never stand for a missing quarter.
    """
    named = requests.select("request_id", F.slice("companies", 1, max_companies).alias("c"), F.coalesce("periods", F.array().cast("array<string>")).alias("asked"))
    rows = named.select("request_id", F.explode("c").alias("company"), "asked").join(years.select("company", F.concat(F.lit("FY"), F.col("year").cast("string")).alias("fy")), "company")
    cells = rows.select("request_id", "company", "fy", "asked", F.explode_outer("asked").alias("period"))
    cells = cells.join(quarters.select("company", "period", F.lit(True).alias("held")), ["company", "period"], "left").withColumn("held", F.coalesce("held", F.lit(False)))
    any_held = F.max("held").over(Window.partitionBy("request_id", "company"))
    whole_year = ~F.col("any") & ((F.size("asked") == 0) | F.array_contains("asked", F.col("fy")))
    cells = cells.withColumn("any", any_held).withColumn("year_only", whole_year)
    own = cells.filter("not year_only").select("request_id", "company", "period", F.when(F.col("held"), "found").otherwise("missing").alias("status"))
    return own.unionByName(cells.filter("year_only").select("request_id", "company", F.col("fy").alias("period"), F.lit("annual").alias("status")).distinct())


def unknown_metrics(requested: DataFrame, registry: DataFrame) -> DataFrame:
    return requested.join(registry.select("metric"), "metric", "left_anti")


def comparison_matrix(companies: DataFrame, periods: DataFrame, metrics: DataFrame, facts: DataFrame) -> DataFrame:
    """Cells company x period x metric with value and basis: reported, derived (operating margin from profit) or null.

    The three axes are small sets of a report; all of them times each other are the cells asked for.
    """
    profit = facts.filter("metric = 'operating_profit'").select("company", "period", F.col("value").alias("p"))
    revenue = facts.filter("metric = 'revenue'").select("company", "period", F.col("value").alias("r"))
    derived = profit.join(revenue, ["company", "period"]).select("company", "period", F.lit("operating_margin").alias("metric"), ratio("p", "r", 100).cast("double").alias("derived"))
    grid = companies.select("company").join(F.broadcast(periods.select("period"))).join(F.broadcast(metrics.select("metric")))
    cells = grid.join(facts.select("company", "period", "metric", F.col("value").cast("double").alias("reported")), ["company", "period", "metric"], "left").join(derived, ["company", "period", "metric"], "left")
    basis = F.when(F.col("reported").isNotNull(), "reported").when(F.col("derived").isNotNull(), "derived")
    return cells.select("company", "period", "metric", F.coalesce("reported", "derived").alias("value"), basis.alias("basis"))


def timeline(series: DataFrame, watched: DataFrame, limit: int = 12) -> DataFrame:
    """Newest periods of the watched companies: revenue beside margin.  series: company, period, metric, value."""
    pick = lambda m: series.filter(F.col("metric") == m).select("company", "period", F.col("value").alias(m))
    rows = pick("revenue").join(pick("gross_margin"), ["company", "period"]).join(watched.select("company"), "company", "left_semi")
    return rows.orderBy(F.desc("period"), F.desc("company")).limit(limit)


def watchlist_events(points: DataFrame, watched: DataFrame, lang: str = "zh", limit: int = 12) -> DataFrame:
    """The newest disclosures of the watched companies, with title and summary in Chinese or English.

    points: company, name_en, period, revenue (billion USD), gross_margin (per cent), published_at, source_title, source_url.
    Sorted by date, then company, both descending.  Spark takes the first `limit` of each task before the last sort.
    """
    figures = ("revenue", "gross_margin")
    if lang == "en":
        title, summary = F.format_string("%s %s results", "name_en", "period"), F.format_string("Revenue USD %.2fbn · gross margin %.1f%%", *figures)
    else:
        title, summary = F.format_string("%s %s 业绩", "company", "period"), F.format_string("营收 %.2f 十亿美元 · 毛利率 %.1f%%", *figures)
    rows = points.join(watched.select("company"), "company", "left_semi").withColumns({"title": title, "summary": summary, "source_url": safe_url("source_url")})
    out = rows.select("company", "name_en", "period", F.col("published_at").alias("date"), "title", "summary", "source_title", "source_url")
    return out.orderBy(F.desc("date"), F.desc("company"), F.desc("period")).limit(limit)


# -- web results --------------------------------------------------------------------------------------------------


# The markup of a result page.
RESULT = r'(?s)class="result results_links.*?".*?</div>\s*</div>'
RESULT_TITLE = r'(?s)class="result__title"[^>]*>.*?<a[^>]*href="([^"]*)"[^>]*>(.*?)</a>'
RESULT_SNIPPET = r'(?s)class="result__snippet"[^>]*>(.*?)</a>'


def search_results(pages: DataFrame, key: str = "page_id", max_results: int = 5) -> DataFrame:
    """key, pos, title, url, snippet, publisher, published_at, trust_tier of the results on result pages (key, html).

    Only the first max_results blocks of a page are looked at; blocks without a title or a link are left out, and pos counts what is left.
    """
    blocks = F.slice(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(RESULT), F.lit(0)), 1, max_results)
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]+>", ""), r"^\s+|\s+$", "")
    plain = lambda c: F.replace(F.replace(c, F.lit("&#x27;"), F.lit("'")), F.lit("&amp;"), F.lit("&"))
    title = lambda b: F.replace(plain(clean(F.regexp_extract(b, RESULT_TITLE, 2))), F.lit("&quot;"), F.lit('"'))
    found = F.transform(blocks, lambda b: F.struct(title(b).alias("title"), F.trim(F.regexp_extract(b, RESULT_TITLE, 1)).alias("url"), plain(clean(F.regexp_extract(b, RESULT_SNIPPET, 1))).alias("snippet")))
    rows = pages.select(key, F.posexplode(F.filter(found, lambda r: (r.title != "") & (r.url != ""))).alias("pos", "r")).select(key, "pos", "r.*")
    return rows.withColumns({"publisher": hostname("url"), "published_at": F.lit(""), "trust_tier": trust_tier("url")})


def assess_results(results: DataFrame, as_of, stale_after: int = STALE_DAYS) -> DataFrame:
    """Adds date_status, rank_score and rank to results (query_id, query, pos, published_at, trust_tier, score).

    Results dated after as_of go.  Undated ones stay, stale is what a time-sensitive query finds older than stale_after days.
    """
    day = source_date("published_at")
    rows = results.withColumn("day", day).filter(F.col("day").isNull() | (F.col("day") <= as_of))
    old = is_time_sensitive("query") & (F.datediff(as_of, F.col("day")) > stale_after)
    rows = rows.withColumn("date_status", F.when(F.col("day").isNull(), "undated").when(old, "stale").otherwise("dated"))
    tier = F.when(F.col("trust_tier") == 1, 0.20).when(F.col("trust_tier") == 2, 0.08).when(F.col("trust_tier") == 3, 0.0).otherwise(-0.05)
    fresh = F.when(F.col("date_status") == "dated", 0.08).when(F.col("date_status") == "stale", -0.10).otherwise(0.0)
    rows = rows.withColumn("rank_score", F.round(F.coalesce("score", F.lit(0.0)) + tier + fresh, 9))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "pos")))


def policy_counts(results: DataFrame, as_of, stale_after: int = STALE_DAYS) -> DataFrame:
    """Per query: results that lie in the future, and stale and undated ones among the rest."""
    future = results.groupBy("query_id").agg(F.count_if(source_date("published_at") > as_of).alias("excluded"))
    kept = assess_results(results, as_of, stale_after).groupBy("query_id").agg(F.count_if(F.col("date_status") == "stale").alias("stale"), F.count_if(F.col("date_status") == "undated").alias("undated"))
    return future.join(kept, "query_id", "left").fillna(0, ["stale", "undated"])


def source_mix(citations: DataFrame, key: str = "answer_id", queries: DataFrame | None = None) -> DataFrame:
    """Web citations of each answer by tier and date status; with queries (key, query) also whether the question is time-sensitive."""
    web = citations.filter("source_type = 'web'")
    tiers = [F.count_if(F.col("trust_tier") == t).alias(f"tier_{t}") for t in (1, 2, 3)]
    out = web.groupBy(key).agg(*tiers, F.count_if(F.col("date_status") == "undated").alias("undated"), F.count_if(F.col("date_status") == "stale").alias("stale"))
    if queries is None:
        return out
    return out.join(queries.select(key, F.coalesce(is_time_sensitive("query"), F.lit(False)).alias("time_sensitive")), key, "left").fillna(False, ["time_sensitive"])
