"""Column functions: identifiers, links, dates, periods, keyword flags, tokens, bounded texts.

All are built from JVM-side expressions, so they stay within the code that Spark generates for a stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions import words as W


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- identifiers --------------------------------------------------------------------------------------------------


def stable_id(prefix: str, *parts, length: int = 24) -> Column:
    """prefix_ and the first hex digits of sha256 over the parts, joined by the unit separator; a null part reads None."""
    texts = [F.coalesce(_col(p).cast("string"), F.lit("None")) for p in parts]
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\u001f", *texts), 256), 1, length))


def short_hash(*parts, length: int = 12) -> Column:
    """First hex digits of md5 over the parts' text."""
    return F.substring(F.md5(F.concat(*[F.coalesce(_col(p).cast("string"), F.lit("None")) for p in parts])), 1, length)


# -- links --------------------------------------------------------------------------------------------------------


def hostname(url) -> Column:
    """Lower-case host without a leading `www.`; empty for anything that isn't a URL."""
    host = F.lower(F.try_parse_url(_col(url), F.lit("HOST")))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def domain_suffixes(host) -> Column:
    """The host and every parent domain of it."""
    parts = F.split(_col(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def trust_tier(url, official: Iterable[str] = W.OFFICIAL_DOMAINS, reputable: Iterable[str] = W.REPUTABLE_DOMAINS) -> Column:
    """1 for an official domain or a sub-domain of one, 2 for a reputable one, else 3."""
    suffixes = domain_suffixes(hostname(url))
    among = lambda names: F.arrays_overlap(suffixes, F.array(*map(F.lit, names)))
    return F.when(among(official), 1).when(among(reputable), 2).otherwise(3)


def safe_url(url, https_only: bool = False) -> Column:
    """The link if it is absolute http(s) with a host, else an empty text."""
    url = F.trim(_col(url))
    scheme, host = (F.try_parse_url(url, F.lit(p)) for p in ("PROTOCOL", "HOST"))
    good = F.lower(scheme).isin(["https"] if https_only else ["http", "https"]) & (F.coalesce(host, F.lit("")) != "")
    return F.when(good, url).otherwise("")


# -- dates and periods --------------------------------------------------------------------------------------------


def source_date(value) -> Column:
    """Day of an ISO stamp (its own, whatever its offset), else of an RFC 2822 stamp, else of the first 20yy-m-d in the text, else null.

    ISO years with a sign (before year 0, after 9999) count too.
    """
    text = F.trim(_col(value))
    signed = F.regexp_extract(text, r"^([+-]\d{4,6}-\d{2}-\d{2})(?:[T ]\d{2}:?\d{2}.*)?$", 1).try_cast("date")
    iso = F.try_to_date(F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}:?\d{2}.*)?$", 1), "yyyy-MM-dd")
    basic = F.try_to_date(F.regexp_extract(text, r"^(\d{8})(?:T\d{4}.*)?$", 1), "yyyyMMdd")
    mail = F.try_to_date(F.regexp_extract(text, r"(?i)^(?:[a-z]{3},\s*)?(\d{1,2} [a-z]{3} \d{4})\s+\d{1,2}:\d{2}", 1), "d MMM yyyy")
    loose = r"(?<![0-9A-Za-z_])(20\d{2})[-/](0?[1-9]|1[0-2])[-/](0?[1-9]|[12]\d|3[01])(?![0-9A-Za-z_])"
    found = F.try_to_date(F.concat_ws("-", *[F.regexp_extract(text, loose, k) for k in (1, 2, 3)]), "yyyy-M-d")
    return F.coalesce(iso, signed, basic, mail, found)


def normalize_period(value) -> Column:
    """`2025 Q3` for the usual spellings of a quarter, `FY2025` for a year, else the cleaned upper-case text."""
    text = F.regexp_replace(F.upper(F.trim(_col(value))), r"\s+", " ")
    got = lambda pattern, k: F.regexp_extract(text, pattern, k)
    year_first, q_first, digit_first = r"^(20\d{2})\s*(?:年|[-/])?\s*Q([1-4])$", r"^Q([1-4])\s*[-/]?\s*(20\d{2})$", r"^([1-4])Q\s*[-/]?\s*(20\d{2})$"
    chinese = r"^(20\d{2})\s*年?\s*第?([一二三四1-4])\s*季度$"
    return (
        F.when(text.rlike(year_first), F.concat(got(year_first, 1), F.lit(" Q"), got(year_first, 2)))
        .when(text.rlike(q_first), F.concat(got(q_first, 2), F.lit(" Q"), got(q_first, 1)))
        .when(text.rlike(digit_first), F.concat(got(digit_first, 2), F.lit(" Q"), got(digit_first, 1)))
        .when(text.rlike(chinese), F.concat(got(chinese, 1), F.lit(" Q"), F.translate(got(chinese, 2), *W.CHINESE_DIGITS)))
        .when(text.rlike(r"^20\d{2}$"), F.concat(F.lit("FY"), text))
        .otherwise(text)
    )


def periods_in(query, available) -> Column:
    """Quarters of the available ones that the query names, in order; all of the named years where it asks for every quarter."""
    query, available = _col(query), _col(available)
    upper = F.upper(query)
    every = lambda text, pattern, k: F.regexp_extract_all(text, F.lit(pattern), F.lit(k))

    def pairs(text, pattern, year, quarter):
        return F.zip_with(every(text, pattern, year), every(text, pattern, quarter), lambda y, q: F.concat(y, F.lit(" Q"), F.translate(q, *W.CHINESE_DIGITS)))

    named = F.concat(
        pairs(upper, r"(20\d{2})\s*(?:年|[-/])?\s*Q([1-4])", 1, 2),
        pairs(upper, r"Q([1-4])\s*[-/]?\s*(20\d{2})", 2, 1),
        pairs(query, r"(20\d{2})\s*年?\s*第?([一二三四1-4])\s*季度", 1, 2),
    )
    years = every(upper, r"(20\d{2})", 1)
    whole = F.sort_array(F.filter(available, lambda p: F.array_contains(years, F.substring(p, 1, 4))))
    return F.when(contains_any(upper, W.ALL_QUARTERS) & (F.size(years) > 0), whole).otherwise(F.array_intersect(F.array_distinct(named), available))


# -- keyword flags ------------------------------------------------------------------------------------------------


def contains_any(text, terms: Iterable[str]) -> Column:
    text = _col(text)
    out = F.lit(False)
    for t in terms:
        out = out | F.contains(text, F.lit(t))
    return out


def is_time_sensitive(query) -> Column:
    return contains_any(F.lower(_col(query)), W.TIME_SENSITIVE)


def needs_calculation(query) -> Column:
    return contains_any(F.lower(_col(query)), W.CALCULATION)


def route(query) -> Column:
    low = F.lower(_col(query))
    return F.when(contains_any(low, W.ROUTE_TABLE), "table_first").when(contains_any(low, W.ROUTE_TEXT), "text_first").otherwise("balanced")


def collection(query) -> Column:
    return F.when(contains_any(_col(query), W.COLLECTION_TABLE), "table").otherwise("text")


def expand_query(query, expansions: Mapping[str, Iterable[str]] = W.EXPANSIONS) -> Column:
    """The query, then the aliases of every trigger in it that it doesn't hold yet, each once."""
    query = _col(query)
    low = F.lower(query)
    extra = [F.when(F.contains(low, F.lit(t.lower())) & ~F.contains(low, F.lit(a.lower())), F.lit(a)) for t, aliases in expansions.items() for a in aliases]
    return F.array_join(F.concat(F.array(query), F.array_distinct(F.array_compact(F.array(*extra)))), " ")


def preferred_domains(query, domains: Mapping[str, Iterable[str]] = W.QUERY_DOMAINS) -> Column:
    """Domains of the named companies where the query asks for filings, else none."""
    low = F.lower(_col(query))
    found = [F.when(F.contains(low, F.lit(name)), F.lit(d)) for name, own in domains.items() for d in own]
    none = F.array().cast("array<string>")
    return F.when(contains_any(low, W.FILING_MARKERS), F.array_distinct(F.array_compact(F.array(*found)))).otherwise(none)


def cache_key(query, max_results) -> Column:
    text = F.regexp_replace(F.trim(F.lower(_col(query))), r"\s+", " ")
    return F.sha2(F.concat_ws("\u001f", F.lit("v1"), text, _col(max_results).cast("string")), 256)


def cache_expiry(query, now) -> Column:
    """15 minutes for time-sensitive queries, else a day."""
    return F.when(is_time_sensitive(query), _col(now) + F.expr("INTERVAL 15 MINUTES")).otherwise(_col(now) + F.expr("INTERVAL 24 HOURS"))


# -- values and texts ---------------------------------------------------------------------------------------------


def canonical_value(value) -> Column:
    """Decimal text without needless zeros for a number (33.10 is 33.1), else the trimmed lower-case text."""
    text = F.trim(_col(value))
    number = text.try_cast("decimal(38,10)")
    plain = F.regexp_replace(F.regexp_replace(number.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    plain = F.when(number == 0, "0").otherwise(plain)
    return F.coalesce(plain, F.lower(text))


def percent_value(value) -> Column:
    return F.regexp_replace(F.trim(_col(value)), r"[~%\s]", "").try_cast("double")


def percent_is_rough(value) -> Column:
    return F.contains(_col(value), F.lit("~"))


def metric_display(key, value) -> Column:
    key, value = _col(key), _col(value)
    # six significant digits, without needless zeros
    exponent = F.when(value == 0, 0).otherwise(F.floor(F.log10(F.abs(value)))).cast("int")
    factor = F.pow(F.lit(10.0), F.lit(5) - exponent)
    rounded = F.regexp_replace(F.regexp_replace(F.format_string("%.12f", F.round(value * factor) / factor), r"0+$", ""), r"\.$", "")
    return (
        F.when(key.endswith("_pct"), F.concat(F.format_string("%.1f", value), F.lit("%")))
        .when(key.endswith("_usd_billion"), F.concat(rounded, F.lit(" USD billion")))
        .when(key == "usd_ntd_exchange_rate", F.concat(F.format_string("%.2f", value), F.lit(" NTD per USD")))
        .otherwise(value.cast("string"))
    )


def lexical_tokens(text) -> Column:
    """Latin tokens (with inner . _ % -), then for every run of CJK letters the run, its bigrams and its trigrams; repeats count."""
    low = F.lower(F.coalesce(_col(text), F.lit("")))
    latin = F.regexp_extract_all(low, F.lit(r"[a-z0-9]+(?:[._%-][a-z0-9]+)*"), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit("[㐀-鿿]+"), F.lit(0))

    def grams(run, n):
        return F.when(F.length(run) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(run) - (n - 1), F.lit(1))), lambda i: F.substring(run, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.concat(latin, F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), grams(r, 2), grams(r, 3)))))


def usage(value) -> Column:
    """A count that can't be read, or is negative, is 0."""
    return F.greatest(F.coalesce(_col(value).try_cast("bigint"), F.lit(0)), F.lit(0)).cast("bigint")


def cache_miss(prompt, hit, miss) -> Column:
    return F.when(_col(miss).isNull(), F.greatest(usage(prompt) - usage(hit), F.lit(0))).otherwise(usage(miss)).cast("bigint")


def usage_cost(hit, miss, completion, hit_rate, miss_rate, completion_rate) -> Column:
    """Cost of tokens at rates per million, 8 decimals half-even; null unless all rates are numbers of at least 0."""
    rates = [_col(r).try_cast("decimal(12,6)") for r in (hit_rate, miss_rate, completion_rate)]
    counts = [usage(c).cast("decimal(18,0)") for c in (hit, miss, completion)]
    total = sum((c * r for c, r in zip(counts, rates, strict=True)), F.lit(0).cast("decimal(18,0)")).cast("decimal(30,6)")
    good = F.lit(True)
    for r in rates:
        good = good & r.isNotNull() & (r >= 0)
    return F.when(good, F.bround((total * F.lit("0.000001").cast("decimal(7,6)")).cast("decimal(38,12)"), 8).cast("decimal(30,8)"))


def audit_outcome(status) -> Column:
    status = _col(status)
    return F.when(status < 400, "success").when(status.isin(401, 403, 429), "denied").otherwise("error")


def is_tool_error(result) -> Column:
    text = F.ltrim(F.coalesce(_col(result), F.lit("")))
    return text.startswith("{") & F.contains(F.substring(text, 1, 200), F.lit('"error"'))


def bounded(text, limit: int, tail: str = "...") -> Column:
    text = _col(text)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(tail))).otherwise(text)


def title_of(text, limit: int = 80) -> Column:
    return F.substring(F.trim(F.regexp_replace(_col(text), r"\s+", " ")), 1, limit)


def slug(text, limit: int = 64) -> Column:
    """Word characters and hyphens only, for a file name."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(_col(text)), r"[^\p{L}\p{N}_-]+", "-"), r"^-+|-+$", ""), 1, limit)


def citation_label(kind, source, name_en, period, page, title) -> Column:
    kind, source, name_en, period, page, title = map(_col, (kind, source, name_en, period, page, title))
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    named = F.when(has(name_en), F.concat(source, F.lit(" ("), name_en, F.lit(")"))).otherwise(source)
    when = F.when(period.startswith("FY") | F.contains(period, F.lit(" Q")), F.concat(F.lit(" · "), period)).otherwise(F.concat(F.lit(" · FY"), period))
    financial = F.concat(named, F.when(has(period), when).otherwise(" 财务数据"), F.when(has(title), F.concat(F.lit(" · "), title)).otherwise(""))
    document = F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(source, F.lit(" · p"), page.cast("string"))).otherwise(source)
    return F.when(kind == "term", named).when(kind == "financial", financial).when(kind == "web", source).otherwise(document)


def citation_icon(kind) -> Column:
    return F.when(_col(kind) == "term", "KNOWLEDGE").when(_col(kind) == "financial", "FINANCIAL").when(_col(kind) == "web", "WEB").otherwise("DOCUMENT")


def keyed_hash(value, secret: str, length: int = 24) -> Column:
    """HMAC-SHA-256 of a text under the secret, as its first hex digits, from built-in functions; null is taken as the word None.

    The padded key stands in the plan, so plans and event logs are as secret as the key.
    """
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    text = F.coalesce(_col(value).cast("string"), F.lit("None")).cast("binary")
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text), 256))), 256), 1, length)
