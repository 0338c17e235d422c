"""Roll-ups of run events, operations reports, conversations, audits of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.finance import percentage, summary
from siltstone.functions.scalars import audit_outcome, safe_url


def run_rollup(events: DataFrame) -> DataFrame:
    """Per run: calls and errors by kind, token sums, first-token latency, status.

    events: run_id, ts, kind (model, tool, first_token, final), ok, prompt, completion, latency_ms, status.
    Status: the explicit one, else error if the final answer failed, degraded if any call did, else success.
    """
    kind = F.col("kind")
    per = events.groupBy("run_id").agg(
        F.count_if(kind == "model").alias("model_calls"),
        F.count_if((kind == "model") & ~F.col("ok")).alias("model_errors"),
        F.count_if(kind == "tool").alias("tool_calls"),
        F.count_if((kind == "tool") & ~F.col("ok")).alias("tool_errors"),
        F.sum("prompt").alias("prompt_tokens"),
        F.sum("completion").alias("completion_tokens"),
        F.min(F.when(kind == "first_token", F.col("latency_ms"))).alias("first_token_ms"),
        F.max(F.when(kind == "final", (~F.col("ok")).cast("int"))).alias("failed"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("ts"))).alias("explicit"),
    )
    status = F.when(F.col("explicit").isNotNull(), F.col("explicit")).when(F.col("failed") == 1, "error").when(F.col("model_errors") + F.col("tool_errors") > 0, "degraded").otherwise("success")
    return per.withColumn("status", status).drop("failed", "explicit")


def operations_summary(runs: DataFrame) -> DataFrame:
    """One row over the runs given (status, duration_ms, prompt_tokens, completion_tokens): counts, rates, latency."""
    shares = [F.count_if(F.col("status") == s).alias(s) for s in ("success", "degraded", "error", "cancelled")]
    base = runs.agg(F.count("*").alias("runs"), *shares, F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    rates = {f"{s}_rate": percentage(F.col(s), F.col("runs")) for s in ("success", "degraded", "error", "cancelled")}
    latency = summary(runs, "duration_ms").select(F.col("mean").alias("mean_ms"), F.col("p95").alias("p95_ms"))
    return base.withColumns(rates).join(F.broadcast(latency))  # one row each


def recent_runs(runs: DataFrame, now, hours: int, newest: int = 10_000) -> DataFrame:
    """The newest runs of the last hours; the number is part of the report."""
    if not 1 <= hours <= 2160:
        raise ValueError("hours must be 1 to 2160")
    return runs.filter(F.col("ts") >= now - F.expr(f"INTERVAL {hours} HOURS")).orderBy(F.desc("ts"), F.desc("run_id")).limit(newest)


def tool_summary(tools: DataFrame, runs: DataFrame) -> DataFrame:
    """Per tool of the selected runs: calls, mean and 95th percentile of duration, errors."""
    rows = tools.join(runs.select("run_id"), "run_id", "left_semi")
    stats = summary(rows, "duration_ms", "tool")
    errors = rows.groupBy("tool").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"))
    return errors.join(stats, "tool").select("tool", "calls", "errors", "mean", "p95")


def route_latency(samples: DataFrame) -> DataFrame:
    """Per path: median, value at place int(0.95 n) of the sorted samples, maximum.  samples: path, ms.

    The place is found by counts of distinct values, so a path's samples are never gathered.
    """
    counts = samples.groupBy("path", "ms").agg(F.count("*").alias("k"))
    n = samples.groupBy("path").agg(F.count("*").alias("n"), F.max("ms").alias("max_ms"), F.expr("percentile(ms, 0.5)").alias("median_ms"))
    upto = F.sum("k").over(Window.partitionBy("path").orderBy("ms"))
    rows = counts.withColumn("upto", upto).join(n, "path").filter(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * 95 / 100)))
    p95 = rows.groupBy("path").agg(F.min("ms").alias("p95_ms"))
    return n.join(p95, "path").select("path", F.round("median_ms", 2).alias("median_ms"), F.round("p95_ms", 2).alias("p95_ms"), F.round("max_ms", 2).alias("max_ms"))


def audit_rows(requests: DataFrame) -> DataFrame:
    """Mutating requests only, with their outcome."""
    return requests.filter(F.upper("method").isin("POST", "PUT", "PATCH", "DELETE")).withColumn("outcome", audit_outcome("status"))


# -- conversations ------------------------------------------------------------------------------------------------


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """Last n messages of each conversation (conv_id, turn), to be read oldest first."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return messages.withColumn("__n", nth).filter(F.col("__n") <= n).drop("__n")


def titles(messages: DataFrame, limit: int = 48, collapse: bool = True) -> DataFrame:
    """Title of each conversation: its first user message, cut."""
    first = messages.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    text = F.trim(F.regexp_replace("text", r"\s+", " ")) if collapse else F.col("text")
    return first.select("conv_id", F.substring(text, 1, limit).alias("title"))


def markdown_export(messages: DataFrame) -> DataFrame:
    """conv_id, markdown: roles and texts in the order of turns.  A conversation's own messages are gathered, no more."""
    line = F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x.l), "\n\n").alias("markdown"))


def research_records(conversations: DataFrame, messages: DataFrame, citations: DataFrame, exported: str, footer: str, lang: str = "zh") -> DataFrame:
    """conv_id, markdown: title, roles and contents in the order of turns, and each answer's numbered sources.

    conversations: conv_id, title.  messages: conv_id, turn, role, text.  citations: conv_id, turn, pos, icon, display, url, publisher,
    published_at, trust_tier, source_type, snippet.  exported: the time to name.  A conversation's own rows are gathered, no more.
    """
    zh = lang == "zh"
    # fixed values: the labels of a record
    roles = {"user": "用户", "assistant": "分析", "system": "系统"} if zh else {"user": "User", "assistant": "Analysis", "system": "System"}
    sources, untitled, when = ("来源", "未命名研究", "导出时间") if zh else ("Sources", "Untitled research", "Exported")
    has = lambda c: F.coalesce(F.col(c), F.lit("")) != ""

    link = safe_url(F.coalesce("url", F.lit("")))
    shown = F.coalesce(F.nullif(F.col("display"), F.lit("")), F.lit("Source"))
    label = F.when(link != "", F.concat(F.lit("["), shown, F.lit("]("), link, F.lit(")"))).otherwise(shown)
    tier = F.when((F.col("trust_tier") > 0) & F.col("source_type").isin("web", "financial"), F.concat(F.lit("Tier "), F.col("trust_tier").cast("string")))
    notes = F.concat_ws(" | ", F.when(has("publisher"), F.col("publisher")), F.when(has("published_at"), F.col("published_at")), tier)
    quote = F.when(has("snippet"), F.concat(F.lit("\n   > "), F.trim(F.replace(F.col("snippet"), F.lit("\n"), F.lit(" "))))).otherwise("")
    entry = F.concat(F.lit(". **"), F.coalesce("icon", F.lit("SOURCE")), F.lit("** "), label, F.when(notes != "", F.concat(F.lit(" - "), notes)).otherwise(""), quote)
    listed = citations.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(F.struct("pos", entry.alias("entry")))).alias("c"))
    listed = listed.select("conv_id", "turn", F.array_join(F.transform("c", lambda x, i: F.concat((i + 1).cast("string"), x.entry)), "\n\n").alias("sources"))

    role = F.coalesce(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv])[F.col("role")], F.col("role"), F.lit(""))
    more = F.when(F.col("sources").isNotNull(), F.concat(F.lit(f"\n\n### {sources}\n\n"), F.col("sources"))).otherwise("")
    part = F.concat(F.lit("## "), role, F.lit("\n\n"), F.coalesce("text", F.lit("")), more)
    bodies = messages.join(listed, ["conv_id", "turn"], "left").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("part")))).alias("m"))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit(untitled))
    body = F.array_join(F.transform("m", lambda x: x.part), "\n\n")
    whole = F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.lit(f"> {when}: {exported}"), body, F.lit("---"), F.lit(footer))
    return conversations.select("conv_id", "title").join(bodies, "conv_id", "left").select("conv_id", F.concat(F.regexp_replace(whole, r"^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))


def assemble_answers(tokens: DataFrame) -> DataFrame:
    """Answers from token events (answer_id, seq, token), in order; blank ones are dropped."""
    whole = tokens.groupBy("answer_id").agg(F.expr("listagg(token) WITHIN GROUP (ORDER BY seq)").alias("answer"))
    return whole.filter(F.trim("answer") != "")


# -- audits -------------------------------------------------------------------------------------------------------


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Count of child rows whose key isn't among the parent's; null keys are no orphans."""
    rows = child.filter(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")
    return rows.agg(F.count("*").alias("orphans"))


def table_contract(table: DataFrame, key: list[str], required: dict[str, str] | None = None, checks: dict[str, str] | None = None) -> DataFrame:
    """One row: rows, duplicate keys, violations of each check (SQL condition), and the required columns that are missing."""
    missing = sorted(set(required or {}) - set(table.columns))
    out = table.agg(F.count("*").alias("rows"), *[F.count_if(~F.expr(c)).alias(n) for n, c in (checks or {}).items()])
    repeated = table.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("duplicate_keys"))
    return out.join(F.broadcast(repeated)).withColumn("missing_columns", F.lit(",".join(missing)))  # one row each


def newest_jobs(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Documents with their newest job: stage, progress and error, with fallbacks where there is none."""
    newest = jobs.groupBy("document_id").agg(F.max_by(F.struct("stage", "progress", "error"), F.struct("created_at", "job_id")).alias("j"))
    rows = documents.join(newest, "document_id", "left")
    return rows.select("document_id", F.coalesce("j.stage", "status").alias("stage"), F.coalesce("j.progress", F.lit(0)).alias("progress"), F.coalesce("j.error", F.lit("")).alias("error"))


def newest(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The newest n rows by the columns, each descending."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)
