"""Financial ratios in decimal arithmetic.

Every function gives the unrounded value; display() rounds half-even to two places.  A zero or null denominator gives null.
Operands are read as decimal(20,6), so that a quotient keeps at least ten places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERAND, RESULT = "decimal(20,6)", "decimal(38,12)"


def amount(value) -> Column:
    return (F.col(value) if isinstance(value, str) else value).try_cast(OPERAND)


def ratio(a, b, scale: int = 1) -> Column:
    # scaled before the division: a product with RESULT would keep eight places only
    return (amount(a) * F.lit(scale) / F.nullif(amount(b), F.lit(0).cast(OPERAND))).cast(RESULT)


def display(value: Column, places: int = 2) -> Column:
    return F.bround(value, places)


def growth(current, previous) -> Column:
    return ratio(amount(current) - amount(previous), previous, 100)


def direction(current, previous) -> Column:
    gap = amount(current) - amount(previous)
    return F.when(gap > 0, "up").when(gap < 0, "down").when(gap == 0, "flat")


def gross_margin(revenue, cost) -> Column:
    return ratio(amount(revenue) - amount(cost), revenue, 100)


def band(value: Column, *steps: tuple[float, str], rest: str) -> Column:
    """Label of the first step that the value reaches (exceeds, for a step of kind >)."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for least, label in steps:
        out = out.when(value >= least, label)
    return out.otherwise(rest)


def above(value: Column, *steps: tuple[float, str], rest: str) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for least, label in steps:
        out = out.when(value > least, label)
    return out.otherwise(rest)


def current_ratio_band(value: Column) -> Column:
    return band(value, (1.5, "strong"), (1.0, "adequate"), rest="weak")


def price_earnings_band(value: Column) -> Column:
    return above(value, (30, "high"), (15, "medium"), rest="low")


def research_band(value: Column) -> Column:
    return above(value, (20, "high"), (10, "medium"), rest="low")


#: operation -> (names of its operands, how its value follows from them, places shown)
OPERATIONS = {
    "yoy_growth": (("current", "previous"), growth, 2),
    "qoq_growth": (("current", "previous"), growth, 2),
    "gross_margin": (("revenue", "cost"), gross_margin, 2),
    "net_margin": (("net_income", "revenue"), lambda a, b: ratio(a, b, 100), 2),
    "roe": (("net_income", "equity"), lambda a, b: ratio(a, b, 100), 2),
    "roa": (("net_income", "assets"), lambda a, b: ratio(a, b, 100), 2),
    "debt_ratio": (("liabilities", "assets"), lambda a, b: ratio(a, b, 100), 2),
    "current_ratio": (("current_assets", "current_liabilities"), ratio, 2),
    "pe_ratio": (("price", "eps"), ratio, 2),
    "revenue_per_employee": (("revenue", "employees"), ratio, 2),
    "rd_ratio": (("rd_expense", "revenue"), lambda a, b: ratio(a, b, 100), 2),
    "difference": (("left", "right"), lambda a, b: (amount(a) - amount(b)).cast(RESULT), 2),
    "ratio": (("numerator", "denominator"), ratio, 4),
}


def calculate(requests: DataFrame) -> DataFrame:
    """Adds value, shown and error to requests (operation, operands map<string,double>, ...).

    An operation that isn't known, or operands that are missing, give an error that names them and no value.
    """
    value = shown = F.lit(None).cast(RESULT)
    needed = F.lit(None).cast("array<string>")
    for name, (operands, rule, places) in OPERATIONS.items():
        own = rule(*[F.element_at("operands", o).cast(OPERAND) for o in operands])
        is_it = F.col("operation") == name
        value = F.when(is_it, own).otherwise(value)
        shown = F.when(is_it, display(own, places).cast(RESULT)).otherwise(shown)
        needed = F.when(is_it, F.array(*map(F.lit, operands))).otherwise(needed)
    missing = F.array_except(needed, F.map_keys("operands"))
    error = F.when(needed.isNull(), F.concat(F.lit("unknown operation: "), F.coalesce("operation", F.lit("")))).when(F.size(missing) > 0, F.concat(F.lit("missing operands: "), F.array_join(missing, ", ")))
    out = requests.withColumn("error", error)
    return out.withColumns({"value": F.when(F.col("error").isNull(), value), "shown": F.when(F.col("error").isNull(), shown)})


def percentage(part, whole) -> Column:
    """Share in per cent to two places, half-even; null for nothing to share."""
    return display(ratio(part, whole, 100)).cast("decimal(18,2)")


#: Ranges of values in which a round of the selection counts.
RANGES = 1024


def nearest_rank(values: DataFrame, value: str, share: float, *keys: str, rounds: int = 1) -> DataFrame:
    """keys, n, p: the smallest value that `share` of a group's values don't exceed (null values aside), exactly.

    Each round counts the values in RANGES even ranges between a group's bounds and keeps the range that holds the rank; what is
    left is counted by value and summed up in order.  So a group's values are never gathered, and only what the rounds leave of them is sorted.
    """
    rows = values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    by = list(keys)
    on = lambda a, b: a.join(b, by) if by else a.join(F.broadcast(b))  # without keys b is one row
    size = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # a rank in whole numbers: share has six places at most
    bounds = size.withColumns({"rank": F.greatest(F.lit(1), F.expr(f"(n * {round(share * 1_000_000)} + 999999) div 1000000")), "of": F.col("n")}).drop("n")
    width = F.col("hi").cast("double") - F.col("lo").cast("double")
    place = F.when(width > 0, F.least(F.lit(RANGES - 1), F.floor((F.col("v").cast("double") - F.col("lo").cast("double")) / width * RANGES))).otherwise(0)
    for _ in range(rounds):
        rows = on(rows, bounds).filter("v between lo and hi").select(*by, "v", "lo", "hi", "rank", "of")
        counts = rows.groupBy(*by, place.alias("place")).agg(F.count("*").alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("rank").alias("rank"), F.first("of").alias("of"))
        upto = F.sum("k").over(Window.partitionBy(*by).orderBy("place"))  # RANGES rows of a group
        bounds = counts.withColumn("upto", upto).filter("upto >= rank and upto - k < rank").select(*by, "lo", "hi", (F.col("rank") - F.col("upto") + F.col("k")).alias("rank"), "of")
        rows = rows.select(*by, "v")
    left = on(rows, bounds).filter("v between lo and hi").groupBy(*by, "v").agg(F.count("*").alias("k"), F.first("rank").alias("rank"), F.first("of").alias("n"))
    upto = F.sum("k").over(Window.partitionBy(*by).orderBy("v"))
    return left.withColumn("upto", upto).filter("upto >= rank and upto - k < rank").select(*by, "n", F.col("v").alias("p"))


def summary(values: DataFrame, value: str, *keys: str) -> DataFrame:
    """count, mean (two places, half-even) and nearest-rank 95th percentile of the values, per group of keys."""
    rows = values.filter(F.col(value).isNotNull())
    mean = F.bround(F.avg(F.col(value).cast("decimal(20,6)")), 2).cast("decimal(20,2)")
    ranked = nearest_rank(rows, value, 0.95, *keys).select(*keys, F.col("p").alias("p95"))
    if keys:
        return rows.groupBy(*keys).agg(F.count(value).alias("n"), mean.alias("mean")).join(ranked, list(keys))
    return rows.agg(F.count(value).alias("n"), mean.alias("mean")).join(F.broadcast(ranked), F.lit(True), "left")  # one row each
