"""Readiness of a table for forecasting: observations, regularity, target, leakage, and the combined score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtrust.functions.values import absent, col, frequency, moment, number, rounded
from tabtrust.operators.checks import fenced, kinds

MIN_OBSERVATIONS, MIN_CYCLES, NEAR_ZERO = 30, 2, 1e-9
MAX_NULLS, MAX_ZEROS, MAX_OUTLIERS = 30.0, 50.0, 30.0
WEIGHTS = (0.30, 0.20, 0.30, 0.20)
ID_NAME = r"(?i)(^|_)(id|uuid|key|code|no)($|_)"


def _when(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, m) for c, m in pairs]), lambda x: x.isNotNull())


def _gaps(dates: DataFrame) -> DataFrame:
    """(d, rows, gap): days to the previous distinct date. Dates are few (days), whatever the rows."""
    days = dates.groupBy("d").agg(F.count("*").alias("rows"))
    return days.withColumn("gap", F.datediff("d", F.lag("d").over(Window.partitionBy(F.lit(0)).orderBy("d"))))


def temporal(df: DataFrame, date: str) -> DataFrame:
    """Observations, range, cycles of 365 days and frequency by the median gap."""
    days = _gaps(df.select(moment(col(date), kinds(df)[date]).cast("date").alias("d")).where("d is not null"))
    one = days.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("observations"), F.min("d").alias("first"), F.max("d").alias("last"), F.median("gap").alias("median_gap"))
    span = F.datediff("last", "first")
    one = one.select("observations", "first", "last", span.cast("long").alias("range_days"), F.floor(span / 365).cast("long").alias("cycles"), frequency(F.col("median_gap")).alias("frequency"))
    return one.withColumn("blockers", _when((F.col("observations") < MIN_OBSERVATIONS, "too_few_observations"), (F.coalesce("cycles", F.lit(0)) < MIN_CYCLES, "too_few_cycles")))


def expected_dates(first: Column, last: Column, freq: Column) -> Column:
    """Number of calendar dates from first to last: days, Sundays, or starts of months, quarters and years."""
    months = lambda unit: F.months_between(F.trunc(last, unit), F.trunc(first, unit)).cast("long") + F.when(F.trunc(first, unit) == first, 1).otherwise(0)
    sunday = F.next_day(F.date_sub(first, 1), "Sun")
    return (
        F.when(freq == "weekly", F.when(sunday > last, 0).otherwise(F.floor(F.datediff(last, sunday) / 7) + 1))
        .when(freq == "monthly", months("month")).when(freq == "quarterly", F.floor(F.months_between(F.trunc(last, "quarter"), F.trunc(first, "quarter")) / 3) + F.when(F.trunc(first, "quarter") == first, 1).otherwise(0))
        .when(freq == "yearly", F.year(last) - F.year(first) + F.when(F.trunc(first, "year") == first, 1).otherwise(0)).otherwise(F.datediff(last, first) + 1).cast("long")
    )


def intervals(df: DataFrame, date: str) -> DataFrame:
    """Duplicate dates, expected against actual dates, largest gap and regularity; only duplicates block."""
    days = _gaps(df.select(moment(col(date), kinds(df)[date]).cast("date").alias("d")).where("d is not null"))
    one = days.agg(F.count("*").alias("actual"), F.sum("rows").alias("rows"), F.min("d").alias("first"), F.max("d").alias("last"), F.median("gap").alias("m"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("max_gap_days"))
    one = one.withColumn("frequency", frequency(F.col("m"))).withColumn("expected", expected_dates(F.col("first"), F.col("last"), F.col("frequency"))).withColumn("duplicates", F.col("rows") - F.col("actual"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide("actual", "expected"), F.lit(0.0)) - F.try_divide("duplicates", "rows")))
    return one.select("actual", "expected", "duplicates", "max_gap_days", "frequency", F.round(score, 4).alias("regularity"), _when((F.col("duplicates") > 0, "duplicate_dates")).alias("blockers"))


def target(df: DataFrame, column: str) -> DataFrame:
    """Nulls, zeros, infinite values, variance and outliers of the target, as one row of percentages."""
    kind = kinds(df)[column]
    n = number(col(column), kind)
    infinite = F.abs(n) == float("inf")
    x = F.when(~infinite, n)
    base = df.select(absent(col(column), kind).alias("null"), n.alias("n"), x.alias("x"))
    (fence,) = fenced(base, [F.col("x")])
    out = F.lit(False) if fence.none else (F.col("x") < fence.low) | (F.col("x") > fence.high)
    one = base.agg(F.count("*").alias("rows"), F.count_if("null").alias("nulls"), F.count("n").alias("numbers"), F.count_if(F.col("x") == 0).alias("zeros"), F.count_if(F.abs("n") == float("inf")).alias("infinite"), F.count_if(out).alias("outliers"), F.min("x").alias("low"), F.max("x").alias("high"), F.coalesce(F.var_samp("x"), F.lit(0.0)).alias("variance"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a) * 100.0, F.col(b)), F.lit(0.0)), 2)
    one = one.select("rows", share("nulls", "rows").alias("null_pct"), share("zeros", "numbers").alias("zero_pct"), "infinite", share("outliers", "numbers").alias("outlier_pct"), "low", "high", "variance", share("numbers", "rows").alias("numeric_pct"))
    return one.withColumn("blockers", _when((F.col("null_pct") > MAX_NULLS, "too_many_nulls"), (F.col("zero_pct") > MAX_ZEROS, "too_many_zeros"), (F.col("infinite") > 0, "infinite_values"), (F.col("variance") < NEAR_ZERO, "no_variance"), (F.col("outlier_pct") > MAX_OUTLIERS, "too_many_outliers"), (F.col("numeric_pct") + F.col("null_pct") < 99, "not_numeric")))


def leakage(df: DataFrame, column: str, features: Sequence[str]) -> DataFrame:
    """(feature, correlation, leaks, ratio, high_cardinality, id_name) of features; correlations of one aggregate, 0 without variance."""
    if not features:
        return df.sparkSession.createDataFrame([], "feature string, correlation double, leaks boolean, ratio double, high_cardinality boolean, id_name boolean")
    by = kinds(df)
    y = number(col(column), by[column])
    xs = [number(col(c), by[c]) for c in features]
    stats = []
    for i, (c, x) in enumerate(zip(features, xs, strict=True)):
        both = x.isNotNull() & y.isNotNull()
        a, b = F.when(both, x), F.when(both, y)
        stats.append(F.struct(F.when((F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.covar_pop(a, b) / (F.stddev_pop(a) * F.stddev_pop(b))).otherwise(0.0).alias("r"), F.count(col(c)).alias("n")).alias(f"s{i}"))
    one = df.agg(*stats).select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.round(F.col(f"s{i}.r"), 6).alias("correlation"), F.col(f"s{i}.n").alias("n")) for i, c in enumerate(features)])))
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), col(c).cast("string").alias("v")) for c in features])).alias("x")).select("x.*").where("v is not null").distinct().groupBy("feature").agg(F.count("*").alias("distinct"))
    out = one.join(F.broadcast(long), "feature", "left")
    share = rounded(F.coalesce(F.try_divide("distinct", "n"), F.lit(0.0)))
    return out.select("feature", "correlation", (F.abs("correlation") > 0.99).alias("leaks"), share.alias("ratio"), (share > 0.95).alias("high_cardinality"), F.col("feature").rlike(ID_NAME).alias("id_name"))


def readiness(df: DataFrame, date: str, column: str, features: Sequence[str]) -> DataFrame:
    """The weighted score of the four parts, their blockers, and ready, caution or not_ready."""
    t = temporal(df, date).select(F.col("blockers").alias("b1"), F.when(F.col("observations") >= MIN_OBSERVATIONS, 50.0).otherwise(F.col("observations") * 50.0 / MIN_OBSERVATIONS).alias("o"), (F.least(F.lit(1.0), F.coalesce(F.col("cycles") / MIN_CYCLES, F.lit(0.0))) * 50).alias("c"))
    i = intervals(df, date).select(F.col("blockers").alias("b2"), F.round(F.col("regularity") * 100, 2).alias("interval_score"))
    g = target(df, column)
    raw = F.greatest(F.lit(0.0), F.lit(100.0) - F.col("null_pct") - F.col("zero_pct") * 0.5 - F.col("outlier_pct"))
    g = g.select(F.col("blockers").alias("b3"), F.round(F.when(F.col("variance") < NEAR_ZERO, F.least(raw, F.lit(10.0))).otherwise(raw), 2).alias("target_score"))
    bad = leakage(df, column, features).agg(F.coalesce(F.bool_or("leaks"), F.lit(False)).alias("x"), F.coalesce(F.bool_or(F.col("high_cardinality") | F.col("id_name")), F.lit(False)).alias("w"))
    bad = bad.select(F.when(F.col("x"), F.array(F.lit("target_leakage"))).otherwise(F.array().cast("array<string>")).alias("b4"), F.when(F.col("x"), 0.0).when(F.col("w"), 50.0).otherwise(100.0).alias("leakage_score"))
    one = t.select("b1", F.round(F.col("o") + F.col("c"), 2).alias("temporal_score")).join(i, F.lit(True)).join(g, F.lit(True)).join(bad, F.lit(True))  # one row each
    score = F.round(F.col("temporal_score") * WEIGHTS[0] + F.col("interval_score") * WEIGHTS[1] + F.col("target_score") * WEIGHTS[2] + F.col("leakage_score") * WEIGHTS[3], 2)
    blockers = F.concat("b1", "b2", "b3", "b4")
    return one.select("temporal_score", "interval_score", "target_score", "leakage_score", score.alias("overall_score"), F.array_join(blockers, ",").alias("blockers"), F.when(F.size(blockers) > 0, "not_ready").when(score >= 80, "ready").when(score >= 60, "caution").otherwise("not_ready").alias("status"))
