"""Scores of check results: dimensions, the composite, ceilings for health data, reports and trends. Inputs are results, which are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtrust.functions.values import rating, readiness, severity

#: Fixed values.
WEIGHTS = {"completeness": 0.18, "validity": 0.18, "type_reliability": 0.14, "consistency": 0.14, "uniqueness": 0.09, "schema_quality": 0.09, "outlier_risk": 0.04, "freshness": 0.04, "privacy_sensitivity": 0.10}
CEILINGS = {"high": 70.0, "medium": 74.0, "low": 89.0}


def _quality() -> Column:
    return F.coalesce("quality_ratio", F.when(F.col("status") == "passed", 1.0).otherwise(0.0))


def assessed(results: DataFrame) -> DataFrame:
    return results.where("status <> 'error' and coalesce(reason, '') not like 'skipped%'")


def dimensions(results: DataFrame) -> DataFrame:
    """(dimension, checks, failed, score, severity): mean quality of assessed results, 0 to 100."""
    out = assessed(results).groupBy("dimension").agg(F.count("*").alias("checks"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg(_quality()) * 100, 2).alias("score"))
    return out.withColumn("severity", severity(F.col("failed") / F.col("checks")))


def composite(scores: DataFrame) -> DataFrame:
    """One row: the weighted mean over the dimensions that there are, what share of the weight they hold, and which are missing."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in WEIGHTS.items() for x in p]), F.col("dimension")), F.lit(0.0))
    have = F.collect_set("dimension")
    one = scores.withColumn("w", weight).agg(F.round(F.try_divide(F.sum(F.col("score") * F.col("w")), F.sum("w")), 2).alias("data_quality_score"), F.round(F.sum("w"), 2).alias("scorable_fraction"), F.array_join(F.array_except(F.array(*map(F.lit, WEIGHTS)), have), ",").alias("excluded"), F.when(F.size(F.filter(F.collect_set("dimension"), lambda d: ~d.isin(*WEIGHTS, "integrity", "accuracy"))) > 0, F.raise_error(F.lit("unknown dimension"))).alias("bad"))
    return one.drop("bad")


def capped(score: DataFrame, level: Column | str, exposure: Column | float = 0.0) -> DataFrame:
    """compliance_adjusted_score: the composite under the ceiling of a severity, or without one of the exposure (100 at 0, 70 at 100); the composite itself stays."""
    own, exposed = (F.lit(x) if isinstance(x, str | float) else x for x in (level, exposure))
    limit = F.try_element_at(F.create_map(*[F.lit(x) for p in CEILINGS.items() for x in p]), own)
    limit = F.coalesce(limit, F.when(exposed > 0, F.round(100.0 - exposed / 100.0 * (100.0 - CEILINGS["high"]), 2)))
    adjusted = F.least("data_quality_score", F.coalesce(limit, F.lit(100.0)))
    return score.withColumns({"compliance_adjusted_score": adjusted, "rating": rating(adjusted), "readiness": readiness(adjusted)})


def privacy(columns: DataFrame) -> DataFrame:
    """columns (column, pii boolean) -> one result a column, quality 0 or 1."""
    return columns.select(F.lit("privacy").alias("check_name"), "column", F.when(F.col("pii"), "failed").otherwise("passed").alias("status"), F.col("pii").cast("long").alias("issues_found"), F.lit(1).cast("long").alias("total"), F.when(F.col("pii"), 0.0).otherwise(1.0).alias("quality_ratio"), F.lit("privacy_sensitivity").alias("dimension"), F.lit(None).cast("string").alias("reason"))


def privacy_risk(columns: DataFrame) -> DataFrame:
    share = F.coalesce(F.try_divide(F.count_if("pii"), F.count("*")), F.lit(0.0))
    return columns.agg(F.count("*").alias("columns"), F.count_if("pii").alias("pii_columns"), F.when(share == 0, "none").when(share < 0.1, "low").when(share < 0.3, "medium").otherwise("high").alias("risk"))


def by_check(results: DataFrame) -> DataFrame:
    """Per check: results, failures, issues, lost quality and its severity."""
    out = results.where("status <> 'error'").groupBy("check_name").agg(F.count("*").alias("results"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("issues_found").alias("issues"), F.round(1 - F.avg(_quality()), 4).alias("impact"))
    return out.withColumn("severity", severity(F.col("impact")))


def by_column(results: DataFrame) -> DataFrame:
    """Per column: its score, worst first when ordered."""
    out = assessed(results).where("column is not null and column <> '*'").groupBy("column").agg(F.round(F.avg(_quality()) * 100, 2).alias("score"), F.count_if(F.col("status") == "failed").alias("failed"))
    return out.withColumn("rating", rating(F.col("score")))


def top_issues(results: DataFrame, most: int = 10) -> DataFrame:
    """The most severe failures: a top-k report."""
    lost = results.where("status = 'failed'").withColumn("severity", severity(1 - _quality()))
    rank = F.when(F.col("severity") == "Critical", 0).when(F.col("severity") == "High", 1).when(F.col("severity") == "Medium", 2).otherwise(3)
    return lost.orderBy(rank, F.desc("issues_found"), "check_name", "column").limit(most).select("check_name", "column", "issues_found", "severity")


def sheets(scores: DataFrame) -> DataFrame:
    """scores (sheet, score, rows, columns) -> mean score, summed rows, most columns."""
    return scores.agg(F.round(F.avg("score"), 2).alias("score"), F.sum("rows").alias("rows"), F.max("columns").alias("columns"), F.count("*").alias("sheets"))


def trend(runs: DataFrame) -> DataFrame:
    """runs (client, file, completed_at, score, status): completed ones, with the change against the previous one of the same file, and its direction."""
    w = Window.partitionBy("client", "file").orderBy("completed_at")
    change = F.round(F.col("score") - F.lag("score").over(w), 2)
    return runs.where("status = 'completed'").withColumn("change", change).withColumn("direction", F.when(F.col("change").isNull(), "first").when(F.col("change") > 0.05, "up").when(F.col("change") < -0.05, "down").otherwise("flat"))


def with_manifests(runs: DataFrame, manifests: DataFrame) -> DataFrame:
    """runs (run_id, ..) with has_compliance: whether any sheet of the run's manifest (run_id, sheets of compliance_report paths) has one."""
    have = manifests.groupBy("run_id").agg(F.bool_or(F.exists("sheets", lambda p: p.isNotNull() & (p != ""))).alias("has_compliance"))
    return runs.join(have, "run_id", "left").withColumn("has_compliance", F.coalesce("has_compliance", F.lit(False)))


def sheet_dimensions(scores: DataFrame) -> DataFrame:
    """scores (sheet, dimension, score; null where it wasn't available) -> (dimension, score, sheets): the mean over the sheets that have it."""
    return scores.groupBy("dimension").agg(F.round(F.avg("score"), 2).alias("score"), F.count("score").alias("sheets"))


def role_counts(classes: DataFrame) -> DataFrame:
    """classes (column, role) -> (role, columns)."""
    return classes.groupBy("role").agg(F.count("*").alias("columns"))


def client_stats(runs: DataFrame) -> DataFrame:
    """runs (client, status, score): totals and mean score of completed runs."""
    done = F.col("status") == "completed"
    return runs.groupBy("client").agg(F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg(F.when(done, F.col("score"))), 2).alias("avg_score"))
