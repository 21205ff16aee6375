"""The whole assessment of a table: roles, all checks, personal data, scores."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtrust.operators import checks, classify, compliance, entities, pii, scoring


@dataclasses.dataclass
class Assessment:
    """Tables of one assessment; nothing but the roles (one row a column) is on the driver."""

    roles: list[dict]
    results: DataFrame
    dimensions: DataFrame
    score: DataFrame
    pii: DataFrame | None
    phi: DataFrame | None = None


def assess(df: DataFrame, as_of: str, rules: Sequence[checks.Rule] = (), keys: list[str] | None = None, references: Sequence[tuple[str, DataFrame, str]] = (), with_pii: bool = True, fuzzy: bool = True) -> Assessment:
    """references: (column, reference table, its column). as_of: the date that counts as today."""
    found = classify.classify(df)
    role = {r["column"]: r["legacy_role"] for r in found}
    by = checks.kinds(df)
    year = int(as_of[:4])
    # all tests of single rows and of the newest dates are one aggregate; the kinds of texts are known by value
    tests = checks.missing_tests(df) + checks.typed_tests(df) + checks.validity_tests(df, role, year)
    fresh = checks.freshness_rows(df, [c for c, r in role.items() if r == "date"], as_of)
    parts = [checks.counted(df, tests, [fresh]), checks.known_text_kinds(df, found), checks.skipped(df, role), checks.duplicates(df)]
    parts += [checks.duplicates(df, k) for k in classify.business_keys(df, found, keys)]
    if numeric := [c for c, r in role.items() if r == "measurement"]:
        parts.append(checks.outliers(df, numeric))
    if rules:
        parts.append(checks.run_rules(df, rules))
    words = [c for c, r in role.items() if r in ("categorical", "identifier") and by[c] == "string"]
    if words:
        parts.append(checks.consistency(df, words))
    loose = [c for c, r in role.items() if r in ("categorical", "free_text") and by[c] == "string"]
    if fuzzy and loose:
        parts.append(entities.fuzzy_check(df, loose))
    spark = df.sparkSession
    names = checks.schema_quality(spark, list(by))
    parts.append(names.select(F.lit("schema_quality").alias("check_name"), "column", F.when(F.col("issue").isNull(), "passed").otherwise("failed").alias("status"), F.col("issue").isNotNull().cast("long").alias("issues_found"), F.lit(1).cast("long").alias("total"), F.when(F.col("issue").isNull(), 1.0).otherwise(0.0).alias("quality_ratio"), F.lit("schema_quality").alias("dimension"), F.col("issue").alias("reason")))
    for column, ref, ref_column in references:
        parts.append(checks.integrity(df, column, ref, ref_column))
    types = pii.summary(df) if with_pii and "string" in by.values() else None
    phi = None
    if types is not None:
        # a row for each column and type; read several times below
        types = spark.createDataFrame(types.collect(), types.schema)
        facts = spark.createDataFrame([(r["column"], r["rows"], r["distinct"]) for r in found], "column string, rows long, distinct long")
        ages = [pii.ages_over_89(df, c).select(F.lit(c).alias("column"), "age_over_89") for c in compliance.age_columns(list(by))]
        phi = compliance.identify(types, list(by), facts, reduce(DataFrame.unionByName, ages) if ages else None)
        held = types.select("column").distinct().withColumn("pii", F.lit(True))
        columns = spark.createDataFrame([(c,) for c in by], "column string").join(F.broadcast(held), "column", "left").select("column", F.coalesce("pii", F.lit(False)).alias("pii"))
        parts.append(scoring.privacy(columns))
    results = reduce(DataFrame.unionByName, parts)
    dims = scoring.dimensions(results)
    score = scoring.composite(dims)
    if phi is None:
        return Assessment(found, results, dims, score, types)
    exposed = pii.exposure(phi).select("severity", "exposure_score")
    score = scoring.capped(score.join(exposed, F.lit(True)), F.col("severity"), F.col("exposure_score"))  # one row each
    return Assessment(found, results, dims, score, types, phi)
