"""Protected health identifiers: the registry, what columns hold of them, and the posture of a table.

Inputs are counts (a row for each column and type); no value of a cell reaches these tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtrust.operators import pii
from tabtrust.operators.checks import RESULT

#: The identifiers by number, and whether cells can show them.
IDENTIFIERS = (
    ("hipaa_01_names", True), ("hipaa_02_geo_substate", True), ("hipaa_03_dates", True), ("hipaa_04_phone", True), ("hipaa_05_fax", True), ("hipaa_06_email", True),
    ("hipaa_07_ssn", True), ("hipaa_08_medical_record", True), ("hipaa_09_health_plan_beneficiary", True), ("hipaa_10_account_number", True), ("hipaa_11_license_certificate", True), ("hipaa_12_vehicle_identifier", True),
    ("hipaa_13_device_identifier", True), ("hipaa_14_url", True), ("hipaa_15_ip_address", True), ("hipaa_16_biometric", False), ("hipaa_17_full_face_photo", False), ("hipaa_18_other_unique_id", True),
)
#: Confidence of the best pattern of a type; of all others DEFAULT.
CONFIDENCE = {"MRN": 0.65, "BENEFICIARY_ID": 0.70, "FAX": 0.80, "VIN": 0.92, "DEVICE_SERIAL": 0.85, "LICENSE_CERT": 0.90, "UNIQUE_ID": 0.95}
DEFAULT, BOOST, BOOST_BELOW, BOOST_MOST = 0.85, 0.25, 0.75, 0.99
#: Types that a column's name and its distinct values show alone, and the share of distinct values above which they do.
BY_COLUMN, BY_COLUMN_RATIO = ("MRN", "BENEFICIARY_ID", "UNIQUE_ID"), 0.9
AGE_WORDS = ("age", "patient_age", "member_age")
SCOPE = "PARTIAL_SCOPE"
FOUND = "column string, identifier string, type string, hits long, confidence double, method string"


def registry(spark: SparkSession) -> DataFrame:
    """(number, identifier, assessed) of all identifiers."""
    return spark.createDataFrame([(i + 1, name, yes) for i, (name, yes) in enumerate(IDENTIFIERS)], "number int, identifier string, assessed boolean")


def hinted(column: str) -> list[str]:
    """Types of health identifiers that a column's name asks for."""
    expected = pii.expected_types(column) or frozenset()
    return [t for t in pii.HEALTH if t in expected]


def age_columns(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if any(w in c.strip().lower().replace("_", " ") for w in AGE_WORDS)]


def _method(confidence: Column, kind: Column) -> Column:
    return F.when(confidence >= 0.85, F.when(kind.isin("NAME", "EMAIL"), "presidio").otherwise("regex")).when(confidence >= 0.55, "regex").otherwise("column_header_heuristic")


def identify(types: DataFrame, columns: Sequence[str], facts: DataFrame | None = None, ages: DataFrame | None = None) -> DataFrame:
    """FOUND rows. types: pii.summary; columns: all names; facts: (column, rows, distinct); ages: (column, age_over_89).

    A type's confidence is that of its best pattern, raised where the column's name asks for it; medical record,
    beneficiary and unique ids also count for a column by its name and its share of distinct values, if no cell showed them.
    """
    spark = types.sparkSession
    names = spark.createDataFrame([(c, t) for c in columns for t in hinted(c)], "column string, type string").withColumn("hinted", F.lit(True))
    by_type = F.create_map(*[F.lit(x) for p in pii.IDENTIFIER.items() for x in p])
    score = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CONFIDENCE.items() for x in p]), F.col("type")), F.lit(DEFAULT))
    out = types.join(F.broadcast(names), ["column", "type"], "left").withColumn("confidence", F.when(F.col("hinted") & (score < BOOST_BELOW), F.least(F.lit(BOOST_MOST), score + BOOST)).otherwise(score))
    out = out.select("column", F.try_element_at(by_type, F.col("type")).alias("identifier"), "type", "hits", F.round("confidence", 4).alias("confidence"), _method(F.col("confidence"), F.col("type")).alias("method")).where("identifier is not null and hits > 0")
    if facts is not None:
        alone = names.where(F.col("type").isin(*BY_COLUMN)).join(facts, "column").where((F.col("rows") > 0) & (F.col("distinct") > BY_COLUMN_RATIO * F.col("rows"))).join(types.select("column", "type"), ["column", "type"], "left_anti")
        out = out.unionByName(alone.select("column", F.try_element_at(by_type, F.col("type")).alias("identifier"), "type", F.col("rows").alias("hits"), F.lit(0.99).alias("confidence"), F.lit("column_header_heuristic").alias("method")))
    if ages is not None:
        out = out.unionByName(ages.where("age_over_89 > 0").select("column", F.lit("hipaa_03_dates").alias("identifier"), F.lit("AGE_OVER_89").alias("type"), F.col("age_over_89").alias("hits"), F.lit(0.9).alias("confidence"), F.lit("age_heuristic").alias("method")))
    return out


def posture(found: DataFrame) -> DataFrame:
    """One row of FOUND rows: status, scope, what was found and where, what is never assessed, and warnings of weak findings."""
    place = F.concat(F.col("identifier"), F.lit(" in column "), F.col("column"))
    weak = F.when(F.col("method") == "column_header_heuristic", F.concat(place, F.lit(": by its name only"))).when(F.col("confidence") < 0.65, F.concat(place, F.lit(": weak")))
    one = found.agg(F.array_sort(F.collect_set("identifier")).alias("i"), F.array_sort(F.collect_set("column")).alias("c"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.array_sort(F.collect_set(weak)).alias("w"))
    text = lambda x: F.array_join(x, ",")
    never = ",".join(name for name, yes in IDENTIFIERS if not yes)
    return one.select(F.when(F.col("hits") > 0, "PHI_DETECTED").otherwise("NO_PHI_DETECTED").alias("status"), F.lit(SCOPE).alias("scope"), text("i").alias("identifiers_found"), text("c").alias("columns_with_phi"), "hits", F.lit(never).alias("not_assessed"), F.array_join("w", "; ").alias("warnings"))


def check_rows(found: DataFrame) -> DataFrame:
    """FOUND rows as check results of no dimension: one of the table, and one of each column with an identifier."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    whole = found.agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("n")).select(F.lit("*").alias("column"), "n")
    rows = whole.unionByName(found.groupBy("column").agg(F.sum("hits").alias("n")))
    made = {"check_name": F.lit("hipaa_compliance"), "column": F.col("column"), "status": F.when(F.col("n") > 0, "failed").otherwise("passed"), "issues_found": F.col("n"), "total": F.lit(None).cast("long"), "quality_ratio": F.lit(None).cast("double"), "dimension": F.lit(""), "reason": F.lit(SCOPE)}
    return rows.select(*[made[n].alias(n) for n in names])
