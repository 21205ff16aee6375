"""The registered queries of the table operators and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtrust.functions import values
from tabtrust.operators import checks, classify, compliance, entities, forecast, pii, scoring
from tabtrust.plans import pipeline
from tabtrust.sources import tables
from tabtrust.streaming import profile as streams

AS_OF = "2001-01-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_sql(check: str, column: str, issues: str, total: str, dimension: str, source: str, reason: str = "CAST(NULL AS VARCHAR)") -> str:
    return f"""SELECT '{check}' AS check_name, '{column}' AS "column", CASE WHEN i > 0 THEN 'failed' ELSE 'passed' END AS status, i AS issues_found, t AS total,
      CASE WHEN t > 0 THEN round(1.0::DOUBLE - i::DOUBLE / t, 6) ELSE 1.0::DOUBLE END AS quality_ratio, '{dimension}' AS dimension, {reason} AS reason
      FROM (SELECT CAST({issues} AS BIGINT) AS i, CAST({total} AS BIGINT) AS t FROM {source})"""


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def severity_sql(x: str) -> str:
    return f"CASE WHEN {x} >= 0.5 THEN 'Critical' WHEN {x} >= 0.2 THEN 'High' WHEN {x} >= 0.05 THEN 'Medium' WHEN {x} > 0 THEN 'Low' ELSE 'None' END"


ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
PRICES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
MISSING_ORDERS = union([row_sql("missing_values", c, f'count(*) FILTER ("{c}" IS NULL)', "count(*)", "completeness", "orders") for c in ORDERS])


@query("flt1_missing", union([row_sql("missing_values", c, f'count(*) FILTER ("{c}" IS NULL)', "count(*)", "completeness", "documents") for c in DOCUMENTS]))
def _(spark, d):
    return checks.missing(read(spark, d, "documents"))


@query("flt2_non_negative", row_sql("non_negative", "Order Qty", "count(*) FILTER (l_quantity - 3 < 0)", "count(l_quantity)", "validity", "lineitem"))
def _(spark, d):
    return checks.validity(read(spark, d, "lineitem").select((F.col("l_quantity") - 3).alias("Order Qty")), {"Order Qty": "measurement"})


@query("flt3_suspicious_zero", row_sql("suspicious_zero", "Standard Cost", "count(*) FILTER (l_discount = 0)", "count(l_discount)", "validity", "lineitem"))
def _(spark, d):
    return checks.validity(read(spark, d, "lineitem").select(F.col("l_discount").alias("Standard Cost")), {"Standard Cost": "measurement"})


@query("flt4_date_validity", row_sql("date_validity", "Order Date", "count(*) FILTER (year(o_orderdate) < 1990 OR year(o_orderdate) > 1996)", "count(o_orderdate)", "validity", "orders"))
def _(spark, d):
    return checks.validity(read(spark, d, "orders").select(F.col("o_orderdate").alias("Order Date")), {"Order Date": "date"}, as_of_year=1995)


@query("flt5_email", row_sql("email_format", "Contact Email", "count(*) FILTER (c_custkey % 7 = 0)", "count(*)", "validity", "customer"))
def _(spark, d):
    return checks.validity(read(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit("#mail"))).otherwise(F.concat(F.lit("c."), F.col("c_custkey").cast("string"), F.lit("@mail.com"))).alias("Contact Email")), {})


@query("flt6_cross_column_dates", row_sql("cross_column_dates", "Ship Date >= Order Date", "count(*) FILTER (l_shipdate < o_orderdate)", "count(*)", "validity", "lineitem JOIN orders ON l_orderkey = o_orderkey"))
def _(spark, d):
    both = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return checks.validity(both.select(F.col("l_shipdate").alias("Ship Date"), F.col("o_orderdate").alias("Order Date")), {})


RULES = [
    checks.Rule("status_required", "required", ("o_orderstatus",)),
    checks.Rule("price_numeric", "datatype", ("o_totalprice",), "numeric"),
    checks.Rule("price_integer", "datatype", ("o_totalprice",), "integer"),
    checks.Rule("price_range", "min_max", ("O_TOTALPRICE ",), low=1000.0, high=200000.0),
    checks.Rule("priority_form", "regex", ("o_orderpriority",), "^[1-3]-"),
    checks.Rule("status_allowed", "allowed_values", ("o_orderstatus",), values=("f", "O")),
    checks.Rule("key_above_customer", "cross_column", ("o_orderkey", "o_custkey"), op=">="),
    checks.Rule("customer_unique", "unique", ("o_custkey", "o_orderdate")),
    checks.Rule("off", "required", ("o_orderkey",), enabled=False),
]


@query(
    "rul_business_rules",
    union(
        [row_sql("business_rule", f"{n}", i, "count(*)", "validity", "orders") for n, i in (
            ("status_required:o_orderstatus", "count(*) FILTER (o_orderstatus IS NULL OR trim(o_orderstatus) = '')"),
            ("price_numeric:o_totalprice", "count(*) FILTER (o_totalprice IS NULL)"),
            ("price_integer:o_totalprice", "count(*) FILTER (o_totalprice % 1 <> 0)"),
            ("price_range:o_totalprice", "count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 200000)"),
            ("priority_form:o_orderpriority", "count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-3]-'))"),
            ("status_allowed:o_orderstatus", "count(*) FILTER (lower(trim(o_orderstatus)) NOT IN ('f', 'o'))"),
            ("key_above_customer:o_orderkey+o_custkey", "count(*) FILTER (o_orderkey < o_custkey)"),
        )]
        + [row_sql("business_rule", "customer_unique:o_custkey+o_orderdate", "coalesce(sum(n - 1), 0)", "coalesce(sum(n), 0)", "uniqueness", "(SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate)")]
    ),
)
def _(spark, d):
    return checks.run_rules(read(spark, d, "orders"), RULES)


def _some_customers(spark, d):
    return read(spark, d, "customer").where("c_custkey % 10 <> 0")


@query("jn1_integrity", row_sql("referential_integrity", "o_custkey", "count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0))", "count(o_custkey)", "integrity", "orders"))
def _(spark, d):
    return checks.integrity(read(spark, d, "orders"), "o_custkey", _some_customers(spark, d), "c_custkey")


@query("jn1_orphans", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)")
def _(spark, d):
    return checks.orphans(read(spark, d, "orders"), "o_custkey", _some_customers(spark, d), "c_custkey").select("o_orderkey", "o_custkey")


@query("jn2_value_shape", "SELECT CASE WHEN avg(CASE WHEN contains(p_brand, ' ') AND length(p_brand) > 5 THEN 1 ELSE 0 END) >= 0.5 THEN 'name' WHEN avg(CASE WHEN regexp_matches(p_brand, '^[A-Za-z0-9_./-]{1,20}$') THEN 1 ELSE 0 END) >= 0.5 THEN 'code' ELSE 'unknown' END AS shape FROM part")
def _(spark, d):
    return checks.value_shape(read(spark, d, "part"), "p_brand")


@query("jn4_apply_mapping", "SELECT c_custkey, coalesce(t, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN (VALUES ('BUILDING', 'Construction'), ('MACHINERY', 'Machines')) m(f, t) ON c_mktsegment = f")
def _(spark, d):
    found = spark.createDataFrame([("c_mktsegment", "BUILDING", "Construction"), ("c_mktsegment", "MACHINERY", "Machines"), ("other", "BUILDING", "no")], "column string, original string, canonical string")
    return entities.standardize(read(spark, d, "customer"), "c_mktsegment", found).select("c_custkey", "c_mktsegment")


def profile_sql(table: str, names: tuple[str, ...]) -> str:
    return union([f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS non_null, count(v) AS "distinct",
      round(coalesce(count(v)::DOUBLE / nullif(sum(n) FILTER (v IS NOT NULL), 0), 0), 4) AS ratio, CAST(coalesce(max(n) FILTER (v IS NOT NULL), 0) AS BIGINT) AS top_n,
      round(coalesce((max(n) FILTER (v IS NOT NULL))::DOUBLE / nullif(sum(n) FILTER (v IS NOT NULL), 0), 0), 4) AS top_ratio FROM (SELECT "{c}" AS v, count(*) AS n FROM {table} GROUP BY 1)""" for c in names])  # fmt: skip


@query("ag1_profile", profile_sql("orders", ORDERS))
def _(spark, d):
    return classify.profile(read(spark, d, "orders"))


@query("ag1_profile_lineitem", profile_sql("lineitem", ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *PRICES, "l_returnflag", "l_linestatus", "l_shipdate")))
def _(spark, d):
    return classify.profile(read(spark, d, "lineitem"))


def _mixed(spark, d):
    return read(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, F.lit("n/k")).when(F.col("c_custkey") % 11 == 0, F.lit("  ")).otherwise(F.concat(F.lit("1,"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"))).alias("code"))


MIXED = "(SELECT CASE WHEN c_custkey % 5 = 0 THEN 'string' WHEN c_custkey % 11 = 0 THEN 'null' ELSE 'number' END AS kind FROM customer)"


@query("ag3_type_kinds", f"SELECT kind, count(*) AS n FROM {MIXED} GROUP BY kind")
def _(spark, d):
    return checks.type_kinds(_mixed(spark, d), "code")


@query("ag3_type_mismatch", row_sql("type_mismatch", "code", "count(*) FILTER (kind = 'string')", "count(*) FILTER (kind <> 'null')", "type_reliability", MIXED))
def _(spark, d):
    return checks.type_mismatch(_mixed(spark, d))


@query("ag4_duplicate_rows", row_sql("duplicate_rows", "*", "sum(n - 1)", "sum(n)", "uniqueness", "(SELECT count(*) AS n FROM events GROUP BY user_id, event_type)", "'rows in groups: ' || (SELECT CAST(sum(n) AS BIGINT) FROM (SELECT count(*) AS n FROM events GROUP BY user_id, event_type) WHERE n > 1)"))
def _(spark, d):
    return checks.duplicates(read(spark, d, "events").select("user_id", "event_type"))


@query("ag5_duplicate_groups", "SELECT l_orderkey AS k0, l_linenumber AS k1, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, d):
    return checks.duplicate_groups(read(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("win_repeats_after_first", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders) WHERE k > 1")
def _(spark, d):
    return checks.duplicate_rows(read(spark, d, "orders"), ["o_custkey"], "o_orderkey").select("o_orderkey", "o_custkey")


@query("win_all_of_group", "SELECT o_orderkey, o_custkey FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderstatus) AS k FROM orders) WHERE k > 1")
def _(spark, d):
    return checks.duplicate_rows(read(spark, d, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey", first=False).select("o_orderkey", "o_custkey")


FENCES = "(SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, count({c}) AS n FROM lineitem)"
OUTLIERS = union([row_sql("outliers_iqr", c, f"count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))", f"count({c})", "outlier_risk", f"lineitem, {FENCES.format(c=c)}") for c in PRICES])


@query("ag10_fences", union([f"""SELECT '{c}' AS "column", n, q1, q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM {FENCES.format(c=c)}""" for c in PRICES]))
def _(spark, d):
    return checks.fences(read(spark, d, "lineitem"), PRICES)


@query("ag10_outliers", OUTLIERS)
def _(spark, d):
    return checks.outliers(read(spark, d, "lineitem"), PRICES)


@query("ag11_dominant", """SELECT 'l_discount' AS "column", v AS value, n, round(n / t, 4) AS share FROM (SELECT l_discount AS v, count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem GROUP BY 1 ORDER BY n DESC, v LIMIT 1) WHERE n / t > 0.05""")
def _(spark, d):
    return checks.dominant(read(spark, d, "lineitem"), ["l_discount", "l_extendedprice"], share=0.05)


NEAR = "(SELECT v, r, list_sort(list(abs(v - w)))[6] AS score FROM (SELECT c_acctbal AS v, count(*) AS r FROM customer GROUP BY 1) CROSS JOIN (SELECT c_acctbal AS w FROM customer) GROUP BY v, r)"


@query("ag12_knn_outliers", f"SELECT v AS value, r AS rows, score, score > (SELECT quantile_cont(score, 0.95) FROM {NEAR} n JOIN customer ON c_acctbal = n.v) AS outlier FROM {NEAR}")
def _(spark, d):
    return checks.knn_outliers(read(spark, d, "customer"), "c_acctbal")


def _spelled(spark, d):
    seg = F.col("c_mktsegment")
    return read(spark, d, "customer").select(F.when(F.col("c_custkey") % 5 == 0, F.lower(seg)).when(F.col("c_custkey") % 7 == 0, F.concat(F.lit(" "), seg, F.lit("  "))).otherwise(seg).alias("segment"))


SPELLED = "(SELECT CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 7 = 0 THEN ' ' || c_mktsegment || '  ' ELSE c_mktsegment END AS raw FROM customer)"
NORM = "lower(trim(regexp_replace(raw, '\\s+', ' ', 'g')))"


@query("ag14_consistency", row_sql("consistency", "segment", "sum(r - b)", "sum(r)", "consistency", f"(SELECT sum(n) AS r, max(n) AS b FROM (SELECT {NORM} AS norm, raw, count(*) AS n FROM {SPELLED} GROUP BY 1, 2) GROUP BY norm)"))
def _(spark, d):
    return checks.consistency(_spelled(spark, d), ["segment"])


@query("ag14_canonical", f"WITH r AS (SELECT {NORM} AS norm, raw, count(*) AS n FROM {SPELLED} GROUP BY 1, 2), b AS (SELECT *, first_value(raw) OVER (PARTITION BY norm ORDER BY n DESC, length(raw), raw DESC) AS canonical FROM r) SELECT raw, canonical, n FROM b WHERE raw <> canonical")
def _(spark, d):
    return checks.canonical_spellings(_spelled(spark, d), "segment")


@query("ag15_freshness", f"""SELECT 'o_orderdate' AS "column", CAST(min(o_orderdate) AS DATE) AS first, CAST(max(o_orderdate) AS DATE) AS last, CAST(DATE '{AS_OF}' - CAST(max(o_orderdate) AS DATE) AS BIGINT) AS days_since, count(o_orderdate) AS n, CASE WHEN DATE '{AS_OF}' - CAST(max(o_orderdate) AS DATE) > 90 THEN 'failed' ELSE 'passed' END AS status FROM orders""")
def _(spark, d):
    return checks.freshness(read(spark, d, "orders"), "o_orderdate", AS_OF)


@query("ag16_schema_quality", """SELECT CAST(p AS BIGINT) AS position, c AS "column", i AS issue FROM (VALUES (0, 'Customer No.', NULL), (1, 'Unnamed: 3', 'generated'), (2, 'Field_2', 'vague'), (3, 'x', 'single_letter'), (4, ' ', 'blank'), (5, 'customer no. ', 'duplicate'), (6, 'SKU', NULL)) v(p, c, i)""")
def _(spark, d):
    return checks.schema_quality(spark, ["Customer No.", "Unnamed: 3", "Field_2", "x", " ", "customer no. ", "SKU"])


@query("tk3_frequent_values", """SELECT 'p_type' AS "column", value, n, CAST(row_number() OVER (ORDER BY n DESC, value) AS INTEGER) AS place FROM (SELECT p_type AS value, count(*) AS n FROM part GROUP BY 1) QUALIFY row_number() OVER (ORDER BY n DESC, value) <= 20""")
def _(spark, d):
    return entities.frequent_values(read(spark, d, "part"), ["p_type"], 20)


@query("prj1_scope", "SELECT k - 100 AS _rid, o_orderkey, o_custkey FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k, * FROM orders) WHERE k >= 100 AND k < 400")
def _(spark, d):
    rows = tables.numbered(read(spark, d, "orders").withColumn("_rid", F.col("o_orderkey")), "_rid")
    return checks.scope(rows, 100, 400, ["o_orderkey", "o_custkey"])


@query("tk1_sample_ids", "SELECT o_orderkey AS _rid FROM orders WHERE o_totalprice > 150000 ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    return checks.sample_ids(read(spark, d, "orders").withColumn("_rid", F.col("o_orderkey")), F.col("o_totalprice") > 150000)


@query("set_upsert", "SELECT original, canonical FROM (SELECT CAST(n_nationkey AS VARCHAR) AS original, n_name AS canonical FROM nation WHERE n_nationkey NOT BETWEEN 5 AND 9 UNION ALL SELECT CAST(n_nationkey AS VARCHAR), lower(n_name) FROM nation WHERE n_nationkey BETWEEN 5 AND 9)")
def _(spark, d):
    old = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("original"), F.col("n_name").alias("canonical"))
    return entities.upsert(old, old.where(F.col("original").cast("int").between(5, 9)).withColumn("canonical", F.lower("canonical")))


def classes_sql(table: str, roles: dict[str, tuple[str, str, bool, bool]]) -> str:
    """column -> (role, legacy role, is double, has a descriptive name); the numbers are computed by the rules of evidence."""
    parts = []
    for c, (role, legacy, double, described) in roles.items():
        plain, named = legacy in ("measurement", "categorical", "free_text"), legacy == "identifier"
        parts.append(f"""SELECT p.*, '{role}' AS role, '{legacy}' AS legacy_role,
  greatest(0.0, least(1.0, round(CAST({-0.4 if described else 0.0} + {-0.3 if plain else 0.2 if named else 0.0} + CASE WHEN d >= 0.98 THEN 0.35 WHEN d >= 0.9 THEN 0.2 WHEN d >= 0.7 THEN 0.1 WHEN d < 0.5 THEN -0.2 ELSE 0 END
    - CASE WHEN non_null >= 20 AND t >= 0.05 THEN 0.3 ELSE 0 END - {0.2 if double else 0.0} - CASE WHEN "distinct" <= 10 AND non_null > 20 THEN 0.3 ELSE 0 END AS DOUBLE), 3))) AS uniqueness_confidence,
  greatest(0.0, round(CAST(CASE WHEN d >= 0.98 THEN 0.5 WHEN d >= 0.9 THEN 0.3 WHEN d >= 0.7 THEN 0.1 ELSE 0 END + {-0.2 if plain else 0.25 if named else 0.0} - CASE WHEN non_null >= 20 AND t >= 0.05 THEN 0.35 ELSE 0 END AS DOUBLE), 4)) AS evidence,
  false AS expected_unique, '{'high' if named else 'medium' if legacy in ('measurement', 'date') else 'low'}' AS importance, 'low' AS sensitivity
  FROM ({profile_sql(table, (c,))}) p, (SELECT count(DISTINCT {c})::DOUBLE / count({c}) AS d, (SELECT max(n) FROM (SELECT count(*) AS n FROM {table} GROUP BY {c}))::DOUBLE / count({c}) AS t FROM {table})""")
    return union(parts)


MEASURE, PRICE, CATEGORY, DATE = ("measurement", "measurement", False, False), ("financial", "measurement", True, False), ("category", "categorical", False, False), ("date", "date", False, False)


@query("cl1_classes", classes_sql("orders", {"o_orderkey": MEASURE, "o_custkey": MEASURE, "o_orderstatus": (*CATEGORY[:3], True), "o_totalprice": PRICE, "o_orderdate": DATE, "o_orderpriority": CATEGORY}))
def _(spark, d):
    return classify.classes(read(spark, d, "orders"))


LINE_CLASSES = {
    **dict.fromkeys(("l_orderkey", "l_partkey", "l_suppkey"), MEASURE), "l_linenumber": ("identifier", "identifier", False, False), "l_quantity": (*MEASURE[:2], True, False), "l_extendedprice": PRICE,
    "l_discount": PRICE, "l_tax": PRICE, "l_returnflag": CATEGORY, "l_linestatus": (*CATEGORY[:3], True), "l_shipdate": DATE,
}


@query("cl1_classes_lineitem", classes_sql("lineitem", LINE_CLASSES))
def _(spark, d):
    return classify.classes(read(spark, d, "lineitem"))


@query("ag7_business_keys", "SELECT CASE WHEN (count(*) - count(DISTINCT l_orderkey))::DOUBLE / count(*) >= 0.2 THEN 'Order Number+Line No' ELSE 'Order Number' END AS k FROM lineitem")
def _(spark, d):
    lines = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("Order Number"), F.col("l_linenumber").alias("Line No"), "l_quantity")
    return spark.createDataFrame([("+".join(k),) for k in classify.business_keys(lines)], "k string")


CARD = "lpad(CAST(o_orderkey * 7919 + o_custkey AS VARCHAR), 16, '4')"


@query("sc10_luhn", f"""SELECT o_orderkey FROM (SELECT o_orderkey, list_sum(list_transform(range(0, 16), lambda i: CASE WHEN i % 2 = 0 THEN CASE WHEN CAST(c[i + 1] AS INTEGER) > 4 THEN CAST(c[i + 1] AS INTEGER) * 2 - 9 ELSE CAST(c[i + 1] AS INTEGER) * 2 END ELSE CAST(c[i + 1] AS INTEGER) END)) AS s FROM (SELECT o_orderkey, {CARD} AS c FROM orders)) WHERE s % 10 = 0""")
def _(spark, d):
    card = F.lpad((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"), 16, "4")
    return read(spark, d, "orders").where(values.luhn(card)).select("o_orderkey")


@query("sc8_similarity", "SELECT n_name AS a, n_name || ' ' || r_name AS b, round(200.0::DOUBLE * length(n_name) / (2 * length(n_name) + 1 + length(r_name)), 4) AS ratio FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(spark, d):
    both = read(spark, d, "nation").join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return both.select(F.col("n_name").alias("a"), F.concat("n_name", F.lit(" "), "r_name").alias("b")).select("a", "b", F.round(values.ratio_sql("a", "b"), 4).alias("ratio"))


@query("sc6_normalize", "SELECT p_partkey, lower(trim(regexp_replace('  ' || p_name || '   ' || p_type, '\\s+', ' ', 'g'))) AS norm FROM part")
def _(spark, d):
    return read(spark, d, "part").select("p_partkey", values.normal(F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type")).alias("norm"))


@query("sc1_numbers", "SELECT count(*) FILTER (kind = 'number') AS loose FROM " + MIXED)
def _(spark, d):
    return _mixed(spark, d).agg(F.count(values.loose_number(F.col("code"))).alias("loose"))


@query("sc3_moments", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def _(spark, d):
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "M/d/yyyy"))
    return read(spark, d, "orders").select("o_orderkey", values.moment(text).cast("date").alias("day"))


MOJIBAKE = "CASE k % 4 WHEN 0 THEN {0} || n WHEN 1 THEN {1} || n WHEN 2 THEN {2} || n ELSE n END"
BROKEN = ("cafÃ© ", "â€œquoteâ€\x9d ", "naÃ¯ve Ã¼ber ")


@query("sc16_repaired", "SELECT k AS c_custkey, " + MOJIBAKE.format("'café '", "'“quote” '", "'naïve über '") + " AS text FROM (SELECT c_custkey AS k, c_name AS n FROM customer)")
def _(spark, d):
    k = F.col("c_custkey") % 4
    text = F.when(k == 3, F.col("c_name"))
    for i, broken in enumerate(BROKEN):
        text = text.when(k == i, F.concat(F.lit(broken), "c_name"))
    return read(spark, d, "customer").select("c_custkey", values.repaired(text).alias("text"))


#: Cells with one finding each, by the key's remainder: (type, text, the same masked); {k} is the key.
CELLS = (
    ("EMAIL", "mail c{k}@mail.com now", "mail c***@mail.com now"),
    ("SSN", "ssn 123-45-6789 end", "ssn [SSN] end"),
    ("IP_ADDRESS", "host 10.20.30.40 up", "host x.x.x.40 up"),
    ("URL", "see https://a.example.org/x ok", "see [URL] ok"),
    ("CARD", "card 4111 1111 1111 1111 ok", "card **** **** **** 1111 ok"),
    ("IBAN", "iban GB29NWBK60161331926819 x", "iban GB****************6819 x"),
    (None, "nothing to see here", "nothing to see here"),
    ("PHONE", "call +44 20 7946 0958 now", "call +** ** **** 0958 now"),
    ("MOBILE", "ring 0300-1234567 today", "ring ****-***4567 today"),
    ("CNIC", "id 35202-1234567-1 here", "id *****-*******-1 here"),
)


def _cells(spark, d):
    k = F.col("c_custkey")
    text = F.lit(None).cast("string")
    for i, (_, cell, _) in enumerate(CELLS):
        text = F.when(k % len(CELLS) == i, F.replace(F.lit(cell), F.lit("{k}"), k.cast("string"))).otherwise(text)
    return read(spark, d, "customer").select("c_custkey", text.alias("notes"), "c_mktsegment", "c_acctbal")


def cell_sql(part: int) -> str:
    return f"CASE c_custkey % {len(CELLS)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if c[part] is None else f"replace('{c[part]}', '{{k}}', CAST(c_custkey AS VARCHAR))") for i, c in enumerate(CELLS)) + " END"


TYPED = f"(SELECT c_custkey, {cell_sql(0)} AS type, {cell_sql(1)} AS notes, {cell_sql(2)} AS masked FROM customer)"


@query("pii1_typed_cells", f"SELECT c_custkey, type FROM {TYPED} WHERE type IS NOT NULL")
def _(spark, d):
    return pii.findings(_cells(spark, d), ["notes"], key="c_custkey").select(F.col("key").alias("c_custkey"), F.explode("spans.type").alias("type"))


@query("pii3_typed_summary", f"""SELECT 'notes' AS "column", type, count(*) AS hits, CAST(sum(count(*)) OVER () AS BIGINT) AS rows_with_pii FROM {TYPED} WHERE type IS NOT NULL GROUP BY type""")
def _(spark, d):
    return pii.summary(_cells(spark, d))


@query("msk1_typed_cells", f"SELECT c_custkey, masked FROM {TYPED} WHERE type IS NOT NULL")
def _(spark, d):
    return pii.findings(_cells(spark, d), ["notes"], key="c_custkey").select(F.col("key").alias("c_custkey"), "masked")


@query("ag29_masked_frame", f"SELECT c_custkey, masked AS notes, c_mktsegment, c_acctbal FROM {TYPED} JOIN customer USING (c_custkey)")
def _(spark, d):
    return pii.masked_frame(_cells(spark, d))


@query("pii3_code_column", "SELECT CAST(0 AS BIGINT) AS hits, count(*) FILTER (c_custkey % 1000 = 7) > 0 AS other FROM customer")
def _(spark, d):
    """Order numbers that hold the digits of a phone are codes, as long as nearly all cells are."""
    k = F.col("c_custkey")
    codes = read(spark, d, "customer").select(F.concat(F.lit("SON-0300"), F.lpad(k.cast("string"), 7, "1")).alias("reference"), F.when(k % 1000 == 7, "0300-1234567").otherwise("n/a").alias("remark"))
    found = pii.summary(codes)
    return found.agg(F.count_if(F.col("column") == "reference").alias("hits"), (F.count_if(F.col("column") == "remark") > 0).alias("other"))


@query("pii6_display", """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'c***@mail.com' WHEN 1 THEN repeat('*', 10) || right('0300' || lpad(CAST(c_custkey AS VARCHAR), 8, '5'), 2) WHEN 2 THEN c_name ELSE 'x' END AS shown FROM (SELECT c_custkey, c_mktsegment AS c_name FROM customer)""")
def _(spark, d):
    k = F.col("c_custkey")
    text = F.when(k % 4 == 0, F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.com"))).when(k % 4 == 1, F.concat(F.lit("0300"), F.lpad(k.cast("string"), 8, "5"))).when(k % 4 == 2, F.col("c_mktsegment")).otherwise("x")
    return read(spark, d, "customer").select("c_custkey", pii.display(text).alias("shown"))


@query("pii3_summary")
def _(spark, d):
    return pii.summary(read(spark, d, "documents"), ["text"])


@query("msk1_masked_cells")
def _(spark, d):
    return pii.findings(read(spark, d, "documents"), ["text"], key="doc_id").select("column", "key", F.size("spans").alias("n_spans"), F.md5("masked").alias("masked_md5"))


@query("hp7_exposure")
def _(spark, d):
    return pii.exposure(pii.identifiers(pii.summary(read(spark, d, "documents"), ["text"])))


@query("hp3_ages_over_89", "SELECT count(*) FILTER (p_size * 2 >= 90) AS age_over_89 FROM part")
def _(spark, d):
    return pii.ages_over_89(read(spark, d, "part").select((F.col("p_size") * 2).alias("patient_age")), "patient_age")


def _plurals(spark, d):
    seg = F.col("c_mktsegment")
    return read(spark, d, "customer").select(F.when(F.col("c_custkey") % 7 == 0, F.concat(seg, F.lit("S"))).otherwise(seg).alias("segment"))


PLURALS = "(SELECT CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment || 'S' ELSE c_mktsegment END AS raw, c_mktsegment AS seg FROM customer)"


@query("std1_fuzzy_mapping", f"""SELECT 'segment' AS "column", raw AS original, seg AS canonical, count(*) AS n FROM {PLURALS} GROUP BY 2, 3""")
def _(spark, d):
    """One letter more is a similarity of 94 and above, so a plural joins its more frequent singular."""
    return entities.mapping(_plurals(spark, d), ["segment"])


@query("std4_fuzzy_rows", row_sql("fuzzy_standardization", "segment", "count(*) FILTER (raw <> seg)", "count(*)", "consistency", PLURALS))
def _(spark, d):
    return entities.fuzzy_check(_plurals(spark, d), ["segment"])


@query("std1_mapping", f"""SELECT 'segment' AS "column", raw AS original, CASE WHEN raw = trim(lower(raw)) THEN upper(raw) ELSE raw END AS canonical, count(*) AS n FROM {SPELLED} GROUP BY 2, 3""")
def _(spark, d):
    return entities.mapping(_spelled(spark, d), ["segment"])


@query("std4_fuzzy_check", row_sql("fuzzy_standardization", "segment", "count(*) FILTER (raw = trim(lower(raw)))", "count(*)", "consistency", SPELLED))
def _(spark, d):
    return entities.fuzzy_check(_spelled(spark, d), ["segment"])


def _names(spark, d):
    nation = read(spark, d, "nation")
    return nation.select(F.col("n_name").alias("name"), F.col("n_name").alias("canonical")).unionByName(nation.select(F.concat(F.lit("X"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("canonical")))


def _cities(spark, d):
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 0, F.col("n_name")).when(k % 4 == 1, F.concat(F.lower("n_name"), F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("X"), k.cast("string"))).otherwise(F.concat("n_name", F.lit("s")))
    return entities.values(read(spark, d, "nation").select(name.alias("city")), "city")


@query("er1_lookup", "SELECT CASE k % 4 WHEN 0 THEN n WHEN 1 THEN lower(n) WHEN 2 THEN 'X' || k ELSE n || 's' END AS value, CAST(1 AS BIGINT) AS n, CASE WHEN k % 4 < 3 THEN n END AS canonical, CASE k % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.99::DOUBLE WHEN 2 THEN 1.0::DOUBLE END AS confidence FROM (SELECT n_nationkey AS k, n_name AS n FROM nation)")
def _(spark, d):
    return entities.lookup(_cities(spark, d), _names(spark, d))


@query("er4_cascade", "SELECT CASE k % 4 WHEN 0 THEN n WHEN 1 THEN lower(n) WHEN 2 THEN 'X' || k ELSE n || 's' END AS value, CAST(1 AS BIGINT) AS n, n AS canonical, CASE WHEN k % 4 = 3 THEN 2 ELSE 1 END AS tier, CASE k % 4 WHEN 1 THEN 0.99::DOUBLE WHEN 3 THEN round(2.0::DOUBLE * length(n) / (2 * length(n) + 1), 4) ELSE 1.0::DOUBLE END AS similarity, 'auto' AS decision FROM (SELECT n_nationkey AS k, n_name AS n FROM nation)")
def _(spark, d):
    return entities.resolve(_cities(spark, d), _names(spark, d))


@query("er3_vectors", """WITH c AS (SELECT 'n' || vec_id AS name, embedding AS e FROM embeddings WHERE vec_id < 5), m AS (SELECT v.vec_id AS id, c.name, round(list_dot_product(v.embedding::DOUBLE[], c.e::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(c.e::DOUBLE[], c.e::DOUBLE[]))), 6) AS similarity FROM embeddings v, c)
SELECT id, name, similarity, CASE WHEN similarity >= 0.78 THEN 'auto' WHEN similarity >= 0.70 THEN 'review' ELSE 'no_match' END AS decision FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, name DESC) = 1""")
def _(spark, d):
    v = read(spark, d, "embeddings")
    listed = v.where("vec_id < 5").select(F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("vector"))
    return entities.resolve_vectors(v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), listed)


DAYS = "(SELECT d, n, CAST(d - lag(d) OVER (ORDER BY d) AS INTEGER) AS gap FROM (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1))"
FREQ = "CASE WHEN median(gap) <= 1.5 THEN 'daily' WHEN median(gap) BETWEEN 5 AND 9 THEN 'weekly' WHEN median(gap) BETWEEN 25 AND 35 THEN 'monthly' WHEN median(gap) BETWEEN 80 AND 100 THEN 'quarterly' WHEN median(gap) BETWEEN 350 AND 380 THEN 'yearly' ELSE 'irregular' END"


@query("rd1_temporal", f"SELECT CAST(sum(n) AS BIGINT) AS observations, min(d) AS first, max(d) AS last, CAST(max(d) - min(d) AS BIGINT) AS range_days, CAST(floor((max(d) - min(d)) / 365) AS BIGINT) AS cycles, {FREQ} AS frequency, '' AS blockers FROM {DAYS}")
def _(spark, d):
    return forecast.temporal(read(spark, d, "orders"), "o_orderdate").withColumn("blockers", F.array_join("blockers", ","))


@query("rd2_intervals", f"SELECT count(*) AS actual, CAST(max(d) - min(d) + 1 AS BIGINT) AS expected, CAST(sum(n) - count(*) AS BIGINT) AS duplicates, CAST(max(gap) AS BIGINT) AS max_gap_days, {FREQ} AS frequency, round(greatest(0.0, count(*)::DOUBLE / (max(d) - min(d) + 1) - (sum(n) - count(*))::DOUBLE / sum(n)), 4) AS regularity, CASE WHEN sum(n) > count(*) THEN 'duplicate_dates' ELSE '' END AS blockers FROM {DAYS}")
def _(spark, d):
    return forecast.intervals(read(spark, d, "orders"), "o_orderdate").withColumn("blockers", F.array_join("blockers", ","))


@query("rd3_target", f"""SELECT count(*) AS rows, round(100.0 * count(*) FILTER (l_discount IS NULL) / count(*), 2)::DOUBLE AS null_pct, round(100.0 * count(*) FILTER (l_discount = 0) / count(l_discount), 2)::DOUBLE AS zero_pct, CAST(0 AS BIGINT) AS infinite,
round(100.0 * count(*) FILTER (l_discount < q1 - 1.5 * (q3 - q1) OR l_discount > q3 + 1.5 * (q3 - q1)) / count(l_discount), 2)::DOUBLE AS outlier_pct, min(l_discount) AS low, max(l_discount) AS high, round(var_samp(l_discount), 8) AS variance, 100.0::DOUBLE AS numeric_pct, '' AS blockers FROM lineitem, {FENCES.format(c="l_discount").replace("count(l_discount) AS n", "1 AS n")}""")
def _(spark, d):
    return forecast.target(read(spark, d, "lineitem"), "l_discount").withColumns({"blockers": F.array_join("blockers", ","), "variance": F.round("variance", 8)})


@query("rd4_leakage", union([f"""SELECT '{c}' AS feature, round(corr({x}, l_extendedprice), 6) AS correlation, abs(corr({x}, l_extendedprice)) > 0.99 AS leaks, round(count(DISTINCT {x})::DOUBLE / count({x}), 4) AS ratio, count(DISTINCT {x})::DOUBLE / count({x}) > 0.95 AS high_cardinality, {i} AS id_name FROM lineitem""" for c, x, i in (("l_quantity", "l_quantity", "false"), ("l_tax", "l_tax", "false"), ("doubled", "l_extendedprice * 2 + 1", "false"), ("line_id", "l_orderkey * 10 + l_linenumber", "true"))]))
def _(spark, d):
    own = read(spark, d, "lineitem").withColumns({"doubled": F.col("l_extendedprice") * 2 + 1, "line_id": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    return forecast.leakage(own, "l_extendedprice", ["l_quantity", "l_tax", "doubled", "line_id"])


RD5 = f"""WITH t AS (SELECT CASE WHEN sum(n) >= 30 THEN 50.0::DOUBLE ELSE sum(n) * 50.0 / 30 END AS o, least(1.0::DOUBLE, floor((max(d) - min(d)) / 365) / 2) * 50 AS c, sum(n) >= 30 AND floor((max(d) - min(d)) / 365) >= 2 AS fine,
  round(100 * greatest(0.0, round(greatest(0.0, count(*)::DOUBLE / (max(d) - min(d) + 1) - (sum(n) - count(*))::DOUBLE / sum(n)), 4)), 2) AS i, sum(n) > count(*) AS repeats FROM {DAYS}),
g AS (SELECT round(greatest(0.0, 100.0 - round(100.0 * count(*) FILTER (o_totalprice = 0) / count(o_totalprice), 2) * 0.5 - round(100.0 * count(*) FILTER (o_totalprice < q1 - 1.5 * (q3 - q1) OR o_totalprice > q3 + 1.5 * (q3 - q1)) / count(*), 2)), 2)::DOUBLE AS g
  FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders)),
l AS (SELECT CASE WHEN abs(corr(o_custkey, o_totalprice)) > 0.99 OR abs(corr(o_orderkey, o_totalprice)) > 0.99 THEN 0.0::DOUBLE WHEN count(DISTINCT o_orderkey)::DOUBLE / count(*) > 0.95 THEN 50.0::DOUBLE ELSE 100.0::DOUBLE END AS l FROM orders)
SELECT round(o + c, 2) AS temporal_score, i AS interval_score, g AS target_score, l AS leakage_score, round(round(o + c, 2) * 0.30::DOUBLE + i * 0.20::DOUBLE + g * 0.30::DOUBLE + l * 0.20::DOUBLE, 2) AS overall_score, CASE WHEN repeats THEN 'duplicate_dates' ELSE '' END AS blockers, CASE WHEN repeats OR NOT fine THEN 'not_ready' ELSE 'ready' END AS status FROM t, g, l"""


@query("rd5_readiness", RD5)
def _(spark, d):
    return forecast.readiness(read(spark, d, "orders"), "o_orderdate", "o_totalprice", ["o_custkey", "o_orderkey"])


def _results(spark, d):
    return checks.side_by_side(spark, [lambda: checks.missing(read(spark, d, "orders")), lambda: checks.outliers(read(spark, d, "lineitem"), PRICES), lambda: checks.type_mismatch(_mixed(spark, d)), lambda: checks.consistency(_spelled(spark, d), ["segment"])])


RESULTS = "(" + union([MISSING_ORDERS, OUTLIERS, SQL["ag3_type_mismatch"], SQL["ag14_consistency"]]) + ")"
DIMENSIONS = f"SELECT dimension, count(*) AS checks, count(*) FILTER (status = 'failed') AS failed, round(avg(quality_ratio) * 100, 2) AS score, {severity_sql('(count(*) FILTER (status = ' + chr(39) + 'failed' + chr(39) + '))::DOUBLE / count(*)')} AS severity FROM {RESULTS} GROUP BY dimension"


@query("ag20_dimensions", DIMENSIONS)
def _(spark, d):
    return scoring.dimensions(_results(spark, d))


@query("ag21_composite", f"""WITH w AS (SELECT score, CASE dimension WHEN 'completeness' THEN 0.18::DOUBLE WHEN 'outlier_risk' THEN 0.04::DOUBLE ELSE 0.14::DOUBLE END AS w FROM ({DIMENSIONS})), s AS (SELECT round(sum(score * w) / sum(w), 2) AS q, round(sum(w), 2) AS f FROM w)
SELECT q AS data_quality_score, f AS scorable_fraction, 'validity,uniqueness,schema_quality,freshness,privacy_sensitivity' AS excluded, a AS compliance_adjusted_score,
CASE WHEN a >= 90 THEN 'Excellent' WHEN a >= 75 THEN 'Good' WHEN a >= 55 THEN 'Fair' ELSE 'Poor' END AS rating, CASE WHEN a >= 90 THEN 'Ready' WHEN a >= 75 THEN 'Ready with Minor Cleaning' WHEN a >= 55 THEN 'Ready with Moderate Cleaning' ELSE 'Not Recommended' END AS readiness
FROM (SELECT *, least(q, 74.0::DOUBLE) AS a FROM s)""")
def _(spark, d):
    return scoring.capped(scoring.composite(scoring.dimensions(_results(spark, d))), "medium")


@query("ag25_by_check", f"SELECT check_name, count(*) AS results, count(*) FILTER (status = 'failed') AS failed, CAST(sum(issues_found) AS BIGINT) AS issues, round(1 - avg(quality_ratio), 4) AS impact, {severity_sql('round(1 - avg(quality_ratio), 4)')} AS severity FROM {RESULTS} GROUP BY 1")
def _(spark, d):
    return scoring.by_check(_results(spark, d))


@query("ag25_by_column", f"""SELECT "column", round(avg(quality_ratio) * 100, 2) AS score, count(*) FILTER (status = 'failed') AS failed, CASE WHEN round(avg(quality_ratio) * 100, 2) >= 90 THEN 'Excellent' WHEN round(avg(quality_ratio) * 100, 2) >= 75 THEN 'Good' WHEN round(avg(quality_ratio) * 100, 2) >= 55 THEN 'Fair' ELSE 'Poor' END AS rating FROM {RESULTS} GROUP BY 1""")
def _(spark, d):
    return scoring.by_column(_results(spark, d))


@query("tk5_top_issues", f"""SELECT check_name, "column", issues_found, {severity_sql('1 - quality_ratio')} AS severity FROM {RESULTS} WHERE status = 'failed' ORDER BY CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, issues_found DESC, check_name, "column" LIMIT 10""")
def _(spark, d):
    return scoring.top_issues(_results(spark, d))


@query("ag22_privacy_risk", f"""WITH h AS (SELECT count(*) FILTER (type IS NOT NULL) > 0 AS held FROM {TYPED}), c AS (SELECT 4 AS n, CAST(held AS INTEGER) AS p FROM h)
SELECT CAST(n AS BIGINT) AS columns, CAST(p AS BIGINT) AS pii_columns, CASE WHEN p = 0 THEN 'none' WHEN p / n < 0.1 THEN 'low' WHEN p / n < 0.3 THEN 'medium' ELSE 'high' END AS risk FROM c""")
def _(spark, d):
    cells = _cells(spark, d)
    held = pii.summary(cells).select("column").distinct().withColumn("pii", F.lit(True))
    columns = spark.createDataFrame([(c,) for c in cells.columns], "column string").join(held, "column", "left")
    return scoring.privacy_risk(columns.select("column", F.coalesce("pii", F.lit(False)).alias("pii")))


def _runs(spark, d):
    return read(spark, d, "events").select((F.col("user_id") % 10).cast("string").alias("client"), F.col("event_type").alias("file"), F.col("event_id").alias("completed_at"), F.round("value", 2).alias("score"), F.when(F.col("event_id") % 9 == 0, "failed").otherwise("completed").alias("status"))


RUNS = "(SELECT CAST(user_id % 10 AS VARCHAR) AS client, event_type AS file, event_id AS completed_at, round(value, 2) AS score, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'completed' END AS status FROM events)"


@query("er6_trend", f"SELECT client, file, completed_at, score, status, change, CASE WHEN change IS NULL THEN 'first' WHEN change > 0.05 THEN 'up' WHEN change < -0.05 THEN 'down' ELSE 'flat' END AS direction FROM (SELECT *, round(score - lag(score) OVER (PARTITION BY client, file ORDER BY completed_at), 2) AS change FROM {RUNS} WHERE status = 'completed')")
def _(spark, d):
    return scoring.trend(_runs(spark, d))


@query("ag27_client_stats", f"SELECT client, count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, round(avg(score) FILTER (status = 'completed'), 2) AS avg_score FROM {RUNS} GROUP BY 1")
def _(spark, d):
    return scoring.client_stats(_runs(spark, d))


SHEETS = "(SELECT event_type AS sheet, round(avg(value), 2) AS score, count(*) AS rows, length(event_type) AS columns FROM events GROUP BY 1)"


def _sheets(spark, d):
    return read(spark, d, "events").groupBy(F.col("event_type").alias("sheet")).agg(F.round(F.avg("value"), 2).alias("score"), F.count("*").alias("rows")).withColumn("columns", F.length("sheet").cast("long"))


@query("ag26_sheets", f"SELECT round(avg(score), 2) AS score, CAST(sum(rows) AS BIGINT) AS rows, CAST(max(columns) AS BIGINT) AS columns, count(*) AS sheets FROM {SHEETS}")
def _(spark, d):
    return scoring.sheets(_sheets(spark, d))


@query("ag26_sheet_dimensions", "SELECT CASE WHEN user_id % 2 = 0 THEN 'validity' ELSE 'completeness' END AS dimension, round(avg(CASE WHEN event_id % 5 > 0 THEN value END), 2) AS score, count(value) FILTER (event_id % 5 > 0) AS sheets FROM events GROUP BY 1")
def _(spark, d):
    rows = read(spark, d, "events").select(F.col("event_id").alias("sheet"), F.when(F.col("user_id") % 2 == 0, "validity").otherwise("completeness").alias("dimension"), F.when(F.col("event_id") % 5 > 0, F.col("value")).alias("score"))
    return scoring.sheet_dimensions(rows)


@query("str_completeness", "SELECT CAST(ts AS DATE) AS day, count(*) AS rows, CAST(sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END + CASE WHEN props IS NULL THEN 1 ELSE 0 END + CASE WHEN user_id IS NULL THEN 1 ELSE 0 END + CASE WHEN event_id IS NULL THEN 1 ELSE 0 END + CASE WHEN event_type IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM events GROUP BY 1")
def _(spark, d):
    import uuid

    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{d}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    name = f"completeness_{uuid.uuid4().hex}"
    q = streams.completeness(stream, "ts", "1 day", "1 hour").writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.to_date("window.start").alias("day"), "rows", "missing")


def assess_sql(table: str, columns: dict[str, str], more: tuple[str, ...] = ()) -> str:
    """Results of an assessment. columns: name -> number, date, key (a number that names rows), words or name (words that are not standardised).

    Texts of the tables hold no personal data and no two spellings of one word, which the SQL asserts: a cell that looks like an address or a
    long number, or a pair of values within a tenth of their length, makes an issue.
    """
    of = lambda *kinds: [c for c, k in columns.items() if k in kinds]
    skipped = "SELECT 'cross_column_dates' AS check_name, r AS \"column\", 'passed' AS status, 0::BIGINT AS issues_found, 0::BIGINT AS total, NULL::DOUBLE AS quality_ratio, 'validity' AS dimension, 'skipped_columns_not_present' AS reason FROM (VALUES "
    parts = [row_sql("missing_values", c, f"count(*) - count({c})", "count(*)", "completeness", table) for c in columns]
    parts += [row_sql("type_mismatch", c, "0", f"count({c})", "type_reliability", table) for c in of("number", "date", "key")]
    for c in of("words", "name"):
        n = f"count(*) FILTER (TRY_CAST({c} AS DOUBLE) IS NOT NULL)"
        parts.append(row_sql("type_mismatch", c, f"CASE WHEN {n} * 2 > count({c}) THEN count({c}) - {n} ELSE 0 END", f"count({c})", "type_reliability", table))
        parts.append(row_sql("consistency", c, "sum(r - b)", "sum(r)", "consistency", f"(SELECT sum(n) AS r, max(n) AS b FROM (SELECT {NORM} AS norm, raw, count(*) AS n FROM (SELECT {c} AS raw FROM {table}) GROUP BY 1, 2) GROUP BY norm)"))
    for c in of("words"):
        near = f"SELECT 1 FROM (SELECT DISTINCT {c} AS x FROM {table}), (SELECT DISTINCT {c} AS y FROM {table}) WHERE x <> y AND levenshtein(lower(x), lower(y)) <= 0.1 * (length(x) + length(y))"
        parts.append(row_sql("fuzzy_standardization", c, f"CASE WHEN EXISTS ({near}) THEN 1 ELSE 0 END", f"count({c})", "consistency", table))
    for c in of("date"):
        parts.append(row_sql("date_validity", c, f"count(*) FILTER (year({c}) < 1990 OR year({c}) > {AS_OF[:4]} + 1)", f"count({c})", "validity", table))
        parts.append(f"""SELECT 'freshness' AS check_name, '{c}' AS "column", CASE WHEN stale THEN 'failed' ELSE 'passed' END AS status, stale::BIGINT AS issues_found, n AS total, NULL::DOUBLE AS quality_ratio, 'freshness' AS dimension, NULL::VARCHAR AS reason
          FROM (SELECT DATE '{AS_OF}' - CAST(max({c}) AS DATE) > 90 AS stale, count({c}) AS n FROM {table})""")
    parts.append(skipped + ", ".join(f"('{a} {op} {b}')" for a, op, b in checks.DATE_RULES) + ") v(r)")
    parts.append(f"""SELECT check_name, "column", status, issues_found, total, quality_ratio, dimension, 'rows in groups: ' || g AS reason
      FROM ({row_sql("duplicate_rows", "*", "sum(n - 1)", "sum(n)", "uniqueness", f"(SELECT count(*) AS n FROM {table} GROUP BY {', '.join(columns)})")}), (SELECT CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS g FROM (SELECT count(*) AS n FROM {table} GROUP BY {', '.join(columns)}))""")
    for c in of("number"):
        quartiles = f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {table})"
        parts.append(row_sql("outliers_iqr", c, f"count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))", f"count({c})", "outlier_risk", f"{table}, {quartiles}"))
    for c in columns:
        parts.append(row_sql("schema_quality", c, f"(NOT regexp_matches('{c}', '^[a-z]_[a-z]+$'))::INT", "1", "schema_quality", "(SELECT 1)"))
        if columns[c] in ("words", "name"):
            held = f"count(*) FILTER (regexp_matches({c}, '\\S+@\\S+|([0-9][ .()-]?){{10,}}|([0-9]+\\.){{3}}|://')) > 0"
            parts.append(row_sql("privacy", c, f"CASE WHEN {held} THEN 1 ELSE 0 END", "1", "privacy_sensitivity", table))
        else:
            parts.append(row_sql("privacy", c, "0", "1", "privacy_sensitivity", "(SELECT 1)"))
    return union([*parts, *more])


ORDER_KINDS = {"o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "words", "o_totalprice": "number", "o_orderdate": "date", "o_orderpriority": "words"}
LINE_KINDS = {c: {"measurement": "number", "identifier": "key", "date": "date"}.get(legacy, "words") for c, (_, legacy, _, _) in LINE_CLASSES.items()}
CUSTOMER_KINDS = {"c_custkey": "number", "c_name": "name", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "words"}
KNOWN = row_sql("referential_integrity", "o_custkey", "count(*) FILTER (o_custkey NOT IN (SELECT c_custkey FROM customer))", "count(o_custkey)", "integrity", "orders")


@query("run_assess_orders", assess_sql("orders", ORDER_KINDS, (f"SELECT * FROM ({SQL['rul_business_rules']})", KNOWN)))
def _(spark, d):
    return pipeline.assess(read(spark, d, "orders"), AS_OF, RULES, references=[("o_custkey", read(spark, d, "customer"), "c_custkey")]).results


@query("run_assess_lineitem", assess_sql("lineitem", LINE_KINDS))
def _(spark, d):
    return pipeline.assess(read(spark, d, "lineitem"), AS_OF).results


@query("run_assess_customer_scores", f"""SELECT dimension, count(*) AS checks, count(*) FILTER (status = 'failed') AS failed, round(avg(quality_ratio) * 100, 2) AS score, {severity_sql("(count(*) FILTER (status = 'failed'))::DOUBLE / count(*)")} AS severity
FROM ({assess_sql("customer", CUSTOMER_KINDS)}) WHERE coalesce(reason, '') NOT LIKE 'skipped%' GROUP BY dimension""")
def _(spark, d):
    return pipeline.assess(read(spark, d, "customer"), AS_OF).dimensions


@query("ag28_value_counts", "SELECT trim(c_mktsegment) AS value, count(*) AS n FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY 1")
def _(spark, d):
    return entities.values(read(spark, d, "customer"), "c_mktsegment")


@query("sc11_vin", "SELECT count(*) FILTER (c_custkey % 3 = 0) AS valid_vins FROM customer")
def _(spark, d):
    number = F.when(F.col("c_custkey") % 3 == 0, F.lit("1m8gdm9axkp042788")).when(F.col("c_custkey") % 3 == 1, F.lit("1M8GDM9A1KP042788")).otherwise(F.lit("1M8GDM9AXKP04278"))
    return pii.valid_vins(read(spark, d, "customer").select(number.alias("vin")), "vin")


@query("sc9_cosine", "SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) AS similarity FROM embeddings")
def _(spark, d):
    return read(spark, d, "embeddings").select("vec_id", F.round(values.cosine(F.col("embedding"), F.reverse("embedding")), 6).alias("similarity"))


@query("sc2_loose_numbers", "SELECT kind = 'number' AS is_number, count(*) AS n, CAST(sum(v) AS DOUBLE) AS total FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'string' WHEN c_custkey % 11 = 0 THEN 'null' ELSE 'number' END AS kind, CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 11 <> 0 THEN 1000000 + c_custkey END AS v FROM customer) GROUP BY 1")
def _(spark, d):
    number = values.loose_number(F.col("code"))
    return _mixed(spark, d).select(number.alias("v")).groupBy(F.col("v").isNotNull().alias("is_number")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(
    "sc19_bands",
    f"""SELECT c_custkey, {severity_sql("s / 100")} AS severity, CASE WHEN s >= 90 THEN 'Excellent' WHEN s >= 75 THEN 'Good' WHEN s >= 55 THEN 'Fair' ELSE 'Poor' END AS rating,
      CASE WHEN s >= 90 THEN 'Ready' WHEN s >= 75 THEN 'Ready with Minor Cleaning' WHEN s >= 55 THEN 'Ready with Moderate Cleaning' ELSE 'Not Recommended' END AS readiness FROM (SELECT c_custkey, c_acctbal / 100 AS s FROM customer)""",
)
def _(spark, d):
    s = F.col("c_acctbal") / 100
    return read(spark, d, "customer").select("c_custkey", values.severity(s / 100).alias("severity"), values.rating(s).alias("rating"), values.readiness(s).alias("readiness"))


@query(
    "sc20_frequency",
    "SELECT CASE WHEN g <= 1.5 THEN 'daily' WHEN g BETWEEN 5 AND 9 THEN 'weekly' WHEN g BETWEEN 25 AND 35 THEN 'monthly' WHEN g BETWEEN 80 AND 100 THEN 'quarterly' WHEN g BETWEEN 350 AND 380 THEN 'yearly' ELSE 'irregular' END AS frequency, count(*) AS n FROM (SELECT l_quantity * l_linenumber AS g FROM lineitem) GROUP BY 1",
)
def _(spark, d):
    return read(spark, d, "lineitem").groupBy(values.frequency(F.col("l_quantity") * F.col("l_linenumber")).alias("frequency")).agg(F.count("*").alias("n"))


NUMBERS = ("1e3", "+5", "5.", " 12 ", "inf", "nan", "1,000", "1d", "0x1A", "", "-.5")
VALUES = (1000.0, 5.0, 5.0, 12.0, float("inf"), None, None, None, None, None, -0.5)


@query("sc1_to_numeric", "SELECT c_custkey, CASE c_custkey % 11 WHEN 0 THEN 1000 WHEN 1 THEN 5 WHEN 2 THEN 5 WHEN 3 THEN 12 WHEN 4 THEN 999 WHEN 10 THEN -0.5 END::DOUBLE AS v FROM customer")
def _(spark, d):
    text = F.element_at(F.array(*map(F.lit, NUMBERS)), (F.col("c_custkey") % 11 + 1).cast("int"))
    v = values.number(text)
    return read(spark, d, "customer").select("c_custkey", F.when(F.abs(v) == float("inf"), 999.0).otherwise(v).alias("v"))


@query("sc7_safe_normal", "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'strasse fi ' || lower(c_mktsegment) WHEN 1 THEN 'a b c' ELSE NULL END AS v FROM customer")
def _(spark, d):
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, F.concat(F.lit("  Stra\u00dfe  \ufb01\t"), "c_mktsegment")).when(k == 1, "A,b;\u3000C!")
    return read(spark, d, "customer").select("c_custkey", values.safe_normal(punctuation=True)(text).alias("v"))


@query("sc17_json_rows", "SELECT '{\"c_custkey\":' || c_custkey || ',\"seg\":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '\"' || c_mktsegment || '\"' END || ',\"x\":null}' AS json FROM customer")
def _(spark, d):
    own = read(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")).alias("seg"), F.lit(float("nan")).alias("x"))
    return values.json_rows(own)


@query("flt6_skipped", """SELECT * FROM (VALUES ('cross_column_dates', 'Expected Del Date >= Order Date', 'skipped_columns_not_present'), ('cross_column_dates', 'Expected  Del. Date >= SO Date Created', 'skipped_columns_not_present'), ('non_negative', 'Order Qty', 'skipped_non_measurement_column'), ('suspicious_zero', 'Standard Cost', 'skipped_non_measurement_column')) v(check_name, "column", reason)""")
def _(spark, d):
    own = read(spark, d, "lineitem").select(F.col("l_shipdate").alias("Ship Date"), F.col("l_shipdate").alias("Order Date"), F.col("l_quantity").alias("Order Qty"), F.col("l_tax").alias("Standard Cost"))
    return checks.skipped(own, {"Order Qty": "identifier", "Standard Cost": "categorical"}).select("check_name", "column", "reason")


@query("jn1_unlike_reference", "SELECT 'c_name' AS \"column\", 'passed' AS status, CAST(0 AS BIGINT) AS issues_found, 'reference_type_mismatch' AS reason FROM (SELECT count(*) FROM customer)")
def _(spark, d):
    named = read(spark, d, "customer").select(F.concat(F.col("c_mktsegment"), F.lit(" Systems Ltd")).alias("c_name"))
    return checks.integrity(named, "c_name", read(spark, d, "customer"), "c_custkey").select("column", "status", "issues_found", "reason")


@query("jn3_references", "SELECT * FROM (VALUES ('Customer No.', 'code', NULL), ('Main Customer', 'name', NULL), ('Last Supplier', NULL, 'reference_type_mismatch')) v(\"column\", kind, reason)")
def _(spark, d):
    k = F.col("c_custkey")
    orders = read(spark, d, "customer").select(F.concat(F.lit("C"), k.cast("string")).alias("Customer No."), F.concat("c_mktsegment", F.lit(" Systems Ltd")).alias("Main Customer"), F.concat("c_mktsegment", F.lit(" Trading Co.")).alias("Last Supplier"))
    codes, names = orders.select(F.col("`Customer No.`").alias("value")), orders.select(F.col("Main Customer").alias("value"))
    suppliers = read(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("value"))
    found = checks.match_references(orders, [(("customer no.", "main customer"), codes, names), (("last supplier",), suppliers, None)])
    return spark.createDataFrame([(c, kind, why) for c, (kind, why) in found.items()], "column string, kind string, reason string")


@query("jn8_manifests", "SELECT o_orderkey AS run_id, o_orderkey % 2 = 0 AND o_orderkey % 6 = 0 AS has_compliance FROM orders")
def _(spark, d):
    run = F.col("o_orderkey")
    manifests = read(spark, d, "orders").where(run % 2 == 0).select(run.alias("run_id"), F.array(F.lit(None).cast("string"), F.when(run % 6 == 0, "c.html").otherwise("")).alias("sheets"))
    return scoring.with_manifests(read(spark, d, "orders").select(run.alias("run_id")), manifests)


@query(
    "rul10_results",
    """WITH n AS (SELECT count(*) AS n FROM orders), r AS (
    SELECT 'price_range' AS rule_id, 'Price in range' AS rule_name, 'min_max' AS rule_type, 'o_totalprice' AS "column", count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 200000) AS f, 'HIGH' AS severity, 'validity' AS dimension FROM orders
    UNION ALL SELECT 'status_allowed', 'status_allowed', 'allowed_values', 'o_orderstatus', count(*) FILTER (lower(o_orderstatus) NOT IN ('f', 'o')), 'MEDIUM', 'validity' FROM orders
    UNION ALL SELECT 'date_kind', 'date_kind', 'datatype', 'o_orderdate', count(*) FILTER (o_orderdate IS NULL), 'MEDIUM', 'validity' FROM orders
    UNION ALL SELECT 'not_after_today', 'not_after_today', 'cross_column', 'o_orderdate+$TODAY', count(*) FILTER (o_orderdate > now()), 'MEDIUM', 'validity' FROM orders
    UNION ALL SELECT 'customer_unique', 'customer_unique', 'unique', 'o_custkey', (SELECT CAST(sum(c - 1) AS BIGINT) FROM (SELECT count(*) AS c FROM orders GROUP BY o_custkey)), 'LOW', 'uniqueness' FROM n)
    SELECT rule_id, rule_name, rule_type, "column", CASE WHEN f > 0 THEN 'failed' ELSE 'passed' END AS status, f AS failed_records, round(f * 100.0::DOUBLE / n, 4) AS failed_pct, severity, 'Validation rule failure affects data quality.' AS business_impact, 'Review and fix failed records at ingestion.' AS recommendation, dimension FROM r, n
    UNION ALL SELECT 'bad_kind', 'bad_kind', 'datatype', 'o_custkey', 'error', 0, 0.0, 'MEDIUM', 'Validation rule failure affects data quality.', '''colour''', 'validity'""",
)
def _(spark, d):
    spec = {"rules": [{"id": "price_range", "name": "Price in range", "type": "min_max", "column": "o_totalprice", "min": 1000.0, "max": 200000.0, "severity": "high"}, {"id": "status_allowed", "type": "allowed_values", "column": "o_orderstatus", "allowed_values": ["f", "O"]}, {"id": "date_kind", "type": "datatype", "column_pattern": "orderdate", "expected_type": "date"}, {"id": "not_after_today", "type": "cross_column", "left": "o_orderdate", "right": "$TODAY", "op": "<="}, {"id": "customer_unique", "type": "unique", "column": "o_custkey", "severity": "low"}, {"id": "bad_kind", "type": "datatype", "column": "o_custkey", "expected_type": "colour"}]}
    return checks.rule_results(read(spark, d, "orders"), checks.load_rules(spec))


@query("tk1_failing_ids", "SELECT 'price_range:o_totalprice' AS label, o_orderkey AS _rid FROM orders WHERE o_totalprice > 200000 ORDER BY o_orderkey LIMIT 100")
def _(spark, d):
    rules = [checks.Rule("price_range", "min_max", ("o_totalprice",), high=200000.0), checks.Rule("none", "required", ("o_orderkey",))]
    return checks.failing_ids(read(spark, d, "orders").withColumn("_rid", F.col("o_orderkey")), rules)


@query("ag28_first_seen", "SELECT c_mktsegment AS value, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1")
def _(spark, d):
    return entities.first_seen(read(spark, d, "customer"), "c_mktsegment", "c_custkey")


@query("er4_three_tiers", """WITH c AS (SELECT 'n' || vec_id AS name, embedding AS e FROM embeddings WHERE vec_id < 5), m AS (SELECT 'v' || v.vec_id AS value, c.name, round(list_dot_product(v.embedding::DOUBLE[], c.e::DOUBLE[]) / (sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])) * sqrt(list_dot_product(c.e::DOUBLE[], c.e::DOUBLE[]))), 6) AS s FROM embeddings v, c QUALIFY row_number() OVER (PARTITION BY v.vec_id ORDER BY s DESC, name DESC) = 1)
SELECT value, CASE WHEN s >= 0.70 THEN name END AS canonical, CASE WHEN s >= 0.70 THEN 3 ELSE 0 END AS tier, CASE WHEN s >= 0.78 THEN 'auto' WHEN s >= 0.70 THEN 'review' ELSE 'no_match' END AS decision, s < 0.78 AS requires_review, CASE WHEN s < 0.70 THEN 'below_all_thresholds' END AS reason FROM m""")
def _(spark, d):
    v = read(spark, d, "embeddings")
    value = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    listed = v.where("vec_id < 5").select(F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("vector"))
    out = entities.cascade(v.select(value.alias("value"), F.lit(1).cast("long").alias("n")), listed.select("name", F.col("name").alias("canonical")), (v.select(value.alias("value"), F.col("embedding").alias("vector")), listed))
    return out.select("value", "canonical", "tier", "decision", "requires_review", "reason")


def _patients(spark, d):
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(F.concat(F.lit("P"), F.lpad(k.cast("string"), 7, "0")).alias("patient_id"), F.concat(F.lit("c"), k.cast("string"), F.lit("@mail.com")).alias("email"), F.when(k % 3 == 0, F.lit("1M8GDM9AXKP042788")).when(k % 3 == 1, F.lit("1M8GDM9A1KP042788")).alias("vehicle_id"), (k % 100).alias("patient_age"), F.lit("~").alias("record_id"))


PHI = """SELECT 'patient_id' AS "column", 'hipaa_08_medical_record' AS identifier, 'MRN' AS type, count(*) AS hits, 0.9::DOUBLE AS confidence, 'regex' AS method FROM customer
UNION ALL SELECT 'email', 'hipaa_06_email', 'EMAIL', count(*), 0.85, 'presidio' FROM customer
UNION ALL SELECT 'vehicle_id', 'hipaa_12_vehicle_identifier', 'VIN', count(*) FILTER (c_custkey % 3 = 0), 0.92, 'regex' FROM customer
UNION ALL SELECT 'patient_age', 'hipaa_03_dates', 'AGE_OVER_89', count(*) FILTER (c_custkey % 100 >= 90), 0.9, 'age_heuristic' FROM customer"""


def _phi(spark, d):
    df = _patients(spark, d)
    facts = classify.profile(df).select("column", "rows", "distinct")
    return compliance.identify(pii.summary(df), df.columns, facts, pii.ages_over_89(df, "patient_age").select(F.lit("patient_age").alias("column"), "age_over_89"))


@query("hp5_identify", PHI)
def _(spark, d):
    return _phi(spark, d)


@query("hp6_posture", f"WITH f AS ({PHI}) SELECT 'PHI_DETECTED' AS status, 'PARTIAL_SCOPE' AS scope, string_agg(DISTINCT identifier, ',' ORDER BY identifier) AS identifiers_found, string_agg(DISTINCT \"column\", ',' ORDER BY \"column\") AS columns_with_phi, CAST(sum(hits) AS BIGINT) AS hits, 'hipaa_16_biometric,hipaa_17_full_face_photo' AS not_assessed, '' AS warnings FROM f WHERE hits > 0")
def _(spark, d):
    return compliance.posture(_phi(spark, d))


@query("hp6_check_rows", f"WITH f AS ({PHI}) SELECT \"column\", CAST(sum(hits) AS BIGINT) AS issues_found, 'failed' AS status FROM f GROUP BY 1 UNION ALL SELECT '*', CAST(sum(hits) AS BIGINT), 'failed' FROM f")
def _(spark, d):
    return compliance.check_rows(_phi(spark, d)).select("column", "issues_found", "status")


@query("hp7_exposure_columns", f"WITH f AS ({PHI}) SELECT 'PHI_DETECTED' AS status, count(DISTINCT identifier) AS identifiers_detected, count(DISTINCT \"column\") AS columns_affected, CAST(sum(hits) AS BIGINT) AS hits, round(least(100.0, least(100.0, count(DISTINCT identifier) * 10.0) + least(30.0, count(DISTINCT \"column\") * 3.0) + least(40.0, log10(sum(hits)) * 15.0) + 20.0), 2)::DOUBLE AS exposure_score, CASE WHEN count(DISTINCT identifier) >= 4 THEN 'high' ELSE 'medium' END AS severity FROM f WHERE hits > 0")
def _(spark, d):
    return pii.exposure(_phi(spark, d))


@query("hp4_by_column", "SELECT 'record_id' AS \"column\", 'hipaa_18_other_unique_id' AS identifier, 'UNIQUE_ID' AS type, count(*) AS hits, 0.99::DOUBLE AS confidence, 'column_header_heuristic' AS method FROM customer")
def _(spark, d):
    """Names without a pattern in any cell, but a distinct value in each row."""
    df = read(spark, d, "customer").select(F.concat(F.lit("~"), F.translate(F.col("c_custkey").cast("string"), "0123456789", "abcdefghij")).alias("record_id"), F.lit("x").alias("claim_id"))
    return compliance.identify(pii.summary(df), df.columns, classify.profile(df).select("column", "rows", "distinct"))


@query("hp1_registry", "SELECT count(*) AS identifiers, count(*) FILTER (i NOT IN (16, 17)) AS assessed, CAST(sum(i) AS BIGINT) AS numbers FROM range(1, 19) r(i)")
def _(spark, d):
    return compliance.registry(spark).agg(F.count("*").alias("identifiers"), F.count_if("assessed").alias("assessed"), F.sum("number").alias("numbers"))


@query("ag23_ceilings", "SELECT c_custkey, least(s, CASE c_custkey % 4 WHEN 0 THEN 70 WHEN 1 THEN 74 WHEN 2 THEN 89 ELSE CASE WHEN c_custkey % 100 > 0 THEN round(100.0 - (c_custkey % 100) / 100.0::DOUBLE * 30.0, 2) ELSE 100 END END::DOUBLE) AS compliance_adjusted_score FROM (SELECT c_custkey, 60.0::DOUBLE + c_custkey % 41 AS s FROM customer)")
def _(spark, d):
    k = F.col("c_custkey")
    own = read(spark, d, "customer").select("c_custkey", (F.lit(60.0) + k % 41).alias("data_quality_score"))
    level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "none"))), (k % 4 + 1).cast("int"))
    return scoring.capped(own, level, (k % 100).cast("double")).select("c_custkey", "compliance_adjusted_score")


def _written(spark, name: str) -> str:
    """A folder of its own beside the session's shared one."""
    import tempfile
    import uuid

    place = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tabtrust-")
    return f"{place}/sources/{uuid.uuid4().hex}/{name}"


@query("src2_csv", "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _rid, CAST(o_orderkey AS VARCHAR) AS \"Order No\", o_orderstatus AS \"Order Status\", CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_custkey AS VARCHAR) END AS \"Customer No.\" FROM orders")
def _(spark, d):
    """Orders as a semicolon file with a header and rows that are all blank, and back."""
    path = _written(spark, "orders.csv")
    lines = read(spark, d, "orders").select("o_orderkey", F.concat_ws(";", F.col("o_orderkey").cast("string"), "o_orderstatus", F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey").cast("string")).otherwise("N/A")).alias("line"))
    blank = lines.where("o_orderkey % 50 = 0").select("o_orderkey", F.lit(";;").alias("line"))
    head = spark.createDataFrame([(-1, "Order No;Order Status;Customer No.")], "o_orderkey long, line string")
    head.unionByName(lines).unionByName(blank).orderBy("o_orderkey").coalesce(1).select("line").write.text(path)
    return next(iter(tables.load(spark, path).values()))


@query("src12_preview", "SELECT o_orderkey AS _rid FROM orders WHERE o_orderkey BETWEEN 15 AND 25")
def _(spark, d):
    return tables.preview(read(spark, d, "orders").select(F.col("o_orderkey").alias("_rid")), 20)


@query("src13_reference_values", "SELECT DISTINCT trim(c_mktsegment) AS value FROM customer")
def _(spark, d):
    return tables.reference_values(read(spark, d, "customer").select(F.concat(F.lit(" "), "c_mktsegment").alias("Customer Code "), "c_name"), ("customer no.", "customer code"))


@query("tk6_runs", "SELECT event_id AS run_id, completed_at FROM (SELECT event_id, event_id AS completed_at FROM events WHERE user_id % 10 = 3) ORDER BY completed_at DESC LIMIT 50")
def _(spark, d):
    path = _written(spark, "runs")
    tables.append(read(spark, d, "events").select(F.col("event_id").alias("run_id"), (F.col("user_id") % 10).cast("string").alias("client"), F.col("event_id").alias("completed_at")), path)
    return tables.runs(spark, path, "3").select("run_id", "completed_at")


@query("prj1_columns", "SELECT o_orderkey - (SELECT min(o_orderkey) FROM orders) AS _rid, o_orderstatus FROM orders")
def _(spark, d):
    own = read(spark, d, "orders")
    first = own.agg(F.min("o_orderkey")).first()[0]
    return checks.scope(own.withColumn("_rid", F.col("o_orderkey") - first), columns=["o_orderstatus"])
