"""Column profiles and semantic roles: unpivoted aggregates of the columns of one form, then rules over one row a column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtrust.functions.values import absent, col, loose_number, moment, number, rounded
from tabtrust.operators import pii
from tabtrust.operators.checks import kinds

#: What names of columns say.
KEY_NAME = re.compile(
    r"(customer\s*no\.?|supplier\s*(code|no\.?)|product(\s*code)?|invoice\s*(no\.?|number)|order\s*(no\.?|number)|\bsku\b|\bemail\b|e-?mail\s*address|account\s*(no\.?|number)|(^|_)id$|(^|_)id\b)", re.I
)
IDENTIFIER_NAME = re.compile(r"(_id\b|\bid\b|\bcode\b|code$|\bno\b|no\.|number|\binv\b|invoice|\bref\b|reference|\bsku\b|\bpo\b|order\s*no)", re.I)
FINANCIAL_NAME = re.compile(r"(price|cost|amount|revenue|tax|margin|discount|balance|net|gross|total|amt|val|value|rate)", re.I)
DESCRIPTIVE_NAME = re.compile(r"(city|country|desc|description|category|state|region|status|type|group|comment|notes|address)", re.I)
CONTACT_WORDS = ("fax", "tel", "phone", "mobile", "toll free", "tollfree", "landline", "cell", "contact")
DATE_NAME = re.compile(r"(date|time|timestamp|\bdob\b)", re.I)
PARENT_KEY_NAME = re.compile(r"(order\s*(no\.?|number)|invoice\s*(no\.?|number))", re.I)
LINE_NAME = re.compile(r"(line(\s*(no\.?|number|#)?)|seq(uence)?(\s*(no\.?|number|#)?)|item\s*(no\.?|number|#))", re.I)
BOOLEANS = {"true", "false", "1", "0", "y", "n", "yes", "no", "t", "f"}
LEGACY = {"primary_key": "identifier", "business_key": "identifier", "foreign_key": "identifier", "category": "categorical", "boolean": "categorical", "financial": "measurement", "contact": "pii"}
SAMPLE = 200
MIN_ROWS, MIN_SCORE, ONE_TO_MANY = 20, 0.6, 0.2


def _form(kind: str) -> str:
    """The type in which cells are counted: whole numbers and moments as long, fractions as double, all else as text."""
    whole = kind in ("tinyint", "smallint", "int", "bigint", "boolean", "date", "timestamp")
    return "long" if whole else "double" if kind in ("float", "double") else "string"


def _cell(c: str, kind: str) -> Column:
    """A cell in its form; absent ones are null."""
    if kind in ("timestamp", "date"):
        return F.unix_micros(col(c)) if kind == "timestamp" else F.unix_date(col(c)).cast("long")
    if kind.startswith(("array", "map", "struct")):
        return F.when(col(c).isNotNull(), F.to_json(F.struct(col(c))))
    return F.when(~absent(col(c), kind), col(c).cast(_form(kind)))


def facts(df: DataFrame) -> DataFrame:
    """profile() with, of each column, the number of cells that are numbers, of those that have a time of day, and of texts that are not blank (texts) and
    numbers if thousands separators are let through (loose).

    Cells are unpivoted and counted by value, with partial sums; a frequent value costs no more than a rare one. Columns of one
    form share a shuffle, so that numbers are never written as text, and each column is read once. What a value is is asked once a value.
    """
    by, parts = kinds(df), []
    for form in sorted(set(map(_form, by.values()))):
        own = {i: (c, k) for i, (c, k) in enumerate(by.items()) if _form(k) == form}
        # the column's number, not its name, goes with each value
        cells = F.array(*[F.struct(F.lit(i).cast("short").alias("i"), _cell(c, k).alias("v")) for i, (c, k) in own.items()])
        counts = df.select(F.explode(cells).alias("x")).select("x.*").groupBy("i", "v").agg(F.count("*").alias("n"))
        there, v = F.col("v").isNotNull(), F.col("v")
        of = lambda test, own=own: F.col("i").isin([i for i, (_, k) in own.items() if test(k)])
        total = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
        text, whole = of(lambda k: k == "string"), of(lambda k: not k.startswith(("string", "array", "map", "struct", "binary", "timestamp", "date", "boolean")))
        is_number, late = whole & there, F.lit(False)
        if form == "string":
            is_number = F.when(text, number(v).isNotNull()).otherwise(is_number)
            late = of(lambda k: k == "timestamp_ntz") & ~v.endswith(" 00:00:00")
        elif form == "long":
            time = F.timestamp_micros(v)
            late = of(lambda k: k == "timestamp") & (time != F.date_trunc("day", time))
        cell = F.nullif(F.trim(v.cast("string")), F.lit(""))
        loose, filled = (text & loose_number(cell).isNotNull(), text & cell.isNotNull()) if form == "string" else (F.lit(False), F.lit(False))
        parts.append(counts.groupBy("i").agg(
            F.sum("n").alias("rows"), total(there).alias("non_null"), F.count_if(there).alias("distinct"), F.coalesce(F.max(F.when(there, F.col("n"))), F.lit(0)).alias("top_n"),
            total(is_number).alias("numbers"), total(late).alias("times"), total(loose).alias("loose"), total(filled).alias("texts"),
        ))
    out = reduce(DataFrame.unionByName, parts)
    share = lambda x: rounded(F.coalesce(F.try_divide(F.col(x), F.col("non_null")), F.lit(0.0)))
    name = F.element_at(F.array(*map(F.lit, by)), F.col("i") + 1).alias("column")
    return out.select(name, "rows", "non_null", "distinct", share("distinct").alias("ratio"), "top_n", share("top_n").alias("top_ratio"), "numbers", "times", "loose", "texts")


def profile(df: DataFrame) -> DataFrame:
    """(column, rows, non_null, distinct, ratio, top_n, top_ratio) of each column."""
    return facts(df).drop("numbers", "times", "loose", "texts")


def heads(df: DataFrame, size: int = SAMPLE) -> dict[str, list[str]]:
    """The first `size` values of each column as text, by partition and row; the sample is part of the rule, and bounded.

    Columns without nulls have theirs in the first rows; those of the others are ranked by row id, with partial top-k.
    """
    by = kinds(df)
    text = [F.when(~absent(col(c), k), col(c).cast("string")) for c, k in by.items()]
    rows = df.select(*[t.alias(f"c{i}") for i, t in enumerate(text)]).limit(size).collect()
    out = {c: [r[i] for r in rows if r[i] is not None] for i, c in enumerate(by)}
    sparse = {i: c for i, c in enumerate(by) if len(out[c]) < len(rows) == size}
    if sparse:
        cells = F.array(*[F.struct(F.lit(i).alias("i"), text[i].alias("v")) for i in sparse])
        cells = df.select(F.monotonically_increasing_id().alias("row"), F.explode(cells).alias("x")).select("row", "x.*").where("v is not null")
        first = cells.withColumn("k", F.row_number().over(Window.partitionBy("i").orderBy("row"))).where(F.col("k") <= size)
        for c in sparse.values():
            out[c] = []
        for r in first.orderBy("i", "k").collect():  # `size` rows a column
            out[sparse[r["i"]]].append(r["v"])
    return out


def _phone_like(values: list[str]) -> bool:
    numbers = [float(v) for v in values if re.fullmatch(r"\s*[+-]?\d+(\.\d+)?\s*", v)]
    if not values or len(numbers) < 0.8 * len(values):
        return False
    return sum(n == int(n) and len(str(abs(int(n)))) >= 9 for n in numbers) > 0.8 * len(numbers)


def _code_like(values: list[str]) -> bool:
    good = [0 < len(v.strip()) <= 20 and v.strip().count(" ") <= 1 for v in values]
    return bool(values) and sum(good) >= 0.8 * len(good)


def role(name: str, kind: str, facts: dict, values: list[str], numeric: float, date_share: float) -> str:
    """One of 12 roles from a column's name, type, profile row, first values and shares of numbers and dates."""
    if not facts["non_null"]:
        return "category"
    low, ratio = name.strip().lower(), facts["distinct"] / facts["non_null"]
    if any(w in low.replace("_", " ") for w in CONTACT_WORDS):
        return "pii" if "email" in low else "contact"
    allowed = pii.expected_types(name)
    if allowed and any(h["type"] in allowed for v in values for h in pii.hits(v, name)):
        return "pii"
    if kind not in ("timestamp", "timestamp_ntz", "date") and _phone_like(values):
        return "contact"
    if kind in ("timestamp", "timestamp_ntz", "date") or (kind == "string" and date_share >= (0.5 if DATE_NAME.search(name) else 0.8)):
        return "date"
    if IDENTIFIER_NAME.search(name) or (kind == "string" and ratio >= 0.9 and sum(bool(re.fullmatch(r"\s*[+-]?\d+(\.\d+)?\s*", v)) for v in values) < 0.8 * len(values) and _code_like(values)):
        if KEY_NAME.search(name.strip()) and ratio >= 0.98:
            return "primary_key"
        return "business_key" if "code" in low or "sku" in low else "identifier"
    if numeric >= 0.9:
        return "financial" if FINANCIAL_NAME.search(name) else "measurement"
    if facts["distinct"] <= 2 and ratio <= 0.1 and {v.strip().lower() for v in values} <= BOOLEANS:
        return "boolean"
    return "category" if ratio <= 0.5 else "free_text"


def uniqueness_confidence(name: str, kind: str, facts: dict, own_role: str) -> float:
    if not facts["non_null"]:
        return 0.0
    ratio, top = facts["distinct"] / facts["non_null"], facts["top_n"] / facts["non_null"]
    score = 0.3 * bool(KEY_NAME.search(name)) - 0.4 * bool(DESCRIPTIVE_NAME.search(name))
    score += 0.35 if own_role in ("primary_key", "business_key") else 0.2 if own_role == "identifier" else -0.3 if own_role in ("category", "free_text", "measurement", "financial") else 0
    score += 0.35 if ratio >= 0.98 else 0.2 if ratio >= 0.9 else 0.1 if ratio >= 0.7 else -0.2 if ratio < 0.5 else 0
    score -= 0.3 * (facts["non_null"] >= 20 and top >= 0.05) + 0.2 * (kind in ("double", "float", "boolean")) + 0.3 * (facts["distinct"] <= 10 and facts["non_null"] > 20)
    return max(0.0, min(1.0, round(score, 3)))


def evidence(name: str, facts: dict, legacy_role: str) -> tuple[float, bool]:
    """(score, is expected to be unique) of a key candidate."""
    n = facts["non_null"]
    if not n:
        return 0.0, False
    ratio, named = facts["distinct"] / n, bool(KEY_NAME.search(name.strip()))
    score = (0.5 if ratio >= 0.98 else 0.3 if ratio >= 0.9 else 0.1 if ratio >= 0.7 else 0) + (0.25 if legacy_role == "identifier" else -0.2 if legacy_role in ("categorical", "free_text", "measurement") else 0) + 0.25 * named
    score = max(0.0, min(1.0, score - 0.35 * (n >= MIN_ROWS and facts["top_n"] / n >= 0.05)))
    return score, named if n < MIN_ROWS else named and score >= MIN_SCORE


def classify(df: DataFrame) -> list[dict]:
    """One entry a column: role, legacy role, uniqueness confidence, evidence, expected_unique, and the profile."""
    by, values = kinds(df), heads(df)
    none = {"rows": 0, "non_null": 0, "distinct": 0, "ratio": 0.0, "top_n": 0, "top_ratio": 0.0, "numbers": 0, "times": 0, "loose": 0, "texts": 0}
    known = {c: {"column": c, **none} for c in by} | {r["column"]: r.asDict() for r in facts(df).collect()}  # one row a column
    for c, k in by.items():
        if k.startswith("timestamp") and not known[c]["times"]:  # timestamps without a time of day read as dates
            values[c] = [v[:10] for v in values[c]]
    texts = [c for c, k in by.items() if k == "string"]
    sample = df.sparkSession.createDataFrame([(c, v) for c in texts for v in values[c]], "column string, value string")
    dates = {r["column"]: r["d"] / r["t"] for r in sample.groupBy("column").agg(F.count(moment(F.col("value"))).alias("d"), F.count("*").alias("t")).collect()}
    out = []
    for c, k in by.items():
        f = known[c]
        own = role(c, k, f, values[c], f["numbers"] / max(1, f["non_null"]), dates.get(c, 0.0))
        legacy = LEGACY.get(own, own)
        score, unique = evidence(c, f, legacy)
        out.append({**f, "role": own, "legacy_role": legacy, "uniqueness_confidence": uniqueness_confidence(c, k, f, own), "evidence": round(score, 4), "expected_unique": unique, "importance": "high" if own in ("primary_key", "business_key", "identifier") else "medium" if own in ("measurement", "financial", "date") else "low", "sensitivity": "high" if own in ("pii", "contact") else "low"})
    return out


CLASSES = "column string, rows long, non_null long, distinct long, ratio double, top_n long, top_ratio double, role string, legacy_role string, uniqueness_confidence double, evidence double, expected_unique boolean, importance string, sensitivity string"


def classes(df: DataFrame) -> DataFrame:
    """classify as a table."""
    names = [x.split()[0] for x in CLASSES.split(", ")]
    return df.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in classify(df)], CLASSES)


def business_keys(df: DataFrame, found: list[dict] | None = None, configured: list[str] | None = None) -> list[tuple[str, ...]]:
    """Keys to check: the configured ones, else each column that evidence expects to be unique; a parent key of lines takes its line column along."""
    if configured:
        return [tuple(configured)]
    found = found or classify(df)
    line = next((r["column"] for r in found if LINE_NAME.search(r["column"].strip())), None)
    out = []
    for r in found:
        extra = (r["non_null"] - r["distinct"]) / max(1, r["rows"])
        if PARENT_KEY_NAME.search(r["column"]) and extra >= ONE_TO_MANY:
            if line:
                out.append((r["column"], line))
        elif r["expected_unique"]:
            out.append((r["column"],))
    return out
