"""Personal data: spans by pattern and context, overlaps resolved, masks; protected health identifiers of columns.

Spans need offsets and context windows, so texts go through one Arrow-batched UDF; all counts are then aggregates.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabtrust.functions.values import col, number, vin, vin_text
from tabtrust.operators.checks import kinds

#: Type -> pattern, score, words one of which must stand near (before, after) or none.
PATTERNS: tuple[tuple[str, re.Pattern, float, tuple[str, ...], int, int], ...] = (
    ("CNIC", re.compile(r"\b\d{5}-?\d{7}-?\d\b"), 0.95, (), 0, 0),
    ("SSN", re.compile(r"\b\d{3}-\d{2}-\d{4}\b"), 0.95, (), 0, 0),
    ("EMAIL", re.compile(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"), 0.99, (), 0, 0),
    ("PHONE", re.compile(r"(?<!\d)(?:\+?92[\s-]?)?0?3\d{2}[\s-]?\d{7}(?!\d)|(?<!\d)(?:\+?44[\s-]?)?0?\d{2,4}[\s-]?\d{3,4}[\s-]?\d{3,4}(?!\d)|(?<!\d)\+\d{1,3}[\s-]?\(?\d{2,4}\)?[\s-]\d{3,4}[\s-]?\d{3,4}(?!\d)"), 0.85, (), 0, 0),
    ("CARD", re.compile(r"(?<!\d)(?:\d[ -]*?){13,19}(?!\d)"), 0.9, (), 0, 0),
    ("IBAN", re.compile(r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"), 0.95, (), 0, 0),
    ("PASSPORT", re.compile(r"\b[A-Z]{1,2}\d{6,8}\b"), 0.75, (), 0, 0),
    ("BANK_ACCOUNT", re.compile(r"\b\d{10,18}\b"), 0.75, ("account", "a/c", "acc", "iban", "bank"), 12, 12),
    ("DRIVER_LICENSE", re.compile(r"\b[A-Z0-9-]{6,20}\b"), 0.7, ("license", "licence", "dl", "driver"), 16, 4),
    ("DOB", re.compile(r"\b(?:\d{4}-\d{2}-\d{2}|\d{2}[/-]\d{2}[/-]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b", re.I), 0.75, ("dob", "birth", "born"), 12, -1),
    ("POSTAL_CODE", re.compile(r"\b\d{5}(?:-\d{4})?\b"), 0.72, ("zip", "postal", "postcode", "post code"), 16, 8),
    ("IP_ADDRESS", re.compile(r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"), 0.95, (), 0, 0),
    ("IP_ADDRESS", re.compile(r"\b(?:[0-9a-f]{1,4}:){2,7}[0-9a-f]{1,4}\b", re.I), 0.9, (), 0, 0),
    ("URL", re.compile(r"\b(?:https?://|www\.)[^\s<>\"]+\b", re.I), 0.9, (), 0, 0),
    ("USERNAME", re.compile(r"(?<![\w@])@[A-Za-z0-9_.-]{3,32}\b"), 0.7, (), 0, 0),
    ("ADDRESS", re.compile(r"\b\d{1,6}[A-Za-z]?\s+[A-Za-z0-9.\- ]{3,60}\s+(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Block|Sector|Phase|Town|Colony)\b\.?", re.I), 0.72, (), 0, 0),
)
#: Which type wins where two spans are equally long.
PRIORITY = {
    "IBAN": 7, "CARD": 6, "CNIC": 5, "SSN": 5, "EMAIL": 4, "PASSPORT": 4, "BANK_ACCOUNT": 4, "PHONE": 3, "MOBILE": 3, "IP_ADDRESS": 3, "URL": 3, "POSTAL_CODE": 2, "DRIVER_LICENSE": 2, "DOB": 2, "USERNAME": 2, "ADDRESS": 2, "NAME": 2,
    "PASSWORD": 6, "MRN": 5, "BENEFICIARY_ID": 5, "VIN": 5, "LICENSE_CERT": 4, "UNIQUE_ID": 4, "DEVICE_SERIAL": 3, "FAX": 3,
}
BASELINE = frozenset("EMAIL PHONE MOBILE CNIC SSN CARD IBAN IP_ADDRESS URL".split())
#: Words in a column's name and the types that they lead to expect.
HINTS: tuple[tuple[tuple[str, ...], tuple[str, ...]], ...] = (
    (("name", "customer", "person", "employee", "contact"), ("NAME",)),
    (("email", "e-mail", "mail"), ("EMAIL",)),
    (("phone", "mobile", "cell", "contact no", "tel"), ("PHONE", "MOBILE")),
    (("cnic", "national id", "nid"), ("CNIC",)),
    (("ssn",), ("SSN",)),
    (("passport",), ("PASSPORT",)),
    (("card", "credit", "debit", "visa", "mastercard"), ("CARD",)),
    (("account", "bank", "iban", "swift"), ("BANK_ACCOUNT", "IBAN")),
    (("license", "licence", "driver"), ("DRIVER_LICENSE",)),
    (("dob", "birth", "date of birth"), ("DOB",)),
    (("address", "street", "city", "location"), ("ADDRESS",)),
    (("zip", "postal", "postcode", "post code"), ("POSTAL_CODE",)),
    (("ip", "ipv4", "ipv6"), ("IP_ADDRESS",)),
    (("url", "website", "link", "domain"), ("URL",)),
    (("username", "user name", "handle", "login"), ("USERNAME",)),
    (("password", "pwd", "pin", "passcode", "security answer", "security question"), ("PASSWORD",)),
    (("mrn", "medical_record", "med_rec", "patient_id", "patient_number", "chart_number", "chart_no", "emr_id", "ehr_id", "hospital_number"), ("MRN",)),
    (("beneficiary", "member_id", "subscriber_id", "policy_id", "insurance_id", "health_plan", "plan_id", "medicaid_id", "medicare", "hicn", "mbi"), ("BENEFICIARY_ID",)),
    (("fax", "facsimile"), ("FAX",)),
    (("vin", "vehicle_id", "vehicle_ident", "chassis"), ("VIN",)),
    (("serial", "device_id", "device_serial", "implant", "udi", "lot_number", "model_serial", "equipment_id"), ("DEVICE_SERIAL",)),
    (("npi", "dea", "license", "licence", "cert", "certificate", "credential", "provider_id", "physician_id"), ("LICENSE_CERT",)),
    (("uuid", "guid", "unique_id", "record_id", "claim_id", "encounter_id"), ("UNIQUE_ID",)),
)
#: Names that ask for a contact, the form of business codes, what columns of such codes don't hold, and how many values show it.
CONTACT_NAME = re.compile(r"(phone|mobile|tel|fax|landline|\bip\b|ipv4|ipv6)", re.I)
BUSINESS_CODE = re.compile(r"^[A-Z]{2,6}-?\d{4,}[A-Z0-9]*$", re.I)
CONTACT = frozenset(("PHONE", "MOBILE", "IP_ADDRESS"))
CODE_SAMPLE = 200
#: Types whose every form has one of these marks.
MARK = r"[0-9@:]|(?i:www\.)"
MARKED = BASELINE | {"BANK_ACCOUNT", "DOB", "PASSPORT", "POSTAL_CODE", "USERNAME", "ADDRESS", "NAME"}
REGISTRATION = ("company reg", "reg no", "reg.", "registration no", "registration number", "crn", "company number", "companies house", "eori", "vat")
#: Patterns of health identifiers, used in columns whose name asks for them.
HEALTH = {
    "MRN": (r"\b\d{6,10}\b", r"\b[A-Z]{0,3}\d{6,12}\b", r"\b[A-Z0-9]{2,4}-?[A-Z0-9]{4,10}\b"),
    "BENEFICIARY_ID": (r"\b[A-Z0-9]{8,14}\b", r"\b\d{3}-?\d{2}-?\d{4}[A-Z0-9]?\b"),
    "FAX": (r"(?<!\d)(?:\+?1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}(?!\d)",),
    "VIN": (r"\b[A-HJ-NPR-Z0-9]{17}\b",),
    "DEVICE_SERIAL": (r"\b[A-Z0-9]{8,20}\b", r"\b\(01\)\d{14}\b"),
    "LICENSE_CERT": (r"\b\d{10}\b", r"\b[A-Z]{2}\d{7}\b", r"\b[A-Z0-9-]{5,15}\b"),
    "UNIQUE_ID": (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",),
}
#: The identifier class of each type.
IDENTIFIER = {
    "NAME": "hipaa_01_names", "ADDRESS": "hipaa_02_geo_substate", "POSTAL_CODE": "hipaa_02_geo_substate", "DOB": "hipaa_03_dates", "PHONE": "hipaa_04_phone", "MOBILE": "hipaa_04_phone", "FAX": "hipaa_05_fax", "EMAIL": "hipaa_06_email", "SSN": "hipaa_07_ssn",
    "MRN": "hipaa_08_medical_record", "BENEFICIARY_ID": "hipaa_09_health_plan_beneficiary", "BANK_ACCOUNT": "hipaa_10_account_number", "CARD": "hipaa_10_account_number", "IBAN": "hipaa_10_account_number", "LICENSE_CERT": "hipaa_11_license_certificate",
    "DRIVER_LICENSE": "hipaa_11_license_certificate", "VIN": "hipaa_12_vehicle_identifier", "DEVICE_SERIAL": "hipaa_13_device_identifier", "URL": "hipaa_14_url", "IP_ADDRESS": "hipaa_15_ip_address", "CNIC": "hipaa_18_other_unique_id", "PASSPORT": "hipaa_11_license_certificate",
    "UNIQUE_ID": "hipaa_18_other_unique_id",
}
SENSITIVE = ("hipaa_07_ssn", "hipaa_08_medical_record", "hipaa_09_health_plan_beneficiary")


@functools.lru_cache(4096)
def expected_types(column: str | None) -> frozenset[str] | None:
    """Types that a column's name leads to expect; None without any hint, and none at all for company registrations."""
    name = (column or "").strip().lower()
    if not name:
        return None
    if any(w in name for w in REGISTRATION):
        return frozenset()
    spaced = name.replace("_", " ")
    found = {t for words, types in HINTS if any(w in name or w.replace("_", " ") in spaced for w in words) for t in types}
    if "FAX" in found:
        found -= {"PHONE", "MOBILE"}
    return frozenset(found) or None


def allowed_types(column: str | None) -> frozenset[str]:
    hinted = expected_types(column)
    return BASELINE if hinted is None else hinted


def _card(digits: str) -> bool:
    if not 13 <= len(digits) <= 19:
        return False
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _accept(kind: str, value: str) -> str | None:
    digits = re.sub(r"\D", "", value)
    if kind == "CARD":
        return kind if _card(digits) else None
    if kind == "PHONE":
        if value.strip().isdigit() and len(digits) >= 10 and not digits.startswith(("0", "44", "92")):
            return None
        return "MOBILE" if re.search(r"(?:^|\D)03\d{2}", value) else kind
    return kind


def raw_hits(text: str) -> list[dict]:
    out, low = [], text.lower()
    for kind, pattern, score, near, before, after in PATTERNS:
        for m in pattern.finditer(text):
            window = low[max(0, m.start() - before) : m.start() if after < 0 else m.end() + after]
            if (not near or any(w in window for w in near)) and (own := _accept(kind, m.group())):
                out.append({"type": own, "start": m.start(), "end": m.end(), "score": score})
    return out


def resolve(found: list[dict]) -> list[dict]:
    """Spans without overlap: the longest first, then by type, score and place."""
    kept: list[dict] = []
    for h in sorted(found, key=lambda h: (h["start"] - h["end"], -PRIORITY.get(h["type"], 0), -h["score"], h["start"])):
        if all(h["end"] <= k["start"] or h["start"] >= k["end"] for k in kept):
            kept.append(h)
    return sorted(kept, key=lambda h: h["start"])


def hits(text: str, column: str | None = None) -> list[dict]:
    """Spans of a cell: overlaps are resolved before the column's types are applied; a password column is masked whole."""
    allowed = allowed_types(column) if column is not None else frozenset(PRIORITY)
    if "PASSWORD" in allowed and text.strip() and column is not None:
        return [{"type": "PASSWORD", "start": 0, "end": len(text), "score": 1.0}]
    found = raw_hits(text)
    for kind in allowed & HEALTH.keys() if column is not None else ():
        found += [{"type": kind, "start": m.start(), "end": m.end(), "score": 0.6} for p in HEALTH[kind] for m in re.finditer(p, text, re.I) if kind != "VIN" or vin_text(m.group())]
    if column is not None and "BANK_ACCOUNT" in allowed:
        found += [{"type": "BANK_ACCOUNT", "start": m.start(), "end": m.end(), "score": 0.75} for m in re.finditer(r"\b\d{10,18}\b", text)]
    return [h for h in resolve(found) if h["type"] in allowed]


def _stars(value: str, show: int) -> str:
    return "*" * len(value) if show <= 0 or len(value) <= show else "*" * (len(value) - show) + value[-show:]


def mask_value(kind: str, value: str, full: bool = False, show: int = 4) -> str:
    token = f"[{kind}]"
    if full or kind in ("NAME", "DOB", "PASSWORD"):
        return token
    if kind == "EMAIL":
        name, _, domain = value.partition("@")
        return f"{name[:1]}***@{domain}" if domain else token
    digits = [c for c in value if c.isdigit()]
    if kind == "CNIC":
        return "*****-*******-" + digits[-1] if len(digits) >= 13 else _stars(value, 1)
    if kind in ("PHONE", "MOBILE", "CARD", "BANK_ACCOUNT"):
        if not digits:
            return _stars(value, show)
        left = iter(_stars("".join(digits), show))
        return "".join(next(left) if c.isdigit() else c for c in value)
    if kind == "IBAN":
        packed = "".join(c for c in value if c.isalnum())
        return packed[:2] + "*" * (len(packed) - 6) + packed[-4:] if len(packed) > 6 else token
    if kind == "IP_ADDRESS":
        if ":" in value:
            parts = value.split(":")
            return ":".join(["****"] * (len(parts) - 2) + parts[-2:]) if len(parts) > 2 else "****"
        return "x.x.x." + value.rsplit(".", 1)[-1] if value.count(".") == 3 else token
    return _stars(value, max(1, show - 1)) if kind in ("PASSPORT", "POSTAL_CODE", "USERNAME") else token


def mask_text(text: str, found: list[dict], full: bool = False) -> str:
    out, at = [], 0
    for h in found:
        out += [text[at : h["start"]], mask_value(h["type"], text[h["start"] : h["end"]], full)]
        at = h["end"]
    return "".join([*out, text[at:]])


SPANS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
CELL = T.StructType([T.StructField("spans", SPANS), T.StructField("masked", T.StringType())])


def _scan(gone: frozenset[str]):
    @F.pandas_udf(CELL)
    def run(column: pd.Series, text: pd.Series) -> pd.DataFrame:
        found = [[h for h in hits(t, c) if c not in gone or h["type"] not in CONTACT] if t else [] for c, t in zip(column, text, strict=True)]
        return pd.DataFrame({"spans": found, "masked": [mask_text(t, f) if f else t for t, f in zip(text, found, strict=True)]})

    return run.asNondeterministic()  # else each use of its columns would be a scan of its own


def scan(column: str, text: str, code_columns: Sequence[str] = ()):
    """Spans and masked form of cells, each with the name of its column. Columns of business codes hold no phone and no address of a machine."""
    return _scan(frozenset(code_columns))(column, text)


def code_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns of which more than 90 % of the first 200 values look like business codes, unless the name asks for a contact."""
    own = [c for c in columns if not CONTACT_NAME.search(c)]
    if not own:
        return []
    rows = df.select(*[F.trim(col(c).cast("string")).alias(f"c{i}") for i, c in enumerate(own)]).limit(CODE_SAMPLE).collect()
    out = []
    for i, c in enumerate(own):
        some = [r[i] for r in rows if r[i]]
        if some and sum(bool(BUSINESS_CODE.match(v)) for v in some) > 0.9 * len(some):
            out.append(c)
    return out


def findings(df: DataFrame, columns: list[str] | None = None, key: str | None = None) -> DataFrame:
    """(column, key, spans, masked) of every text cell that holds personal data. Values never leave the executors.

    Cells without a digit, @, colon or www. are left out in the JVM, in columns whose types all need one of them.
    """
    own = columns or [c for c, k in kinds(df).items() if k == "string"]
    own = [c for c in own if allowed_types(c)]
    if not own:
        return df.sparkSession.createDataFrame([], f"column string, key {dict(df.dtypes)[key] if key else 'long'}, spans array<struct<type:string,start:int,end:int,score:double>>, masked string")
    value = lambda c: F.when(col(c).cast("string").rlike(MARK), col(c).cast("string")) if allowed_types(c) <= MARKED else col(c).cast("string")
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(c).alias("v")) for c in own]))
    long = df.select((col(key) if key else F.lit(None).cast("long")).alias("key"), cells.alias("x")).select("key", "x.*").where("v is not null")
    return long.select("column", "key", scan("column", "v", code_columns(df, own)).alias("s")).select("column", "key", "s.*").where(F.size("spans") > 0)


def summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, type, hits, rows_with_pii): spans by type, and cells with any. One scan of the cells."""
    found = findings(df, columns).select("column", F.posexplode("spans").alias("i", "h"))
    types = found.groupBy("column", F.col("h.type").alias("type")).agg(F.count("*").alias("hits"), F.count_if(F.col("i") == 0).alias("first"))
    return types.select("column", "type", "hits", F.sum("first").over(Window.partitionBy("column")).alias("rows_with_pii"))


def masked_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """df with the personal data of its text columns masked; rows and other columns stay."""
    own = [c for c in (columns or [c for c, k in kinds(df).items() if k == "string"]) if allowed_types(c)]
    codes = code_columns(df, own)
    for c in own:
        df = df.withColumn(c, F.when(col(c).isNotNull(), _scan(frozenset(codes))(F.lit(c), col(c).cast("string"))["masked"]))
    return df


def display(c: Column) -> Column:
    """Form of a value for queues and logs: an e-mail as its first letter and domain, seven digits or more as stars and the last two."""
    digits = F.length(F.regexp_replace(c, r"\D", ""))
    mail = c.rlike(r"[^@]+@[^@]+\.[^@]+")
    sensitive = (F.length(c) >= 3) & (mail | (c.rlike(r"\+?\d[\d\s\-().]{6,}\d") & (digits >= 7)))
    local, domain = F.substring_index(c, "@", 1), F.substring(c, F.instr(c, "@") + 1, F.length(c))
    hidden = F.when(c.contains("@"), F.concat(F.substring(local, 1, 1), F.lit("***@"), domain)).otherwise(F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(1), F.length(c) - 2)), F.right(c, F.lit(2))))
    return F.when(sensitive, hidden).otherwise(c)


def ages_over_89(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(number(col(column), kinds(df)[column]) >= 90).alias("age_over_89"))


def valid_vins(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_if(vin(col(column))).alias("valid_vins"))


def identifiers(types: DataFrame) -> DataFrame:
    """summary rows -> (identifier, column, hits) by identifier class."""
    pairs = F.create_map(*[F.lit(x) for p in IDENTIFIER.items() for x in p])
    return types.select("column", F.try_element_at(pairs, F.col("type")).alias("identifier"), "hits").where("identifier is not null").groupBy("identifier", "column").agg(F.sum("hits").alias("hits"))


def exposure(found: DataFrame) -> DataFrame:
    """One row of identifiers() rows: status, counts, exposure score and severity."""
    one = found.agg(F.collect_set("identifier").alias("ids"), F.count_distinct("column").alias("columns_affected"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    n, c = F.size("ids"), F.col("columns_affected")
    some = F.arrays_overlap("ids", F.array(*map(F.lit, SENSITIVE)))
    combo = F.forall(F.array(*map(F.lit, ("hipaa_07_ssn", "hipaa_01_names", "hipaa_03_dates"))), lambda x: F.array_contains("ids", x))
    score = F.least(F.lit(100.0), F.least(F.lit(100.0), n * 10.0) + F.least(F.lit(30.0), c * 3.0) + F.least(F.lit(40.0), F.log10(F.greatest("hits", F.lit(1))) * 15.0) + F.when(some, 20.0).otherwise(0.0))
    level = F.when(n == 0, "none").when((n >= 4) | combo, "high").when(some | (n >= 2) | (c >= 2), "medium").otherwise("low")
    return one.select(F.when(n > 0, "PHI_DETECTED").otherwise("NO_PHI_DETECTED").alias("status"), n.cast("long").alias("identifiers_detected"), "columns_affected", "hits", F.when(n > 0, F.round(score, 2)).otherwise(0.0).alias("exposure_score"), level.alias("severity"))
