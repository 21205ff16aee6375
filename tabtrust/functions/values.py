"""Scalar functions over columns: coercion, normalisation, similarity, checksums and report bands."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|inf|infinity)\s*$"
#: Tried in turn: month first, then day first.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "MMM d, yyyy", "yyyyMMdd", "yyyy")
#: The number of each VIN character, and the weights of the 17 places.
VIN_VALUES = {
    "0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "8": 8, "9": 9, "A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8,
    "J": 1, "K": 2, "L": 3, "M": 4, "N": 5, "P": 7, "R": 9, "S": 2, "T": 3, "U": 4, "V": 5, "W": 6, "X": 7, "Y": 8, "Z": 9,
}
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
MOJIBAKE = "Ã.|Â.|â€|ï¿½|Å.|Ä."


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def absent(c: Column, kind: str) -> Column:
    """Null, or NaN in a floating-point column."""
    return c.isNull() | F.isnan(c) if kind in ("double", "float") else c.isNull()


def number(c: Column, kind: str = "string") -> Column:
    """A double, null for what is no number (NaN too)."""
    if kind != "string":
        return F.when(~absent(c, kind), c.cast("double"))
    return F.when(c.rlike(f"(?i){NUMBER}"), c.try_cast("double"))


def loose_number(c: Column) -> Column:
    """As number, but thousands separators are let through (type check only)."""
    return number(F.replace(F.trim(c), F.lit(","), F.lit("")))


def moment(c: Column, kind: str = "string") -> Column:
    """A timestamp from a date, timestamp or text in one of DATE_FORMATS; numbers are no dates."""
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return c.cast("timestamp")
    if kind != "string":
        return F.lit(None).cast("timestamp")
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_FORMATS])


def normal(c: Column) -> Column:
    """Trimmed, lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def safe_normal(punctuation: bool = False):
    """NFKC, trimmed, white space collapsed, case folded; with punctuation=True punctuation becomes space."""

    def run(values: pd.Series) -> pd.Series:
        def one(v):
            if v is None:
                return None
            text = unicodedata.normalize("NFKC", v)
            if punctuation:
                text = "".join(" " if unicodedata.category(ch)[0] == "P" else ch for ch in text)
            return " ".join(text.split()).casefold()

        return values.map(one)

    return F.pandas_udf(run, T.StringType())


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, one bit a place of a."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Normalised Indel similarity of two texts, 0 to 100, of case-folded forms."""
    a, b = a.casefold(), b.casefold()
    return 100.0 if not a and not b else 200.0 * lcs_length(a, b) / (len(a) + len(b))


def ratio_sql(a: str, b: str) -> Column:
    """The same as ratio for ASCII case, from higher-order functions: stays in the JVM."""
    lcs = (
        f"element_at(aggregate(filter(split(lower({a}), ''), x -> x <> ''), array_repeat(0, length({b}) + 1), (prev, ch) -> aggregate(if(length({b}) = 0, array(), sequence(1, length({b}))), array(0), "
        f"(r, j) -> concat(r, array(if(substring(lower({b}), j, 1) = ch, prev[j - 1] + 1, greatest(prev[j], r[j - 1])))))), -1)"
    )
    return F.expr(f"if(length({a}) + length({b}) = 0, 100D, 200D * {lcs} / (length({a}) + length({b})))")


def json_rows(df: DataFrame) -> DataFrame:
    """One column json: every row as an object with all its columns; NaN and infinite numbers become null."""
    safe = [F.when(~F.isnan(col(c)) & (F.abs(col(c)) != float("inf")), col(c)).alias(c) if k in ("double", "float") else col(c) for c, k in df.dtypes]
    return df.select(F.to_json(F.struct(*safe), {"ignoreNullFields": "false"}).alias("json"))


def rounded(x: Column, places: int = 4) -> Column:
    """Rounded by the scaled double, as most engines do, so that ties fall alike."""
    return F.round(x * 10.0**places) / 10.0**places


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def luhn(c: Column) -> Column:
    digits = F.regexp_replace(c, r"\D", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def vin(c: Column) -> Column:
    """17 characters with the right check digit."""
    up = F.upper(c)
    value = F.create_map(*[F.lit(x) for pair in VIN_VALUES.items() for x in pair])
    total = reduce(lambda s, x: s + x, [F.try_element_at(value, F.substring(up, i + 1, 1)) * w for i, w in enumerate(VIN_WEIGHTS)])
    want = F.when(total % 11 == 10, F.lit("X")).otherwise((total % 11).cast("string"))
    return F.coalesce(up.rlike("^[A-HJ-NPR-Z0-9]{17}$") & (F.substring(up, 9, 1) == want), F.lit(False))


def vin_text(text: str) -> bool:
    """The same of one text."""
    up = text.upper()
    if len(up) != 17 or any(ch not in VIN_VALUES for ch in up):
        return False
    rest = sum(VIN_VALUES[ch] * w for ch, w in zip(up, VIN_WEIGHTS, strict=True)) % 11
    return up[8] == ("X" if rest == 10 else str(rest))


#: The characters that Windows-1252 has where Latin-1 has control codes, in the order of those codes.
WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CONTROLS = "".join(bytes(w, "cp1252").decode("latin-1") for w in WINDOWS)


def repaired(c: Column) -> Column:
    """Text that was UTF-8 read as Windows-1252, read again; other text as it is."""
    plain = F.translate(c, WINDOWS, CONTROLS)
    single = c.rlike(MOJIBAKE) & plain.rlike("^[\\x{0}-\\x{ff}]*$")
    raw = F.encode(F.when(single, plain), "iso-8859-1").cast("string")
    return F.coalesce(F.when(F.is_valid_utf8(raw), raw), c)


def band(value: Column, steps: tuple[tuple[float, str], ...], last: str, none: str) -> Column:
    out = F.when(value.isNull(), none)
    for least, name in steps:
        out = out.when(value >= least, name)
    return out.otherwise(last)


def severity(share: Column) -> Column:
    return F.when(share > 0, band(share, ((0.5, "Critical"), (0.2, "High"), (0.05, "Medium")), "Low", "None")).otherwise("None")


def rating(score: Column) -> Column:
    return band(score, ((90, "Excellent"), (75, "Good"), (55, "Fair")), "Poor", "Unrated")


def readiness(score: Column) -> Column:
    return band(score, ((90, "Ready"), (75, "Ready with Minor Cleaning"), (55, "Ready with Moderate Cleaning")), "Not Recommended", "Not Recommended")


def frequency(gap_days: Column) -> Column:
    """Label of the median gap between dates."""
    return F.when(gap_days <= 1.5, "daily").when(gap_days.between(5, 9), "weekly").when(gap_days.between(25, 35), "monthly").when(gap_days.between(80, 100), "quarterly").when(gap_days.between(350, 380), "yearly").otherwise("irregular")


def range_of(x: Column, cuts: list) -> Column:
    """The number of sorted, distinct cuts below a value: its range. Counted among every 64th cut first."""
    if not cuts:
        return F.lit(0)
    below = lambda some: F.size(F.filter(some, lambda c: c < x))
    lists = F.array(*[F.array(*map(F.lit, cuts[i : i + 64])) for i in range(0, len(cuts), 64)])
    chunk = F.greatest(F.lit(1), below(F.array(*map(F.lit, cuts[::64]))))
    return ((chunk - 1) * 64 + below(F.element_at(lists, chunk))).cast("int")
