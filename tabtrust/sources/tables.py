"""Sources and sinks: Parquet, CSV and XLSX tables with a header found in the first rows; results, event logs and run history."""

from __future__ import annotations

import datetime as dt
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabtrust.functions.values import range_of

SUPPORTED = (".xlsx", ".xlsm", ".xltx", ".xltm", ".xls", ".csv")
MAX_BYTES = 200 * 1024 * 1024
SCAN_ROWS, LOOK_AHEAD = 15, 5
MIN_CONFIDENCE = 0.8
#: Cells that a CSV reader takes as null, words of header cells, and forms of ids and numbers.
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
HEADER_WORD = re.compile(r"(name|code|date|desc|qty|quantity|address|customer|supplier|product|ref|amount|price|cost|site|order|invoice|phone|fax|country|city|post|number|line|status|currency|margin|stock|lot|pack|value|terms|vat)", re.I)
ID_LIKE = re.compile(r"^[A-Z]{1,6}\d{3,}[A-Z0-9-]*$", re.I)
NUMBER_LIKE = re.compile(r"^-?\d+([.,]\d+)?$")


def magic(head: bytes) -> str | None:
    """zip (Office Open XML), ole (old Office) or None, by the first bytes."""
    return "zip" if head[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08") else "ole" if head[:4] == b"\xd0\xcf\x11\xe0" else None


def encoding(head: bytes) -> str:
    """Of a sample of bytes: a byte-order mark, else the first of UTF-8, Windows-1252 and Latin-1 that decodes it strictly."""
    if head.startswith(b"\xef\xbb\xbf"):
        return "utf-8-sig"
    if head.startswith((b"\xff\xfe", b"\xfe\xff")):
        return "utf-16"
    for name in ("utf-8", "cp1252", "latin-1"):
        try:
            head[: len(head) - 3 if name == "utf-8" and len(head) > 1000 else None].decode(name)
            return name
        except UnicodeDecodeError:
            continue
    return "utf-8"


def encoding_check(head: bytes) -> dict:
    """(status, encoding, confidence, reason) of the first bytes of a text file: a byte-order mark or strict UTF-8 is sure; other
    bytes could be any one-byte encoding, so their confidence is under the least that passes, and the encoding is a proposal."""
    if not head:
        return {"status": "failed", "encoding": None, "confidence": 0.0, "reason": "empty_bytes"}
    found = encoding(head)
    sure = 1.0 if found in ("utf-8-sig", "utf-16") or head.isascii() else 0.99 if found == "utf-8" else 0.73 if found == "cp1252" else 0.5
    return {"status": "passed" if sure >= MIN_CONFIDENCE else "failed", "encoding": found, "confidence": sure, "reason": None if sure >= MIN_CONFIDENCE else "low_confidence"}


def kind(spark: SparkSession, path: str) -> tuple[str, bytes]:
    """(csv, xlsx or xls; first 100,000 bytes) of a file, read by Spark so that any store does."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name.startswith("~$") or not name.lower().endswith(SUPPORTED):
        raise ValueError(f"unsupported file: {name}")
    row = spark.read.format("binaryFile").load(path).select("length", F.substring("content", 1, 100_000).alias("head")).first()
    if row is None:
        raise FileNotFoundError(path)
    if row["length"] > MAX_BYTES and not name.lower().endswith(".csv"):
        raise ValueError("spreadsheets are read whole and may have 200 MB at most")
    found = magic(bytes(row["head"]))
    return ("xlsx" if found == "zip" else "xls" if found == "ole" else "csv"), bytes(row["head"])


def _string_share(row: Sequence) -> float:
    texts = [str(c).strip() for c in row if c is not None and str(c).strip()]
    return sum(not NUMBER_LIKE.match(t) for t in texts) / len(row) if row else 0.0


def _same_kind(rows: list[Sequence], i: int) -> float:
    """How alike the cells under row i are, by column."""
    scores = []
    for c in range(len(rows[i])):
        below = [str(r[c]).strip() for r in rows[i + 1 : i + 1 + LOOK_AHEAD] if c < len(r) and r[c] is not None and str(r[c]).strip()]
        if len(below) >= 2:
            numbers = sum(bool(NUMBER_LIKE.match(v)) for v in below)
            scores.append(max(numbers, len(below) - numbers) / len(below))
        else:
            scores.append(0.5 if below else 0.0)
    return sum(scores) / len(scores) if scores else 0.0


def _label(row: Sequence) -> float:
    texts = [str(c).strip() for c in row if c is not None and str(c).strip()]
    if not texts:
        return 0.0
    return sum(bool(HEADER_WORD.search(t)) for t in texts) / len(texts) + 0.25 * len({t.lower() for t in texts}) / len(texts) - sum(bool(ID_LIKE.match(t)) for t in texts) / len(texts)


def header_row(rows: list[Sequence], scan: int = SCAN_ROWS) -> int:
    """Index of the header in the first rows, -1 for none."""
    width = max((sum(c is not None and str(c).strip() != "" for c in r) for r in rows), default=0)
    scores = []
    for i, row in enumerate(rows[:scan]):
        full = sum(c is not None and str(c).strip() != "" for c in row)
        if not full:
            continue
        sparse = max(0.0, 0.5 - full / max(1, width)) * 2
        score = _string_share(row) + _same_kind(rows, i) + 1.25 * _label(row) - sparse + max(0.0, (scan - i) * 0.001)
        scores.append((score, -i))
        if _string_share(row) == 0 or (full < 2 and width > 1):
            scores.pop()
    best = max(scores, default=None)
    return -best[1] if best and best[0] >= 0.15 else -1


def unique_names(cells: Sequence) -> list[str]:
    """Trimmed names, unnamed_i for blank ones; the second x is x_1, the third x_2, or the next number that no other name has."""
    plain = [str(c).strip() if c is not None and str(c).strip() else f"unnamed_{i}" for i, c in enumerate(cells)]
    out: list[str] = []
    seen: dict[str, int] = {}
    for name in plain:
        n = seen.get(name, 0)
        own = name if not n else f"{name}_{n}"
        while n and (own in plain or own in out):
            n += 1
            own = f"{name}_{n}"
        seen[name] = n + 1
        out.append(own)
    return out


def merged_names(parent: Sequence, child: Sequence) -> list[str]:
    """Two header rows as one, if at least 40 % of the parent's cells are text."""
    if _string_share(parent) < 0.4:
        return unique_names(child)
    return unique_names([" ".join(str(x).strip() for x in (p, c) if x is not None and str(x).strip()) for p, c in zip(parent, child, strict=False)])


def with_header(raw: DataFrame, header: int | None = None) -> DataFrame:
    """raw (_rid, c0..) -> named columns below the header, rows without any cell dropped, _rid from 0.

    Only the first rows go to the driver. Row numbers come from offsets of ranges, not from one global window.
    """
    cells = [c for c in raw.columns if c != "_rid"]
    head = [tuple(r) for r in raw.where(F.col("_rid") < SCAN_ROWS + LOOK_AHEAD).orderBy("_rid").select(*cells).collect()]
    at = header_row(head) if header is None else header
    names = unique_names(head[at]) if at >= 0 else [f"unnamed_{i}" for i in range(len(cells))]
    body = raw.where(F.col("_rid") > at).dropna(how="all", subset=cells)
    return numbered(body, "_rid").select("_rid", *[F.col(c).alias(n) for c, n in zip(cells, names, strict=True)])


#: Rows that one range of row numbers has, about, as long as there are no more than RANGES.
RANGE_ROWS, RANGES = 1_000_000, 4096


def numbered(df: DataFrame, order: str) -> DataFrame:
    """_rid becomes 0, 1, ... in the order of a column with numbers; nulls come first, equal values in any order.

    Ranges are cut by value: the bounds are quantiles of the column, one for each RANGE_ROWS rows, and a row's range follows from
    its own value alone, so that no two evaluations of df can put it into different ones. Ranges are numbered apart, in
    parallel, and shifted by the sizes of those before them. df is read several times and must be repeatable (a file or
    table). A value that is repeated more often than a range has rows makes a larger range.
    """
    names, place = [c for c in df.columns if c != "_rid" or c == order], F.col(f"`{order}`")
    n = df.count()
    parts = min(RANGES, -(-n // RANGE_ROWS))
    cuts = df.select(F.percentile_approx(place, [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first()["q"] if parts > 1 else []
    cuts = sorted({c for c in cuts or () if c is not None})  # RANGES numbers at most
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.coalesce(range_of(place, cuts), F.lit(0)).alias("_p"))
    sizes = {r["_p"]: r["n"] for r in rows.groupBy("_p").agg(F.count("*").alias("n")).collect()}  # a row a range
    before, total = {}, 0
    for p in sorted(sizes):
        before[p] = total
        total += sizes[p]
    shift = F.element_at(F.array(*[F.lit(before.get(i, 0)).cast("long") for i in range(len(cuts) + 1)]), F.col("_p") + 1)
    own = F.row_number().over(Window.partitionBy("_p").orderBy(place)) - 1
    return rows.withColumn("_rid", (shift + own).cast("long")).select("_rid", *[F.col(f"`{c}`") for c in names if c not in ("_rid", "_p")])


def preview(raw: DataFrame, at: int, around: int = 5) -> DataFrame:
    return raw.where(F.col("_rid").between(at - around, at + around)).orderBy("_rid")


def read_csv(spark: SparkSession, path: str, head: bytes) -> DataFrame:
    """All cells as text, with row numbers; the delimiter is the commonest in the first lines; short rows are padded."""
    enc = encoding(head)
    lines = head.decode(enc, errors="ignore").splitlines()[:10]
    sep = max(",;\t|", key=lambda s: (min((x.count(s) for x in lines if x.strip()), default=0), -",;\t|".index(s)))
    width = max((x.count(sep) + 1 for x in lines), default=1)
    schema = ", ".join(f"c{i} string" for i in range(width))
    java = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp1252": "windows-1252", "latin-1": "ISO-8859-1", "utf-16": "UTF-16"}[enc]
    raw = spark.read.csv(path, schema=schema, sep=sep, header=False, encoding=java, multiLine=enc == "utf-16", mode="PERMISSIVE")
    cells = [F.when(~F.trim(c).isin(*NULL_TOKENS), F.regexp_replace(c, "^﻿", "")).alias(c) for c in raw.columns]
    return numbered(raw.select(F.monotonically_increasing_id().alias("_rid"), *cells), "_rid").select("_rid", *raw.columns)


NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _text(node: ET.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{{{NS['m']}}}t"))


def workbook(data: bytes) -> list[tuple[str, bool, str]]:
    """(sheet, visible, part) of an Office Open XML workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book, links = ET.fromstring(z.read("xl/workbook.xml")), ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        part = {x.get("Id"): x.get("Target") for x in links}
        return [(s.get("name"), s.get("state", "visible") == "visible", "xl/" + part[s.get(f"{{{NS['r']}}}id")].removeprefix("/xl/")) for s in book.iterfind("m:sheets/m:sheet", NS)]


def visible_sheets(data: bytes) -> list[str]:
    """Names of visible sheets; all if all are hidden."""
    found = workbook(data)
    return [n for n, shown, _ in found if shown] or [n for n, _, _ in found]


def _place(ref: str) -> int:
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def sheet_rows(data: bytes, sheet: str) -> Iterator[list[str | None]]:
    """Rows of a sheet as text, blank cells as None; parsed as a stream."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_text(x) for x in ET.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", NS)] if "xl/sharedStrings.xml" in z.namelist() else []
        part = next(p for n, _, p in workbook(data) if n == sheet)
        for _, row in ET.iterparse(z.open(part)):
            if row.tag != f"{{{NS['m']}}}row":
                continue
            cells: list[str | None] = []
            for c in row.iterfind("m:c", NS):
                at = _place(c.get("r") or "") if c.get("r") else len(cells)
                cells += [None] * (at - len(cells))
                v, form = c.find("m:v", NS), c.get("t")
                text = shared[int(v.text)] if form == "s" and v is not None else _text(c) if form == "inlineStr" else {"1": "TRUE", "0": "FALSE"}.get(v.text, v.text) if form == "b" and v is not None else v.text if v is not None else None
                cells.append(text if text not in (None, "") else None)
            yield cells
            row.clear()


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> dict[str, DataFrame]:
    """Raw sheets of a workbook in any store: the file (200 MB at most) goes to one task a sheet, as its format can't be split."""
    files = spark.read.format("binaryFile").load(path)
    names = [sheet] if sheet else None
    if names is None:
        names = [r["n"] for r in files.select(_sheet_names("content").alias("n")).select(F.explode("n").alias("n")).collect()]
    out = {}
    for name in names:
        rows = files.select(_sheet_cells(name)("content").alias("rows")).select(F.posexplode("rows").alias("_rid", "cells"))
        width = rows.agg(F.coalesce(F.max(F.size("cells")), F.lit(0))).first()[0]
        if width:
            out[name] = rows.select(F.col("_rid").cast("long").alias("_rid"), *[F.try_element_at("cells", F.lit(i + 1)).alias(f"c{i}") for i in range(width)])
    return out


def _sheet_names(column: str):
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda d: visible_sheets(bytes(d)))

    return F.pandas_udf(run, "array<string>")(column)


def _sheet_cells(name: str):
    def run(content: pd.Series) -> pd.Series:
        return content.map(lambda d: list(sheet_rows(bytes(d), name)))

    return F.pandas_udf(run, "array<array<string>>")


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Every visible sheet of a CSV or XLSX file, or a Parquet folder, as a table with a header and _rid."""
    if path.rstrip("/").lower().endswith(".parquet"):
        return {path.rstrip("/").rsplit("/", 1)[-1][:-8]: spark.read.parquet(path)}
    form, head = kind(spark, path)
    if form == "xls":
        raise ValueError("old binary workbooks (.xls) are not supported; save as .xlsx")
    raw = read_xlsx(spark, path) if form == "xlsx" else {path.rsplit("/", 1)[-1].rsplit(".", 1)[0]: read_csv(spark, path, head)}
    return {name: with_header(df) for name, df in raw.items()}


def reference_values(df: DataFrame, words: Sequence[str]) -> DataFrame:
    """Distinct trimmed values of the first column whose name equals, else contains, one of the words."""
    low = {c.strip().lower(): c for c in df.columns}
    own = next((low[w] for w in words if w in low), None) or next((c for n, c in low.items() for w in words if w in n), None)
    if own is None:
        raise ValueError(f"no column like {', '.join(words)}")
    return df.select(F.trim(F.col(f"`{own}`").cast("string")).alias("value")).where("value is not null and value <> ''").distinct()


def append(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Results, manifests or events; JSON lines for logs."""
    df.write.mode("append").format(form).save(path)


def event(spark: SparkSession, path: str, run_id: str, name: str, **facts: str) -> None:
    now = dt.datetime.now(dt.UTC).isoformat()
    append(spark.createDataFrame([(run_id, name, now, facts)], "run_id string, event string, at string, facts map<string,string>"), path, "json")


def runs(spark: SparkSession, path: str, client: str | None = None, most: int = 50) -> DataFrame:
    """Newest runs first; a list report of at most `most` rows."""
    df = spark.read.parquet(path)
    return (df if client is None else df.where(F.col("client") == client)).orderBy(F.desc("completed_at")).limit(most)


def html_report(title: str, results: DataFrame, score: float, most: int = 100) -> str:
    """A page with the first rows of the results."""
    import html

    rows = results.orderBy(F.desc("issues_found"), "check_name", "column").limit(most).collect()
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows)
    head = "".join(f"<th>{html.escape(c)}</th>" for c in results.columns)
    return f"<!doctype html><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><p>Score: {score}</p><table><tr>{head}</tr>{body}</table>"
