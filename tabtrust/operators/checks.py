"""Checks of a table. Each gives rows of one shape (RESULT), from as few passes over the table as its semantics allow.

Counts of all columns come from one aggregate; distinct values from one unpivoted aggregate. Sample row ids need the
column `_rid` and are only taken where it exists.
"""

from __future__ import annotations

import dataclasses
import json
import math
import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabtrust.functions.values import absent, col, loose_number, moment, normal, number, range_of

RESULT = "check_name string, column string, status string, issues_found long, total long, quality_ratio double, dimension string, reason string"
SAMPLE_IDS = 100
#: Names of columns that hold counts, and of columns in which a zero is suspicious.
NON_NEGATIVE = re.compile(r"\b(qty|quantity|count|age|stock|units?|weight|hours?|days?)\b", re.I)
SUSPICIOUS_ZERO = ("GBP Amt-tax", "Amt-tax", "Margin%", "Cost", "Net Sell Price GBP", "Line Cost Price GBP", "Avg Cost of Current Stock", "Cumulative Avg Cost (GBP)", "Standard Cost", "Usage Per Week")
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"
GENERATED_NAME = re.compile(r"^unnamed[:_]\s*\d+$", re.I)
VAGUE_NAME = re.compile(r"^(column|col|field|data|value|val|attribute|attr|var|variable|temp|tmp)[\s_]*\d*$", re.I)
DATE_RULES = (("Expected Del Date", ">=", "Order Date"), ("Ship Date", ">=", "Order Date"), ("Expected  Del. Date", ">=", "SO Date Created"))
STALE_DAYS = 90


def kinds(df: DataFrame) -> dict[str, str]:
    return {c: k for c, k in df.dtypes if c != "_rid"}


def _row(check: str, column: Column | str, issues: Column, total: Column, dimension: str, ratio: Column | None = None, reason: Column | None = None) -> Column:
    """One RESULT row as a struct; passed without issues, and quality is the share of rows without one."""
    share = F.when(total > 0, F.round(F.lit(1.0) - F.try_divide(issues, total), 6)).otherwise(F.lit(1.0)) if ratio is None else ratio
    return F.struct(
        F.lit(check).alias("check_name"), (F.lit(column) if isinstance(column, str) else column).alias("column"), F.when(issues > 0, "failed").otherwise("passed").alias("status"), issues.cast("long").alias("issues_found"),
        total.cast("long").alias("total"), share.alias("quality_ratio"), F.lit(dimension).alias("dimension"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"),
    )


#: Tests of rows: (check, dimension, label -> (is an issue, is assessed)).
Tests = tuple[str, str, dict[str, tuple[Column, Column]]]


#: Further aggregates of one pass, and the RESULT rows that are made of them.
More = tuple[list[Column], list[Column]]


def counted(df: DataFrame, groups: Sequence[Tests], more: Sequence[More] = ()) -> DataFrame:
    """A row for each label, then those of `more`. All is counted by one aggregate, in one pass over the table."""
    flat = [(check, dimension, label, issue, seen) for check, dimension, tests in groups for label, (issue, seen) in tests.items()]
    aggs = [a for own, _ in more for a in own]
    if not flat and not aggs:
        return df.sparkSession.createDataFrame([], RESULT)
    bad = [F.count_if(F.coalesce(issue & seen, F.lit(False))).alias(f"b{i}") for i, (_, _, _, issue, seen) in enumerate(flat)]
    all_ = [F.count_if(F.coalesce(seen, F.lit(False))).alias(f"n{i}") for i, (_, _, _, _, seen) in enumerate(flat)]
    rows = [_row(check, label, F.col(f"b{i}"), F.col(f"n{i}"), dimension) for i, (check, dimension, label, _, _) in enumerate(flat)]
    return df.agg(*bad, *all_, *aggs).select(F.inline(F.array(*rows, *[r for _, own in more for r in own])))


def side_by_side(spark: SparkSession, parts: Sequence[Callable[[], DataFrame]]) -> DataFrame:
    """The RESULT rows of checks that don't need each other, in their order. Each is planned and run in a thread of the driver, so that the passes of one fill the cores
    while another is planned or waits for its last task. A check has a row a column, so the rows fit the driver."""
    if not parts:
        return spark.createDataFrame([], RESULT)
    keep = inheritable_thread_target(spark)  # a thread has its caller's job group, pool and tags; where threads aren't pinned this is the session
    runs = [lambda part=part: part().collect() for part in parts]
    with ThreadPoolExecutor(len(parts)) as pool:
        found = list(pool.map(lambda run: run(), runs if keep is spark else map(keep, runs)))
    schema = StructType.fromDDL(RESULT)
    return spark.createDataFrame(pa.Table.from_pylist([row.asDict() for rows in found for row in rows], to_arrow_schema(schema)), schema)  # a table of Arrow needs no Python workers


def missing_tests(df: DataFrame) -> list[Tests]:
    return [("missing_values", "completeness", {c: (absent(col(c), k), F.lit(True)) for c, k in kinds(df).items()})]


def missing(df: DataFrame) -> DataFrame:
    """Null or NaN cells of each column; a blank text is not missing."""
    return counted(df, missing_tests(df))


def sample_ids(df: DataFrame, issue: Column, most: int = SAMPLE_IDS) -> DataFrame:
    """The first `most` row ids with the issue; a report feature."""
    return df.where(issue).select("_rid").orderBy("_rid").limit(most)


def type_kinds(df: DataFrame, column: str) -> DataFrame:
    """(kind, n): number or string of a text column's cells, blank as null."""
    cell = F.nullif(F.trim(col(column)), F.lit(""))
    kind = F.when(cell.isNull(), "null").when(loose_number(cell).isNotNull(), "number").otherwise("string")
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def type_mismatch(df: DataFrame) -> DataFrame:
    """Cells that are not of a column's dominant kind. Typed columns have one kind; text columns where most cells are numbers have two."""
    texts = [c for c, k in kinds(df).items() if k == "string"]
    # a text is trimmed once and loses its separators once, below the aggregate
    own = df.withColumns({f"_t{i}": F.trim(col(c)) for i, c in enumerate(texts)}) if texts else df
    bare = {f"_x{i}": F.when(F.col(f"_t{i}") != "", F.replace(F.col(f"_t{i}"), F.lit(","), F.lit(""))) for i in range(len(texts))}
    own = own.withColumns(bare) if texts else own
    return counted(own, typed_tests(df), [_text_counts(texts, [(number(F.col(x)), F.col(x)) for x in bare])])


def text_kinds(df: DataFrame) -> More:
    """The type_mismatch rows of text columns."""
    cells = {c: F.nullif(F.trim(col(c)), F.lit("")) for c, k in kinds(df).items() if k == "string"}
    return _text_counts(list(cells), [(loose_number(x), x) for x in cells.values()])


def _text_counts(columns: Sequence[str], cells: Sequence[tuple[Column, Column]]) -> More:
    """cells: (number, text) of each column, null where it is none."""
    aggs = [a for i, (n, x) in enumerate(cells) for a in (F.count(n).alias(f"numbers{i}"), F.count(x).alias(f"texts{i}"))]
    return aggs, [_text_kind(c, F.col(f"numbers{i}"), F.col(f"texts{i}")) for i, c in enumerate(columns)]


def _text_kind(column: Column | str, numbers: Column, texts: Column) -> Column:
    return _row("type_mismatch", column, F.when(numbers * 2 > texts, texts - numbers).otherwise(0), texts, "type_reliability")


def known_text_kinds(df: DataFrame, found: Sequence[dict]) -> DataFrame:
    """text_kinds() of columns that have been classified, from the numbers found then."""
    by = kinds(df)
    rows = df.sparkSession.createDataFrame([(r["column"], r["loose"], r["texts"]) for r in found if by[r["column"]] == "string"], "column string, loose long, texts long")
    return rows.select(_text_kind(F.col("column"), F.col("loose"), F.col("texts")).alias("r")).select("r.*")


def typed_tests(df: DataFrame) -> list[Tests]:
    """Columns of a type other than text hold no cell of another one."""
    return [("type_mismatch", "type_reliability", {c: (F.lit(False), ~absent(col(c), k)) for c, k in kinds(df).items() if k != "string"})]


def _key(df: DataFrame, keys: Sequence[str]) -> list[Column]:
    """Key columns with texts trimmed, blank as null."""
    by = kinds(df)
    return [(F.nullif(F.trim(col(c)), F.lit("")) if by[c] == "string" else col(c)).alias(f"k{i}") for i, c in enumerate(keys)]


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(k0.., n) of keys that more than one row has; nulls are equal."""
    return df.groupBy(*_key(df, keys)).agg(F.count("*").alias("n")).where("n > 1")


#: Hash codes of more than one row that are looked at one by one, at most.
MANY = 100_000


def _repeated(df: DataFrame, keys: Sequence[str]) -> list[int] | None:
    """Hash codes of keys that more than one row has; None if there are more than MANY, or if keys are short or of a type without a hash code.

    Codes alone are shuffled and sorted, which takes less than whole keys where nearly all differ; of each code two rows at most leave a task.
    """
    by = kinds(df)
    if len(keys) < 3 or any(t in by[c] for c in keys for t in ("map", "collate", "variant")):
        return None
    place = F.row_number().over(Window.partitionBy("h").orderBy("h"))
    codes = df.select(F.xxhash64(*_key(df, keys)).alias("h")).withColumn("n", place).where("n = 2").select("h")
    found = codes.limit(MANY + 1).agg(F.collect_list("h").alias("h")).first()["h"]
    return found if len(found) <= MANY else None


def duplicates(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each key (all columns by default); reason holds the number of rows in such groups.

    Equal keys have equal hash codes, so only rows whose code repeats are grouped, by their whole keys; all are, where many codes repeat.
    """
    own = list(keys or kinds(df))
    codes, rows = _repeated(df, own), df
    if codes is not None:
        some = df.sparkSession.createDataFrame([(h,) for h in codes], "h long")
        rows = df.join(F.broadcast(some), F.xxhash64(*_key(df, own)) == F.col("h"), "left_semi") if codes else df.where("false")
    groups = rows.groupBy(*_key(df, own)).agg(F.count("*").alias("n"))
    one = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    if codes is not None:
        one = one.drop("total").crossJoin(df.agg(F.count("*").alias("total")))
    name = "duplicate_rows" if keys is None else "duplicate_keys"
    return one.select(_row(name, "+".join(own) if keys else "*", F.col("extra"), F.col("total"), "uniqueness", reason=F.concat(F.lit("rows in groups: "), F.col("rows").cast("string"))).alias("r")).select("r.*")


def duplicate_rows(df: DataFrame, keys: Sequence[str], order: str, first: bool = True) -> DataFrame:
    """The rows that repeat a key: all but the first by `order`, or (first=False) all of the group."""
    w = Window.partitionBy(*_key(df, keys))
    mark = F.row_number().over(w.orderBy(col(order))) if first else F.count("*").over(w)
    return df.withColumn("_n", mark).where("_n > 1").drop("_n")


#: Values between two bounds that are counted one by one, at most; parts into which more of them are cut; parts of a power of two.
HELD, ACCURACY, BINADE = 50_000, 4_096, 256
#: Parts of the first pass between two neighbouring eighth roots, and their number on a side of zero, at most.
ROOTS, MOST_ROOTS = 2_048, 1_000_000


def _root(x: Column) -> Column:
    """A whole number that never falls when x rises: parts of the eighth root, which is three quick instructions where a logarithm is a call. The outer parts are open."""
    size = F.least(F.sqrt(F.sqrt(F.sqrt(F.abs(x)))) * ROOTS, F.lit(float(MOST_ROOTS))).cast("int")
    return F.when(x < 0, -1 - size).otherwise(size)


def _binade(x: Column) -> Column:
    """A whole number that never falls when x rises: parts of powers of two. Zero and infinite values have parts of their own."""
    size = F.floor(F.least(F.ln(F.abs(x)) * (BINADE / math.log(2)), F.lit(1025.0 * BINADE))) + 1076 * BINADE  # one logarithm; log2 takes two
    return F.when(x == 0, 0).when(x > 0, size).otherwise(-size).cast("int")  # short keys are counted faster than fractions


def _cut(x: Column, low: float, high: float, n: int, held: int, accuracy: int) -> Column:
    """The part of a number of n between low and high: itself, if few; else of powers of two, or of even parts where they lie within one."""
    if n <= held:
        return x
    if low > 0 and low >= high / 2 or high < 0 and high <= low / 2:  # halves: doubled, the largest numbers were infinite
        return F.floor((x - low) / (high - low) * accuracy).cast("double")
    return _binade(x).cast("double")


def _counted(cells: DataFrame, *keys: str) -> DataFrame:
    return cells.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def _wanted(parts: DataFrame, ranks: Callable[[Column], list[Column]]) -> list[Row]:
    """(k, n, lo, hi, before, total, least, most) of each part b of a set k of numbers that holds a wanted rank (from 0) of its set; the last three are the set's."""
    w = Window.partitionBy("k")
    parts = parts.withColumns({"before": F.sum("n").over(w.orderBy("b")) - F.col("n"), "total": F.sum("n").over(w), "least": F.min("lo").over(w), "most": F.max("hi").over(w)})
    wanted = [(r >= F.col("before")) & (r < F.col("before") + F.col("n")) for r in ranks(F.col("total"))]
    return parts.where(reduce(lambda a, c: a | c, wanted)).collect()  # a part for each rank, at most


@dataclasses.dataclass
class _Spread:
    """Numbers of a column: how many, the least and the largest, and exact quantiles; null without numbers."""

    n: int
    least: float | None
    most: float | None
    quantiles: list[float | None]


def _spreads(df: DataFrame, numbers: Sequence[Column], shares: Sequence[float], held: int = HELD, accuracy: int = ACCURACY) -> list[_Spread]:
    """Exact quantiles with linear interpolation of each column of numbers, in memory that doesn't grow with the table.

    The first pass counts each column by parts of its eighth root, with the least and the largest value of each part. A rank at
    either end of its part, or in a part of one value, is found, so ties end the search. What is left is cut by each further
    pass into parts of powers of two, where it spans more than one, then into even parts (`accuracy`), or by value where at most
    `held` numbers are left. The ends of a part always fall into different parts of the next pass, and five passes of even parts
    separate all doubles within a power of two.
    """
    rows = df.select(*[x.cast("double").alias(f"x{i}") for i, x in enumerate(numbers)])
    xs = [F.col(f"x{i}") for i in range(len(numbers))]
    ends_of, found, state = {}, {}, {}  # ends_of: column -> count, least, largest; state: (column, rank) -> low, high, numbers below, numbers between

    def settle(i: int, rank: int, below: int, part: Row) -> None:
        at = rank - below - part["before"]
        if 0 <= at < part["n"]:
            if part["lo"] == part["hi"] or at in (0, part["n"] - 1):
                found[i, rank] = part["lo"] if at == 0 else part["hi"]
            else:
                state[i, rank] = (part["lo"], part["hi"], below + part["before"], part["n"])

    def ends(share: float, n: int) -> tuple[int, int]:
        return math.floor(share * (n - 1)), math.ceil(share * (n - 1))

    each = [_counted(rows.select(x.alias("x")).where("x is not null and not isnan(x)").withColumn("b", _root(F.col("x"))), "b").withColumn("k", F.lit(i)) for i, x in enumerate(xs)]
    for part in _wanted(reduce(DataFrame.unionByName, each), lambda n: [f(s * (n - 1)) for s in shares for f in (F.floor, F.ceil)]) if each else []:
        ends_of[part["k"]] = (part["total"], part["least"], part["most"])
        for rank in {r for s in shares for r in ends(s, part["total"])}:
            settle(part["k"], rank, 0, part)
    while state:
        sets = list(dict.fromkeys((i, *s) for (i, _), s in state.items()))
        open_ = [(sets.index((i, *s)), rank) for (i, rank), s in state.items()]
        state, inside = {}, [(xs[i] >= low) & (xs[i] <= high) for i, low, high, _, _ in sets]
        cut = [_cut(xs[i], low, high, n, held, accuracy) for i, low, high, _, n in sets]
        own = [F.when(c, F.struct(F.lit(k).alias("k"), cut[k].alias("b"), xs[sets[k][0]].alias("x"))) for k, c in enumerate(inside)]
        cells = rows.where(reduce(lambda a, c: a | c, inside)).select(F.explode(F.array(*own)).alias("c")).where("c is not null").select("c.*")
        for part in _wanted(_counted(cells, "k", "b"), lambda _, sets=sets, open_=open_: [F.when(F.col("k") == k, rank - sets[k][3]) for k, rank in open_]):
            i, _, _, below, _ = sets[part["k"]]
            for k, rank in open_:
                if k == part["k"]:
                    settle(i, rank, below, part)

    def value(i: int, n: int, share: float) -> float | None:
        if not n:
            return None
        low, high = (found[i, r] for r in ends(share, n))
        part = share * (n - 1) % 1
        return low if low == high else low * (1 - part) + high * part

    known = [ends_of.get(i, (0, None, None)) for i in range(len(numbers))]
    return [_Spread(n, least, most, [value(i, n, s) for s in shares]) for i, (n, least, most) in enumerate(known)]


def quantiles(df: DataFrame, numbers: Sequence[Column], shares: Sequence[float], held: int = HELD, accuracy: int = ACCURACY) -> list[tuple[int, list[float | None]]]:
    """(count, exact quantiles with linear interpolation) of each column of numbers."""
    return [(s.n, s.quantiles) for s in _spreads(df, numbers, shares, held, accuracy)]


@dataclasses.dataclass
class Fence:
    """Quartiles of a column's numbers and the bounds beyond which a number is an outlier; none: whether no number is, as the least and the largest say."""

    n: int
    q1: float | None
    q3: float | None
    low: float | None
    high: float | None
    none: bool


def fenced(df: DataFrame, numbers: Sequence[Column], multiplier: float = 1.5) -> list[Fence]:
    out = []
    for s in _spreads(df, numbers, (0.25, 0.75)):
        q1, q3 = s.quantiles
        low, high = (None, None) if q1 is None else (q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1))
        out.append(Fence(s.n, q1, q3, low, high, low is None or s.least >= low and s.most <= high))  # a bound that is NaN leaves it open
    return out


def fences(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """(column, n, q1, q3, low, high): exact quartiles with linear interpolation, of all columns together."""
    by = kinds(df)
    found = fenced(df, [number(col(c), by[c]) for c in columns], multiplier)
    return df.sparkSession.createDataFrame([(c, f.n, f.q1, f.q3, f.low, f.high) for c, f in zip(columns, found, strict=True)], "column string, n long, q1 double, q3 double, low double, high double")


def outliers(df: DataFrame, columns: Sequence[str], multiplier: float = 1.5) -> DataFrame:
    """Values beyond the fences, of columns with at least 4 numbers. Quartiles first, then one pass that counts columns of which some number is beyond."""
    by = kinds(df)
    numbers = [number(col(c), by[c]) for c in columns]
    found = fenced(df, numbers, multiplier)
    beyond = {i: F.count_if((numbers[i] < f.low) | (numbers[i] > f.high)).alias(f"b{i}") for i, f in enumerate(found) if not f.none}
    one = df.agg(*beyond.values()) if beyond else df.sparkSession.range(1)
    rows = []
    for i, (c, f) in enumerate(zip(columns, found, strict=True)):
        bad = F.col(f"b{i}") if i in beyond and f.n >= 4 else F.lit(0)
        reason = "no_numeric_values" if f.n == 0 else "insufficient_numeric_values" if f.n < 4 else None
        rows.append(_row("outliers_iqr", c, bad, F.lit(f.n), "outlier_risk", reason=F.lit(reason).cast("string")))
    return one.select(F.inline(F.array(*rows)))


def dominant(df: DataFrame, columns: Sequence[str], share: float = 0.3) -> DataFrame:
    """(column, value, n, share) of the most frequent number where its share is above `share`; the smallest on ties."""
    by = kinds(df)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), number(col(c), by[c]).alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    top = counts.groupBy("column").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("value"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return top.withColumn("share", F.col("n") / F.col("total")).where(F.col("share") > share).select("column", "value", "n", F.round("share", 4).alias("share"))


#: Distinct values of a range of neighbours, at least, and ranges at most.
NEAR_ROWS, NEAR_RANGES = 10_000, 2_000


def knn_outliers(df: DataFrame, column: str, k: int = 5, contamination: float = 0.05) -> DataFrame:
    """(value, rows, score, outlier) of each distinct number: distance to its k-th neighbour among all rows.

    Neighbours in one dimension are neighbours in order, so ranges of values are sorted in parallel and only the last
    and first k distinct values of neighbouring ranges are looked at beside their own. A value's range follows from the
    value alone, and each range holds at least k distinct values: one has NEAR_ROWS of them, or 10 * k if that is more, and the
    sketch that cuts them is wrong by a tenth of that at most.
    """
    x = number(col(column), kinds(df)[column])
    counts = df.select(x.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("rows"))
    parts = min(NEAR_RANGES, counts.count() // max(NEAR_ROWS, 10 * k))
    cuts = counts.select(F.percentile_approx("value", [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first()["q"] if parts > 1 else []
    ranged = counts.withColumn("part", range_of(F.col("value"), sorted(set(cuts))))
    edge = Window.partitionBy("part")
    low, high = (ranged.withColumn("at", F.row_number().over(edge.orderBy(o))).where(F.col("at") <= k) for o in (F.col("value"), F.desc("value")))
    spread = ranged.withColumn("own", F.lit(True)).unionByName(low.select("value", "rows", (F.col("part") - 1).alias("part"), F.lit(False).alias("own"))).unionByName(high.select("value", "rows", (F.col("part") + 1).alias("part"), F.lit(False).alias("own")))
    w = Window.partitionBy("part").orderBy("value")
    near = [F.struct(F.abs(F.lag("value", i).over(w) - F.col("value")).alias("d"), F.lag("rows", i).over(w).alias("n")) for i in range(1, k + 1)] + [F.struct(F.abs(F.lead("value", i).over(w) - F.col("value")).alias("d"), F.lead("rows", i).over(w).alias("n")) for i in range(1, k + 1)]
    scored = spread.withColumn("near", F.array(*near)).where("own")
    kth = F.aggregate(F.array_sort(F.filter("near", lambda s: s["d"].isNotNull())), F.struct((F.col("rows") - 1).alias("have"), F.lit(0.0).alias("d")), lambda a, s: F.when(a["have"] >= k, a).otherwise(F.struct((a["have"] + s["n"]).alias("have"), s["d"].alias("d"))), lambda a: a["d"])
    scored = scored.select("value", "rows", kth.alias("score"))
    cut = scored.agg(F.percentile("score", F.lit(1 - contamination), F.col("rows")).alias("c")).scalar()
    return scored.withColumn("outlier", F.col("score") > cut)


def validity(df: DataFrame, roles: dict[str, str], as_of_year: int | None = None, rules: Sequence[tuple[str, str, str]] = DATE_RULES) -> DataFrame:
    """Non-negative counts, suspicious zeros, implausible dates, e-mail forms, and the cross-column date rules, in one pass."""
    return counted(df, validity_tests(df, roles, as_of_year, rules))


def skipped(df: DataFrame, roles: dict[str, str], rules: Sequence[tuple[str, str, str]] = DATE_RULES) -> DataFrame:
    """Result rows of validity checks that don't apply: columns of counts or prices that are no measurement, date rules without their columns. No score counts them."""
    names, rows = {c.strip().lower() for c in kinds(df)}, []
    for c in kinds(df):
        if roles.get(c) != "measurement":
            rows += [("non_negative", c, "skipped_non_measurement_column")] * bool(NON_NEGATIVE.search(c))
            rows += [("suspicious_zero", c, "skipped_non_measurement_column")] * any(z.lower() in c.lower() for z in SUSPICIOUS_ZERO)
    rows += [("cross_column_dates", f"{a} {op} {b}", "skipped_columns_not_present") for a, op, b in rules if not {a.lower(), b.lower()} <= names]
    out = df.sparkSession.createDataFrame(rows, "check_name string, column string, reason string")
    made = {"status": F.lit("passed"), "issues_found": F.lit(0).cast("long"), "total": F.lit(0).cast("long"), "quality_ratio": F.lit(None).cast("double"), "dimension": F.lit("validity")}
    return out.withColumns(made).select(*[x.split()[0] for x in RESULT.split(", ")])


def validity_tests(df: DataFrame, roles: dict[str, str], as_of_year: int | None = None, rules: Sequence[tuple[str, str, str]] = DATE_RULES) -> list[Tests]:
    by, names = kinds(df), {c.strip().lower(): c for c in kinds(df)}
    year = F.lit(as_of_year) if as_of_year else F.year(F.current_date())
    negative, zero, dates, email, cross = {}, {}, {}, {}, {}
    for c, k in by.items():
        n = number(col(c), k)
        if roles.get(c) == "measurement" and NON_NEGATIVE.search(c):
            negative[c] = (n < 0, n.isNotNull())
        if any(z.lower() == c.strip().lower() or z.lower() in c.lower() for z in SUSPICIOUS_ZERO) and roles.get(c) == "measurement":
            zero[c] = (n == 0, n.isNotNull())
        if roles.get(c) == "date":
            t = moment(col(c), k)
            dates[c] = (t.isNull() | (F.year(t) < 1990) | (F.year(t) > year + 1), ~absent(col(c), k))
        if "email" in c.lower():
            email[c] = (~col(c).cast("string").rlike(EMAIL), col(c).isNotNull())
    for left, op, right in rules:
        a, b = names.get(left.lower()), names.get(right.lower())
        if a and b:
            x, y = moment(col(a), by[a]), moment(col(b), by[b])
            cross[f"{a} {op} {b}"] = (~_compare(x, op, y), x.isNotNull() & y.isNotNull())
    named = (("non_negative", negative), ("suspicious_zero", zero), ("date_validity", dates), ("email_format", email), ("cross_column_dates", cross))
    return [(name, "validity", tests) for name, tests in named]


def _compare(x: Column, op: str, y: Column) -> Column:
    op = {"le": "<=", "ge": ">=", "lt": "<", "gt": ">", "eq": "==", "ne": "!="}.get(op, op)
    return {"<=": x <= y, ">=": x >= y, "<": x < y, ">": x > y, "==": x == y, "!=": x != y}[op]


def consistency(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that are not in the most frequent spelling (least text on ties) of their normalised value, in one aggregate of all columns."""
    cells = [F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("raw")) for c in columns]
    long = df.select((cells[0] if len(cells) == 1 else F.explode(F.array(*cells))).alias("x")).select("x.*").where("raw is not null")  # the cells of one column are its rows
    raw = long.groupBy("column", "raw").agg(F.count("*").alias("n"))  # normalised once a spelling, not once a row
    groups = raw.groupBy("column", normal(F.col("raw")).alias("norm")).agg(F.sum("n").alias("rows"), F.max("n").alias("best"))
    sums = groups.groupBy("column").agg(F.sum(F.col("rows") - F.col("best")).alias("issues"), F.sum("rows").alias("total"))
    return sums.select(_row("consistency", F.col("column"), F.col("issues"), F.col("total"), "consistency").alias("r")).select("r.*")


def canonical_spellings(df: DataFrame, column: str) -> DataFrame:
    """(raw, canonical, n) of spellings that are not the canonical one."""
    raw = df.where(col(column).isNotNull()).groupBy(normal(col(column)).alias("norm"), col(column).alias("raw")).agg(F.count("*").alias("n"))
    best = raw.groupBy("norm").agg(F.max_by("raw", F.struct("n", F.expr("-length(raw)"), "raw")).alias("canonical"))
    return raw.join(best, "norm").where("raw != canonical").select("raw", "canonical", "n")


def freshness(df: DataFrame, column: str, as_of: str, stale_days: int = STALE_DAYS) -> DataFrame:
    t = moment(col(column), kinds(df)[column])
    one = df.agg(F.min(t).cast("date").alias("first"), F.max(t).cast("date").alias("last"), F.count(t).alias("n"))
    return one.select(F.lit(column).alias("column"), "first", "last", _days(F.col("last"), as_of).alias("days_since"), "n").withColumn("status", _fresh(F.col("n"), F.col("days_since"), stale_days))


def _days(last: Column, as_of: str) -> Column:
    return F.datediff(F.lit(as_of).cast("date"), last).cast("long")


def _fresh(n: Column, days: Column, stale_days: int) -> Column:
    return F.when(n == 0, "skipped").when(days > stale_days, "failed").otherwise("passed")


def freshness_rows(df: DataFrame, columns: Sequence[str], as_of: str, stale_days: int = STALE_DAYS) -> More:
    """freshness() of several columns as RESULT rows."""
    by, aggs, rows = kinds(df), [], []
    for i, c in enumerate(columns):
        t = moment(col(c), by[c])
        aggs += [F.max(t).cast("date").alias(f"last{i}"), F.count(t).alias(f"dates{i}")]
        status = _fresh(F.col(f"dates{i}"), _days(F.col(f"last{i}"), as_of), stale_days)
        row = _row("freshness", c, (status == "failed").cast("long"), F.col(f"dates{i}"), "freshness", ratio=F.lit(None).cast("double"))
        rows.append(row.withField("status", status))
    return aggs, rows


def schema_quality(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(position, column, issue) of names, from the raw header: generated, vague, single letter, blank, duplicate."""
    seen, rows = set(), []
    for i, raw in enumerate(names):
        name = str(raw).strip()
        issue = "blank" if not name else "generated" if GENERATED_NAME.match(name) else "vague" if VAGUE_NAME.match(name) else "single_letter" if re.fullmatch("[A-Za-z]", name) else "duplicate" if name.lower() in seen else None
        seen.add(name.lower())
        rows.append((i, str(raw), issue))
    return spark.createDataFrame(rows, "position long, column string, issue string")


#: Words of companies' names.
COMPANY = (" ltd", " limited", " plc", " inc", " gmbh", " llc", " corp", " co.")
CODE_SHAPE = r"^[A-Za-z0-9_./-]{1,20}$"


def value_shape(df: DataFrame, column: str) -> DataFrame:
    """One row `shape`: name, code or unknown, by the first 80 values (a sample by definition)."""
    v = F.trim(col(column).cast("string"))
    sample = df.select(v.alias("v")).where("v is not null and v <> ''").limit(80)
    low = F.concat(F.lit(" "), F.lower("v"), F.lit(" "))
    name = (F.col("v").contains(" ") & (F.length("v") > 5)) | reduce(lambda a, b: a | b, [low.contains(w) for w in COMPANY])
    votes = sample.agg(F.avg(name.cast("int")).alias("name"), F.avg((~name & F.col("v").rlike(CODE_SHAPE)).cast("int")).alias("code"))
    return votes.select(F.when(F.col("name") >= 0.5, "name").when(F.col("code") >= 0.5, "code").otherwise("unknown").alias("shape"))


def compatible_reference(df: DataFrame, column: str, codes: DataFrame | None, names: DataFrame | None = None) -> tuple[str | None, str | None]:
    """Which reference list (one column `value`) a column can be compared with: (code or name, None), or (None, reason).

    The shapes of the first values decide; an unclear column takes the list that has one of its first values.
    """
    shape = lambda x, c: None if x is None else value_shape(x, c).first()["shape"]
    own, code, name = shape(df, column), shape(codes, "value"), shape(names, "value")
    if own == "code" and code in ("code", "unknown"):
        return "code", None
    if own == "name" and name in ("name", "unknown"):
        return "name", None
    if own == "unknown":
        sample = df.select(F.trim(col(column).cast("string")).alias("value")).where("value <> ''").limit(80)
        for kind, ref in (("code", codes), ("name", names)):
            if ref is not None and ref.join(sample, "value", "left_semi").limit(1).count():
                return kind, None
    return None, "reference_type_mismatch"


def match_references(df: DataFrame, lists: Sequence[tuple[Sequence[str], DataFrame | None, DataFrame | None]]) -> dict[str, tuple[str | None, str | None]]:
    """column -> compatible_reference(), for the columns that a list names: (names in lower case, codes, names or None)."""
    low, out = {c.strip().lower(): c for c in kinds(df)}, {}
    for wanted, codes, names in lists:
        for w in wanted:
            if w in low and low[w] not in out:
                out[low[w]] = compatible_reference(df, low[w], codes, names)
    return out


def orphans(df: DataFrame, column: str, reference: DataFrame, ref_column: str) -> DataFrame:
    """Rows whose trimmed key is not in the reference; null and blank keys are skipped. Spark picks the join by size."""
    ref = reference.select(F.trim(col(ref_column).cast("string")).alias("_key")).where("_key is not null and _key <> ''").distinct()
    own = df.withColumn("_key", F.trim(col(column).cast("string"))).where("_key is not null and _key <> ''")
    return own.join(ref, "_key", "left_anti").drop("_key")


def integrity(df: DataFrame, column: str, reference: DataFrame, ref_column: str, dimension: str = "integrity") -> DataFrame:
    """Membership of keys; an empty reference is an error."""
    key = F.trim(col(column).cast("string"))
    counts = df.where(key.isNotNull() & (key != "")).groupBy(key.alias("_key")).agg(F.count("*").alias("n"))
    ref = reference.select(F.trim(col(ref_column).cast("string")).alias("_key")).where("_key is not null and _key <> ''").distinct().withColumn("hit", F.lit(True))
    one = counts.join(ref, "_key", "left").agg(F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("hit").alias("hits"))
    empty = ref.agg((F.count("*") == 0).alias("e")).scalar()
    own, other = value_shape(df, column).scalar(), value_shape(reference, ref_column).scalar()
    # codes are not compared with names; such a column passes, and the reason says that nothing was compared
    unlike = F.coalesce((own != other) & (own != "unknown") & (other != "unknown"), F.lit(False))
    bad = F.when(unlike, 0).otherwise(F.col("bad"))
    out = one.select(_row("referential_integrity", column, bad, F.col("total"), dimension, reason=F.when(unlike, "reference_type_mismatch")).alias("r")).select("r.*")
    return out.withColumn("status", F.when(empty, "error").otherwise(F.col("status"))).withColumn("issues_found", F.when(empty, 0).otherwise(F.col("issues_found")))


@dataclasses.dataclass(frozen=True)
class Rule:
    """type: required, unique, datatype, min_max, regex, allowed_values or cross_column."""

    id: str
    type: str
    columns: tuple[str, ...] = ()
    expected: str = ""
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()
    op: str = ""
    severity: str = "MEDIUM"
    pattern: str = ""
    enabled: bool = True
    name: str = ""
    impact: str = "Validation rule failure affects data quality."
    recommendation: str = "Review and fix failed records at ingestion."


def load_rules(spec: dict) -> list[Rule]:
    """Rules from the mapping form: keys id, type, column(s) or column_pattern, and what the type needs."""
    out = []
    for r in spec.get("rules", []):
        columns = tuple(r.get("columns") or ([r["column"]] if r.get("column") else [r["left"], r["right"]] if r.get("left") else []))
        out.append(Rule(r["id"], r["type"], columns, r.get("expected_type") or r.get("pattern", ""), r.get("min"), r.get("max"), tuple(r.get("allowed_values", ())), r.get("op", ""), str(r.get("severity", "MEDIUM")).upper(), r.get("column_pattern", ""), r.get("enabled", True), r.get("name", ""), r.get("business_impact", Rule.impact), r.get("recommendation", Rule.recommendation)))
    return out


def targets(rule: Rule, names: Sequence[str]) -> list[tuple[str, ...]]:
    """Column tuples a rule applies to: exact, then trimmed and case-insensitive names, or names with its pattern; none if one is absent."""
    if rule.pattern:
        return [(n,) for n in names if rule.pattern.lower() in n.lower()]
    found = []
    for c in rule.columns:
        same = [n for n in names if n == c] or [n for n in names if n.strip().lower() == c.strip().lower()]
        if not same and c.upper().lstrip("$") not in ("TODAY", "NOW"):
            return []
        found.append(same[0] if same else c)
    return [tuple(found)]


def rule_test(rule: Rule, by: dict[str, str], columns: Sequence[str]) -> tuple[Column, Column]:
    """(is a failure, is assessed) of one row."""
    c = columns[0]
    x, k = col(c), by[c]
    text = F.trim(x.cast("string"))
    some = ~absent(x, k)
    n = number(x, k)
    if rule.type == "required":
        return ~some | (text == ""), F.lit(True)
    if rule.type == "datatype":
        good = {"numeric": n.isNotNull(), "integer": n.isNotNull() & (n % 1 == 0), "date": moment(x, k).isNotNull(), "boolean": F.lower(text).isin("true", "false", "1", "0", "yes", "no", "y", "n", "t", "f")}[rule.expected]
        return ~good, some & (text != "")
    if rule.type == "min_max":
        out = F.lit(False)
        if rule.low is not None:
            out = out | (n < rule.low)
        if rule.high is not None:
            out = out | (n > rule.high)
        return out, n.isNotNull()
    if rule.type == "regex":
        return ~x.cast("string").rlike(f"(?i){rule.expected}"), some
    if rule.type == "allowed_values":
        return ~F.lower(text).isin(*[v.strip().lower() for v in rule.values]), some
    if rule.type == "cross_column":
        today = columns[1].upper().lstrip("$") in ("TODAY", "NOW")
        ky = "timestamp" if today else by[columns[1]]
        y = F.current_timestamp() if today else col(columns[1])
        if not today and k not in ("timestamp", "date") and ky not in ("timestamp", "date"):
            a, b = n, number(y, ky)
            numeric = a.isNotNull() & b.isNotNull()
            s, t = moment(x, k), moment(y, ky)
            return F.when(numeric, ~_compare(a, rule.op, b)).otherwise(~_compare(s, rule.op, t)), numeric | (s.isNotNull() & t.isNotNull())
        s, t = moment(x, k), moment(y, ky)
        return ~_compare(s, rule.op, t), s.isNotNull() & t.isNotNull()
    raise ValueError(f"unknown rule type: {rule.type}")


def run_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """A row for each rule and target. All row rules share one aggregate; each unique rule takes one of its own."""
    by, tests, keyed = kinds(df), {}, []
    for rule in rules:
        for columns in targets(rule, list(by)) if rule.enabled else []:
            if rule.type == "unique":
                keyed.append((rule, columns))
            else:
                tests[f"{rule.id}:{'+'.join(columns)}"] = rule_test(rule, by, columns)
    out = counted(df, [("business_rule", "validity", tests)])
    for rule, columns in keyed:
        out = out.unionByName(duplicates(df, columns).withColumns({"check_name": F.lit("business_rule"), "column": F.lit(f"{rule.id}:{'+'.join(columns)}"), "reason": F.lit(None).cast("string")}))
    return out


def rule_results(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """run_rules() in the shape of rule reports: rule_id, rule_name, rule_type, column, status, failed_records, failed_pct of all rows, severity, business_impact, recommendation, dimension.

    A rule that can't be evaluated gives a row with status error; the others are not touched.
    """
    by, good, wrong = kinds(df), [], []
    for rule in rules:
        for columns in targets(rule, list(by)) if rule.enabled else []:
            try:
                if rule.type != "unique":
                    rule_test(rule, by, columns)
                good.append((rule, columns))
            except (KeyError, ValueError) as why:
                wrong.append((f"{rule.id}:{'+'.join(columns)}", rule, columns, str(why)))
    spark, found = df.sparkSession, run_rules(df, list({r.id: r for r, _ in good}.values()))
    facts = [(f"{r.id}:{'+'.join(c)}", r.id, r.name or r.id, r.type, "+".join(c), r.severity, r.impact, r.recommendation) for r, c in good]
    facts = spark.createDataFrame(facts, "label string, rule_id string, rule_name string, rule_type string, target string, severity string, business_impact string, recommendation string")
    rows = df.agg(F.count("*").alias("n")).scalar()
    share = F.round(F.coalesce(F.try_divide(F.col("issues_found") * 100.0, rows), F.lit(0.0)), 4)
    out = found.join(F.broadcast(facts), F.col("column") == F.col("label")).select("rule_id", "rule_name", "rule_type", F.col("target").alias("column"), "status", F.col("issues_found").alias("failed_records"), share.alias("failed_pct"), "severity", "business_impact", "recommendation", "dimension")
    if wrong:
        out = out.unionByName(spark.createDataFrame([(r.id, r.name or r.id, r.type, "+".join(c), "error", 0, 0.0, r.severity, r.impact, why, "validity") for _, r, c, why in wrong], out.schema))
    return out


def failing_ids(df: DataFrame, rules: Sequence[Rule], most: int = SAMPLE_IDS) -> DataFrame:
    """(label, _rid): the first `most` rows that fail each row rule; a report feature, taken in one pass with partial top-k."""
    by = kinds(df)
    tests = {f"{r.id}:{'+'.join(c)}": rule_test(r, by, c) for r in rules if r.enabled and r.type != "unique" for c in targets(r, list(by))}
    if not tests:
        return df.sparkSession.createDataFrame([], "label string, _rid long")
    failed = F.array(*[F.when(F.coalesce(issue & seen, F.lit(False)), F.lit(label)) for label, (issue, seen) in tests.items()])
    rows = df.select("_rid", F.explode(F.filter(failed, lambda x: x.isNotNull())).alias("label"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("_rid"))).where(F.col("k") <= most).select("label", "_rid")


def merged_spec(base: dict, own: dict) -> dict:
    """A client's settings over the common ones: mappings are merged key by key, anything else, lists too, is replaced."""
    out = dict(base)
    for k, v in own.items():
        out[k] = merged_spec(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


RULE_TYPES = ("required", "unique", "datatype", "min_max", "regex", "allowed_values", "cross_column")


def read_rules(spark: SparkSession, path: str, own: str | None = None) -> list[Rule]:
    """Rules of a JSON file in any store (or YAML, where a reader for it is installed), with a client's file merged over it. Wrong rules are errors."""

    def spec(at: str) -> dict:
        text = spark.read.text(at, wholetext=True).first()[0]
        if at.lower().endswith((".yaml", ".yml")):
            import yaml

            return yaml.safe_load(text) or {}
        return json.loads(text)

    found = merged_spec(spec(path), spec(own)) if own else spec(path)
    for r in found.get("rules", []):
        if not r.get("id") or r.get("type") not in RULE_TYPES:
            raise ValueError(f"wrong rule: {r}")
    return load_rules(found)


def scope(df: DataFrame, start: int = 0, end: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows start <= _rid < end and some columns, numbered from 0 again; an unknown column is an error."""
    unknown = set(columns or ()) - set(df.columns)
    if unknown:
        raise KeyError(sorted(unknown)[0])
    own = df.where(F.col("_rid") >= start) if end is None else df.where((F.col("_rid") >= start) & (F.col("_rid") < end))
    return own.select((F.col("_rid") - start).alias("_rid"), *[col(c) for c in columns or [c for c in df.columns if c != "_rid"]])
