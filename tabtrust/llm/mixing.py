"""Mixing sources to target weights by nested hash-threshold histograms. DataFrame functions only.

Every document has a hash of its id. Of each source the mix takes whole passes over all documents and, for the
rest of its target, the documents whose hash lies below a threshold. The threshold is found without sorting
documents: sizes are summed by (source, top 12 bits of the hash); the bucket in which the running sum passes the
budget is refined by the next 12 bits, and what is left of it by the hash itself. Each level is one aggregation
with map-side partial sums, so a source with a third of all rows is no hot spot.

Defined results: a null text has size 0; documents of size 0 are never repeated; a null source is a source of its
own and sorts last; a null id takes the hash of the text; rows that repeat an id fall on the same side of the
threshold. An empty table gives an empty result. Extra columns may have any names: `mix` returns
its own columns only, and `mixed` the input's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtrust.llm.scratch import quoted, small, table

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the white space around it; nothing else is left of a text that has a word.
SPACED_WORD = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+"
BITS = 12


def words(text: Column) -> Column:
    """Number of words: one letter is left of each. (regexp_count makes an array of all words first, which fills the heap.)"""
    return F.when(text.rlike(WORD), F.length(F.regexp_replace(text, SPACED_WORD, "w"))).otherwise(0).cast("long")


def id_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id, the same in any SQL engine."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("~"), F.md5(text)), F.lit("~"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """Target of each source: (src, source_size) -> + target. One row a source.

    Sources in code-point order, null last, get the weights in turn and share `share` of all words; a target stops
    at `most` times its source's size, and the excess goes to the others by weight until none is above.
    That is the level L at which the sum of least(cap, weight * L) is the whole: capped are the sources of least
    cap / weight, as far as L of the others is above that ratio.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    every = Window.orderBy(F.col("src").isNull(), "src")
    before = Window.orderBy(F.col("cap") / F.col("w"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    return (
        sizes.withColumn("rank", F.row_number().over(every)).withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("all", F.sum("source_size").over(whole) * F.lit(float(share))).withColumn("ws", F.sum("w").over(whole))
        .withColumn("level", F.try_divide(F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.col("ws") - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("capped", F.col("cap") / F.col("w") < F.col("level"))
        .withColumn("open", F.try_divide(F.col("all") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(whole), F.sum(F.when(~F.col("capped"), F.col("w")).otherwise(0.0)).over(whole)))
        .select("src", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("w") * F.col("open"))).alias("target"))
    )


def _boundary(histogram: DataFrame, budgets: DataFrame) -> DataFrame:
    """Of each source the first bucket at which the running sum passes its budget `rest`; `rest` becomes what is left before it."""
    run = Window.partitionBy("src").orderBy("b")
    return (
        histogram.join(small(budgets.select(F.col("src").alias("of"), "rest")), F.col("src").eqNullSafe(F.col("of")))
        .withColumn("run", F.sum("n").over(run)).where((F.col("run") > F.col("rest")) & (F.col("run") - F.col("n") <= F.col("rest")))
        .select("src", "b", "n", (F.col("rest") - (F.col("run") - F.col("n"))).alias("rest"))
    )


def thresholds(slim: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """(src, size, h) of all documents -> a row for each source: source_size, target, passes, cut (hashes up to it are taken once more)."""
    aims = table(targets(slim.groupBy("src").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    passes = F.least(F.lit(most), F.floor(F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0)))).cast("long")
    aims = aims.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    found, inside = aims.select("src", "rest"), slim
    for level in (1, 2):
        bucket = F.shiftrightunsigned("h", 60 - BITS * level)
        found = table(_boundary(inside.groupBy("src", bucket.alias("b")).agg(F.sum("size").alias("n")), found), f"level{level}")
        at = small(found.select(F.col("src").alias("at"), F.col("b").alias("at_b")))
        inside = slim.join(at, slim["src"].eqNullSafe(F.col("at")) & (bucket == F.col("at_b"))).select("src", "size", "h")
        found = found.select("src", "rest")
    last = _boundary(inside.groupBy("src", F.col("h").alias("b")).agg(F.sum("size").alias("n")), found)
    # the last hash is taken too if that comes nearer
    cut = F.when(F.col("n") - F.col("rest") < F.col("rest"), F.col("b")).otherwise(F.col("b") - 1)
    cuts = last.select(F.col("src").alias("cut_src"), cut.alias("cut"))
    return table(aims.join(small(cuts), F.col("src").eqNullSafe(F.col("cut_src")), "left").select("src", "source_size", "target", "passes", F.coalesce("cut", F.lit(-1)).alias("cut")), "cuts")


def _apply(df: DataFrame, cuts: DataFrame, src: Column, h: Column, size: Column) -> DataFrame:
    cuts = small(cuts.withColumnRenamed("src", "__src"))
    repeats = F.col("passes") + F.when(h <= F.col("cut"), 1).otherwise(0)
    return df.withColumns({"__key": src, "__h": h, "__size": size}).join(cuts, F.col("__key").eqNullSafe(F.col("__src"))).withColumn("__repeats", F.when(F.col("__size") > 0, repeats.cast("long")).otherwise(0))


def slim(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, src, size, h) of all documents, written: the text is read once."""
    return table(docs.select(quoted(id_col).alias("id"), quoted(source_col).alias("src"), words(quoted(text_col)).alias("size"), id_hash(quoted(id_col), quoted(text_col)).alias("h")), "slim")


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each document: id, size, source_size, target (its source's) and taken (words, repeats counted)."""
    rows = slim(docs, id_col, text_col, source_col)
    out = _apply(rows, thresholds(rows, weights, share, most), F.col("src"), F.col("h"), F.col("size"))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("__repeats")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixed documents themselves: every input row as often as the mix takes it, with its own columns."""
    cuts = thresholds(slim(docs, id_col, text_col, source_col), weights, share, most)
    names = [f"c{i}" for i in range(len(docs.columns))]  # safe from any clash of names
    at = {c: F.col(f"__{n}") for c, n in zip(docs.columns, names, strict=True)}
    plain = docs.select(*[quoted(c).alias(f"__{n}") for c, n in zip(docs.columns, names, strict=True)])
    out = _apply(plain, cuts, at[source_col], id_hash(at[id_col], at[text_col]), words(at[text_col]))
    copies = F.explode(F.array_repeat(F.lit(0), F.col("__repeats").cast("int")))
    return out.where("__repeats > 0").select(*[c.alias(n) for n, c in at.items()], copies.alias("__copy")).drop("__copy")


#: The same rows in DuckDB: thresholds by sorting each source's documents by hash.
SQL = r"""
WITH d AS (
  SELECT doc_id, source AS src, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '~' || md5(text), '~')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
r AS (SELECT *, row_number() OVER (ORDER BY src IS NULL, src) AS rk FROM s),
w AS (SELECT *, CAST([1, 2, 3][(rk - 1) % 3 + 1] AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () * 1.0::DOUBLE AS t FROM r),
l AS (SELECT *, (t - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM w
      WINDOW b AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, cap / w < level AS capped FROM l),
o AS (SELECT *, (t - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0 ELSE w END) OVER () AS lam FROM c),
a AS (SELECT src, source_size, CASE WHEN capped THEN cap ELSE least(cap, w * lam) END AS target FROM o),
p AS (SELECT *, CAST(least(3, floor(coalesce(target / nullif(source_size, 0), 0))) AS BIGINT) AS passes FROM a),
g AS (SELECT src, h, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY src, h),
u AS (SELECT g.*, sum(n) OVER (PARTITION BY g.src ORDER BY h) AS run, p.target - p.passes * p.source_size AS rest
      FROM g JOIN p ON g.src IS NOT DISTINCT FROM p.src),
k AS (SELECT src, min(CASE WHEN run - rest < rest - (run - n) THEN h ELSE h - 1 END) AS cut FROM u WHERE run > rest AND run - n <= rest GROUP BY src)
SELECT d.doc_id, d.size, p.source_size, p.target,
       CAST(CASE WHEN d.size > 0 THEN d.size * (p.passes + CASE WHEN d.h <= coalesce(k.cut, -1) THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN p ON d.src IS NOT DISTINCT FROM p.src LEFT JOIN k ON d.src IS NOT DISTINCT FROM k.src
"""
