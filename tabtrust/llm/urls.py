"""URL rules by a blocked Bloom filter and an exact hash join. DataFrame functions only.

A rule is (host, path, verdict); its canonical form is host followed by path. A URL can only be met by a rule whose
host is one of the URL's host suffixes and whose path is a prefix of its path with a length that some rule has. All
those canonical forms are tested against a blocked Bloom filter (each form sets one bit in each of the four 64-bit
words of one block); the forms that pass are joined by value with the rules, which removes false positives. The
longest rule wins. The filter has a fixed number of bits, whatever the number of rules: a fuller filter only
passes more forms to the join.

Defined results: a null URL, or one without ://, has an empty host and path and meets no rule; no rule gives the
default verdict. Rules that repeat a canonical form: block wins. Rules with a null host or path are ignored.
An empty table gives an empty result. `judge` returns its own columns only, so extra columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabtrust.llm.scratch import quoted, small, table

BLOCKS = 4096
WORDS = 4
#: The rules of the contract.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(h: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 24), F.lit(BLOCKS))


def _mask(h: Column, word: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * word).bitwiseAND(F.lit(63).cast("long")).cast("int"))


def bloom(keys: DataFrame, key: str = "key") -> DataFrame:
    """One row, one column `bits`: BLOCKS * WORDS longs (128 kB), from any number of keys."""
    h = F.xxhash64(key)
    blocks = keys.groupBy(_block(h).alias("block")).agg(*[F.bit_or(_mask(h, i)).alias(f"w{i}") for i in range(WORDS)])
    found = F.map_from_entries(F.collect_list(F.struct(F.col("block").cast("int").alias("k"), F.array(*[f"w{i}" for i in range(WORDS)]).alias("v"))))
    zero = F.array(*[F.lit(0).cast("long")] * WORDS)
    return blocks.agg(found.alias("m")).select(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i), zero))).alias("bits"))


def may_contain(bits: Column, key: Column) -> Column:
    h = F.xxhash64(key)
    at = (_block(h) * WORDS + 1).cast("int")
    tests = [F.element_at(bits, at + i).bitwiseAND(_mask(h, i)) != 0 for i in range(WORDS)]
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def candidates(host: Column, path: Column, lengths: Column) -> Column:
    """All canonical forms (host suffix + path prefix) that a rule could have."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substr(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.concat(s, p).alias("key"), F.length(s).alias("n")))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule and verdict of every row. rules: (host, path, verdict), of any size."""
    key = F.concat("host", "path")
    # the length of the host tells `a.b` + `/c` from other splits of one string
    known = rules.where("host is not null and path is not null and verdict is not null").groupBy(key.alias("key"), F.length("host").alias("n")).agg(F.max("verdict").alias("verdict"))
    known = table(known, "rules")
    # a URL is at most a few thousand characters long, and so has the rules' paths few lengths
    lengths = known.agg(F.array_sort(F.collect_set(F.length("key") - F.col("n"))).alias("x")).scalar()
    bits = table(bloom(known), "bloom").scalar()  # one row, read by both passes over the pages
    rows = pages.select(quoted(id_col).alias("id"), host_of(quoted(url_col)).alias("host"), path_of(quoted(url_col)).alias("path"))
    hits = F.filter(candidates(F.col("host"), F.col("path"), F.col("lengths")), lambda c: may_contain(F.col("bits"), c["key"]))
    rows = rows.withColumns({"lengths": lengths, "bits": bits}).select("id", "host", "path", hits.alias("hits"))
    # nearly all URLs of a hot host have the same hits: each distinct list of hits is joined once
    lists = rows.where(F.size("hits") > 0).groupBy("hits").agg(F.lit(1).alias("one")).select("hits", F.explode("hits").alias("hit"))
    best = lists.join(known, (F.col("hit.key") == F.col("key")) & (F.col("hit.n") == F.col("n"))).groupBy("hits").agg(F.max_by(F.struct("key", "verdict"), F.struct(F.length("key"), F.col("n"))).alias("best"))
    # a hot host's rows share one list, so its lists are broadcast as far as they are few; else Spark splits the skewed join
    best = table(best, "best")
    return (
        rows.join(small(best, best.count()), "hits", "left")
        .select(F.col("id").alias(id_col), "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    )


SQL = r"""
WITH rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
x AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, host, path, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
      FROM x LEFT JOIN rules r ON (host = r.h OR suffix(host, '.' || r.h)) AND starts_with(path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
