"""Standardisation of spellings and entity resolution: lookup, then blocked similarity, then vectors."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabtrust.functions.values import col, cosine, normal, ratio, ratio_sql, safe_normal
from tabtrust.operators.checks import _row
from tabtrust.operators.pii import display

MAX_VALUES = 500
THRESHOLD = 90.0
AUTO, REVIEW = 0.85, 0.75
VECTOR_AUTO, VECTOR_REVIEW = 0.78, 0.70
CANDIDATES = 25
#: Values with fewer candidates in their block are compared with all canonicals, which stand in so many parts.
MIN_BLOCK, PARTS = 3, 32


def frequent_values(df: DataFrame, columns: Sequence[str], most: int = MAX_VALUES) -> DataFrame:
    """(column, value, n) of each column's most frequent values: the limit is part of the operator."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null and trim(value) <> ''")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))).where(F.col("place") <= most)


def _cluster(threshold: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        anchors: list[tuple[str, list[tuple[str, int]]]] = []
        for value, n in pdf.sort_values("place")[["value", "n"]].itertuples(index=False):
            own = next((members for anchor, members in anchors if ratio(anchor, value) >= threshold), None)
            if own is None:
                anchors.append((value, [(value, n)]))
            else:
                own.append((value, n))
        rows = []
        for _, members in anchors:
            canonical = max(members, key=lambda m: (m[1], -len(m[0]), m[0]))[0]
            rows += [(pdf["column"].iloc[0], v, canonical, n) for v, n in members]
        return pd.DataFrame(rows, columns=["column", "original", "canonical", "n"])

    return run


def mapping(df: DataFrame, columns: Sequence[str], threshold: float = THRESHOLD, most: int = MAX_VALUES) -> DataFrame:
    """(column, original, canonical, n): values join the first more frequent anchor that is similar enough.

    The order of values decides, so one task takes a column; it holds at most `most` values.
    """
    return frequent_values(df, columns, most).groupBy("column").applyInPandas(_cluster(threshold), "column string, original string, canonical string, n long")


def standardize(df: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """df with the column's values replaced by their canonical form; what has none stays. Spark picks the join by the mapping's size;
    of several rows for a value the least canonical form counts."""
    own = found.where(F.col("column") == column).groupBy(F.col("original").alias("_from")).agg(F.min("canonical").alias("_to"))
    return df.join(own, col(column) == F.col("_from"), "left").withColumn(column, F.coalesce("_to", col(column))).drop("_from", "_to")


def fuzzy_check(df: DataFrame, columns: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose value is not its canonical form."""
    found = mapping(df, columns, threshold).groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("original") != F.col("canonical"), F.col("n"))), F.lit(0)).alias("bad"), F.sum("n").alias("n"))
    return found.select(_row("fuzzy_standardization", F.col("column"), F.col("bad"), F.col("n"), "consistency").alias("r")).select("r.*")


def values(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of distinct values that are not blank."""
    return df.where(col(column).isNotNull() & (F.trim(col(column)) != "")).groupBy(F.trim(col(column)).alias("value")).agg(F.count("*").alias("n"))


def lookup(own: DataFrame, names: DataFrame) -> DataFrame:
    """Tier 1. names: (name, canonical). Exact matches count 1.0, normalised ones 0.99."""
    exact = names.groupBy(F.col("name").alias("_n")).agg(F.min("canonical").alias("_exact"))
    plain = names.groupBy(normal(F.col("name")).alias("_p")).agg(F.min("canonical").alias("_normal"))
    out = own.join(exact, F.col("value") == F.col("_n"), "left").join(plain, normal(F.col("value")) == F.col("_p"), "left")
    return out.select(*own.columns, F.coalesce("_exact", "_normal").alias("canonical"), F.when(F.col("_exact").isNotNull(), 1.0).when(F.col("_normal").isNotNull(), 0.99).alias("confidence"))


def blocked_candidates(own: DataFrame, canonicals: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """Tier 2 pairs (value, canonical, similarity), the best `most` of each value.

    All canonicals, where there are at most `most`; else those of equal first letter and neighbouring length class, both of
    normal forms; a value with fewer than MIN_BLOCK of these, or without a letter, is compared with all. Blocks are joined by
    equality on (first letter, length class), each canonical standing in three classes; all canonicals, by equality on their part.
    """
    first = lambda c: F.substring(c, 1, 1).alias("f")
    place = lambda c: F.when(F.length(c) <= 3, 0).when(F.length(c) <= 6, 1).when(F.length(c) <= 12, 2).otherwise(3)
    pairs, rest = None, own.select("value")
    if canonicals.limit(most + 1).count() > most:
        plain = safe_normal()
        left = own.withColumn("p", plain("value")).select("value", first("p"), place("p").alias("b"))
        right = canonicals.withColumn("p", plain("canonical")).select("canonical", first("p"), F.explode(F.array(*[place("p") + d for d in (-1, 0, 1)])).alias("b"))
        # a canonical without a letter stands in the blocks of all letters
        blank = right.where("f = ''").drop("f")
        lettered, blanks = right.where("f <> ''").groupBy("f", "b").agg(F.count("*").alias("m")), blank.groupBy("b").agg(F.count("*").alias("o"))
        left = left.join(lettered, ["f", "b"], "left").join(blanks, "b", "left").withColumn("many", (F.col("f") != "") & (F.coalesce("m", F.lit(0)) + F.coalesce("o", F.lit(0)) >= MIN_BLOCK))
        near, rest = left.where("many"), left.where("not many").select("value")
        pairs = near.join(right.where("f <> ''"), ["f", "b"]).select("value", "canonical").unionByName(near.join(blank, "b").select("value", "canonical"))
    every = rest.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))).join(canonicals.select("canonical", F.pmod(F.xxhash64("canonical"), F.lit(PARTS)).cast("int").alias("part")), "part").select("value", "canonical")
    pairs = (every if pairs is None else pairs.unionByName(every)).select("value", "canonical", (ratio_sql("value", "canonical") / 100).alias("similarity"))
    best = Window.partitionBy("value").orderBy(F.desc("similarity"), "canonical")
    return pairs.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most).drop("k")


def resolve(own: DataFrame, names: DataFrame, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """(value, n, canonical, tier, similarity, decision): auto, review or no_match. names: (name, canonical)."""
    first = lookup(own, names)
    open_ = first.where("canonical is null").select("value")
    best = blocked_candidates(open_, names.select("canonical").distinct()).groupBy("value").agg(F.max_by(F.struct("canonical", "similarity"), F.struct("similarity", "canonical")).alias("best"))
    out = first.join(best, "value", "left")
    sim = F.coalesce("confidence", F.col("best.similarity"))
    hit = F.coalesce(sim, F.lit(0.0)) >= review
    tier = F.when(F.col("confidence").isNotNull(), 1).when(hit, 2).otherwise(0)
    decision = F.when(F.col("confidence").isNotNull() | (sim >= auto), "auto").when(hit, "review").otherwise("no_match")
    return out.select("value", "n", F.when(hit, F.coalesce("canonical", "best.canonical")).alias("canonical"), tier.alias("tier"), F.round(sim, 4).alias("similarity"), decision.alias("decision"))


def resolve_vectors(own: DataFrame, canonicals: DataFrame, auto: float = VECTOR_AUTO, review: float = VECTOR_REVIEW) -> DataFrame:
    """Tier 3. own (id, vector) against a short, stated list canonicals (name, vector): the most similar name and the decision."""
    listed = canonicals.agg(F.collect_list(F.struct("name", F.col("vector").cast("array<double>").alias("vector"))).alias("all"))
    scored = own.withColumn("all", listed.scalar()).select("id", F.explode(F.transform("all", lambda c: F.struct(F.round(cosine(F.col("vector").cast("array<double>"), c["vector"]), 6).alias("similarity"), c["name"].alias("name")))).alias("m"))
    best = scored.groupBy("id").agg(F.max_by("m", F.struct("m.similarity", "m.name")).alias("m"))
    return best.select("id", F.col("m.name").alias("name"), F.col("m.similarity").alias("similarity"), F.when(F.col("m.similarity") >= auto, "auto").when(F.col("m.similarity") >= review, "review").otherwise("no_match").alias("decision"))


def cascade(own: DataFrame, names: DataFrame, vectors: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """resolve(), then tier 3 for what has no match, by vectors: ((value, vector) of values, (name, vector) of canonicals).

    (value, n, canonical, candidate, tier, similarity, decision, requires_review, reason). An empty value has no match and
    needs no review; any other value without one does, with its best candidate.
    """
    out = resolve(own, names).withColumn("reason", F.when(F.trim("value") == "", "empty_value").when(F.col("decision") == "no_match", "below_all_thresholds"))
    out = out.withColumn("candidate", F.col("canonical"))
    if vectors is not None:
        open_ = out.where("decision = 'no_match' and reason <> 'empty_value'").select("value")
        third = resolve_vectors(vectors[0].join(open_, "value", "left_semi").select(F.col("value").alias("id"), "vector"), vectors[1])
        third = third.select(F.col("id").alias("value"), F.col("name").alias("_name"), F.col("similarity").alias("_sim"), F.col("decision").alias("_decision"))
        hit = F.coalesce(F.col("_decision"), F.lit("no_match")) != "no_match"
        out = out.join(third, "value", "left").select("value", "n", F.when(hit, F.col("_name")).otherwise(F.col("canonical")).alias("canonical"), F.coalesce("candidate", "_name").alias("candidate"), F.when(hit, 3).otherwise(F.col("tier")).alias("tier"), F.when(hit, F.col("_sim")).otherwise(F.greatest("similarity", "_sim")).alias("similarity"), F.when(hit, F.col("_decision")).otherwise(F.col("decision")).alias("decision"), F.when(~hit, F.col("reason")).alias("reason"))
    return out.select("value", "n", "canonical", "candidate", "tier", "similarity", "decision", ((F.col("decision") != "auto") & (F.trim("value") != "")).alias("requires_review"), "reason")


def review_queue(resolved: DataFrame, column: str, entity_type: str) -> DataFrame:
    """The values that someone has to look at, in a form that shows no personal data."""
    return resolved.where("decision = 'review'").select(F.lit(column).alias("column"), F.lit(entity_type).alias("entity_type"), display(F.col("value")).alias("value"), display(F.col("candidate")).alias("candidate"), "similarity", "tier")


def eligible(roles: dict[str, str], types: Sequence[dict]) -> dict[str, str]:
    """column -> entity type, of the columns that a type names (in any case) and whose role it takes; personal data is never resolved.
    types: (entity_type, columns, eligible_roles)."""
    out = {}
    for name, role in roles.items():
        own = next((t for t in types if name.casefold() in {c.casefold() for c in t["columns"]}), None)
        if own is not None and role != "pii" and role in own["eligible_roles"]:
            out[name] = own["entity_type"]
    return out


def first_seen(df: DataFrame, column: str, order: str = "_rid") -> DataFrame:
    """(value, n, first) of distinct values that are not blank, with the place where each is seen first."""
    return df.where(col(column).isNotNull() & (F.trim(col(column)) != "")).groupBy(F.trim(col(column)).alias("value")).agg(F.count("*").alias("n"), F.min(col(order)).alias("first"))


def decisions(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("decision").agg(F.count("*").alias("n_values"), F.sum("n").alias("n_rows"))


def upsert(old: DataFrame, new: DataFrame, key: str = "original") -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


