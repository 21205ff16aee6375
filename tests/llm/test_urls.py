"""URL rules against DuckDB and a plain reading."""

from pyspark.sql import functions as F

from tabtrust.llm import queries, urls


def judged(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:cut], rest[cut:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_same_rows_as_sql(spark, tables, duck):
    out = queries.op6_url_filter(spark, "/root/testdata/sf0.001")
    cursor = duck.execute(urls.SQL)
    assert [c[0] for c in cursor.description] == out.columns
    assert sorted(map(tuple, out.collect())) == sorted(cursor.fetchall())


def test_odd_rows(spark):
    found = [None, "", "x", "://", "http://com", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com/en", "http://a.example.com/en/", "http://notexample.com/en/x", "http://a.net/es/?u=http://com/", "a\nb://net/fr/\nq", "http://net?/es/", "http://..net/es/", "x://y://com/", "http://com//", "http://a.net#/es/", "http://" + "a." * 500 + "net/fr/" + "p" * 5000, "http://b.com/", "http://b.com/"]
    pages = spark.createDataFrame([(i, u, 1, "x") for i, u in enumerate(found)], "page_id long, url string, bits long, Verdict string")
    out = urls.judge(pages, urls.rule_table(spark, urls.RULES))
    assert sorted(map(tuple, out.collect())) == [(i, *judged(u, urls.RULES)) for i, u in enumerate(found)]
    assert urls.judge(pages.where("false"), urls.rule_table(spark, urls.RULES)).collect() == []


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    bits = urls.bloom(keys).scalar()
    assert keys.where(~urls.may_contain(bits, F.col("key"))).count() == 0
    others = spark.range(5000).select(F.concat(F.lit("z"), "id").alias("key"))
    assert others.where(urls.may_contain(bits, F.col("key"))).count() < 500
