import datetime

import pytest
from pyspark.sql import functions as F

from tabtrust.functions import values
from tabtrust.operators import checks, classify, compliance, entities, forecast, pii, scoring
from tabtrust.plans import pipeline
from tabtrust.sources import tables
from tabtrust.streaming import profile as streams


def only(df):
    return [r.asDict() for r in df.collect()]


def test_missing_and_duplicates(spark):
    df = spark.createDataFrame([("Ali", 30), (None, 25), ("Sara", None)], "Name string, Age int")
    assert {r["column"]: r["issues_found"] for r in only(checks.missing(df))} == {"Name": 1, "Age": 1}
    keys = spark.createDataFrame([("C1", "HO", "a"), ("C1", "WHS", "b"), ("C2", "HO", "c"), ("C2", "HO", "c")], "no string, code string, city string")
    assert only(checks.duplicates(keys))[0]["issues_found"] == 1
    one = only(checks.duplicates(keys, ["no"]))[0]
    assert (one["issues_found"], one["reason"]) == (2, "rows in groups: 4")
    assert only(checks.duplicates(spark.createDataFrame([("LHR",), (" LHR ",)], "c string")))[0]["issues_found"] == 1
    assert only(checks.duplicates(keys.limit(0)))[0]["status"] == "passed"


def test_types_and_outliers(spark):
    df = spark.createDataFrame([("1",), ("2",), ("three",), ("4",)], "Age string")
    assert only(checks.type_mismatch(df))[0]["issues_found"] == 1
    df = spark.createDataFrame([(float(v),) for v in [*range(1, 11), 1000]], "Amount double")
    assert only(checks.outliers(df, ["Amount"]))[0]["issues_found"] == 1
    assert only(checks.outliers(df.where("Amount < 3"), ["Amount"]))[0]["reason"] == "insufficient_numeric_values"
    assert only(checks.outliers(df.select(F.lit(None).cast("double").alias("Amount")), ["Amount"]))[0]["reason"] == "no_numeric_values"
    assert [r["value"] for r in only(checks.knn_outliers(df, "Amount", k=2, contamination=0.1).where("outlier"))] == [1000.0]


def test_knn_against_brute_force(spark):
    own = [float((i * i * 7) % 501) for i in range(200)]
    got = {r["value"]: r["score"] for r in only(checks.knn_outliers(spark.createDataFrame([(v,) for v in own], "v double"), "v", k=5))}
    for v, score in got.items():
        near = sorted(abs(v - x) for x in own)
        assert score == near[5]


@pytest.mark.parametrize("k", [1, 5])
def test_knn_of_several_ranges(spark, monkeypatch, k):
    """Neighbours across the bounds of ranges, with nulls and repeated values."""
    monkeypatch.setattr(checks, "NEAR_ROWS", 60)
    own = [float((i * i * 7919) % 100_003) for i in range(900)] + [5.0] * 7
    df = spark.createDataFrame([(v,) for v in [*own, None, None]], "v double")
    got = {r["value"]: (r["rows"], r["score"]) for r in only(checks.knn_outliers(df, "v", k=k))}
    assert got.keys() == set(own)
    for v, (rows, score) in got.items():
        assert rows == own.count(v) and score == sorted(abs(v - x) for x in own)[k]
    assert only(checks.knn_outliers(df.where("v is null"), "v")) == []


def test_dates_of_a_table_in_one_pass(spark):
    df = spark.createDataFrame([("2024-01-01", "2020-01-01", "1", None), (None, "2019-05-05", "2", None), ("2023-12-31", "x", "b", None)], "a string, b string, c string, d string")
    got = only(checks.counted(df, [], [checks.text_kinds(df), checks.freshness_rows(df, ["a", "b", "d"], "2024-02-01")]))
    assert [(r["column"], r["issues_found"], r["total"]) for r in got if r["check_name"] == "type_mismatch"] == [("a", 0, 2), ("b", 0, 3), ("c", 1, 3), ("d", 0, 0)]
    assert [(r["column"], r["status"], r["total"]) for r in got if r["check_name"] == "freshness"] == [("a", "passed", 2), ("b", "failed", 2), ("d", "skipped", 0)]
    for c in "abd":
        assert only(checks.freshness(df, c, "2024-02-01"))[0]["status"] == next(r["status"] for r in got if r["check_name"] == "freshness" and r["column"] == c)


def test_timestamps_without_a_time_are_dates(spark):
    """A name with "ip" in it asks for addresses; only with a time of day does a timestamp look like one."""
    day = spark.range(30).select(F.timestamp_seconds(F.col("id") * 86400).alias("ship_date"))
    assert classify.classify(day)[0]["role"] == "date"
    assert classify.classify(day.select((F.col("ship_date") + F.expr("interval 5 minutes")).alias("ship_date")))[0]["role"] == "pii"


def test_validity(spark):
    df = spark.createDataFrame([(5.0, "a@b.com", "2024-01-01"), (-3.0, "no", "not a date"), (10.0, "c@d.org", "1899-01-01")], "`Order Qty` double, `Contact Email` string, `Order Date` string")
    got = {r["check_name"]: r["issues_found"] for r in only(checks.validity(df, {"Order Qty": "measurement", "Order Date": "date"}, 2025))}
    assert got == {"non_negative": 1, "email_format": 1, "date_validity": 2}


def test_rules(spark):
    df = spark.createDataFrame([("C001", "10", 10, 100), (None, "abc", 150, 100), ("  ", "25", 5, 5)], "no string, qty string, d int, t int")
    rules = checks.load_rules({"rules": [{"id": "r", "type": "required", "column": "No"}, {"id": "n", "type": "datatype", "column": "qty", "expected_type": "numeric"}, {"id": "x", "type": "cross_column", "left": "d", "op": "<=", "right": "t"}, {"id": "absent", "type": "required", "column": "zz"}]})
    assert {r["column"]: r["issues_found"] for r in only(checks.run_rules(df, rules))} == {"r:no": 2, "n:qty": 1, "x:d+t": 1}


def test_integrity(spark):
    df = spark.createDataFrame([("C1",), (None,), ("  ",), ("C2",), ("GHOST",)], "k string")
    ref = spark.createDataFrame([("C1",), ("C2 ",)], "r string")
    assert only(checks.integrity(df, "k", ref, "r"))[0]["issues_found"] == 1
    assert only(checks.integrity(df, "k", ref.limit(0), "r"))[0]["status"] == "error"
    assert [r["k"] for r in only(checks.orphans(df, "k", ref, "r"))] == ["GHOST"]


def test_classes(spark):
    rows = [(f"INV{1000 + i}", f"CUS{100 + i}", 100.0 if i < 23 else 200.0 + i, f"u{i}@x.com", "0300-1234567", "AB"[i % 2], f"2024-01-{i + 1:02d}", f"note number {i} is long and unlike the others") for i in range(25)]
    df = spark.createDataFrame(rows, "`inv.no` string, `Dimension (CUS)` string, Amount double, email string, mobile_number string, status string, order_date string, notes string")
    assert [r["legacy_role"] for r in classify.classify(df)] == ["identifier", "identifier", "measurement", "pii", "pii", "categorical", "date", "free_text"]


def test_classes_of_late_columns(spark):
    """The sample are the first values that are there, not those of the first rows."""
    late = lambda i, v: v if i >= 300 else None
    rows = [(i, late(i, f"2024-01-{i % 28 + 1:02d}"), late(i, f"u{i}@x.com"), late(i, 3001234567.0 + i) if i % 2 else float("nan")) for i in range(700)]
    df = spark.createDataFrame(rows, "line int, shipped string, email_address string, m double").repartition(3, "line").sortWithinPartitions("line")
    found = {r["column"]: r["role"] for r in classify.classify(df)}
    assert (found["shipped"], found["email_address"]) == ("date", "pii")
    values, kept = classify.heads(df), df.collect()
    assert values["shipped"] == [r["shipped"] for r in kept if r["shipped"]][:200]
    assert [float(v) for v in values["m"]] == [r["m"] for r in kept if r["m"] is not None and r["m"] == r["m"]][:200]


@pytest.mark.parametrize(
    ("text", "kind", "masked"),
    [("write john.doe@gmail.com now", "EMAIL", "write j***@gmail.com now"), ("35202-1234567-1", "CNIC", "*****-*******-1"), ("0300-1234567", "MOBILE", "****-***4567"), ("4111 1111 1111 1111", "CARD", "**** **** **** 1111"), ("ssn 123-45-6789", "SSN", "ssn [SSN]"), ("host 10.0.0.7", "IP_ADDRESS", "host x.x.x.7"), ("GB29NWBK60161331926819", "IBAN", "GB****************6819")],
)
def test_pii(text, kind, masked):
    found = pii.hits(text)
    assert [h["type"] for h in found] == [kind]
    assert pii.mask_text(text, found) == masked
    assert pii.mask_text(text, found, full=True).count(f"[{kind}]") == 1


def test_pii_of_columns(spark):
    assert pii.hits("SON2001010000022", "order no") == []
    assert pii.hits("hunter2", "password")[0]["type"] == "PASSWORD"
    assert pii.hits("GB123456789", "VAT no") == []
    df = spark.createDataFrame([("a@b.com", "x"), (None, "call 0300-1234567"), ("", None)], "email string, notes string")
    assert {(r["column"], r["type"]): r["hits"] for r in only(pii.summary(df))} == {("email", "EMAIL"): 1, ("notes", "MOBILE"): 1}
    assert only(pii.exposure(pii.identifiers(pii.summary(df.limit(0)))))[0]["status"] == "NO_PHI_DETECTED"
    cars = spark.createDataFrame([("1HGCM82633A004352",), ("1HGCM82633A004353",), (None,)], "vin string")
    assert only(pii.valid_vins(cars, "vin"))[0]["valid_vins"] == 1


def test_similarity(spark):
    pairs = [("lahore", "lahor", 90.909), ("paid", "piad", 75.0), ("kitten", "sitting", 61.538), ("", "", 100.0), ("a", "", 0.0)]
    got = spark.createDataFrame([(a, b) for a, b, _ in pairs], "a string, b string").select(values.ratio_sql("a", "b").alias("r")).collect()
    for (a, b, want), r in zip(pairs, got, strict=True):
        assert values.ratio(a, b) == pytest.approx(want, abs=1e-3) == r["r"]


def test_entities(spark):
    df = spark.createDataFrame([("LHR",), ("  lahore  ",), ("Lahor",), ("Paris",), (None,)], "City string")
    names = spark.createDataFrame([("Lahore", "Lahore"), ("LHR", "Lahore"), ("Karachi", "Karachi")], "name string, canonical string")
    got = {r["value"]: (r["canonical"], r["tier"], r["decision"]) for r in only(entities.resolve(entities.values(df, "City"), names))}
    assert got == {"LHR": ("Lahore", 1, "auto"), "lahore": ("Lahore", 1, "auto"), "Lahor": ("Lahore", 2, "auto"), "Paris": (None, 0, "no_match")}
    words = spark.createDataFrame([("Karachi",)] * 3 + [("karachi",), ("Karachii",), ("Multan",)], "c string")
    assert {r["original"]: r["canonical"] for r in only(entities.mapping(words, ["c"]))} == {"Karachi": "Karachi", "karachi": "Karachi", "Karachii": "Karachi", "Multan": "Multan"}


@pytest.mark.parametrize("others", [0, 40])
def test_candidates(spark, others):
    """Few canonicals: all are compared; many: the block, or all where it holds fewer than three."""
    long = "Grand Central Company of Rail and Sea"
    listed = ["Karachi", "Lahore", long, *[f"m{i:02d} place" for i in range(others)], *[f"g{x} {'holdings' * 3}" for x in ("abc" if others else "")]]
    names = spark.createDataFrame([(n, n) for n in listed], "name string, canonical string")
    own = spark.createDataFrame([("Xarachi", 1), (long[:-12], 2), ("Zzz", 1)], "value string, n long")
    got = {r["value"]: (r["canonical"], r["decision"]) for r in only(entities.resolve(own, names))}
    assert got == {"Xarachi": ("Karachi", "auto"), long[:-12]: (long, "review"), "Zzz": (None, "no_match")}
    pairs = only(entities.blocked_candidates(own, names.select("canonical")))
    assert len([r for r in pairs if r["value"] == "Zzz"]) == min(25, len(listed))
    assert len([r for r in pairs if r["value"] == long[:-12]]) == (4 if others else 3)


def test_readiness(spark):
    start = datetime.date(2022, 1, 1)
    days = lambda n: spark.createDataFrame([(start + datetime.timedelta(i), float(i % 17 + 1)) for i in range(n)], "d date, y double")
    assert only(forecast.temporal(days(731), "d"))[0]["blockers"] == []
    assert only(forecast.temporal(days(365), "d"))[0]["blockers"] == ["too_few_cycles"]
    assert only(forecast.intervals(days(100), "d"))[0]["regularity"] == 1.0
    assert only(forecast.intervals(days(100).unionAll(days(1)), "d"))[0]["blockers"] == ["duplicate_dates"]
    assert only(forecast.target(days(100).withColumn("y", F.lit(50.0)), "y"))[0]["blockers"] == ["no_variance"]
    leak = only(forecast.leakage(days(100).withColumn("z", F.col("y") + 5), "y", ["z"]))[0]
    assert leak["leaks"]
    assert only(forecast.readiness(days(800), "d", "y", []))[0]["status"] == "ready"


def test_scores(spark):
    rows = [("a", "x", "passed", 0, 10, 1.0, "completeness", None), ("b", "y", "failed", 5, 10, None, "validity", None), ("c", "z", "error", 0, 0, None, "validity", None), ("d", "w", "passed", 0, 1, None, "validity", "skipped_role")]
    dims = scoring.dimensions(spark.createDataFrame(rows, checks.RESULT))
    assert {r["dimension"]: r["score"] for r in only(dims)} == {"completeness": 100.0, "validity": 0.0}
    one = only(scoring.capped(scoring.composite(dims), "medium"))[0]
    assert (one["data_quality_score"], one["compliance_adjusted_score"], one["rating"]) == (50.0, 50.0, "Poor")


def test_repair(spark):
    bad = "café".encode().decode("cp1252")
    got = spark.createDataFrame([(bad,), ("plain",), (None,)], "t string").select(values.repaired(F.col("t")).alias("t")).collect()
    assert [r["t"] for r in got] == ["café", "plain", None]


def test_quantiles_in_bounded_memory(spark):
    """Exact quartiles, whatever few values a pass holds; ties, one value only, and columns without numbers."""
    import numpy as np

    rng = np.random.default_rng(4)
    own = {"a": rng.standard_normal(20_000), "b": rng.integers(0, 5, 20_000).astype(float), "c": np.full(20_000, 3.0), "d": np.exp(4 * rng.standard_normal(20_000))}
    rows = list(zip(*(v.tolist() for v in own.values()), strict=True))
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").withColumn("e", F.lit(None).cast("double"))
    got = checks.quantiles(df, [F.col(c) for c in df.columns], (0.25, 0.5, 0.9), held=50, accuracy=40)
    for (n, q), v in zip(got, own.values(), strict=False):
        assert n == 20_000 and q == pytest.approx(np.quantile(v, (0.25, 0.5, 0.9)).tolist(), rel=1e-12)
    assert got[4] == (0, [None, None, None])


def test_rule_files(spark, tmp_path):
    import json

    (tmp_path / "base.json").write_text(json.dumps({"rules": [{"id": "a", "type": "required", "column": "x"}], "settings": {"deep": {"k": 1, "l": 2}}}))
    (tmp_path / "own.json").write_text(json.dumps({"rules": [{"id": "b", "type": "min_max", "column": "y", "max": 5, "severity": "high"}]}))
    assert [r.id for r in checks.read_rules(spark, str(tmp_path / "base.json"))] == ["a"]
    assert [(r.id, r.severity) for r in checks.read_rules(spark, str(tmp_path / "base.json"), str(tmp_path / "own.json"))] == [("b", "HIGH")]
    assert checks.merged_spec({"a": {"k": 1, "l": [1, 2]}, "b": 1}, {"a": {"l": [3]}}) == {"a": {"k": 1, "l": [3]}, "b": 1}
    (tmp_path / "bad.json").write_text(json.dumps({"rules": [{"id": "b", "type": "colour"}]}))
    with pytest.raises(ValueError):
        checks.read_rules(spark, str(tmp_path / "bad.json"))


def test_cascade_and_queue(spark):
    own = spark.createDataFrame([("LHR", 2), ("lahore ", 1), ("Lahor", 1), ("Zzz", 1), (" ", 1), ("lahoreab", 1)], "value string, n long")
    names = spark.createDataFrame([("Lahore", "Lahore"), ("LHR", "Lahore"), ("Karachi", "Karachi")], "name string, canonical string")
    got = {r["value"]: r for r in entities.cascade(own, names).collect()}
    assert (got["LHR"]["tier"], got["lahore "]["tier"], got["Lahor"]["tier"]) == (1, 1, 2)
    assert (got["Zzz"]["decision"], got["Zzz"]["requires_review"], got["Zzz"]["reason"]) == ("no_match", True, "below_all_thresholds")
    assert (got[" "]["decision"], got[" "]["requires_review"], got[" "]["reason"]) == ("no_match", False, "empty_value")
    queue = only(entities.review_queue(entities.cascade(own, names, None), "City", "city"))
    assert [(r["column"], r["value"], r["candidate"]) for r in queue] == [("City", "lahoreab", "Lahore")] or got["lahoreab"]["decision"] == "auto"
    types = [{"entity_type": "city", "columns": ("City",), "eligible_roles": ("categorical",)}]
    assert entities.eligible({"CITY": "categorical", "Name": "categorical"}, types) == {"CITY": "city"}
    assert entities.eligible({"City": "pii"}, [{**types[0], "eligible_roles": ("pii",)}]) == {}


def test_mapping_of_any_size(spark):
    """More than 500 rows of a mapping are all applied."""
    df = spark.range(3000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    found = df.select(F.lit("c").alias("column"), F.col("c").alias("original"), F.upper("c").alias("canonical"))
    assert entities.standardize(df, "c", found).where(F.col("c") != F.upper("c")).count() == 0


def test_assessment_has_compliance(spark):
    df = spark.createDataFrame([(f"P{i:07d}", f"c{i}@mail.com", i % 100) for i in range(60)], "patient_id string, email string, patient_age long")
    out = pipeline.assess(df, "2024-01-01")
    assert {r["identifier"] for r in out.phi.collect()} == {"hipaa_08_medical_record", "hipaa_06_email"}
    one = out.score.first()
    assert one["severity"] == "medium" and one["compliance_adjusted_score"] <= 74.0
    assert compliance.posture(out.phi).first()["status"] == "PHI_DETECTED"


def test_encoding_check():
    assert tables.encoding_check(b"")["reason"] == "empty_bytes" and tables.encoding_check(b"")["status"] == "failed"
    assert tables.encoding_check("abc é".encode()) == {"status": "passed", "encoding": "utf-8", "confidence": 0.99, "reason": None}
    low = tables.encoding_check(b"caf\xe9 \x93quoted\x94")
    assert (low["status"], low["encoding"], low["reason"]) == ("failed", "cp1252", "low_confidence")


def test_stream_without_repeats(spark, tmp_path):
    import datetime as dt

    rows = [(i % 5, dt.datetime(2024, 1, 1, 0, i)) for i in range(10)]
    spark.createDataFrame(rows, "k long, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, ts timestamp").parquet(str(tmp_path / "in"))
    seen = []
    q = streams.profile_batches(streams.without_repeats(stream, ["k"], "ts"), lambda df, _: seen.extend(r["k"] for r in df.collect()), str(tmp_path / "at"))
    q.awaitTermination()
    assert sorted(seen) == [0, 1, 2, 3, 4]


def test_quantiles_between_ties(spark):
    """A rank between two values of which each has more rows than a pass holds: the search ends, and both values count."""
    import numpy as np

    own = np.repeat([1.0, 2.0, 3.0, 4.0], 1000)
    df = spark.createDataFrame([(v,) for v in own.tolist()], "a double")
    ((n, q),) = checks.quantiles(df, [F.col("a")], (0.25, 0.5, 0.75), held=50, accuracy=40)
    assert (n, q) == (4000, [1.75, 2.5, 3.25])


def test_quantiles_of_extreme_numbers(spark):
    """Signs, zeros, subnormal, huge and infinite values, and a narrow range far from zero, in parts of any size."""
    import numpy as np

    rng = np.random.default_rng(5)
    edge = [-float("inf"), -1.7e308, -1e-320, -0.0, 0.0, 5e-324, 1e-320, 1.7e308, float("inf")]
    own = {"a": np.array(edge * 100), "b": 1.7e9 + np.arange(900) / 1024, "c": rng.integers(-9, 9, 900) * 10.0 ** rng.integers(-300, 300, 900)}
    df = spark.createDataFrame(list(zip(*(v.tolist() for v in own.values()), strict=True)), "a double, b double, c double")
    shares = [i / 31 for i in range(32)]  # 899 = 29 * 31: every rank is whole
    got = checks.quantiles(df, [F.col(c) for c in own], shares, held=3, accuracy=4)
    assert [n for n, _ in got] == [900] * 3
    for (_, q), v in zip(got, own.values(), strict=True):
        assert q == np.sort(v)[[29 * i for i in range(32)]].tolist()


def test_outliers_read_once_after_the_quartiles(spark):
    """Fences are plain numbers in the pass that counts: nothing is looked up by row, and nothing else is computed again."""
    df = spark.createDataFrame([(float(i % 10), float(i)) for i in range(100)] + [(900.0, None), (None, None)], "a double, b double").withColumn("c", F.lit(None).cast("double"))
    out = checks.outliers(df, ["a", "b", "c"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "ubquery" not in plan and "map_from_entries" not in plan
    assert [(r["column"], r["issues_found"], r["total"], r["reason"]) for r in only(out)] == [("a", 1, 101, None), ("b", 0, 100, None), ("c", 0, 0, "no_numeric_values")]


def test_quantiles_take_one_logarithm_a_number(spark):
    """Parts of powers of two are whole numbers that never fall when the number rises."""
    import numpy as np

    own = np.sort(np.concatenate([s * 2.0 ** np.arange(-1070, 1024) for s in (-1.0, -1.3, 1.0, 1.7)] + [[0.0, float("inf"), -float("inf")]]))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(own.tolist())], "i int, x double")
    out = df.select("i", checks._binade(F.col("x")).alias("b"))
    assert dict(out.dtypes)["b"] == "int"
    got = [r["b"] for r in out.orderBy("i").collect()]
    assert got == sorted(got) and len(set(got)) == len(got)


@pytest.mark.parametrize("many", [100_000, 3, 0])
def test_duplicate_rows_by_hash_codes(spark, monkeypatch, many):
    """Equal rows are found by hash codes and counted by their keys, whether few or many codes repeat; codes of unlike rows may be equal."""
    monkeypatch.setattr(checks, "MANY", many)
    rows = [(i, f"t{i % 7}", None if i % 3 else 0.0) for i in range(40)] + [(1, " t1", None)] * 3 + [(3, "t3", -0.0), (None, " ", None), (None, None, None)]
    df = spark.createDataFrame(rows, "a long, b string, c double")
    one = only(checks.duplicates(df))[0]
    assert (one["issues_found"], one["total"], one["reason"]) == (5, 46, "rows in groups: 8")
    assert only(checks.duplicates(df.where("a < 1")))[0]["reason"] == "rows in groups: 0"
    assert only(checks.duplicates(df.where("false")))[0]["total"] == 0
    monkeypatch.setattr(F, "xxhash64", lambda *c: F.lit(1).cast("long") + F.length(F.concat_ws("", *[x.cast("string") for x in c])) * 0)
    assert only(checks.duplicates(df))[0]["reason"] == "rows in groups: 8"


def test_rows_without_repeats_are_not_shuffled_whole(spark):
    df = spark.range(50).selectExpr("id a", "id % 3 b", "id % 7 c", "cast(id as string) d")
    plan = checks.duplicates(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" not in plan and "k3" not in plan


def test_profile_counts_cells_in_their_own_type(spark):
    """Numbers and moments are never written as text, so zeros of both signs are one value; numbers in texts are counted by value."""
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    rows = [(0.0, 1, at, "1,000", True, at.date(), [1], b"1"), (-0.0, 1, at, " ", False, None, [1], b"1"), (float("nan"), 2, at + dt.timedelta(microseconds=1), "x", None, None, None, None), (None, None, None, "7", None, None, [2], None), (2.5, 3, None, None, None, at.date(), None, None)]
    df = spark.createDataFrame(rows, "a double, b int, c timestamp, d string, e boolean, f date, g array<int>, h binary").withColumn("i", F.col("b").cast("decimal(9,2)"))
    got = {r["column"]: (r["rows"], r["non_null"], r["distinct"], r["top_n"], r["numbers"], r["times"], r["loose"], r["texts"]) for r in classify.facts(df).collect()}
    assert got == {"a": (5, 3, 2, 2, 3, 0, 0, 0), "b": (5, 4, 3, 2, 4, 0, 0, 0), "c": (5, 3, 2, 2, 0, 1, 0, 0), "d": (5, 4, 4, 1, 1, 0, 2, 3), "e": (5, 2, 2, 1, 0, 0, 0, 0), "f": (5, 2, 1, 2, 0, 0, 0, 0), "g": (5, 3, 2, 2, 0, 0, 0, 0), "h": (5, 2, 1, 2, 0, 0, 0, 0), "i": (5, 4, 3, 2, 4, 0, 0, 0)}
    plan = classify.profile(df.select("a", "b", "c", "f"))._jdf.queryExecution().optimizedPlan().toString()
    assert "as string" not in plan


def test_known_kinds_of_texts(spark):
    """What classification knows by value gives the rows that a pass over all cells gives."""
    df = spark.createDataFrame([("1,5", "a", None, " "), ("2", "b", None, "3"), (" x", "1", None, None)], "a string, b string, c string, d string").withColumn("e", F.lit(1))
    assert sorted(checks.known_text_kinds(df, classify.classify(df)).collect()) == sorted(checks.counted(df, [], [checks.text_kinds(df)]).collect())


def test_spellings_are_normalised_once_a_value(spark):
    df = spark.createDataFrame([("A b",)] * 3 + [(" a  B",)] * 2 + [("c",), (None,)], "s string")
    out = checks.consistency(df, ["s"])
    assert [(r["issues_found"], r["total"]) for r in only(out)] == [(2, 6)]
    below = out._jdf.queryExecution().optimizedPlan().toString().rsplit("Aggregate", 1)[1].split("\n", 1)[1]
    assert "lower" not in below


def test_parts_of_roots_never_fall():
    """Bounds of the first pass rise with the number, over all of its range, and both zeros share a part."""
    import numpy as np

    own = np.sort(np.concatenate([s * 2.0 ** np.arange(-1074, 1024) for s in (-1.0, -1.3, 1.0, 1.7)] + [[0.0, -0.0, float("inf"), -float("inf")]]))
    size = np.minimum(np.sqrt(np.sqrt(np.sqrt(np.abs(own)))) * checks.ROOTS, checks.MOST_ROOTS).astype(int)
    want = np.where(own < 0, -1 - size, size)
    assert (np.diff(want) >= 0).all()


def test_first_pass_of_quantiles(spark):
    """Keys of the first pass are whole numbers without a logarithm; the parts are those of the definition."""
    own = [-float("inf"), -1e300, -2.0, -1e-300, -0.0, 0.0, 1e-300, 0.03, 7.0, 7.0001, 1e300, float("inf")]
    out = spark.createDataFrame([(i, v) for i, v in enumerate(own)], "i int, x double").select("i", checks._root(F.col("x")).alias("b"))
    assert dict(out.dtypes)["b"] == "int" and "LOG" not in out._jdf.queryExecution().optimizedPlan().toString().upper().replace("LOGICALRDD", "")
    got = [r["b"] for r in out.orderBy("i").collect()]
    assert got == sorted(got)
    assert got == [-1 - checks.MOST_ROOTS, -1 - checks.MOST_ROOTS, -1 - int(2.0**0.125 * checks.ROOTS), -1, 0, 0, 0, int(0.03**0.125 * checks.ROOTS), int(7.0**0.125 * checks.ROOTS), int(7.0001**0.125 * checks.ROOTS), checks.MOST_ROOTS, checks.MOST_ROOTS]


def test_columns_within_their_fences_are_not_counted_again(spark, tmp_path):
    """The least and the largest number say that none is beyond; only a column with outliers, or with infinite quartiles, is read again."""
    inf = float("inf")
    rows = [(float(i % 10), float(i % 10), inf if i % 2 else -inf, None) for i in range(100)] + [(None, 900.0, 3.0, 1.0)]
    spark.createDataFrame(rows, "a double, b double, c double, d double").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = lambda *c: checks.outliers(df, list(c))._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan("a", "d")
    assert "isnan(b#" in plan("a", "b", "d") and "isnan(a#" not in plan("a", "b", "d")
    got = [(r["column"], r["status"], r["issues_found"], r["total"], r["quality_ratio"], r["reason"]) for r in only(checks.outliers(df, ["a", "b", "d"]))]
    assert got == [("a", "passed", 0, 100, 1.0, None), ("b", "failed", 1, 101, round(1 - 1 / 101, 6), None), ("d", "passed", 0, 1, 1.0, "insufficient_numeric_values")]
    low, high = (-inf - 1.5 * inf), inf + 1.5 * inf
    assert only(checks.outliers(df, ["c"]))[0]["issues_found"] == only(df.where((F.col("c") < low) | (F.col("c") > high)).agg(F.count("*").alias("n")))[0]["n"]


def test_texts_are_bared_once_a_cell(spark):
    """Trimming and separators are done once, below the aggregate; the counts are those of text_kinds(), whatever the cells."""
    rows = [("1,000", " "), (" 2 ", None), ("x", "1e3"), ("", "NaN"), (",", "1d"), ("-.5", "Infinity"), (None, ", 7"), ("3.", "\t4\n"), ("1,,2", "5,")]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "a string, `b.c` string, d int")
    out = checks.type_mismatch(df)
    want = checks.counted(df, checks.typed_tests(df), [checks.text_kinds(df)])
    assert out.columns == want.columns and out.collect() == want.collect()
    plan = checks.type_mismatch(spark.range(9).select(F.concat(F.col("id").cast("string"), F.lit(" ")).alias("t")))._jdf.queryExecution().optimizedPlan().toString()
    top = plan[plan.index("Aggregate") :].split("\n", 1)[0]
    assert "trim" not in top and "replace" not in top


def test_spellings_of_one_column_are_not_exploded(spark):
    df = spark.createDataFrame([("A b", "x"), (" a  B", "X"), ("A b", None), (None, "x")], "s string, t string")
    one = checks.consistency(df, ["s"])
    assert "Generate" not in one._jdf.queryExecution().optimizedPlan().toString()
    both = {r["column"]: r for r in only(checks.consistency(df, ["s", "t"]))}
    assert only(one) == [both["s"]] and (both["s"]["issues_found"], both["s"]["total"], both["t"]["issues_found"], both["t"]["total"]) == (1, 3, 1, 3)


def test_target_within_its_fences_has_no_comparison(spark):
    """Outliers are only looked for where the least or the largest number is beyond the fences."""
    df = spark.range(100).select((F.col("id") % 10).cast("double").alias("y"))
    plan = lambda d: forecast.target(d, "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "13.5" not in plan(df) and only(forecast.target(df, "y"))[0]["outlier_pct"] == 0.0
    more = df.unionByName(spark.createDataFrame([(900.0,), (None,), (float("inf"),)], "y double"))
    one = only(forecast.target(more, "y"))[0]
    assert (one["outlier_pct"], one["infinite"], one["high"], one["rows"]) == (round(100 / 102, 2), 1, 900.0, 103)


def test_checks_run_side_by_side(spark):
    """Checks that don't need each other run at the same time; their rows are those of a union, in its order, and need no Python worker."""
    import threading

    a = spark.createDataFrame([(float(i % 10), str(i) if i % 9 else "x\u00e9\"\n") for i in range(100)] + [(900.0, None), (None, " ")], "a double, `b.c` string")
    met, groups = threading.Barrier(3, timeout=60), []

    def part(check):
        def run():
            met.wait()  # breaks unless all three have begun
            groups.append(spark.sparkContext.getLocalProperty("spark.jobGroup.id"))
            return check()

        return run

    own = [lambda: checks.missing(a), lambda: checks.outliers(a, ["a"]), lambda: checks.type_mismatch(a)]
    spark.sparkContext.setJobGroup("own", "checks")
    out = checks.side_by_side(spark, [part(c) for c in own])
    want = own[0]().unionByName(own[1]()).unionByName(own[2]())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert groups == ["own"] * 3 and out.dtypes == want.dtypes and out.collect() == want.collect()
    assert "LocalRelation" in out._jdf.queryExecution().optimizedPlan().toString()
    assert checks.side_by_side(spark, []).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        checks.side_by_side(spark, [own[0], lambda: a.select("nowhere")])


def test_top_issues_are_ranked_after_all_checks(spark):
    """The checks have been counted, side by side, when the issues are ranked: the ranking reads no table."""
    from tabtrust.plans import catalog

    plan = catalog.QUERIES["tk5_top_issues"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "LocalRelation" in plan
