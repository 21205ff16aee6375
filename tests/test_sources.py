import zipfile

from pyspark.sql import functions as F

from tabtrust.sources import tables


def test_header():
    assert tables.header_row([("Name", "Age", "City"), ("Ali", "30", "Lahore"), ("Sara", "25", "Karachi")]) == 0
    assert tables.header_row([("Client Export - Q1 2024", None, None), (None, None, None), ("Name", "Age", "City"), ("Ali", "30", "Lahore"), ("Sara", "25", "Karachi"), ("Omar", "40", "Quetta")]) == 2
    assert tables.header_row([("1", "2"), ("3", "4")]) == -1
    assert tables.unique_names(["a", None, "a", " "]) == ["a", "unnamed_1", "a_1", "unnamed_3"]
    assert tables.merged_names(["Order", "Order"], ["No", "Date"]) == ["Order No", "Order Date"]


def test_sniffing():
    assert tables.magic(b"PK\x03\x04xx") == "zip"
    assert tables.magic(b"\xd0\xcf\x11\xe0") == "ole"
    assert tables.encoding("é".encode()) == "utf-8"
    assert tables.encoding(b"caf\xe9") == "cp1252"


def test_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Report;;\nName;Age;City\nAli;30;Lahore\nSara;NA;\n;;\nOmar;40;Quetta\n")
    rows = tables.load(spark, f"{tmp_path}/t.csv")["t"].orderBy("_rid").collect()
    assert [tuple(r) for r in rows] == [(0, "Ali", "30", "Lahore"), (1, "Sara", None, None), (2, "Omar", "40", "Quetta")]


def sheet(rows):
    cells = "".join(f'<row r="{i + 1}">' + "".join(f'<c r="{chr(65 + j)}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for j, v in enumerate(r) if v is not None) + "</row>" for i, r in enumerate(rows))
    return f'<worksheet xmlns="{tables.NS["m"]}"><sheetData>{cells}</sheetData></worksheet>'


def test_xlsx(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.csv", "w") as z:  # a workbook by its bytes, whatever the name says
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{tables.NS["m"]}" xmlns:r="{tables.NS["r"]}"><sheets><sheet name="One" r:id="a"/><sheet name="Gone" state="hidden" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/worksheets/s1.xml", sheet([("Name", "City"), ("Ali", None), ("Sara", "Lahore")]))
    found = tables.load(spark, f"{tmp_path}/b.csv")
    assert list(found) == ["One"]
    assert [tuple(r) for r in found["One"].orderBy("_rid").collect()] == [(0, "Ali", None), (1, "Sara", "Lahore")]


def test_history(spark, tmp_path):
    runs = spark.createDataFrame([("a", 1, 70.0), ("a", 2, 80.0), ("b", 3, 60.0)], "client string, completed_at long, score double")
    tables.append(runs, f"{tmp_path}/runs")
    assert [r["completed_at"] for r in tables.runs(spark, f"{tmp_path}/runs", "a").collect()] == [2, 1]
    tables.event(spark, f"{tmp_path}/log", "r1", "started", sheet="One")
    assert spark.read.json(f"{tmp_path}/log").first()["event"] == "started"


def wide(spark, n):
    return spark.range(n, numPartitions=16).select(F.col("id").alias("_rid"), *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))).alias(f"c{i}") for i in range(5)])


def test_numbered_loses_no_row(spark, tmp_path):
    """Rows as written, not as counted: no row is lost and no number is given twice, in the order of the old numbers."""
    n = 1_200_000
    rows = wide(spark, n).withColumn("_rid", F.col("_rid") * 7 + 3)
    tables.numbered(rows, "_rid").write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert tuple(out.agg(F.count("*"), F.count_distinct("_rid"), F.min("_rid"), F.max("_rid")).first()) == (n, n, 0, n - 1)
    assert out.where(F.md5(F.concat((F.col("_rid")).cast("string"), F.lit("0"))) != F.col("c0")).count() == 0
    assert tables.numbered(rows.where("false"), "_rid").count() == 0


def test_numbered_ranges(spark, monkeypatch):
    """Many ranges, ties and nulls."""
    monkeypatch.setattr(tables, "RANGE_ROWS", 10)
    rows = spark.createDataFrame([(None if i % 97 == 0 else (i * 31) % 500, str(i)) for i in range(3000)], "k long, c string")
    got = tables.numbered(rows, "k").collect()
    assert sorted(r["_rid"] for r in got) == list(range(3000)) and {r["c"] for r in got} == {str(i) for i in range(3000)}
    inorder = [r["k"] for r in sorted(got, key=lambda r: r["_rid"])]
    assert inorder == sorted(inorder, key=lambda k: -1 if k is None else k)


def test_csv_of_several_files(spark, tmp_path):
    n = 300_000
    wide(spark, n).drop("_rid").repartition(5).write.csv(str(tmp_path / "many.csv"))
    raw = tables.read_csv(spark, str(tmp_path / "many.csv"), b",".join([b"x"] * 5) + b"\n")
    raw.write.parquet(str(tmp_path / "raw"))
    out = spark.read.parquet(str(tmp_path / "raw"))
    assert tuple(out.agg(F.count("*"), F.count_distinct("_rid"), F.max("_rid"), F.count_distinct("c0")).first()) == (n, n, n - 1, n)


def test_unique_names_never_repeat():
    assert tables.unique_names(["x", "x", "x_1"]) == ["x", "x_2", "x_1"]
    assert tables.unique_names(["x", "x", "x", None, " "]) == ["x", "x_1", "x_2", "unnamed_3", "unnamed_4"]
