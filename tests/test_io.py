import json

from pyspark.sql import functions as F

from quireline.sources import readers as R
from quireline.sources import writers as K
from quireline.streaming import progress as P


def test_pairs_and_texts(spark, tmp_path):
    for name in ("a.pdf", "a.tex", "a.txt", "b.pdf", "b.txt", "c.pdf"):
        (tmp_path / name).write_bytes(b"x\xff y" if name == "b.txt" else b"text")
    got = {r["stem"].rsplit("/", 1)[1]: r["text_path"].rsplit("/", 1)[1] for r in R.pairs(R.listing(spark, str(tmp_path))).collect()}
    assert got == {"a": "a.tex", "b": "b.txt"}
    assert R.whole_texts(spark, str(tmp_path / "b.txt")).first()["text"] == "x y"


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"qid": "a", "n": 1}\nnot json\n[1]\n{"qid": "b"}\n')
    assert sorted(r["qid"] for r in R.json_lines(spark, str(tmp_path / "x.jsonl"), "qid string, n int").collect()) == ["a", "b"]
    (tmp_path / "x.csv").write_text('\ufeffqid,t\n1,"a\nb"\n2,\n', encoding="utf-8")
    got = R.csv_strings(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["qid", "t"] and got.count() == 2


def test_registry_round_trip(spark, tmp_path):
    row = "\t".join(["3", "T", "p", "o", "good", "0.5", "4", "9", "1", "0", "now", "n"])
    (tmp_path / "r.tsv").write_text(f"#version: 2\nbook_id\ttitle\n{row}\nshort\trow\n")
    r = R.registry(spark, str(tmp_path / "r.tsv")).first()
    assert (r["book_id"], r["quality_score"], r["summarised"], r["usable"]) == (3, 0.5, True, False)
    assert [tuple(x) for x in R.registry_meta(spark, str(tmp_path / "r.tsv")).collect()] == [("version", "2")]


def test_id_list(spark, tmp_path):
    (tmp_path / "ids").write_text("# head\nq2\nq1 # note\n\nq2\n")
    assert [r["id"] for r in R.id_list(spark, str(tmp_path / "ids")).orderBy("pos").collect()] == ["q2", "q1"]


def test_question_blocks_round_trip(spark):
    md = "```q0\nfirst\n```\n## Q7｜Heat\ntext\n```q0\nline 1\nline 2\n```\n```q0\nthird\n```"
    df = spark.createDataFrame([("f", md)], "file string, text string")
    got = [tuple(r) for r in R.question_blocks(df).orderBy("idx").select("idx", "qid", "title", "question").collect()]
    assert got == [(1, "Q01", "", "first"), (2, "Q7", "Heat", "line 1\nline 2"), (3, "Q7", "Heat", "third")]
    back = K.question_markdown(spark.createDataFrame(got, "idx int, qid string, title string, question string")).withColumn("file", F.lit("f")).withColumnRenamed("markdown", "text")
    assert [tuple(r) for r in R.question_blocks(back).orderBy("idx").select("idx", "qid", "title", "question").collect()] == got


def test_page_layout_and_regions(spark):
    d = spark.createDataFrame([("a", 0, 200.0, 100.0), ("a", 1, 210.0, 100.0), ("b", 0, 70.0, 100.0)], "book string, page int, width double, height double")
    assert {r["book"]: r["two_up"] for r in R.layout(d).collect()} == {"a": True, "b": False}
    t = spark.createDataFrame([("1\n2\n3\n4\n5\n6\n7\n8",)], "t string")
    assert t.select(R.unit_text(F.col("t"), "top"), R.unit_text(F.col("t"), "body"), R.unit_text(F.col("t"), "bottom")).first()[:] == ("1\n2", "3\n4\n5\n6", "7\n8")


def test_settings():
    assert R.env_keys("K", 3, {"K1": "a", "K2": "b"}) == ["a", "b"] and R.env_keys("K", 2, {"K0": "z", "K1": "a"}) == ["z", "a"]
    assert R.with_defaults({"a": {"b": None}, "f": False}, {"a": {"b": 1, "c": 2}, "f": True, "d": 3}) == {"a": {"b": None, "c": 2}, "f": False, "d": 3}


def test_flat_csv_and_report(spark, tmp_path):
    d = spark.createDataFrame([("b", [1, 2], None), ("a", [], 1.5)], "qid string, xs array<int>, v double")
    K.write_csv(d, str(tmp_path / "out"), ["v", "qid"], "qid")
    back = R.csv_strings(spark, str(tmp_path / "out"))
    assert back.columns == ["v", "qid", "xs"] and sorted((r["qid"], r["xs"]) for r in back.collect()) == [("a", "[]"), ("b", "[1,2]")]
    assert K.markdown_table(d.select("qid", "v"), ["qid"]).first()["markdown"].splitlines()[2:] == ["| a | 1.500 |", "| b |  |"]
    assert K.report_sections(spark.createDataFrame([("q", "x ```", "")], "qid string, a string, b string"), "qid", [("A", "a"), ("B", "b")]).first()["section"] == "## q\n\n### A\n\nx ` ` `"


def test_catalog_and_files(spark):
    books = spark.createDataFrame([(1, "T")], "book_id long, title string")
    ch = spark.createDataFrame([(1, 2, "B"), (1, 1, "A")], "book_id long, chapter_no int, chapter_title string")
    sec = spark.createDataFrame([(1, 1, 7, "s")], "book_id long, chapter_no int, section_id long, title string")
    got = json.loads(K.catalog_json(books, ch, sec).first()["catalog"])
    assert [c["chapter_title"] for c in got["chapters"]] == ["A", "B"] and got["chapters"][0]["sections"][0]["section_id"] == 7
    names = K.split_texts(spark.createDataFrame([(1, "a/b"), (2, "???")], "no int, title string")).orderBy("no").collect()
    assert names[0]["file_name"] == "01_a_b.txt" and len(names[1]["file_name"]) == len("02_12345678.txt")


def test_stream_upsert(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, t int").write.parquet(src)
    schema = "k string, v int, t int"
    P.start_upsert(spark.readStream.schema(schema).parquet(src), out, check, ["k"], ["t"]).awaitTermination()
    spark.createDataFrame([("b", 2, 2), ("c", 3, 2)], schema).write.mode("append").parquet(src)
    P.start_upsert(spark.readStream.schema(schema).parquet(src), out, check, ["k"], ["t"]).awaitTermination()
    assert sorted((r["k"], r["v"]) for r in P.current(spark, out).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_windowed_counts_close(spark, tmp_path):
    rows = [(f"2024-01-0{d} 10:00:00", "x", 1.0) for d in (1, 1, 2, 4)]
    spark.createDataFrame(rows, "ts string, kind string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "e"))
    s = spark.readStream.schema("ts timestamp, kind string, value double").parquet(str(tmp_path / "e"))
    q = P.windowed_counts(s, "ts", "kind").writeStream.format("memory").queryName("closed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("closed").collect()) == [1, 2]
