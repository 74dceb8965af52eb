"""Queries over whole tables: the SQL of their counterparts without its cuts, or small cases."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quireline.plans import catalog

SF = "/root/testdata/sf0.001"


def rows_of(spark, sf, name, cut, instead=""):
    """The rows of name_whole, and those of name's SQL without the given cut."""
    tables = "documents benchmark orders part customer".split()
    duck = duckdb.connect()
    for t in tables:
        duck.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    assert cut in catalog.ORACLES[name]
    want = duck.execute(catalog.ORACLES[name].replace(cut, instead))
    cols = [d[0] for d in want.description]
    plain = lambda r: tuple(round(v, 5) + 0.0 if isinstance(v, float) else v for v in r)
    got = sorted((plain(r[c] for c in cols) for r in catalog.QUERIES[f"{name}_whole"](spark, sf).collect()), key=repr)
    return got, sorted(map(plain, want.fetchall()), key=repr), len(duck.execute(catalog.ORACLES[name]).fetchall())


@pytest.mark.parametrize(("name", "cut"), [("token_jaccard_contamination", " where n_chars < 4000"), ("chunk_overlap", " where n_chars < 5000")])
def test_long_documents_and_unknown_lengths_are_read(spark, tmp_path, name, cut):
    for t in "orders part customer".split():
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    words = " ".join(f"word{i}x" for i in range(700))
    spark.createDataFrame([(1, "some short leak of words", 24), (2, words, len(words)), (3, "short leak", None)], "doc_id long, text string, n_chars int").coalesce(1).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(7, words[:4000]), (8, "short leak of words")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "b"))
    for a, b in (("d", "documents"), ("b", "benchmark")):
        (tmp_path / f"{b}.parquet").symlink_to(next((tmp_path / a).glob("part-*")))
    got, want, cut_rows = rows_of(spark, str(tmp_path), name, cut)
    assert got == want and len(got) > cut_rows
    assert {r[0] for r in got} == {1, 2, 3}


def test_phrases_meet_all_documents_they_share_a_word_with(spark, tmp_path):
    filler = " ".join(f"w{i}" for i in range(2000))
    phrase = "Él vio el mar, y " + "a b c d e f g h " * 5 + "fin"
    docs = [(1, f"{phrase} {filler}", 9000), (2, phrase, None), (3, "другой текст", 12), (4, f"fin {'z' * 300}", 304)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, phrase), (8, "другой")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {(r["doc_id"], r["item_id"], r["window"]): r["score"] for r in catalog.QUERIES["phrase_window_match"](spark, str(tmp_path)).collect()}
    assert set(got) == {(1, 7, "head"), (1, 7, "mid"), (1, 7, "tail"), (2, 7, "head"), (3, 8, "head"), (4, 7, "head")}
    assert got[1, 7, "head"] == got[2, 7, "head"] == got[3, 8, "head"] == 1.0 and got[4, 7, "head"] < 1


@pytest.mark.parametrize(("name", "cut", "instead"), [("theil_sen", " where o_orderpriority like '1%'", ""), ("name_similarity_rank", "c_custkey % 40 = p_partkey % 40 where p_partkey <= 400", "true")])
def test_all_orders_and_parts(spark, name, cut, instead):
    got, want, cut_rows = rows_of(spark, SF, name, cut, instead)
    assert got == want and len(got) > cut_rows


def test_all_items_are_asked_and_long_documents_aligned(spark, tmp_path):
    lines = "\n".join(f"line number {i} of a long text, with words" for i in range(200))
    spark.createDataFrame([(1, lines, "s", len(lines)), (2, lines[:400], "s", None)], "doc_id long, text string, source string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, f"{'What is it? ' * 20}{i}") for i in (3, 19, 20, 150)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert {r["qid"] for r in catalog.QUERIES["ask_questions"](spark, str(tmp_path)).collect()} == {3, 19, 20, 150}
    assert {r["doc_id"] for r in catalog.QUERIES["dp_align"](spark, str(tmp_path)).select("doc_id").distinct().collect()} == {1, 2}


def test_phrases_are_scored_in_many_tasks(spark, tmp_path):
    docs = [(i, f"common words of document number {i} " * 20) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, "common phrase"), (8, "number of words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    found = catalog.QUERIES["phrase_window_match"](spark, str(tmp_path))
    assert found.count() == 60 * 2 * 3
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions")) == 4
