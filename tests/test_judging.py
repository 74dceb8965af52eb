"""Judge replies, evidence and titles: every code occurs, and what SQL doesn't state."""

import json

from pyspark.sql import functions as F

from quireline.functions import vector as V
from quireline.operators import judging as J
from quireline.operators import titles as T
from quireline.plans import judging as P


def test_every_reply_code_occurs(spark):
    d = spark.createDataFrame([(i, r) for i, r in enumerate(P.REPLIES)], "i int, r string")
    got = {r["i"]: r["e"] for r in d.select("i", J.judge_object_errors(F.col("r")).alias("e")).collect()}
    assert got[0] == [] and got[1] == got[2] == got[3] == ["not_dict"]
    seen = {c for e in got.values() for c in e}
    assert {"schema_version_mismatch", "missing_qid", "missing_scores", "scores_not_dict", "scores_missing_derivation", "scores_out_of_range_overall", "scores_not_int_correctness", "confidence_out_of_range", "confidence_not_float", "should_use_tools_not_bool", "used_evidence_indices_not_list", "used_evidence_indices_not_int", "key_issues_not_list", "unsupported_claims_not_list"} <= seen
    assert "missing_mode" not in got[6] and "scores_not_int_clarity" in got[10] and "scores_out_of_range_hallucination_resistance" not in got[10]


def test_every_contents_verdict_occurs(spark):
    got = {r["reason"] for r in P.contents_checks(spark, "/root/testdata/sf0.001").select("reason").distinct().collect()}
    assert got == {"too_many_chapters", "too_few_chapters", "titles_template_only", "printed_page_too_sparse", "printed_page_span_too_small", "toc_starts_late", "ok"}


def test_judge_input(spark):
    answers = spark.createDataFrame([("q1", "M1", "why?", "x" * 50, "answer1", True), ("q2", "M2", None, None, None, False)], "qid string, mode string, question string, final_answer string, selected string, retrieval_used boolean")
    shown = J.evidence(spark.createDataFrame([("q1", 2, "section", "s2", "second"), ("q1", 1, "section", "s1", "f" * 30), ("q1", 3, "section", "s3", "  ")], "qid string, at int, kind string, source string, text string"), ["qid"], "at", "text", 10, 40)
    got = {r["qid"]: json.loads(r["input"]) for r in J.judge_input(answers, shown, {"final_answer": 5}).collect()}
    assert got["q1"]["final_answer"] == "xxxxx" + J.CUT and got["q1"]["tool_trace"] == {"retrieval_used": True}
    assert [(e["index"], e["text"]) for e in got["q1"]["evidence"]] == [(1, "f" * 10 + J.CUT), (2, "second")]
    assert got["q2"]["evidence"] == [] and got["q2"]["final_answer"] == ""


def test_score_text(spark):
    d = spark.createDataFrame([(7, None), (None, None)], "judge_score_overall int, judge_score_clarity int")
    assert [r["t"] for r in d.select(J.score_text(d).alias("t")).collect()] == ["- overall: 7\n- clarity: NA", "（当前尚无评分结果）"]


def test_title_similarity(spark):
    rows = [("Heat and Mass", "mass and heat"), ("Heat", ""), ("Heat transfer", "Fluid dynamics"), ("Heat transfer", "Heat transfer basics"), (None, "x")]
    d = spark.createDataFrame(rows, "a string, b string")
    got = [r["s"] for r in d.select(V.title_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == 1.0 and got[1] == got[4] == 0.0 and got[2] < 0.5 < got[3] < 1.0
    assert got[3] == 0.75 * V.similarity("heat transfer", "basics heat transfer") + 0.25 * 2 / 3


def test_answers_are_normalised(spark):
    texts = ["", "【解题思路】a【最终答案】b", "plain", "【解题思路与公式推导思路】【最终答案】only"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["n"] for r in d.select(T.normalised_answer(F.col("t")).alias("n")).collect()]
    head, final = "【解题思路与公式推导思路】", "【最终答案】"
    assert got == [f"{head}\n\n{final}", f"{head}\na\n\n{final}\nb", f"{head}\nplain\n\n{final}\nplain", f"{head}\nonly\n\n{final}\nonly"]


def test_lists_fences_and_fragments(spark):
    d = spark.createDataFrame([("a ```b", ["x", "y"]), ("", [])], "t string, xs array<string>")
    assert [tuple(r) for r in d.select(T.fence_escaped(F.col("t")), T.bullet_list(F.col("xs"))).collect()] == [("a `​``b", "- x\n- y"), ("", "- （空）")]
    s = spark.createDataFrame([("0123456789 ab \ncd", 0, 10), ("0123456789 ab \ncd", 10, 17), ("0123456789", 4, 4)], "t string, s int, e int")
    assert [(r["s"], r["len"], r["preview"], r["reason"]) for r in T.micro_fragments(s, "t", "s", "e").orderBy("s").collect()] == [(4, 0, "", "empty_segment"), (10, 7, "ab \\ncd", "micro_segment")]
    assert T.micro_fragments(s, "t", "s", "e", 5).count() == 1


def test_snap_takes_the_first_pattern_that_occurs(spark):
    d = spark.createDataFrame([("ab \\section{x} \\chapter{y}",), ("none",)], "t string")
    assert [r["s"] for r in d.select(T.snapped(F.col("t"), F.lit(0), 100, tex=True).alias("s")).collect()] == [15, None]
    assert d.select(T.snapped(F.col("t"), F.lit(0), 15, tex=True).alias("s")).first()["s"] == 3


def test_library_ids_stay_and_grow_without_gaps(spark):
    lib = spark.createDataFrame([(3, "Heat", "old"), (9, "Mass!", "old")], "book_id long, title string, path string")
    new = spark.createDataFrame([(None, "heat ", "new"), (None, "Flow", "new"), (None, "flow", "later"), *[(None, f"b{i}", "n") for i in range(200)]], "book_id long, title string, path string")
    kept = {r["title"]: r for r in T.library_update(lib, new).collect()}
    assert kept["Heat"]["path"] == "old" and kept["Flow"]["path"] == "new" and "flow" not in kept
    assert sorted(r["book_id"] for r in kept.values()) == [3, 9, *range(10, 211)]
    over = {r["book_id"]: r for r in T.library_update(lib, new, overwrite=True).collect()}
    assert (over[3]["title"], over[3]["path"], over[9]["path"]) == ("heat ", "new", "old")
    assert T.library_remove(lib, spark.createDataFrame([(3,)], "book_id long")).count() == 1


def test_refit_prefers_first_hand_points(spark):
    from quireline.operators import aggs as A

    own = [("g", float(p), float(p + 5), False) for p in range(1, 9)]
    read = [("g", float(p), float(200 - 9 * p), True) for p in range(1, 12)]
    d = spark.createDataFrame(own + read, "g string, page double, unit double, second boolean").withColumn("t", F.monotonically_increasing_id())
    line = A.clean_and_refit(d, ["g"], "page", "unit", "t", second_hand="second").first()
    assert (line["slope"], line["intercept"], line["n"]) == (1.0, 5.0, 8)
