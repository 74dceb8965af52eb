import random

import pytest
from pyspark.sql import functions as F

from quireline.operators import aggs as A
from quireline.operators import joins as J
from quireline.operators import models as M
from quireline.operators import sequential as S
from quireline.operators import windows as W


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_upsert_new_wins(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, t int")
    new = spark.createDataFrame([("b", 3, 0), ("b", 4, 1), ("c", 5, 1)], "k string, v int, t int")
    assert rows(J.upsert(old, new, ["k"], ["t"]), "k", "v") == [("a", 1), ("b", 4), ("c", 5)]


def test_last_wins_left_join(spark):
    left = spark.createDataFrame([("q1",), ("q2",), ("q3",)], "qid string")
    right = spark.createDataFrame([("q1", 1, 0), ("q1", 2, 1), ("q2", None, 0)], "qid string, score int, at int")
    assert rows(J.last_wins_left_join(left, right, ["qid"], ["at"], "judge_").fillna(-1), "qid", "judge_score") == [("q1", 2), ("q2", -1), ("q3", -1)]


def test_band_join_takes_the_best_in_reach(spark):
    left = spark.createDataFrame([(1, "g", 100), (2, "g", 900)], "l long, g string, at long")
    right = spark.createDataFrame([(10, "g", 95, 1.0), (11, "g", 105, 1.0), (12, "g", 160, 9.0), (13, "h", 100, 9.0)], "r long, g string, pos long, v double")
    got = J.band_join_best(left, right, ["g"], "at", "pos", 50, F.col("v"), ["r"], "l")
    assert rows(got, "l", "r") == [(1, 10)]


def test_rates(spark):
    d = spark.createDataFrame([(True,), (None,), (False,), (None,)], "b boolean")
    r = d.agg(A.rate_missing_false(F.col("b")), A.rate_missing_excluded(F.col("b"))).first()
    assert tuple(r) == (0.25, 0.5)


def test_repeat_stats_of_one_run(spark):
    d = spark.createDataFrame([("q", "m", 2.0)], "qid string, mode string, x double")
    r = A.repeat_stats(d, ["qid", "mode"], "x", F.lit(True)).first()
    assert (r["x_mean"], r["x_std"], r["x_min"], r["x_max"], r["ok_runs"]) == (2.0, 0.0, 2.0, 2.0, 1)


def test_spearman_ties_and_constants(spark):
    d = spark.createDataFrame([("a", 1.0, 1.0), ("a", 2.0, 2.0), ("a", 2.0, 3.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("c", 1.0, 1.0)], "g string, x double, y double")
    got = {r["g"]: r["rho"] for r in A.spearman(d, ["g"], "x", "y").collect()}
    assert got["a"] == pytest.approx(0.8660254) and got["b"] == 0.0 and got["c"] == 0.0


def test_refit_drops_the_outlier(spark):
    pts = [("g", float(p), float(p + 5)) for p in range(1, 6)] + [("g", 6.0, 80.0), ("g", 7.0, 90.0), ("g", 8.0, 70.0), ("g", 9.0, 60.0)]
    d = spark.createDataFrame(pts, "g string, page double, unit double").withColumn("t", F.monotonically_increasing_id())
    line = A.clean_and_refit(d, ["g"], "page", "unit", "t").first()
    assert line["slope"] == 1.0 and line["refitted"] and line["intercept"] == 5.0


def test_page_offset(spark):
    d = spark.createDataFrame([("a", 1.0, 11.0), ("a", 2.0, 12.0), ("a", 3.0, 14.0), ("b", 1.0, 5.0), ("b", 2.0, 90.0), ("b", 3.0, 4.0)], "g string, p double, u double")
    assert {r["g"]: r["page_offset"] for r in A.page_offset(d, ["g"], "p", "u").collect()} == {"a": 10.0, "b": None}


def test_monotone_scan_is_the_recurrence(spark):
    rng = random.Random(1)
    data = [(g, i, rng.randint(0, 900)) for g in range(20) for i in range(12)]
    d = spark.createDataFrame(data, "g long, i long, s long")
    got = rows(W.monotone_scan(d, ["g"], "i", "s", 50, "o"), "g", "i", "o")
    want = []
    for g in range(20):
        prev = -1
        for i in range(12):
            prev = max(prev + 50, data[g * 12 + i][2])
            want.append((g, i, prev))
    assert got == want


def test_running_budget_at_its_edge(spark):
    d = spark.createDataFrame([("q", i, 40) for i in range(4)], "q string, i int, n int")
    assert rows(W.running_budget(d, ["q"], ["i"], "n", 30, 75), "i", "granted") == [(0, 30), (1, 30), (2, 15), (3, 0)]


def test_backfill(spark):
    ranked = spark.createDataFrame([("q", 7, 1), ("q", 9, 2)], "q string, id int, o int")
    rest = spark.createDataFrame([("q", i, i) for i in (1, 7, 8)], "q string, id int, o int")
    assert [r["id"] for r in W.backfill(ranked, rest, ["q"], "id", "o", 3).orderBy("rank").collect()] == [7, 9, 1]


def test_heading_dedup_compares_with_the_last_kept(spark):
    d = spark.createDataFrame([("b", p, "s", n) for p, n in ((0, "a"), (3000, "a"), (6000, "a"), (6100, "b"), (6200, "a"))], "b string, at int, kind string, norm string")
    assert [r["at"] for r in S.dedup_headings(d, ["b"], "at", "kind", "norm", 5000).orderBy("at").collect()] == [0, 6000, 6100, 6200]


def test_spacing_and_diversity(spark):
    assert S.kept_far_apart([0, 5, 9, 10, 21], 10) == [True, False, False, True, True]
    assert S.kept_far_apart([0, 20, 40], 10, 2) == [True, True, False]
    d = spark.createDataFrame([("g", 0, 0.5), ("g", 3, 0.9), ("g", 10, 0.8), ("g", 12, 0.7)], "g string, at int, score double")
    assert [r["at"] for r in S.diverse_top(d, ["g"], "at", "score", 5, 3).orderBy("rank").collect()] == [3, 10]


def test_families(spark):
    d = spark.createDataFrame([("g", 0, 0), ("g", 0, 1), ("g", 1, 3), ("g", 1, 50)], "g string, family int, at int")
    assert rows(S.merge_families(d, ["g"], "at", "family", 10), "family", "at") == [(0, 0), (0, 1), (1, 50)]


@pytest.mark.parametrize(
    ("units", "want"),
    [([5, None, None, 20], [5, 10, 15, 20]), ([None, 10], [5, 10]), ([5, 3, 30], [5, 17, 30]), ([5, 10, None, None], [5, 10, 16, 22]), ([], [])],
)
def test_fill_gaps(units, want):
    got = S.fill_gaps(units, 0, 1000)
    assert all(a < b for a, b in zip(got, got[1:])) and len(got) == len(want)
    known = [(i, u) for i, u in enumerate(units) if u is not None and u not in (3,)]
    assert all(got[i] == u for i, u in known)


def test_merged_lines():
    lines = ["Contents", "1 First things", "12", "A plain sentence without a number", "Second", "", "xiv", "text"]
    assert S.merged_lines(lines) == ["Contents", "1 First things 12", "Second xiv"]


def test_alignment_skips_on_both_sides():
    left = [(None, "Preface"), (1, "Heat flow in solids"), (2, "Mass transfer"), (3, "Radiation")]
    right = [(1, "Heat flow in solids"), (None, "Exercises and notes"), (2, "Mass transfer!"), (3, "Chapter 3")]
    assert S.monotone_alignment(left, right) == {1: 0, 2: 2, 3: 3}
    assert S.monotone_alignment([], right) == {}


def test_boundaries_keep_order():
    got = S.chosen_boundaries([[(100, 0.9)], [(50, 0.99)], [(90, 0.4)]], [0.0, 500.0, 600.0], 10_000)
    assert got == [(100, "candidate"), (500, "estimate"), (700, "estimate")]
    assert S.lock_headings([100, 120, 500], [110, 130, 490], 50) == [110, 130, 490]


def test_model_calls_never_raise(spark):
    def broken():
        def reply(p):
            if "bad" in p:
                raise ValueError("no")
            return 'fine {"a": 1}'

        return reply

    d = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "id int, p string")
    got = {r["id"]: r["r"] for r in M.call(d, "p", "r", broken, 2).collect()}
    assert got[1]["json"] == '{"a": 1}' and got[2]["error"] == "ValueError: no" and got[2]["attempts"] == 2 and got[3]["error"] is None


def test_answers_are_repaired_or_normalised(spark):
    d = spark.createDataFrame([(1, "Q id=3"), (2, "TRUNCATE")], "id int, p string")
    got = {r["id"]: r for r in M.answers(d, "p").collect()}
    assert got[1]["repairs"] == 0 and not got[1]["normalised"]
    assert got[2]["repairs"] > 0


def test_judge_falls_back_to_zero(spark):
    d = spark.createDataFrame([(1, "x")], "id int, t string")
    got = M.judge(d, "id", "t", lambda: lambda p: "no json").first()
    assert (got["overall"], got["confidence"]) == (0, 0.0) and got["errors"]


def test_align_by_group(spark):
    a = spark.createDataFrame([("g", 0, 1, "Heat"), ("g", 1, 2, "Mass"), ("h", 0, 1, "Only left")], "g string, pos long, no int, title string")
    b = spark.createDataFrame([("g", 5, 1, "Heat"), ("g", 6, None, "Mass")], "g string, pos long, no int, title string")
    assert rows(S.align(a, b, ["g"]), "g", "left_pos", "right_pos") == [("g", 0, 5), ("g", 1, 6)]


