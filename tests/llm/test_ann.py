import math

import numpy as np

from quireline.llm import ann as A


def exact(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v):
            good[i] = np.array(v, dtype=float)
    ids = np.array(sorted(good))
    x = np.array([good[i] for i in ids])
    out = {}
    for q in ids[ids % every == 0]:
        d = np.sqrt(((x - good[q]) ** 2).sum(1))
        d[ids == q] = np.inf
        out[q] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d))[: min(k, len(ids) - 1)]]
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 16)) * 3
    rows = [(i, (centres[i % 30] + r.normal(size=16)).astype(np.float32).tolist()) for i in range(3000)]
    got = A.nearest(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")).collect()
    want = exact(rows, 100, 10)
    by = {}
    for g in got:
        by.setdefault(g["query_id"], []).append((g["rank"], g["vec_id"], g["score"]))
    assert by.keys() == want.keys() and all(sorted(x[0] for x in v) == list(range(1, 11)) for v in by.values())
    known = dict(rows)
    for q, v in by.items():
        for _, i, s in v:
            assert abs(s - math.dist(known[q], known[i])) < 1e-9
    assert sum(len({i for _, i, _ in by[q]} & {i for i, _ in want[q]}) for q in want) / (10 * len(want)) >= 0.9


def test_bad_vectors_ties_and_copies(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0]), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [None, 1.0]), (8, [5.0, 5.0]), (None, [1.0, 0.0]), (100, [1.0, 0.0]), (9, [1.0])]
    df = spark.createDataFrame(rows + [(1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(g["query_id"], g["rank"], g["vec_id"], round(g["score"], 9)) for g in A.nearest(df).orderBy("query_id", "rank").collect()]
    far = round(math.sqrt(41), 9)
    assert got == [(0, 1, 100, 0.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 8, far), (100, 1, 0, 0.0), (100, 2, 1, 1.0), (100, 3, 2, 1.0), (100, 4, 8, far)]


def test_one_very_common_vector(spark, monkeypatch):
    monkeypatch.setattr(A, "BLOCK", 64)
    r = np.random.default_rng(5)
    rows = [(i, [1.0] * 8 if i % 3 == 0 else r.normal(size=8).astype(np.float32).tolist()) for i in range(1500)]
    got = A.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), every=150).collect()
    want = exact(rows, 150, 10)
    for q in want:
        assert [(g["vec_id"], round(g["score"], 6)) for g in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == [(i, round(d, 6)) for i, d in want[q]]


def test_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert A.nearest(spark.createDataFrame([], schema)).count() == 0
    assert A.nearest(spark.createDataFrame([(100, [1.0])], schema)).count() == 0
    assert [tuple(r) for r in A.nearest(spark.createDataFrame([(100, [1.0]), (1, [3.0])], schema)).collect()] == [(100, 1, 1, 2.0)]


def test_rows_without_clusters(spark, monkeypatch):
    monkeypatch.setattr(A, "LIST_SIZE", 16)
    rows = list(enumerate(np.random.default_rng(7).random(size=(5000, 48)).tolist()))
    got = A.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = exact(rows, 100, 10)
    found = {(g["query_id"], g["vec_id"]) for g in got}
    assert sum((q, i) in found for q in want for i, _ in want[q]) / (10 * len(want)) >= 0.95
