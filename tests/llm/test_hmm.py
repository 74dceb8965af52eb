import math
import zlib
from collections import Counter

import numpy as np
import pytest

from quireline.llm import hmm as H


def docs(spark, prose, rng):
    rows = []
    for i in range(120):
        lang = ("en", "fr")[i % 2]
        rows.append((i, " ".join(rng.choice(prose[lang]) for _ in range(rng.randint(5, 150)))))
    return [*rows, (200, None), (201, ""), (202, "Ab\tAB\x0bab\x1cx x"), (None, "the end"), (3, rows[3][1])]


def test_base_score_and_counts(spark, prose, rng):
    rows = docs(spark, prose, rng)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = sorted(H.language_model(spark, df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["base_score"]))
    held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
    counts = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in H.words(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((i is None, i, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in H.words(t))), h, len(H.words(t)), sum(counts[w] > 0 for w in H.words(t))) for (i, t), h in zip(rows, held, strict=True))
    assert len(got) == len(want)
    for g, (key, h, size, known) in zip(got, want, strict=True):
        assert (g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (key[1], h, size, known, n)
        assert g["base_score"] == pytest.approx(key[2], abs=1e-8)
        assert math.isfinite(g["score"])
    out = [g for g in got if g["held_out"]]
    assert sum(g["score"] for g in out) > sum(g["base_score"] for g in out)


def test_rare_words_go_through_the_join(spark, prose, rng, monkeypatch):
    """Scores don't depend on how many words every task holds."""
    df = spark.createDataFrame(docs(spark, prose, rng)[:60], "doc_id long, text string")
    one = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in H.language_model(spark, df, rounds=1).collect()}
    monkeypatch.setattr(H, "HEAD", 4)
    two = {r["doc_id"]: (r["base_score"], r["n_known"]) for r in H.language_model(spark, df, rounds=1).collect()}
    assert one.keys() == two.keys() and all(one[k][1] == two[k][1] and one[k][0] == pytest.approx(two[k][0]) for k in one)


def test_forward_equals_the_sum_over_paths():
    rng = np.random.default_rng(2)
    m = H.Model(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), size=3), rng.dirichlet(np.ones(5), size=3))
    codes = [np.array([0, 3, 1, 4]), np.array([2]), np.array([1, 1]), rng.integers(5, size=400)]
    got = H.forward(m, codes)
    import itertools

    for c, g in zip(codes[:3], got, strict=False):
        p = sum(m.start[s[0]] * m.emit[s[0], c[0]] * math.prod(m.move[a, b] * m.emit[b, x] for a, b, x in zip(s, s[1:], c[1:], strict=False)) for s in itertools.product(range(3), repeat=len(c)))
        assert g == pytest.approx(math.log10(p))
    assert math.isfinite(got[3]) and got[3] < -100


def test_baum_welch_never_lowers_the_likelihood():
    rng = np.random.default_rng(4)
    dim = H.OWN + H.SHARED
    base = np.full(dim, 1e-9)
    base[:20] = 1
    base /= base.sum()
    rows = [np.repeat(rng.integers(2, size=8), 8) * 10 + rng.integers(10, size=64) for _ in range(60)]
    m = H.first_model(H.windows(rows), base, states=2)
    last = -np.inf
    for _ in range(4):
        now = H.forward(m, rows).sum()
        assert now >= last - 1e-3
        last = now
        acc = (np.zeros((2, dim)), np.zeros((2, 2)), np.zeros(2))
        H.e_step(m, H.windows(rows), *acc)
        assert acc[0].sum() == pytest.approx(60 * 64, rel=1e-4) and acc[1].sum() > 0
        m = H.m_step(m, *acc, base, prior=1e-3)


def test_empty_table(spark):
    assert H.language_model(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    held = zlib.crc32(b"1") % 5 == 1
    r = H.language_model(spark, only).first()
    assert r["held_out"] == held and r["n_tokens"] == 3


def test_windows_that_go_on_do_not_count_as_starts():
    rng = np.random.default_rng(9)
    dim = H.OWN + H.SHARED
    codes = [rng.integers(50, size=n) for n in (10, 64, 65, 300)]
    rows, first = H.windows(codes), H.opening(codes)
    assert len(rows) == len(first) == 9 and first.sum() == 4
    m = H.Model(np.array([0.9, 0.1]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(dim), size=2))
    assert np.allclose(H.usual(m), [0.4, 0.6])
    acc = (np.zeros((2, dim)), np.zeros((2, 2)), np.zeros(2))
    H.e_step(m, rows, *acc, first)
    assert acc[2].sum() == pytest.approx(4, abs=1e-3) and acc[0].sum() == pytest.approx(439, abs=1e-2)


def test_scores_are_log_probabilities(spark, prose, rng):
    df = spark.createDataFrame(docs(spark, prose, rng)[:60], "doc_id long, text string")
    got = H.language_model(spark, df, rounds=1).collect()
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
