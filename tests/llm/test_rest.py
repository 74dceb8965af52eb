"""Language identification, WARC, line templates, mixing and the pipeline."""

import base64
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from quireline.llm import langid, line_templates, mixing, warc


def text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


# language identification


def test_language_held_out_accuracy(spark, prose, rng):
    rows = [(i, text(rng, prose[lang], rng.randint(8, 80)).title() + " 12!", lang, 0.5) for i, lang in ((i, rng.choice(list(prose))) for i in range(600))]
    extra = [(1000, None, "en", 0.0), (1001, " 12 ++ ", "en", 0.0), (None, text(rng, prose["de"], 30), "de", 0.0), (1002, text(rng, prose["fr"], 30), None, 0.0), (1003, text(rng, prose["es"], 20000), "es", 0.0)]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score double")
    got = langid.language_id(spark, df).collect()
    assert len(got) == len(rows) + len(extra)
    truth = {r[0]: r[2] for r in rows}
    out = [g for g in got if g["held_out"] and g["doc_id"] in truth]
    assert len(out) > 80 and sum(g["lang_pred"] == truth[g["doc_id"]] for g in out) / len(out) >= 0.97
    by = {g["doc_id"]: g for g in got}
    assert by[1000]["lang_pred"] == by[1001]["lang_pred"] == "und" and by[1000]["score"] == 0.0
    assert (by[1002]["lang_pred"], by[1003]["lang_pred"], by[None]["lang_pred"]) == ("fr", "es", "de")
    assert all(0 <= g["score"] <= 1 for g in got) and not by[None]["held_out"]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 12, 40])
def test_codewords_differ(n):
    c = langid.codewords(n)
    assert c.shape[0] == n and len({tuple(r) for r in c}) == n
    if n > 5:
        assert min(int((a != b).sum()) for i, a in enumerate(c) for b in c[:i]) >= c.shape[1] // 5


def test_language_of_nothing_and_of_one(spark):
    none = spark.createDataFrame([(1, "abc", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(none, langid.learn(none)).collect()} == {"und"}
    one = spark.createDataFrame([(1, "abc", "xx"), (2, "zzz", None), (3, "1", None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(one, langid.learn(one)).collect()} == {1: ("xx", 1.0), 2: ("xx", 1.0), 3: ("und", 0.0)}
    assert langid.language_id(spark, one.limit(0)).count() == 0


@pytest.mark.parametrize(("text", "letters"), [("½ ² Ⅷ", False), ("x²", True), ("12 + 3", False), ("_", False), ("ß", True), ("漢", True), ("", False), ("²" * 50 + "a", True)])
def test_letters_are_letters(text, letters):
    assert langid.has_letter(text) == letters


# WARC


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(1)
    html = [None, "", "<p>é😀</p>", "<p>same</p>", "<p>same</p>", "x" * 300_000, *[f"<html><body>{text(rng, ['alpha', 'beta', 'gamma'], 60)}</body></html>" for _ in range(40)]]
    rows = [(i, f"http://h/{i}\r\nX: y z", h) for i, h in enumerate(html)] + [(None, None, "<p>same</p>"), (None, "u", "only null id"), (4, "again", "<p>same</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write_archives(warc.with_revisits(df), f"file://{tmp_path}/a", warc.dictionary_from(df), archive_bytes=2000)
    back = warc.read_archives(manifest).collect()
    assert manifest.count() > 1 and sum(r["records"] for r in manifest.collect()) == len(rows) == len(back)
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", -1), i)
    key = lambda r: tuple((x is None, x) for x in r)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        keep = best.get(h or "", i) == i
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if keep else "revisit", None if keep else best[h or ""], (h or "") if keep else None))
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["html"]) for r in back), key=key) == sorted(want, key=key)
    first = sorted(os.listdir(tmp_path / "a"))[0]
    with open(tmp_path / "a" / first, "rb") as f:
        assert int.from_bytes(f.read(4), "little") == warc.DICT_MAGIC


def test_warc_of_nothing(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.warc_round_trip(spark, empty).count() == 0
    few = spark.createDataFrame([(1, "u", "tiny")], empty.schema)
    assert warc.dictionary_from(few) == b"" and warc.warc_round_trip(spark, few).first()["record_type"] == "response"


def test_warc_rejects_damage(spark, tmp_path):
    import io

    import zstandard

    rec = warc.record(1, "u", b"abc", None, False, warc.digest_of(b"abc"))
    assert list(warc.read_records(io.BytesIO(zstandard.compress(rec))))[0][1].endswith(b"abc")
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(zstandard.compress(b"junk\r\n"))))


# line templates


def test_recurring_lines_go_and_copies_stay(spark, prose, rng):
    own = lambda: text(rng, prose["en"], rng.randint(12, 30))
    docs, passage = [], text(rng, prose["de"], 60)
    for i in range(60):
        lines = [own() for _ in range(rng.randint(2, 6))]
        if i % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), f"Copyright {1990 + i} by the authors of page {i}, all rights reserved")
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        lines.insert(rng.randint(0, len(lines)), "Of a.")
        docs.append((i, "\n".join(lines)))
    base = "\n".join(own() for _ in range(6))
    copies = [(100 + k, base) for k in range(5)] + [(110 + k, base.replace("thing", f"zz{k}", 1)) for k in range(5)]
    rest = [(200, None), (201, ""), (202, "\n\n"), (None, own()), (0, docs[0][1])]
    df = spark.createDataFrame([(i, t, "k", 5) for i, t in docs + copies + rest], "doc_id long, text string, n_lines string, size int")
    out = line_templates.drop_recurring_lines(df)
    assert set(out.columns) == {"doc_id", "text", "size", "n_lines", "n_dropped"}
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == df.count() and len(got[0]) == 2
    for i, t in docs:
        want = [x for x in t.split("\n") if not x.startswith("Copyright") and x != passage]
        assert got[i][0]["text"] == "\n".join(want), i
        assert got[i][0]["n_dropped"] == len(t.split("\n")) - len(want)
    assert all(got[i][0]["text"] == t for i, t in copies)
    assert got[200][0]["text"] is None and got[201][0]["text"] == "" and got[202][0]["text"] == "\n\n" and got[200][0]["n_lines"] == 0


def test_leaf_generalises_a_varying_word(spark, prose, rng):
    names = ["anna", "boris", "carla", "dmitri", "elena", "felix", "gregor", "hanna"]
    docs = [(i, "\n".join([text(rng, prose["en"], 15 + i), f"Posted in the archive of {n} under general remarks today", text(rng, prose["fr"], 20 + i)])) for i, n in enumerate(names)]
    docs = [(i, t if i % 2 else "\n".join(reversed(t.split("\n")[:2])) + "\nmore words that stand here " + text(rng, prose["es"], 9)) for i, t in docs]
    got = line_templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all("Posted" not in r["text"] and r["n_dropped"] == 1 for r in got)


def test_a_large_group_of_copies_does_not_keep_a_line(spark, prose, rng):
    own = lambda n: [text(rng, prose["en"], rng.randint(12, 30)) for _ in range(n)]
    common = text(rng, prose["de"], 20)
    base = own(3)
    docs = [(i, [*base, common]) for i in range(20)] + [(100 + i, [*own(2 + i % 5), common, *own(1 + i % 3)]) for i in range(13)]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id long, text string")).collect()}
    assert all(got[i]["text"] == "\n".join(y for y in x if y != common) for i, x in docs)


@pytest.mark.parametrize("apart", ["\n", "\n\n"])
def test_a_block_of_lines_does_not_keep_itself(spark, prose, rng, apart):
    own = lambda n: [text(rng, prose["en"], rng.randint(12, 30)) for _ in range(n)]
    block, base = [text(rng, prose["de"], 15) for _ in range(12)], own(6)
    docs = []
    for i in range(24):
        mine = own(3 + i % 4)
        docs.append((i, mine[: i % 3], block, mine[i % 3 :]))
    copies = [(100 + k, apart.join([*base[:k], *base[k + 1 :]])) for k in range(3)] + [(110 + k, apart.join(base)) for k in range(6)]
    rows = [(i, apart.join([*a, *b, *c])) for i, a, b, c in docs] + copies
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([x for x in got[i]["text"].split("\n") if x] == [*a, *c] for i, a, _, c in docs)
    assert all(got[i]["text"] == t for i, t in copies)


def test_edited_copies_keep_their_lines(spark, rng):
    words = [f"w{i:03}x".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(900)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 50))] for _ in range(8)]
    rows = [(i, "\n".join(" ".join(x) for x in base)) for i in range(15)]
    for i in range(15, 35):
        mine = [list(x) for x in base]
        for x in rng.sample(mine, 4):
            at = rng.randrange(len(x))
            x[at : at + rng.choice([0, 1, 1, 2])] = [rng.choice(words)]
        rows.append((i, "\n".join(" ".join(x) for x in mine if i % 3 or x is not mine[i % 8])))
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows)


def test_groups_of_documents_by_place_or_beside(spark, rng):
    rows, want = [], set()
    for k in range(60):
        size = rng.randint(2, 9)
        docs = [(rng.randrange(rng.randint(1, 9)), rng.randrange(rng.randint(1, 9))) for _ in range(size)]
        groups = []
        for p, b in docs:
            near = [g for g in groups if any(p == q or b == c for q, c in g)]
            groups = [g for g in groups if g not in near] + [[(p, b), *[x for g in near for x in g]]]
        rows += [(k, k % 2 == 0, p, b) for p, b in docs]
        want |= {k} if len(groups) >= 3 and (k % 2 == 0 or len(groups) * 3 >= size) else set()
    one = spark.createDataFrame(rows, "k int, sure boolean, place int, beside long")
    got = line_templates._unrelated(one, one.groupBy("k", "sure").agg(F.count("*").alias("docs")), ["k"], 3)
    assert sorted(r["k"] for r in got.collect()) == sorted(want) and 0 < len(want) < 60


def test_a_hot_group_of_short_copies_keeps_its_lines(spark, rng):
    words = [f"w{i:03}x".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(900)]
    base = [[rng.choice(words) for _ in range(70)] for _ in range(2)]
    rows = [(i, "\n".join(" ".join(x) for x in base)) for i in range(30)]
    for i in range(30, 300):
        mine = [list(x) for x in base]
        for _ in range(rng.randrange(12)):
            x = rng.choice(mine)
            at = rng.randrange(len(x))
            x[at : at + rng.choice([0, 1, 1, 2])] = [rng.choice(words)]
        rows.append((i, "\n".join(" ".join(x) for x in mine)))
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(rows)


def test_lines_without_blanks_recur_too(spark, prose, rng):
    common, numbered = "本网站所载内容未经书面授权不得以任何形式转载或摘编", "版权所有者为本站第{}号编辑部并保留一切权利以及解释权"
    docs = []
    for i in range(9):
        own = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(30)) + str(i) for _ in range(3 + i % 4)]
        docs.append((i, [*own[: i % 3], "短行", common, numbered.format(i), *own[i % 3 :]]))
    docs += [(20 + i, [f"{rng.randrange(10**24, 10**25)}", text(rng, prose["en"], 12 + i)]) for i in range(5)]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(spark.createDataFrame([(i, "\n".join(x)) for i, x in docs], "doc_id long, text string")).collect()}
    assert all(got[i] == "\n".join(y for y in x if y not in (common, numbered.format(i))) for i, x in docs)


def test_lines_of_nothing(spark):
    assert line_templates.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# mixing


def test_rates_meet_targets_and_toxic_words_sink(spark, prose, rng):
    rows, labels = [], []
    for i in range(400):
        kind = "toxic" if i % 8 == 0 else "poor" if i % 5 == 0 else "clean"
        t = text(rng, prose["en"], rng.randint(40, 120))
        t = t + " vile scum " + text(rng, prose["en"], 10) if kind == "toxic" else (t.split()[0] + " ") * 60 if kind == "poor" else t
        rows.append((i, t, 1.0))
        if i % 2:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
        elif rng.random() < 0.6:
            labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    rows += [(900, None, 1.0), (901, "", 1.0), (None, "plain words", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rate double")
    lab = spark.createDataFrame([*labels, (1, 1, 0), (5000, 1, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    targets = {"clean": 0.9, "poor": 0.07, "toxic": 0.03}
    got = mixing.mix(docs, lab, targets)
    assert got.columns[:2] == ["doc_id", "text"] and got.count() == len(rows)
    r = got.agg(*[F.expr(f"sum(rate * n_tokens * p_{d}) / sum(n_tokens)").alias(d) for d in mixing.DOMAINS], F.min("rate").alias("least")).first()
    assert all(abs(r[d] - targets[d]) <= 0.01 for d in mixing.DOMAINS) and r["least"] >= 0
    mean = {k: got.where(cond).agg(F.avg("rate")).first()[0] for k, cond in (("toxic", "doc_id % 8 = 0 and doc_id < 400"), ("clean", "doc_id % 8 <> 0 and doc_id % 5 <> 0 and doc_id < 400"))}
    assert mean["toxic"] < 0.6 * mean["clean"]
    by = {x["doc_id"]: x for x in got.collect()}
    assert by[900]["n_tokens"] == by[901]["n_tokens"] == 0 and by[900]["p_clean"] == pytest.approx(by[901]["p_clean"])


def small_stats(spark, seed):
    import numpy as np

    r = np.random.default_rng(seed)
    p, n = r.dirichlet(np.ones(3) * 0.4, size=60), r.integers(1, 500, size=60)
    return p, n, spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(60)], "i int, n_tokens long, p_clean double, p_poor double, p_toxic double")


@pytest.mark.parametrize("targets", [(0.5, 0.2, 0.05), (0.93, 0.06, 0.01), (0.1, 0.1, 0.7)])
def test_rates_equal_brute_force_least_squares(spark, targets):
    import numpy as np

    p, n, stats = small_stats(spark, 6)
    fit = mixing.fit_rates(stats, dict(zip(mixing.DOMAINS, targets, strict=True)), pull=0.01, least_pull=0.01, tolerance=1e-6)
    got = np.array([x["r"] for x in stats.select("i", fit.rate.alias("r")).orderBy("i").collect()])
    # plain projected gradient on all 60 rates, in the token-weighted metric, to its end
    t, aim = n.sum(), np.array(targets)
    w = 1 / np.diag((p * n[:, None]).T @ p / t)
    size = 1 / (np.linalg.eigvalsh(np.sqrt(w)[:, None] * ((p * n[:, None]).T @ p / t) * np.sqrt(w)).max() + 0.01)
    x = np.ones(60)
    for _ in range(60_000):
        x = np.maximum(0, x - size * (p @ (w * ((x * n) @ p / t - aim)) + 0.01 * (x - 1)))
    assert np.allclose(got, x, atol=2e-3)
    assert np.allclose((got * n) @ p / t, [fit.shares[d] for d in mixing.DOMAINS])


def test_targets_are_met_or_flagged(spark):
    p, n, stats = small_stats(spark, 8)
    near = mixing.fit_rates(stats, mixing.TARGETS)
    assert near.met and all(abs(near.shares[d] - mixing.TARGETS[d]) <= 0.002 * max(mixing.TARGETS[d], 0.01) for d in mixing.DOMAINS) and near.iterations < 25
    alike = stats.withColumn("p_clean", F.lit(0.5)).withColumn("p_poor", F.lit(0.3)).withColumn("p_toxic", F.lit(0.2))
    assert not mixing.fit_rates(alike, mixing.TARGETS).met


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_registered_mixture_meets_its_targets(spark, sf):
    from quireline.llm import queries

    got = queries.QUERIES["op7_mixing"](spark, f"/root/testdata/{sf}")
    r = got.agg(*[F.expr(f"sum(rate * n_tokens * p_{d}) / sum(n_tokens)").alias(d) for d in mixing.DOMAINS], F.bool_and("targets_met").alias("met")).first()
    assert r["met"] and all(abs(r[d] - t) <= 0.002 * max(t, 0.01) for d, t in mixing.TARGETS.items())


def test_mixing_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["p_clean"] for r in mixing.mixing(spark, docs, lab).collect()} == {1.0}
    assert mixing.mixing(spark, docs.limit(0), lab).count() == 0


# pipeline


def test_pipeline_stage_by_stage(spark, tmp_path, prose, rng):
    import corpus_pipeline as cp

    own = lambda: "\n".join(text(rng, prose["en"], rng.randint(15, 40)) for _ in range(4))
    item = text(rng, prose["fr"], 40)
    docs = [(i, own() + ("\n" + item if i in (7, 8) else "") + ("\nLicensed to everyone under the plain terms, version 9" if i % 3 == 0 else ""), "en", "s", 1) for i in range(40)]
    docs += [(50, docs[1][1], "en", "s", 1), (51, docs[1][1] + " tail", "en", "s", 1), (52, "12 34", "en", "s", 1), (53, None, "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    sets = []
    for name, stage in cp.STAGES:
        d = cp.stored(stage(spark, d, str(tmp_path)), name)
        assert d.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        sets.append(ids(d))
    everyone = {r[0] for r in docs}
    assert sets[0] == sets[1] == everyone - {52, 53}
    assert sets[2] == sets[0] - {50, 51}
    assert sets[3] == sets[4] == sets[2] - {7, 8}
    assert d.where(F.col("text").contains("Licensed")).count() == 0 and d.where("rate < 0 or rate is null").count() == 0
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontaminate", "mixing"]
    assert ids(cp.run(spark, str(tmp_path))) == sets[4]


def test_stages_keep_own_columns_of_any_name(spark, tmp_path, prose, rng):
    import corpus_pipeline as cp

    own = ["lang_pred", "score", "runner_up", "ambiguous", "n_lines", "n_dropped", "rk", "__rk", "drop", "a.b", "odd, name"]
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    texts = [text(rng, prose["en"], 40) for _ in range(9)]
    texts += [texts[0], " ".join(texts) * 60, None]
    rows = [(i, t, "en", *[f"{c}{i}" for c in own]) for i, t in enumerate(texts)] + [(0, texts[0], "en", *[f"{c}0" for c in own])]
    d = spark.createDataFrame(rows, ["doc_id", "text", "lang", *own])
    for _, stage in cp.STAGES:
        d = stage(spark, d, str(tmp_path))
        got = {r["doc_id"]: r for r in d.collect()}
        assert d.columns[: 3 + len(own)] == ["doc_id", "text", "lang", *own]
        assert len(got) >= 9 and all(r[c] == f"{c}{i}" for i, r in got.items() for c in own)


def test_stages_take_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        assert stage(spark, d, str(tmp_path)).count() == 0


# all queries on the smallest tables


def test_registered_queries_run(spark):
    from quireline.llm import queries

    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    for name in ("op2_hmm", "op4_secret_scan", "op5_ngram_join", "op7_mixing", "op8_language_id", "op10_line_templates"):
        assert queries.QUERIES[name](spark, sf).count() == n, name
