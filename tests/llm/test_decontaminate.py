import re

from quireline.llm import decontaminate as D


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def fixture(rng):
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([5, 7, 12, 30, 60]))) for i in range(25)] + [(90, "one two three"), (91, None), (92, "... !"), (93, "one two three")]
    docs = []
    for i in range(150):
        body = text(rng.randint(0, 300))
        if i % 3 == 0:
            w = rng.choice(items[:25])[1].split()
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = "zz"
            body += "\n" + " ".join(w).upper() + "! " + text(20)
        docs.append((i, body))
    docs += [(500, None), (501, ""), (502, "One, two: THREE"), (503, "one two three four"), (None, items[3][1]), (7, docs[7][1]), (504, (items[5][1] + " ") * 400)]
    return docs, items


def test_equals_brute_force(spark, rng):
    docs, items = fixture(rng)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for i, t in docs:
        s = shingles(t)
        for k, u in items:
            q = shingles(u)
            if q and len(q & s) * 100 >= 80 * len(q):
                want.add((i, k, len(q), len(q & s)))
    got = D.find_items(d, b).collect()
    assert {(r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in got} == want
    assert len(got) == len(want) and len(want) > 20
    bad = {i for i, *_ in want}
    kept = D.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, _ in docs if i not in bad), key=str)


def test_large_sides_are_shuffled(spark, rng, monkeypatch):
    monkeypatch.setattr("quireline.llm.common.BROADCAST_BYTES", -1)
    docs, items = fixture(rng)
    d, b = spark.createDataFrame(docs[:40], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k) for i, t in docs[:40] for k, u in items if (q := shingles(u)) and len(q & shingles(t)) * 100 >= 80 * len(q)}
    assert {(r["doc_id"], r["item_id"]) for r in D.find_items(d, b).collect()} == want


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.find_items(d, b).count() == 0
    assert D.find_items(spark.createDataFrame([(1, "a b c d e")], d.schema), b).count() == 0
