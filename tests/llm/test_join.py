import gc
import time

import pytest
from pyspark.sql import functions as F

from quireline.llm import common
from quireline.llm import ngram_join as N


def brute(data, n, percent):
    sets = []
    for _, t in data:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset())
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(data)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) * 100 >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(data):
        k = find(i)
        if doc is not None:
            least[k] = min(least.get(k, doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(data)), key=str)


def fixture(rng):
    v = [f"w{i}" for i in range(40)]
    texts = []
    for size in (2, 6, 15, 30, 60, 120, 120, 200):
        base = [rng.choice(v) for _ in range(size)]
        for _ in range(10):
            d = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                k = rng.randrange(len(d))
                d[k : k + rng.choice([0, 1])] = [rng.choice(v)]
            texts.append(" ".join(d))
    data = list(enumerate(texts)) + [(300, None), (301, ""), (302, " \t\x0b"), (303, "A b"), (304, "a B"), (None, texts[4]), (None, "lonely words of nobody"), (7, texts[7]), (7, texts[60]), (-5, texts[20])]
    return data


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_components_equal_brute_force(spark, rng, n, percent):
    data = fixture(rng)
    df = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, component_id int")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.join_components(df, n, percent).collect()), key=str)
    assert got == brute(data, n, percent)


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_links_equal_brute_force(spark, rng, n, percent):
    base = [f"w{rng.randrange(40)}" for _ in range(150)]
    copies = [" ".join([*base[:k], f"new{k}", *base[k + 1 :]]) for k in range(0, 150, 10)]
    data = fixture(rng) + list(enumerate(copies, 1000))
    sets = {}
    for doc, t in data:
        w = (t or "").encode().lower().split()
        sets.setdefault(frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset(), []).append(doc)
    like = lambda a, b: a and b and a != b and len(a & b) * 100 >= percent * len(a | b)
    want = sorted(((doc, sum(bool(like(a, b)) for b in sets)) for a, docs in sets.items() for doc in docs), key=str)
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(((r["doc_id"], r["n_links"]) for r in N.join_components(df, n, percent, count_links=True).collect()), key=str) == want
    assert max(c for _, c in want) >= 14


def test_one_of_each_stays(spark, rng):
    data = [d for d in fixture(rng) if d[0] not in (None, 7)]
    df = spark.createDataFrame([(i, t, "s") for i, t in data], "doc_id long, text string, source string")
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    want = {d for d, n, c in brute(data, 5, 80) if n == 0 or d == c}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_components_of_a_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "node long")
    links = spark.createDataFrame([((i * 7) % 30, ((i + 1) * 7) % 30) for i in range(29)], "a long, b long")
    got = {r["node"]: r["comp"] for r in N.components(nodes, links).collect()}
    assert all(got[i] == 0 for i in range(30)) and all(got[i] == i for i in range(30, 40))


def test_empty(spark):
    assert N.ngram_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def crowded(rng, n):
    """Near copies with up to many edits, and unrelated texts around one long common passage with few words of their own."""
    v = [f"w{i}" for i in range(4000)]
    words = lambda k: [rng.choice(v) for _ in range(k)]
    base, passage = words(110), words(100)
    texts = []
    for _ in range(120):
        d = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6, 12])):
            k = rng.randrange(len(d))
            d[k : k + rng.choice([0, 1, 1, 2])] = [rng.choice(v[:6])]
        texts.append(" ".join(d))
    for _ in range(120):
        cut = rng.choice([0, 0, 2, 5])
        texts.append(" ".join(words(rng.choice([1, 3, 6, 12, 20])) + passage[cut:] + words(rng.choice([0, 2, 7, 15]))))
    return list(enumerate(texts))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_crowded_lists_equal_brute_force(spark, rng, n, percent):
    data = crowded(rng, n)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.join_components(df, n, percent).collect()), key=str)
    want = brute(data, n, percent)
    assert got == want
    assert 3 < len({c for _, _, c in want}) < len(data)


def test_pairs_beyond_hubs_are_few(spark, rng):
    data = crowded(rng, 5)
    df = spark.createDataFrame(data, "rk long, text string")
    placed, post = N._postings(N.full_sets(df, 5), 80)
    none = spark.createDataFrame([], "node long, comp long")
    entries = post.where("rk <> hub.rk").select("hub.rk", "rk").distinct().count()
    assert N._beyond_hubs(post, none, placed, 80).distinct().count() < 4 * entries


def test_overlaps_in_narrow_steps(rng):
    import numpy as np

    rows = [np.array(sorted(rng.sample(range(60), rng.randrange(1, 40)))) for _ in range(30)]
    left, right = np.arange(0, 30, 2), np.arange(1, 30, 2)
    got = N._overlaps(rows, left, right, width=7)
    assert got.tolist() == [[len(set(rows[a].tolist()) & set(rows[b].tolist())) for b in right] for a in left]


@pytest.mark.parametrize("block", [3, 1024])
def test_links_are_counted_in_blocks(spark, rng, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_SETS", block)
    data = crowded(rng, 5)[:60]
    w = [t.split() for _, t in data]
    sets = {}
    for (doc, _), words in zip(data, w, strict=True):
        sets.setdefault(frozenset(tuple(words[j : j + 5]) for j in range(len(words) - 4)), []).append(doc)
    want = sorted((doc, sum(a != b and len(a & b) * 100 >= 80 * len(a | b) for b in sets)) for a, docs in sets.items() for doc in docs)
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_links"]) for r in N.join_components(df, 5, 80, count_links=True).collect()) == want


def test_large_sides_are_shuffled(spark, rng, monkeypatch):
    monkeypatch.setattr("quireline.llm.common.BROADCAST_BYTES", -1)
    data = crowded(rng, 5)[:80]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in N.join_components(df).collect()), key=str)
    assert got == brute(data, 5, 80)


# shuffle files


def shuffle_bytes(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [files.apply(i) for i in range(files.size())]
    return sum(f.length() for f in files if f.getName().startswith("shuffle_"))


def settled(spark, most, seconds=10):
    """The bytes of shuffle files once they are at most so many, or after so long: Spark deletes them beside other work."""
    until = time.time() + seconds
    while (b := shuffle_bytes(spark)) > most and time.time() < until:
        time.sleep(0.1)
    return b


def test_what_was_shuffled_goes_when_a_table_is_stored(spark):
    before = shuffle_bytes(spark)
    source = spark.range(200_000).groupBy(F.xxhash64("id").alias("h")).count()  # held, so that nothing goes as garbage
    with common.scratch(spark):
        out = common.stored(source, "counts")
        assert settled(spark, before) <= before
        assert out.count() == source.count() == 200_000
    assert spark.conf.get(common.DROP_SHUFFLES) == "false"


@pytest.mark.parametrize("value", [None, "true"])
def test_a_setting_is_as_before_also_after_failure(spark, value):
    key = "spark.sql.quireline.test"
    if value is not None:
        spark.conf.set(key, value)
    with pytest.raises(ValueError, match="inside"), common.setting(spark, key, "other"):
        assert spark.conf.get(key) == "other"
        raise ValueError("inside")
    assert spark.conf.get(key, None) == value
    spark.conf.unset(key)


def test_a_join_holds_no_shuffle_of_earlier_steps(spark, rng, monkeypatch):
    left, names, store = [], [], N.stored
    gc.collect()
    before = shuffle_bytes(spark)

    def watched(df, name):
        out = store(df, name)
        names.append(name)
        left.append(settled(spark, before + 100_000) - before)  # sums of a few rows stay
        return out

    monkeypatch.setattr(N, "stored", watched)
    v = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choice(v) for _ in range(300)) for _ in range(150)]
    texts += [t + " and more" for t in texts]
    got = N.join_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80)
    assert {r["component_id"] for r in got.collect()} == set(range(150))
    assert names.index("held") < names.index("pool") and names.index("shared-shingles") < names.index("placed")
    assert max(left) <= 100_000
