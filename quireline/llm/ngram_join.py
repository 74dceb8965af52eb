"""Set-similarity join on word n-grams: Jaccard similarity by rare-first prefix filtering.

Texts with the same shingle set form a class; classes are joined, not copies.

1. A first reading gives each text its set's size, a key of the set, and those of
   its shingle hashes that lie in a fixed share of the hash space. Two similar
   sets hold the same shared shingles there, and their sizes are in the same or
   in neighbouring size bands, so a set of which too few sampled shingles occur
   in another set of such a size has no partner: only the rest goes on.
2. For those, every shingle's document frequency is counted, and each set is
   ordered rare first. The first n - ceil(t*n) + 1 shingles are its prefix: two
   similar sets share one there (prefix filter).
3. In every posting list of a prefix shingle, all sets first meet one hub (the one
   with the least sum of its size and the shingles that no other set has), which
   costs one pair for each entry. Pairs pass the length, positional and suffix filters
   (the last bounds the overlap of what follows by counts in hash bands) before
   each is verified once on the shingles that more than one set has.
4. Linked sets become components. In lists that still hold several, the overlap o of
   each set with the hub is known, and the rest r of the set outside it. Two sets of
   different components are not both linked to the hub. If they are similar, either
   they share a shingle outside the hub, at least as many as the unlinked one lacks
   in o, so they meet on the rare-first prefix of its rest; or the hub covers all they
   share, and then one of them is smaller than the hub. Both joins take place within
   a hub's sets. So groups of near copies cost their size, not its square, pairs of a
   list are never all formed, and no link between components is lost.
5. Where links are counted, the sets of each component are dealt into blocks, and
   each pair of blocks counts in one task by products of 0/1 matrices. No pair
   becomes a row. The products do cost the square of a component's size.

Shingles are compared by 64-bit hashes throughout, so results are exact as long as
no two shingles of a comparison share a hash.

Defined results: null texts and texts without words have the empty set, are
linked with nothing and are their own component; texts with fewer words than n
have one shingle, the whole sequence; rows that repeat an id stay separate rows;
a null id belongs to its class and never names a component unless the component
has no other; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, row_key, scratch, small_batches, stored

BANDS = 16
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Distinct 64-bit shingle hashes of texts, sorted; hashes of words are remembered up to a bound."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, dtype=np.uint64)
        known = self.known
        if len(known) > 500_000:
            known.clear()
        hashes = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w)
            hashes.append(h)
        a = np.array(hashes, dtype=np.uint64)
        width = min(self.n, a.size)
        s = np.full(a.size - width + 1, width, dtype=np.uint64)
        for j in range(width):
            s = _mix(s * M1 + a[j : a.size - width + 1 + j])
        return np.unique(s)


def _as_long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64), pa.int64())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([p.size for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), _as_long(values))


def first_reading(docs: DataFrame, n: int, percent: int, share: float) -> DataFrame:
    """(rk, doc_id, n, set_key, ck, need, band, sampled) of every row; set_key is null for the empty set.

    need: how many of the sampled shingles a partner must share, at least. band: sizes of similar sets differ by one band at most.
    A task samples a class it has seen before no second time, so copies cost a row each and no more.
    """
    limit, ratio = np.uint64(min(2**64 - 1, int(share * 2**64))), 1.0001 * np.log(100 / percent)

    def run(batches):
        shingles, seen = Shingler(n), set()
        none = np.zeros(0, dtype=np.uint64)
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if s.size else None for s in sets]
            size = np.array([s.size for s in sets], dtype=np.int64)
            some = [s[: np.searchsorted(s, limit)] for s in sets]
            need = np.array([s.size for s in some], dtype=np.int64) - (size - -(-size * percent // 100))
            for i, k in enumerate(keys):
                if k in seen:
                    some[i] = none
                elif k is not None:
                    seen.add(k)
            if len(seen) > 500_000:
                seen.clear()
            band = np.floor(np.log(np.maximum(size, 1)) / ratio).astype(np.int64) if percent < 100 else size
            short = np.array([0 if k is None else int.from_bytes(k[:8], "little", signed=True) for k in keys], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("rk"), b.column("doc_id"), pa.array(size), pa.array(keys, pa.binary()), pa.array(short), pa.array(need), pa.array(band), _lists(some)], names=["rk", "doc_id", "n", "set_key", "ck", "need", "band", "sampled"])

    return docs.mapInArrow(run, "rk long, doc_id long, n long, set_key binary, ck long, need long, band long, sampled array<long>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """(rk, hs, n, bands) of each row: all shingles, their number, and how many fall into each hash band."""

    def run(batches):
        shingles = Shingler(n)
        for b in batches:
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            bands = [np.bincount((s >> np.uint64(7)).astype(np.int64) % BANDS, minlength=BANDS).tolist() for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("rk"), _lists(sets), pa.array([s.size for s in sets], pa.int32()), pa.array(bands, pa.list_(pa.int32()))], names=["rk", "hs", "n", "bands"])

    return docs.mapInArrow(run, "rk long, hs array<long>, n int, bands array<int>")


def with_possible_partner(read: DataFrame) -> DataFrame:
    """(set_key): classes that hold enough sampled shingles which another class of a like size holds too.

    A shingle's classes are summed up in one row: whether there are two, and which size bands (in 64 bits) hold it. Where a
    band holds it more than once the row does not tell which, and all its classes count as having company: never too few.
    These rows are stored first, so that what was shuffled to make them is gone when the join shuffles the classes.
    """
    rows = read.select("rk", "ck", F.pmod("band", F.lit(64)).cast("int").alias("band"), F.explode("sampled").alias("h"))
    bit = lambda c: F.expr(f"shiftleft(1L, {c})")
    held = rows.groupBy("h").agg(F.min("ck").alias("c1"), F.max("ck").alias("c2"), F.count("*").alias("c"), F.bit_or(bit("band")).alias("bits"))
    held = stored(held.where("c1 <> c2").select("h", (F.col("c") > F.bit_count("bits")).alias("many"), "bits"), "held")
    beside = bit("pmod(band + 1, 64)").bitwiseOR(bit("pmod(band + 63, 64)"))
    company = rows.join(held, "h").where(F.col("many") | (F.col("bits").bitwiseAND(beside) != 0)).groupBy("rk").agg(F.count("*").alias("met"))
    own = read.where("set_key is not null and (need <= 0 or size(sampled) > 0)").select("rk", "set_key", "need")
    return own.join(company, "rk", "left").where((F.col("need") <= 0) | (F.col("met") >= F.col("need"))).select("set_key").distinct()


def components(nodes: DataFrame | None, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, comp): comp is the least node reachable over the links (a, b); nodes without links are their own.

    Rounds of contraction: every node points to the least of its neighbours and itself in an order by hash, pointers are followed
    once more, and what is left are links between the nodes pointed to. Ends when no link is left.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    for k in range(most_rounds + 1):
        if edges.isEmpty():
            break
        if k == most_rounds:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
        order = lambda c: F.struct(F.xxhash64(c).alias("o"), F.col(c).alias("v"))
        least = both(edges).groupBy("a").agg(F.min(order("b")).alias("m")).select("a", F.least("m", order("a"))["v"].alias("to"))
        further = least.select(F.col("a").alias("to"), F.col("to").alias("further"))
        point = stored(least.join(further, "to").select("a", F.col("further").alias("to")), "pointers")
        named = edges.join(point, "a").select(F.col("to").alias("a"), "b").join(point.withColumnRenamed("a", "b").withColumnRenamed("to", "tb"), "b")
        edges = stored(named.select("a", F.col("tb").alias("b")).where("a <> b").distinct(), "edges")
        labels = labels.join(point.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    labels = stored(labels, "labels")
    found = labels.join(labels.groupBy("root").agg(F.min("node").alias("comp")), "root").select("node", "comp")
    if nodes is None:
        return found
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def _need(a, b, percent: int):
    """The least overlap at which sets of these sizes are similar."""
    return F.ceil((a + b) * percent / (100 + percent))


def _like_sizes(a, b, percent: int):
    return (a * 100 >= b * percent) & (b * 100 >= a * percent)


def _filtered(pairs: DataFrame, percent: int) -> DataFrame:
    """Length, positional and suffix filters on pairs (a, na, ka, ia, ba, b, nb, kb, ib, bb).

    n is the set's size, k how many of its shingles no other set has (they come first and are never shared), i the place of
    the common prefix shingle. So what comes before it holds at most i - k common ones, and what follows at most n - i.
    """
    need = _need(F.col("na"), F.col("nb"), percent)
    before = F.least(F.col("ia") - F.col("ka"), F.col("ib") - F.col("kb"))
    positional = before + F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= need
    apart = F.aggregate(F.zip_with("ba", "bb", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    suffix = apart <= F.col("na") + F.col("nb") - 2 * need
    return pairs.where(_like_sizes(F.col("na"), F.col("nb"), percent) & positional & suffix)


def _verified(pairs: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """The distinct pairs (a, b), a < b, whose sets are similar: each is worked out once."""
    once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = once.join(placed.select(F.col("rk").alias("a"), F.col("n").alias("na"), F.col("o").alias("oa")), "a")
    both = left.join(placed.select(F.col("rk").alias("b"), F.col("n").alias("nb"), F.col("o").alias("ob")), "b")
    return both.where(F.size(F.array_intersect("oa", "ob")) >= _need(F.col("na"), F.col("nb"), percent)).select("a", "b")


def _postings(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rk, n, bands, k, tight, o): o are the shingles of more than one set, rare first; (h, rk, ..., i, hub) of the prefixes.

    A set can share n - k shingles at most; if that is too few for partners of its own size and larger ones, it is loose, and
    two loose sets never link (each would have to be the smaller one): every pair has a tight end.
    """
    every = sets.select("rk", F.explode("hs").alias("h"))
    shared = stored(every.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"), "shared-shingles")
    placed = every.join(shared, "h").groupBy("rk").agg(F.array_sort(F.collect_list(F.struct("df", "h")))["h"].alias("o"))
    placed = placed.join(sets.select("rk", "n", "bands"), "rk").withColumn("k", F.col("n") - F.size("o"))
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    tight = F.floor((F.col("n") - F.col("k")) * (100 + percent) / percent) >= 2 * F.col("n")
    placed = stored(placed.withColumn("take", prefix - F.col("k")).where("take > 0").withColumn("tight", tight), "placed")
    post = placed.select("rk", "n", "bands", "tight", "k", F.posexplode(F.slice("o", F.lit(1), F.col("take"))).alias("i", "h")).withColumn("i", F.col("i") + F.col("k"))
    hub = F.min(F.struct((F.col("n") + F.col("k")).alias("cost"), "rk", "n", "k", "i", "bands", "tight")).alias("hub")
    hubs = post.groupBy("h").agg(hub, F.count("*").alias("held")).where("held > 1").drop("held")
    return placed, stored(post.join(hubs, "h"), "postings")


def _beyond_hubs(post: DataFrame, comp: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that may be similar and are in a list together, neither being its hub; see step 4."""
    named = post.join(comp.withColumnRenamed("node", "rk"), "rk", "left").withColumn("comp", F.coalesce("comp", "rk"))
    open_lists = named.groupBy("h").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.bool_or("tight").alias("any_tight")).where("c1 <> c2 and any_tight").select("h")
    members = stored(named.join(bounded(stored(open_lists, "open-lists")), "h").select(F.col("hub.rk").alias("p"), F.col("hub.n").alias("np"), "rk", "n", "tight", "comp").distinct(), "open-members")
    least = members.groupBy("p").agg(F.min("n").alias("least"))
    shown = members.where("rk <> p").join(least, "p").join(placed.select("rk", "o"), "rk").join(placed.select(F.col("rk").alias("p"), F.col("o").alias("op")), "p")
    shown = shown.select("p", "np", "least", "rk", "n", "tight", "comp", F.size(F.array_intersect("o", "op")).alias("o"), F.array_except("o", "op").alias("rest")).withColumn("r", F.size("rest"))
    smallest = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    lacks = (_need(F.col("n"), smallest, percent) - F.col("o")).cast("int")
    linked = F.col("o") >= _need(F.col("n"), F.col("np"), percent)
    shown = stored(shown.withColumn("lacks", lacks).withColumn("linked", linked), "beside-hubs")
    x = lambda *more: shown.select("p", "rk", "n", "tight", "comp", "o", "r", *more)
    one = lambda d, s: d.select("p", *[F.col(c).alias(f"{c}{s}") for c in ("rk", "n", "tight", "comp", "o", "r")], *[c for c in d.columns if c == "h"])
    unlinked = shown.where(~F.col("linked") & (F.col("lacks") <= F.col("r")))
    probes = unlinked.select("p", "rk", "n", "tight", "comp", "o", "r", F.explode(F.slice("rest", F.lit(1), F.col("r") - F.greatest("lacks", F.lit(1)) + 1)).alias("h"))
    need = _need(F.col("na"), F.col("nb"), percent)
    may = (F.col("compa") != F.col("compb")) & (F.col("tighta") | F.col("tightb")) & _like_sizes(F.col("na"), F.col("nb"), percent)
    outside = one(probes, "a").join(one(x(F.explode("rest").alias("h")), "b"), ["p", "h"]).where(may & (F.least("oa", "ob") + F.least("ra", "rb") >= need))
    covered = one(unlinked.where("lacks <= 0"), "a").join(one(shown.where("n < np"), "b"), "p").where(may & (F.least("oa", "ob") >= need))
    return outside.select(F.col("rka").alias("a"), F.col("rkb").alias("b")).unionByName(covered.select(F.col("rka").alias("a"), F.col("rkb").alias("b")))


#: Sets and shingles of a block in which links are counted.
BLOCK_SETS, BLOCK_SHINGLES = 1024, 500_000


def _overlaps(rows: list[np.ndarray], left: np.ndarray, right: np.ndarray, width: int = 2048) -> np.ndarray:
    """Overlaps of the sets at left with those at right, by products over width shingles at a time."""
    at = np.repeat(np.arange(len(rows)), [r.size for r in rows])
    _, code, count = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    held = count[code] > 1
    at, code = at[held], new[code[held]]
    order = np.argsort(code, kind="stable")
    at, code = at[order], code[order]
    out = np.zeros((left.size, right.size), dtype=np.float32)
    for start in range(0, int(code[-1]) + 1 if code.size else 0, width):
        lo, hi = np.searchsorted(code, [start, start + width])
        m = np.zeros((len(rows), min(width, int(code[hi - 1]) - start + 1)), dtype=np.float32)
        m[at[lo:hi], code[lo:hi] - start] = 1
        out += m[left] @ m[right].T
    return out.astype(np.int64)


def _links_of(comp: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """(rep, n_links): for each set in a component of several, how many others it is linked to."""
    sets = comp.join(placed.select(F.col("rk").alias("node"), "n", "o"), "node")
    size = sets.groupBy("comp").agg(F.count("*").alias("m"), F.sum(F.size("o").cast("long")).alias("s"))
    size = stored(size.select("comp", F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"), "s"), "component-sizes")
    units = 1 + (size.where("blocks = 1").agg(F.sum("s")).first()[0] or 0) // BLOCK_SHINGLES
    dealt = sets.join(size.drop("s"), "comp").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(units))).otherwise(F.col("comp"))
    dealt = dealt.select(unit.alias("unit"), (F.col("blocks") > 1).alias("split"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "comp", "block", F.col("node").alias("rep"), "n", "o")

    def count(t: pa.Table) -> pa.Table:
        comps, blocks = t.column("comp").to_numpy(), t.column("block").to_numpy()
        n, i, j = t.column("n").to_numpy().astype(np.int64), t.column("i")[0].as_py(), t.column("j")[0].as_py()
        lists = t.column("o").combine_chunks()
        ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
        out = np.zeros(t.num_rows, dtype=np.int64)
        order = np.argsort(comps, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(comps[order])) + 1):
            rows = [values[ends[r] : ends[r + 1]] for r in own]
            left, right = np.flatnonzero(blocks[own] == i), np.flatnonzero(blocks[own] == j)
            both = _overlaps(rows, left, right)
            like = both * 100 >= (n[own[left]][:, None] + n[own[right]][None] - both) * percent
            if i == j:
                np.fill_diagonal(like, False)
            else:
                out[own[right]] = like.sum(0)
            out[own[left]] = like.sum(1)
        return pa.table({"rep": t.column("rep"), "c": pa.array(out)})

    counted = dealt.groupBy("unit", "split", "i", "j").applyInArrow(count, "rep long, c long")
    return counted.groupBy("rep").agg(F.sum("c").alias("n_links"))


def join_components(docs: DataFrame, n: int = 5, percent: int = 80, share: float | None = None, count_links: bool = False) -> DataFrame:
    """(rk, doc_id, n_shingles, component_id, and n_links if asked for) of each row of docs; rk is the row's key.

    component_id is the least doc_id of the component; n_links counts the links of the row's
    class to other classes, all of them. The result is a stored table.
    """
    with scratch(docs.sparkSession) as keep:
        return keep(stored(_join_components(docs, n, percent, share, count_links), "components"))


def _join_components(docs: DataFrame, n: int, percent: int, share: float | None, count_links: bool) -> DataFrame:
    spark = docs.sparkSession
    small_batches(spark)
    share = share if share is not None else min(1.0, (0.05 + 1.25 * (100 - percent) / 100))
    base = docs.select(row_key("doc_id", "text").alias("rk"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = stored(first_reading(base, n, percent, share), "first-reading")
    classes = read.where("set_key is not null").groupBy("set_key").agg(F.min("rk").alias("rep"), F.min("doc_id").alias("least_id"))
    classes = stored(classes, "classes")
    pool = stored(classes.join(with_possible_partner(read), "set_key", "left_semi").select(F.col("rep").alias("rk")), "pool")
    sets = stored(full_sets(base.join(bounded(pool), "rk").dropDuplicates(["rk"]).select("rk", "text"), n), "sets")
    placed, post = _postings(sets, percent)
    star = post.where("rk <> hub.rk and (tight or hub.tight)").selectExpr("hub.rk as a", "hub.n as na", "hub.k as ka", "hub.i as ia", "hub.bands as ba", "rk as b", "n as nb", "k as kb", "i as ib", "bands as bb")
    links = stored(_verified(_filtered(star, percent), placed, percent), "links")
    comp = components(None, links)
    more = stored(_verified(_beyond_hubs(post, comp, placed, percent), placed, percent), "links")
    if not more.isEmpty():
        comp = components(None, links.unionByName(more))
    named = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    answer = named.join(least, "comp")
    if count_links:
        answer = answer.join(_links_of(comp, placed, percent), "rep", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))
    extra = ["n_links"] if count_links else []
    out = read.select("rk", "doc_id", F.col("n").alias("n_shingles"), "set_key").join(answer.select("set_key", "component_id", *extra), "set_key", "left")
    return out.select("rk", "doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in extra])


def ngram_join(docs: DataFrame) -> DataFrame:
    return join_components(docs, n=3, percent=90, count_links=True).drop("rk")


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the component's least id; rows with the empty set, and repeats of the kept row's id and text, as they are."""
    key = fresh(docs, "rk")
    with scratch(docs.sparkSession) as keep:
        drop = keep(stored(_copies(join_components(docs, n, percent), key), "copies"))
    return docs.withColumn(key, row_key("doc_id", "text")).join(bounded(drop), key, "left_anti").drop(key)


def _copies(found: DataFrame, key: str) -> DataFrame:
    return found.where((F.col("n_shingles") > 0) & F.col("component_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("rk").alias(key)).distinct()
