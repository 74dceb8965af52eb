"""Approximate nearest neighbours by balanced posting lists.

Centroids are fitted on a bounded sample by k-means with a penalty on long
lists. Every vector is put into the list of its nearest centroid and, if it is
near a boundary, into further lists (its replicas). A query's lists come from a
beam search over a graph of the centroids, and those much farther than the
nearest one are left out. How far is far enough depends on the rows, so it is
measured: some queries are compared with all rows, and the bounds are widened,
up to all lists, until these queries find what is asked of them (beams beyond
the graph's take the distances to all centroids, which cost less than a wide
search). Distances to what the lists hold are exact. Long
lists, and lists with many queries, are cut into blocks, so that no task meets
more than one block of either.

Defined results: vectors that are null, zero, of a length other than the most
frequent one, or hold null or non-finite components take no part, nor do rows
without an id; rows that repeat an id and vector count once; ties go to the
smaller id; with fewer candidates than k all are returned; a query whose lists
hold too few is searched over all lists; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import stored

#: Bounds of the model, whatever the table's size: vectors to fit on, and lists.
SAMPLE, MAX_LISTS = 20_000, 8192
#: Vectors a list should hold; vectors and queries in a block.
LIST_SIZE, BLOCK = 128, 4096
#: Queries compared with all rows, and the share of their nearest rows that the visited lists must hold.
TRIALS, RECALL = 128, 0.97
#: The widest beam of the graph, and what may be visited: distances beyond the nearest list's as a share of it, and numbers of lists.
BEAM, RATIOS = 64, (0.35, 0.5, 0.7, 1.0, 1.5, float("inf"))


def _usable(c: Column) -> Column:
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(c, lambda x: x != 0)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, v) with v as packed doubles, and the vectors' length."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & _usable(F.col("v")))
    top = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = top["n"] if top else 0

    def pack(batches):
        for b in batches:
            col = b.column("v")
            flat = np.ascontiguousarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
            raw = flat.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([raw[i * dim * 8 : (i + 1) * dim * 8] for i in range(b.num_rows)], pa.binary())], names=["id", "v"])

    return v.where(F.size("v") == dim).mapInArrow(pack, "id long, v binary"), dim


def unpack(col, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), dtype=np.float64).reshape(-1, dim)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means whose assignment adds to a squared distance a penalty that grows with the list's length."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.permutation(len(x))[: min(lists, len(x))])].copy()
    even = len(x) / max(1, len(c))
    extra = np.zeros(len(c))
    for _ in range(rounds):
        at, unit = np.empty(len(x), dtype=int), 0.0
        for i in range(0, len(x), 2048):
            d = _squares(x[i : i + 2048], c)
            unit += d.min(1).sum()
            at[i : i + 2048] = (d + extra).argmin(1)
        n = np.bincount(at, minlength=len(c))
        extra = 0.5 * extra + 0.1 * (unit / max(1, len(x))) * (n / even - 1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        if (n == 0).any():
            c[n == 0] = x[rng.integers(len(x), size=int((n == 0).sum()))]
    return np.unique(c, axis=0)


class Graph:
    """Centroids and, for each, its nearest others and a few random ones."""

    def __init__(self, centroids: np.ndarray, degree: int = 16, far: int = 4, seed: int = 13):
        self.c = centroids
        n = len(centroids)
        k = min(degree, max(0, n - 1))
        near = np.empty((n, k), dtype=np.int32)
        for i in range(0, n, 1024):
            d = _squares(centroids[i : i + 1024], centroids)
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i : i + 1024] = np.argsort(d, axis=1)[:, :k]
        rng = np.random.default_rng(seed)
        self.near = np.hstack([near, rng.integers(n, size=(n, far)).astype(np.int32)]) if n else near
        self.start = rng.permutation(n)

    def search(self, x: np.ndarray, beam: int, expand: int = 12, hops: int = 12) -> tuple[np.ndarray, np.ndarray]:
        """Ids and distances of about the beam nearest centroids of each row, nearest first: each hop looks at the neighbours of the best."""
        n = len(self.c)
        if n <= beam or beam > BEAM:
            d = np.sqrt(_squares(x, self.c))
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            return order, np.take_along_axis(d, order, 1)
        ids = np.tile(self.start[:beam].astype(np.int32), (len(x), 1))
        d = self._distances(x, ids)
        for _ in range(hops):
            order = np.argsort(d, axis=1, kind="stable")
            ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
            more = self.near[ids[:, :expand]].reshape(len(x), -1)
            allids = np.hstack([ids, more])
            alld = np.hstack([d, self._distances(x, more)])
            order = np.argsort(allids, axis=1, kind="stable")
            si, sd = np.take_along_axis(allids, order, 1), np.take_along_axis(alld, order, 1)
            sd[:, 1:][si[:, 1:] == si[:, :-1]] = np.inf
            order = np.argsort(sd, axis=1, kind="stable")[:, :beam]
            new = np.take_along_axis(si, order, 1)
            same = np.array_equal(np.sort(new, axis=1), np.sort(ids, axis=1))
            ids, d = new, np.take_along_axis(sd, order, 1)
            if same:
                break
        return ids, d

    def _distances(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        g = self.c[ids]
        return np.sqrt(np.maximum(((g - x[:, None, :]) ** 2).sum(2), 0))


def replicas(graph: Graph, x: np.ndarray, slack: float = 0.12, most: int = 8) -> list[np.ndarray]:
    """Lists of each vector: the nearest, and those at most slack farther that no chosen list shields (is nearer to than the vector)."""
    ids, d = graph.search(x, 32)
    out = []
    for row, dist in zip(ids, d, strict=True):
        chosen = [row[0]]
        for j in range(1, len(row)):
            if dist[j] > dist[0] * (1 + slack) or len(chosen) >= most:
                break
            c = graph.c[row[j]]
            if all(((graph.c[k] - c) ** 2).sum() > dist[j] ** 2 for k in chosen):
                chosen.append(row[j])
        out.append(np.array(chosen))
    return out


class Index:
    """The graph, the stored postings (list, id, v) and each list's length."""

    def __init__(self, graph: Graph, postings: DataFrame, sizes: dict[int, int], dim: int, rows: int):
        self.graph, self.postings, self.sizes, self.dim, self.rows = graph, postings, sizes, dim, rows


def build(packed: DataFrame, dim: int) -> Index:
    """Fits on at most SAMPLE vectors, chosen by hash; then every vector is indexed."""
    spark = packed.sparkSession
    rows = packed.count()
    share = min(1.0, 1.2 * SAMPLE / max(1, rows))
    got = packed.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30))).limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    x = unpack(got, dim) if got else np.zeros((0, max(1, dim)))
    lists = int(max(1, min(MAX_LISTS, rows // LIST_SIZE, len(x) // 4)))
    graph = Graph(balanced_centroids(x, lists) if len(x) else np.zeros((0, max(1, dim))))
    held = spark.sparkContext.broadcast(graph)

    def place(batches):
        for b in batches:
            v = b.column("v").to_pylist()
            ids, out = b.column("id").to_pylist(), ([], [], [])
            for i in range(0, len(v), 256):
                for j, chosen in enumerate(replicas(held.value, unpack(v[i : i + 256], dim)), i):
                    for c in chosen:
                        out[0].append(int(c))
                        out[1].append(ids[j])
                        out[2].append(v[j])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())], names=["list", "id", "v"])

    postings = stored(packed.mapInArrow(place, "list int, id long, v binary"), "ann-postings")
    sizes = {r["list"]: r["count"] for r in postings.groupBy("list").count().collect()}
    return Index(graph, postings, sizes, dim, rows)


def _visited(at: np.ndarray, d: np.ndarray, sizes: np.ndarray, k: int, ratio: float) -> np.ndarray:
    """Which of each row's lists (nearest first) are visited: those near enough, and more until they hold some times k vectors."""
    held = np.cumsum(sizes[at], axis=1)
    before = np.hstack([np.zeros((len(at), 1), dtype=held.dtype), held[:, :-1]])
    return (d <= d[:, :1] * (1 + ratio) if np.isfinite(ratio) else np.isfinite(d)) | (before < 16 * (k + 1))


def _by_list(sizes: dict[int, int], lists: int) -> np.ndarray:
    out = np.zeros(lists, dtype=np.int64)
    out[list(sizes)] = list(sizes.values())
    return out


def _nearest_of_all(packed: DataFrame, ids: np.ndarray, x: np.ndarray, dim: int, k: int) -> list[set[int]]:
    """The ids of the k rows nearest to each row of x (of these ids): every row is compared, each task keeps its k best."""
    held = packed.sparkSession.sparkContext.broadcast((ids, x))

    def best(batches):
        ids, x = held.value
        d, at = np.full((len(x), 0), np.inf), np.full((len(x), 0), -1, dtype=np.int64)
        for b in batches:
            new, v = b.column("id").to_numpy(), b.column("v").to_pylist()
            for i in range(0, len(v), 4096):
                near = _squares(x, unpack(v[i : i + 4096], dim))
                near[ids[:, None] == new[None, i : i + 4096]] = np.inf
                d, at = np.hstack([d, near]), np.hstack([at, np.broadcast_to(new[i : i + 4096], near.shape)])
                if d.shape[1] > k:
                    first = np.argpartition(d, k - 1, axis=1)[:, :k]
                    d, at = np.take_along_axis(d, first, 1), np.take_along_axis(at, first, 1)
        q, _ = np.nonzero(np.isfinite(d))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(at[np.isfinite(d)], pa.int64()), pa.array(d[np.isfinite(d)], pa.float64())], names=["q", "id", "d"])

    got = packed.mapInArrow(best, "q int, id long, d double").toPandas().sort_values(["q", "d", "id"]).drop_duplicates(["q", "id"])
    out = got.groupby("q").head(k).groupby("q")["id"].apply(set).to_dict()
    return [out.get(i, set()) for i in range(len(x))]


def widths(index: Index, packed: DataFrame, queries: DataFrame, k: int, recall: float | None = None) -> tuple[float, int]:
    """(ratio, beam): of the bounds under which the lists hold enough of the trial queries' nearest rows, those that visit the fewest rows."""
    graph, n = index.graph, len(index.graph.c)
    trial = queries.orderBy(F.xxhash64("id"), "id").limit(TRIALS).toArrow()
    if not trial.num_rows or n <= 1:
        return RATIOS[0], BEAM
    ids, x = trial.column("id").to_numpy(), unpack(trial.column("v").to_pylist(), index.dim)
    truth = _nearest_of_all(packed, ids, x, index.dim, k)
    lists: dict[int, list[int]] = {}
    for r in index.postings.where(F.col("id").isin(sorted(set().union(*truth)))).select("id", "list").distinct().collect():
        lists.setdefault(r["id"], []).append(r["list"])
    sizes, least = _by_list(index.sizes, n), (RECALL if recall is None else recall) * sum(map(len, truth))
    held = np.zeros((len(x), n), dtype=bool)

    def cost(at: np.ndarray, d: np.ndarray, ratio: float) -> float | None:
        seen = _visited(at, d, sizes, k, ratio)
        held[:] = False
        row, _ = np.nonzero(seen)
        held[row, at[seen]] = True
        hits = sum(bool(held[i, lists[t]].any()) for i, near in enumerate(truth) for t in near)
        return float(sizes[at[seen]].sum()) if hits >= least else None

    at, d = graph.search(x, BEAM)
    if cost(at, d, RATIOS[0]) is not None:
        return RATIOS[0], BEAM
    at, d = graph.search(x, n + BEAM)
    beams = sorted({min(n, int(BEAM * 1.25**i)) for i in range(64)} - set(range(BEAM + 1)) | {n})
    found = [(c, r, b) for r in RATIOS for b in beams if (c := cost(at[:, :b], d[:, :b], r)) is not None]
    _, ratio, beam = min(found)
    return ratio, max(beam, BEAM + 1)


FOUND = "query_id long, vec_id long, score double"


def search(index: Index, queries: DataFrame, k: int = 10, ratio: float = RATIOS[0], beam: int = BEAM, everywhere: bool = False) -> DataFrame:
    """The k nearest of each query (id, v) as (query_id, rank, vec_id, score). everywhere: over all lists, which is exact.

    Queries may have a column most: rows farther away are not asked for, and then lists give next to no rows.
    """
    if "most" not in queries.columns:
        queries = queries.withColumn("most", F.lit(float("inf")))
    spark, dim, sizes = queries.sparkSession, index.dim, index.sizes
    held = spark.sparkContext.broadcast((index.graph, sizes))

    def route(batches):
        graph, n = held.value
        every = np.array(sorted(n))
        n = _by_list(n, len(graph.c))
        for b in batches:
            v, ids, most, out = b.column("v").to_pylist(), b.column("id").to_pylist(), b.column("most").to_pylist(), ([], [], [], [])
            for i in range(0, len(v), 256):
                x = unpack(v[i : i + 256], dim)
                at, d = graph.search(x, beam)
                near = _visited(at, d, n, k, ratio)
                for j in range(len(x)):
                    for c in every if everywhere else at[j][near[j]]:
                        out[0].append(int(c))
                        out[1].append(ids[i + j])
                        out[2].append(v[i + j])
                        out[3].append(most[i + j])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.float64())], names=["list", "id", "v", "most"])

    routed = stored(queries.select("id", "v", "most").mapInArrow(route, "list int, id long, v binary, most double"), "ann-routes")
    asked = {r["list"]: r["count"] for r in routed.groupBy("list").count().collect()}
    top = max([*sizes, *asked], default=0)
    blocks = lambda n: F.element_at(F.split(F.lit(",".join(str(-(-n.get(i, 1) // BLOCK)) for i in range(top + 1))), ",").cast("array<int>"), F.col("list") + 1)
    part = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), blocks(n)).cast("int")
    spread = lambda n, name: F.explode(F.sequence(F.lit(0), blocks(n) - 1)).alias(name)
    p = index.postings.select("list", "id", "v", part(sizes, 1).alias("pb"), spread(asked, "qb"))
    q = routed.select("list", "id", "v", "most", part(asked, 2).alias("qb"), spread(sizes, "pb"))

    def nearest_in_block(left, right):
        import pandas as pd

        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        ids, x = left["id"].to_numpy(), unpack(left["v"], dim)
        out = ([], [], [])
        for qid, y, most in zip(right["id"].to_numpy(), unpack(right["v"], dim), right["most"].to_numpy(), strict=True):
            d = np.sqrt(((x - y) ** 2).sum(1))
            close = np.flatnonzero((ids != qid) & (d <= most))
            if len(close) > 4 * k:
                close = close[d[close] <= np.partition(d[close], k)[k]]
            best = close[np.lexsort((ids[close], d[close]))]
            _, first = np.unique(ids[best], return_index=True)
            best = best[np.sort(first)][:k]
            best = best[np.isfinite(d[best])]
            out[0].extend([qid] * len(best))
            out[1].extend(ids[best])
            out[2].extend(d[best])
        return pd.DataFrame({"query_id": np.array(out[0], dtype="int64"), "vec_id": np.array(out[1], dtype="int64"), "score": np.array(out[2], dtype="float64")})

    keys = ("list", "pb", "qb")
    found = p.groupBy(*keys).cogroup(q.groupBy(*keys)).applyInPandas(nearest_in_block, FOUND).dropDuplicates(["query_id", "vec_id"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """Queries are the rows whose id is divisible by ``every``, against all rows."""
    packed, dim = usable(vectors, id_col, vec_col)
    if not dim:
        return vectors.sparkSession.createDataFrame([], T.StructType([T.StructField("query_id", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())]))
    packed = stored(packed.dropDuplicates(["id", "v"]), "ann-vectors")
    index = build(packed, dim)
    queries = packed.where(F.col("id") % every == 0)
    found = stored(search(index, queries, k), "ann-found")
    ratio, beam = widths(index, packed, queries, k)
    if (ratio, beam) != (RATIOS[0], BEAM):
        # The first search's k-th distance bounds what the wider one has to give back.
        bound = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.max("score") * (1 + 1e-9)).alias("most"))
        asked = queries.join(bound, "id", "left").withColumn("most", F.coalesce("most", F.lit(float("inf"))))
        both = found.drop("rank").unionByName(search(index, asked, k, ratio, beam).drop("rank")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        found = stored(both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-found")
    want = min(k, packed.select("id").distinct().count() - 1)
    full = found.groupBy("query_id").count().where(F.col("count") >= want).select(F.col("query_id").alias("id"))
    short = queries.join(full, "id", "left_anti")
    if want <= 0 or short.isEmpty():
        return found
    rest = short.select("id").distinct().withColumnRenamed("id", "query_id")
    return found.join(rest, "query_id", "left_anti").unionByName(search(index, short, k, everywhere=True))
