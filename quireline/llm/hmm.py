"""Hidden Markov language model over words, trained on the whole corpus.

Each state emits a word class, and the class emits the word: the most frequent
words are classes of their own, the others share a class by their last three
bytes and divide it in proportion to their counts plus one half, with one
further half for words not seen. Baum-Welch counts are gathered in every
partition and summed; each round covers all training texts. A text's
probability is the exact one: the scaled forward recursion over all its words.

Words are the lower-cased (A-Z) runs between ASCII white space, followed by one
end token. A text's class sequence is what the states see, so its score is the
forward probability of the classes plus each word's probability in its class.

Defined results: a null or empty text is the end token alone; a null id counts
as training; repeated rows count and are scored each on their own; with no
training texts the base score is 0 for every text; an empty table gives an empty
table; extra columns are ignored; memory holds one batch of coded texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, small_batches, stored

END = b" "
#: Words with a class of their own; classes that the others share; words whose counts every task holds.
OWN, SHARED, HEAD = 8192, 1024, 131072
STATES, WINDOW = 8, 64


def words(text: str | None) -> list[bytes]:
    out = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def count_words(texts: DataFrame) -> DataFrame:
    """(token, c) over all rows; each task sums up what it has read before rows are sent."""

    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b.column("text").to_pylist():
                c.update(words(t))
            if len(c) > 400_000:
                yield _counts(c)
                c = Counter()
        if c:
            yield _counts(c)

    return texts.select("text").mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _counts(c: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["token", "c"])


class Lexicon:
    """Totals, counts of up to HEAD most frequent words (all with a least count), the words with own classes, and each shared class's total."""

    def __init__(self, counts: DataFrame):
        shared = F.crc32(F.substring("token", -3, 3)) % SHARED
        parts = counts.groupBy(shared.cast("int").alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
        self.total, self.types = sum(r["n"] for r in parts), sum(r["v"] for r in parts)
        # the head by a threshold on counts rather than by a sort: no task and not the driver sees more than HEAD words
        grade = F.when(F.col("c") < 4096, F.col("c")).otherwise(4096 + F.floor(F.log2(F.col("c") / 4096) * 256)).cast("long")
        grades = sorted(((r["g"], r["count"]) for r in counts.groupBy(grade.alias("g")).count().collect()), reverse=True)
        least, held = None, 0
        for g, many in grades:
            held += many
            if held > HEAD:
                break
            least = g
        head = counts.where(grade >= least).toArrow() if least is not None else None
        rows = sorted(zip(head.column("c").to_pylist(), head.column("token").to_pylist(), strict=True), key=lambda r: (-r[0], r[1])) if head else []
        names, n = [r[1] for r in rows], [r[0] for r in rows]
        self.own = {w: i for i, w in enumerate(names[:OWN])}
        self.head = dict(zip(names, n, strict=True))
        weight = np.full(SHARED, 0.5)
        mass = np.zeros(SHARED)
        for r in parts:
            weight[r["k"]] += r["n"] + 0.5 * r["v"]
            mass[r["k"]] += r["n"]
        for w in self.own:
            k = zlib.crc32(w[-3:]) % SHARED
            weight[k] -= self.head[w] + 0.5
            mass[k] -= self.head[w]
        self.log_shared = np.log10(np.maximum(weight, 0.5))
        self.base = np.concatenate([[self.head[w] for w in names[:OWN]], np.zeros(OWN - len(self.own)), np.maximum(mass, 0)]) + 0.5
        self.base /= self.base.sum()

    def denominator(self) -> float:
        return math.log10(self.total + 0.5 * (self.types + 1))


CODED = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("code", pa.binary()), ("logs", pa.float64()), ("known", pa.int64()), ("in_class", pa.float64()), ("tail", pa.list_(pa.binary())), ("tail_n", pa.list_(pa.int64()))])


def encode(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """A row for each text: its classes as 16-bit numbers, sums over its frequent words, and its other words with their numbers."""
    held = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = held.value
        own, head, shared = lex.own.get, lex.head, {}
        logs = {w: math.log10(c + 0.5) for w, c in head.items()}
        for b in batches:
            rows = []
            for rid, doc_id, out, text in zip(*(b.column(c).to_pylist() for c in ("rid", "doc_id", "held_out", "text")), strict=True):
                tokens = words(text)
                seen = Counter(tokens)
                total, known, within, tail, cls = 0.0, 0, 0.0, [], {}
                for w, n in seen.items():
                    if w in head:
                        total += n * logs[w]
                        known += n
                    else:
                        tail.append(w)
                    k = own(w)
                    if k is None:
                        end = w[-3:]
                        k = shared.get(end)
                        if k is None:
                            k = shared[end] = OWN + zlib.crc32(end) % SHARED
                        within -= n * lex.log_shared[k - OWN]
                    else:
                        within -= n * logs[w]
                    cls[w] = k
                rows.append((rid, doc_id, out, len(tokens), np.array([cls[w] for w in tokens], dtype=np.int16).tobytes(), total, known, within, tail, [seen[w] for w in tail]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CODED.types, strict=True)] if rows else [pa.array([], t) for t in CODED.types], schema=CODED)

    small_batches(docs.sparkSession)
    kinds = "rid long, doc_id long, held_out boolean, n_tokens long, code binary, logs double, known long, in_class double, tail array<binary>, tail_n array<long>"
    return stored(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, kinds), "hmm-coded")


class Model:
    """Start and transition probabilities, and for each class (one more for padding) the states' emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def padded(self) -> np.ndarray:
        return np.vstack([self.emit.T, np.ones(self.start.size)])


def windows(codes: list[np.ndarray], width: int = WINDOW) -> np.ndarray:
    """Rows of width classes that hold all of every text; the last of a text is filled with the padding class."""
    pad = OWN + SHARED
    return np.vstack([np.pad(c, (0, -c.size % width), constant_values=pad).reshape(-1, width) for c in codes]) if codes else np.zeros((0, width), dtype=np.int64)


def opening(codes: list[np.ndarray], width: int = WINDOW) -> np.ndarray:
    """Which of the windows are a text's first."""
    sizes = [max(0, -(-c.size // width)) for c in codes]
    return np.concatenate([np.arange(n) == 0 for n in sizes]) if sizes else np.zeros(0, dtype=bool)


def usual(m: Model) -> np.ndarray:
    """The states' shares in the long run: what a window that goes on in a text begins with."""
    p = np.full(m.start.size, 1 / m.start.size)
    for _ in range(200):
        p = p @ m.move
    return p / p.sum()


def e_step(m: Model, rows: np.ndarray, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray, first: np.ndarray | None = None) -> None:
    """Adds the expected counts of these windows (forward-backward over all of them at once); first: which begin a text (all, if not given)."""
    obs, k = rows.T, m.start.size
    first = np.ones(len(rows), dtype=bool) if first is None else first
    begin = np.where(first[:, None], m.start, usual(m)).astype(np.float32)
    em, used = m.padded().astype(np.float32)[obs], obs < OWN + SHARED
    move = m.move.astype(np.float32)
    t, n = obs.shape
    alpha, scale = np.empty((t, n, k), np.float32), np.empty((t, n, 1), np.float32)
    for i in range(t):
        a = (alpha[i - 1] @ move if i else begin) * em[i]
        scale[i] = np.maximum(a.sum(1, keepdims=True), 1e-30)
        alpha[i] = a / scale[i]
    beta = np.ones((n, k), np.float32)
    gamma = np.empty_like(alpha)
    for i in range(t - 1, -1, -1):
        gamma[i] = alpha[i] * beta
        if i:
            back = em[i] * beta / scale[i]
            moved += (alpha[i - 1] * used[i][:, None]).T @ back
            beta = back @ move.T
    gamma *= used[:, :, None]
    started += gamma[0][first].sum(0)
    flat = obs.ravel()
    for s in range(k):
        emitted[s] += np.bincount(flat, weights=gamma[:, :, s].ravel(), minlength=OWN + SHARED + 1)[: OWN + SHARED]


def m_step(m: Model, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray, base: np.ndarray, prior: float = 200.0) -> Model:
    """New probabilities; emissions are drawn towards the corpus's class shares with the weight of prior words."""
    emit = emitted + prior * base
    move = moved * m.move + 1.0 / m.start.size
    start = started + 1.0
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def first_model(sample: np.ndarray, base: np.ndarray, states: int = STATES, seed: int = 3) -> Model:
    """A start for Baum-Welch: windows of a bounded sample, clustered, then a few rounds on the sample alone."""
    rng, dim = np.random.default_rng(seed), OWN + SHARED
    move = np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1))
    m = Model(np.full(states, 1 / states), move / move.sum(1, keepdims=True), np.tile(base, (states, 1)))
    if not len(sample):
        return m
    x = np.zeros((len(sample), dim), np.float32)
    for i, row in enumerate(sample):
        np.add.at(x[i], row[row < dim], 1)
    x = np.sqrt(x)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    centres, far = [x[rng.integers(len(x))]], np.full(len(x), np.inf)
    for _ in range(states - 1):
        far = np.minimum(far, np.maximum(0, 2 - 2 * x @ centres[-1]))
        centres.append(x[rng.choice(len(x), p=far / far.sum())] if far.sum() > 0 else x[rng.integers(len(x))])
    centres = np.array(centres)
    for _ in range(10):
        at = (x @ centres.T).argmax(1)
        for s in range(states):
            if (at == s).any():
                c = x[at == s].mean(0)
                centres[s] = c / max(np.linalg.norm(c), 1e-9)
    emitted = np.zeros((states, dim))
    for row, s in zip(sample, at, strict=True):
        np.add.at(emitted[s], row[row < dim], 1)
    m = Model(m.start, m.move, (emitted + 200 * base) / (emitted + 200 * base).sum(1, keepdims=True))
    for _ in range(6):
        acc = (np.zeros((states, dim)), np.zeros((states, states)), np.zeros(states))
        for i in range(0, len(sample), 1024):
            e_step(m, sample[i : i + 1024], *acc)
        m = m_step(m, *acc, base)
    return m


def baum_welch(coded: DataFrame, lexicon: Lexicon, rounds: int = 2, sample_texts: int = 400, states: int = STATES) -> Model:
    """Rounds over all training texts. Each text is seen in windows of WINDOW words, none left out.

    A window that goes on in a text begins with the states' usual shares, and only first windows count for the start. The one move
    from a window's last word to the next window's first is not counted: one in WINDOW, whatever the words. Scoring knows no windows.

    The sample that bounds the first model's cost is sample_texts texts by hash; the rounds that follow use every text.
    """
    train = coded.where("not held_out").select("rid", "code")
    got = train.withColumn("h", F.xxhash64("rid")).orderBy("h").limit(sample_texts).select("code").collect()
    picked = windows([np.frombuffer(r["code"], dtype=np.int16).astype(np.int64) for r in got])
    picked = picked[np.sort(np.random.default_rng(5).permutation(len(picked))[:2048])]
    m = first_model(picked, lexicon.base, states)
    spark, dim = coded.sparkSession, OWN + SHARED
    size = states * dim
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(m)

        def run(batches, held=held):
            m = held.value
            acc = (np.zeros((states, dim)), np.zeros((states, states)), np.zeros(states))
            waiting, n = [], 0

            def use():
                rows, first = windows(waiting), opening(waiting)
                for i in range(0, len(rows), 1024):
                    e_step(m, rows[i : i + 1024], *acc, first[i : i + 1024])
                waiting.clear()

            for b in batches:
                for c in b.column("code").to_pylist():
                    waiting.append(np.frombuffer(c, dtype=np.int16).astype(np.int64))
                    n += waiting[-1].size
                    if n >= 200_000:
                        use()
                        n = 0
            use()
            flat = np.concatenate([a.ravel() for a in acc])
            keys = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(flat[keys])], names=["k", "v"])

        sums = train.select("code").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
        flat = np.zeros(size + states * states + states)
        flat[sums.column("k").to_numpy()] = sums.column("v").to_numpy()
        m = m_step(m, flat[:size].reshape(states, dim), flat[size : size + states**2].reshape(states, states), flat[-states:], lexicon.base)
        held.unpersist()
    return m


def forward(m: Model, codes: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole class sequence: scaled forward recursion, longest first so that ended ones drop out."""
    order = sorted(range(len(codes)), key=lambda i: -codes[i].size)
    sizes = np.array([codes[i].size for i in order])
    out = np.zeros(len(codes))
    if not len(codes):
        return out
    flat = np.concatenate([codes[i] for i in order])
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    emit = np.ascontiguousarray(m.emit.T)
    logs, alpha, live = np.zeros(len(codes)), None, len(codes)
    still = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
    product = np.ones(len(codes))
    for t in range(sizes[0]):
        live = still[t]
        e = emit[flat[at[:live] + t]]
        a = (alpha[:live] @ m.move if t else m.start) * e
        s = a.sum(1)
        alpha = a / s[:, None]
        product[:live] *= s
        if t % 16 == 15 or live < len(product):
            logs[: len(product)] += np.log10(product)
            product = np.ones(live)
    logs[: len(product)] += np.log10(product)
    out[order] = logs
    return out


def score(coded: DataFrame, counts: DataFrame, lexicon: Lexicon, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Words outside the head meet their counts in a join."""
    held = coded.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            got = forward(held.value, [np.frombuffer(c, dtype=np.int16) for c in b.column("code").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rid", "doc_id", "held_out", "n_tokens", "logs", "known", "in_class")), pa.array(got)], names=["rid", "doc_id", "held_out", "n_tokens", "logs", "known", "in_class", "classes"])

    whole = coded.drop("tail", "tail_n").mapInArrow(run, "rid long, doc_id long, held_out boolean, n_tokens long, logs double, known long, in_class double, classes double")
    tail = coded.select("rid", F.explode(F.arrays_zip("tail", "tail_n")).alias("x")).select("rid", F.col("x.tail").alias("token"), F.col("x.tail_n").alias("n"))
    met = tail.join(counts, "token", "left").groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("t_logs"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("t_known"))
    logs = F.col("logs") + F.coalesce("t_logs", F.lit(0.0))
    return whole.join(met, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("t_known", F.lit(0))).cast("long").alias("n_known"), F.lit(lexicon.total).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(lexicon.denominator())).alias("base_score"), (F.col("classes") + F.col("in_class") + logs).alias("score"),
    )


def language_model(spark: SparkSession, docs: DataFrame, rounds: int = 2) -> DataFrame:
    d = docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id"), 5) == 1, F.lit(False)).alias("held_out"))
    counts = stored(count_words(d.where("not held_out")), "hmm-counts")
    lexicon = Lexicon(counts)
    coded = encode(d, lexicon)
    return score(coded, counts, lexicon, baum_welch(coded, lexicon, rounds))
