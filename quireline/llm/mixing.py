"""Mixing to target weights with soft membership.

A classifier trained on the labelled table gives each document a probability for
each domain. Nonnegative rates are then fitted, one a document, such that the
expected domain token totals (rate x tokens x probability, summed) match the
targets: a least-squares problem with a small pull towards rate 1, solved by
projected gradient steps. A step needs the residual of each domain only, so an
iteration is one aggregation; a document's rate follows from one value for each
domain, and no state is kept for it between iterations.

Domains are ``toxic`` (whatever the quality), ``poor`` (quality 0) and ``clean``.

Defined results: a null or empty text has no tokens and the labelled rows' class
shares as probabilities; labels that are null or of unknown documents are
ignored; with no labels every document is clean; rows that repeat are rated
alike, and ties in a domain's word list go to the word first by its bytes; very long
texts count whole; targets out of reach give the nearest totals and targets_met
false; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, quoted, scratch, small_batches, stored

DOMAINS = ("clean", "poor", "toxic")
#: Shares of the tokens that the mixture should hold.
TARGETS = {"clean": 0.93, "poor": 0.06, "toxic": 0.01}
WORD = re.compile(r"[^\W_]+")
#: What is measured of a text besides words: roots of shares, so that length does not decide.
SHAPE = 6


def _domain(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when(quality.isNotNull() | toxic.isNotNull(), "clean")


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def shape(text: str | None, tokens: list[bytes]) -> list[float]:
    """Repetition, capitals, signs and short lines: what tells poor text whatever its words."""
    if not tokens:
        return [0.0] * SHAPE
    n, raw = len(tokens), text or ""
    same = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n
    upper = sum(t.isupper() for t in tokens) / n
    signs = sum(not t.isalnum() and t.isascii() for t in tokens) / n
    alone = sum(len(t) == 1 and not t.isalnum() for t in tokens) / n
    lines = raw.split("\n")
    return [same**0.5, upper**0.5, signs**0.5, alone**0.5, (1 - len(set(tokens)) / n) ** 0.5, (1 - len(set(lines)) / len(lines)) ** 0.5]


def _clean(tokens: list[bytes]) -> set[bytes]:
    return {t.strip(b".,;:!?\"'()[]#$%&*").lower() for t in tokens}


class Classifier:
    """Logistic regression for each domain's odds on marked words and the text's shape; softmax over the domains."""

    def __init__(self, vocabulary: dict[bytes, int], weights: np.ndarray, prior: np.ndarray):
        self.vocabulary, self.weights, self.prior = vocabulary, weights, prior

    def row(self, text: str | None, tokens: list[bytes]) -> tuple[list[int], list[float]]:
        get = self.vocabulary.get
        return [i for i in map(get, _clean(tokens)) if i is not None], shape(text, tokens)

    def predict(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        p, n = np.empty((len(texts), len(DOMAINS))), np.empty(len(texts), dtype=np.int64)
        v = len(self.vocabulary)
        for i, t in enumerate(texts):
            tokens = tokens_of(t)
            n[i] = len(tokens)
            if not tokens or not len(self.weights):
                p[i] = self.prior
                continue
            marked, form = self.row(t, tokens)
            z = self.weights[marked].sum(0) + np.array(form) @ self.weights[v : v + SHAPE] + self.weights[-1]
            z = np.exp(z - z.max())
            p[i] = z / z.sum()
        return p, n


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, words_kept: int = 800, least_docs: int = 5) -> Classifier:
    """Fits on about sample_rows labelled documents, chosen by a hash of the id; that bounds the fitting whatever the tables' size.

    The words kept are those whose presence tells one domain from the rest most surely (by a z-score of document shares). An id
    with several labels takes the least one. Only the sample's ids meet the documents, so texts are not shuffled.
    """
    with scratch(docs.sparkSession):
        return _train(docs, labels, sample_rows, words_kept, least_docs)


def _train(docs: DataFrame, labels: DataFrame, sample_rows: int, words_kept: int, least_docs: int) -> Classifier:
    spark = docs.sparkSession
    lab = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("quality", "toxic")).alias("l"))
    lab = lab.select("doc_id", _domain(F.col("l.quality"), F.col("l.toxic")).alias("domain")).where("domain is not null")
    share = min(1.0, sample_rows / max(1, lab.count()))
    ids = lab.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = stored(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").select("text", "domain"), "mix-sample")
    small_batches(spark)

    def sets(batches):
        for b in batches:
            out = [list(_clean(tokens_of(t))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("domain"), pa.array(out, pa.list_(pa.binary()))], names=["domain", "words"])

    words = picked.mapInArrow(sets, "domain string, words array<binary>")
    sizes = {r["domain"]: r["count"] for r in picked.groupBy("domain").count().collect()}
    n = sum(sizes.values())
    if not n:
        return Classifier({}, np.zeros((0, len(DOMAINS))), np.array([1.0, 0.0, 0.0]))
    counts = words.select("domain", F.explode("words").alias("w")).groupBy("w").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS])
    counts = counts.withColumn("all", sum((F.col(d) for d in DOMAINS), F.lit(0))).where(F.col("all") >= least_docs)

    def z(d: str) -> Column:
        a, m = F.lit(float(sizes.get(d, 0))), F.lit(float(n))
        p = F.col("all") / m
        return F.abs(F.col(d) - a * p) / F.sqrt(a * p * (1 - p) + 1.0)

    top = counts.withColumn("z", F.greatest(*[z(d) for d in DOMAINS])).orderBy(F.desc("z"), "w").limit(words_kept).select("w").collect()
    vocabulary = {bytes(r["w"]): i for i, r in enumerate(top)}
    prior = np.array([sizes.get(d, 0) / n for d in DOMAINS])
    blank = Classifier(vocabulary, np.zeros((0, len(DOMAINS))), prior)
    held = spark.sparkContext.broadcast(blank)

    def encode(batches):
        c = held.value
        for b in batches:
            out = []
            for t in b.column("text").to_pylist():
                x = np.zeros(len(c.vocabulary) + SHAPE + 1, dtype=np.float32)
                marked, form = c.row(t, tokens_of(t))
                x[marked], x[-1 - SHAPE : -1], x[-1] = 1, form, 1
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("domain"), pa.array(out, pa.binary())], names=["domain", "x"])

    got = picked.mapInArrow(encode, "domain string, x binary").toArrow()
    held.unpersist()
    at = np.array([DOMAINS.index(d) for d in got.column("domain").to_pylist()])
    x = np.empty((got.num_rows, len(vocabulary) + SHAPE + 1), dtype=np.float32)
    for i, row in enumerate(got.column("x")):
        x[i] = np.frombuffer(row.as_buffer(), dtype=np.float32)
    del got
    return Classifier(vocabulary, _softmax(x, at, prior), prior)


def _softmax(x: np.ndarray, at: np.ndarray, prior: np.ndarray, steps: int = 150, ridge: float = 3e-4) -> np.ndarray:
    """Accelerated gradient steps on the mean log loss, each as long as the features' curvature allows."""
    one = np.eye(len(DOMAINS), dtype=np.float32)[at]
    w = np.zeros((x.shape[1], len(DOMAINS)), dtype=np.float32)
    w[-1] = np.log(np.maximum(prior, 1e-4))
    v, q = w.copy(), np.ones(x.shape[1], dtype=np.float32)
    for _ in range(12):
        q = x.T @ (x @ q)
        q /= np.linalg.norm(q)
    rate = 1.0 / (0.5 * float(np.linalg.norm(x @ q)) ** 2 / len(x) + ridge)
    for k in range(steps):
        z = x @ v
        z = np.exp(z - z.max(1, keepdims=True))
        g = x.T @ (z / z.sum(1, keepdims=True) - one) / len(x)
        g[:-1] += ridge * v[:-1]
        new = v - rate * g
        v, w = new + k / (k + 3) * (new - w), new
    return w


def posteriors(docs: DataFrame, classifier: Classifier, *keep: str) -> DataFrame:
    """keep, n_tokens and p_<domain> for each row."""
    held = docs.sparkSession.sparkContext.broadcast(classifier)
    small_batches(docs.sparkSession)
    plain = numbered(docs.select(*map(quoted, dict.fromkeys([*keep, "text"]))))
    at = [*dict.fromkeys([*keep, "text"])].index("text")
    schema = plain.select(plain.columns[: len(keep)]).schema.add("n_tokens", "long")
    for d in DOMAINS:
        schema = schema.add(f"p_{d}", "double")

    def run(batches):
        for b in batches:
            p, n = held.value.predict(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n), *(pa.array(p[:, j]) for j in range(len(DOMAINS)))], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*keep, *schema.names[len(keep) :])


def _moments(stats: DataFrame, dual: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """Shares of all tokens that the domains get at these dual values, and their derivative (negated): one aggregation."""
    names = [f"p_{d}" for d in DOMAINS]
    k = len(names)
    weight = F.col("n_tokens") * _rate(dual)
    kept = F.when(weight > 0, F.col("n_tokens"))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = stats.agg(*[F.sum(weight * F.col(c)).alias(f"s{i}") for i, c in enumerate(names)], *[F.sum(kept * F.col(names[i]) * F.col(names[j])).alias(f"g{i}_{j}") for i, j in pairs]).first()
    gram = np.zeros((k, k))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = (got[f"g{i}_{j}"] or 0.0) / total
    return np.array([(got[f"s{i}"] or 0.0) / total for i in range(k)]), gram


def _rate(dual: np.ndarray) -> Column:
    """The projection to nonnegative rates of what the gradients have summed up to."""
    return F.greatest(F.lit(0.0), sum((F.col(f"p_{d}") * F.lit(-float(y)) for d, y in zip(DOMAINS, dual, strict=True)), F.lit(1.0)))


class Fit:
    """rate: a column on the fitted rows; shares: what the domains reach; met: whether all are within tolerance; iterations."""

    def __init__(self, rate: Column, shares: dict[str, float], met: bool, iterations: int):
        self.rate, self.shares, self.met, self.iterations = rate, shares, met, iterations


def fit_rates(stats: DataFrame, targets: dict[str, float], iterations: int = 40, pull: float = 1e-4, least_pull: float = 1e-10, tolerance: float = 0.002) -> Fit:
    """Nonnegative rates whose expected domain totals are nearest to the targets. stats has n_tokens and p_<domain>.

    Minimises half the weighted squares of the domain totals' residuals (as shares of all tokens) plus pull/2 times the token-weighted
    squared distance of the rates from 1; a domain's weight is the inverse of its own curvature, so that a small domain counts as a
    large one does. In the token-weighted metric a document's gradient is sum_d p_d * weight_d * residual_d + pull * (rate - 1), so
    projected gradient steps that sum their gradients before the projection give rate = max(0, 1 - sum_d p_d * y_d): a value for each
    domain is all the state there is. A step is scaled by the inverse of the gradients' curvature over the documents whose rate is
    positive, and halved until the optimality residual falls. Where the pull keeps the totals from their targets, it is taken back a
    hundredfold, down to least_pull. Targets that no rates reach end in the nearest totals and met = False;
    a domain is met when its total is within tolerance of its target, relative to the larger of target and 0.01.
    """
    aim = np.array([targets[d] for d in DOMAINS])
    total = float(stats.agg(F.sum("n_tokens")).first()[0] or 0)
    dual = np.zeros(len(DOMAINS))
    if not total:
        return Fit(F.lit(1.0), {}, False, 0)
    shares, gram = _moments(stats, dual, total)
    inverse_weight = np.maximum(np.diag(gram), 1e-6)
    scale = np.maximum(aim, 0.01)
    off = lambda shares, dual: shares - aim - pull * inverse_weight * dual
    met = lambda: bool((np.abs(shares - aim) <= tolerance * scale).all())
    done = 0
    for done in range(1, iterations + 1):
        now = off(shares, dual)
        if float((np.abs(now) / scale).max()) < tolerance / 20:
            if met() or pull <= least_pull:
                break
            pull = max(pull / 100, least_pull)
            now = off(shares, dual)
        step = np.linalg.solve(gram + pull * np.diag(inverse_weight), now)
        for _ in range(12):
            then = _moments(stats, dual + step, total)
            if np.linalg.norm(off(then[0], dual + step) / scale) < np.linalg.norm(now / scale):
                break
            step = step / 2
        else:
            break
        dual, (shares, gram) = dual + step, then
    return Fit(_rate(dual), dict(zip(DOMAINS, shares.tolist(), strict=True)), met(), done)


NEW = ["n_tokens", *(f"p_{d}" for d in DOMAINS), "rate", "targets_met"]


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The columns of docs with n_tokens, p_<domain>, rate and targets_met (own columns of these names are replaced).

    targets_met is the same for all rows: whether the rates reach the targets. Documents go through the classifier once, and are
    stored with their probabilities; the fit reads those columns only.
    """
    own = [c for c in docs.columns if c.lower() not in NEW]
    classifier = train(docs, labels)
    judged = stored(posteriors(docs.select(*map(quoted, own)), classifier, *own), "mix-judged")
    fit = fit_rates(judged, targets or TARGETS)
    return judged.withColumn("rate", fit.rate).withColumn("targets_met", F.lit(fit.met))


def mixing(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, targets_met for each document; without the texts nothing but ids and figures is moved."""
    classifier = train(docs, labels)
    stats = stored(posteriors(docs.select("doc_id", "text"), classifier, "doc_id"), "mix-stats")
    fit = fit_rates(stats, TARGETS)
    return stats.withColumn("rate", fit.rate).withColumn("targets_met", F.lit(fit.met))
