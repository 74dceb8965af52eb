"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier over hashed character
n-grams predicts each bit. A text's language is the one whose codeword has the
least loss, each bit's logistic loss weighted by that classifier's accuracy on
the training rows. A small lead over the runner-up flags the text as ambiguous.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
a null id is never held out; languages tie to the smaller name; with nothing to
learn from every text is ``und``; with one language every text with a letter is
of that language, with score 1; repeated rows get the same answer; an empty
table gives an empty table; whole texts count, whatever their length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, numbered, quoted, small_batches

DIM = 4096
#: Runs of letters, and of numerals such as one half or superscript two, which are none.
ALNUM = re.compile(r"[^\W\d_]+")
#: Bytes that separate words count as one blank: ASCII other than letters.
BYTES = np.array([c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], dtype=np.uint32)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for m in ALNUM.finditer(text) for c in m[0])


def features(text: str) -> np.ndarray:
    """Roots of the hashed counts of byte pairs and triples of the lower-cased text, of length 1."""
    a = BYTES[np.frombuffer(f" {text.lower()} ".encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    a = a[np.append(True, (a[1:] != 32) | (a[:-1] != 32))]
    pair = a[:-1] * np.uint32(2654435761) ^ a[1:] * np.uint32(40503)
    codes = (pair[:-1] * np.uint32(2246822519) ^ a[2:] * np.uint32(3266489917)) >> np.uint32(20) if a.size > 2 else pair[:0]
    counts = np.bincount(codes, minlength=DIM) + np.bincount((pair * np.uint32(668265263)) >> np.uint32(20), minlength=DIM)
    x = np.sqrt(counts.astype(np.float32))
    return x / max(float(np.sqrt((x * x).sum())), 1e-9)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1: all distinct splits for up to 5 languages, else the best of 64 random matrices by least distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        bits = [[1 if (k >> i) & 1 else -1 for i in range(n)] for k in range(1, 2**n - 1) if k & 1]
        return np.array(bits, dtype=float).T
    rng, width, best, far = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n))), None, -1
    for _ in range(64):
        m = rng.choice([-1.0, 1.0], size=(n, width))
        d = (width - m @ m.T) / 2
        np.fill_diagonal(d, width)
        if d.min() > far:
            best, far = m, d.min()
    return best


class Model:
    """langs, one codeword for each, and weights of the bits' classifiers."""

    def __init__(self, langs, code, w, b, trust):
        self.langs, self.code, self.w, self.b, self.trust = langs, code, w, b, trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability-like scores (rows by languages) and losses."""
        f = x @ self.w + self.b
        loss = (np.logaddexp(0, -f[:, None, :] * self.code[None]) * self.trust).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        return p / p.sum(1, keepdims=True), loss


def fit(x: np.ndarray, langs: list[str], steps: int = 80, ridge: float = 1e-4) -> Model:
    """One logistic classifier a bit, by accelerated gradient steps; rows weigh so that each language weighs the same."""
    names = sorted(set(langs))
    code = codewords(len(names))
    if len(names) < 2:
        return Model(names, code, np.zeros((DIM, 1)), np.ones(1), np.ones(1))
    at = np.array([names.index(v) for v in langs])
    y, weight = code[at], (1 / np.bincount(at))[at] / len(names)
    w, b = np.zeros((DIM, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1])
    v, vb = w.copy(), b.copy()
    for k in range(steps):
        f = x @ v + vb
        g = (-y / (1 + np.exp(y * f)) * weight[:, None]).astype(np.float32)
        nw, nb = v - 4 * (x.T @ g + ridge * v), vb - 4 * g.sum(0)
        r = k / (k + 3)
        v, vb, w, b = nw + r * (nw - w), nb + r * (nb - b), nw, nb
    right = (((x @ w + b) * y > 0) * weight[:, None]).sum(0)
    return Model(names, code, w, b, np.clip(2 * right - 1, 0.05, 1))


def learn(labelled: DataFrame, sample_docs: int = 3000) -> Model:
    """Fits on about sample_docs labelled rows (text, lang), the same share for each language, chosen by hash.

    sample_docs bounds the training set whatever the table's size; languages with fewer rows give all they have.
    """
    rows = labelled.where("lang is not null and text is not null").select("text", "lang")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.ones((0, 1)), np.zeros((DIM, 1)), np.ones(1), np.ones(1))
    each = max(20, sample_docs // len(counts))
    share = F.element_at(F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, each / n))]), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(1 << 20)) < share * (1 << 20))

    def encode(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"lang": b.column("lang"), "x": [features(t).astype(np.float16).tobytes() for t in b.column("text").to_pylist()]}, pa.schema([("lang", pa.string()), ("x", pa.binary())]))

    small_batches(labelled.sparkSession)
    got: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in chosen.mapInArrow(encode, "lang string, x binary").toLocalIterator():
        if len(got[r["lang"]]) < 2 * each:  # copies of one text share a hash and could all be chosen
            got[r["lang"]].append(bytes(r["x"]))
    langs = [k for k in sorted(got) for _ in got[k]]
    x = np.array([np.frombuffer(v, dtype=np.float16) for k in sorted(got) for v in got[k]], dtype=np.float32).reshape(-1, DIM)
    missing = sorted(set(counts) - set(langs))
    if missing:  # every language takes part, however rare
        for lang in missing:
            t = rows.where(F.col("lang") == lang).select("text").first()["text"]
            x, langs = np.vstack([x, features(t)[None]]), [*langs, lang]
    return fit(x, langs)


NEW = ("lang_pred", "score", "runner_up", "ambiguous")


def identify(docs: DataFrame, model: Model, text_col: str = "text", lead: float = 0.2) -> DataFrame:
    """docs with lang_pred, score, runner_up and ambiguous (the two best scores are less than lead apart); own columns of these names are replaced."""
    own = [c for c in docs.columns if c.lower() not in NEW]
    spark = docs.sparkSession
    held, at = spark.sparkContext.broadcast(model), own.index(text_col)
    plain = numbered(docs.select(*map(quoted, own)))
    schema = T.StructType(list(plain.schema.fields)).add("lang_pred", "string").add("score", "double").add("runner_up", "string").add("ambiguous", "boolean")

    def predict(batches):
        m = held.value
        for b in batches:
            texts = b.column(at).to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None and m.langs and has_letter(t)]
            lang, score, second, unsure = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts), [True] * len(texts)
            for i in range(0, len(known), 128):
                part = known[i : i + 128]
                p, loss = m.decode(np.array([features(texts[j]) for j in part]))
                order = np.argsort(loss, axis=1, kind="stable")
                for row, j in enumerate(part):
                    a = order[row, 0]
                    lang[j], score[j] = m.langs[a], float(p[row, a])
                    if len(m.langs) > 1:
                        c = order[row, 1]
                        second[j], unsure[j] = m.langs[c], bool(p[row, a] - p[row, c] < lead)
                    else:
                        unsure[j] = False
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(second, pa.string()), pa.array(unsure, pa.bool_())], names=schema.names)

    small_batches(spark)
    return plain.mapInArrow(predict, schema).toDF(*own, *NEW)


def held_out(parts: int = 4, part: int = 2):
    return F.coalesce(fold(F.col("doc_id"), parts) == part, F.lit(False))


def language_id(spark: SparkSession, docs: DataFrame) -> DataFrame:
    model = learn(docs.where(~held_out()))
    out = identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.drop("text")
