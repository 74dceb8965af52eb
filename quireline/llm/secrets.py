"""Secret scanning: fixed patterns plus character Markov models, DataFrame functions only.

Base spans come from three fixed patterns. The method then looks at every other
long run of key characters: two first-order character Markov models, one of
random strings and one of ordinary identifiers, are trained from labelled
samples, and a run whose log-likelihood ratio favours the random model becomes
a span of kind ``markov``. A run that holds a base span adds nothing, and the text
of an assignment is not searched again. Ordinary samples are put together from
words of the documents themselves (a bounded number) and from fixed ones; the ratio
that is asked for is the one which few held-out ordinary samples exceed.

Defined results: a null or empty text has no spans; repeated rows are scanned
each on their own; ids and extra columns are carried through untouched; an
empty table gives an empty table; whole texts are scanned whatever their length.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, quoted

# The base patterns and the least lengths of what they find.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "markov")

#: Characters the models know; any other counts as one further symbol.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
SYMBOLS = len(ALPHABET) + 1
CANDIDATE_LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LEAST},}}"
#: Natural-log odds that a run must reach in any case: a prior of one random run in about 20,000.
LLR_LEAST = 10.0

# Plain words from which the ordinary half of the samples is put together.
WORDS = (
    "the and that with this from have not are was for you all one out when your said there use each which she how their will other "
    "about many then them these some her would make like him into time has look two more write see number way could people than first "
    "water been call who oil its now find long down day did get come made may part over new sound take only little work know place "
    "year live back give most very after thing our just name good sentence man think say great where help through much before line "
    "right too mean old any same tell boy follow came want show also around form three small set put end does another well large must "
    "big even such because turn here why ask went men read need land different home us move try kind hand picture again change off "
    "play spell air away animal house point page letter mother answer found study still learn should world user account index value "
    "config option default request response handler service manager factory builder stream buffer reader writer parser format table "
    "column field record session context message event listener connection transaction document version update delete insert select "
    "und der die das nicht eine auch sich mit ist von werden zeichnung entwicklung geschwindigkeit verbindung les des est une pour dans "
    "que avec sur plus nous ouvrage developpement los las una para como entre sobre tambien desarrollo informacion comunidad"
).split()


def corpus_words(docs: DataFrame, rows: int = 2000, sample_docs: int = 4000) -> list[str]:
    """At most rows distinct words of 3 to 14 letters, by hash, out of about sample_docs documents that are chosen by a hash of the id."""
    share = min(1.0, sample_docs / max(1, docs.count()))
    chosen = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    words = chosen.select(F.explode(F.split(F.lower("text"), "[^A-Za-z]+")).alias("w")).where(F.length("w").between(3, 14)).distinct()
    return [r["w"] for r in words.orderBy(F.xxhash64("w"), "w").limit(rows).collect()]


def labelled_samples(spark: SparkSession, rows: int = 4000, docs: DataFrame | None = None) -> DataFrame:
    """(sample, is_random): digests in the usual key alphabets, and words joined as identifiers and paths are, and plain numbers.

    The words are the fixed ones and those of the documents, if given.
    """
    pool = [*WORDS, *(corpus_words(docs) if docs is not None else [])]
    n = len(pool)
    words = F.split(F.lit(" ".join(pool)), " ")
    ids = spark.range(rows)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest)), "=+$", "")
    kind = F.col("id") % 4
    rand = F.when(kind == 0, b64).when(kind == 1, F.translate(b64, "+/", "x7")).when(kind == 2, F.upper(F.translate(b64, "+/", "q4"))).otherwise(F.substring(digest, 1, 40))
    pick = [F.element_at(words, (F.pmod(F.xxhash64(F.col("id"), F.lit(j)), F.lit(n)) + 1).cast("int")) for j in range(5)]
    camel = F.concat(pick[0], *[F.initcap(p) for p in pick[1:]])
    plain = F.when(kind == 0, F.concat_ws("_", *pick)).when(kind == 1, camel).when(kind == 2, F.concat_ws("-", *pick)).otherwise(F.concat_ws("/", *pick))
    number = F.format_string("%019d%04d", F.abs(F.xxhash64("id")), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10_000)))
    plain = F.when(F.col("id") % 7 == 0, F.concat(pick[0], pick[1], pick[2])).when(F.col("id") % 11 == 0, F.upper(F.concat_ws("_", *pick))).when(F.col("id") % 13 == 0, F.concat(camel, (F.col("id") % 2100).cast("string"))).when(F.col("id") % 17 == 0, number).otherwise(plain)
    return ids.select(rand.alias("sample"), F.lit(True).alias("is_random")).union(ids.select(plain.alias("sample"), F.lit(False).alias("is_random")))


def split_samples(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Three quarters for the models, a quarter held out for the threshold, by a hash of the sample."""
    held = F.pmod(F.xxhash64("sample"), F.lit(4)) == 0
    return samples.where(~held), samples.where(held)


def threshold(held_out: DataFrame, ratios: list[float], errors: float = 0.002, least: float = LLR_LEAST) -> float:
    """The least ratio that at most a share of the held-out ordinary samples exceeds, and no less than the prior odds.

    Only samples as long as a candidate count. Without any there is no measure, and nothing is to be found.
    """
    plain = held_out.where(~F.col("is_random") & (F.length("sample") >= CANDIDATE_LEAST))
    found = plain.agg(F.percentile(_ratio(F.col("sample"), _table(ratios)), 1 - errors).alias("t")).first()["t"]
    return float("inf") if found is None else max(least, float(found))


def train(samples: DataFrame) -> list[float]:
    """Log ratio of the two transition probabilities for each pair of symbols, with one added to each count.

    The table has SYMBOLS squared entries whatever the samples' number; null and
    one-character samples add nothing, and without samples every ratio is 0.
    """
    pairs = samples.where(F.length("sample") > 1).select("is_random", F.explode(_pairs(F.col("sample"))).alias("pair"))
    counts = pairs.groupBy("is_random", "pair").count().collect()
    seen = {True: [1.0] * SYMBOLS**2, False: [1.0] * SYMBOLS**2}
    for r in counts:
        seen[bool(r["is_random"])][r["pair"]] += r["count"]
    out = []
    for a in range(SYMBOLS):
        row = slice(a * SYMBOLS, (a + 1) * SYMBOLS)
        totals = {k: sum(v[row]) for k, v in seen.items()}
        out += [math.log(x / totals[True]) - math.log(y / totals[False]) for x, y in zip(seen[True][row], seen[False][row], strict=True)]
    return out


def _pairs(s: Column) -> Column:
    """Codes of a text's neighbouring characters; characters are taken apart once, so the cost follows the length."""
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.transform(F.arrays_zip(F.slice(codes, F.lit(1), F.size(codes) - 1).alias("a"), F.slice(codes, F.lit(2), F.size(codes) - 1).alias("b")), lambda p: p["a"] * SYMBOLS + p["b"])


def _table(ratios: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.5f}" for x in ratios)), ",").cast("array<double>")


def _ratio(s: Column, table: Column) -> Column:
    return F.aggregate(_pairs(s), F.lit(0.0), lambda acc, p: acc + F.element_at(table, (p + 1).cast("int")))


SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Matches that one fold takes; folds of folds keep the cost near the number of matches.
FOLD = 128


def _none() -> Column:
    return F.array().cast(SPAN)


def _pieces(text: Column, pattern: str) -> Column:
    """(gap, match) for each of a pattern's leftmost non-overlapping matches: gap is the text since the one before."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"))


def _placed(pieces: Column, kind: int) -> Column:
    """Spans of the matches, from the lengths of gaps and matches before them."""
    zero = F.struct(F.lit(0).alias("pos"), _none().alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        return F.struct(end.alias("pos"), F.array_append(acc["spans"], F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["match"].alias("value"))).alias("spans"))

    folds = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / FOLD).cast("int")), lambda k: F.aggregate(F.slice(pieces, k * FOLD + 1, F.lit(FOLD)), zero, step))

    def join(acc: Column, f: Column) -> Column:
        return F.struct((acc["pos"] + f["pos"]).alias("pos"), F.array_append(acc["folds"], F.struct(acc["pos"].alias("pos"), f["spans"].alias("spans"))).alias("folds"))

    empty = F.struct(F.lit(0).alias("pos"), F.array().cast(f"array<struct<pos:int,spans:{SPAN}>>").alias("folds"))
    moved = F.aggregate(folds, empty, join, lambda acc: acc["folds"])
    return F.flatten(F.transform(moved, lambda f: F.transform(f["spans"], lambda x: _shifted(x, f["pos"]))))


def _shifted(span: Column, by: Column) -> Column:
    return F.struct((span["start"] + by).alias("start"), span["kind"].alias("kind"), (span["end"] + by).alias("end"), span["value"].alias("value"))


def _found(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches."""
    spans = _placed(_pieces(text, pattern), kind)
    return F.when(text.rlike(pattern), F.filter(spans, keep) if keep is not None else spans).otherwise(_none())


def _runs(text: Column, assigned: Column) -> Column:
    """Candidate runs outside the base spans: none in an assignment, none that holds a key or a hexadecimal run.

    Both of these consist of a run's characters, so one that overlaps a run lies in it.
    """
    whole = F.filter(_found(text, CANDIDATE, 3), lambda s: ~s["value"].rlike(f"{ACCESS}|{HEX}"))
    # with assignments: their matches cut the text, and each part is searched by itself
    gaps = F.transform(F.split(text, ASSIGN, -1), lambda g: F.filter(_found(g, CANDIDATE, 3), lambda s: ~s["value"].rlike(f"{ACCESS}|{HEX}")))
    starts = F.concat(F.array(F.lit(0)), F.transform(assigned, lambda s: s["end"]))
    cut = F.flatten(F.transform(F.arrays_zip(starts.alias("at"), gaps.alias("runs")), lambda g: F.transform(g["runs"], lambda s: _shifted(s, g["at"]))))
    return F.when(~text.rlike(CANDIDATE), _none()).when(F.size(assigned) > 0, cut).otherwise(whole)


def scan_secrets(docs: DataFrame, ratios: list[float], text_col: str = "text", llr_least: float = LLR_LEAST) -> DataFrame:
    """Adds ``secret_spans``: array of (start, kind, end, value, llr), sorted by start, then kind (an index into KINDS).

    One pass over the rows, without a shuffle. Columns of docs stay as they are; an
    own ``secret_spans`` column is replaced.
    """
    out = "secret_spans"
    docs = docs.drop(out)
    names = {c: fresh(docs, c) for c in ("assigned", "base", "runs")}
    text = F.coalesce(quoted(text_col), F.lit(""))
    long = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= ASSIGN_LEAST

    def typed(s: Column, llr: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"), llr.cast("double").alias("llr"))

    assigned, base, runs = (F.col(names[c]) for c in ("assigned", "base", "runs"))
    three = docs.withColumn(names["assigned"], F.when(text.rlike("[:=]"), _found(text, ASSIGN, 0)).otherwise(_none()))
    three = three.withColumn(names["base"], F.concat(F.filter(assigned, long), F.when(text.contains("AKIA"), _found(text, ACCESS, 1)).otherwise(_none()), _found(text, HEX, 2)))
    three = three.withColumn(names["runs"], _runs(text, assigned))
    table = _table(ratios)
    scored = F.filter(F.transform(runs, lambda c: typed(c, _ratio(c["value"], table))), lambda c: c["llr"] >= F.lit(llr_least))
    spans = F.array_sort(F.concat(F.transform(base, lambda b: typed(b, F.lit(None))), scored))
    return three.withColumn(out, spans).drop(*names.values())


def secret_digest(scanned: DataFrame) -> DataFrame:
    """doc_id with counts by kind, a digest of the base spans, and all spans as text."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    label = lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.concat_ws(",", F.transform(F.filter("secret_spans", lambda s: s["kind"] < 3), label))
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.transform("secret_spans", label)).alias("spans"), count(3).alias("n_markov"),
    )


def secret_scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    fit, held = split_samples(labelled_samples(spark, docs=docs.select("doc_id", "text")))
    ratios = train(fit)
    return secret_digest(scan_secrets(docs.select("doc_id", "text"), ratios, llr_least=threshold(held, ratios)))
