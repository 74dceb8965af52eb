"""URL filtering by fixed host/path rules and by mined association rules.

FP-growth mines combinations of URL tokens that go with a label. Rules whose
confidence and support are too low, and rules to which a shorter one with the
same consequent and no less confidence exists, are pruned. A page meets a rule
through an inverted index: each rule is listed under its rarest token, a url's
tokens are looked up there, and the rest of the rule is then checked.

Defined results: a null url, or one without ``://``, has an empty host and path
and no tokens, and is allowed; hosts keep ports and user parts as written;
repeated rows are judged alike; null labels are ignored; without usable rules
every page not judged by a fixed rule is allowed; an empty table gives an empty
table; extra columns are not used.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bounded, row_key, stored

# Fixed values: (verdict, rule); a rule is a host and the beginning of a path.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))

LABEL = "label="
BLOCK, ALLOW = LABEL + "block", LABEL + "allow"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does."""
    rule = verdict = None
    for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[1])):
        h, _, p = r.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def tokens(url: Column) -> Column:
    """Distinct tokens: host labels, registered domain, path words and query keys; digits are generalised."""
    host, path = host_path(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    words = F.filter(F.split(F.regexp_replace(ascii_lower(path), r"[0-9]+", "#"), r"[/._-]+"), lambda x: x != "")
    keys = F.filter(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: x != "")
    host_words = F.filter(F.split(F.regexp_replace(host, r"[0-9]+", "#"), r"[.-]+"), lambda x: x != "")
    tag = lambda a, t: F.transform(a, lambda x: F.concat(F.lit(t), x))
    domain = F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("d:"), F.array_join(F.slice(labels, -2, 2), ".")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(tag(host_words, "h:"), domain, tag(words, "p:"), tag(keys, "q:")))


def mine(labelled: DataFrame, min_support: float = 0.001, min_count: int = 8, min_confidence: float = 0.8, min_lift: float = 1.3) -> DataFrame:
    """Rules (rule_id, antecedent, verdict, confidence, support, key) from rows (url, blocked).

    A rule must also beat its label's share of all rows by min_lift: where most rows are allowed, "allow" is no finding.

    Tokens below the least support cannot be in a rule and are dropped first; all others go to the
    miner, so supports and confidences are exact. The combinations it holds grow with the number of
    frequent tokens that urls have in common.
    """
    spark = labelled.sparkSession
    rows = labelled.where("blocked is not null and url is not null").select(tokens(F.col("url")).alias("tokens"), F.when(F.col("blocked"), BLOCK).otherwise(ALLOW).alias("label"))
    rows = stored(rows.where(F.size("tokens") > 0).withColumn("row", F.monotonically_increasing_id()), "url-tokens")
    n = rows.count()
    support = max(min_support, min_count / n) if n else 1.0
    empty = spark.createDataFrame([], "rule_id long, antecedent array<string>, verdict string, confidence double, support double, key string")
    if n < min_count:
        return empty
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= support * n)
    kept = rows.select("row", "label", F.explode("tokens").alias("token")).join(counts, "token")
    items = kept.groupBy("row", "label").agg(F.collect_list("token").alias("t"))
    items = items.select(F.concat(F.col("t"), F.array("label")).alias("items"))
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(items).associationRules
    found = found.where(F.size("consequent") == 1).select("antecedent", F.col("consequent")[0].alias("label"), "confidence", "support", "lift")
    found = found.where((F.col("lift") >= min_lift) & F.col("label").isin(BLOCK, ALLOW) & ~F.exists("antecedent", lambda x: x.startswith(LABEL)))
    found = found.select(F.array_sort("antecedent").alias("antecedent"), F.regexp_replace("label", LABEL, "").alias("verdict"), "confidence", "support")
    found = stored(found.withColumn("rule_id", F.xxhash64("antecedent", "verdict")), "url-rules")
    parts = found.select("rule_id", "antecedent", "verdict", "confidence", F.explode("antecedent").alias("token"))
    short = found.select(F.col("rule_id").alias("s_id"), F.col("antecedent").alias("s_ante"), F.col("verdict").alias("s_verdict"), F.col("confidence").alias("s_conf"))
    short = short.join(counts.withColumnRenamed("token", "s_key"), F.array_contains("s_ante", F.col("s_key"))).groupBy("s_id").agg(F.first("s_ante").alias("s_ante"), F.first("s_verdict").alias("s_verdict"), F.first("s_conf").alias("s_conf"), F.min_by("s_key", F.struct("count", "s_key")).alias("token"))
    short = stored(short, "url-rules-keyed")
    covered = parts.join(short, "token").where((F.size("s_ante") < F.size("antecedent")) & (F.col("s_verdict") == F.col("verdict")) & (F.col("s_conf") >= F.col("confidence")) & (F.size(F.array_except("s_ante", "antecedent")) == 0)).select("rule_id").distinct()
    keyed = short.select(F.col("s_id").alias("rule_id"), F.col("token").alias("key"))
    return found.join(covered, "rule_id", "left_anti").join(keyed, "rule_id")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, mined_verdict, mined_rule, confidence) of each distinct url that a mined rule meets; the most confident rule decides, then the longer, then the one first by id."""
    u = urls.select("url").where(F.col("url").isNotNull()).distinct().withColumn("tokens", tokens(F.col("url")))
    hits = u.select("url", "tokens", F.explode("tokens").alias("key")).join(rules, "key")
    hits = hits.where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = F.max(F.struct("confidence", F.size("antecedent").alias("n"), "rule_id", "verdict", F.array_join("antecedent", " ").alias("text"))).alias("b")
    return hits.groupBy("url").agg(best).select("url", F.col("b.verdict").alias("mined_verdict"), F.col("b.text").alias("mined_rule"), F.col("b.confidence").alias("confidence"))


def judge_urls(pages: DataFrame, mined: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for every page."""
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    j = p.join(match(pages, mined), "url", "left")
    return j.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("mined_verdict"), F.lit("allow")).alias("verdict"), "mined_rule", "confidence")


#: Characters that a block of text must have to tell whose text a page shows.
BLOCK_CHARS = 20


def _blocks(text: Column) -> Column:
    """Hashes and lengths of a text's lines, blanks aside; short ones are left out."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")))
    return F.transform(F.array_distinct(F.filter(lines, lambda x: F.length(x) >= BLOCK_CHARS)), lambda x: F.struct(F.xxhash64(x).alias("h"), F.length(x).alias("n")))


def html_text(html: Column) -> Column:
    """The text of a page, a line for each element."""
    return F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", "\n"), r"(?s)<[^>]*>", "\n")


def labelled_by_content(pages: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(url, blocked) of the pages that show labelled documents' text: at least half of a page's lines, by characters, must be known.

    A document is bad if a label of it says poor or toxic. A line counts as bad by the share of its documents that are, and a page by
    the mean over its known lines. Only line hashes are moved, each line of the documents as one row.
    """
    marks = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("bad"))
    lines = docs.select("doc_id", "text").join(bounded(marks), "doc_id").select("bad", F.explode(_blocks(F.col("text"))).alias("b"))
    lines = lines.groupBy(F.col("b.h").alias("h")).agg(F.avg(F.col("bad").cast("int")).alias("bad"))
    shown = pages.select(row_key("page_id", "url").alias("rk"), "url", F.explode(_blocks(html_text(F.col("html")))).alias("b")).select("rk", "url", "b.h", "b.n")
    found = shown.join(lines, "h", "left").groupBy("rk", "url")
    known = F.when(F.col("bad").isNotNull(), F.col("n"))
    found = found.agg(F.sum("n").alias("all"), F.sum(known).alias("known"), (F.sum(F.col("bad") * F.col("n")) / F.sum(known)).alias("share"))
    return found.where(F.col("known") * 2 >= F.col("all")).select("url", (F.col("share") >= 0.5).alias("blocked"))


def url_filter(spark: SparkSession, pages: DataFrame, labels: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Rules are mined from labelled pages and decide where no fixed rule does.

    A page's label is the verdict of the fixed rules where one fits, which makes the mined rules carry those decisions on to hosts
    that the list doesn't know; else, where documents are given, that of the labelled documents whose text it shows.
    """
    host, path = host_path(F.col("url"))
    named = pages.withColumns({"host": host, "path": path}) if not {"host", "path"} & {c.lower() for c in pages.columns} else pages.select(*[c for c in pages.columns if c.lower() not in ("host", "path")], host.alias("host"), path.alias("path"))
    _, verdict = fixed_rule(F.col("host"), F.col("path"))
    judged = named.select("page_id", "url", *(["html"] if docs is not None else []), verdict.alias("fixed"))
    labelled = judged.where("fixed is not null").select("url", (F.col("fixed") == "block").alias("blocked"))
    if docs is not None:
        labelled = labelled.unionByName(labelled_by_content(judged.where("fixed is null"), docs, labels))
    return judge_urls(pages, mine(labelled))
