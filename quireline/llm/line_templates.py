"""Line deduplication with a fixed-depth log-template tree, DataFrame functions only.

A line goes down the tree by its number of tokens and its leading tokens; tokens
with digits count as variable fields from the start. In a leaf that holds
several templates, positions where no token prevails become variable too, and
templates that differ from that pattern in few places (a share, and most_variable at
most, since prose with many other words is another text) are merged into it. A template that
recurs in enough unrelated documents is dropped from all of them.

Unrelated: copies of one document share all their lines, and dropping those
would leave none of it. So documents of a template that agree in the place of the
line (its index, their number of lines and the lengths of the lines before and
after it) or in what else they hold form one group, and so do groups that share a
document. A template recurs if there are min_docs groups, however many documents
one of them has. Copies are left to document-level deduplication.

What else they hold is told by a line's sign, the hash of its template's leading
tokens, which edits further on leave as it is. If more than one in OWN tokens of a
document stands in lines whose signs are in fewer than min_docs documents, the least
of these signs counts, so that lines which recur together do not make their
documents look alike; else (copies, or little but recurring lines) the least and the
greatest sign of all lines do, and those by a second hash, each if it is not the
line's own. Blank lines and lines that do not take part
have no sign.

Copies whose other lines are edited at the front and in length look unrelated, and
a group of thousands holds many of those. So documents with less than half their
tokens, or fewer than OWN_LINES lines, of their own count only where they form at least a third as many groups as they
are documents; otherwise all of them count as one.

Defined results: a null text stays null, an empty one empty; lines of fewer than
min_tokens tokens stay unless their templates have min_chars characters besides the
variable fields (scripts without blanks), and in those only the digits are variable; rows that repeat an id and text count as one
document and are treated alike; ids may be null; columns other than the text
are carried through; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, quoted, row_key, scratch, stored
from .ngram_join import components

BLANKS = r"[\x20\x09-\x0D]+"
#: A document has text of its own if that is more than this part of it, and surely so if it is more than that part in so many lines.
OWN, SURE, OWN_LINES = 4, 2, 3
#: Other documents count if their groups are more than this part of them.
APART = 3


def _blanks(c: Column) -> Column:
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))


def _lines(docs: DataFrame, depth: int, min_tokens: int, min_chars: int) -> DataFrame:
    """(rk, at, n, place, leaf, th, sign, tpl) of the lines that take part.

    n: tokens; tpl: tokens joined by blanks, variable ones as <*>; th: its hash; sign: that of its leading tokens; place: a hash
    of the line's index, the document's number of lines and the tokens of the lines before and after.
    """
    texts = docs.select(row_key("doc_id", "text").alias("rk"), F.split("text", "\n", -1).alias("all")).where("text is not null")
    texts = texts.withColumn("sizes", F.transform("all", _blanks)).select("rk", F.size("all").alias("count"), "sizes", F.posexplode("all").alias("at", "line"))
    beside = [F.get("sizes", F.col("at") + k) for k in (-1, 0, 1)]
    lines = texts.select("rk", "at", "line", beside[1].alias("blanks"), F.xxhash64("at", "count", F.coalesce(beside[0], F.lit(-1)), F.coalesce(beside[2], F.lit(-1))).alias("place"))
    line = F.col("line")
    odd = F.contains(line, F.lit("  ")) | line.startswith(" ") | line.endswith(" ")
    for c in "\t\x0b\x0c\r":
        odd = odd | F.contains(line, F.lit(c))
    lines = lines.withColumn("odd", odd).withColumn("flat", F.when(F.col("odd"), F.trim(F.regexp_replace("line", BLANKS, " "))).otherwise(line))
    lines = lines.withColumn("n", F.when(F.col("flat") == "", 0).otherwise(F.when(F.col("odd"), _blanks(F.col("flat"))).otherwise(F.col("blanks")) + 1))
    variable = F.when(F.col("n") < min_tokens, F.regexp_replace("flat", "[0-9]+", "<*>")).otherwise(F.regexp_replace("flat", r"[^ ]*[0-9][^ ]*", "<*>"))
    # the partition's number keeps the condition below from being pushed under the templates, which would be worked out twice
    lines = lines.withColumn("tpl", F.when(line.rlike("[0-9]"), variable).otherwise(F.col("flat"))).withColumn("part", F.spark_partition_id())
    takes_part = (F.col("n") >= min_tokens) | (F.length(F.replace("tpl", F.lit("<*>"), F.lit(""))) >= min_chars)
    lead = F.substring_index("tpl", " ", depth)
    return lines.where(takes_part & (F.col("part") >= 0)).select("rk", "at", "n", "place", F.xxhash64("n", lead).alias("leaf"), F.xxhash64("tpl", "n").alias("th"), F.xxhash64(lead).alias("sign"), "tpl")


def _unrelated(one: DataFrame, docs: DataFrame, keys: list[str], min_docs: int) -> DataFrame:
    """The keys whose documents form min_docs groups or more, linked by an equal place or an equal beside; a document can have several rows.

    Groups are counted apart for sure documents and others. Places are joined to the least place with the same beside. Each such
    link takes away one group at most, so counting settles most keys; components are worked out for the links of the others only.
    """
    own = [*keys, "sure"]
    held = stored(one.select(*own, F.col("place").alias("p"), F.coalesce("beside", F.lit(0)).alias("b")).distinct(), "line-places")
    places = held.select(*own, "p").distinct().groupBy(*own).agg(F.count("*").alias("places"))
    wide = held.groupBy(*own, "b").agg(F.min("p").alias("m"), F.max("p").alias("x")).where("m <> x").drop("x")
    links = stored(held.join(wide, [*own, "b"]).where("p <> m").select(*own, "p", "m").distinct(), "line-place-links")
    bounds = places.join(docs, own).join(links.groupBy(*own).agg(F.count("*").alias("links")), own, "left").fillna(0, ["links"])
    bounds = stored(bounds.withColumn("groups", F.col("places") - F.col("links")), "line-groups")
    counts = F.col("sure") | (F.col("groups") * APART >= F.col("docs"))
    settled = bounds.where(counts & (F.col("groups") >= min_docs)).select(*keys).distinct()
    rest = stored(bounds.join(bounded(stored(settled, "line-settled")), keys, "left_anti"), "line-unsettled")
    node = lambda c: F.xxhash64(*own, c)
    open_links = stored(links.join(rest.select(*own), own).select(*own, node("p").alias("a"), node("m").alias("b")), "line-open-links")
    nodes = open_links.select(*own, F.explode(F.array("a", "b")).alias("node")).distinct()
    comp = nodes.join(components(nodes.select("node"), open_links), "node")
    less = comp.groupBy(*own).agg((F.count("*") - F.count_distinct("comp")).alias("less"))
    groups = rest.drop("groups").join(less, own, "left").withColumn("groups", F.col("places") - F.coalesce("less", F.lit(0)))
    found = groups.groupBy(*keys).agg(F.sum(F.when(counts, F.col("groups")).otherwise(F.least(F.col("groups"), F.lit(1)))).alias("groups")).where(F.col("groups") >= min_docs)
    return settled.unionByName(found.select(*keys))


def recurring(lines: DataFrame, min_docs: int, similarity: float, most_variable: int) -> DataFrame:
    """(rk, drop): the indexes of each document's lines whose template recurs."""
    docs_of = lines.select("leaf", "th", "rk").distinct()
    sizes = docs_of.groupBy("leaf", "th").agg(F.count("*").alias("docs"))
    busy = stored(sizes.groupBy("leaf").agg(F.count("*").alias("kinds"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs), "line-leaves")
    mixed = busy.where("kinds > 1").select("leaf")
    split = stored(lines.select("leaf", "th", "tpl").join(bounded(mixed), "leaf").groupBy("leaf", "th").agg(F.first("tpl").alias("tpl")), "line-templates")
    cells = split.select("leaf", F.posexplode(F.split("tpl", " ")).alias("at", "token")).groupBy("leaf", "at", "token").agg(F.count("*").alias("c"))
    column = cells.groupBy("leaf", "at").agg(F.max_by("token", F.struct("c", "token")).alias("token"), F.max("c").alias("most"), F.sum("c").alias("all"))
    column = column.select("leaf", "at", F.when((F.col("most") > 1) & (F.col("most") * 2 >= F.col("all")), F.col("token")).otherwise("<*>").alias("token"))
    pattern = bounded(stored(column.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("at", "token")))["token"].alias("pattern")), "line-patterns"))
    alike = F.size(F.filter(F.zip_with(F.split("tpl", " "), "pattern", lambda a, b: (a == b) & (b != "<*>")), lambda x: x))
    merged = split.join(pattern, "leaf").where((alike >= similarity * F.size("pattern")) & (F.size("pattern") - alike <= most_variable)).select("leaf", "th", F.xxhash64("leaf", "pattern").alias("merged"))
    kept = lines.drop("tpl").join(bounded(busy.select("leaf")), "leaf").join(bounded(stored(merged, "line-merged")), ["leaf", "th"], "left")
    kept = stored(kept.select("rk", "at", "place", "leaf", "sign", F.coalesce("merged", "th").alias("template")), "line-candidates")
    keys = ["leaf", "template"]
    one = kept.groupBy(*keys, "rk").agg(F.min("place").alias("place"), F.min("sign").alias("sign"))
    often = stored(one.groupBy(*keys).agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs).select(*keys), "line-often")
    known = lines.select("sign", "rk").distinct().groupBy("sign").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    known = stored(known.select("sign", F.lit(True).alias("known")), "line-signs")
    rare = F.col("known").isNull()
    held = lines.join(bounded(known), "sign", "left").groupBy("rk").agg(F.sum("n").alias("tokens"), F.sum(F.when(rare, F.col("n")).otherwise(0)).alias("own"), F.count_if(rare).alias("own_lines"), F.min(F.when(rare, F.col("sign"))).alias("rarest"), *[f(c).alias(f"s{i}") for i, (f, c) in enumerate((f, c) for f in (F.min, F.max) for c in ("sign", F.xxhash64("sign")))])
    others = F.array_union(F.array_except(F.array("s0", "s2"), F.array("sign")), F.array_except(F.array("s1", "s3"), F.array(F.xxhash64("sign"))))
    mostly_own = F.col("own") * OWN > F.col("tokens")
    one = one.join(bounded(often), keys).join(held, "rk").withColumn("sure", (F.col("own") * SURE > F.col("tokens")) & (F.col("own_lines") >= OWN_LINES))
    docs = one.groupBy(*keys, "sure").agg(F.count("*").alias("docs"))
    beside = F.when(mostly_own, F.array("rarest")).otherwise(others)
    found = _unrelated(one.select(*keys, "sure", "place", F.explode_outer(beside).alias("beside")), docs, keys, min_docs)
    return kept.join(bounded(stored(found, "line-found")), keys).groupBy("rk").agg(F.collect_set("at").alias("drop"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 3, min_tokens: int = 4, depth: int = 3, similarity: float = 0.7, min_chars: int = 20, most_variable: int = 3) -> DataFrame:
    """docs without the recurring lines, plus n_lines and n_dropped (own columns of these names are replaced)."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    d = docs.select(*map(quoted, own))
    key, drop = fresh(d, "rk"), fresh(d, "drop")
    with scratch(docs.sparkSession) as keep:
        lines = stored(_lines(d, depth, min_tokens, min_chars), "lines")
        drops = keep(stored(recurring(lines, min_docs, similarity, most_variable), "line-drops"))
    out = d.withColumn(key, row_key("doc_id", "text")).join(bounded(drops.toDF(key, drop)), key, "left")
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(drop, i)), "\n")
    cols = [F.when(F.col(drop).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else quoted(c) for c in own]
    n = F.when(F.col("text").isNull() | (F.col("text") == ""), 0).otherwise(F.size(parts))
    return out.select(*cols, n.cast("long").alias("n_lines"), F.coalesce(F.size(drop), F.lit(0)).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame) -> DataFrame:
    return drop_recurring_lines(docs.select("doc_id", "text"))
