"""Benchmark decontamination by size-partitioned MinHash containment search, DataFrame functions only.

Test items are short and documents long, so what counts is containment: the
share of an item's distinct five-word shingles that a document holds. Items are
partitioned by size (powers of two of their shingle count), and every item
keeps a MinHash sketch: its smallest shingle hashes, as many as its partition
needs for a document with the asked containment to be unable to miss them all.
Documents look up all their shingles' hashes in the sketches, provided that they
have enough shingles for the item's size. What holds enough of a sketch is a
candidate, verified by exact containment on the shingles themselves.

Words are runs of letters and digits of the lower-cased text. Texts of fewer
than five words have one shingle, the whole sequence, so that an item that short
is only found in a document that is nothing else.

Defined results: null and empty texts, and texts without words, match nothing;
rows of documents that repeat an id and text give one row; items with the same
text are each reported; null ids are carried; extra columns are ignored; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, fresh, row_key, scratch, stored

WORDS = 5
#: Containment in percent.
LEAST = 80


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _spots(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each shingle: keep, w, and the index i where it starts. What follows stays in one generated loop.

    The condition that drops texts without words names i, so it can't be pushed below, where w would be worked out twice.
    """
    spots = df.select(*keep, "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - WORDS, F.lit(0)))).alias("i"))
    return spots.where(F.get("w", F.col("i")).isNotNull())


def _parts() -> list[Column]:
    return [F.get("w", F.col("i") + j) for j in range(WORDS)]


def sketches(items: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(item_id, s, n): all shingles; (h, item_id, part, need, least_doc): those of the sketches.

    An item of n shingles may miss n - ceil(n*least/100) of them. Its partition's bound u >= n gives the
    sketch's size, floor(u*(100-least)/100) + 1; need is how many of them a match must still hold.
    """
    w = items.select("item_id", words(F.col("text")).alias("w"))
    s = _spots(w, "item_id").select("item_id", F.concat_ws(" ", *_parts()).alias("s"), F.xxhash64(*_parts()).alias("h")).distinct()
    n = s.groupBy("item_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("h")).alias("hs"))
    part = F.floor(F.log2("n")).cast("int")
    size = F.least(F.floor((F.pow(F.lit(2), F.col("part") + 1) - 1) * (100 - least) / 100).cast("int") + 1, F.size("hs"))
    must = F.ceil(F.col("n") * least / 100).cast("int")
    sketch = n.withColumn("part", part).withColumn("must", must).withColumn("sketch", F.slice("hs", F.lit(1), size))
    rows = sketch.select("item_id", "part", F.greatest(F.lit(1), F.size("sketch") - (F.col("n").cast("int") - F.col("must"))).alias("need"), F.col("must").alias("least_doc"), F.explode("sketch").alias("h"))
    return stored(s.join(n.select("item_id", "n"), "item_id").drop("h"), "item-shingles"), stored(rows, "item-sketches")


def contaminated(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """(rk, doc_id, item_id, n_item, n_shared, containment) for each document and item that it holds; rk is the row's key."""
    shingles, sketch = sketches(items, least)
    base = docs.select(row_key("doc_id", "text").alias("rk"), "doc_id", "text")
    spots = _spots(base.select("rk", words(F.col("text")).alias("w")), "rk")
    probes = spots.select("rk", F.xxhash64(*_parts()).alias("h"), F.greatest(F.size("w") - WORDS + 1, F.lit(1)).alias("n_doc"))
    hits = probes.join(bounded(sketch), "h").where(F.col("n_doc") >= F.col("least_doc"))
    candidates = hits.groupBy("rk", "item_id", "need", "h").count().groupBy("rk", "item_id", "need").count().where(F.col("count") >= F.col("need"))
    candidates = stored(candidates.select("rk", "item_id"), "contamination-candidates")
    found = base.join(bounded(candidates.select("rk").distinct()), "rk").dropDuplicates(["rk"])
    exact = _spots(found.select("rk", "doc_id", words(F.col("text")).alias("w")), "rk", "doc_id").select("rk", "doc_id", F.concat_ws(" ", *_parts()).alias("s"))
    held = exact.join(bounded(shingles), "s").select("rk", "doc_id", "item_id", "n", "s").distinct().groupBy("rk", "doc_id", "item_id", "n").agg(F.count("*").alias("n_shared"))
    held = held.join(candidates, ["rk", "item_id"], "left_semi").where(F.col("n_shared") * 100 >= F.col("n") * least)
    return held.select("rk", "doc_id", "item_id", F.col("n").alias("n_item"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, least: int = LEAST) -> DataFrame:
    """The documents that hold no item, with their columns."""
    key = fresh(docs, "rk")
    with scratch(docs.sparkSession) as keep:
        bad = keep(stored(contaminated(docs, items, least).select(F.col("rk").alias(key)).distinct(), "contaminated"))
    return docs.withColumn(key, row_key("doc_id", "text")).join(bounded(bad), key, "left_anti").drop(key)


def find_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    return contaminated(docs, items).drop("rk")
