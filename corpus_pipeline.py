"""Corpus pipeline: language, lines, near duplicates, benchmark leaks, mixture.

Each stage reads what the one before it kept, as Parquet in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireline.llm import decontaminate, langid, line_templates, mixing, ngram_join
from quireline.llm.common import fresh, quoted, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _aside(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """docs with own columns of these names renamed, and how to name them back: a stage's operator replaces such columns."""
    moved: dict[str, str] = {}
    for c in docs.columns:
        if c.lower() in names:
            new = fresh(docs, f"own_{c}")
            docs, moved[new] = docs.withColumnRenamed(c, new), c
    return docs, moved


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null or empty text, no letter) and those whose two best languages are too close.

    Repeated rows are judged alike; ties of languages go to the smaller name and are too close; own columns stay, whatever their names.
    """
    rest, moved = _aside(docs, langid.NEW)
    found = langid.identify(rest, langid.learn(docs))
    kept = found.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).drop(*langid.NEW)
    return kept.withColumnsRenamed(moved).select(*map(quoted, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines out of the texts; a document that held nothing else goes. n_chars follows the text.

    Null and empty texts stay as they are, repeated rows are treated alike, own columns stay whatever their names.
    """
    rest, moved = _aside(docs, ("n_lines", "n_dropped"))
    found = line_templates.drop_recurring_lines(rest)
    kept = found.where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.drop("n_lines", "n_dropped").withColumnsRenamed(moved).select(*map(quoted, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are linked by a Jaccard similarity of 0.8 or more on five-word shingles.

    That of the least id; texts without words stay, and so do rows that repeat the kept row's id and text.
    """
    return ngram_join.one_of_each(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; texts without words hold none, and repeated rows go or stay together."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's domain probabilities, tokens, rate, and whether the rates reach the targets.

    A null or empty text has no tokens; repeated rows get the same rate; own columns of the added names are replaced.
    """
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES: list[tuple[str, Stage]] = [("language_id", language), ("line_dedup", lines), ("ngram_join", near_copies), ("decontaminate", leaks), ("mixing", mixture)]

#: The stages' models and sketches are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
