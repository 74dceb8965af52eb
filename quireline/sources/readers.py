"""Sources: whole texts, pairs of files, JSON and CSV tables, registries, id lists, question batches and page units."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import safe_bool, strip


def listing(spark: SparkSession, *globs: str) -> DataFrame:
    """Distinct files of several patterns, without their contents."""
    df = spark.read.format("binaryFile").load(list(globs)).select("path", F.col("length").alias("bytes"), "modificationTime")
    return df.dropDuplicates(["path"])


def pairs(files: DataFrame) -> DataFrame:
    """Each pdf with the tex, else the txt, of the same stem and folder."""
    f = files.select("path", F.regexp_extract("path", r"^(.*)\.[^./]+$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"))
    g = f.groupBy("stem").agg(*[F.max(F.when(F.col("ext") == e, F.col("path"))).alias(e) for e in ("pdf", "tex", "txt")])
    return g.where(F.col("pdf").isNotNull()).select("stem", "pdf", F.coalesce("tex", "txt").alias("text_path")).where(F.col("text_path").isNotNull())


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): bytes that are no UTF-8 are dropped."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", _lenient(F.col("content")).alias("text"))


def _lenient(c: Column) -> Column:
    """Valid UTF-8 is taken as it is; other bytes lose what can't be read."""
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.replace(F.make_valid_utf8(c.cast("string")), F.lit("�"), F.lit("")))


def json_table(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """Tolerant JSON: what can't be read is null."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "PERMISSIVE").json(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Bad lines and lines that are no objects are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Every column a string; a byte-order mark goes from the first name."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


REGISTRY = ("book_id", "title", "path", "overview", "quality_label", "quality_score", "chapter_count", "section_count", "summarised", "usable", "updated_at", "notes")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated rows of twelve columns; comment rows and short ones are dropped."""
    raw = spark.read.text(path).where(~F.col("value").startswith("#"))
    parts = raw.select(F.split("value", "\t", -1).alias("p")).where(F.size("p") >= len(REGISTRY))
    cols = [F.col("p")[i].alias(c) for i, c in enumerate(REGISTRY)]
    df = parts.select(*cols).where(F.col("book_id").rlike("^[0-9]+$"))
    return df.withColumns({"book_id": F.col("book_id").cast("long"), "quality_score": F.col("quality_score").try_cast("double"), "chapter_count": F.col("chapter_count").try_cast("int"), "section_count": F.col("section_count").try_cast("int"), "summarised": safe_bool(F.col("summarised")), "usable": safe_bool(F.col("usable"))})


def registry_meta(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of the registry's head."""
    m = spark.read.text(path).where(F.col("value").rlike("^#[^:]+:"))
    return m.select(F.trim(F.regexp_extract("value", "^#([^:]+):", 1)).alias("key"), F.trim(F.regexp_extract("value", "^#[^:]+:(.*)$", 1)).alias("value"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, pos): distinct ids of a file in order of their first place; comments and blanks don't count."""
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    ids = raw.select(strip(F.regexp_replace("line", "#.*$", "")).alias("id"), "pos").where("id <> ''")
    return ids.groupBy("id").agg(F.min("pos").alias("pos"))


def question_blocks(md: DataFrame, text: str = "text", tag: str = "q0") -> DataFrame:
    """Fenced blocks in order, each with the nearest heading before it, else Q01, Q02, ... by its place.

    Works line by line: a heading's and a fence's state at a line is what the last such line before it says.
    """
    lines = md.select(*[c for c in md.columns if c != text], F.posexplode(F.split(text, r"\r?\n")).alias("at", "line"))
    keys = [c for c in md.columns if c != text]
    w = Window.partitionBy(*keys).orderBy("at")
    opens, closes = F.trim("line") == f"```{tag}", F.trim("line") == "```"
    mark = F.when(opens, 1).when(closes, 0)
    heading = F.when(F.col("line").rlike(r"^#{1,6}\s"), strip(F.regexp_replace("line", r"^#+\s*", "")))
    state = lines.withColumn("inside", F.last(mark, True).over(w)).withColumn("heading", F.last(F.when(F.coalesce(F.last(mark, True).over(w), F.lit(0)) == 0, heading), True).over(w)).withColumn("block", F.sum(opens.cast("int")).over(w))
    body = state.where((F.col("inside") == 1) & ~opens)
    out = body.groupBy(*keys, "block").agg(F.first("heading").alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("question"))
    named = F.split(F.col("heading"), r"[｜|]", 2)
    qid = F.coalesce(F.nullif(strip(named[0]), F.lit("")), F.format_string("Q%02d", "block"))
    return out.select(*keys, F.col("block").cast("int").alias("idx"), qid.alias("qid"), strip(F.coalesce(F.try_element_at(named, F.lit(2)), F.lit(""))).alias("title"), strip(F.col("question")).alias("question"))


def page_units(pages: DataFrame, page: str = "page", two_up: str = "two_up") -> DataFrame:
    """A page of a two-up layout is two units, left and right."""
    sides = F.when(F.col(two_up), F.array(F.lit("L"), F.lit("R"))).otherwise(F.array(F.lit("")))
    return pages.select("*", F.posexplode(sides).alias("__i", "side")).withColumn("unit", F.when(F.col(two_up), F.col(page) * 2 + F.col("__i")).otherwise(F.col(page))).drop("__i")


def layout(pages: DataFrame, book: str = "book", width: str = "width", height: str = "height", ratio: float = 1.15, share: float = 0.6) -> DataFrame:
    """Two-up where the median page is broad, or enough pages are."""
    r = F.col(width) / F.col(height)
    return pages.groupBy(book).agg(F.median(r).alias("aspect"), F.avg((r >= ratio).cast("double")).alias("broad")).withColumn("two_up", (F.col("aspect") >= ratio) | (F.col("broad") >= share))


def unit_text(c: Column, region: str) -> Column:
    """A region of a page's text by share of its lines: top (first quarter), bottom (last), body (between) or full."""
    ls = F.split(F.coalesce(c, F.lit("")), r"\r?\n")
    q = F.greatest(F.lit(1), F.ceil(F.size(ls) / 4).cast("int"))
    parts = {"full": ls, "top": F.slice(ls, F.lit(1), q), "bottom": F.slice(ls, F.greatest(F.lit(1), F.size(ls) - q + 1), q), "body": F.slice(ls, q + 1, F.greatest(F.lit(0), F.size(ls) - 2 * q))}
    return F.array_join(parts[region], "\n")


def env_keys(prefix: str, n: int, env: dict[str, str] | None = None) -> list[str]:
    """Values of numbered settings, from 0 if number 0 is set, else from 1."""
    env = dict(os.environ) if env is None else env
    first = 0 if env.get(f"{prefix}0") else 1
    return [v for i in range(first, first + n) if (v := env.get(f"{prefix}{i}"))]


def with_defaults(given: dict, defaults: dict) -> dict:
    """Missing keys are filled at every level; what is given stays, nulls and falsy values included."""
    out = dict(given)
    for k, v in defaults.items():
        out[k] = with_defaults(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else out.get(k, v) if k in out else v
    return out


def section_text(sections: DataFrame, key: list[str], *strategies: tuple[DataFrame, str]) -> DataFrame:
    """The first of several sources that has a non-empty text for the key."""
    df = sections
    for i, (src, c) in enumerate(strategies):
        df = df.join(src.select(*key, F.nullif(strip(F.col(c)), F.lit("")).alias(f"__t{i}")), key, "left")
    names = [f"__t{i}" for i in range(len(strategies))]
    return df.withColumn("section_text", F.coalesce(*names)).drop(*names)


RESULT = T.StructType([T.StructField(n, t) for n, t in (("qid", T.StringType()), ("title", T.StringType()), ("status", T.StringType()), ("mode", T.StringType()), ("duration_sec", T.DoubleType()))])


def batch_context(spark: SparkSession, folder: str) -> DataFrame:
    """A batch's questions with the results of its summary."""
    q = spark.read.schema("idx int, qid string, title string, question string").option("multiLine", True).json(f"{folder}/parsed_questions.json")
    s = spark.read.schema(T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("results", T.ArrayType(RESULT))])).option("multiLine", True).json(f"{folder}/batch_summary.json")
    r = s.select("batch_id", F.explode("results").alias("r")).select("batch_id", F.col("r.qid").alias("qid"), "r.status", "r.mode", "r.duration_sec")
    return q.join(r, "qid", "left")
