"""Sinks: flat CSV, JSON lines, Markdown reports, registries and split texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import safe_filename


def flat(df: DataFrame, first: list[str] | None = None) -> DataFrame:
    """Preferred columns first, lists and maps as JSON, null as an empty text."""
    order = [c for c in first or [] if c in df.columns] + [c for c in df.columns if c not in (first or [])]
    kinds = dict(df.dtypes)
    nested = lambda c: kinds[c].startswith(("array", "map", "struct"))
    return df.select(*[F.coalesce(F.to_json(F.col(c)) if nested(c) else F.col(c).cast("string"), F.lit("")).alias(c) for c in order])


def write_csv(df: DataFrame, path: str, first: list[str] | None = None, order: str | None = None) -> None:
    out = flat(df.orderBy(order) if order else df, first)
    out.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_table(df: DataFrame, order: list[str]) -> DataFrame:
    """One row with a table of at most a few summary rows; numbers have three decimals."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.3f", F.col(c))) if kinds[c] in ("double", "float") else F.col(c).cast("string"), F.lit(""))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in df.columns]), F.lit(" |"))
    head = f"| {' | '.join(df.columns)} |\n|{'|'.join(' --- ' for _ in df.columns)}|\n"
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, row.alias("__row")))), lambda x: x["__row"])
    return df.agg(F.concat(F.lit(head), F.array_join(lines, "\n")).alias("markdown"))


def report_sections(df: DataFrame, key: str, parts: list[tuple[str, str]]) -> DataFrame:
    """A Markdown section a question: each filled part under its heading."""
    shown = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"### {title}\n\n"), F.replace(F.col(c), F.lit("```"), F.lit("` ` `")))) for title, c in parts]
    return df.select(key, F.concat(F.lit("## "), F.col(key).cast("string"), F.lit("\n\n"), F.concat_ws("\n\n", *shown)).alias("section"))


def question_markdown(df: DataFrame, tag: str = "q0") -> DataFrame:
    """The inverse of reading question blocks: one row with all of them in order."""
    block = F.format_string(f"## %s｜%s\n\n```{tag}\n%s\n```", "qid", "title", "question")
    return df.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("markdown"))


def registry_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Tab-separated rows, flags as 0 and 1, tabs and line ends as blanks."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.coalesce(F.col(c).cast("int").cast("string") if kinds[c] == "boolean" else F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " "), F.lit(""))
    return df.select(F.concat_ws("\t", *[cell(c) for c in columns]).alias("value"))


def notes(*flags: tuple[str, Column]) -> Column:
    """Names of the flags that hold, joined by semicolons."""
    return F.concat_ws(";", *[F.when(cond, F.lit(name)) for name, cond in flags])


def split_texts(segments: DataFrame, no: str = "no", title: str = "title") -> DataFrame:
    """File names NN_title.txt for segments; a title without usable characters becomes its hash."""
    name = safe_filename(F.col(title), 60)
    return segments.withColumn("file_name", F.concat(F.lpad(F.col(no).cast("string"), 2, "0"), F.lit("_"), F.when(name.rlike(r"[\p{L}\p{N}]"), name).otherwise(F.left(F.sha1(F.coalesce(F.col(title), F.lit(""))), F.lit(8))), F.lit(".txt")))


def marked_text(segments: DataFrame, by: list[str], order: str, title: str, text: str) -> DataFrame:
    """One text a book with a marker line before each chapter."""
    part = F.concat(F.lit("===== CHAPTER "), F.col(order).cast("string"), F.lit(": "), F.coalesce(F.col(title), F.lit("")), F.lit(" =====\n"), F.col(text))
    return segments.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part.alias("p")))), lambda x: x["p"]), "\n").alias("marked"))


def catalog_json(books: DataFrame, chapters: DataFrame, sections: DataFrame) -> DataFrame:
    """One nested JSON object a book: chapters, and their sections, in order."""
    s = sections.groupBy("book_id", "chapter_no").agg(F.array_sort(F.collect_list(F.struct("section_id", "title"))).alias("sections"))
    c = chapters.join(s, ["book_id", "chapter_no"], "left").groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_no", "chapter_title", F.coalesce("sections", F.array().cast("array<struct<section_id:bigint,title:string>>")).alias("sections")))).alias("chapters"))
    return books.join(c, "book_id", "left").select("book_id", F.to_json(F.struct("book_id", "title", "chapters")).alias("catalog"))


def rebased(c: Column, old: str, new: str) -> Column:
    """A path moved from one folder to another; others stay."""
    return F.when(c.startswith(old), F.concat(F.lit(new), F.substring(c, len(old) + 1, 10_000))).otherwise(c)
