"""Titles, answer sections, mode lists and checks of a parsed table of contents, as Column expressions and group aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import heading_number, normalise_key, squeeze, strip
from . import quality as Q

# Section headings of an answer, modes and their order, chapter headings, and words that end a book's body.
REASONING_MARK, FINAL_MARK = r"【\s*解题思路.*?】", r"【\s*最终答案\s*】"
MODES = tuple(f"M{i}" for i in range(1, 10))
MODE_ORDER = ("M2", "M4", "M3", "M5", "M1", "M9", "M6", "M7", "M8")
ALL_MODES = ("ALL", "M1-M8", "M1–M8", "M1~M8", "M1-M9", "M1–M9", "M1~M9")
TEX_HEADINGS = (r"\\chapter\*?\{", r"\\section\*?\{", r"\\subsection\*?\{", r"\\subsubsection\*?\{", r"\\part\*?\{", r"\\begin\{chapter\}")
TEXT_HEADINGS = (r"(?im)^\s*chapter\s+\d+\b",)
CHAPTER_HINT = r"(?i)\bchapter\b|第\s*[0-9０-９零〇○一二三四五六七八九十百千]+\s*章"
BACK_MATTER = (
    r"\section*{APPENDIX}", r"\chapter{APPENDIX}", r"\section*{BIBLIOGRAPHY}", r"\section*{Bibliography}", r"\section*{REFERENCES}",
    r"\section*{References}", r"\section*{SUBJECT INDEX}", r"\section*{AUTHOR INDEX}", r"\section*{参考文献}", r"\section*{索引}",
)


def answer_sections(c: Column) -> tuple[Column, Column]:
    """the reasoning and the final part; without both headings in order, the whole answer twice."""
    a = strip(c)
    r, f = F.regexp_instr(a, F.lit(REASONING_MARK)), F.regexp_instr(a, F.lit(FINAL_MARK))
    r_end = r + F.length(F.regexp_extract(a, REASONING_MARK, 0))
    f_end = f + F.length(F.regexp_extract(a, FINAL_MARK, 0))
    both = (r > 0) & (f > r_end)
    return F.when(both, strip(F.substring(a, r_end, f - r_end))).otherwise(a), F.when(both, strip(F.substring(a, f_end, F.length(a)))).otherwise(a)


def without_headings(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, REASONING_MARK, ""), FINAL_MARK, ""))


def normalised_answer(c: Column) -> Column:
    """both headings with their parts; a part that is missing is the whole body."""
    a, (r, f) = strip(c), answer_sections(c)
    body = without_headings(a)
    part = lambda x: F.coalesce(F.nullif(without_headings(x), F.lit("")), body)
    return F.when(a == "", f"{Q.REASONING}\n\n{Q.FINAL}").otherwise(strip(F.concat(F.lit(f"{Q.REASONING}\n"), part(r), F.lit(f"\n\n{Q.FINAL}\n"), part(f))))


def chapter_label(book: Column, no: Column, title: Column) -> Column:
    """F20."""
    name = F.coalesce(F.nullif(strip(title), F.lit("")), F.concat(F.lit("chapter "), no.cast("string")))
    return F.concat(F.lit("《"), squeeze(book), F.lit("》第"), no.cast("string"), F.lit("章："), name)


def section_label(chapter: Column, title: Column) -> Column:
    """F20."""
    return F.concat(chapter, F.lit("｜节："), strip(title))


def fence_escaped(c: Column) -> Column:
    """fences broken by a character without width."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("```"), F.lit("`\u200b``"))


def bullet_list(c: Column) -> Column:
    """a line for each entry, or one that says there is none."""
    return F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, "- （空）").otherwise(F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n"))


def positive_ints(c: Column, default: list[int]) -> Column:
    """the positive numbers of a comma-separated list, each once, else the default."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x).try_cast("int"))
    found = F.array_distinct(F.filter(parts, lambda x: x > 0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*[F.lit(x) for x in default]))


def mode_list(c: Column) -> Column:
    """the modes that a list names, each once in its order; a range or ``all`` stands for all."""
    s = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    every = F.array(*[F.lit(m) for m in MODES])
    parts = F.filter(F.transform(F.split(F.replace(s, F.lit(";"), F.lit(",")), ","), lambda x: F.trim(x)), lambda x: x != "")
    named = F.flatten(F.transform(parts, lambda x: F.when(x.isin("M1-M8", "M1–M8", "M1-M9", "M1–M9"), every).when(x.rlike("^M[0-9]+$"), F.array(x)).otherwise(F.array().cast("array<string>"))))
    return F.when(s.isin(*ALL_MODES), every).otherwise(F.array_distinct(named))


def in_stage_order(modes: Column) -> Column:
    """The modes that are asked for, cheap ones first."""
    return F.filter(F.array(*[F.lit(m) for m in MODE_ORDER]), lambda m: F.array_contains(modes, m))


def snapped(text: Column, start: Column, limit: Column | int, tex: bool = False) -> Column:
    """the place of the first heading within limit characters from start; the first pattern that occurs decides. Null if none does."""
    at = F.greatest(start, F.lit(0))
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    sub = F.substring(text, (at + 1).cast("int"), limit.cast("int"))
    found = [F.nullif(F.regexp_instr(sub, F.lit(p)), F.lit(0)) for p in (TEX_HEADINGS if tex else TEXT_HEADINGS)]
    return F.when((limit > 0) & (at < F.length(text)), at + F.coalesce(*found) - 1)


def heading_hint(title: Column, opening: Column, anchors: Column, most: int = 240) -> Column:
    """the first of title, anchors and the opening's first eight lines that reads like a chapter heading, else the title."""
    lines = F.slice(F.split(F.coalesce(opening, F.lit("")), r"\r?\n"), 1, 8)
    candidates = F.concat(F.array(title), F.coalesce(anchors, F.array().cast("array<string>")), lines)
    hits = F.filter(F.transform(candidates, lambda x: strip(x)), lambda x: x.rlike(CHAPTER_HINT))
    return F.left(F.coalesce(F.get(hits, F.lit(0)), strip(title)), F.lit(most))


def usable_title(c: Column) -> Column:
    """Filled, not numbered like a section, not a hash."""
    t = strip(c)
    return (t != "") & ~t.rlike(r"^[0-9]{1,3}\s*[.．。]\s+") & ~t.rlike(r"^[0-9]{1,3}(\s*[.．。]\s*[0-9]{1,3})+") & ~F.lower(t).rlike(r"^[0-9a-f]{8,32}$")


def output_title(segment: Column, tex: Column, pdf: Column, toc: Column) -> Column:
    """The first usable of the segment's, TeX's and the page's heading, else the first that is filled of TeX, page and contents."""
    filled = [F.nullif(strip(c), F.lit("")) for c in (tex, pdf, toc)]
    return F.coalesce(*[F.when(usable_title(c), strip(c)) for c in (segment, tex, pdf)], *filled, F.lit(""))


def back_matter_at(text: Column, start: Column, words: tuple[str, ...] = BACK_MATTER) -> Column:
    """Where the last chapter ends: at the first back-matter heading from its start on, or one that reads so, else at the text's end."""
    import re

    at = F.greatest(start, F.lit(0))
    rest = F.substring(text, (at + 1).cast("int"), F.length(text))
    places = []
    for w in words:
        plain = re.sub(r"\s+", " ", re.sub(r"\\[A-Za-z]+\*?\{", "", w).replace("}", "")).strip()
        exact = F.nullif(F.instr(rest, F.lit(w)), F.lit(0))
        places.append(F.coalesce(exact, F.nullif(F.instr(F.lower(rest), F.lit(plain.lower())), F.lit(0))) if plain else exact)
    return F.coalesce(at + F.array_min(F.array(*places)) - 1, F.length(text))


def micro_fragments(segments: DataFrame, text: str, start: str, end: str, most: int = 6) -> DataFrame:
    """Segments that are empty or hold at most so many characters, with the reason and a preview."""
    piece = F.substring(F.col(text), (F.col(start) + 1).cast("int"), (F.col(end) - F.col(start)).cast("int"))
    empty = F.col(end) <= F.col(start)
    short = segments.withColumn("__s", F.when(empty, F.lit("")).otherwise(strip(piece))).where(F.length("__s") <= most)
    return short.withColumns({"len": F.greatest(F.col(end) - F.col(start), F.lit(0)), "preview": F.replace(F.col("__s"), F.lit("\n"), F.lit("\\n")), "reason": F.when(empty, "empty_segment").otherwise("micro_segment")}).drop("__s")


def contents_verdict(chapters: DataFrame, by: list[str], least: int = 6, most: int = 80, template_most: float = 0.65, paged_least: float = 0.6, span_least: int = 30, first_most: int = 2) -> DataFrame:
    """(by, n, template_ratio, paged_ratio, span, first_no, reason) of parsed tables of contents: the first check that fails, or ok.

    chapters: no and printed_page as texts, title. A chapter's number is that of its column, else of its title.
    """
    page, title = strip(F.col("printed_page")), strip(F.col("title"))
    digits = F.when(page.rlike("^[0-9]{1,4}$"), page.cast("int"))
    no = F.coalesce(F.when(strip(F.col("no")).rlike("^[0-9]+$"), strip(F.col("no")).try_cast("int")), heading_number(title))
    g = chapters.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.when((title == "") | Q.template_title(title), 1.0).otherwise(0.0)).alias("template_ratio"), F.avg(F.when(page != "", 1.0).otherwise(0.0)).alias("paged_ratio"),
        F.when(F.count(digits) >= 3, F.max(digits) - F.min(digits)).alias("span"), F.min(no).alias("first_no"),
    )
    reason = (
        F.when(F.col("n") > most, "too_many_chapters").when(F.col("n") < least, "too_few_chapters").when(F.col("template_ratio") > template_most, "titles_template_only")
        .when(F.col("paged_ratio") < paged_least, "printed_page_too_sparse").when(F.col("span") < span_least, "printed_page_span_too_small").when(F.col("first_no") > first_most, "toc_starts_late").otherwise("ok")
    )
    return g.withColumn("reason", reason)


def library_update(library: DataFrame, incoming: DataFrame, overwrite: bool = False, id_col: str = "book_id", title: str = "title") -> DataFrame:
    """The library with the incoming books added by normalised title.

    Known titles keep their ids; with overwrite their other columns are taken from the newcomer. New ones get the next free ids, without
    gaps, in an order by hash. Of newcomers with one title the first by its spelling and then its other columns counts. Both have the same columns.
    """
    key = normalise_key(F.col(title))
    rest = [c for c in library.columns if c != id_col]
    new = incoming.withColumn("__k", key).groupBy("__k").agg(F.min(F.struct(title, *[c for c in rest if c != title])).alias("__new"))
    known = library.withColumn("__k", key).groupBy("__k").agg(F.min(id_col).alias("__id"))
    old = library.withColumn("__k", key)
    if overwrite:
        old = old.join(new, "__k", "left").select(id_col, *[F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) for c in rest])
    top = library.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
    # numbered in buckets, so that no task holds all newcomers
    added = new.join(known, "__k", "left_anti").withColumn("__b", F.pmod(F.xxhash64("__k"), F.lit(BUCKETS)))
    before = added.groupBy("__b").agg(F.count("*").alias("__c")).withColumn("__from", F.coalesce(F.sum("__c").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    added = added.withColumn("__n", F.row_number().over(Window.partitionBy("__b").orderBy("__k"))).join(before, "__b")
    added = added.select((F.lit(top) + F.col("__from") + F.col("__n")).cast(library.schema[id_col].dataType).alias(id_col), *[F.col("__new")[c].alias(c) for c in rest])
    return old.select(id_col, *rest).unionByName(added)


#: Buckets in which new books are numbered.
BUCKETS = 64


def library_remove(library: DataFrame, gone: DataFrame, id_col: str = "book_id") -> DataFrame:
    """The library without the books of these ids."""
    return library.join(gone.select(id_col), id_col, "left_anti")
