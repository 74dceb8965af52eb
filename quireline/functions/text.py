"""Text functions as Column expressions: they stay inside generated code and need no Python workers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the title normaliser and of CJK characters.
TEX_WITH_ARG = r"\\[a-zA-Z@]+\s*\*?\s*(?:\[[^\]]*\]\s*)?\{([^\{\}]*)\}"
TEX_BARE = r"\\[a-zA-Z@]+\s*\*?(?:\s*\[[^\]]*\])?(?:\s*\{[^\}]*\})?"
NOT_WORD = r"[^\p{L}\p{N}_]+"
CJK = r"[\x{4e00}-\x{9fff}]"

# The numerals' worth.
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
HAN_DIGITS = {"零": 0, "〇": 0, "○": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
HAN_UNITS = {"十": 10, "百": 100, "千": 1000}


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends; null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+", ""), r"\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def normalise_title(c: Column) -> Column:
    """TeX commands go (their arguments stay, up to three levels), then lower case, words only, CJK characters set apart."""
    t = strip(c)
    for _ in range(3):
        t = F.regexp_replace(t, TEX_WITH_ARG, " $1 ")
    t = F.lower(F.regexp_replace(t, TEX_BARE, " "))
    t = F.regexp_replace(t, NOT_WORD, " ")
    return squeeze(F.regexp_replace(t, f"({CJK})", " $1 "))


def normalise_key(c: Column) -> Column:
    """letters and digits of the lower-cased text."""
    return F.regexp_replace(F.lower(strip(c)), r"[^0-9a-z\x{4e00}-\x{9fff}]+", "")


def slug(c: Column, most: int = 80) -> Column:
    """words joined by underscores, cut to a length."""
    s = F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^0-9a-z]+", "_"), "^_+|_+$", "")
    return F.regexp_replace(F.left(s, F.lit(most)), "_+$", "")


def tokens(c: Column) -> Column:
    """distinct tokens of a normalised title: CJK characters, and words of three characters or more."""
    return F.array_distinct(F.filter(F.split(normalise_title(c), " "), lambda t: (F.length(t) >= 3) | t.rlike(f"^{CJK}$")))


def plain_tokens(c: Column, least: int = 3) -> Column:
    """Distinct lower-cased words of ASCII letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= least))


def occurrences(c: Column, part: str) -> Column:
    """How often a part occurs, without overlaps."""
    c = F.coalesce(c, F.lit(""))
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def leading_int(c: Column) -> Column:
    """a number of up to three digits that starts the text, else null."""
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"^\s*(\d{1,3})\b", 1), F.lit("")).cast("int")


def roman(c: Column) -> Column:
    """value of a Roman numeral by one fold from its end; null where a character is none."""
    s = F.lower(strip(c))
    worth = F.lit(None).cast("int")
    letters = F.reverse(F.split(s, ""))

    def value(ch: Column) -> Column:
        out = worth
        for k, v in ROMAN.items():
            out = F.when(ch == k, v).otherwise(out)
        return out

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    step = lambda a, ch: F.struct((a["total"] + F.when(value(ch) < a["last"], -value(ch)).otherwise(value(ch))).alias("total"), F.greatest(a["last"], value(ch)).alias("last"))
    return F.when(s.rlike("^[ivxlcdm]+$"), F.aggregate(letters, start, step, lambda a: a["total"]))


def han_number(c: Column) -> Column:
    """value of a Han numeral up to thousands, or of digits; null for anything else."""
    s = strip(c)
    marks = "".join(HAN_DIGITS) + "".join(HAN_UNITS)

    def pick(ch: Column, table: dict[str, int]) -> Column:
        out = F.lit(None).cast("int")
        for k, v in table.items():
            out = F.when(ch == k, v).otherwise(out)
        return out

    def step(a: Column, ch: Column) -> Column:
        unit, digit = pick(ch, HAN_UNITS), pick(ch, HAN_DIGITS)
        total = a["total"] + F.when(unit.isNotNull(), F.when(a["num"] == 0, 1).otherwise(a["num"]) * unit).otherwise(0)
        return F.struct(total.alias("total"), F.when(unit.isNotNull(), 0).otherwise(digit).alias("num"))

    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("num"))
    folded = F.aggregate(F.split(s, ""), start, step, lambda a: a["total"] + a["num"])
    return F.when(s.rlike(r"^[0-9]{1,9}$"), s.try_cast("int")).when(s.rlike(f"^[{marks}]+$"), F.nullif(folded, F.lit(0)))


def heading_number(c: Column) -> Column:
    """number at the start, after a chapter word, or between the Han marks of a chapter."""
    t = squeeze(c)
    word = F.nullif(F.regexp_extract(t, r"^(?:CHAPTER|Chapter|Chap\.?|CHAP\.?)\s*(\d{1,3})\b", 1), F.lit("")).cast("int")
    han = F.nullif(F.regexp_extract(t, r"^第\s*([0-9]{1,3}|[零〇○一二两三四五六七八九十百千]{1,8})\s*章", 1), F.lit(""))
    return F.coalesce(leading_int(t), word, han_number(han))


def safe_filename(c: Column, most: int = 80) -> Column:
    """forbidden characters become underscores; a longer name is cut and gets eight digits of its hash."""
    s = F.regexp_replace(F.regexp_replace(strip(c), r'[\\/:*?"<>|\x00-\x1f]+', "_"), r"[ .]+$", "")
    return F.when(F.length(s) <= most, s).otherwise(F.concat(F.regexp_replace(F.left(s, F.lit(most - 9)), r"[ ._]+$", ""), F.lit("_"), F.left(F.sha1(s), F.lit(8))))


def truncate(c: Column, most: int) -> Column:
    """F16: the first characters."""
    return F.left(F.coalesce(c, F.lit("")), F.lit(most))


def truncate_marked(c: Column, most: int, mark: str = "…") -> Column:
    """F16: cut with a mark that counts towards the length."""
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most - len(mark))), F.lit(mark))).otherwise(c)


def json_object(c: Column) -> Column:
    """what stands between the first opening and the last closing brace, or null."""
    first = F.instr(c, F.lit("{"))
    last = F.length(c) - F.instr(F.reverse(c), F.lit("}")) + 1
    return F.when((first > 0) & c.contains("}") & (last > first), F.substring(c, first, last - first + 1))


def verdict_letter(c: Column, letters: str = "ABC") -> Column:
    """the letter after a verdict mark, else the last such letter, else null."""
    t = F.upper(F.coalesce(c, F.lit("")))
    marked = F.regexp_extract(t, rf"VERDICT\s*[:=]?\s*([{letters}])\b", 1)
    lone = F.regexp_extract_all(t, F.lit(rf"\b([{letters}])\b"), F.lit(1))
    return F.coalesce(F.nullif(marked, F.lit("")), F.try_element_at(lone, F.lit(-1)))


def safe_bool(c: Column) -> Column:
    """true/1/yes, false/0/no, else null."""
    s = F.lower(strip(c.cast("string")))
    return F.when(s.isin("true", "1", "yes"), True).when(s.isin("false", "0", "no"), False)


def safe_double(c: Column) -> Column:
    """A number, or null for what is none."""
    return F.nullif(strip(c.cast("string")), F.lit("")).try_cast("double")


def first_filled(*cols: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def symbol_ratio(c: Column) -> Column:
    """P25: share of characters that are neither letters, digits nor white space."""
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[\p{L}\p{N}\s]", "")) / F.length(c)).otherwise(0.0)


def capitals_share(c: Column) -> Column:
    """share of upper-case letters among letters; null with fewer than six letters."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when(letters >= 6, F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")) / letters)


def han_share(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]", "")) / F.length(c)).otherwise(0.0)


def language_hint(c: Column, least: int = 40, share: float = 0.02) -> Column:
    """Zh where there are enough Han characters and they are enough of the text, else en."""
    n = F.length(F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}]", ""))
    return F.when((n >= least) & (han_share(c) >= share), "zh").otherwise("en")


def chunk_starts(c: Column, size: int, overlap: int) -> Column:
    """where chunks of a size start so that neighbours overlap."""
    return F.when(F.length(c) > 0, F.sequence(F.lit(0), F.length(c) - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


def probe_windows(c: Column, size: int) -> Column:
    """distinct (name, start) of windows at the head, middle and tail; a short text has one."""
    n = F.length(c)
    three = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("int").alias("start")) for k, v in (("head", F.lit(0)), ("mid", F.greatest(F.lit(0), F.floor(n / 2) - size // 2)), ("tail", F.greatest(F.lit(0), n - size)))])
    return F.when(n <= size, F.slice(three, 1, 1)).otherwise(three)


def even_samples(start: Column, end: Column, n: int) -> Column:
    """N evenly spaced whole numbers of a span, distinct, halves rounded to even."""
    at = F.sequence(F.lit(0), F.lit(n - 1))
    return F.array_distinct(F.transform(at, lambda i: F.least(end, F.greatest(start, F.bround(start + i * (end - start) / F.lit(max(1, n - 1)), 0).cast("int")))))


def unescaped(c: Column, mark: str = "$") -> Column:
    """Occurrences of a mark without a backslash before it."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(rf"(?<!\\)\{mark}"))


def cut_flags(c: Column, at: Column) -> Column:
    """what a cut before character ``at`` (from 0) would break: open math, a word, a TeX command."""
    head, nxt = F.left(c, at), F.substring(c, at + 1, F.lit(1))
    prev = F.right(head, F.lit(1))
    return F.struct((unescaped(head) % 2 == 1).alias("in_math"), (prev.rlike(r"^[\p{L}\p{N}]$") & nxt.rlike(r"^[\p{L}\p{N}]$")).alias("in_word"), head.rlike(r"\\[a-zA-Z]*$").alias("in_command"))


def codes(*flags: tuple[str, Column]) -> Column:
    """Names of the flags that hold, in the order given."""
    return F.filter(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in flags]), lambda x: x.isNotNull())
