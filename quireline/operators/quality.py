"""Rule checks whose result is a list of codes: integrity, answer format, conformance, gates and table-of-contents tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import codes, heading_number, occurrences, strip, unescaped

# Headings, markers and words that the checks look for.
REASONING, FINAL = "【解题思路与公式推导思路】", "【最终答案】"
FENCE, CORRECTION = "```", "Correction:"
TOC_WORDS = r"contents|table of contents|目录|目 录"
BACK_WORDS = r"index|references|bibliography|glossary|notation|symbols|acknowledg|参考文献|索引|附录"
FRONT_WORDS = r"contents|preface|foreword|acknowledg|bibliography|reference|index|glossary|notation|symbols|list of figures|list of tables|目录|前言|序|致谢|参考文献|索引|符号表"
SEVERE = ("empty", "unclosed_code_fence", "looks_truncated", "tag_order_wrong", "missing_reasoning_heading", "missing_final_heading", "duplicate_reasoning_heading", "duplicate_final_heading", "extra_level1_heading", "empty_final_section", "unbalanced_math_delimiter")
EXPOSURES = ("expose", "caution", "masked", "unknown", "")


def integrity_issues(c: Column, fence: str = FENCE, marker: str = CORRECTION, heading: str = REASONING, least: int = 20) -> Column:
    """Codes for an open fence, a correction marker, a repeated heading, and a text that is too short."""
    t = F.coalesce(c, F.lit(""))
    return codes(("unclosed_code_fence", occurrences(t, fence) % 2 == 1), ("correction_tail", t.contains(marker)), ("duplicate_reasoning_heading", occurrences(t, heading) > 1), ("too_short", F.length(strip(t)) < least))


def looks_truncated(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+$", "")
    return (t == "") | F.right(t, F.lit(120)).rlike(r"Correction:|V0/") | t.rlike(r"(=|/|\\|\(|\[|\{|:|\-|\*)$")


def answer_format_errors(c: Column, reasoning: str = REASONING, final: str = FINAL) -> Column:
    """The first of each of twelve codes, in a fixed order; an empty answer has one code alone."""
    a = strip(c)
    r, f = F.instr(a, F.lit(reasoning)), F.instr(a, F.lit(final))
    body = strip(F.substring(a, r + len(reasoning), f - r - len(reasoning)))
    rest = strip(F.substring(a, f + len(final), F.length(a)))
    lines = F.transform(F.split(a, r"\r?\n"), lambda x: strip(x))
    extra = F.exists(lines, lambda x: x.rlike(r"^【[^】\n]{1,80}】$") & ~x.isin(reasoning, final))
    ordered = (r > 0) & (f > r)
    found = codes(
        ("missing_reasoning_heading", occurrences(a, reasoning) == 0), ("duplicate_reasoning_heading", occurrences(a, reasoning) > 1),
        ("missing_final_heading", occurrences(a, final) == 0), ("duplicate_final_heading", occurrences(a, final) > 1),
        ("extra_level1_heading", extra), ("tag_order_wrong", (f > 0) & (r > f)),
        ("empty_reasoning_section", ordered & (body == "")), ("empty_final_section", ordered & (rest == "")),
        ("unclosed_code_fence", occurrences(a, FENCE) % 2 == 1), ("contains_correction_marker", a.contains(CORRECTION)),
        ("looks_truncated", looks_truncated(a)), ("unbalanced_math_delimiter", unescaped(a) % 2 == 1),
    )
    return F.when(a == "", F.array(F.lit("empty"))).otherwise(found)


def severely_broken(issues: Column) -> Column:
    return F.arrays_overlap(issues, F.array(*[F.lit(x) for x in SEVERE]))


def select_answer(chosen: Column, issues1: Column, issues2: Column) -> tuple[Column, Column]:
    """The second answer where the first alone is severely broken, and the other way round; else the one chosen. (selected, overridden)"""
    b1, b2 = severely_broken(issues1), severely_broken(issues2)
    out = F.when(b1 & ~b2, "answer2").when(b2 & ~b1, "answer1").otherwise(chosen)
    return out, out != chosen


STEPS = ("Step1", "Step2", "Step3", "Step4", "Step5", "Step6")


def conformance(m: str = "mode") -> Column:
    """P10: codes of what a result row violates of its mode's rules.

    Reads mode, executed_steps, retrieval_used, expert_prompt_used, chapter_only_mode, skip_section_ranking, step5_selection_mode,
    p_solve, confidence_threshold, m5_gate_triggered_retrieval, n1..n5 (rows of each step), final_sources, topk_sections,
    available_sections, ok1..ok5 (whether each step's reply could be parsed).
    """
    mode, steps = F.upper(F.trim(F.col(m))), F.col("executed_steps")
    used, expert = F.coalesce(F.col("retrieval_used"), F.lit(False)), F.coalesce(F.col("expert_prompt_used"), F.lit(False))
    chapters, skipped = F.coalesce(F.col("chapter_only_mode"), F.lit(False)), F.coalesce(F.col("skip_section_ranking"), F.lit(False))
    n = {i: F.coalesce(F.col(f"n{i}"), F.lit(0)) for i in range(1, 6)}
    sources, topk, available = (F.coalesce(F.col(c), F.lit(0)) for c in ("final_sources", "topk_sections", "available_sections"))
    has = lambda s: F.array_contains(steps, s)
    rule5 = F.coalesce(F.col("step5_selection_mode") == "rule_based", F.lit(False))
    rules: list[tuple[str, Column]] = [("missing_step0", ~has("Step0"))]

    def add(which: str, code: str, cond: Column) -> None:
        rules.append((code, (mode == which) & cond))

    def all_steps(which: str, prefix: str, needed: tuple[str, ...], cond: Column) -> None:
        for s in needed:
            add(which, f"{prefix}_missing_{s}", cond & ~has(s))

    yes = F.lit(True)
    for which in ("M1", "M6", "M7", "M8", "M9"):
        add(which, f"{which}_requires_retrieval", ~used)
    for which in ("M2", "M4"):
        add(which, f"{which}_forbids_retrieval", used)
    for which in ("M4", "M9"):
        add(which, f"{which}_requires_expert_prompt", ~expert)
    for which in ("M1", "M8", "M9"):
        all_steps(which, which, STEPS, yes)
    all_steps("M3", "M3_retrieval", STEPS, used)
    all_steps("M6", "M6", tuple(s for s in STEPS if s != "Step5"), yes)
    add("M2", "M2_forbids_retrieval_outputs", F.greatest(*n.values(), sources) > 0)
    for which, code in (("M1", "M1_requires_at_least_one_section"), ("M9", "M9_requires_at_least_one_section"), ("M8", "M8_requires_at_least_one_section"), ("M7", "M7_requires_selected_sections")):
        add(which, code, n[5] < 1)
    for which in ("M1", "M8", "M9"):
        add(which, f"{which}_requires_final_sources", sources < 1)
    p, th, gate = F.col("p_solve"), F.col("confidence_threshold"), F.col("m5_gate_triggered_retrieval")
    add("M5", "M5_requires_p_solve_and_threshold", p.isNull() | th.isNull())
    for code, cond in (("M5_high_confidence_should_not_retrieve", (p >= th) & used), ("M5_low_confidence_should_retrieve", (p < th) & ~used), ("M5_gate_flag_inconsistent_high", (p >= th) & gate), ("M5_gate_flag_inconsistent_low", (p < th) & ~gate)):
        add("M5", code, cond)
    for code, cond in (("M6_requires_chapter_only_mode", ~chapters), ("M6_should_skip_step5", has("Step5")), ("M6_requires_selected_chapters", n[4] < 1), ("M6_should_not_select_sections", n[5] != 0)):
        add("M6", code, cond)
    for code, cond in (("M7_requires_skip_section_ranking", ~skipped), ("M7_requires_rule_based_step5", ~rule5)):
        add("M7", code, cond)
    for code, cond in (("M8_requires_topk_sections", topk <= 0), ("M8_zero_available_sections", available <= 0), ("M8_section_budget_not_met", n[5] != F.when(available > 0, F.least(topk, available)).otherwise(0))):
        add("M8", code, cond)
    for i in range(1, 5):
        rules.append((f"step{i}_json_ok_false", used & ~F.col(f"ok{i}")))
    rules.append(("step5_json_ok_false", used & ~chapters & ~F.col("ok5") & ~rule5))
    return codes(*rules)


# Words that make a question count as demanding.
MULTI_PART = r"(分别|比较|并|以及|同时|给出.*和.*|讨论.*与.*)"
DERIVATION = r"(推导|证明|证明出|写出|给出表达式|说明适用条件|解释原因|由.*推出)"
GROUNDING = r"(?i)(RPA|SCFT|spinodal|binodal|Donnan|Cahn|Hilliard|reptation|tube model|OSF|WLC|Flory[–-]Huggins)"
TOPOLOGY = r"(?i)(星型|环状|嵌段|网络|刷|接枝|受限|拓扑|多臂|rod|coil)"


def question_flags(q: Column, multi_part: str = MULTI_PART, derivation: str = DERIVATION, grounding: str = GROUNDING, topology: str = TOPOLOGY) -> Column:
    """Five properties of a question's text."""
    q = F.coalesce(q, F.lit(""))
    clauses = F.regexp_count(q, F.lit("[；;、]")) >= 2
    formulas = F.regexp_count(q, F.lit(r"\$[^$]+\$")) >= 3
    return F.struct((clauses | formulas).alias("multi_clause"), q.rlike(multi_part).alias("multi_part"), q.rlike(derivation).alias("derivation_heavy"), q.rlike(grounding).alias("grounding_sensitive"), q.rlike(topology).alias("topology_sensitive"))


def retrieval_gate(flags: Column, sufficient: Column, tools: Column, confidence: Column, errors: Column, open_issues: Column) -> Column:
    """(verdict, reason, threshold): the first reason to retrieve, else an early exit."""
    heavy = flags["derivation_heavy"] | flags["grounding_sensitive"] | flags["multi_part"]
    th = F.when(flags["topology_sensitive"] & flags["multi_clause"], 0.93).when(heavy, 0.91).otherwise(0.88)
    reason = (
        F.when(F.size(errors) > 0, "retrieve_due_to_explicit_errors").when(~F.coalesce(sufficient, F.lit(False)), "retrieve_due_to_not_direct_sufficient")
        .when(F.coalesce(tools, F.lit(True)), "retrieve_due_to_positive_tool_utility").when(confidence.isNull() | (confidence < th), "retrieve_due_to_low_confidence")
        .when(open_issues > 0, "retrieve_due_to_open_issues").otherwise("early_exit_confident_and_low_utility")
    )
    verdict = F.when(reason == "retrieve_due_to_explicit_errors", "B").when(reason.startswith("early_exit"), "A").otherwise("C")
    return F.struct(verdict.alias("verdict"), reason.alias("reason"), th.alias("threshold"))


def confidence_gate(p: Column, threshold: Column) -> Column:
    """Retrieve below the threshold, or where there is no estimate."""
    return F.coalesce(p < threshold, F.lit(True))


def judge_errors(scores: dict[str, Column], flag: Column, confidence: Column) -> Column:
    """Codes for scores that are missing or out of 0..10, a missing flag, and a confidence out of 0..1."""
    found = []
    for k, c in scores.items():
        found += [(f"missing_score:{k}", c.isNull()), (f"score_out_of_range:{k}", ~c.between(0, 10))]
    return codes(*found, ("missing_should_use_tools", flag.isNull()), ("missing_confidence", confidence.isNull()), ("confidence_out_of_range", ~confidence.between(0, 1)))


def lines_of(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n"), lambda x: strip(x)), lambda x: x != "")


def toc_likeness(c: Column, words: str = TOC_WORDS, back: str = BACK_WORDS, lines: Column | None = None) -> Column:
    """How much a page looks like a table of contents, 0 to 1."""
    lines = lines_of(c) if lines is None else lines
    ls = F.slice(lines, 1, 200)
    low = F.lower(F.coalesce(c, F.lit("")))
    tails = F.size(F.filter(ls, lambda x: x.rlike(r"\d$")))
    leaders = F.size(F.filter(ls, lambda x: x.rlike(r"\.{3,}\s*\d$|…")))
    score = F.when(low.rlike(words), 0.45).otherwise(0.0) + F.when(low.rlike(back), 0.25).otherwise(0.0) + F.when(tails >= 10, 0.35).otherwise(0.0) + F.when(leaders >= 8, 0.20).otherwise(0.0)
    return F.when(F.size(lines) == 0, 0.0).otherwise(F.least(F.lit(1.0), score))


def page_label(c: Column, edge: int = 4) -> Column:
    """The only number that stands alone in a line near the top or bottom of a page, else null."""
    ls = lines_of(c)
    near = F.concat(F.slice(ls, F.lit(1), F.lit(edge)), F.slice(ls, F.greatest(F.lit(1), F.size(ls) - edge + 1), F.lit(edge)))
    found = F.array_distinct(F.filter(F.transform(near, lambda x: F.regexp_extract(x, r"^[-–—\s]*(\d{1,4})[-–—\s]*$", 1)), lambda x: x != ""))
    return F.when(F.size(found) == 1, found[0].cast("int"))


def toc_line_stats(c: Column, ls: Column | None = None) -> Column:
    """Counts over a contents page's lines; the first rule that fits gives a line's chapter prefix.

    ls: the text's lines, if a column holds them already; worked out once there, they are not split anew for every count.
    """
    ls = lines_of(c) if ls is None else ls
    count = lambda p: F.size(F.filter(ls, p))
    alpha = lambda x: x.rlike(r"[A-Za-z\x{4e00}-\x{9fff}]")
    tail = lambda x: x.rlike(r"\d$")
    dots = lambda x: x.rlike(r"\.{4}|…|·")
    prefix = lambda x: F.coalesce(heading_number(x), F.nullif(F.regexp_extract(x, r"^([0-9]{1,3})\s*\.\s*\d", 1), F.lit("")).cast("int"))
    some = F.array_distinct(F.filter(F.transform(F.slice(ls, 1, 200), prefix), lambda x: x.isNotNull()))
    pages = F.filter(F.transform(F.slice(ls, 1, 200), lambda x: F.nullif(F.regexp_extract(x, r"(\d{1,4})$", 1), F.lit("")).cast("int")), lambda x: x.isNotNull())
    return F.struct(
        F.length(strip(c)).alias("md_len"), F.size(ls).alias("num_lines"), count(alpha).alias("alpha_lines"), count(tail).alias("tail_digit_lines"), count(dots).alias("dotleader_lines"),
        count(lambda x: alpha(x) & (tail(x) | dots(x))).alias("entry_like_lines"), F.lower(c).rlike(r"\bcontents\b|目录|目\s*录").alias("has_contents_keyword"),
        F.size(some).alias("distinct_chapter_prefixes"), F.array_min(some).alias("min_chapter_prefix"), F.coalesce(F.array_max(pages), F.lit(0)).alias("max_page_num"),
    )


def toc_verdict(s: Column, min_len: int = 220, min_lines: int = 12, min_alpha: int = 6, min_tail: int = 6) -> Column:
    """The first reason against a contents page, else ok."""
    weak = (s["dotleader_lines"] >= 3) | ((s["entry_like_lines"] >= max(6, min_tail)) & (s["distinct_chapter_prefixes"] >= 3))
    whole = (s["distinct_chapter_prefixes"] >= 3) | (s["has_contents_keyword"] & (s["max_page_num"] >= 50))
    return (
        F.when(s["md_len"] < min_len, "too_short").when(s["num_lines"] < min_lines, "too_few_lines").when(s["alpha_lines"] < min_alpha, "too_few_alpha_lines")
        .when((s["tail_digit_lines"] < min_tail) & ~weak, "too_few_tail_digit_lines").when(~whole, "not_global_toc").when(s["min_chapter_prefix"] > 2, "toc_starts_late").otherwise("ok")
    )


def template_title(c: Column) -> Column:
    """A title that names a chapter and nothing else."""
    return strip(c).rlike(r"(?i)^(chapter|chap\.?|section|part)?\s*([0-9]{1,3}|[ivxlcdm]{1,10})[.:]?$|^第\s*[0-9零〇一二两三四五六七八九十百千]{1,8}\s*[章节]$")


def front_matter(c: Column) -> Column:
    """A title of front or back matter."""
    return F.lower(strip(c)).rlike(FRONT_WORDS)


def chapter_like(c: Column) -> Column:
    """Strict (a chapter word with a number), loose (a leading number), decimal (2.1), else none."""
    t = strip(c)
    return F.when(t.rlike(r"(?i)^(chapter|chap\.?)\s+([0-9]{1,3}|[ivxlcdm]{1,10})\b|^第.{1,8}章"), "strict").when(t.rlike(r"^[0-9]{1,3}\s*\.\s*[0-9]"), "decimal").when(t.rlike(r"^[0-9]{1,3}\b"), "loose").otherwise("none")


def exposed(quality: Column, exposure: Column, least: float, allow: tuple[str, ...] = EXPOSURES, masked: bool = False) -> Column:
    """Good enough, of an allowed exposure, and masked only if asked for."""
    e = F.coalesce(exposure, F.lit(""))
    return (quality >= least) & e.isin(*allow) & (F.lit(masked) | (e != "masked"))


def repair_class(missing: Column, answered: Column, selected: Column, topk: Column, available: Column) -> Column:
    """full_rerun without an answer, resume below the required number, else done."""
    return F.when(missing | ~answered, "full_rerun").when(selected < F.least(topk, available), "resume").otherwise("done")
