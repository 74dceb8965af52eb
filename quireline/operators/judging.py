"""What goes into a judge call and what comes out of it: evidence under budgets, checks of a reply, flat scores, metrics of a result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import codes
from . import quality as Q

# The keys of a judge's reply, its scores, its lists, the form's version, and what marks a cut.
VERSION = "judge_v1"
KEYS = ("qid", "mode", "scores", "should_use_tools", "confidence", "used_evidence_indices", "key_issues", "strengths")
SCORES = ("overall", "correctness", "completeness", "derivation", "clarity", "grounding", "hallucination_resistance")
LISTS = ("key_issues", "strengths", "unsupported_claims")
CUT = "\n...(truncated)..."


def _kind(v: Column) -> Column:
    """VOID for a JSON null, null where there is nothing; BIGINT, DECIMAL(..), DOUBLE, STRING, BOOLEAN, ARRAY<..>, OBJECT<..>."""
    return F.schema_of_variant(v)


def _number(v: Column, pattern: str, kind: Column | None = None) -> Column:
    """A number, a truth value as 0 or 1, or a text that reads as one; else null."""
    kind, text = _kind(v) if kind is None else kind, F.trim(F.try_variant_get(v, "$", "string"))
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double"))
        .when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))
        .when((kind == "STRING") & text.rlike(pattern), text.try_cast("double"))
    )


def judge_object_errors(reply: Column, version: str = VERSION) -> Column:
    """The codes of what a judge's reply (JSON) lacks or has in a wrong form, in a fixed order.

    The reply is parsed once and each of its values is read once: they are bound to arrays, as an expression of this size is
    compiled to no code, and what is written twice in it is worked out twice.
    """
    paths = ["schema_version", *KEYS, *[f"scores.{k}" for k in SCORES], *[k for k in LISTS if k not in KEYS]]
    values = lambda obj: F.array(obj, *[F.try_variant_get(obj, f"$.{p}", "variant") for p in paths])
    pairs = lambda vs: F.transform(vs, lambda v: F.struct(v.alias("v"), _kind(v).alias("kind")))
    return _bound(F.try_parse_json(reply), lambda obj: _bound(pairs(values(obj)), lambda found: _object_codes(found, paths, version)))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _object_codes(read: Column, paths: list[str], version: str) -> Column:
    obj = F.get(read, F.lit(0))["v"]
    at = lambda path: F.get(read, F.lit(paths.index(path) + 1))["v"]
    kind_of = lambda path: F.get(read, F.lit(paths.index(path) + 1))["kind"]
    whole = r"^[+-]?[0-9]+$"
    scores = kind_of("scores").startswith("OBJECT")
    no_scores = ~F.coalesce(scores, F.lit(False))
    found = [("schema_version_mismatch", ~F.coalesce((kind_of("schema_version") == "STRING") & (F.try_variant_get(at("schema_version"), "$", "string") == version), F.lit(False)))]
    found += [(f"missing_{k}", at(k).isNull()) for k in KEYS]
    found.append(("scores_not_dict", no_scores))
    for k in SCORES:
        v = at(f"scores.{k}")
        n = _number(v, whole, kind_of(f"scores.{k}"))
        n = F.when(n < 0, F.ceil(n)).otherwise(F.floor(n))
        found += [(f"scores_missing_{k}", scores & v.isNull()), (f"scores_out_of_range_{k}", scores & ~n.between(0, 10)), (f"scores_not_int_{k}", scores & v.isNotNull() & n.isNull())]
    sure = _number(at("confidence"), r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", kind_of("confidence"))
    found += [("confidence_out_of_range", ~sure.between(0, 1)), ("confidence_not_float", sure.isNull())]
    found.append(("should_use_tools_not_bool", ~F.coalesce(kind_of("should_use_tools") == "BOOLEAN", F.lit(False))))
    used = F.try_variant_get(at("used_evidence_indices"), "$", "array<variant>")
    listed = F.coalesce(kind_of("used_evidence_indices").startswith("ARRAY"), F.lit(False))
    found += [("used_evidence_indices_not_list", ~listed), ("used_evidence_indices_not_int", listed & F.exists(used, lambda x: _number(x, whole).isNull()))]
    found += [(f"{k}_not_list", ~kind_of(k).rlike("^(ARRAY|VOID)")) for k in LISTS]
    return F.when(F.coalesce(F.get(read, F.lit(0))["kind"].startswith("OBJECT"), F.lit(False)), codes(*found)).otherwise(F.array(F.lit("not_dict")))


def judge_flat(reply: Column) -> list[Column]:
    """A reply's scores and lists as prefixed columns."""
    scores = "struct<" + ",".join(f"{k}:int" for k in SCORES) + ">"
    j = F.from_json(reply, f"qid string, mode string, scores {scores}, should_use_tools boolean, confidence double, used_evidence_indices array<int>, unsupported_claims array<string>, key_issues array<string>, strengths array<string>")
    rest = ("should_use_tools", "confidence", "used_evidence_indices", "unsupported_claims", "key_issues", "strengths")
    return [j["qid"].alias("qid"), j["mode"].alias("mode"), *[j["scores"][k].alias(f"judge_score_{k}") for k in SCORES], *[j[k].alias(f"judge_{k}") for k in rest]]


def cut(c: Column, most: Column | int) -> Column:
    """F16: the first characters and a mark, where there are more."""
    c, most = F.coalesce(c, F.lit("")), most if isinstance(most, Column) else F.lit(most)
    return F.when((most > 0) & (F.length(c) > most), F.concat(F.left(c, most.cast("int")), F.lit(CUT))).otherwise(c)


def evidence(views: DataFrame, by: list[str], order: str, text: str, each: int = 8000, total: int = 24000) -> DataFrame:
    """the excerpts of each question that fit the budgets: (by, index, views' other columns, text).

    Each is cut to its own budget, blank ones are left out, the one that goes beyond the total is cut to what is left, and those after
    it go. index counts from 1, blank ones included.
    """
    place = Window.partitionBy(*by).orderBy(order)
    v = views.withColumn("index", F.row_number().over(place)).withColumn(text, cut(F.col(text), each)).where(F.col(text).rlike(r"\S"))
    before = F.coalesce(F.sum(F.length(text)).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    v = v.withColumn("__left", F.lit(total) - before)
    if total <= 0:
        return v.drop("__left")
    return v.where("__left > 0").withColumn(text, F.when(F.length(text) > F.col("__left"), cut(F.col(text), F.col("__left"))).otherwise(F.col(text))).drop("__left")


def judge_input(answers: DataFrame, shown: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(qid, input): one JSON object a question with its cut answer and outlines, the trace of its steps and its evidence.

    answers: qid, mode, question, final_answer, outline, audit_outline, selected and the columns of the trace, whichever there are.
    shown: qid, index, kind, source, text.
    """
    most = {"final_answer": 6000, "outline": 8000, "audit_outline": 12000} | (limits or {})
    head = ("qid", "mode", "question", *most, "selected")
    trace = [c for c in answers.columns if c not in head]
    listed = shown.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("index", "kind", "source", "text"))).alias("evidence"))
    text = lambda c: cut(F.col(c), most[c]) if c in most else F.coalesce(F.col(c).cast("string"), F.lit(""))
    none = F.array().cast("array<struct<index:int,kind:string,source:string,text:string>>")
    body = F.struct(*[text(c).alias(c) for c in head if c in answers.columns], F.struct(*trace).alias("tool_trace") if trace else F.lit(None).alias("tool_trace"), F.coalesce("evidence", none).alias("evidence"))
    return answers.join(listed, "qid", "left").select("qid", F.to_json(body).alias("input"))


# Names of a result's lists, numbers, flags and texts.
STEP_LISTS = ("step1_candidates_books", "step2_selected_books", "step3_candidate_chapters", "step4_selected_chapters", "step5_selected_sections")
NUMBERS = ("retrieval_rounds", "topk_books", "topk_books_view", "topk_candidate_chapters", "topk_selected_chapters", "topk_sections", "section_budget_used", "step5_available_sections_total", "section_chars_total")
FLAGS = ("retrieval_used", "forced_retrieval", "no_retrieval", "expert_prompt_used", "chapter_only_mode", "skip_section_ranking")
CHARS = ("answer_raw", "final_answer", "outline", "audit_outline")
LOOSE = ("p_solve double", "confidence_threshold double", "m5_gate_triggered_retrieval boolean", *(f"step{i}_json_ok boolean" for i in range(1, 6)), "duration_sec double")


def auto_metrics(df: DataFrame, payload: str, meta: dict[str, Column] | None = None) -> DataFrame:
    """A result's JSON as one wide row: counts of lists, lengths of texts, flags, issues, overrides and rule violations.

    meta gives columns that the payload lacks (batch_id, title, paths, ...). A payload that is no object counts as failed, with defaults.
    """
    step = "array<struct<chapter_summary:string>>"
    lists = ", ".join(f"{c} {step if c == 'step4_selected_chapters' else 'array<string>'}" for c in STEP_LISTS)
    schema = f"test_mode string, executed_steps array<string>, {lists}, final_sources array<string>, trace array<struct<step:string>>, answer1 string, answer2 string, selected string, step5_selection_mode string, " + ", ".join([*(f"{c} long" for c in NUMBERS), *(f"{c} boolean" for c in FLAGS), *(f"{c} string" for c in CHARS), *LOOSE])
    d = df.withColumn("__p", F.from_json(payload, schema))
    p = F.col("__p")
    size = lambda c: F.coalesce(F.size(p[c]), F.lit(0)) if c else None
    text = lambda c: F.coalesce(p[c], F.lit(""))
    out: dict[str, Column] = dict(meta or {})
    out["status"] = F.when(F.col(payload).rlike(r"^\s*\{"), "ok").otherwise("failed")
    out["mode"], out["executed_steps"] = text("test_mode"), F.coalesce(p["executed_steps"], F.array().cast("array<string>"))
    out["executed_steps_count"] = size("executed_steps")
    out |= {c: F.coalesce(p[c], F.lit(False)) for c in FLAGS} | {c: F.coalesce(p[c], F.lit(0).cast("long")) for c in NUMBERS}
    out |= {f"{c}_count": F.greatest(size(c), F.lit(0)) for c in (*STEP_LISTS, "final_sources")}
    summaries = F.aggregate(F.coalesce(p["step4_selected_chapters"], F.array().cast(step)), F.lit(0).cast("long"), lambda acc, x: acc + F.coalesce(F.length(x["chapter_summary"]), F.lit(0)))
    out["evidence_chars_total"] = F.when((out["section_chars_total"] <= 0) & out["chapter_only_mode"], summaries).otherwise(out["section_chars_total"])
    out["step5_selection_mode"] = text("step5_selection_mode")
    out |= {f"{c}_chars": F.length(text(c)) for c in CHARS}
    one, two = Q.integrity_issues(text("answer1")), Q.integrity_issues(text("answer2"))
    out |= {"answer1_issues": one, "answer2_issues": two, "selected_issues": F.when(text("selected") == "answer1", one).otherwise(two)}
    out["selected_severely_broken"] = Q.severely_broken(out["selected_issues"])
    out["selection_override"] = F.coalesce(F.exists(p["trace"], lambda t: t["step"] == "SelectionOverride"), F.lit(False))
    out |= {c.split()[0]: p[c.split()[0]] for c in LOOSE}
    wide = d.select(*df.columns, *[c.alias(k) for k, c in out.items() if k not in df.columns])
    rules = wide.withColumns({**{f"n{i}": F.col(f"{c}_count") for i, c in enumerate(STEP_LISTS, 1)}, "final_sources": F.col("final_sources_count"), "available_sections": F.col("step5_available_sections_total"), **{f"ok{i}": F.col(f"step{i}_json_ok") for i in range(1, 6)}})
    judged = rules.withColumn("spec_violations", Q.conformance()).withColumn("spec_ok", F.size("spec_violations") == 0)
    return judged.drop(*(f"n{i}" for i in range(1, 6)), "final_sources", "available_sections", *(f"ok{i}" for i in range(1, 6)))


def score_text(df: DataFrame) -> Column:
    """the scores of a judged row as lines; a row without any says so."""
    line = lambda k: F.concat(F.lit(f"- {k}: "), F.coalesce(F.col(f"judge_score_{k}").cast("string"), F.lit("NA")))
    scores = [k for k in SCORES if f"judge_score_{k}" in df.columns]
    if not scores:
        return F.lit("（当前尚无评分结果）")
    some = F.coalesce(*[F.col(f"judge_score_{k}") for k in scores]).isNotNull()
    return F.when(some, F.concat_ws("\n", *[line(k) for k in scores])).otherwise("（当前尚无评分结果）")
