import difflib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireline.functions import text as X
from quireline.functions import vector as V
from quireline.operators import quality as Q


def one(spark, column, **values):
    """The value of a column expression over one row."""
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'long' if isinstance(v, int) and not isinstance(v, bool) else 'boolean' if isinstance(v, bool) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(("raw", "want"), [(r"\section*{Chapter 3: The Flow}", "chapter 3 the flow"), (r"\textbf{A \emph{b}}", "a b"), ("第三章 流动", "第 三 章 流 动"), (None, ""), ("  ", "")])
def test_normalise_title(spark, raw, want):
    assert one(spark, X.normalise_title(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("xiv", 14), ("MCMXC", 1990), ("iiii", 4), ("abc", None), ("", None)])
def test_roman(spark, raw, want):
    assert one(spark, X.roman(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("十", 10), ("二十三", 23), ("一百零二", 102), ("12", 12), ("三x", None), ("", None)])
def test_han_number(spark, raw, want):
    assert one(spark, X.han_number(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("3. Intro", 3), ("CHAPTER 12 End", 12), ("第十二章 末", 12), ("Intro", None)])
def test_heading_number(spark, raw, want):
    assert one(spark, X.heading_number(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("raw", "want"), [('so {"a": {"b": 1}} end', '{"a": {"b": 1}}'), ("none", None), ("} {", None), (None, None)])
def test_json_object(spark, raw, want):
    assert one(spark, X.json_object(F.col("s")), s=raw) == want


@pytest.mark.parametrize(("raw", "want"), [("Verdict: B because A", "B"), ("maybe A or C", "C"), ("nothing", None), (None, None)])
def test_verdict_letter(spark, raw, want):
    assert one(spark, X.verdict_letter(F.col("s")), s=raw) == want


def test_windows_and_samples(spark):
    assert [r["name"] for r in one(spark, X.probe_windows(F.col("s"), 3), s="abcdefghij")] == ["head", "mid", "tail"]
    assert [r["name"] for r in one(spark, X.probe_windows(F.col("s"), 30), s="abc")] == ["head"]
    assert one(spark, X.chunk_starts(F.col("s"), 4, 1), s="abcdefgh") == [0, 3, 6]
    assert one(spark, X.chunk_starts(F.col("s"), 4, 1), s="") == []


def test_even_samples(spark):
    assert one(spark, X.even_samples(F.col("a").cast("int"), F.col("b").cast("int"), 3), a=0, b=10) == [0, 5, 10]
    assert one(spark, X.even_samples(F.col("a").cast("int"), F.col("b").cast("int"), 3), a=4, b=4) == [4]


def test_cut_flags(spark):
    assert tuple(one(spark, X.cut_flags(F.col("s"), F.lit(3)), s="a $x$ b")) == (True, False, False)
    assert tuple(one(spark, X.cut_flags(F.col("s"), F.lit(2)), s="word")) == (False, True, False)
    assert tuple(one(spark, X.cut_flags(F.col("s"), F.lit(2)), s=r"\x y")) == (False, False, True)


def test_language_hint(spark):
    assert one(spark, X.language_hint(F.col("s")), s="文" * 50) == "zh"
    assert one(spark, X.language_hint(F.col("s")), s="文" * 10 + "a" * 50) == "en"


GOOD = f"{Q.REASONING}\nbecause\n{Q.FINAL}\nthe answer"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (GOOD, []), ("", ["empty"]), (None, ["empty"]),
        (f"{Q.FINAL}\na\n{Q.REASONING}\nb", ["tag_order_wrong"]),
        (f"{Q.REASONING}\n\n{Q.FINAL}\nx", ["empty_reasoning_section"]),
        (GOOD + "\n【Extra】\n$5", ["extra_level1_heading", "unbalanced_math_delimiter"]),
        (GOOD + " \\$5 ```", ["unclosed_code_fence"]),
        ("so x =", ["missing_reasoning_heading", "missing_final_heading", "looks_truncated"]),
    ],
)
def test_answer_format(spark, text, want):
    assert one(spark, Q.answer_format_errors(F.col("s")), s=text) == want


def test_selection_override(spark):
    a, b = F.array(F.lit("looks_truncated")), F.array().cast("array<string>")
    chosen, over = Q.select_answer(F.lit("answer1"), a, b)
    assert one(spark, F.struct(chosen, over), s="") == ("answer2", True)
    chosen, over = Q.select_answer(F.lit("answer1"), a, a)
    assert one(spark, F.struct(chosen, over), s="") == ("answer1", False)


def base_row(**changes):
    row = dict(mode="M1", executed_steps=[f"Step{i}" for i in range(7)], retrieval_used=True, expert_prompt_used=True, chapter_only_mode=False, skip_section_ranking=False, step5_selection_mode="llm", p_solve=None, confidence_threshold=None, m5_gate_triggered_retrieval=None, n1=3, n2=2, n3=2, n4=2, n5=2, final_sources=1, topk_sections=2, available_sections=5, ok1=True, ok2=True, ok3=True, ok4=True, ok5=True)
    return row | changes


ROW = "mode string, executed_steps array<string>, retrieval_used boolean, expert_prompt_used boolean, chapter_only_mode boolean, skip_section_ranking boolean, step5_selection_mode string, p_solve double, confidence_threshold double, m5_gate_triggered_retrieval boolean, n1 int, n2 int, n3 int, n4 int, n5 int, final_sources int, topk_sections int, available_sections int, ok1 boolean, ok2 boolean, ok3 boolean, ok4 boolean, ok5 boolean"


def test_conformance(spark):
    cases = [
        (base_row(), []),
        (base_row(n5=0), ["M1_requires_at_least_one_section"]),
        (base_row(mode="M2"), ["M2_forbids_retrieval", "M2_forbids_retrieval_outputs"]),
        (base_row(mode="M3", executed_steps=["Step0"], retrieval_used=False), []),
        (base_row(mode="M4", retrieval_used=False, expert_prompt_used=False), ["M4_requires_expert_prompt"]),
        (base_row(mode="M5"), ["M5_requires_p_solve_and_threshold"]),
        (base_row(mode="M5", p_solve=0.9, confidence_threshold=0.5), ["M5_high_confidence_should_not_retrieve"]),
        (base_row(mode="M6", n5=0, chapter_only_mode=True, executed_steps=[f"Step{i}" for i in range(7) if i != 5]), []),
        (base_row(mode="M7", skip_section_ranking=True, step5_selection_mode="rule_based", ok5=False), []),
        (base_row(mode="M8", n5=1), ["M8_section_budget_not_met"]),
        (base_row(mode="M9", executed_steps=["Step1"]), ["missing_step0", *[f"M9_missing_Step{i}" for i in range(2, 7)]]),
        (base_row(ok3=False, ok5=False), ["step3_json_ok_false", "step5_json_ok_false"]),
    ]
    got = spark.createDataFrame([tuple(r.values()) for r, _ in cases], ROW).select(Q.conformance()).collect()
    assert [sorted(g[0]) for g in got] == [sorted(w) for _, w in cases]


def test_toc_checks(spark):
    page = "Contents\n" + "\n".join(f"{i} Title number {i} ........ {i * 9}" for i in range(1, 15))
    s = one(spark, Q.toc_line_stats(F.col("s")), s=page)
    assert (s["num_lines"], s["distinct_chapter_prefixes"], s["min_chapter_prefix"], s["max_page_num"], s["has_contents_keyword"]) == (15, 14, 1, 126, True)
    assert one(spark, Q.toc_verdict(Q.toc_line_stats(F.col("s"))), s=page) == "ok"
    assert one(spark, Q.toc_verdict(Q.toc_line_stats(F.col("s"))), s="short") == "too_short"
    assert one(spark, Q.toc_likeness(F.col("s")), s=page) == pytest.approx(0.8)
    assert one(spark, Q.page_label(F.col("s")), s="Head\ntext\n- 12 -") == 12
    assert one(spark, Q.page_label(F.col("s")), s="11\ntext\n12") is None


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB ﬁﬃ\u00ad-‐\n\t“’é😀ǅ中", max_size=40))
def test_match_form_maps_into_the_text(s):
    form, at = V.match_form(s)
    assert len(form) == len(at)
    assert all(0 <= i < len(s) for i in at) and at == sorted(at)
    assert "  " not in form and form == form.lower()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab$\\{}%[]\n section", max_size=60))
def test_tex_shadow_keeps_length(s):
    assert len(V.tex_shadow(s)) == len(s)


def test_match_form():
    assert V.match_form("of\ufb01ce poly-\nmer  A")[0] == "office polymer a"
    assert V.match_form(None) == ("", [])


def test_headings_and_find_all():
    text = "x\n\\section*[s]{A {b} \\{c}\n\\chapter{}\nChapter 3 Flow\n"
    assert [(k, t) for k, t, _, _ in V.headings(text)] == [("section", "A {b} \\{c"), ("plain", "Chapter 3 Flow")]
    assert V.headings(None) == []
    assert V.find_all("aaaa", "aa") == [0, 1, 2] and V.find_all("abc", "") == []


def test_similarity():
    assert V.similarity("flow of heat", "flow of heat") == 1.0 and V.similarity("", "x") == 0.0
    assert V.partial_similarity("heat", "the flow of heat and mass") == 1.0


@pytest.mark.parametrize("letters", ["ab", "abcd", "abc déñ😀", "the quick brown fox"])
def test_partial_similarity_equals_difflib(letters):
    rng = random.Random(5)

    def plain(a, b):
        short, long = sorted((a, b), key=len)
        if not short:
            return 0.0
        found = difflib.SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()
        starts = {max(0, min(len(long) - len(short), y - x)) for x, y, n in found if n}
        return max((difflib.SequenceMatcher(None, short, long[s : s + len(short)], autojunk=False).ratio() for s in starts), default=0.0)

    for n in [0, 1, 2, 3, *[rng.randrange(40) for _ in range(300)], 150]:
        a = "".join(rng.choice(letters) for _ in range(n))
        b = "".join(rng.choice(letters) for _ in range(rng.choice([n, n + 1, 2 * n, 3 * n])))
        b = b[: n // 2] + a[n // 4 :] + b[n // 2 :] if rng.random() < 0.3 else b
        assert V.partial_similarity(a, b) == plain(a, b)


def test_partial_similarity_does_not_repeat_work(monkeypatch):
    rng, tried = random.Random(9), []
    phrase, window = ("".join(rng.choice("etaoin shrdlu") for _ in range(n)) for n in (200, 400))
    longest = V._Blocks._longest
    monkeypatch.setattr(V._Blocks, "_longest", lambda self, *box: tried.append(box[:4]) or longest(self, *box))
    blocks = V._Blocks(phrase, window)
    starts = range(0, 200, 2)
    sizes = [blocks.matched(s, s + 200) for s in starts]
    assert len(tried) == len(set(tried)) and sizes[0] == sum(m.size for m in difflib.SequenceMatcher(None, phrase, window[:200], autojunk=False).get_matching_blocks())
