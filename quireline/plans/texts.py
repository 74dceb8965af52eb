"""Text path: scalar functions, chunking, structure tests and similarity on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vector as V
from ..operators import joins as J
from ..operators import quality as Q
from ..session import table
from ..sources import readers as R
from ..sources import writers as K
from .registry import query

STRIP = lambda c: f"regexp_replace(regexp_replace({c}, '^\\s+', ''), '\\s+$', '')"
WORDS = "list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda t: length(t) >= 3))"


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *cols)


def _lined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their lines bound to a column, so that what follows does not split them again."""
    return _docs(spark, sf_dir, "text", Q.lines_of(F.col("text")).alias("ls"))


@query(f"""
with a as (select doc_id, {WORDS.format(c="text")} tk from documents where n_chars < 4000), b as (select item_id, {WORDS.format(c="text")} tk from benchmark),
x as (select doc_id, len(tk) nl, unnest(tk) t from a), y as (select item_id, len(tk) nr, unnest(tk) t from b)
select doc_id, item_id, count(*) shared, round(count(*) / (nl + nr - count(*)), 6) jaccard, round(count(*) / least(nl, nr), 6) overlap from x join y using (t) group by doc_id, item_id, nl, nr
having count(*) / (nl + nr - count(*)) >= 0.2
""")
def token_jaccard_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token sets of documents and benchmark items that overlap, by an inverted index. As its SQL, only documents under 4,000 characters."""
    return _contaminated(spark, sf_dir, table(spark, sf_dir, "documents").where("n_chars < 4000"))


@query()
def token_jaccard_contamination_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all documents (unit-tested; no SQL)."""
    return _contaminated(spark, sf_dir, table(spark, sf_dir, "documents"))


def _contaminated(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", X.plain_tokens(F.col("text")).alias("tokens"))
    b = table(spark, sf_dir, "benchmark").select("item_id", X.plain_tokens(F.col("text")).alias("tokens"))
    o = J.token_overlap(d, b, "doc_id", "item_id", least=0.2)
    return o.select("doc_id", "item_id", "shared", F.round("jaccard", 6).alias("jaccard"), F.round("overlap", 6).alias("overlap"))


@query("""
select doc_id, array_to_string(list_filter([case when ((length(text) - length(replace(text, '!!', ''))) // 2) % 2 = 1 then 'unclosed_code_fence' end,
  case when contains(text, 'License') then 'correction_tail' end, case when (length(text) - length(replace(text, 'Licensed', ''))) // 8 > 1 then 'duplicate_reasoning_heading' end,
  case when length(trim(text)) < 20 then 'too_short' end], lambda x: x is not null), ',') issues from documents
""")
def integrity_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity codes, with markers that occur in these texts."""
    return _docs(spark, sf_dir, F.array_join(Q.integrity_issues(F.col("text"), "!!", "License", "Licensed"), ",").alias("issues"))


@query(f"""
select conv_id, turn, case when a = '' then 'empty' else array_to_string(list_filter([case when r = 0 then 'missing_reasoning_heading' end, 'missing_final_heading',
  case when regexp_matches(a, '(=|/|\\\\|\\(|\\[|\\{{|:|-|\\*)$') then 'looks_truncated' end,
  case when (length(a) - length(replace(a, '$', ''))) % 2 = 1 then 'unbalanced_math_delimiter' end], lambda x: x is not null), ',') end errors
from (select conv_id, turn, {STRIP('text')} a, instr(text, '【解题思路与公式推导思路】') r from conversations)
""")
def answer_format_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format codes of answers; none of these texts has the headings, so the SQL needs few of the codes."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(Q.answer_format_errors(F.col("text")), ",").alias("errors"))


@query("""
with s as (select user_id, list_distinct(list('Step' || (event_id % 7)::varchar)) steps, count(*) filter (where event_type = 'view') n5, bool_or(event_type = 'purchase') used, count(*) n from events group by user_id),
m as (select *, case user_id % 3 when 0 then 'M1' when 1 then 'M2' else 'M8' end AS mode from s)
select user_id, array_to_string(list_filter(flatten([[case when not list_contains(steps, 'Step0') then 'missing_step0' end, case when mode <> 'M2' and not used then mode || '_requires_retrieval' end, case when mode = 'M2' and used then 'M2_forbids_retrieval' end],
  list_transform(list_filter(['Step1','Step2','Step3','Step4','Step5','Step6'], lambda z: mode <> 'M2' and not list_contains(steps, z)), lambda z: mode || '_missing_' || z),
  [case when mode = 'M2' and n5 > 0 then 'M2_forbids_retrieval_outputs' end, case when mode <> 'M2' and n5 < 1 then mode || '_requires_at_least_one_section' end, case when mode <> 'M2' and user_id % 5 = 0 then mode || '_requires_final_sources' end,
   case when mode = 'M8' and n5 <> least(10, n) then 'M8_section_budget_not_met' end, case when used and user_id % 4 = 0 then 'step2_json_ok_false' end]]), lambda x: x is not null), ',') codes
from m
""")
def conformance_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule violations of each mode, for all users."""
    e = table(spark, sf_dir, "events")
    s = e.groupBy("user_id").agg(F.collect_set(F.concat(F.lit("Step"), (F.col("event_id") % 7).cast("string"))).alias("executed_steps"), F.count_if(F.col("event_type") == "view").alias("n5"), F.bool_or(F.col("event_type") == "purchase").alias("retrieval_used"), F.count("*").alias("available_sections"))
    m = F.when(F.col("user_id") % 3 == 0, "M1").when(F.col("user_id") % 3 == 1, "M2").otherwise("M8")
    none = {c: F.lit(None).cast(t) for c, t in {"expert_prompt_used": "boolean", "chapter_only_mode": "boolean", "skip_section_ranking": "boolean", "step5_selection_mode": "string", "p_solve": "double", "confidence_threshold": "double", "m5_gate_triggered_retrieval": "boolean", "ok1": "boolean", "ok3": "boolean", "ok4": "boolean", "ok5": "boolean"}.items()}
    sources = F.when((m == "M2") | (F.col("user_id") % 5 == 0), 0).otherwise(1)
    s = s.withColumns({"mode": m, "n1": F.lit(0), "n2": F.lit(0), "n3": F.lit(0), "n4": F.lit(0), "final_sources": sources, "topk_sections": F.lit(10), "ok2": F.col("user_id") % 4 != 0, **none})
    return s.select("user_id", F.array_join(Q.conformance(), ",").alias("codes"))


@query("""
select doc_id, start, substr(text, start::int + 1, 400) chunk from (select doc_id, text, unnest(range(0, length(text), 360)) start from documents where n_chars < 5000) 
""")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """overlapping chunks by code points. As its SQL, only documents under 5,000 characters."""
    return _chunks(table(spark, sf_dir, "documents").where("n_chars < 5000"))


@query()
def chunk_overlap_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the same over all documents (unit-tested; no SQL)."""
    return _chunks(table(spark, sf_dir, "documents"))


def _chunks(docs: DataFrame) -> DataFrame:
    d = docs.select("doc_id", "text", F.explode(X.chunk_starts(F.col("text"), 400, 40)).alias("start"))
    return d.select("doc_id", F.col("start").cast("bigint").alias("start"), F.substring("text", F.col("start") + 1, F.lit(400)).alias("chunk"))


LINES = f"list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: {STRIP('x')}), lambda x: x <> '')"


@query(f"""
select doc_id, len(ls) num_lines, len(list_filter(ls, lambda x: regexp_matches(x, '[A-Za-z\\x{{4e00}}-\\x{{9fff}}]'))) alpha_lines, len(list_filter(ls, lambda x: regexp_matches(x, '\\d$'))) tail_digit_lines,
  length({STRIP('text')}) md_len, coalesce(list_max(list_filter(list_transform(ls[1:200], lambda x: try_cast(nullif(regexp_extract(x, '(\\d{{1,4}})$', 1), '') as int)), lambda x: x is not null)), 0) max_page_num
from (select doc_id, text, {LINES} ls from documents)
""")
def line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the lines of a text."""
    d = _lined(spark, sf_dir).select("doc_id", Q.toc_line_stats(F.col("text"), F.col("ls")).alias("s"))
    return d.select("doc_id", *[F.col(f"s.{c}").cast("bigint" if c != "max_page_num" else "int").alias(c) for c in ("num_lines", "alpha_lines", "tail_digit_lines", "md_len", "max_page_num")])


@query(f"""
select doc_id, case when len(ls) = 0 then 0.0 else least(1.0, (case when regexp_matches(lower(text), 'license') then 0.45 else 0 end + case when regexp_matches(lower(text), 'mail|http') then 0.25 else 0 end
  + case when len(list_filter(ls[1:200], lambda x: regexp_matches(x, '\\d$'))) >= 10 then 0.35 else 0 end + case when len(list_filter(ls[1:200], lambda x: regexp_matches(x, '\\.{{3,}}\\s*\\d$|…'))) >= 8 then 0.20 else 0 end)) end::double AS toc_score
from (select doc_id, text, {LINES} ls from documents)
""")
def toc_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score from words, numbers at line ends and leaders."""
    return _lined(spark, sf_dir).select("doc_id", Q.toc_likeness(F.col("text"), "license", "mail|http", F.col("ls")).alias("toc_score"))


@query(f"""
with f as (select page_id, list_distinct(list_filter(list_transform(list_concat(ls[1:4], ls[greatest(1, len(ls) - 3):len(ls)]), lambda x: regexp_extract(x, '^[-–—\\s]*(\\d{{1,4}})[-–—\\s]*$', 1)), lambda x: x <> '')) v
  from (select page_id, list_filter(list_transform(string_split_regex(t, '\\r?\\n'), lambda x: {STRIP('x')}), lambda x: x <> '') ls from (select page_id, regexp_replace(html, '<[^>]*>|[^0-9<>]+', chr(10), 'g') t from pages)))
select page_id, case when len(v) = 1 then v[1]::int end AS "label" from f
""")
def page_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The only number that stands alone near a page's edge."""
    t = F.regexp_replace("html", "<[^>]*>|[^0-9<>]+", "\n")
    return table(spark, sf_dir, "pages").select("page_id", Q.page_label(t).alias("label"))


@query(f"""
select doc_id, case when md_len < 220 then 'too_short' when n < 12 then 'too_few_lines' when alpha < 6 then 'too_few_alpha_lines' else 'other' end verdict
from (select doc_id, length({STRIP('text')}) md_len, len({LINES}) n, len(list_filter({LINES}, lambda x: regexp_matches(x, '[A-Za-z\\x{{4e00}}-\\x{{9fff}}]'))) alpha from documents)
""")
def toc_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against a contents page; later reasons are pooled, their rules are unit-tested."""
    stats = _lined(spark, sf_dir).select("doc_id", Q.toc_line_stats(F.col("text"), F.col("ls")).alias("s"))
    v = Q.toc_verdict(F.col("s"))
    return stats.select("doc_id", F.when(v.isin("too_short", "too_few_lines", "too_few_alpha_lines"), v).otherwise("other").alias("verdict"))


@query("select p_partkey, case when length(n) <= 12 then n else regexp_replace(left(n, 3), '[ ._]+$', '') || '_' || left(sha1(n), 8) end file_name from (select p_partkey, regexp_replace(p_name || ':' || p_type, '[:/ ]+', '_', 'g') n from part)")
def safe_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names without forbidden characters, cut to a length with a part of their hash."""
    n = F.regexp_replace(F.concat("p_name", F.lit(":"), "p_type"), "[:/ ]+", "_")
    return table(spark, sf_dir, "part").select("p_partkey", X.safe_filename(n, 12).alias("file_name"))


@query("select event_id, try_cast(regexp_extract(props, '\"[a-z_]+\":\\s*([0-9]+)', 1) as int) num, strpos(props, '{') > 0 has_object from events")
def json_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the object inside a reply, and a number saved from it by pattern."""
    e = table(spark, sf_dir, "events")
    wrapped = F.concat(F.lit("Sure: "), F.col("props"), F.lit(" done"))
    num = F.nullif(F.regexp_extract(X.json_object(wrapped), r'"[a-z_]+":\s*([0-9]+)', 1), F.lit("")).try_cast("int")
    return e.select("event_id", num.alias("num"), X.json_object(wrapped).isNotNull().alias("has_object"))


@query("""
select n, (n // 1000 * 0 + n)::int AS "value" from (select unnest(range(1, 400)) n)
""")
def roman_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman numerals of 1 to 399, built by place value and read back by one fold."""
    place = lambda d, one, five, ten: F.element_at(F.array(F.lit(""), *[F.lit(x) for x in (one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (d + 1).cast("int"))
    n = F.col("n")
    text = F.concat(place(F.floor(n / 100), "c", "d", "m"), place(F.floor(n / 10) % 10, "x", "l", "c"), place(n % 10, "i", "v", "x"))
    return spark.range(1, 400).withColumnRenamed("id", "n").select("n", X.roman(text).alias("value"))


@query("select c_custkey, lower(regexp_replace(trim(regexp_replace(c_name || ' (' || c_mktsegment || ')', '[^A-Za-z0-9_]+', ' ', 'g')), ' +', ' ', 'g')) title, regexp_replace(lower(c_name), '[^0-9a-z]+', '', 'g') AS \"key\" from customer")
def normalised_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """two ways to bring a title into normal form."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", X.normalise_title(F.concat(F.lit(r"\section*{"), "c_name", F.lit("} ("), "c_mktsegment", F.lit(")"))).alias("title"), X.normalise_key(F.col("c_name")).alias("key"))


@query("""
with s as (select regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g') k, min(p_partkey) p from part group by 1)
select s_suppkey, p part_key from (select s_suppkey, (s_suppkey * 3) % 200 + 1 pk from supplier) x join part on p_partkey = pk join s on s.k = regexp_replace(lower(p_name), '[^0-9a-z]+', '', 'g')
""")
def title_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup by normalised title; of equal titles the first id."""
    part = table(spark, sf_dir, "part").select("p_partkey", X.normalise_key(F.col("p_name")).alias("k"))
    first = part.groupBy("k").agg(F.min("p_partkey").alias("part_key"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 3) % 200 + 1).alias("p_partkey"))
    return s.join(part, "p_partkey").join(first, "k").select("s_suppkey", "part_key")


@query("select doc_id, regexp_extract(text, '^\\s*(\\d{1,3})\\b', 1) = '' no_number, round(case when length(text) > 0 then length(regexp_replace(text, '[\\p{L}\\p{N}\\s]', '', 'g')) / length(text) else 0 end, 6) symbols, round(case when length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 6 then length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / length(regexp_replace(text, '[^\\p{L}]', '', 'g')) end, 6) capitals from documents")
def noise_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of signs and capitals."""
    t = F.col("text")
    return _docs(spark, sf_dir, X.leading_int(t).isNull().alias("no_number"), F.round(X.symbol_ratio(t), 6).alias("symbols"), F.round(X.capitals_share(t), 6).alias("capitals"))


@query("select doc_id, case when length(text) > 100 then left(text, 99) || '…' else text end cut, left(text, 100) AS head, right(text, 60) tail, sha1(text) digest from documents")
def truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts with and without a mark, a tail, a hash."""
    t = F.col("text")
    return _docs(spark, sf_dir, X.truncate_marked(t, 100).alias("cut"), X.truncate(t, 100).alias("head"), F.right(t, F.lit(60)).alias("tail"), F.sha1(t).alias("digest"))


@query("select event_id, case lower(b) when 'true' then true when '1' then true when 'yes' then true when 'false' then false when '0' then false when 'no' then false end flag, try_cast(nullif(d, '') as double) num from (select event_id, case event_id % 6 when 0 then 'Yes' when 1 then 'no' when 2 then '1' when 3 then '' when 4 then 'maybe' else 'FALSE' end b, case event_id % 3 when 0 then '' when 1 then 'bad' else value::varchar end d from events)")
def safe_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tolerant booleans and numbers."""
    k = F.col("event_id") % 6
    b = F.when(k == 0, "Yes").when(k == 1, "no").when(k == 2, "1").when(k == 3, "").when(k == 4, "maybe").otherwise("FALSE")
    d = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, "bad").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", X.safe_bool(b).alias("flag"), X.safe_double(d).alias("num"))


@query("""
with f as (select item_id, regexp_matches(text, 'the.*and') mp, regexp_matches(lower(text), 'tion') gs, length(text) % 100 / 100.0 conf, length(text) % 2 = 0 suff, length(text) % 5 = 0 tools from benchmark)
select item_id, case when not suff then 'retrieve_due_to_not_direct_sufficient' when tools then 'retrieve_due_to_positive_tool_utility' when conf < (case when mp or gs then 0.91 else 0.88 end) then 'retrieve_due_to_low_confidence' else 'early_exit_confident_and_low_utility' end reason,
       (case when mp or gs then 0.91 else 0.88 end)::double AS threshold from f
""")
def retrieval_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question flags and the first reason to retrieve, with patterns that occur in these texts."""
    n = F.length("text")
    flags = Q.question_flags(F.col("text"), "the.*and", "zzzz", "(?i)tion", "zzzz")
    b = table(spark, sf_dir, "benchmark").select("item_id", flags.alias("flags"), (n % 2 == 0).alias("suff"), (n % 5 == 0).alias("tools"), (n % 100 / 100.0).alias("conf"))
    gate = Q.retrieval_gate(F.col("flags"), F.col("suff"), F.col("tools"), F.col("conf"), F.array().cast("array<string>"), F.lit(0))
    return b.select("item_id", gate.alias("g")).select("item_id", F.col("g.reason").alias("reason"), F.col("g.threshold").alias("threshold"))


@query("select doc_id, array_to_string(list_filter([case when quality is null then 'missing_score:overall' end, case when quality * 20 not between 0 and 10 then 'score_out_of_range:overall' end, case when toxic is null then 'missing_should_use_tools' end, case when n_chars / 10000.0 > 1 then 'confidence_out_of_range' end], lambda x: x is not null), ',') errors from documents left join labels using (doc_id)")
def judge_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes for missing and impossible scores."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.array_join(Q.judge_errors({"overall": F.col("quality") * 20}, F.col("toxic") == 1, F.col("n_chars") / 10000.0), ",").alias("errors"))


@query("select doc_id, case when doc_id % 4 = 0 and not exists (select 1 from labels l where l.doc_id = d.doc_id) then 'exception' when not exists (select 1 from labels l where l.doc_id = d.doc_id) then 'missing_qa_result' when doc_id % 9 = 0 then 'report_error' else '' end error_type from documents d")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of error from what files are there."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("has")), "doc_id", "left")
    none = F.col("has").isNull()
    return d.select("doc_id", F.when(none & (F.col("doc_id") % 4 == 0), "exception").when(none, "missing_qa_result").when(F.col("doc_id") % 9 == 0, "report_error").otherwise("").alias("error_type"))


@query("select conv_id, turn, q.line from (select conv_id, turn, unnest(string_split(text, '. ')) line from conversations) q where length(q.line) between 20 and 60")
def excerpt_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P25: excerpts of a useful length."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.split("text", r"\. ")).alias("line"))
    return c.where(F.length("line").between(20, 60))


@query("select p_partkey, case when regexp_matches(t, '(?i)^(chapter|chap\\.?)\\s+([0-9]{1,3}|[ivxlcdm]{1,10})\\b') then 'strict' when regexp_matches(t, '^[0-9]{1,3}\\s*\\.\\s*[0-9]') then 'decimal' when regexp_matches(t, '^[0-9]{1,3}\\b') then 'loose' else 'none' end kind, try_cast(nullif(regexp_extract(t, '([0-9]{1,3})', 1), '') as int) AS \"number\" from (select p_partkey, case p_partkey % 4 when 0 then 'Chapter ' || (p_partkey % 90 + 1) when 1 then (p_partkey % 90 + 1) || '.' || p_size || ' x' when 2 then (p_partkey % 90 + 1) || ' ' || p_type else 'Name' end t from part)")
def heading_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much a title looks like a chapter heading, and its number."""
    n, k = (F.col("p_partkey") % 90 + 1).cast("string"), F.col("p_partkey") % 4
    t = F.when(k == 0, F.concat(F.lit("Chapter "), n)).when(k == 1, F.concat(n, F.lit("."), F.col("p_size").cast("string"), F.lit(" x"))).when(k == 2, F.concat(n, F.lit(" "), "p_type")).otherwise("Name")
    return table(spark, sf_dir, "part").select("p_partkey", Q.chapter_like(t).alias("kind"), X.heading_number(t).alias("number"))


@query("select page_id, unit, side from (select page_id, page_id % 3 = 0 two, unnest(case when page_id % 3 = 0 then [0, 1] else [0] end) i, from pages), lateral (select case when two then page_id * 2 + i else page_id end unit, case when not two then '' when i = 0 then 'L' else 'R' end side)")
def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of pages, two for a two-up one."""
    p = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 3 == 0).alias("two_up"))
    return R.page_units(p, "page_id").select("page_id", "unit", "side")


@query("select supplier.s_suppkey, lpad((s_suppkey % 100)::varchar, 2, '0') || '_' || replace(regexp_replace(s_name, '[#/:]+', '_', 'g'), '#', '_') || '.txt' file_name from supplier")
def split_file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of chapter files."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 100).alias("no"), F.regexp_replace("s_name", "[#/:]+", "_").alias("title"))
    return K.split_texts(s).select("s_suppkey", "file_name")


@query("select n_regionkey, string_agg('===== CHAPTER ' || n_nationkey || ': ' || n_name || ' =====' || chr(10) || lower(n_name), chr(10) order by n_nationkey) marked from nation group by 1")
def marked_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One marked text a book."""
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name", F.lower("n_name").alias("body"))
    return K.marked_text(n, ["n_regionkey"], "n_nationkey", "n_name", "body")


@query("select c_custkey::varchar c_custkey, c_name, c_acctbal::varchar >= '' filled, coalesce(nullif(c_mktsegment, ''), '') c_mktsegment from customer")
def flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as a CSV sink writes them: preferred columns first, all text, null empty."""
    c = K.flat(table(spark, sf_dir, "customer"), ["c_custkey", "c_name"])
    return c.select("c_custkey", "c_name", (F.col("c_acctbal") >= "").alias("filled"), "c_mktsegment")


@query("select s_suppkey::varchar || chr(9) || s_name || chr(9) || (s_acctbal > 0)::int::varchar || chr(9) || array_to_string(list_filter([case when s_acctbal <= 0 then 'debt' end, case when s_nationkey < 5 then 'near' end], lambda x: x is not null), ';') AS \"value\" from supplier")
def registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a registry with flags and notes."""
    s = table(spark, sf_dir, "supplier").withColumn("usable", F.col("s_acctbal") > 0).withColumn("notes", K.notes(("debt", F.col("s_acctbal") <= 0), ("near", F.col("s_nationkey") < 5)))
    return K.registry_rows(s, ["s_suppkey", "s_name", "usable", "notes"])


@query()
def normalize_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the matching form of each text with its map into the raw one (unit-tested; no SQL)."""
    d = V.match_forms(_docs(spark, sf_dir, "text"), "doc_id", "text")
    return d.select("doc_id", F.length("text").alias("n"), F.array_max("at").alias("last"), F.sha1("text").alias("digest"))


@query()
def tex_shadow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts with markup blanked, of the same length (unit-tested; no SQL)."""
    return _docs(spark, sf_dir, V.tex_shadow_udf("text").alias("shadow")).select("doc_id", F.length("shadow").alias("n"), F.sha1("shadow").alias("digest"))


@query()
def parsed_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """headings found in texts, each of which opens with one of four kinds (unit-tested; no SQL)."""
    n, k = (F.col("doc_id") % 90 + 1).cast("string"), F.col("doc_id") % 4
    head = F.when(k == 0, F.concat(F.lit("Chapter "), n, F.lit(" begins"))).when(k == 1, F.concat(F.lit("\\section{Part "), n, F.lit("}"))).when(k == 2, F.concat(n, F.lit(".2 Results"))).otherwise("第十二章 热")
    return _docs(spark, sf_dir, F.explode(V.headings_udf(F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))))).alias("h")).select("doc_id", "h.*")


@query()
def phrase_window_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts against the windows of documents they share a word with; exact hits first, then fuzzy ones (no SQL)."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != ""))
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    tok = d.select("doc_id", words(F.col("text")).alias("tokens"))
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    near = J.token_overlap(tok, b.select("item_id", words(F.col("phrase")).alias("tokens")), "doc_id", "item_id").select("doc_id", "item_id")
    w = d.select("doc_id", "text", F.explode(X.probe_windows(F.col("text"), 400)).alias("w")).select("doc_id", F.col("w.name").alias("window"), F.expr("substring(text, w.start + 1, 400)").alias("part"))
    # Scoring costs far more than its bytes tell, so windows are dealt to as many tasks as a shuffle has.
    m = near.groupBy("doc_id").agg(F.collect_list("item_id").alias("items")).join(w, "doc_id")
    m = m.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "window")
    m = m.select("doc_id", "window", "part", F.explode("items").alias("item_id")).join(b, "item_id")
    fuzzy = V.partial_similarity_udf("phrase", "part")
    return m.select("doc_id", "item_id", "window", F.when(F.contains("part", F.col("phrase")), 1.0).otherwise(fuzzy).alias("score"))
