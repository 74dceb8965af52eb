"""Evaluation path: joined metrics, summaries, repeats, pivots, deltas, failures and robust statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import aggs as A
from ..operators import joins as J
from ..session import table
from .registry import query

TYPES = ("click", "error", "purchase", "signup", "view")


@query("""
select lang, count(*) items, round(avg(case when coalesce(quality, 0) = 1 then 1.0 else 0.0 end), 6) ok_rate,
       coalesce(round(avg(toxic), 6), 0.0) toxic_mean, round(avg(n_chars), 6) chars_mean
from documents d left join labels l on d.doc_id = l.doc_id group by lang
""")
def mode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join of judged labels, summary by mode; an empty mean is 0."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.select("doc_id", "lang", "n_chars").join(lab, "doc_id", "left")
    return j.groupBy("lang").agg(
        F.count("*").alias("items"), F.round(F.avg((F.coalesce("quality", F.lit(0)) == 1).cast("double")), 6).alias("ok_rate"),
        F.coalesce(F.round(F.avg("toxic"), 6), F.lit(0.0)).alias("toxic_mean"), F.round(F.avg("n_chars"), 6).alias("chars_mean"),
    )


@query("""
select user_id, event_type, event_id judge_event_id, value judge_value, quality judge_quality from (
  select user_id, event_type, event_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) e
left join (select doc_id, quality from labels) l on l.doc_id = e.user_id where r = 1
""")
def combined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user (last wins), joined with its label, right columns prefixed."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    left = J.latest(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", F.col("event_id").alias("judge_event_id"), F.col("value").alias("judge_value"))
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("user_id"), "quality")
    return J.last_wins_left_join(left, lab, ["user_id"], ["quality"], "judge_")


@query("""
select source, round(avg(case when coalesce(quality, 0) = 1 then 1.0 else 0.0 end), 6) rate_missing_false,
       round(avg(quality::double), 6) rate_missing_excluded, count(quality) known
from documents d left join labels l using (doc_id) group by source
""")
def rate_semantics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two rates side by side: missing as false, and missing left out."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    ok = F.col("quality") == 1
    return j.groupBy("source").agg(F.round(A.rate_missing_false(ok), 6).alias("rate_missing_false"), F.round(A.rate_missing_excluded(ok), 6).alias("rate_missing_excluded"), F.count("quality").alias("known"))


REPEATS = """
select user_id, event_type, count(*) n_runs, sum(case when value > 0 then 1 else 0 end)::bigint ok_runs, sum(case when value > 0 then 0 else 1 end)::bigint failed_runs,
       round(avg(value), 6) value_mean, round(stddev_pop(value), 6) value_std, round(min(value), 6) value_min, round(max(value), 6) value_max
from events group by user_id, event_type
"""


@query(REPEATS)
def repeat_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of repeated runs of a question under a mode."""
    return A.repeat_stats(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", F.col("value") > 0)


@query(f"select event_type, count(*) questions, round(avg(value_mean), 6) value_mean, round(avg(value_std), 6) value_std from ({REPEATS}) group by event_type")
def repeat_mode_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of means that are already rounded."""
    stats = A.repeat_stats(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", F.col("value") > 0)
    return A.mean_of_means(stats, "event_type", "value_mean", "value_std")


@query("select user_id, " + ", ".join(f"arg_max(value, (ts, event_id)) filter (where event_type = '{t}') \"{t}_value\"" for t in TYPES) + " from events group by user_id")
def pivot_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a question, one column a mode; the last value wins."""
    return A.pivot_last(table(spark, sf_dir, "events"), "user_id", "event_type", list(TYPES), "value", ["ts", "event_id"], "_value")


@query("""
with m as (select user_id, event_type, round(avg(value), 6) v from events group by all)
select a.user_id, a.event_type, a.v mode_value, b.v baseline_value, round(a.v - b.v, 6) delta
from m a join m b on a.user_id = b.user_id and b.event_type = 'view' where a.event_type <> 'view'
""")
def delta_vs_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mode's mean less the baseline mode's, where both are there."""
    m = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("mode_value"))
    return A.delta_vs_baseline(m, "user_id", "event_type", "mode_value", "view").select("user_id", "event_type", "mode_value", "baseline_value", "delta")


@query("select distinct doc_id from (select doc_id from documents union all select doc_id from labels union all select item_id from benchmark)")
def key_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct keys of three tables."""
    return J.key_spine(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id"), key="doc_id")


@query("select doc_id, lang from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def missing_judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label."""
    return J.missing(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
select doc_id, lang, source, coalesce(quality, -1) quality from documents d left join labels using (doc_id)
where exists (select 1 from labels l where l.doc_id = d.doc_id) or n_chars > 2000
""")
def enrich_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left joins to dimension tables by key."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.where(F.col("quality").isNotNull() | (F.col("n_chars") > 2000)).select("doc_id", "lang", "source", F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""
select user_id, event_id, event_type, value from (
  select *, row_number() over (partition by user_id order by (ts >= timestamp '2024-01-16')::int desc, ts desc, event_id desc) r from events) where r = 1
""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the month is merged over the first; per user the last new row wins."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts")
    cut = F.lit("2024-01-16").cast("timestamp")
    return J.upsert(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""
select e.user_id, e.user_id % 10 batch, row_number() over (partition by e.user_id % 10 order by o.o_orderkey nulls last, e.user_id) pos
from (select distinct user_id from events) e left join (select o_custkey, min(o_orderkey) o_orderkey from orders group by 1) o on o.o_custkey = e.user_id
""")
def ordered_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's rows in known order, leftovers behind."""
    e = table(spark, sf_dir, "events").select("user_id").distinct()
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.min("o_orderkey").alias("first_order"))
    j = e.join(o, "user_id", "left").withColumn("batch", F.col("user_id") % 10)
    return j.select("user_id", "batch", F.row_number().over(Window.partitionBy("batch").orderBy(F.asc_nulls_last("first_order"), "user_id")).cast("bigint").alias("pos"))


@query("""
select d.doc_id, coalesce(nullif(c.text, ''), nullif(b.text, ''), nullif(left(d.text, 50), '')) AS value,
       case when nullif(c.text, '') is not null then 1 when nullif(b.text, '') is not null then 2 when nullif(left(d.text, 50), '') is not null then 3 else 0 end origin
from documents d left join (select conv_id, arg_min(text, turn) as text from conversations group by 1) c on c.conv_id = d.doc_id left join benchmark b on b.item_id = d.doc_id
""")
def fallback_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text from the first of three sources that has one."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(50)).alias("head"))
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("text", "turn").alias("text"))
    b = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "doc_id")
    return J.fallback_chain(d.select("doc_id"), "doc_id", (c, "text"), (b, "text"), (d, "head"))


@query("select c_mktsegment, count(*) n, coalesce(sum((c_acctbal > 0)::int), 0)::bigint ok_count, coalesce(sum((c_acctbal <= 0)::int), 0)::bigint fail_count from customer group by 1")
def ok_fail_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of successes and failures."""
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("ok_count"), F.count_if(F.col("c_acctbal") <= 0).alias("fail_count"))


FLAGS = """
select doc_id, unnest(list_filter([case when quality is null then 'missing_label' end, case when toxic = 1 then 'toxic' end, case when quality = 0 then 'poor' end,
       case when n_chars < 200 then 'short' end, case when contains(text, '!!') then 'shouting' end], lambda x: x is not null)) reason
from documents left join labels using (doc_id)
"""


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    reasons = X.codes(("missing_label", F.col("quality").isNull()), ("toxic", F.col("toxic") == 1), ("poor", F.col("quality") == 0), ("short", F.col("n_chars") < 200), ("shouting", F.col("text").contains("!!")))
    return d.select("doc_id", reasons.alias("reasons"))


@query(FLAGS)
def failure_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and reason."""
    return _reasons(spark, sf_dir).select("doc_id", F.explode("reasons").alias("reason"))


@query(f"select reason item, count(*) n from ({FLAGS}) group by reason")
def reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each reason occurs."""
    return A.list_counts(_reasons(spark, sf_dir), "reasons")


@query(f"select doc_id % 10 batch, count(*) reasons_total, count(distinct doc_id) failed from ({FLAGS}) group by 1")
def failure_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of list sizes a batch."""
    r = _reasons(spark, sf_dir).where(F.size("reasons") > 0)
    return r.groupBy((F.col("doc_id") % 10).alias("batch")).agg(F.sum(F.size("reasons")).alias("reasons_total"), F.count("*").alias("failed"))


@query("""
select event_id, user_id, event_type, last_value(case when event_type = 'view' then value end ignore nulls) over
       (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) previous_view from events
""")
def asof_previous_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest view strictly before each event."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    return J.asof_before(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("value")), "previous_view").select("event_id", "user_id", "event_type", "previous_view")


@query("""
with p as (select event_id, user_id, floor(epoch(ts))::bigint p_at from events where event_type = 'purchase'),
v as (select event_id view_id, user_id, floor(epoch(ts))::bigint v_at, value from events where event_type = 'view')
select event_id, view_id, round(score, 6) score from (
  select p.event_id, view_id, value - abs(p_at - v_at) / 14400.0 score, row_number() over (partition by p.event_id order by value - abs(p_at - v_at) / 14400.0 desc, view_id) r
  from p join v on p.user_id = v.user_id and abs(p_at - v_at) <= 14400) where r = 1
""")
def band_join_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the best view of its user within four hours."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_timestamp("ts").alias("at"), "value", "event_type")
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    v = e.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("at").alias("v_at"), "value")
    score = F.col("value") - F.abs(F.col("at") - F.col("v_at")) / 14400.0
    return J.band_join_best(p, v, ["user_id"], "at", "v_at", 14400, score, ["view_id"], "event_id").select("event_id", "view_id", F.round("score", 6).alias("score"))


@query("""
with e as (select event_id, user_id, event_id pos, case when event_type = 'view' then value end known from events),
w as (select *, last_value(case when known is not null then pos end ignore nulls) over b x0, last_value(known ignore nulls) over b y0,
      first_value(case when known is not null then pos end ignore nulls) over a x1, first_value(known ignore nulls) over a y1 from e
      window b as (partition by user_id order by pos rows between unbounded preceding and current row), a as (partition by user_id order by pos rows between current row and unbounded following))
select event_id, user_id, round(coalesce(y0 + (y1 - y0) * (pos - x0) / nullif(x1 - x0, 0), y0, y1) + 1e-8, 6) filled from w
""")
def interpolate_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values between two known ones lie on the line through them."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("event_type") == "view", F.col("value")).alias("known"))
    return J.interpolate(e, ["user_id"], "event_id", "known", "filled").select("event_id", "user_id", F.round(F.col("filled") + 1e-8, 6).alias("filled"))


@query("""
select event_type, user_id, n, case when n < 2 or sx < 1e-6 or sy < 1e-6 then 0.0 else round(c / (sx * sy), 6) end rho from (
  select event_type, user_id, count(*) n, stddev_pop(rx) sx, stddev_pop(ry) sy, covar_pop(rx, ry) c from (
    select event_type, user_id, rank() over (partition by event_type, user_id order by value) + (count(*) over (partition by event_type, user_id, value) - 1) / 2.0 rx,
           rank() over (partition by event_type, user_id order by ts) + (count(*) over (partition by event_type, user_id, ts) - 1) / 2.0 ry from events) group by all)
""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of value and time for each user and type."""
    return A.spearman(table(spark, sf_dir, "events").select("event_type", "user_id", "value", "ts"), ["event_type", "user_id"], "value", "ts").select("event_type", "user_id", "n", F.round("rho", 6).alias("rho"))


POINTS = "select o_custkey cust, o_orderkey pos, o_totalprice / 1000 y, (epoch(o_orderdate) / 86400.0) x from orders where o_orderpriority like '1%'"
LINE = f"""
with p as ({POINTS}),
s as (select a.cust, median((b.y - a.y) / (b.x - a.x)) raw from p a join p b on a.cust = b.cust and a.pos < b.pos and a.x <> b.x group by 1),
l as (select cust, case when raw between 0.6 and 1.4 then raw else 1.0 end slope from s),
m as (select cust, slope, median(y - slope * x) intercept from p join l using (cust) group by 1, 2)
select cust, slope, intercept, median(abs(y - (slope * x + intercept))) mad, count(*) n from p join m using (cust) group by 1, 2, 3
"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderpriority", F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("pos"), (F.col("o_totalprice") / 1000).alias("y"), (F.unix_timestamp("o_orderdate") / 86400.0).alias("x"))


@query(f"select cust, round(slope + 1e-8, 6) slope, round(intercept + 1e-6, 4) intercept, round(mad + 1e-6, 4) mad, n, round(greatest(0.0, least(0.99, 1 - mad / 300)), 6) conf from ({LINE})")
def theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robust line through each group's points, with its spread and a confidence. As its SQL, only orders of the first priority."""
    return _lines_through(_points(spark, sf_dir).where(F.col("o_orderpriority").like("1%")))


@query()
def theil_sen_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all orders (unit-tested; no SQL)."""
    return _lines_through(_points(spark, sf_dir))


def _lines_through(points: DataFrame) -> DataFrame:
    r = A.robust_line(points.drop("o_orderpriority"), ["cust"], "x", "y", "pos", most_err=300.0)
    return r.select("cust", F.round(F.col("slope") + 1e-8, 6).alias("slope"), F.round(F.col("intercept") + 1e-6, 4).alias("intercept"), F.round(F.col("mad") + 1e-6, 4).alias("mad"), "n", F.round("conf", 6).alias("conf"))


@query()
def refit_without_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poor fits lose their extreme points and are fitted again (unit-tested; no SQL)."""
    return A.clean_and_refit(_points(spark, sf_dir).drop("o_orderpriority"), ["cust"], "x", "y", "pos", most_err=60.0)


@query("""
select o_custkey cust, max(d) - min(d) spread, count(*) n, case when count(*) >= 3 and max(d) - min(d) <= 2000000 then median(d) end page_offset
from (select o_custkey, (o_orderkey - o_custkey)::double d from orders) group by 1
""")
def page_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset a group's samples agree on."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_custkey").cast("double").alias("page"), F.col("o_orderkey").cast("double").alias("unit"))
    return A.page_offset(o, ["cust"], "page", "unit", 2_000_000.0)


@query("""
select lang, bin, votes, r::int "rank" from (select lang, bin, votes, row_number() over (partition by lang order by votes desc, bin) r from (
  select lang, (n_chars // 500) * 500 bin, count(*) votes from documents group by 1, 2)) where r <= 8
""")
def seed_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fullest bins of a histogram."""
    return A.binned_top(table(spark, sf_dir, "documents").select("lang", "n_chars"), ["lang"], "n_chars", 500, 8)


@query("""
select source, case when count(distinct lang) = 1 then min(lang) else nullif(regexp_extract(upper(min(name)), '(?:^|[^A-Z0-9])(M[1-9])(?:[^0-9]|$)', 1), '') end AS mode,
       try_cast(nullif(regexp_extract(lower(min(name)), 'k(?:=|_)?([0-9]+)', 1), '') as int) k
from (select source, lang, 'run_m' || (1 + length(source) % 9) || '_k' || substr(source, 4) AS name from documents) group by source
""")
def mode_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's mode from its rows, else from its name."""
    d = table(spark, sf_dir, "documents")
    named = d.select("source", "lang", F.concat(F.lit("run_m"), (1 + F.length("source") % 9).cast("string"), F.lit("_k"), F.substring("source", 4, 10)).alias("name"))
    return A.inferred_mode(named, "source", "lang", "name")


@query("""
select conv_id, string_agg(role || ': ' || left(text, 40), chr(10) order by turn) as transcript, sum(length(text))::bigint chars_total from conversations group by conv_id
""")
def ordered_transcript(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts joined in order, and their total length."""
    c = table(spark, sf_dir, "conversations")
    lines = c.select("conv_id", "turn", F.concat("role", F.lit(": "), F.left("text", F.lit(40))).alias("line"))
    total = c.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars_total"))
    return A.ordered_text(lines, ["conv_id"], ["turn"], "line", "\n", "transcript").join(total, "conv_id")


@query("""
select n_nationkey, coalesce(nullif(n_nationkey % 3, 0)::bigint, c.n, 0) children from nation left join (select c_nationkey, count(*) n from customer group by 1) c on c_nationkey = n_nationkey
""")
def count_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored count, else the children counted."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") % 3).alias("stored"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return n.join(c, "n_nationkey", "left").select("n_nationkey", F.coalesce(F.nullif(F.col("stored"), F.lit(0)).cast("bigint"), "n", F.lit(0)).alias("children"))


@query("select source, sha1(string_agg(doc_id || ':' || sha1(text), chr(10) order by doc_id::varchar)) content_hash from documents group by source")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash over a folder's files in path order."""
    d = table(spark, sf_dir, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.sha1("text").alias("digest"))
    return A.folder_hash(d, ["source"], "path", "digest")


@query("""
select lang, count(*)::bigint segments, round(sum((n_chars >= 500)::int) / greatest(1, count(*)), 6) ok_ratio,
       round(sum(case when n_chars >= 500 then least(1.0, n_chars / 3000.0) else 0 end) / greatest(1, sum((n_chars >= 500)::int)), 6) avg_hit from documents group by lang
""")
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: share of verified segments and their mean hit ratio; denominators are at least 1."""
    ok = F.col("n_chars") >= 500
    n, hits = F.count("*"), F.count_if(ok)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(n.alias("segments"), F.round(hits / F.greatest(F.lit(1), n), 6).alias("ok_ratio"), F.round(F.sum(F.when(ok, F.least(F.lit(1.0), F.col("n_chars") / 3000.0)).otherwise(0.0)) / F.greatest(F.lit(1), hits), 6).alias("avg_hit"))


@query("""
select 'a' batch_id, user_id, event_type, value, null::varchar props from events where event_type = 'error'
union all by name select 'b' batch_id, user_id, event_type, null::double as value, props from events where event_type = 'signup'
""")
def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with different columns, each row with its batch."""
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'error'").select(F.lit("a").alias("batch_id"), "user_id", "event_type", "value")
    b = e.where("event_type = 'signup'").select(F.lit("b").alias("batch_id"), "user_id", "event_type", "props")
    return a.unionByName(b, allowMissingColumns=True)
