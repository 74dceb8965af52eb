"""Selection path: policies, ranked picks, budgets, spans and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import quality as Q
from ..operators import windows as W
from ..session import table
from .registry import query


@query("""
select l_orderkey, l_partkey, pos, r::int "rank" from (select l_orderkey, l_partkey, pos, row_number() over (partition by l_orderkey order by pos, l_partkey) r from (
  select l_orderkey, l_partkey, min(l_linenumber) pos from lineitem where l_partkey in (select p_partkey from part where p_size <= 25) group by 1, 2)) where r <= 3
""")
def allowed_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid ids at their first place, at most three a group."""
    ranked = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("pos"))
    allowed = table(spark, sf_dir, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return J.allowed_ranked(ranked, allowed, ["l_orderkey"], "l_partkey", "pos", 3)


@query("""
select c_custkey, o_orderkey, o_orderstatus, o_totalprice from (
  select o_custkey c_custkey, o_orderkey, o_orderstatus, o_totalprice, row_number() over (partition by o_custkey order by (o_orderstatus = 'F')::int desc, o_totalprice desc, o_orderkey) r
  from orders where o_orderstatus in ('F', 'O')) where r = 1
""")
def policy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two sources, the preferred source first, then the higher score."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_totalprice")
    order = [F.desc(F.col("o_orderstatus") == "F"), F.desc("o_totalprice"), F.col("o_orderkey")]
    return J.policy_merge(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), "c_custkey", order)


@query("""
select doc_id, source, case when doc_id % 5 = 0 then 'masked' when doc_id % 5 = 1 then 'caution' when doc_id % 7 = 0 then 'secret' else 'expose' end exposure, coalesce(quality, 0) quality
from documents left join labels using (doc_id) where coalesce(quality, 0) >= 1 and doc_id % 5 <> 0 and not (doc_id % 7 = 0 and doc_id % 5 > 1)
""")
def policy_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good enough, allowed exposure, not masked."""
    exposure = F.when(F.col("doc_id") % 5 == 0, "masked").when(F.col("doc_id") % 5 == 1, "caution").when(F.col("doc_id") % 7 == 0, "secret").otherwise("expose")
    d = table(spark, sf_dir, "documents").select("doc_id", "source", exposure.alias("exposure")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.withColumn("quality", F.coalesce("quality", F.lit(0))).where(Q.exposed(F.col("quality"), F.col("exposure"), 1))


@query("""
with d as (select source, doc_id, least(n_chars, 2000) c from documents),
b as (select *, coalesce(sum(c) over (partition by source order by doc_id rows between unbounded preceding and 1 preceding), 0) before from d)
select source, doc_id, greatest(0, least(c, 20000 - before))::bigint granted from b
""")
def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A running budget of characters, each row capped."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return W.running_budget(d, ["source"], ["doc_id"], "n_chars", 2000, 20000).select("source", "doc_id", "granted")


@query("""
select source, lang, doc_id, gr::int group_rank, r::int "rank" from (select *, row_number() over (partition by source order by n_chars desc, doc_id) r from (
  select source, lang, doc_id, n_chars, row_number() over (partition by source, lang order by n_chars desc, doc_id) gr from documents) where gr <= 3) where r <= 7
""")
def topk_group_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each group under a cap of the whole."""
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return W.top_k_with_cap(d, ["source"], ["lang"], [F.desc("n_chars"), F.col("doc_id")], 3, 7).drop("n_chars")


@query("""
with x as (select source, doc_id, n_chars, n_chars > 9000 ok, sum((n_chars > 9000)::int) over (partition by source) n, row_number() over (partition by source order by doc_id) r from documents)
select source, doc_id, n_chars from x where case when n >= 2 then ok else r <= 2 end
""")
def positional_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen rows, or the first ones where too few were chosen."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", (F.col("n_chars") > 9000).alias("ok"))
    return W.positional_fallback(d, ["source"], "ok", ["doc_id"], 2, 2).drop("ok")


@query("""
with ranked as (select source, doc_id, 0 src, -n_chars ord from documents where n_chars > 6000), rest as (select source, doc_id, 1 src, doc_id ord from documents),
o as (select *, row_number() over (partition by source, doc_id order by src, ord) f from (from ranked union all from rest))
select source, doc_id, src, r::int "rank" from (select *, row_number() over (partition by source order by src, ord, doc_id) r from o where f = 1) where r <= 6
""")
def backfill_to_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked ids first, then the rule order's until the budget is full."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    ranked = d.where("n_chars > 6000").select("source", "doc_id", (-F.col("n_chars")).alias("ord"))
    return W.backfill(ranked, d.select("source", "doc_id", F.col("doc_id").alias("ord")), ["source"], "doc_id", "ord", 6).select("source", "doc_id", "src", "rank")


@query("select source, doc_id, coalesce(lead(doc_id) over (partition by source order by doc_id), 1000000) span_end from documents")
def lead_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans from each start to the next."""
    return W.spans_to_next(table(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], "doc_id", F.lit(1_000_000))


@query("""
with recursive d as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) i from documents),
r as (select source, doc_id, i, greatest(-1 + 300, n_chars) out from d where i = 1
      union all select d.source, d.doc_id, d.i, greatest(r.out + 300, d.n_chars) from d join r on d.source = r.source and d.i = r.i + 1)
select source, doc_id, out::bigint moved from r
""")
def min_gap_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recurrence as a running maximum; the SQL is the recurrence itself."""
    return W.monotone_scan(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), ["source"], "doc_id", "n_chars", 300, "moved").select("source", "doc_id", "moved")


@query("""
with recursive d as (select source, doc_id, n_chars, row_number() over (partition by source order by doc_id) i from documents),
r as (select source, doc_id, i, greatest(0, n_chars) out from d where i = 1
      union all select d.source, d.doc_id, d.i, greatest(r.out + 1, d.n_chars) from d join r on d.source = r.source and d.i = r.i + 1),
g as (select source, sum((n_chars < 400)::int) >= 3 or avg((n_chars < 400)::int) >= 0.5 repair from documents group by source)
select source, doc_id, repair, (case when repair then out else n_chars end)::bigint repaired from r join documents using (source, doc_id) join g using (source)
""")
def boundary_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with too many unreliable starts are scanned, the rest stay."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", (F.col("n_chars") < 400).alias("bad"))
    return W.repair_needed(d, ["source"], "doc_id", "n_chars", "bad").select("source", "doc_id", "repair", "repaired")


@query("select user_id, event_type, event_id first_id, value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) r from events) where r = 1")
def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each key."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return W.first_occurrences(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", F.col("event_id").alias("first_id"), "value")


@query("select p_brand, p_partkey, p_retailprice, r::int \"rank\" from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) r from part) where r <= 5")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best rows of each group with an explicit tie-break."""
    return W.top_by(table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 5)


@query("""
select user_id, event_id, distance, r::int "rank" from (select user_id, event_id, abs(event_id - 5000) distance, row_number() over (partition by user_id order by abs(event_id - 5000), event_id) r from events) where r <= 11
""")
def probe_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by distance from a centre, at most eleven."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.lit(5000).cast("long").alias("centre"))
    return W.probe_order(e, ["user_id"], "event_id", "centre").select("user_id", "event_id", "distance", "rank")


@query("""
with c as (select doc_id, p "at", abs(p - 200) + case when substr(text, p, 1) = chr(10) then 0 when substr(text, p, 1) = ' ' then 20 else 60 end penalty
  from (select doc_id, text, unnest(range(150, 251)) p from documents where n_chars >= 300) where not regexp_matches(substr(text, p - 1, 2), '^[\\p{L}\\p{N}]{2}$'))
select doc_id, "at", penalty from (select *, row_number() over (partition by doc_id order by penalty, "at") r from c) where r = 1
""")
def safe_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best place near an offset to cut a text, words never split."""
    d = table(spark, sf_dir, "documents").where("n_chars >= 300").select("doc_id", F.substring("text", 149, 102).alias("part"))
    c = d.select("doc_id", "part", F.explode(F.sequence(F.lit(150).cast("long"), F.lit(250).cast("long"))).alias("at"))
    ch, two = F.expr("substring(part, cast(at as int) - 148, 1)"), F.expr("substring(part, cast(at as int) - 149, 2)")
    penalty = F.abs(F.col("at") - 200) + F.when(ch == "\n", 0).when(ch == " ", 20).otherwise(60)
    return W.best_cut(c, ["doc_id"], "at", penalty, two.rlike(r"^[\p{L}\p{N}]{2}$")).select("doc_id", "at", "penalty")


@query("""
select p_partkey, c_custkey, score, r::int "rank" from (select *, row_number() over (partition by p_partkey order by score desc, c_custkey) r from (
  select p_partkey, c_custkey, 100 * contains(lower(c_name), lower(p_brand))::int + len(list_intersect(list_distinct(string_split(lower(p_brand), '')), list_distinct(string_split(lower(c_name), '')))) score
  from part join customer on c_custkey % 40 = p_partkey % 40 where p_partkey <= 400)) where r <= 5
""")
def name_similarity_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names ranked by containment, then by shared characters; as in its SQL, parts up to 400 and candidates from a blocking key."""
    p = table(spark, sf_dir, "part").where("p_partkey <= 400").select("p_partkey", F.lower("p_brand").alias("a"), (F.col("p_partkey") % 40).alias("k"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("b"), (F.col("c_custkey") % 40).alias("k"))
    shared = F.size(F.array_intersect(F.split("a", ""), F.split("b", "")))
    j = p.join(c, "k").select("p_partkey", "c_custkey", (100 * F.contains("b", F.col("a")).cast("int") + shared).cast("bigint").alias("score"))
    return W.top_of_many(j, ["p_partkey"], "score", "c_custkey", 5)


@query()
def name_similarity_rank_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all parts and customers; each distinct brand is ranked once (unit-tested; no SQL)."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_brand").alias("brand"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("b"))
    shared = F.size(F.array_intersect(F.split("a", ""), F.split("b", "")))
    j = c.crossJoin(p.select(F.col("brand").alias("a")).distinct()).select("a", "c_custkey", (100 * F.contains("b", F.col("a")).cast("int") + shared).cast("bigint").alias("score"))
    top = W.top_of_many(j, ["a"], "score", "c_custkey", 5)
    return p.join(top, F.col("brand").eqNullSafe(F.col("a"))).select("p_partkey", "c_custkey", "score", "rank")


@query("select doc_id from documents where lang = 'en' intersect select doc_id from labels where quality = 1")
def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in both sets."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.where("lang = 'en'").select("doc_id").intersect(lab.where("quality = 1").select("doc_id"))


@query("select doc_id, idx from (select doc_id, (row_number() over (partition by source order by doc_id))::int idx from documents) where idx between 3 and 12")
def index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slice of each batch by position."""
    return W.top_by(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")], 12).where("rank >= 3").select("doc_id", F.col("rank").alias("idx"))


@query("""
select o_orderkey, case when o_orderstatus = 'P' then 'full_rerun' when n < least(5, 1 + o_orderkey % 6) then 'resume' else 'done' end action
from orders join (select l_orderkey, count(*) n from lineitem group by 1) on l_orderkey = o_orderkey
""")
def repair_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to be run again, and from where."""
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(n, "o_orderkey")
    return o.select("o_orderkey", Q.repair_class(F.col("o_orderstatus") == "P", F.lit(True), F.col("n"), F.lit(5), 1 + F.col("o_orderkey") % 6).alias("action"))


@query("""
select s_suppkey, round(p, 6) p_solve, coalesce(p < 0.5, true) retrieve from (select s_suppkey, case when s_suppkey % 7 = 0 then null else s_acctbal / 10000 end p from supplier)
""")
def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieve below a threshold or without an estimate."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 7 != 0, F.col("s_acctbal") / 10000).alias("p"))
    return s.select("s_suppkey", F.round("p", 6).alias("p_solve"), Q.confidence_gate(F.col("p"), F.lit(0.5)).alias("retrieve"))


@query("""
select n_name, r_name, count(c_custkey) customers, round(coalesce(avg(c_acctbal), 0), 6) mean_balance from nation join region on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey
group by n_name, r_name order by n_name
""")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed lookups through small tables, in key order."""
    n, r, c = (table(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    totals = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"), F.avg("c_acctbal").alias("m"))
    j = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).join(totals, "n_nationkey", "left")
    return j.select("n_name", "r_name", F.coalesce("customers", F.lit(0)).alias("customers"), F.round(F.coalesce("m", F.lit(0.0)), 6).alias("mean_balance")).orderBy("n_name")
