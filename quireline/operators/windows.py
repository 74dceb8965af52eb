"""Window-shaped operators: spans, budgets, ranked picks and monotone scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def spans_to_next(df: DataFrame, by: list[str], start: str, end: Column) -> DataFrame:
    """Each row's span ends where the next one starts; the last one's ends at ``end``."""
    w = Window.partitionBy(*by).orderBy(start)
    return df.withColumn("span_end", F.coalesce(F.lead(start).over(w), end))


def running_budget(df: DataFrame, by: list[str], order: list[str], size: str, each: int, total: int) -> DataFrame:
    """Characters granted to each row: at most ``each``, and ``total`` for the rows in order."""
    capped = df.withColumn("__c", F.least(F.col(size).cast("long"), F.lit(each)))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return capped.withColumn("granted", F.greatest(F.lit(0), F.least(F.col("__c"), F.lit(total) - before)).cast("long")).drop("__c")


def top_k_with_cap(df: DataFrame, scope: list[str], group: list[str], order: list[Column], each: int, most: int) -> DataFrame:
    """The first ``each`` of every group, of these the first ``most`` of the scope, with their rank in it."""
    inner = F.row_number().over(Window.partitionBy(*scope, *group).orderBy(*order))
    outer = F.row_number().over(Window.partitionBy(*scope).orderBy(*order))
    return df.withColumn("group_rank", inner).where(F.col("group_rank") <= each).withColumn("rank", outer).where(F.col("rank") <= most)


def positional_fallback(df: DataFrame, by: list[str], chosen: str, order: list[str], least: int, first: int) -> DataFrame:
    """The chosen rows of each group; where they are too few, its first rows instead."""
    w = Window.partitionBy(*by)
    n = F.count_if(F.col(chosen)).over(w)
    return df.withColumn("__n", n).withColumn("__r", F.row_number().over(w.orderBy(*order))).where(F.when(F.col("__n") >= least, F.col(chosen)).otherwise(F.col("__r") <= first)).drop("__n", "__r")


def monotone_scan(df: DataFrame, by: list[str], order: str, start: str, gap: int, out: str, length: Column | None = None, seed: int = -1) -> DataFrame:
    """Starts pushed forward so that neighbours are at least a gap apart.

    The recurrence out_i = max(out_(i-1) + gap, start_i) has the closed form i*gap + max over j<=i of (start_j - j*gap), a running maximum.
    """
    w = Window.partitionBy(*by).orderBy(order)
    s = F.col(start) if length is None else F.least(length, F.col(start))
    indexed = df.withColumn("__i", F.row_number().over(w) - 1).withColumn("__s", F.greatest(s, F.lit(seed) + gap))
    top = F.max(F.col("__s") - F.col("__i") * gap).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return indexed.withColumn(out, (F.col("__i") * gap + top).cast("long")).drop("__i", "__s")


def repair_needed(df: DataFrame, by: list[str], order: str, start: str, bad: str, count: int = 3, share: float = 0.5) -> DataFrame:
    """Marks groups with too many unreliable starts, and scans those only, with a gap of 1."""
    g = df.groupBy(*by).agg(F.count_if(F.col(bad)).alias("bad_count"), F.avg(F.col(bad).cast("double")).alias("bad_share"))
    g = g.withColumn("repair", (F.col("bad_count") >= count) | (F.col("bad_share") >= share))
    scanned = monotone_scan(df, by, order, start, 1, "repaired")
    return scanned.join(g.select(*by, "repair"), by).withColumn("repaired", F.when(F.col("repair"), F.col("repaired")).otherwise(F.col(start).cast("long")))


def first_occurrences(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first by order."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(*keys, *[F.col(f"__x.{c}").alias(c) for c in rest])


def backfill(ranked: DataFrame, rest: DataFrame, by: list[str], key: str, order: str, most: int) -> DataFrame:
    """Ranked keys first, then the rule order's, each key once, up to a budget."""
    both = ranked.select(*by, key, F.lit(0).alias("src"), order).unionByName(rest.select(*by, key, F.lit(1).alias("src"), order))
    once = first_occurrences(both, [*by, key], ["src", order])
    return once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("src", order, key))).where(F.col("rank") <= most)


def top_by(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group by an order that ends in a tie-break."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


#: Buckets of a group whose best rows bound the rows that can be among its first k.
BUCKETS = 1024


def top_of_many(df: DataFrame, by: list[str], score: str, key: str, k: int) -> DataFrame:
    """T02 for few groups of many rows: the first k by falling score, then rising key (a number), without sorting the groups.

    The k-th best of the buckets' best rows is no better than the group's k-th row, so what is worse than it goes before the ranking.
    """
    row = F.struct(F.col(score).alias("s"), (-F.col(key)).alias("k"))
    best = df.groupBy(*by, F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("__b")).agg(F.max(row).alias("__best"))
    least = best.groupBy(*by).agg(F.get(F.sort_array(F.collect_list("__best"), asc=False), F.lit(k - 1)).alias("__least"))
    least = F.broadcast(least.select(*[F.col(c).alias(f"__{c}") for c in by], "__least"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    near = df.join(least, same).where(F.col("__least").isNull() | (row >= F.col("__least"))).select(*df.columns)
    return top_by(near, by, [F.desc(score), F.col(key)], k)


def probe_order(df: DataFrame, by: list[str], at: str, centre: str, most: int = 11) -> DataFrame:
    """Candidates by distance from a centre, then by index."""
    return top_by(df.withColumn("distance", F.abs(F.col(at) - F.col(centre))), by, [F.col("distance"), F.col(at)], most)


def best_cut(df: DataFrame, by: list[str], at: str, penalty: Column, reject: Column) -> DataFrame:
    """The cut with the least penalty among those not rejected; ties to the earlier."""
    ok = df.where(~F.coalesce(reject, F.lit(False))).withColumn("penalty", penalty)
    return ok.groupBy(*by).agg(F.min(F.struct("penalty", at)).alias("__x")).select(*by, F.col(f"__x.{at}").alias(at), F.col("__x.penalty").alias("penalty"))
