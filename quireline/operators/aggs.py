"""Aggregations: summaries, repeat statistics, pivots, deltas and robust statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rate_missing_false(c: Column) -> Column:
    """Share of true, where missing counts as false."""
    return F.avg(F.coalesce(c, F.lit(False)).cast("double"))


def rate_missing_excluded(c: Column) -> Column:
    """Share of true among what is known; null where nothing is."""
    return F.avg(c.cast("double"))


def mean_or_zero(c: Column) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0))


def repeat_stats(df: DataFrame, keys: list[str], metric: str, ok: Column) -> DataFrame:
    """Runs, successes, failures and mean, population deviation, least and largest of a metric, rounded to 6."""
    m = F.col(metric)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_runs"), F.sum(F.coalesce(ok, F.lit(False)).cast("long")).alias("ok_runs"), F.sum((~F.coalesce(ok, F.lit(False))).cast("long")).alias("failed_runs"),
        F.round(F.avg(m), 6).alias(f"{metric}_mean"), F.round(F.stddev_pop(m), 6).alias(f"{metric}_std"), F.round(F.min(m), 6).alias(f"{metric}_min"), F.round(F.max(m), 6).alias(f"{metric}_max"),
    )


def mean_of_means(stats: DataFrame, mode: str, *metrics: str) -> DataFrame:
    """Second level over means already rounded."""
    return stats.groupBy(mode).agg(F.count("*").alias("questions"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])


def pivot_last(df: DataFrame, key: str, name: str, names: list[str], value: str, order: list[str], suffix: str) -> DataFrame:
    """A column for each name (given, so that the schema is fixed); of several values the last by order."""
    picks = [F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.struct(*order))).alias(f"{n}{suffix}") for n in names]
    return df.groupBy(key).agg(*picks)


def delta_vs_baseline(df: DataFrame, key: str, mode: str, value: str, baseline: str) -> DataFrame:
    """Difference from the baseline mode's value of the same key, for keys that have both."""
    base = df.where(F.col(mode) == baseline).select(key, F.col(value).alias("baseline_value"))
    return df.where(F.col(mode) != baseline).join(base, key).where(F.col(value).isNotNull() & F.col("baseline_value").isNotNull()).withColumn("delta", F.round(F.col(value) - F.col("baseline_value"), 6))


def list_counts(df: DataFrame, col: str) -> DataFrame:
    """How often each element occurs over all rows' lists."""
    return df.select(F.explode(col).alias("item")).groupBy("item").agg(F.count("*").alias("n"))


def ordered_text(df: DataFrame, keys: list[str], order: list[str], text: str, sep: str, out: str) -> DataFrame:
    """Texts of a group joined in order."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), sep).alias(out))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks for ties; 0 where a side is constant or there are fewer than two points."""

    def mean_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2.0

    r = df.withColumn("__rx", mean_rank(x)).withColumn("__ry", mean_rank(y))
    sx, sy = F.stddev_pop("__rx"), F.stddev_pop("__ry")
    return r.groupBy(*by).agg(F.count("*").alias("n"), sx.alias("__sx"), sy.alias("__sy"), F.covar_pop("__rx", "__ry").alias("__c")).select(
        *by, "n", F.when((F.col("n") < 2) | (F.col("__sx") < 1e-6) | (F.col("__sy") < 1e-6), 0.0).otherwise(F.col("__c") / F.nullif(F.col("__sx") * F.col("__sy"), F.lit(0.0))).alias("rho")
    )


def robust_line(df: DataFrame, by: list[str], x: str, y: str, tie: str, lo: float = 0.6, hi: float = 1.4, default: float = 1.0, most_err: float = 3.0) -> DataFrame:
    """Theil-Sen line: median of pairwise slopes (the default outside lo..hi), median intercept, MAD and a confidence from it.

    Groups are bounded samples (a dozen labels a book); the pairs of a group are its square.
    """
    a = df.select(*by, F.col(x).alias("x1"), F.col(y).alias("y1"), F.col(tie).alias("t1"))
    b = df.select(*by, F.col(x).alias("x2"), F.col(y).alias("y2"), F.col(tie).alias("t2"))
    slopes = a.join(b, by).where("t1 < t2 and x1 <> x2").groupBy(*by).agg(F.median((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("raw_slope"))
    line = slopes.withColumn("slope", F.when(F.col("raw_slope").between(lo, hi), F.col("raw_slope")).otherwise(default))
    at = df.join(line, by).withColumn("__b", F.col(y) - F.col("slope") * F.col(x))
    mid = at.groupBy(*by, "slope").agg(F.median("__b").alias("intercept"))
    res = df.join(mid, by).withColumn("__e", F.abs(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))))
    out = res.groupBy(*by, "slope", "intercept").agg(F.median("__e").alias("mad"), F.count("*").alias("n"))
    return out.withColumn("conf", F.greatest(F.lit(0.0), F.least(F.lit(0.99), 1 - F.col("mad") / most_err)))


def _judged_line(df: DataFrame, by: list[str], x: str, y: str, tie: str, most_err: float, least: int, min_rho: float) -> DataFrame:
    """A robust line with the points' rank correlation; without enough of that the confidence is 0; groups of too few points have none."""
    line = robust_line(df, by, x, y, tie, most_err=most_err).where(F.col("n") >= least)
    rho = spearman(df.select(*by, x, y), by, x, y).select(*by, "rho")
    return line.join(rho, by).withColumn("conf", F.when(F.col("rho") < min_rho, 0.0).otherwise(F.col("conf")))


def _suffixed(line: DataFrame, by: list[str]) -> DataFrame:
    return line.select(*by, *[F.col(c).alias(f"__{c}") for c in FIT])


FIT = ("slope", "intercept", "mad", "n", "conf", "rho")


def clean_and_refit(df: DataFrame, by: list[str], x: str, y: str, tie: str, good: float = 0.72, most_err: float = 3.0, least: int = 4, min_rho: float = 0.75, second_hand: str | None = None) -> DataFrame:
    """A poor fit first loses its second-hand points (a boolean column: labels read from a text layer), then its extreme residuals.

    Poor: confidence below good or rank correlation below min_rho. The first step needs points of both kinds and stays if the
    confidence rises, or the correlation does at no less confidence (0.1 at least); the second stays if the confidence doesn't fall.
    A line whose points beyond the outlier distance are a minority that the median hides (MAD 0 and still points that far) is
    refitted as well, which leaves slope and intercept as they are but for rounding.
    """
    far = max(8.0, 3 * most_err)
    poor = (F.col("conf") < good) | (F.col("rho") < min_rho)
    points = df
    first = _judged_line(points, by, x, y, tie, most_err, least, min_rho)
    if second_hand:
        kinds = df.groupBy(*by).agg(F.bool_or(second_hand).alias("__s"), F.bool_or(~F.col(second_hand)).alias("__f")).where("__s and __f").select(*by)
        own = df.join(first.where(poor).select(*by).join(kinds, by), by).where(~F.col(second_hand))
        alone = _suffixed(_judged_line(own, by, x, y, tie, most_err, least, min_rho), by)
        gains = (F.col("__conf") > F.col("conf")) | ((F.col("__rho") > F.col("rho")) & (F.col("__conf") >= F.greatest(F.lit(0.1), F.col("conf"))))
        both = first.join(alone, by, "left").withColumn("__own", F.coalesce(gains, F.lit(False)))
        first = both.select(*by, *[F.when(F.col("__own"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in FIT], "__own")
        points = df.join(first.select(*by, "__own"), by).where(~(F.col("__own") & F.col(second_hand))).drop("__own")
        first = first.drop("__own")
    asked = first.where(poor | (F.col("mad") == 0)).select(*by, "slope", "intercept")
    kept = points.join(asked, by).where(F.abs(F.col(y) - (F.col("slope") * F.col(x) + F.col("intercept"))) <= far).drop("slope", "intercept")
    both = first.join(_suffixed(_judged_line(kept, by, x, y, tie, most_err, least, min_rho), by), by, "left")
    better = F.coalesce((F.col("__n") < F.col("n")) & (F.col("__conf") >= F.col("conf")), F.lit(False))
    return both.select(*by, *[F.when(better, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in FIT], better.alias("refitted"))


def page_offset(df: DataFrame, by: list[str], page: str, unit: str, tolerance: float = 2.0, least: int = 3) -> DataFrame:
    """Median of unit - page where enough samples agree within a tolerance, else null."""
    d = F.col(unit) - F.col(page)
    g = df.groupBy(*by).agg(F.median(d).alias("__m"), (F.max(d) - F.min(d)).alias("spread"), F.count("*").alias("n"))
    return g.select(*by, "spread", "n", F.when((F.col("n") >= least) & (F.col("spread") <= tolerance), F.col("__m")).alias("page_offset"))


def binned_top(df: DataFrame, by: list[str], pos: str, width: int, most: int) -> DataFrame:
    """The bins with most positions in each group; ties to the lower bin."""
    b = df.withColumn("bin", (F.floor(F.col(pos) / width) * width).cast("long")).groupBy(*by, "bin").agg(F.count("*").alias("votes"))
    return b.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("votes"), "bin"))).where(F.col("rank") <= most)


def inferred_mode(df: DataFrame, key: str, mode: str, name: str) -> DataFrame:
    """A group's only mode, else the one its name tells (M and a digit), with k from a suffix."""
    g = df.groupBy(key).agg(F.countDistinct(mode).alias("__n"), F.min(mode).alias("__m"), F.min(name).alias("__name"))
    told = F.nullif(F.regexp_extract(F.upper("__name"), r"(?:^|[^A-Z0-9])(M[1-9])(?:[^0-9]|$)", 1), F.lit(""))
    k = F.nullif(F.regexp_extract(F.lower("__name"), r"k(?:=|_)?(\d+)", 1), F.lit("")).cast("int")
    return g.select(key, F.when(F.col("__n") == 1, F.col("__m")).otherwise(told).alias("mode"), k.alias("k"))


def folder_hash(df: DataFrame, by: list[str], path: str, content_sha1: str) -> DataFrame:
    """One hash for a set of files, in the order of their paths."""
    rows = F.array_sort(F.collect_list(F.struct(path, content_sha1)))
    return df.groupBy(*by).agg(F.sha1(F.array_join(F.transform(rows, lambda r: F.concat(r[path], F.lit(":"), r[content_sha1])), "\n")).alias("content_hash"))
