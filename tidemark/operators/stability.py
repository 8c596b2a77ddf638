"""Ranks, rank correlations and their summaries."""

from __future__ import annotations

import math


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: A correlation up to this is a rounding error of zero, not positive.
NOISE = 1e-12


def average_rank(part: list[str], value: str) -> Column:
    """Zero-based, ties share the mean of their places."""
    ties = F.count(F.lit(1)).over(W.partitionBy(*part, value))
    return F.rank().over(W.partitionBy(*part).orderBy(value)) - 1 + (ties - 1) / 2


def correlation(x, y) -> Column:
    """NULL without variance, where corr() would fail under ANSI rules."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def long_factors(rows: DataFrame, factors: list[str], target: str) -> DataFrame:
    """(date, factor, code, x, y) without missing values (Q33)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("x")) for f in factors])).alias("p")
    return rows.select("date", "code", F.col(target).alias("y"), pairs).select("date", "code", "y", "p.factor", "p.x").filter("x is not null and y is not null")


def daily_ic(rows: DataFrame, factors: list[str], target: str, least: int = 3) -> DataFrame:
    """A10, Q10, Q11: (date, factor, n, ic); days with fewer rows or without variance are left out."""
    long = long_factors(rows, factors, target)
    ranked = long.withColumn("rx", average_rank(["date", "factor"], "x")).withColumn("ry", average_rank(["date", "factor"], "y"))
    return ranked.groupBy("date", "factor").agg(F.count(F.lit(1)).alias("n"), correlation("rx", "ry").alias("ic")).filter((F.col("n") >= least) & F.col("ic").isNotNull())


def summary(ic: DataFrame, keys: list[str], annual: int = 252) -> DataFrame:
    """Mean, median, spread, information ratio and share of positive days."""
    spread = F.stddev_pop("ic")
    rate = F.when(spread > 1e-20, F.avg("ic") / spread)
    return ic.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.avg("ic").alias("mean_ic"), F.median("ic").alias("median_ic"), spread.alias("std_ic"), rate.alias("ir"), (rate * math.sqrt(annual)).alias("annual_ir"), F.avg((F.col("ic") > NOISE).cast("double")).alias("positive_ratio"), F.avg(F.abs("ic")).alias("mean_abs_ic"),
    )


def newey_west(ic: DataFrame, lag: int) -> DataFrame:
    """Bartlett-weighted t of the mean; lags count kept days. A day meets the `lag` days before it only."""
    day = W.partitionBy("factor").orderBy("date")
    every = W.partitionBy("factor")
    e = ic.withColumn("i", F.row_number().over(day)).withColumn("e", F.col("ic") - F.avg("ic").over(every)).withColumn("n", F.count(F.lit(1)).over(every))
    other = e.select("factor", F.col("i").alias("j"), F.col("e").alias("f"))
    top = F.least(F.lit(lag), F.col("n") - 1)
    lagged = e.withColumn("back", F.explode(F.sequence(F.lit(0), top.cast("int")))).withColumn("j", F.col("i") - F.col("back"))
    weight = F.when(F.col("back") == 0, 1.0).otherwise(2 * (1 - F.col("back") / (top + 1)))
    total = lagged.join(other, ["factor", "j"]).groupBy("factor", "n").agg((F.sum(weight * F.col("e") * F.col("f")) / F.col("n")).alias("s"))
    out = total.join(ic.groupBy("factor").agg(F.avg("ic").alias("mean_ic")), "factor")
    variance = F.col("s") / F.col("n")
    return out.select("factor", F.col("n").alias("days"), "mean_ic", F.when((F.col("n") >= 2) & (variance > 1e-20), F.col("mean_ic") / F.sqrt(variance)).alias("t_stat"))


@F.pandas_udf(DoubleType())
def normal_p(t: pd.Series) -> pd.Series:
    """two-sided p of a normal statistic, on summary rows only."""
    return t.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))


def factor_pairs(rows: DataFrame, factors: list[str], least: int = 3) -> DataFrame:
    """Mean daily rank correlation of factor pairs, all pairs in one aggregation over one ranking."""
    ranked = rows.select("date", *[average_rank(["date"], f).alias(f) for f in factors])
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i + 1 :]]
    daily = ranked.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *[correlation(a, b).alias(f"{a}|{b}") for a, b in pairs]).filter(F.col("n") >= least)
    long = daily.select(F.explode(F.array(*[F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])).alias("p")).select("p.*").filter("r is not null")
    return long.groupBy("factor_a", "factor_b").agg(F.count(F.lit(1)).alias("days"), F.avg("r").alias("mean_r"), F.avg(F.abs("r")).alias("mean_abs_r"), F.avg((F.col("r") > NOISE).cast("double")).alias("positive_ratio"))


def factor_records(ic_summary: DataFrame, factors: list[str], split: str, horizon: int) -> DataFrame:
    """One record per factor in the order of the list, of factors without a usable day too."""
    names = ic_summary.sparkSession.createDataFrame([(f, i) for i, f in enumerate(factors)], "factor string, position int")
    return names.join(ic_summary, "factor", "left").select(F.lit(split).alias("split"), F.lit(horizon).alias("horizon"), "position", "factor", *[c for c in ic_summary.columns if c != "factor"])


def compact(records: DataFrame) -> DataFrame:
    """The six fields of a report."""
    return records.select("factor", "days", "mean_ic", "mean_abs_ic", "positive_ratio", "t_stat")


def strongest(records: DataFrame, most: int = 8) -> DataFrame:
    """K5: the factors of the largest mean correlations by size; ties keep the order of factors."""
    return records.filter("mean_ic is not null").orderBy(F.abs("mean_ic").desc(), "position").limit(most)


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """K6: factor pairs by size, then names."""
    return pairs.orderBy(F.col("mean_abs_r").desc(), "factor_a", "factor_b")


def stability(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Factors of both splits, whether the sign holds, ranks by size; a rounding error is a tie."""
    v = validation.select("factor", F.col("mean_ic").alias("validation_ic"))
    both = train.select("factor", F.col("mean_ic").alias("train_ic")).join(v, "factor")
    return both.withColumn("consistent", F.col("train_ic") * F.col("validation_ic") > 0).withColumn("place", F.row_number().over(W.orderBy(F.round(F.abs("validation_ic"), 12).desc(), "factor")).cast("long"))


def stability_report(train: DataFrame, validation: DataFrame) -> DataFrame:
    """Every factor of the training records with its part in the report; one row per factor.

    available: both splits have a mean. flipped: the signs differ. magnitude: the smaller of both sizes of a factor that
    keeps its sign, and its place by that. spearman: rank correlation of the means of the available factors.
    """
    v = validation.select("factor", F.col("mean_ic").alias("validation_ic"))
    both = train.select("factor", F.col("mean_ic").alias("train_ic")).join(v, "factor", "left")
    both = both.withColumn("available", F.col("train_ic").isNotNull() & F.col("validation_ic").isNotNull())
    both = both.withColumn("flipped", F.when(F.col("available"), F.col("train_ic") * F.col("validation_ic") < 0))
    both = both.withColumn("magnitude", F.when(F.col("available") & ~F.col("flipped"), F.least(F.abs("train_ic"), F.abs("validation_ic"))))
    place = F.row_number().over(W.orderBy(F.col("magnitude").desc_nulls_last(), "factor"))
    ranked = both.filter("available").withColumn("rx", average_rank([], "train_ic")).withColumn("ry", average_rank([], "validation_ic"))
    return both.withColumn("place", F.when(F.col("magnitude").isNotNull(), place).cast("long")).crossJoin(ranked.agg(correlation("rx", "ry").alias("spearman")))


def bucket_means(rows: DataFrame, share: float = 0.2, keys: tuple[str, ...] = ("date",)) -> DataFrame:
    """Per key the mean target of the lowest and highest share of scores; a tied group at the edge counts in part. rows: keys, score, y."""
    groups = rows.groupBy(*keys, "score").agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("c"))
    every = W.partitionBy(*keys)
    k = F.greatest(F.lit(1), F.ceil(F.sum("c").over(every) * share))
    out = groups.withColumn("k", k)
    for name, order in (("bottom", F.col("score").asc()), ("top", F.col("score").desc())):
        before = F.coalesce(F.sum("c").over(every.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        out = out.withColumn(name, F.greatest(F.lit(0), F.least("c", F.col("k") - before)) * F.col("m") / F.col("k"))
    return out.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum("top").alias("top"), F.sum("bottom").alias("bottom"), (F.sum("top") - F.sum("bottom")).alias("spread"))


def score_metrics(rows: DataFrame, keys: list[str], centred: str | None = None) -> DataFrame:
    """Rank correlation and bucket spread per day, rolled up per key; errors against the centred target if there is one. rows: keys, date, score, y."""
    day = [*keys, "date"]
    ranked = rows.withColumn("rx", average_rank(day, "score")).withColumn("ry", average_rank(day, "y"))
    ic = ranked.groupBy(*day).agg(correlation("rx", "ry").alias("ic")).filter("ic is not null")
    spread = F.stddev_pop("ic")
    by_ic = ic.groupBy(*keys).agg(
        F.avg("ic").alias("mean_daily_rank_ic"), F.when(F.count("ic") > 1, spread).alias("daily_rank_ic_std"), F.when((F.count("ic") > 1) & (spread > 0), F.avg("ic") / spread).alias("rank_ic_ir"),
        F.avg((F.col("ic") > NOISE).cast("double")).alias("positive_rank_ic_ratio"),
    )
    by_bucket = bucket_means(rows, keys=tuple(day)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trading_dates"), F.sum("n").alias("rows"), (F.avg("spread") * 1e4).alias("mean_spread_bps"), F.avg((F.col("spread") > 0).cast("double")).alias("positive_spread_ratio"),
        (F.avg("top") * 1e4).alias("top_bps"), (F.avg("bottom") * 1e4).alias("bottom_bps"),
    )
    out = by_bucket.join(by_ic, keys, "left")
    if centred:
        error = F.col(centred) - F.col("score")
        out = out.join(rows.groupBy(*keys).agg((F.avg(F.abs(error)) * 1e4).alias("mae_bps"), (F.sqrt(F.avg(error * error)) * 1e4).alias("rmse_bps")), keys)
    return out


def auc(rows: DataFrame, cuts: int = 64) -> DataFrame:
    """Zero-based rank sum; NULL with one class only. rows: (score, up).

    Rows are counted per score first; scores fall into ranges at approximate quantiles, whose totals (`cuts` numbers)
    place the ranks of each range, so no task sorts more than its range.
    """
    groups = rows.groupBy("score").agg(F.sum("up").alias("u"), F.count(F.lit(1)).alias("c"))
    edges = sorted(set(groups.agg(F.percentile_approx("score", [i / cuts for i in range(1, cuts)], 10_000)).first()[0] or []))
    ranged = groups.withColumn("range", F.size(F.filter(F.array(*[F.lit(float(x)) for x in edges]), lambda x: x < F.col("score"))) if edges else F.lit(0))
    before, at = {}, 0
    for r in ranged.groupBy("range").agg(F.sum("c").alias("c")).orderBy("range").collect():
        before[r.range], at = at, at + r.c
    start = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range")) if before else F.lit(0)
    inside = F.coalesce(F.sum("c").over(W.partitionBy("range").orderBy("score").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = ranged.withColumn("r", start + inside + (F.col("c") - 1) / 2)
    p, n = F.sum("u"), F.sum(F.col("c") - F.col("u"))
    return ranked.agg(F.try_divide(F.sum(F.col("r") * F.col("u")) - p * (p - 1) / 2, (p * n).cast("double")).alias("auc"), p.alias("ups"), n.alias("downs"))


def direction_metrics(rows: DataFrame, threshold: float) -> DataFrame:
    """Accuracy, balanced accuracy and Brier score. rows: (score in 0..1, up)."""
    said = (F.col("score") >= threshold).cast("int")
    hit = lambda c: F.try_divide(F.sum(F.when((F.col("up") == c) & (said == c), 1).otherwise(0)), F.sum(F.when(F.col("up") == c, 1).otherwise(0)))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg((said == F.col("up")).cast("double")).alias("accuracy"), ((hit(1) + hit(0)) / 2).alias("balanced"), F.avg(F.pow(F.col("score") - F.col("up"), 2)).alias("brier"))


def direction_summary(rows: DataFrame, threshold: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """The overall numbers per key, the majority's share, recalls and rates, and the means of the days' accuracies. rows: keys, date, score, up."""
    said = (F.col("score") >= threshold).cast("int")
    share = lambda c, n: F.try_divide(F.sum(F.when((F.col("up") == c) & (said == c), 1).otherwise(0)).cast("double"), F.sum(F.when(F.col("up") == c, 1).otherwise(0)).cast("double")).alias(n)
    right = F.avg((said == F.col("up")).cast("double")).alias("accuracy")
    days = rows.groupBy(*keys, "date").agg(right, share(1, "s"), share(0, "t"))
    daily = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("trading_dates"), F.avg("accuracy").alias("mean_daily_accuracy"), F.avg((F.col("s") + F.col("t")) / 2).alias("mean_daily_balanced"))
    total = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), right, F.greatest(F.avg("up"), 1 - F.avg("up")).alias("majority_accuracy"), share(1, "sensitivity"), share(0, "specificity"),
        F.avg(F.pow(F.col("score") - F.col("up"), 2)).alias("brier"), F.avg(said.cast("double")).alias("predicted_up_rate"), F.avg(F.col("up").cast("double")).alias("actual_up_rate"),
    )
    total = total.withColumn("balanced", (F.col("sensitivity") + F.col("specificity")) / 2).withColumn("accuracy_vs_majority", F.col("accuracy") - F.col("majority_accuracy"))
    return total.join(daily, list(keys)) if keys else total.crossJoin(daily)


