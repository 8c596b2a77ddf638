"""Model selection over purged folds, the final fit, its gate and the texts about it.

Every fold fits its own preprocessing, target scale and Gram matrix; all candidates of a fold are then columns of one
table of test rows, and metrics of all candidates come from one long table (candidate, date, code, score, y, centred).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.normalize import sigmoid
from tidemark.operators import models as M
from tidemark.operators import stability as S

FAMILIES = ("factor_composite", "ridge", "elastic_net", "knn")
#: Rows of predictions: what is scored, the target, and the target's deviation from the day's mean.
LONG = ["candidate", "date", "code", "score", "y", "centred"]


@dataclass
class Fit:
    """What is learnt from training rows: preprocessing, the target's scale, Gram matrix and cross products."""

    features: list[str]
    preprocessing: dict
    target: tuple[float, float, float, float]
    gram: object
    cross: object
    train: DataFrame = field(repr=False)

    def columns(self, families: tuple[str, ...]) -> dict[str, Column]:
        """Scores of the linear candidates of the families, by name."""
        _, _, mean, scale = self.target
        out = {}
        if "factor_composite" in families:
            out["factor_composite"] = M.composite_score(self.features, self.cross, scale)
        if "ridge" in families:
            out |= {f"ridge_alpha_{a:g}": M.linear_score(self.features, M.ridge(self.gram, self.cross, a), scale, mean) for a in M.RIDGE_ALPHAS}
        if "elastic_net" in families:
            out |= {f"elastic_net_alpha_{a:g}_l1_{r:g}": M.linear_score(self.features, M.elastic_net(self.gram, self.cross, a, r), scale, mean) for a in M.NET_ALPHAS for r in M.NET_RATIOS}
        return out

    def neighbours(self, test: DataFrame, counts: list[int] = M.NEIGHBOURS) -> DataFrame:
        """(date, code, candidate, score) of the neighbour models; neighbours are sought once, for the largest count."""
        _, _, mean, scale = self.target
        keyed = lambda rows: rows.withColumn("id", F.xxhash64("date", "code")).withColumn("vec", F.array(*self.features))
        near = M.nearest(keyed(test), keyed(self.train), max(counts)).persist()
        targets, names, out = keyed(self.train).select(F.col("id").alias("train_id"), F.col("scaled").alias("y")), keyed(test).select(F.col("id").alias("query_id"), "date", "code"), None
        for k in counts:
            one = M.neighbour_mean(near.filter(F.col("place") <= k), targets).join(names, "query_id").select("date", "code", F.lit(f"knn_k_{k}").alias("candidate"), (F.col("prediction") * scale + mean).alias("score"))
            out = one if out is None else out.unionByName(one)
        return out


def centred(rows: DataFrame, target: str) -> DataFrame:
    """The target as y and its deviation from the day's mean as centred."""
    return rows.withColumn("y", F.col(target)).withColumn("centred", M.excess(target))


def fit(train: DataFrame, features: list[str]) -> tuple[Fit, callable]:
    """Fit on rows with y and centred; also a function that standardises other rows alike."""
    preprocessing, target = M.fit_preprocessor(train, features), M.fit_target(train, "centred")
    scaled = M.standardise(train, preprocessing).withColumn("scaled", M.scaled_target("centred", target))
    gram, cross, _ = M.gram(scaled, features, "scaled")
    return Fit(features, preprocessing, target, gram, cross, scaled), lambda rows: M.standardise(rows, preprocessing)


def _long(test: DataFrame, columns: dict[str, Column], fitted: Fit, families: tuple[str, ...]) -> DataFrame:
    scored = test.select("date", "code", "y", "centred", F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), c.alias("score")) for n, c in columns.items()])).alias("s"))
    out = scored.select("s.candidate", "date", "code", "s.score", "y", "centred")
    if "knn" in families:
        out = out.unionByName(fitted.neighbours(test).join(test.select("date", "code", "y", "centred"), ["date", "code"]).select(*LONG))
    return out


def candidates(walk: DataFrame, features: list[str], families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Out-of-fold scores LONG and fold of all candidates. walk: rows of walk_forward with y and centred."""
    out = None
    for r in walk.select("fold").distinct().orderBy("fold").collect():  # four folds
        part = walk.filter(F.col("fold") == r.fold)
        train = part.filter("role = 'train'").persist()
        fitted, transform = fit(train, features)
        one = _long(transform(part.filter("role = 'test'")), fitted.columns(families), fitted, families).withColumn("fold", F.lit(r.fold))
        out = one if out is None else out.unionByName(one)
        train.unpersist()
    return out


def direction_candidates(walk: DataFrame, features: list[str], penalties: list[float] = M.LOGISTIC_L2) -> DataFrame:
    """(l2, fold, date, code, score, up): out-of-fold probabilities; every threshold is judged on the same ones."""
    out = None
    for r in walk.select("fold").distinct().orderBy("fold").collect():
        part = walk.filter(F.col("fold") == r.fold)
        train = part.filter("role = 'train'").withColumn("up", (F.col("y") > 0).cast("int")).persist()
        preprocessing = M.fit_preprocessor(train, features)
        found = M.logistics(M.standardise(train, preprocessing), features, "up", penalties)
        scores = F.array(*[F.struct(F.lit(l2).alias("l2"), sigmoid(M.linear_score(features, b) + a).alias("score")) for l2, (a, b) in zip(penalties, found, strict=True)])
        test = M.standardise(part.filter("role = 'test'"), preprocessing).withColumn("up", (F.col("y") > 0).cast("int"))
        one = test.select("date", "code", "up", F.explode(scores).alias("s")).select("s.l2", F.lit(r.fold).alias("fold"), "date", "code", "s.score", "up")
        out = one if out is None else out.unionByName(one)
        train.unpersist()
    return out


def select_models(metrics: DataFrame) -> DataFrame:
    """Of ridge, elastic net and neighbours the candidate with the largest mean rank correlation, then spread; the first of equals in grid order."""
    grid = [*(f"ridge_alpha_{a:g}" for a in M.RIDGE_ALPHAS), *(f"elastic_net_alpha_{a:g}_l1_{r:g}" for a in M.NET_ALPHAS for r in M.NET_RATIOS), *(f"knn_k_{k}" for k in M.NEIGHBOURS)]
    places = metrics.sparkSession.createDataFrame([(c, i, next(f for f in FAMILIES if c.startswith(f))) for i, c in enumerate(grid)], "candidate string, position int, family string")
    best = F.row_number().over(W.partitionBy("family").orderBy(F.col("mean_daily_rank_ic").desc_nulls_last(), F.col("mean_spread_bps").desc_nulls_last(), "position"))
    return metrics.join(F.broadcast(places), "candidate").withColumn("n", best).filter("n = 1").select("family", "candidate", "mean_daily_rank_ic", "mean_spread_bps")


def direction_table(probabilities: DataFrame, thresholds: list[float] = M.THRESHOLDS, penalties: list[float] = M.LOGISTIC_L2) -> DataFrame:
    """(l2, threshold, balanced, auc, brier, place): balanced accuracy, then AUC, then the smaller Brier score; first of equals."""
    spark, out = probabilities.sparkSession, None
    for i, l2 in enumerate(penalties):
        own = probabilities.filter(F.col("l2") == l2)
        area = S.auc(own.select("score", "up")).select("auc")
        for t in thresholds:
            one = S.direction_metrics(own, t).crossJoin(area).select(F.lit(i).alias("at"), F.lit(l2).alias("l2"), F.lit(t).alias("threshold"), "balanced", "auc", "brier")
            out = one if out is None else out.unionByName(one)
    out = spark.createDataFrame(out.collect(), out.schema)  # one row per candidate
    return out.withColumn("place", F.row_number().over(W.orderBy(F.col("balanced").desc_nulls_last(), F.col("auc").desc_nulls_last(), "brier", "at", "threshold")).cast("long")).drop("at")


def validate(train: DataFrame, validation: DataFrame, features: list[str], chosen: dict[str, str], families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Scores LONG on the validation rows of the chosen candidate of every family, refitted on all training rows, and of both baselines.

    train, validation: rows with y and centred; chosen: family to candidate.
    """
    fitted, transform = fit(train, features)
    rate = train.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
    columns = {n: c for n, c in fitted.columns(families).items() if n == "factor_composite" or n in chosen.values()}
    scored = _long(transform(validation), columns, fitted, families)
    scored = scored.filter(F.col("candidate").isin("factor_composite", *chosen.values()))
    baselines = {"zero_baseline": F.lit(0.0), "direction_prior": F.lit(float(rate))}
    return scored.unionByName(_long(validation, baselines, fitted, ()))


def gate(metrics: DataFrame) -> DataFrame:
    """Increments over the composite and whether a model advances, in order of rank correlation, then spread."""
    base = metrics.filter("candidate = 'factor_composite'").select(F.col("mean_daily_rank_ic").alias("base_ic"), F.col("mean_spread_bps").alias("base_spread"))
    out = metrics.filter(~F.col("candidate").isin("zero_baseline", "direction_prior")).crossJoin(F.broadcast(base))
    more_ic, more_spread = F.col("mean_daily_rank_ic") - F.col("base_ic"), F.col("mean_spread_bps") - F.col("base_spread")
    advances = (F.col("candidate") != "factor_composite") & (F.col("mean_daily_rank_ic") > 0) & (F.col("mean_spread_bps") > 0) & (more_ic > 0) & (more_spread > 0)
    place = F.row_number().over(W.orderBy(F.col("mean_daily_rank_ic").desc_nulls_last(), F.col("mean_spread_bps").desc_nulls_last(), "candidate")).cast("long")
    return out.select("candidate", "mean_daily_rank_ic", "mean_spread_bps", more_ic.alias("more_ic"), more_spread.alias("more_spread"), F.coalesce(advances, F.lit(False)).alias("advances"), place.alias("place"))


def recommendation(gated: DataFrame, horizon: int) -> str:
    """One sentence per horizon."""
    rows = gated.orderBy("place").collect()
    names = [r.candidate for r in rows if r.advances]
    best = rows[0].candidate if rows else "none"
    return f"{horizon}d: {', '.join(names)} advance over the factor composite" if names else f"{horizon}d: no model improves on the factor composite; the best in validation is {best}"


def listed_coefficients(features: list[str], coefficients) -> list[tuple[str, float]]:
    """K7: by size, the largest first."""
    return sorted(zip(features, map(float, coefficients), strict=True), key=lambda x: -abs(x[1]))
