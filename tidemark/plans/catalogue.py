"""Registered queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import normalize as N
from tidemark.operators import backtest as B
from tidemark.operators import factors as X
from tidemark.operators import models as M
from tidemark.operators import panel as P
from tidemark.operators import selection as C
from tidemark.operators import stability as S
from tidemark.sources import fixtures as T

RATIOS = {"train": "0.70", "validation": "0.10", "test": "0.10", "final_oos": "0.10"}
TARGET = "fwd_return_5d"
#: All features of the models.
FEATURES = [*X.FACTORS, *X.CONTEXT]
#: Features that differ between the codes of a day: others are uncorrelated with a centred target, but for noise of either sign.
VARIED = [f for f in FEATURES if f not in ("market_return_1", "market_breadth_up")]
#: Scores of the backtest grid, in place of model predictions.
GRID = ["momentum_5", "momentum_20", "volatility_20", "close_location", "rsi_14"]


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, so that sums of another order compare equal; -0.0 becomes 0.0."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _quality(rows: DataFrame) -> DataFrame:
    """Bars with injected faults: the 13th of a month lacks fields, the 14th is malformed."""
    day = F.dayofmonth("date")
    return rows.withColumn("quality", F.when(day == 13, "missing").when(day == 14, "invalid_format").otherwise("complete"))


def q01_bars(spark, d):
    return T.bars(spark, d)


def q02_normalize_dates(spark, d):
    day, kind = F.to_date("o_orderdate"), F.col("o_orderkey") % 6
    text = F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, " yyyy/M/d")).when(kind == 2, F.date_format(day, "yyyy.M.d ")).when(kind == 3, F.date_format(day, "yyyyMMdd")).when(kind == 4, F.date_format(day, "yyyy-13-dd")).otherwise("n/a")
    return T.table(spark, d, "orders").select("o_orderkey", N.normalize_date(text).alias("date"), N.is_missing(text).alias("missing"), N.strict_date(text).alias("strict"))


def q03_normalize_codes(spark, d):
    key, kind = F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.col("s_suppkey") % 5
    text = F.when(kind == 0, F.concat(F.lit("SH."), key)).when(kind == 1, F.concat(F.lit(" sz"), key)).when(kind == 2, F.concat(F.lit("bj."), key, F.lit("　"))).when(kind == 3, F.concat(F.lit("us."), key)).otherwise(F.concat(F.lit("sh."), key, F.lit("9")))
    code = N.normalize_code(text)
    return T.table(spark, d, "supplier").select("s_suppkey", code.alias("code"), N.limit_rate(F.coalesce(code, F.lit("")), kind == 1).cast("double").alias("rate"))


def q04_decimal_round(spark, d):
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("nan")).otherwise(F.format_number("o_totalprice", 2))
    rows = T.table(spark, d, "orders").withColumn("text", text)
    return rows.select("o_orderkey", N.normalize_decimal(F.col("text"), 1).cast("double").alias("price"), F.coalesce(N.normalize_integer(F.col("text")), F.lit(-1)).alias("whole"), N.parse_number(F.col("text")).alias("number"))


def _raw_lines(spark, d):
    kind = F.col("l_orderkey") % 17
    rows = T.table(spark, d, "lineitem").join(T.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    date = F.when(kind == 1, "2020-02-31").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd"))
    code = F.when(kind == 2, "xx.1").otherwise(F.concat(F.lit("sh."), F.lpad(F.regexp_extract("p_brand", r"(\d+)", 1), 6, "0")))
    price = F.when(kind == 3, "nan").when(kind == 4, "12x").when(kind == 5, "").when(kind == 6, "1,234.5").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
    return rows.select(*T.LINE_ORDER, date.alias("date_text"), code.alias("code_text"), price.alias("price_text"))


def q05_reject_reasons(spark, d):
    rows = _raw_lines(spark, d).select("*", N.normalize_date(F.col("date_text")).alias("date"), N.normalize_code(F.col("code_text")).alias("code"))
    place = F.row_number().over(W.partitionBy("date", "code").orderBy(*T.LINE_ORDER))
    price = F.col("price_text")
    rows = rows.withColumn("known", F.col("date").isNotNull() & F.col("code").isNotNull()).withColumn("n", place)
    reason = F.when(~F.col("known"), "invalid_identity").when(F.col("n") > 1, "duplicate").when(N.is_missing(price), "missing").when(N.parse_decimal(price).isNull(), "invalid_format").otherwise("complete")
    return rows.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q06_dedupe_keep_first(spark, d):
    return P.dedupe_first(T.table(spark, d, "lineitem").select(*T.LINE_ORDER), ["l_orderkey", "l_linenumber"], T.LINE_ORDER[2:])


def q07_calendar(spark, d):
    cal = P.calendar(T.bars(spark, d))
    weeks = cal.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(P.mondays(F.col("a"), F.col("b"))).alias("date"))
    return cal.select(F.lit("session").alias("kind"), "date", "pos").unionByName(weeks.select(F.lit("monday").alias("kind"), "date", F.lit(-1).cast("long").alias("pos")))


def q08_listing_age(spark, d):
    rows = T.bars(spark, d).select("code", "date")
    cal = P.calendar(rows)
    age = P.listing_age(F.col("pos"), F.col("listing_pos"))
    return rows.join(F.broadcast(cal), "date").join(P.listing(rows, cal), "code").select("code", "date", "listing_date", age.alias("age"), P.listing_status(age).alias("listing_status"))


def q09_price_limit(spark, d):
    rows = T.bars(spark, d)
    money = lambda c: F.col(c).cast("decimal(18,4)")
    rate = N.limit_rate(F.col("code"), F.col("code") == "Brand#11")
    status = P.price_limit_status(F.col("tradestatus") == 1, F.lit(300), money("high"), money("low"), money("preclose"), rate)
    return rows.select("code", "date", status.alias("price_limit_status"))


def _ledger(spark, d):
    return P.status_ledger(_quality(T.bars(spark, d)))


def q10_status_ledger(spark, d):
    return _ledger(spark, d).select("date", "code", "age", "listing_status", "trading_status", "price_limit_status", "security_status")


def q11_clean_daily(spark, d):
    return P.clean_daily(_quality(T.bars(spark, d))).select("date", "code", "close", "age", "security_status")


def q12_status_counts(spark, d):
    kinds = ["listing_status", "trading_status", "security_status"]
    return _ledger(spark, d).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("status")) for k in kinds])).alias("s")).groupBy("s.kind", "s.status").agg(F.count(F.lit(1)).alias("n"))


def q13_join_names(spark, d):
    return T.bars(spark, d).select("code", "date", "volume").join(T.brand_names(spark, d), "code", "left")


def q14_membership_events(spark, d):
    return P.membership_events(T.memberships(spark, d))


def q15_membership_asof(spark, d):
    return P.point_in_time_panel(T.bars(spark, d).select("code", "date"), P.membership_events(T.memberships(spark, d)))


def q16_split(spark, d):
    return P.assign_splits(T.bars(spark, d).select("date", "code"), RATIOS).groupBy("split").agg(F.countDistinct("date").alias("dates"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"))


def _panel(spark, d):
    return X.labelled_panel(T.bars(spark, d))


def q17_walk_forward(spark, d):
    return P.walk_forward(_panel(spark, d).select("date", "code", "label_5d_end_date"), "label_5d_end_date").groupBy("fold", "start_date", "end_date", "role").agg(F.count(F.lit(1)).alias("n"))


def _tri(spark, d):
    return X.total_return(X.valid_bars(T.bars(spark, d)))


def _some_factors(*names):
    def query(spark, d):
        return rounded(X.add_factors(_tri(spark, d)).select("code", "date", *names))

    return query


def q18_tri(spark, d):
    events = X.corporate_actions(T.bars(spark, d))
    return rounded(_tri(spark, d).select("code", "date", "rn", "tri").join(events, "code"), 2)


def q24_context(spark, d):
    return rounded(X.add_context(T.bars(spark, d)).select("code", "date", *X.CONTEXT))


def q25_factor_panel(spark, d):
    rows = X.add_context(X.add_factors(_tri(spark, d)))
    return rounded(rows.filter(X.complete(rows)).select("code", "date", *X.FACTORS, *X.CONTEXT))


def q26_forward_labels(spark, d):
    return rounded(X.add_labels(_tri(spark, d)).select("code", "date", "label_5d_end_date", "fwd_return_5d", "label_20d_end_date", "fwd_return_20d"))


def q27_drop_reasons(spark, d):
    panel = X.add_labels(X.add_factors(_tri(spark, d)))
    return panel.groupBy(F.coalesce(X.drop_reason(), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def q28_preprocess_params(spark, d):
    panel = _panel(spark, d).persist()
    try:
        fitted = M.fit_preprocessor(panel, FEATURES)
    finally:
        panel.unpersist()
    return rounded(spark.createDataFrame([(f, *map(float, v)) for f, v in fitted.items()], "factor string, median double, low double, high double, mean double, scale double"))


def _standardised(spark, d):
    panel = _panel(spark, d).withColumn("y", F.col(TARGET) - F.avg(TARGET).over(W.partitionBy("date"))).persist()
    try:
        fitted = M.fit_preprocessor(panel, FEATURES)
    finally:
        panel.unpersist()
    return M.standardise(panel, fitted)


def q29_standardized(spark, d):
    return rounded(_standardised(spark, d).select("code", "date", "y", *FEATURES))


def _ranked_panel(spark, d):
    """Features without the noise of sums in another order, which would break ties."""
    return _panel(spark, d).withColumns({f: F.round(f, 9) for f in FEATURES})


def _ic(spark, d):
    return S.daily_ic(_ranked_panel(spark, d), FEATURES, TARGET)


def q30_rank_ic_daily(spark, d):
    return rounded(_ic(spark, d))


def q31_ic_summary(spark, d):
    return rounded(S.summary(_ic(spark, d), ["factor"]))


def q32_ic_yearly(spark, d):
    return rounded(S.summary(_ic(spark, d).withColumn("year", F.year("date").cast("long")), ["factor", "year"]))


def q33_newey_west(spark, d):
    return rounded(S.newey_west(_ic(spark, d), 4))


def q33_newey_west_p(spark, d):
    return rounded(S.newey_west(_ic(spark, d), 4).select("factor", S.normal_p("t_stat").alias("p_value")))


def q34_factor_pairs(spark, d):
    return rounded(S.factor_pairs(_ranked_panel(spark, d), FEATURES))


def q35_stability(spark, d):
    ic = _ic(spark, d)
    cut = F.to_date(F.lit("2000-01-01"))
    return rounded(S.stability(S.summary(ic.filter(F.col("date") < cut), ["factor"]), S.summary(ic.filter(F.col("date") >= cut), ["factor"])))


def _gram(spark, d):
    """Gram matrix and cross products; the panel is computed once for all passes of the fit."""
    panel = _panel(spark, d).withColumn("y", F.col(TARGET) - F.avg(TARGET).over(W.partitionBy("date"))).persist()
    try:
        return M.gram(M.standardise(panel, M.fit_preprocessor(panel, FEATURES)), FEATURES, "y")
    finally:
        panel.unpersist()


def q36_gram(spark, d):
    g, c, n = _gram(spark, d)
    rows = [(a, b, float(g[i, j])) for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES)] + [(a, "y", float(v)) for a, v in zip(FEATURES, c, strict=True)]
    return rounded(spark.createDataFrame(rows, "a string, b string, value double"), 5)


def q37_composite_score(spark, d):
    rows = _standardised(spark, d)
    _, c, _ = _gram(spark, d)
    return rounded(rows.select("code", "date", M.composite_score(VARIED, [c[FEATURES.index(f)] for f in VARIED]).alias("score")), 5)


def _coefficients(spark, d, fit):
    g, c, _ = _gram(spark, d)
    return spark.createDataFrame([(f, *key, float(v)) for key, b in fit(g, c) for f, v in C.listed_coefficients(FEATURES, b)], "factor string, alpha double, l1 double, coefficient double")


def q38_ridge(spark, d):
    return _coefficients(spark, d, lambda g, c: [((a, 0.0), M.ridge(g, c, a)) for a in M.RIDGE_ALPHAS])


def q39_elastic_net(spark, d):
    return _coefficients(spark, d, lambda g, c: [((a, r), M.elastic_net(g, c, a, r)) for a in M.NET_ALPHAS for r in M.NET_RATIOS])


def q40_knn(spark, d):
    """The ids divisible by 100 against all other rows."""
    rows = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    near = M.nearest(rows.filter("id % 100 = 0"), rows, 6).filter("query_id <> train_id")
    place = F.row_number().over(W.partitionBy("query_id").orderBy("d2", "train_id")).cast("long")
    near = near.withColumn("place", place).filter("place <= 5")
    predicted = M.neighbour_mean(near, rows.select(F.col("id").alias("train_id"), F.col("label").cast("double").alias("y")))
    return rounded(near.join(predicted, "query_id").select("query_id", "train_id", "place", "prediction"), 5)


def q41_logistic(spark, d):
    """On five features: a step is a pass over the rows, and collinear features take many steps."""
    intercept, b = M.logistic(_standardised(spark, d).withColumn("up", (F.col("y") > 0).cast("int")), GRID, "up", 1e-2)
    return spark.createDataFrame([("intercept", intercept), *zip(GRID, map(float, b), strict=True)], "term string, value double")


def _probability(spark, d):
    return _panel(spark, d).select("date", "code", F.col("return_rank").alias("score"), (F.col(TARGET) > 0).cast("long").alias("up"), F.col(TARGET).alias("y"))


def q42_direction_metrics(spark, d):
    rows = _probability(spark, d)
    return rounded(S.direction_metrics(rows, 0.5).crossJoin(S.auc(rows)))


def q43_bucket_spread(spark, d):
    return rounded(S.bucket_means(_probability(spark, d).select("date", "score", "y")))


def _scores(spark, d):
    return X.add_factors(_tri(spark, d)).select("date", "code", (-F.col("momentum_5")).alias("score")).filter("score is not null")


def q44_topk_schedule(spark, d):
    return B.schedule(_scores(spark, d), P.calendar(T.bars(spark, d)), 5, 5)


def q45_tradability(spark, d):
    return B.tradable(_ledger(spark, d)).select("date", "code", "can_buy", "can_sell")


def _simulated(spark, d, scores, ks, holdings, scenarios):
    """Events of the plans of all scores by all ks (None: all codes) and holding periods."""
    bars = T.bars(spark, d)
    status = P.status_ledger(_quality(bars)).select("date", "code", "trading_status", "price_limit_status")
    cal, plans = P.calendar(bars), None
    for holding in holdings:
        for name, rows in scores.items():
            for k in ks:
                one = B.schedule(rows, cal, k, holding).select(F.lit(f"{name}_{'all' if k is None else f'top{k}'}_{holding}d").alias("plan_id"), F.lit(holding).alias("holding"), "execution_date", "code", "place")
                plans = one if plans is None else plans.unionByName(one)
    return B.simulate(bars.join(status, ["date", "code"]), plans, cal, scenarios)


def q46_simulate(spark, d):
    events = _simulated(spark, d, {"reversal": _scores(spark, d)}, (5, 10), (5,), {"base": B.Costs()})
    return rounded(B.nav_of(events), 2)


def q50_backtest_grid(spark, d):
    """Metrics of 3 cost scenarios by 2 holding periods by 5 scores and the equally weighted universe, over the second half of all dates."""
    bars = T.bars(spark, d)
    rows = X.add_factors(_tri(spark, d))
    middle = P.calendar(bars).agg(F.percentile_approx("date", 0.5)).first()[0]
    rows = rows.filter(F.col("date") > F.lit(middle)).persist()
    scored = {f: rows.select("date", "code", F.col(f).alias("score")).filter("score is not null") for f in GRID}
    universe = {"universe": rows.select("date", "code", F.lit(0.0).alias("score"))}
    status = P.status_ledger(_quality(bars)).select("date", "code", "trading_status", "price_limit_status")
    cal, plans = P.calendar(bars), None
    for holding in (5, 20):
        for name, k, score in [*((f, 10, s) for f, s in scored.items()), ("universe", None, universe["universe"])]:
            one = B.schedule(score, cal, k, holding).select(F.lit(f"{name}_{holding}d").alias("plan_id"), F.lit(holding).alias("holding"), "execution_date", "code", "place")
            plans = one if plans is None else plans.unionByName(one)
    events = B.simulate(bars.join(status, ["date", "code"]), plans.persist(), cal).persist()
    return rounded(B.portfolio_metrics(B.nav_of(events), B.trades_of(events), B.Costs().capital), 4)


def _made_trades(spark, d):
    """A trade per day of the made value series, whose size follows the day's bars."""
    day = T.bars(spark, d).groupBy("date").agg(F.sum("volume").alias("v"))
    gross = F.col("v") % 50
    return day.select(F.lit("made").alias("run_id"), "date", gross.alias("gross"), (gross * 3e-4).alias("commission"), (gross * 5e-4).alias("stamp_tax"), (gross * 1e-3).alias("slippage"))


def q51_portfolio_metrics(spark, d):
    """A22, B6 on the made series: half of the value is invested, every fifth day rebalances."""
    nav = _made_nav(spark, d).withColumn("invested", F.col("nav") / 2).withColumn("rebalanced", (F.dayofmonth("date") % 5 == 0).cast("int"))
    return rounded(B.portfolio_metrics(nav, _made_trades(spark, d), 100.0), 5)


def _made_nav(spark, d):
    """A deterministic value series: the mean day return of each day's bars compounds."""
    day = T.bars(spark, d).groupBy("date").agg((1 + F.avg(N.ratio(F.col("close"), F.col("open"))) / 1000).alias("g"))
    return day.select(F.lit("made").alias("run_id"), "date", (100.0 * F.product("g").over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0))).alias("nav"))


def q47_nav_metrics(spark, d):
    return rounded(B.value_metrics(_made_nav(spark, d), 100.0), 5)


def q48_latest_name(spark, d):
    return T.table(spark, d, "part").groupBy(F.col("p_brand").alias("code")).agg(F.max_by("p_name", "p_partkey").alias("code_name"))


def q49_thresholds(spark, d):
    """Thresholds by balanced accuracy over the walk-forward test rows, first best wins."""
    rows = P.walk_forward(_panel(spark, d), "label_5d_end_date").filter("role = 'test'").select(F.col("return_rank").alias("score"), (F.col(TARGET) > 0).cast("long").alias("up"))
    grid = F.explode(F.array(*[F.lit(t) for t in M.THRESHOLDS])).alias("threshold")
    said = (F.col("score") >= F.col("threshold")).cast("int")
    hit = lambda c: F.try_divide(F.sum(F.when((F.col("up") == c) & (said == c), 1).otherwise(0)), F.sum(F.when(F.col("up") == c, 1).otherwise(0)))
    scored = rows.select("*", grid).groupBy("threshold").agg(((hit(1) + hit(0)) / 2).alias("balanced"))
    return rounded(scored.withColumn("place", F.row_number().over(W.orderBy(F.round("balanced", 9).desc_nulls_last(), "threshold")).cast("long")))


def _walk(spark, d):
    return C.centred(P.walk_forward(_panel(spark, d), "label_5d_end_date"), TARGET)


def q52_candidates(spark, d):
    """Out-of-fold metrics of the composite, 5 ridge and 12 elastic net candidates, and which of a family is chosen."""
    walk = _walk(spark, d).persist()
    scores = C.candidates(walk, VARIED, ("factor_composite", "ridge", "elastic_net")).persist()
    metrics = S.score_metrics(scores, ["candidate"], "centred").persist()
    chosen = C.select_models(metrics).select("candidate", F.lit(True).alias("chosen"))
    return rounded(metrics.join(chosen, "candidate", "left").withColumn("chosen", F.coalesce("chosen", F.lit(False))), 5)


def q53_signal_metrics(spark, d):
    """A12, A14, M18 on two raw features over the validation split of the panel: daily rank correlation and spread, increments, gate."""
    panel = C.centred(_panel(spark, d), TARGET)
    rows = panel.select("date", "code", "y", "centred", F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), c.alias("score")) for n, c in (("factor_composite", F.col("momentum_5")), ("reversal", -F.col("momentum_5")), ("shape", F.col("close_location")))])).alias("s"))
    metrics = S.score_metrics(rows.select("s.candidate", "date", "code", "s.score", "y", "centred"), ["candidate"], "centred")
    return rounded(C.gate(metrics).join(metrics.select("candidate", "trading_dates", "rows", "positive_spread_ratio", "top_bps", "bottom_bps", "mae_bps", "rmse_bps"), "candidate"), 5)


def q54_direction_summary(spark, d):
    return rounded(S.direction_summary(_probability(spark, d), 0.5))


def q55_membership_audit(spark, d):
    return P.membership_audit(T.bars(spark, d).select("code", "date"), P.membership_events(T.memberships(spark, d)))


def q56_daily_rows(spark, d):
    """Text rows of bars, a fault in some; valid rows by date and code."""
    bars = T.bars(spark, d)
    kind = F.dayofmonth("date")
    money = lambda c: F.col(c).cast("decimal(18,4)").cast("string")
    texts = {
        "date": F.date_format("date", "yyyy/M/d"), "code": F.concat(F.lit("SH"), F.lpad(F.regexp_extract("code", r"(\d+)", 1), 6, "0")), **{c: money(c) for c in ("high", "low", "close", "preclose", "amount")},
        "open": F.when(kind == 3, "n/a").otherwise(F.concat(F.floor("open").cast("string"), F.lit(".25"))), "turn": money("turn"), "pctChg": F.when(kind == 4, "1e").otherwise(F.lit("0.5")), "volume": F.when(kind == 5, "1.5").otherwise(F.format_number("volume", 0)),
        "tradestatus": F.lit("1"), "isST": F.lit("0"), "adjustflag": F.lit("3"), "code_name": F.col("code"), "industry_code": F.lit(" j66 "), "industry_name": F.when(kind != 6, F.lit("x")), "adjustment": F.lit("None"), "data_source": F.lit("s"),
    }
    typed = N.normalize_daily(bars.select(*[c.alias(n) for n, c in texts.items()]))
    return typed.filter("valid").select("date", "code", F.col("open").cast("double").alias("open"), "volume", "industry_code", "adjustment")


QUERIES = {name: value for name, value in list(globals().items()) if name[0] == "q" and name[1:3].isdigit()} | {
    "q19_momentum": _some_factors("return_1", "momentum_5", "momentum_20", "momentum_60"),
    "q20_volatility": _some_factors("volatility_20", "volatility_60"),
    "q21_sma_volume_ratios": _some_factors("sma_ratio_5_20", "sma_ratio_20_60", "volume_ratio_5_20", "amount_ratio_5_20", "turnover_mean_20"),
    "q22_bar_shape": _some_factors("intraday_range", "close_location", "open_gap"),
    "q23_amihud_rsi": _some_factors("amihud_20", "rsi_14"),
}
QUERIES = dict(sorted(QUERIES.items()))
