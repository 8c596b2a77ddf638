"""Past-only factors, cross-sectional context and calendar-exact forward labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.normalize import ratio
from tidemark.operators.panel import calendar

#: Factor names, in the order of files.
FACTORS = [
    "return_1", "momentum_5", "momentum_20", "momentum_60", "volatility_20", "volatility_60", "sma_ratio_5_20", "sma_ratio_20_60", "volume_ratio_5_20",
    "amount_ratio_5_20", "turnover_mean_20", "intraday_range", "close_location", "open_gap", "amihud_20", "rsi_14", "turnover_1",
]
CONTEXT = ["market_return_1", "market_breadth_up", "relative_return_1", "return_rank"]


def by_code():
    return W.partitionBy("code").orderBy("date")


def by_date():
    return W.partitionBy("date")


def valid_bars(rows: DataFrame) -> DataFrame:
    """Q1, Q28: trading rows only; windows count these."""
    return rows.filter("tradestatus = 1")


def total_return(rows: DataFrame) -> DataFrame:
    """The index starts at 1 and grows by close / preclose; an exact product, no logarithms."""
    step = F.when(F.row_number().over(by_code()) == 1, 1.0).otherwise(F.col("close") / F.col("preclose"))
    return rows.withColumn("rn", F.row_number().over(by_code()).cast("long")).withColumn("__step", step).withColumn("tri", F.product("__step").over(by_code().rowsBetween(W.unboundedPreceding, 0))).drop("__step")


def corporate_actions(rows: DataFrame) -> DataFrame:
    """(code, n) of precloses that differ from the close before."""
    before = F.lag("close").over(by_code())
    return rows.withColumn("__d", F.abs(F.try_divide("preclose", before) - 1)).withColumn("__b", before).groupBy("code").agg(F.count_if((F.col("__b") > 0) & (F.col("__d") > 1e-6)).alias("n_events"))


def _mean(c: Column, k: int, least: int | None = None) -> Column:
    return F.when(F.col("rn") >= (least or k), F.avg(c).over(by_code().rowsBetween(-(k - 1), 0)))


def add_factors(rows: DataFrame) -> DataFrame:
    """All rolling factors share one exchange and one sort by code and date."""
    r = rows.withColumn("ret", ratio(F.col("tri"), F.lag("tri").over(by_code())))
    span = lambda k: by_code().rowsBetween(-(k - 1), 0)
    move = lambda k: ratio(F.col("tri"), F.lag("tri", k).over(by_code()))
    spread = lambda k: F.when(F.col("rn") >= k + 1, F.stddev_pop("ret").over(span(k)))
    over = lambda c, a, b: F.try_divide(_mean(F.col(c), a), F.nullif(_mean(F.col(c), b), F.lit(0.0)))
    gain, loss = _mean(F.greatest("ret", F.lit(0.0)), 14, 15), _mean(F.greatest(-F.col("ret"), F.lit(0.0)), 14, 15)
    rsi = F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - F.try_divide(F.lit(100.0), 1 + F.try_divide(gain, loss)))
    illiquid = F.when((F.col("rn") >= 21) & (F.min("amount").over(span(20)) > 0), F.avg(F.try_divide(F.abs("ret"), F.col("amount"))).over(span(20)) * 1e8)
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    return r.withColumns({
        "return_1": F.col("ret"), "momentum_5": move(5), "momentum_20": move(20), "momentum_60": move(60), "volatility_20": spread(20), "volatility_60": spread(60),
        "sma_ratio_5_20": over("tri", 5, 20) - 1, "sma_ratio_20_60": over("tri", 20, 60) - 1, "volume_ratio_5_20": over("volume", 5, 20), "amount_ratio_5_20": over("amount", 5, 20),
        "turnover_mean_20": _mean(F.col("turn"), 20), "turnover_1": F.col("turn"), "intraday_range": F.try_divide(high - low, close), "close_location": F.when(high != low, (2 * close - high - low) / (high - low)).otherwise(0.0),
        "open_gap": ratio(F.col("open"), F.col("preclose")), "amihud_20": illiquid, "rsi_14": rsi,
    })


def add_context(rows: DataFrame) -> DataFrame:
    """Market return and breadth, deviation, ordinal rank by (return, code); defaults where undefined."""
    day = ratio(F.col("close"), F.col("preclose"))
    r = rows.withColumn("__r", day)
    place = F.row_number().over(by_date().orderBy("__r", "code")) - 1
    context = {
        "market_return_1": F.avg("__r").over(by_date()), "market_breadth_up": F.avg((F.col("__r") > 0).cast("double")).over(by_date()),
        "relative_return_1": F.col("__r") - F.avg("__r").over(by_date()), "return_rank": place / F.greatest(F.lit(1), F.count("__r").over(by_date()) - 1),
    }
    defaults = dict(zip(CONTEXT, (0.0, 0.5, 0.0, 0.5), strict=True))
    return r.withColumns({k: F.coalesce(F.when(F.col("__r").isNotNull(), v), F.lit(defaults[k])) for k, v in context.items()}).drop("__r")


def complete(rows: DataFrame) -> Column:
    """All factors known; forced by the 61st valid bar."""
    out = F.lit(True)
    for name in FACTORS:
        out = out & F.col(name).isNotNull()
    return out


def add_labels(rows: DataFrame, horizons: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Return to the same code's index on the date `h` calendar positions on; never the h-th next row.

    A frame over positions finds that row in the code's own sort; only the calendar is sent along.
    """
    cal = calendar(rows)
    out = rows.join(F.broadcast(cal), "date")
    for h in horizons:
        then = F.max("tri").over(W.partitionBy("code").orderBy("pos").rangeBetween(h, h))
        out = out.withColumn(f"fwd_return_{h}d", ratio(then, F.col("tri")))
    for h in horizons:
        out = out.join(F.broadcast(cal.select((F.col("pos") - h).alias("pos"), F.col("date").alias(f"label_{h}d_end_date"))), "pos", "left")
    return out


def add_history(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Training rows (code, date) with the history row of the same code and date, history_missing where there is none."""
    return rows.select("code", "date").join(history.withColumn("__known", F.lit(True)), ["code", "date"], "left").withColumn("history_missing", F.col("__known").isNull()).drop("__known")


def drop_reason(horizons: tuple[int, ...] = (5, 20), history: bool = False) -> Column:
    """The first rule that a row fails; NULL for a row that stays (Q4: both labels are needed). history: rows come from add_history."""
    known = F.lit(True)
    for name in FACTORS:
        known = known & F.col(name).isNotNull()
    reason = F.when(F.col("history_missing"), "feature_history_missing").when(~known, "feature_warmup") if history else F.when(~known, "feature_warmup")
    for h in horizons:
        reason = reason.when(F.col(f"label_{h}d_end_date").isNull(), f"label_{h}d_outside")
        # a base of zero has a target, but no return
        reason = reason.when(F.col(f"fwd_return_{h}d").isNull(), F.when(F.col("tri") == 0, "invalid_label_base_price").otherwise(f"label_{h}d_missing"))
    return reason


def labelled_panel(rows: DataFrame) -> DataFrame:
    """All factors, context and labels of the rows that keep both labels."""
    panel = add_labels(add_context(add_factors(total_return(valid_bars(rows)))))
    return panel.filter(drop_reason().isNull())


def split_panel(rows: DataFrame, splits: DataFrame, name: str) -> DataFrame:
    """Factors and labels of one split's dates, from bars up to the split's last date. splits: (date, split)."""
    last = splits.filter(F.col("split") == name).agg(F.max("date")).first()[0]
    dates = splits.filter(F.col("split") == name).select("date").distinct()
    return labelled_panel(rows.filter(F.col("date") <= F.lit(last))).join(F.broadcast(dates), "date", "left_semi")
