"""Schedules, the path-dependent portfolio simulation (one task per run) and metrics of its value."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.normalize import ratio


@dataclass(frozen=True)
class Costs:
    """Basis points of the traded value, shares of a lot, and the starting cash."""

    commission: float = 3.0
    stamp: float = 5.0
    slippage: float = 10.0
    lot: int = 100
    capital: float = 1_000_000.0


#: The cost scenarios of the grid.
SCENARIOS = {"zero_cost": Costs(0.0, 0.0, 0.0), "base": Costs(), "high_cost": Costs(slippage=20.0)}
EVENTS = (
    "run_id string, kind string, date date, nav double, cash double, invested double, rebalanced int, "
    "code string, side string, shares double, reference_price double, price double, gross double, commission double, stamp_tax double, slippage double"
)


def top_codes(scores: DataFrame, k: int | None) -> DataFrame:
    """K1: the k best codes of each date by score, ties by code. K2: without k all codes, by code."""
    order = ["code"] if k is None else [F.col("score").desc(), "code"]
    placed = scores.filter("score is not null").withColumn("place", F.row_number().over(W.partitionBy("date").orderBy(*order)).cast("long"))
    return placed if k is None else placed.filter(F.col("place") <= k)


def schedule(scores: DataFrame, cal: DataFrame, k: int | None, holding: int) -> DataFrame:
    """Every holding-th signal date, executed in the next session; without one it is left out. k: None for all codes."""
    days = scores.select("date").distinct().withColumn("n", F.row_number().over(W.orderBy("date")) - 1).filter(F.col("n") % holding == 0)
    following = cal.withColumn("execution_date", F.lead("date").over(W.orderBy("date"))).select("date", "execution_date").filter("execution_date is not null")
    return top_codes(scores.join(days.select("date"), "date", "left_semi"), k).join(F.broadcast(following), "date").select(F.col("date").alias("signal_date"), "execution_date", "code", "place")


def tradable(rows: DataFrame) -> DataFrame:
    """B2, Q22, Q23"""
    trading = F.col("trading_status") == "trading"
    return rows.withColumn("can_buy", trading & (F.col("price_limit_status") != "limit_up")).withColumn("can_sell", trading & (F.col("price_limit_status") != "limit_down"))


def simulate_run(bars: dict, targets: dict, costs: Costs, sessions: list) -> tuple[list[dict], list[dict]]:
    """(values per session, trades) of one run.

    bars: date to code to a bar with open, close, can_buy, can_sell; targets: execution date to codes in order. Sells
    come first, by code; a code without a bar keeps its last close and is not traded.
    """
    fee, tax, slip = costs.commission / 1e4, costs.stamp / 1e4, costs.slippage / 1e4
    cash, held, seen, days, trades = costs.capital, {}, {}, [], []
    lots = lambda shares: int(shares // costs.lot) * costs.lot if shares > 0 else 0

    def trade(side: str, code: str, shares: int, reference: float) -> float:
        price = reference * (1 - slip if side == "sell" else 1 + slip)
        gross = shares * price
        stamp = gross * tax if side == "sell" else 0.0
        trades.append({"date": date, "code": code, "side": side, "shares": float(shares), "reference_price": reference, "price": price, "gross": gross, "commission": gross * fee, "stamp_tax": stamp, "slippage": shares * reference * slip})
        return gross - gross * fee - stamp if side == "sell" else -gross - gross * fee

    for date in sessions:
        today = bars.get(date, {})
        if date in targets:
            codes = targets[date]
            value = cash + sum(n * (today[c].open if c in today else seen.get(c, 0.0)) for c, n in held.items())
            wanted = {c: lots(value / len(codes) / today[c].open) for c in codes if c in today and today[c].open > 0}
            for c in sorted(held):
                if c in today and today[c].can_sell and (n := held[c] - (wanted.get(c, 0) if c in codes else 0)) > 0:
                    cash += trade("sell", c, n, today[c].open)
                    held[c] -= n
            held = {c: n for c, n in held.items() if n}
            for c in codes:
                if c in wanted and today[c].can_buy and (short := wanted[c] - held.get(c, 0)) > 0:
                    n = min(short, lots(cash / (today[c].open * (1 + slip) * (1 + fee))))
                    if n > 0:
                        cash += trade("buy", c, n, today[c].open)
                        held[c] = held.get(c, 0) + n
        seen |= {c: today[c].close for c in held if c in today}
        invested = sum(n * seen.get(c, 0.0) for c, n in held.items())
        days.append({"date": date, "nav": cash + invested, "cash": cash, "invested": invested, "rebalanced": int(date in targets)})
    return days, trades


def simulate(bars: DataFrame, plans: DataFrame, cal: DataFrame, scenarios: dict[str, Costs] = SCENARIOS) -> DataFrame:
    """EVENTS (kind nav or trade) of every plan under every cost scenario; run_id is scenario/plan.

    plans: (plan_id, holding, execution_date, code, place); cal: (date, pos). A plan is one task, which gets the bars of
    the plan's own codes only, and runs from its first execution to `holding` sessions after the last.
    """
    sessions = [r.date for r in cal.select("date").orderBy("date").collect()]  # one row per session
    spans = plans.groupBy("plan_id", "code").agg(F.lit(1).alias("one")).join(plans.groupBy("plan_id").agg(F.min("execution_date").alias("first")), "plan_id")
    rows = tradable(bars).select("date", "code", "open", "close", "can_buy", "can_sell")
    own = rows.join(spans, "code").filter(F.col("date") >= F.col("first")).select("plan_id", "date", "code", "open", "close", "can_buy", "can_sell")
    orders = plans.groupBy(F.col("plan_id").alias("plan")).agg(F.max("holding").alias("holding"), F.sort_array(F.collect_list(F.struct("execution_date", "place", "code"))).alias("orders"))

    def run(key: tuple, own: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        targets: dict = {}
        for o in plan["orders"].iloc[0] if len(plan) else []:
            targets.setdefault(o["execution_date"], []).append(o["code"])
        if not targets:
            return pd.DataFrame(columns=names)
        days = {date: {r.code: r for r in day.itertuples()} for date, day in own.groupby("date")}
        end = min(sessions.index(max(targets)) + int(plan["holding"].iloc[0]), len(sessions) - 1)
        out = []
        for scenario, costs in scenarios.items():
            nav, trades = simulate_run(days, targets, costs, sessions[sessions.index(min(targets)) : end + 1])
            out += [{"run_id": f"{scenario}/{key[0]}", "kind": kind, **x} for kind, part in (("nav", nav), ("trade", trades)) for x in part]
        return pd.DataFrame(out, columns=names).astype({"rebalanced": "Int32"})

    names = [x.split(" ")[0] for x in EVENTS.split(", ")]
    return own.groupBy("plan_id").cogroup(orders.groupBy("plan")).applyInPandas(run, EVENTS)


def nav_of(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'nav'").select("run_id", "date", "nav", "cash", "invested", "rebalanced")


def trades_of(events: DataFrame) -> DataFrame:
    return events.filter("kind = 'trade'").select("run_id", "date", "code", "side", "shares", "reference_price", "price", "gross", "commission", "stamp_tax", "slippage")


def portfolio_metrics(nav: DataFrame, trades: DataFrame, capital: float, annual: int = 252) -> DataFrame:
    """Value metrics with exposure, turnover and costs of every run."""
    held = nav.groupBy("run_id").agg(F.avg(F.when(F.col("nav") != 0, F.col("invested") / F.col("nav")).otherwise(0.0)).alias("average_exposure"), F.avg("nav").alias("__nav"), F.sum("rebalanced").alias("rebalance_count"), F.max_by("nav", "date").alias("final_nav"))
    spent = trades.groupBy("run_id").agg(F.count(F.lit(1)).alias("trade_count"), *[F.sum(c).alias(f"__{c}") for c in ("gross", "commission", "stamp_tax", "slippage")])
    out = value_metrics(nav, capital, annual).join(held, "run_id").join(spent, "run_id", "left").fillna(0)
    costs = F.col("__commission") + F.col("__stamp_tax") + F.col("__slippage")
    turnover = F.try_divide("__gross", "__nav")
    return out.withColumns({
        "turnover_ratio": turnover, "annualized_turnover": turnover * annual / F.greatest(F.col("days"), F.lit(1)), "total_commission": F.col("__commission"), "total_stamp_tax": F.col("__stamp_tax"),
        "total_slippage": F.col("__slippage"), "total_costs": costs, "costs_bps_of_nav": F.try_divide(costs, F.col("__nav")) * 10_000,
    }).drop("__nav", "__gross", "__commission", "__stamp_tax", "__slippage")


def value_metrics(nav: DataFrame, capital: float, annual: int = 252) -> DataFrame:
    """Returns, volatility, Sharpe, drawdown from the peak that includes the start, Calmar. nav: (run_id, date, nav)."""
    day = W.partitionBy("run_id").orderBy("date")
    peak = F.greatest(F.max("nav").over(day.rowsBetween(W.unboundedPreceding, 0)), F.lit(capital))
    rows = nav.withColumn("r", ratio(F.col("nav"), F.coalesce(F.lag("nav").over(day), F.lit(capital)))).withColumn("dd", F.least(ratio(F.col("nav"), peak), F.lit(0.0)))
    total, spread, down = F.max_by("nav", "date") / capital - 1, F.stddev_pop("r"), F.min("dd")
    # a portfolio that has lost all, or more, has lost all in a year
    yearly = F.when(total > -1, F.pow(F.greatest(1 + total, F.lit(0.0)), F.lit(float(annual)) / F.count(F.lit(1))) - 1).otherwise(-1.0)
    return rows.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("days"), total.alias("total_return"), yearly.alias("annual_return"), (spread * annual**0.5).alias("volatility"),
        F.when(spread > 1e-12, F.avg("r") / spread * annual**0.5).alias("sharpe"), down.alias("max_drawdown"), F.when(down < -1e-12, yearly / F.abs(down)).alias("calmar"),
    )
