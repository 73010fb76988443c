"""Performance of backtests, from tables of equity (keys, ts, equity) and trades (keys, net_pnl, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
DAYS, RISK_FREE = 252, 0.065


def or_else(a: Column, b: Column, otherwise: float) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(otherwise))


def drawdowns(equity: DataFrame, *keys: str) -> DataFrame:
    """equity with its running peak and drawdown as a part of it."""
    w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return equity.withColumn("peak", F.max("equity").over(w)).withColumn("drawdown", F.try_divide(C("equity") - C("peak"), C("peak")))


def daily(equity: DataFrame, *keys: str) -> DataFrame:
    """(keys, day, equity, r): the last equity of each day and its change from the day before."""
    d = equity.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.max_by("equity", "ts").alias("equity"))
    before = F.lag("equity").over(Window.partitionBy(*keys).orderBy("day"))
    return d.withColumn("r", F.try_divide(C("equity"), before) - 1)


def period_returns(equity: DataFrame, *keys: str, unit: str = "month") -> DataFrame:
    """(keys, period, return_pct): changes of the last equity of months or years; the first period has none before it and is left out."""
    d = equity.groupBy(*keys, F.to_date(F.date_trunc(unit, "ts")).alias("period")).agg(F.max_by("equity", "ts").alias("equity"))
    before = F.lag("equity").over(Window.partitionBy(*keys).orderBy("period"))
    return d.withColumn("return_pct", 100 * (F.try_divide(C("equity"), before) - 1)).where("return_pct is not null").drop("equity")


def equity_metrics(equity: DataFrame, *keys: str) -> DataFrame:
    """Returns, risk and drawdowns by account, of which keys (at least one) are the columns."""
    d = drawdowns(equity, *keys)
    under = C("drawdown") < 0
    ordered = Window.partitionBy(*keys).orderBy("ts")
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_n", F.row_number().over(ordered)).withColumn("_run", C("_n") - F.coalesce(F.max(F.when(~under, C("_n"))).over(upto), F.lit(0)))
    bars = d.groupBy(*keys).agg(
        F.min_by("equity", "ts").alias("start_equity"), F.max_by("equity", "ts").alias("end_equity"), F.min("ts").alias("_a"), F.max("ts").alias("_b"),
        F.min("drawdown").alias("max_drawdown"), F.avg(F.when(under, C("drawdown"))).alias("avg_drawdown"), F.max(F.when(under, C("_run")).otherwise(0)).alias("longest_drawdown_bars"),
        F.max(C("peak") - C("equity")).alias("max_drawdown_money"), F.count("*").alias("bars"),
    )
    free = (1 + RISK_FREE) ** (1 / DAYS) - 1
    r = C("r")
    by_day = daily(equity, *keys).groupBy(*keys).agg(
        F.stddev_samp(r).alias("_sd"), F.avg(r - free).alias("_excess"), F.stddev_samp(F.when(r < 0, r)).alias("_down"),
        F.sum(F.when(r > 0, r).otherwise(0.0)).alias("_gains"), F.sum(F.when(r <= 0, -r).otherwise(0.0)).alias("_losses"),
    )
    years = F.greatest(F.datediff("_b", "_a") / 365.25, F.lit(1 / 365.25))
    out = bars.join(by_day, list(keys))
    out = out.withColumn("years", years).withColumn("total_return", F.try_divide(C("end_equity"), C("start_equity")) - 1).withColumn("cagr", F.pow(F.greatest(F.try_divide(C("end_equity"), C("start_equity")), F.lit(0.0)), 1 / C("years")) - 1)
    root = F.sqrt(F.lit(float(DAYS)))
    out = out.withColumn("volatility", F.coalesce(C("_sd"), F.lit(0.0)) * root).withColumn("sharpe", or_else(C("_excess"), C("_sd"), 0.0) * root).withColumn("sortino", or_else(C("_excess"), C("_down"), 0.0) * root)
    out = out.withColumn("calmar", F.abs(or_else(C("cagr"), C("max_drawdown"), 0.0)))
    out = out.withColumn("omega", F.when(C("_losses") > 0, C("_gains") / F.nullif(C("_losses"), F.lit(0.0))).when(C("_gains") > 0, 999.0).otherwise(0.0))
    net = C("end_equity") - C("start_equity")
    out = out.withColumn("recovery", F.when(C("max_drawdown_money") > 0, net / F.nullif(C("max_drawdown_money"), F.lit(0.0))).when(net > 0, 999.0).otherwise(0.0))
    return out.drop("_a", "_b", "_sd", "_excess", "_down", "_gains", "_losses")


def longest_streaks(trades: DataFrame, *keys: str) -> DataFrame:
    """(keys, max_wins, max_losses) in a row, in order of exit."""
    w = Window.partitionBy(*keys).orderBy("exit_time", "entry_time", "symbol")
    d = trades.withColumn("_win", C("net_pnl") > 0).withColumn("_n", F.row_number().over(w))
    d = d.withColumn("_g", C("_n") - F.row_number().over(Window.partitionBy(*keys, "_win").orderBy("exit_time", "entry_time", "symbol")))
    runs = d.groupBy(*keys, "_win", "_g").count()
    return runs.groupBy(*keys).agg(F.coalesce(F.max(F.when(C("_win"), C("count"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(~C("_win"), C("count"))), F.lit(0)).alias("max_losses"))


def trade_metrics(trades: DataFrame, *keys: str) -> DataFrame:
    win, x, reason = C("net_pnl") > 0, C("net_pnl"), C("exit_reason")
    stop = reason.contains("SL") | reason.contains("Stop") | reason.contains("Chandelier")
    target = reason.contains("TARGET") | reason.contains("Target")
    time = reason.contains("TIME") | reason.contains("Time") | reason.contains("EOD")
    share = lambda c: F.count_if(c) * 100 / F.count("*")
    d = trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_if(win).alias("winners"), F.count_if(~win).alias("losers"), F.sum(x).alias("net_profit"), F.sum("charges").alias("charges"),
        F.coalesce(F.avg(F.when(win, x)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(~win, x)), F.lit(0.0)).alias("avg_loss"), F.max(x).alias("best_trade"), F.min(x).alias("worst_trade"),
        F.coalesce(F.sum(F.when(win, x)), F.lit(0.0)).alias("_won"), F.coalesce(F.sum(F.when(~win, x)), F.lit(0.0)).alias("_lost"), F.avg("bars_held").alias("avg_bars_held"), F.avg(F.datediff("exit_time", "entry_time")).alias("avg_days_held"),
        share(stop).alias("stop_pct"), share(target).alias("target_pct"), share(time).alias("time_pct"),
    )
    p = C("winners") / C("trades")
    d = d.withColumn("win_rate", p).withColumn("profit_factor", F.when(C("_lost") < 0, C("_won") / F.abs(F.nullif(C("_lost"), F.lit(0.0)))).otherwise(999.0))
    d = d.withColumn("expectancy", p * C("avg_win") + (1 - p) * C("avg_loss"))
    d = d.withColumn("kelly", or_else(p * C("avg_win") - (1 - p) * F.abs(C("avg_loss")), C("avg_win"), 0.0))
    return d.withColumn("signal_pct", F.greatest(100 - C("stop_pct") - C("target_pct") - C("time_pct"), F.lit(0.0))).drop("_won", "_lost")


def contributions(trades: DataFrame) -> DataFrame:
    """(symbol, net_pnl, share_pct, is_best, is_worst): what each symbol gave to the total; of equal ones the first by name is the best or worst."""
    d = trades.groupBy("symbol").agg(F.sum("net_pnl").alias("net_pnl"))  # a row per symbol from here on
    whole = F.sum("net_pnl").over(Window.partitionBy())
    at = lambda *order: F.row_number().over(Window.partitionBy().orderBy(*order)) == 1
    return d.select("symbol", "net_pnl", F.coalesce(F.try_divide(100 * C("net_pnl"), whole), F.lit(0.0)).alias("share_pct"), at(F.desc("net_pnl"), "symbol").alias("is_best"), at("net_pnl", "symbol").alias("is_worst"))


def daily_summary(trades: DataFrame) -> DataFrame:
    """(day, pnl, trades, win_rate_pct) of the trades that were closed on each day."""
    d = trades.groupBy(F.to_date("exit_time").alias("day")).agg(F.sum("net_pnl").alias("pnl"), F.count("*").alias("trades"), F.count_if(C("net_pnl") > 0).alias("_won"))
    return d.select("day", "pnl", "trades", (100 * C("_won") / C("trades")).alias("win_rate_pct"))


def exposure_pct(equity: DataFrame, trades: DataFrame, *keys: str) -> DataFrame:
    """(keys, exposure_pct): bars of the curve within any trade, both ends included, by a sweep over starts and ends."""
    point = lambda d, ts, o, n: d.select(*keys, C(ts).alias("ts"), F.lit(o).alias("_o"), F.lit(n).alias("_d"))
    points = point(equity, "ts", 1, 0).unionByName(point(trades, "entry_time", 0, 1)).unionByName(point(trades, "exit_time", 2, -1))
    running = F.sum("_d").over(Window.partitionBy(*keys).orderBy("ts", "_o").rowsBetween(Window.unboundedPreceding, 0))
    return points.withColumn("_open", running).where("_o = 1").groupBy(*keys).agg((100 * F.count_if(C("_open") > 0) / F.count("*")).alias("exposure_pct"))


def performance(equity: DataFrame, trades: DataFrame, *keys: str, capital: float = 100_000.0) -> DataFrame:
    """All figures of an account in one row: of its curve (keys, ts, equity) against the capital it began with, and of its trades.

    Accounts without trades have 0 in their place, accounts without a curve no row. Months and years are in monthly_returns
    and annual_returns, maps by 'yyyy-MM' and 'yyyy'.
    """
    e = equity_metrics(equity, *keys).withColumn("total_return", C("end_equity") / capital - 1).withColumn("cagr", F.pow(F.greatest(C("end_equity") / capital, F.lit(0.0)), 1 / C("years")) - 1)
    e = e.withColumn("calmar_ratio", F.abs(or_else(C("cagr"), C("max_drawdown"), 0.0)))
    net = C("end_equity") - capital
    dates = equity.groupBy(*keys).agg(F.to_date(F.min("ts")).alias("start_date"), F.to_date(F.max("ts")).alias("end_date"))
    of = {"month": "yyyy-MM", "year": "yyyy"}
    periods = {u: period_returns(equity, *keys, unit=u).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.date_format("period", f), F.round("return_pct", 2))))).alias(n)) for (u, f), n in zip(of.items(), ("monthly_returns", "annual_returns"), strict=True)}  # a row per month of an account
    t = trade_metrics(trades, *keys).join(longest_streaks(trades, *keys), list(keys)).join(trades.groupBy(*keys).agg(F.avg(C("mae") * C("quantity")).alias("avg_mae"), F.avg(C("mfe") * C("quantity")).alias("avg_mfe")), list(keys))
    d = e.join(dates, list(keys)).join(t, list(keys), "left").join(exposure_pct(equity, trades, *keys), list(keys), "left")
    for x in periods.values():
        d = d.join(x, list(keys), "left")
    zero = lambda c, kind="double": F.coalesce(c if not isinstance(c, str) else C(c), F.lit(0)).cast(kind)
    drag = zero("charges") / capital * 100
    return d.select(
        *keys, "start_date", "end_date", F.lit(capital).alias("initial_capital"), C("end_equity").alias("final_capital"), net.alias("total_net_pnl"), (100 * C("total_return")).alias("total_return_pct"), (100 * C("cagr")).alias("cagr_pct"),
        (100 * C("volatility")).alias("annualised_volatility"), C("sharpe").alias("sharpe_ratio"), C("sortino").alias("sortino_ratio"), "calmar_ratio", C("omega").alias("omega_ratio"), zero("kelly").alias("kelly_fraction"),
        (100 * C("max_drawdown")).alias("max_drawdown_pct"), (100 * zero("avg_drawdown")).alias("avg_drawdown_pct"), C("longest_drawdown_bars").cast("bigint").alias("max_drawdown_duration_bars"),
        F.when(C("max_drawdown_money") > 0, net / F.nullif(C("max_drawdown_money"), F.lit(0.0))).when(net > 0, 999.0).otherwise(0.0).alias("recovery_factor"),
        drag.alias("brokerage_drag_pct"), (100 * C("total_return") - drag).alias("net_return_after_tax_pct"), zero("avg_days_held").alias("avg_holding_days"), (zero("trades") / (C("years") * 12)).alias("trades_per_month"),
        zero("trades", "bigint").alias("total_trades"), zero("winners", "bigint").alias("winning_trades"), zero("losers", "bigint").alias("losing_trades"), (100 * zero("win_rate")).alias("win_rate_pct"), zero("avg_win").alias("avg_win"), zero("avg_loss").alias("avg_loss"),
        F.greatest(zero("best_trade"), F.lit(0.0)).alias("largest_win"), F.least(zero("worst_trade"), F.lit(0.0)).alias("largest_loss"), zero("profit_factor").alias("profit_factor"), zero("expectancy").alias("expectancy"),
        F.coalesce(F.try_divide(C("avg_win"), F.abs("avg_loss")), F.lit(0.0)).alias("risk_reward_ratio"), zero("avg_bars_held").alias("avg_trade_duration_bars"), zero("max_wins", "bigint").alias("max_consecutive_wins"), zero("max_losses", "bigint").alias("max_consecutive_losses"),
        zero("avg_mae").alias("avg_mae"), zero("avg_mfe").alias("avg_mfe"), zero("stop_pct").alias("pct_stopped_out"), zero("target_pct").alias("pct_target_hit"), zero("signal_pct").alias("pct_signal_exit"), zero("time_pct").alias("pct_time_exit"),
        "monthly_returns", "annual_returns", zero("exposure_pct").alias("exposure_pct"), zero("charges").alias("total_commission_paid"),
    )
