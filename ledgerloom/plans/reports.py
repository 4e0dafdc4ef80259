"""Reports as ordered rows (ord, line): their numbers come from the ledger's aggregates, which are a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cost, ledger, render


def _lines(df: DataFrame, part: int, line: Column, *order: str) -> DataFrame:
    """One report line a row of df, in order."""
    place = F.row_number().over(Window.orderBy(*order)) if order else F.lit(1)
    return df.select((F.lit(part * 1000) + place).alias("ord"), line.alias("line"))


def stats(spark: SparkSession, rows: DataFrame, session_model: str = "opus-5", turns: int = 10) -> DataFrame:
    """The ledger report: tools, cache, strategies, and the verdict in dollars."""
    prices = dict(cost.SESSION_PRICES)
    if session_model not in prices:
        raise ValueError(f"unknown session model {session_model!r} (known: {sorted(prices)})")
    price = prices[session_model]
    tools = _lines(ledger.by_tool(rows), 1, F.format_string("  %-6s %12d %14d %12.4f", "tool", "calls", "saved", "cost"), "tool")
    c = ledger.cache_counts(rows)
    rate = F.when(F.col("hits") + F.col("misses") > 0, F.format_string("  cache   %d hit / %d miss (%.0f%% hit rate, Read only)", "hits", "misses", F.coalesce("hit_rate", F.lit(0.0)))).otherwise("  cache   no cache-eligible interceptions yet")
    table = ledger.strategy_table(spark, ledger.by_strategy(rows))
    strategies = _lines(table, 3, F.rtrim(F.format_string("  %-20s %10d %14d %12.4f   %s", "strategy", "calls", "saved", "cost", "note")), "ord", "strategy")
    t = ledger.totals(rows)
    first = F.coalesce("saved", F.lit(0)) * price / 1e6
    again = first * (1 + turns * 0.10)
    spent = F.coalesce("cost", F.lit(0.0))
    verdict = F.when(again - spent < 0, "BEHIND").otherwise("ahead")
    head = _lines(t, 4, F.format_string(f"  assuming a {session_model} session ({price:.2f} $/Mtok in), content surviving {turns} more turns:%s", F.lit("")))
    saved = _lines(t, 5, F.format_string("    saved    ~%d tokens  =  $%.4f on first read, $%.4f with re-sends", F.coalesce("saved", F.lit(0)), first, again))
    paid = _lines(t, 6, F.format_string("    spent    $%.4f actually billed by the worker (%d of %d calls reported cost)", spent, "costed", "calls"))
    net = _lines(t, 7, F.format_string("    net      $%+.4f  — %s", again - spent, verdict))
    out = tools.union(_lines(c, 2, rate)).union(strategies).union(head).union(saved).union(paid).union(net)
    return out.orderBy("ord")


def pricing(spark: SparkSession, calibrated: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Prices by model, then the calibrated ratios by kind."""
    p = _lines(cost.pricing(spark, overrides), 1, F.format_string("  %-28s %8.2f %8.2f %8.2f %8.2f", "model", "input", "output", "cache_write", "cache_read"), "model")
    c = _lines(calibrated, 2, F.format_string("  %-16s n=%d mean=%.3f sd=%.3f conservative=%.3f", "kind", "count", "mean_ratio", "stddev", "conservative_ratio"), "kind")
    return p.union(c).orderBy("ord")


def explain(log: DataFrame, tool: str | None = None, target: str | None = None, n: int = 10, seq: str = "seq") -> DataFrame:
    """The last decisions that fit, with the gap between estimate and bill where there is one."""
    found = ledger.prediction_gap(ledger.last(ledger.filter_decisions(log, tool, target), n, seq))
    gap = F.when(F.coalesce("actual_worker_cost_usd", F.lit(0.0)) > 0, F.format_string("  gap $%.4f (%s-estimated)", "gap_usd", "gap_kind")).otherwise("")
    line = F.concat(F.format_string("%s  %s  %s  net $%.4f", F.coalesce("tool", F.lit("")), F.coalesce("target", F.lit("")), F.coalesce("strategy", F.lit("")), F.coalesce("est_net_savings_usd", F.lit(0.0))), gap)
    return found.select(F.col(seq).alias("ord"), line.alias("line")).orderBy("ord")


def map_report(entries: DataFrame, tool: str = "loom") -> DataFrame:
    """File-map texts from outline entries (path, ord, lines or start_line and end_line, kind[, summary, symbols, notes])."""
    from ..functions.text import line_range

    e = entries if "lines" in entries.columns else entries.withColumn("lines", line_range(F.col("start_line"), F.col("end_line")))
    e = e.withColumns({c: F.lit(None).cast(t) for c, t in (("summary", "string"), ("symbols", "array<string>"), ("notes", "string")) if c not in e.columns})
    g = e.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("ord", "lines", "kind"))).alias("x"), *[F.first(c).alias(c) for c in ("summary", "symbols", "notes")])
    m = F.struct(
        F.coalesce("summary", F.lit("")).alias("summary"), F.transform("x", lambda v: F.struct(v["lines"].alias("lines"), v["kind"].alias("kind"))).alias("map"),
        F.coalesce("symbols", F.array().cast("array<string>")).alias("symbols"), F.coalesce("notes", F.lit("")).alias("notes"),
    )
    one = F.lit(1)
    return g.select("path", render.file_map(m, F.col("path"), tool, one, one, one, one).alias("text"))
