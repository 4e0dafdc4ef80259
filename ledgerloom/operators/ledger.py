"""Reports over the ledger and the decision log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trim_space

LEDGER_SCHEMA = (
    "ts string, tool string, strategy string, orig_tokens_est bigint, digest_tokens_est bigint, saved_est bigint, worker_tokens bigint, worker_input_tokens bigint, worker_output_tokens bigint, "
    "worker_cache_write_tokens bigint, worker_cache_read_tokens bigint, worker_cost_usd double, predicted_compression_ratio double, actual_compression_ratio double, cache_hit boolean"
)
DECISION_SCHEMA = (
    "ts string, tool string, target string, strategy string, dry_run boolean, est_orig_cost_usd double, est_worker_cost_usd double, est_net_savings_usd double, predicted_ratio double, compressor_kind string, "
    "compress_ratio double, actual_worker_cost_usd double, actual_output_ratio double, reuse_count int, reason string"
)
# Strategies in the order of reports, with their notes.
STRATEGIES = (
    ("DETERMINISTIC", "no worker — AST/regex"), ("CHEAP_WORKER", "Haiku worker"), ("NORMAL_WORKER", "Sonnet worker"), ("DEEP_WORKER", "Opus worker"),
    ("DIRECT", "engine: not worth intercepting"), ("PASSTHROUGH", "excluded by config"),
)


def parse_log(lines: DataFrame, schema: str, value: str = "value", max_bytes: int = 1 << 20) -> DataFrame:
    """JSON lines that hold, as rows; a line that is no JSON of the schema goes whole, as does one over max_bytes."""
    full = f"{schema}, _corrupt string"
    text = trim_space(F.col(value))
    whole = F.endswith(text, F.lit("}")) & F.startswith(text, F.lit("{"))
    parsed = lines.where((F.octet_length(F.col(value)) <= max_bytes) & whole).select(F.from_json(text, full, {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return parsed.where("r is not null and r._corrupt is null").select("r.*").drop("_corrupt")


def write_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def by_tool(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.coalesce("tool", F.lit("")) != "").groupBy("tool").agg(F.count("*").alias("calls"), F.sum(F.coalesce("saved_est", F.lit(0))).alias("saved"), F.sum(F.coalesce("worker_cost_usd", F.lit(0.0))).alias("cost"))


def by_strategy(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.coalesce("strategy", F.lit("")) != "").groupBy("strategy").agg(F.count("*").alias("calls"), F.sum(F.coalesce("saved_est", F.lit(0))).alias("saved"), F.sum(F.coalesce("worker_cost_usd", F.lit(0.0))).alias("cost"))


def cache_counts(ledger: DataFrame) -> DataFrame:
    """Hits, misses and the hit rate; rows without a cache count for neither."""
    hits, misses = F.count_if(F.col("cache_hit")), F.count_if(~F.col("cache_hit"))
    return ledger.agg(hits.alias("hits"), misses.alias("misses"), F.try_divide(hits * 100.0, hits + misses).alias("hit_rate"))


def totals(ledger: DataFrame) -> DataFrame:
    cost = F.coalesce("worker_cost_usd", F.lit(0.0))
    return ledger.agg(F.count("*").alias("calls"), F.sum(F.coalesce("saved_est", F.lit(0))).alias("saved"), F.sum(cost).alias("cost"), F.count_if(cost > 0).alias("costed"))


def verdicts(ledger: DataFrame, prices: DataFrame, turns: int = 0) -> DataFrame:
    """By session model (family, price): dollars saved by tokens kept out, less those spent. prices is a fixed few rows."""
    saved = F.col("saved") * F.col("price") / 1e6 * (1 + turns * 0.10)
    net = saved - F.col("cost")
    joined = totals(ledger).withColumn("_one", F.lit(1)).join(F.broadcast(prices.withColumn("_one", F.lit(1))), "_one")
    return joined.select("family", saved.alias("saved_usd"), F.col("cost").alias("spent_usd"), net.alias("net_usd"), F.when(net < 0, "BEHIND").otherwise("ahead").alias("verdict"))


def strategy_table(spark: SparkSession, report: DataFrame) -> DataFrame:
    """The strategy report in its fixed order with notes; unknown strategies last, by name."""
    known = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(STRATEGIES)], "ord int, strategy string, note string")
    return report.join(F.broadcast(known), "strategy", "left").select(F.coalesce("ord", F.lit(99)).alias("ord"), "strategy", "calls", "saved", "cost", F.coalesce("note", F.lit("")).alias("note")).orderBy("ord", "strategy")


def filter_decisions(log: DataFrame, tool: str | None = None, target: str | None = None) -> DataFrame:
    out = log
    if tool:
        out = out.where(F.lower("tool") == tool.lower())
    if target:
        out = out.where(F.contains(F.col("target"), F.lit(target)))
    return out


def last(log: DataFrame, n: int = 25, seq: str = "seq") -> DataFrame:
    """The last n rows in log order: a top-n, then n rows sorted."""
    return log.orderBy(F.desc(seq)).limit(n if n > 0 else 25).orderBy(seq)


def prediction_gap(log: DataFrame) -> DataFrame:
    gap = F.abs(F.col("est_worker_cost_usd") - F.col("actual_worker_cost_usd"))
    sign = F.when(F.col("actual_worker_cost_usd") > F.col("est_worker_cost_usd"), "under").when(F.col("actual_worker_cost_usd") < F.col("est_worker_cost_usd"), "over").otherwise("exact")
    return log.withColumns({"gap_usd": gap, "gap_kind": sign})


def kind_histogram(entries: DataFrame, order: list[str], by: str = "path") -> DataFrame:
    """Counts by kind in a fixed order, as one summary a path; kinds outside the order are left out."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("kind"))
    counts = entries.where(place > 0).groupBy(by, "kind").agg(F.count("*").alias("n"), F.min(place).alias("ord"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("ord", "n", "kind"))), lambda x: F.concat_ws(" ", x["n"].cast("string"), F.concat(x["kind"], F.when(x["n"] == 1, "").otherwise("s"))))
    return counts.groupBy(by).agg(F.array_join(parts, ", ").alias("summary"))


def first_seen(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """Distinct values by group in the order they first appear."""
    firsts = df.groupBy(by, value).agg(F.min(order).alias("_at"))
    return firsts.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda x: x[value]).alias("names"))


def running_first(x: Column, by: str, order: str) -> Column:
    return F.last(x, ignorenulls=True).over(Window.partitionBy(by).orderBy(order))
