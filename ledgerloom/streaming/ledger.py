"""Streaming forms of the ledger report and of read sessions, over a file source of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ledger import LEDGER_SCHEMA, parse_log


def ledger_stream(spark: SparkSession, path: str) -> DataFrame:
    return parse_log(spark.readStream.text(path), LEDGER_SCHEMA)


def by_tool_windows(ledger: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Calls, savings and cost by tool and window; late rows count up to the watermark."""
    timed = ledger.withColumn("at", F.to_timestamp("ts")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "tool").agg(F.count("*").alias("calls"), F.sum("saved_est").alias("saved"), F.sum("worker_cost_usd").alias("cost"))


def read_sessions(reads: DataFrame, by: str, ts: str, gap: str = "4 hours", late: str = "1 hour") -> DataFrame:
    """Sessions by idle gap; ts may lack a time zone, which watermarks don't take."""
    timed = reads.withColumn("_at", F.col(ts).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(F.session_window("_at", gap), by).agg(F.count("*").alias("reads")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "reads")
