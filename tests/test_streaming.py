import json

from ledgerloom.operators import ledger
from ledgerloom.streaming import ledger as stream


def test_log_stream(spark, tmp_path):
    good = [{"ts": f"2024-01-0{d}T0{h}:00:00Z", "tool": "Read", "saved_est": 10, "worker_cost_usd": 0.5} for d in (1, 2) for h in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "log.jsonl").write_text("\n".join([*map(json.dumps, good), "not json", "", '{"tool": "x", "saved_est": 1.5}']))
    flow = stream.by_tool_windows(stream.ledger_stream(spark, str(tmp_path / "in")))
    q = flow.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["tool"], r["calls"], r["saved"], r["cost"]) for r in spark.table("windows").orderBy("window").collect()] == [("Read", 3, 30, 1.5)] * 2


def test_cache_rate_leaves_out_rows_without_a_cache(spark):
    df = spark.createDataFrame([("Read", True), ("Read", False), ("Bash", False), ("Bash", None)], "tool string, cache_hit boolean")
    r = ledger.cache_counts(df).first()
    assert (r["hits"], r["misses"]) == (1, 2) and abs(r["hit_rate"] - 100 / 3) < 1e-9
