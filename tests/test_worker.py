from pyspark.sql import functions as F

from ledgerloom.functions import predicates as P
from ledgerloom.operators import cost, render, search, worker


def test_calls_are_pluggable_and_batched(spark):
    seen = []

    def call(prompts, model):
        assert len(prompts) <= 2
        return [(None if "fail" in p else '{"summary":"' + model + '"}', worker.Usage(1, 2, 3, 4, 0.5)) for p in prompts]

    df = spark.createDataFrame([(str(i), "fail" if i == 3 else "x") for i in range(5)], "op string, prompt string").coalesce(1)
    rows = {r["op"]: r for r in worker.summarise(df, "sonnet", call, batch=2).collect()}
    assert rows["3"]["raw"] is None and rows["0"]["raw"] == '{"summary":"sonnet"}' and rows["1"]["cost_usd"] == 0.5 and not seen


def test_prompts_say_what_is_shown(spark):
    df = spark.createDataFrame([("file_map", True, True), ("run", True, False), ("clusters", False, False)], "kind string, part boolean, up boolean")
    got = {r[0]: r[1] for r in df.select("kind", worker.prompt(F.col("kind"), F.lit("m"), F.lit("text"), F.col("part"), F.col("up"))).collect()}
    assert "FIRST PART" in got["file_map"] and "escalate" in got["file_map"] and "END" in got["run"] and "escalate" not in got["run"] and "All of it" in got["clusters"]
    assert all(x.endswith("\nCONTENT:\ntext") for x in got.values())


def test_long_files_go_up_one_tier(spark):
    df = spark.createDataFrame([("a", 10), ("b", 3000)], "op string, n int")
    df = df.select("op", worker.prompt(F.lit("file_map"), F.col("op"), F.repeat(F.lit("x\n"), F.col("n")), F.lit(False), F.lit(True)).alias("prompt"))
    rows = worker.escalated(df).collect()
    assert sorted((r["op"], r["attempt"], r["model"], r["escalate"]) for r in rows) == [("a", 0, "haiku", False), ("b", 0, "haiku", True), ("b", 1, "sonnet", False)]
    digest = spark.createDataFrame(rows).where("not escalate").select("op", F.from_json("raw", render.MAP_TYPE).alias("d"))
    assert digest.where(~P.valid_map(F.col("d"))).count() == 0


def test_cache_keeps_the_latest(spark):
    one = spark.createDataFrame([("k", 1, "old"), ("l", 1, "x")], "key string, mtime int, digest string")
    two = spark.createDataFrame([("k", 2, "new")], "key string, mtime int, digest string")
    assert sorted(map(tuple, cost.cache_put(one, two).collect())) == [("k", 2, "new"), ("l", 1, "x")]


def test_samples_stop_at_their_size(spark):
    files = spark.createDataFrame([("a", "\n".join(f"hit {i}" for i in range(1000))), ("b", "no")], "path string, text string")
    ((path, sample),) = search.sample_bytes(search.matching_lines(files, "hit"), 25).collect()
    assert (path, sample) == ("a", "a:1:hit 0\na:2:hit 1\na:3:h")


def test_redirects(spark):
    cmds = ["cat a", "cat a | wc", "my tool run -- cat a", "'my tool' run -- cat a", "ls"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cmds], "c string").coalesce(1).select(P.redirect(F.col("c"), "my tool")).collect()]
    assert got[0].endswith("  'my tool' run -- cat a\n") and got[1].endswith("  'my tool' run -- sh -c 'cat a | wc'\n") and got[3] is None and got[4] is None
