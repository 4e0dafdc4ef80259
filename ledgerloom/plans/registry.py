"""Queries of the library by name, and the SQL that states the same results.

The driver's tables stand in for the library's inputs: `events` for the ledger, the decision log and reads by user,
`documents` for files, `pages` for paths. Each key names the operators it covers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import cost, ledger, measure, reduce, render, search
from . import reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger rows."""
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.array(*[F.lit(s) for s, _ in ledger.STRATEGIES], F.lit(""))
    return _table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", F.col("event_type").alias("tool"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("strategy"), F.floor(F.col("value") * 100).alias("saved_est"),
        (F.floor(F.col("value") * 1000) / 1e6).alias("worker_cost_usd"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("cache_hit"), k.alias("k"), "value",
    )


_S = ", ".join(f"'{s}'" for s, _ in ledger.STRATEGIES)
_LEDGER = rf"""l AS (SELECT event_id, ts, user_id, event_type AS tool, [{_S}, ''][(event_id % 7)::INT + 1] AS strategy, floor(value * 100)::BIGINT AS saved_est, floor(value * 1000) / 1e6 AS worker_cost_usd,
  regexp_extract(props, '"k": *(-?[0-9]+)', 1)::INT AS k, value FROM events)"""


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: src/<source>/<id>.<ext by id>."""
    ext = F.get(F.array(*map(F.lit, ("go", "py", "md", "lock", "png"))), (F.col("doc_id") % 5).cast("int"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("src/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("path"), "text")


_FILES = "f AS (SELECT doc_id, 'src/' || source || '/' || doc_id || '.' || ['go', 'py', 'md', 'lock', 'png'][(doc_id % 5)::INT + 1] AS path, text FROM documents)"


@query(f"WITH {_LEDGER} SELECT tool, count(*) AS calls, sum(saved_est)::BIGINT AS saved, round(sum(worker_cost_usd), 6) AS cost FROM l WHERE tool <> '' GROUP BY tool")
def a1_ledger_by_tool(spark, sf_dir):
    return ledger.by_tool(_events(spark, sf_dir)).withColumn("cost", F.round("cost", 6))


@query(f"WITH {_LEDGER} SELECT strategy, count(*) AS calls, sum(saved_est)::BIGINT AS saved, round(sum(worker_cost_usd), 6) AS cost FROM l WHERE strategy <> '' GROUP BY strategy")
def a2_ledger_by_strategy(spark, sf_dir):
    return ledger.by_strategy(_events(spark, sf_dir)).withColumn("cost", F.round("cost", 6))


@query(f"WITH {_LEDGER} SELECT count(*) FILTER (k % 3 = 0) AS hits, count(*) FILTER (k % 3 = 1) AS misses, count(*) FILTER (k % 3 = 0) * 100.0::DOUBLE / count(*) FILTER (k % 3 < 2) AS hit_rate FROM l")
def a3_a5_cache_counts(spark, sf_dir):
    return ledger.cache_counts(_events(spark, sf_dir))


@query(f"WITH {_LEDGER} SELECT count(*) AS calls, sum(saved_est)::BIGINT AS saved, round(sum(worker_cost_usd), 6) AS cost, count(*) FILTER (worker_cost_usd > 0) AS costed FROM l")
def a4_ledger_totals(spark, sf_dir):
    return ledger.totals(_events(spark, sf_dir)).withColumn("cost", F.round("cost", 6))


_P = ", ".join(f"('{m}', {p})" for m, p in cost.SESSION_PRICES)


@query(f"""WITH {_LEDGER}, t AS (SELECT sum(saved_est) AS s, sum(worker_cost_usd) AS c FROM l), p(family, price) AS (VALUES {_P}), v AS (SELECT family, s * price::DOUBLE / 1e6 * (1 + 5 * 0.10::DOUBLE) AS g, c FROM t, p)
SELECT family, round(g, 6) AS saved_usd, round(c, 6) AS spent_usd, round(g - c, 6) AS net_usd, CASE WHEN g - c < 0 THEN 'BEHIND' ELSE 'ahead' END AS verdict FROM v""")
def a6_j8_session_verdicts(spark, sf_dir):
    prices = spark.createDataFrame(list(cost.SESSION_PRICES), "family string, price double")
    out = ledger.verdicts(_events(spark, sf_dir), prices, turns=5)
    return out.withColumns({c: F.round(c, 6) for c in ("saved_usd", "spent_usd", "net_usd")})


@query(f"""WITH {_LEDGER}, o AS (SELECT tool AS kind, (1 + k) / 100.0::DOUBLE AS r FROM l WHERE (1 + k) / 100.0 <= 5 AND 1 + k > 0),
a AS (SELECT kind, count(*) AS count, avg(r) AS m, var_pop(r) * count(*) AS m2, coalesce(stddev_samp(r), 0.1) AS sd FROM o GROUP BY kind)
SELECT kind, count, round(m, 9) AS mean_ratio, round(m2, 6) AS m2, round(sd, 9) AS stddev, round(CASE WHEN count < 10 THEN 0.3 ELSE greatest(0.01, least(1.0, m + 1.5 * sd)) END, 9) AS conservative_ratio FROM a""")
def a7_a8_calibration(spark, sf_dir):
    obs = _events(spark, sf_dir).select(F.col("tool").alias("kind"), F.lit(100).alias("input_tokens"), (F.col("k") + 1).alias("output_tokens"))
    return cost.calibration(obs).withColumns({"mean_ratio": F.round("mean_ratio", 9), "m2": F.round("m2", 6), "stddev": F.round("stddev", 9), "conservative_ratio": F.round("conservative_ratio", 9)})


_LINES = r"n AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS raw FROM f)"


@query(f"WITH {_FILES}, {_LINES} SELECT path, count(*) AS matches FROM n WHERE regexp_matches(raw, 'the ') GROUP BY path")
def a9_s11_match_counts(spark, sf_dir):
    return search.count_matches(_files(spark, sf_dir), "the ")


@query(f"WITH {_FILES}, {_LINES}, c AS (SELECT count(*) AS total FROM n WHERE regexp_matches(raw, '(?i)THE ')) SELECT total FROM c WHERE total > 60")
def p10_matches_over_limit(spark, sf_dir):
    return search.over_limit(search.count_matches(_files(spark, sf_dir), "THE ", ignore_case=True))


@query(f"""WITH {_FILES}, n AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS d, string_split(text, chr(10)) AS ls FROM f),
u AS (SELECT path, d, ls[i] AS raw, i FROM n, unnest(range(1, len(ls) + 1)) AS t(i) WHERE regexp_matches(ls[i], 'and ')),
b AS (SELECT d, path, count(*) AS n, min_by(raw, i) AS gist FROM u GROUP BY ALL),
g AS (SELECT d AS "where", sum(n)::BIGINT AS matches, min_by(gist, path) AS gist, array_to_string((list(path ORDER BY n DESC, path))[1:5], ',') AS representative_files FROM b GROUP BY d)
SELECT * FROM g ORDER BY matches DESC, "where" LIMIT 10""")
def a10_clusters(spark, sf_dir):
    return search.clusters(search.matching_lines(_files(spark, sf_dir), "and ")).withColumn("representative_files", F.array_join("representative_files", ","))


@query(f"""WITH {_LEDGER}, a AS (SELECT user_id AS op, event_id AS attempt, k AS i, saved_est AS o, tool AS model, k % 2 = 0 AS e, worker_cost_usd AS c FROM l)
SELECT op, count(*) AS attempts, sum(i)::BIGINT AS input_tokens, round(sum(c), 6) AS cost_usd, coalesce(max_by(o, attempt) FILTER (NOT e), 0)::BIGINT AS output_tokens, max_by(model, attempt) FILTER (NOT e) AS model FROM a GROUP BY op""")
def a12_r5_escalation_usage(spark, sf_dir):
    e = _events(spark, sf_dir).select(
        F.col("user_id").alias("op"), F.col("event_id").alias("attempt"), F.col("tool").alias("model"), F.col("k").alias("input_tokens"), F.col("saved_est").alias("output_tokens"), F.lit(0).alias("cache_write"), F.lit(0).alias("cache_read"),
        F.col("worker_cost_usd").alias("cost_usd"), (F.col("k") % 2 == 0).alias("escalate"),
    )
    return cost.escalation_usage(e).drop("cache_write", "cache_read").withColumn("cost_usd", F.round("cost_usd", 6))


@query(f"WITH {_LEDGER}, m AS (SELECT user_id, tool, min(event_id) AS a FROM l GROUP BY ALL) SELECT user_id, string_agg(tool, ',' ORDER BY a) AS names FROM m GROUP BY user_id")
def a14_first_seen(spark, sf_dir):
    return ledger.first_seen(_events(spark, sf_dir), "user_id", "tool", "event_id").withColumn("names", F.array_join("names", ","))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 4 HOURS THEN 0 ELSE 1 END AS f FROM events),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT event_id, user_id, session::BIGINT AS session, row_number() OVER (PARTITION BY user_id, session, event_type ORDER BY ts, event_id)::INTEGER AS reuse_count FROM s""")
def w1_session_reuse(spark, sf_dir):
    return cost.sessions(_table(spark, sf_dir, "events"), "user_id", "event_type").select("event_id", "user_id", "session", "reuse_count")


@query(f"""WITH {_FILES}, n AS (SELECT path, string_split(text, chr(10)) AS ls FROM f),
u AS (SELECT path, i AS line_no, ls[i] AS raw, regexp_matches(ls[i], 'idiot') AS is_match FROM n, unnest(range(1, len(ls) + 1)) AS t(i) WHERE NOT (i = len(ls) AND ls[i] = '')),
c AS (SELECT *, max(is_match::INT) OVER (PARTITION BY path ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM u)
SELECT path, line_no::INTEGER AS line_no, raw, is_match FROM c WHERE near = 1""")
def w8_context_lines(spark, sf_dir):
    return search.context_lines(_files(spark, sf_dir), "idiot", before=1, after=2)


@query(f"WITH {_LEDGER}, x AS (SELECT event_id AS seq, tool, strategy FROM l WHERE lower(tool) = 'view' AND contains(strategy, 'WORKER') ORDER BY seq DESC LIMIT 25) SELECT * FROM x ORDER BY seq")
def p16_l1_last_decisions(spark, sf_dir):
    log = _events(spark, sf_dir).select(F.col("event_id").alias("seq"), "tool", F.col("strategy").alias("target"))
    return ledger.last(ledger.filter_decisions(log, "VIEW", "WORKER")).withColumnRenamed("target", "strategy")


_ORD = " ".join(f"WHEN '{s}' THEN {i}" for i, (s, _) in enumerate(ledger.STRATEGIES))
_NOTE = " ".join(f"WHEN '{s}' THEN '{n}'" for s, n in ledger.STRATEGIES)


@query(f"WITH {_LEDGER} SELECT CASE strategy {_ORD} ELSE 99 END AS ord, strategy, count(*) AS calls, sum(saved_est)::BIGINT AS saved, round(sum(worker_cost_usd), 6) AS cost, CASE strategy {_NOTE} ELSE '' END AS note FROM l WHERE strategy <> '' GROUP BY strategy ORDER BY ord")
def j4_l3_strategy_table(spark, sf_dir):
    return ledger.strategy_table(spark, ledger.by_strategy(_events(spark, sf_dir))).withColumn("cost", F.round("cost", 6))


@query("""WITH m AS (SELECT doc_id, strlen(text) AS b, len(text) - len(replace(text, chr(10), '')) AS nl, text FROM documents)
SELECT doc_id, (nl + (b > 0 AND NOT suffix(text, chr(10)))::INT)::INTEGER AS lines, b::INTEGER AS bytes, (CASE WHEN nl < 5 THEN b ELSE strlen(array_to_string(string_split(text, chr(10))[1:5], chr(10))) + 1 END)::INTEGER AS prefix_bytes, ((b + 3) // 4)::BIGINT AS tokens FROM m""")
def p1_p14_measure(spark, sf_dir):
    return measure.measure(_table(spark, sf_dir, "documents").select("doc_id", "text"), 5).select("doc_id", "lines", "bytes", "prefix_bytes", "tokens")


@query("SELECT doc_id FROM documents WHERE strlen(text) > 2000 OR len(text) - len(replace(text, chr(10), '')) + (NOT suffix(text, chr(10)))::INT > 8")
def p2_over_threshold(spark, sf_dir):
    m = measure.measure(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return m.where(P.exceeds(F.col("lines"), F.col("bytes"), 8, 2000)).select("doc_id")


@query(f"WITH {_FILES} SELECT path, suffix(path, '.png') OR contains(text[1:512], chr(0)) AS binary FROM f")
def p3_looks_binary(spark, sf_dir):
    return _files(spark, sf_dir).select("path", P.looks_binary(F.col("path"), F.col("text").cast("binary")).alias("binary"))


@query("""WITH c AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'cat a.txt' WHEN 1 THEN 'go test ./...' WHEN 2 THEN 'echo hi' WHEN 3 THEN 'concatenate x' ELSE 'npm run test | tee log' END AS cmd FROM events)
SELECT event_id, CASE WHEN regexp_matches(cmd, '\\bcat\\s') THEN '\\bcat\\s' WHEN regexp_matches(cmd, 'npm\\s+(run\\s+)?test') THEN 'npm\\s+(run\\s+)?test' WHEN regexp_matches(cmd, 'go\\s+test') THEN 'go\\s+test' END AS pattern,
  contains(cmd, '|') AS meta FROM c""".replace("\\\\", "\\"))
def p4_p12_r18_noisy_commands(spark, sf_dir):
    pick = F.get(F.array(*map(F.lit, ("cat a.txt", "go test ./...", "echo hi", "concatenate x", "npm run test | tee log"))), (F.col("event_id") % 5).cast("int"))
    e = _table(spark, sf_dir, "events").select("event_id", pick.alias("cmd"))
    return e.select("event_id", P.first_match(F.col("cmd"), [*P.NOISY_COMMANDS, "("]).alias("pattern"), P.shell_meta(F.col("cmd")).alias("meta"))


@query(f"WITH {_FILES} SELECT path FROM f WHERE suffix(path, '.md')")
def p5_passthrough(spark, sf_dir):
    return _files(spark, sf_dir).where(P.passes_through(F.col("path"), list(P.PASSTHROUGH_GLOBS))).select("path")


@query(f"WITH {_FILES} SELECT CASE WHEN suffix(path, '.go') THEN 'go' WHEN suffix(path, '.py') THEN 'python' END AS parser, count(*) AS files FROM f GROUP BY ALL")
def p19_p21_dispatch(spark, sf_dir):
    return _files(spark, sf_dir).groupBy(P.parser_of(F.col("path")).alias("parser")).agg(F.count("*").alias("files"))


_PLAN = """WITH m AS (SELECT doc_id, strlen(text) AS b, (strlen(text) + 3) // 4 AS t FROM documents), p AS (SELECT *, trunc(t * 0.3::DOUBLE)::BIGINT AS o FROM m),
e AS (SELECT *, (t + 650) * 0.8::DOUBLE / 1e6 + o * 4.0::DOUBLE / 1e6 AS c, (t - o) * 15.0::DOUBLE / 1e6 AS g FROM p)
SELECT doc_id, t::BIGINT AS orig_tokens, CASE WHEN b <= 0 THEN 'PASSTHROUGH' WHEN o >= t THEN 'DIRECT' WHEN g <= c * 1.5 THEN 'DIRECT' WHEN g - c < 0.001 THEN 'DIRECT' ELSE 'CHEAP_WORKER' END AS strategy, round(g - c, 9) AS net FROM e"""


@query(_PLAN)
def r1_r2_j1_read_plans(spark, sf_dir):
    m = measure.measure(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    plans = cost.plan_reads(m, "bytes", "lines", cost.pricing(spark), max_lines=-1, max_bytes=-1)
    return plans.select("doc_id", "orig_tokens", "strategy", F.round("est_savings_usd", 9).alias("net"))


@query("SELECT doc_id, sha256(coalesce(text, '') || chr(0) || 'm' || chr(0) || '1') AS key FROM documents")
def r7_content_keys(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", cost.content_key(F.col("text"), F.lit("m")).alias("key"))


@query("WITH k AS (SELECT doc_id, md5(text) AS key FROM documents), c AS (SELECT DISTINCT key FROM k WHERE doc_id % 3 = 0) SELECT doc_id, key IN (SELECT key FROM c) AS hit FROM k")
def j3_s8_cache_lookup(spark, sf_dir):
    items = _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("key"))
    hits, misses = cost.cache_lookup(items, items.where("doc_id % 3 = 0").select("key").distinct())
    return hits.select("doc_id", F.lit(True).alias("hit")).union(misses.select("doc_id", F.lit(False)))


@query(f"""WITH {_LEDGER}, o AS (SELECT tool AS kind, (1 + k) / 100.0::DOUBLE AS r FROM l WHERE k >= 0), a AS (SELECT kind, count(*) AS n, avg(r) AS m, stddev_samp(r) AS sd FROM o GROUP BY kind)
SELECT event_id, round(CASE WHEN n >= 10 THEN greatest(0.01, least(1.0, m + 1.5 * sd)) ELSE 0.3 END, 9) AS ratio FROM l LEFT JOIN a ON a.kind = l.tool""")
def j5_calibrated_ratios(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("kind", F.col("tool"))
    obs = e.select("kind", F.lit(100).alias("input_tokens"), (F.col("k") + 1).alias("output_tokens"))
    return cost.with_ratio(e, cost.calibration(obs)).select("event_id", F.round("ratio", 9).alias("ratio"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT doc_id, CASE WHEN ls[-1] = '' THEN ls[1:-2] ELSE ls END AS ls FROM l)
SELECT doc_id, i::INTEGER AS line_no, ls[i] AS raw FROM n, unnest(range(1, len(ls) + 1)) AS t(i)""")
def s3_lines(spark, sf_dir):
    return T.explode_lines(_table(spark, sf_dir, "documents"), "text", ("doc_id",))


@query("SELECT tool, count(*) AS calls, sum(saved)::BIGINT AS saved FROM (SELECT event_type AS tool, floor(value * 100)::BIGINT AS saved FROM events WHERE event_id % 10 <> 3) GROUP BY tool")
def s5_tolerant_log_scan(spark, sf_dir):
    """The log is written as JSON lines with a spoiled line among every ten."""
    e = _table(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.col("event_type").alias("tool"), F.floor(F.col("value") * 100).alias("saved_est")))
    bad = F.get(F.array(F.lit("not json"), F.lit('{"tool":"R","saved_est":"x"}'), F.lit('{"tool":"R"} trailing'), F.lit("")), (F.col("event_id") % 4).cast("int"))
    lines = e.select(F.when(F.col("event_id") % 10 == 3, bad).otherwise(good).alias("value"))
    return ledger.by_tool(ledger.parse_log(lines, ledger.LEDGER_SCHEMA)).select("tool", "calls", "saved")


@query("SELECT doc_id, strlen(array_to_string(string_split(text, chr(10))[1:3], chr(10)))::INTEGER AS head_bytes FROM documents")
def l7_heads(spark, sf_dir):
    return measure.first_lines(_table(spark, sf_dir, "documents"), 3).select("doc_id", F.octet_length("first").alias("head_bytes"))


@query("SELECT doc_id, md5(encode(text)[-64:]) AS tail FROM documents")
def s12_byte_tails(spark, sf_dir):
    """Of all texts: a tail may begin inside a character."""
    return measure.tail(_table(spark, sf_dir, "documents"), 64).select("doc_id", F.md5("tail").alias("tail"))


_OUTPUTS = (
    ("go_test", "=== RUN   TestA\n--- PASS: TestA (0.00s)\n=== RUN   TestB\n\tb_test.go:12: want 1, got 2\n--- FAIL: TestB (0.01s)\nFAIL\nFAIL\texample.com/x\t0.02s\nsome chatter that is dropped\n", "[1 tests passed — output omitted]\n\tb_test.go:12: want 1, got 2\n--- FAIL: TestB (0.01s)\nFAIL\nFAIL\texample.com/x\t0.02s"),
    ("git_status", "On branch main\nYour branch is up to date.\n\nChanges not staged for commit:\n  (use \"git add <file>...\" to update)\n\tmodified:   a.go\n\tdeleted:    b.go\n\nUntracked files:\n  (use \"git add <file>...\" to include)\n\tc.txt\n", "On branch main\nYour branch is up to date.\nChanges (2):\n\tmodified:   a.go\n\tdeleted:    b.go\nUntracked (1):\n\tc.txt"),
    ("build", "downloading x\nmain.go:3:5: undefined: y\nbuild failed\nFAILED: all of it\nverifying the checksum of everything\n", "main.go:3:5: undefined: y\nFAILED: all of it"),
    ("generic_test", "collected 3 items\ntest_a PASSED\ntest_b FAILED\n  assert no\n\n....F....\n=== 1 failed, 2 passed in 0.1s ===\nbye and a longer line here\n", "test_b FAILED\n  assert no\n\n=== 1 failed, 2 passed in 0.1s ==="),
    ("", "nothing of interest\n", "nothing of interest\n"),
)


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"


@query("SELECT * FROM (VALUES " + ", ".join(f"({_sql_text(k)}, {_sql_text(o)})" for k, _, o in _OUTPUTS) + ") AS v(kind, output)")
def c1_c2_c5_c6_c7_reducers(spark, sf_dir):
    return reduce.reduce_output(spark.createDataFrame([(t,) for _, t, _ in _OUTPUTS], "text string")).select("kind", "output")


_DIFF = "diff --git a/x.go b/x.go\nindex 1..2\n--- a/x.go\n+++ b/x.go\n@@ -1,3 +1,3 @@\n-old\n+new token\n ctx\n@@ -9,2 +9,2 @@\n+plain\n" + " filler line of context\n" * 12
_LOG = "".join(f"commit {i:040x}\nAuthor: A B <a@b.c>\nDate:   Mon Jan 1 10:00:00 2024\n\n    subject {i}\n\n    body of the change\n" for i in range(8))
_LOG_OUT = "8 commits:\n\n" + "".join("0000000  Mon  A B\n" + f"    subject {i}\n" for i in range(8))


@query(f"""SELECT * FROM (VALUES ('git_diff', {_sql_text("git diff — 1 file(s), +2 -1 lines" + chr(10) * 2 + "  " + "x.go".ljust(50) + " +2    -1" + chr(10) + chr(10) + "[x.go — sensitive hunk]" + chr(10) + "@@ -1,3 +1,3 @@" + chr(10) + "-old" + chr(10) + "+new token" + chr(10) + " ctx" + chr(10))}, false), ('git_log', {_sql_text(_LOG_OUT)}, true)) AS v(kind, output, complete)""")
def c3_c4_a11_w10_git_reducers(spark, sf_dir):
    return reduce.reduce_output(spark.createDataFrame([(_DIFF,), (_LOG,)], "text string")).select("kind", "output", "complete")


@query(f"""SELECT {_sql_text(render.FRAMING + "a.go is large — digest instead of full contents." + chr(10) * 2 + "sums" + chr(10) * 2 + "Structure:" + chr(10) + "  1-3        func A" + chr(10) + chr(10) + "Key symbols: A, B" + chr(10) + chr(10) + "For exact lines, Read again with offset/limit on the range you need." + chr(10) + "To force the full file: loom cat a.go" + chr(10))} AS out""")
def r8_render_file_map(spark, sf_dir):
    m = spark.createDataFrame([(("sums", [("1-3", "func A")], ["A", "B"], ""),)], f"m {render.MAP_TYPE}")
    n = F.lit(10)
    return m.select(render.file_map(F.col("m"), F.lit("a.go"), "loom", n, n, n, n).alias("out"))


@query(f"WITH {_LEDGER}, e AS (SELECT *, value / 1000 AS est FROM l) SELECT event_id, round(abs(est - worker_cost_usd), 9) AS gap_usd, CASE WHEN worker_cost_usd > est THEN 'under' WHEN worker_cost_usd < est THEN 'over' ELSE 'exact' END AS gap_kind FROM e")
def r11_prediction_gap(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", (F.col("value") / 1000).alias("est_worker_cost_usd"), F.col("worker_cost_usd").alias("actual_worker_cost_usd"))
    return ledger.prediction_gap(e).select("event_id", F.round("gap_usd", 9).alias("gap_usd"), "gap_kind")


_GREP = _PLAN.replace("(t + 650) * 0.8", "(((b // 2) + 3) // 4 + 650) * 0.8").replace("WHEN b <= 0 THEN 'PASSTHROUGH'", "WHEN b <= 0 THEN 'DIRECT'")


@query(_GREP)
def r3_grep_plans(spark, sf_dir):
    m = measure.measure(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("half", F.floor(F.col("bytes") / 2))
    plans = cost.plan_greps(m, "half", "bytes", cost.pricing(spark))
    return plans.select("doc_id", "orig_tokens", "strategy", F.round("est_savings_usd", 9).alias("net"))


@query("SELECT * FROM (VALUES ('build', 'DETERMINISTIC'), ('generic_test', 'DETERMINISTIC'), ('git_status', 'DETERMINISTIC'), ('go_test', 'DETERMINISTIC'), ('git_diff', 'DIRECT'), ('', 'DIRECT'), ('', 'CHEAP_WORKER')) AS v(kind, strategy)")
def r4_run_plans(spark, sf_dir):
    texts = [(t,) for _, t, _ in _OUTPUTS] + [(_DIFF,), ("a plain line of output without any marker\n" * 200,)]
    return cost.plan_runs(reduce.reduce_output(spark.createDataFrame(texts, "text string")), cost.pricing(spark)).select("kind", "strategy")


@query("SELECT doc_id, ((strlen(text) + 3) // 4 - (strlen(text) // 3 + 3) // 4)::BIGINT AS saved_est FROM documents")
def r17_run_savings(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("o")).withColumn("d", F.floor(F.col("o") / 3))
    return cost.run_entries(d, "o", "d").select("doc_id", "saved_est")


_STATS = [("Read", "DETERMINISTIC", 20000, 0.0, True), ("Read", "CHEAP_WORKER", 5000, 0.05, False), ("Bash", "DIRECT", 0, 0.0, None)]


@query("""SELECT * FROM (VALUES (1001, '  Bash              1              0       0.0000'), (1002, '  Read              2          25000       0.0500'), (2001, '  cache   1 hit / 1 miss (50% hit rate, Read only)'),
(3001, '  DETERMINISTIC                 1          20000       0.0000   no worker — AST/regex'), (3002, '  CHEAP_WORKER                  1           5000       0.0500   Haiku worker'), (3003, '  DIRECT                        1              0       0.0000   engine: not worth intercepting'),
(4001, '  assuming a opus-5 session (5.00 $/Mtok in), content surviving 10 more turns:'), (5001, '    saved    ~25000 tokens  =  $0.1250 on first read, $0.2500 with re-sends'),
(6001, '    spent    $0.0500 actually billed by the worker (1 of 3 calls reported cost)'), (7001, '    net      $+0.2000  — ahead')) AS v(ord, line)""")
def r12_stats_report(spark, sf_dir):
    return reports.stats(spark, spark.createDataFrame(_STATS, "tool string, strategy string, saved_est long, worker_cost_usd double, cache_hit boolean"))


@query("SELECT * FROM (VALUES (2, 'Read  b.go  CHEAP_WORKER  net $0.0100  gap $0.0010 (under-estimated)'), (3, 'Read  c.go  DIRECT  net $0.0000')) AS v(ord, line)")
def r14_explain_report(spark, sf_dir):
    rows = [(1, "Read", "a.go", "DIRECT", 0.0, 0.0, 0.0), (2, "Read", "b.go", "CHEAP_WORKER", 0.01, 0.002, 0.003), (3, "read", "c.go", "DIRECT", 0.0, 0.0, 0.0), (4, "Bash", "c.go", "DIRECT", 0.0, 0.0, 0.0)]
    log = spark.createDataFrame(rows, "seq int, tool string, target string, strategy string, est_net_savings_usd double, est_worker_cost_usd double, actual_worker_cost_usd double")
    return reports.explain(log.withColumn("tool", F.initcap("tool")), "READ", ".go", 2)


@query("SELECT model, i::DOUBLE AS input FROM (VALUES " + ", ".join(f"('{m}', {9.5 if m == 'opus-5' else p[0]})" for m, *p in cost.PRICES) + ", ('new', 7.0)) AS v(model, i)")
def j2_r13_price_overrides(spark, sf_dir):
    o = spark.createDataFrame([("opus-5", 9.5, None, None, None), ("new", 7.0, 1.0, 1.0, 1.0)], "model string, input double, output double, cache_write double, cache_read double")
    return cost.pricing(spark, o).select("model", "input")


@query(f"SELECT 's.sql' AS path, {_sql_text(render.FRAMING + 's.sql is large — digest instead of full contents.' + chr(10) * 2 + 'SQL — 1 table, 1 index, 1 function' + chr(10) * 2 + 'Structure:' + chr(10) + '  2-4        table users' + chr(10) + '  5          index i on users' + chr(10) + '  6-8        function f' + chr(10) * 2 + 'Key symbols: table users, index i on users, function f' + chr(10) * 2 + 'For exact lines, Read again with offset/limit on the range you need.' + chr(10) + 'To force the full file: loom cat s.sql' + chr(10))} AS text")
def r15_map_report(spark, sf_dir):
    from ..operators import scanners

    text = "-- c\nCREATE TABLE users (\n  id int\n);\nCREATE UNIQUE INDEX i ON users (id);\nCREATE FUNCTION f() RETURNS int AS $$\n select 1;\n$$ LANGUAGE sql;\n"
    return reports.map_report(scanners.outline(spark.createDataFrame([("s.sql", text)], "path string, text string"), "sql"))


from . import more, outlines  # noqa: E402, F401  (they add their queries)
