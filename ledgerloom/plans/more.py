"""Queries of the remaining operators: predicates, sources, windows, renderings, the worker and plans of reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import cost, ledger, measure, outline, reduce, render, scanners, search, worker
from ..sources import files as sources
from . import reading, reports
from .registry import _FILES, _LEDGER, _events, _files, _sql_text, _table, query


def _pick(values: tuple, by: Column) -> Column:
    """values[by mod their number]."""
    return F.get(F.array(*map(F.lit, values)), F.pmod(by, F.lit(len(values))).cast("int"))


def _sql_pick(values: tuple, by: str) -> str:
    items = ", ".join(_sql_text(v) if isinstance(v, str) else str(v).lower() for v in values)
    return f"[{items}][({by} % {len(values)})::INT + 1]"


def _temporary(spark, name: str) -> str:
    """A new folder that all executors see."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None and not (spark.sparkContext.master + "[").startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{root or tempfile.mkdtemp(prefix='ledgerloom-')}/{name}-{uuid.uuid4().hex}"


# --- predicates -------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'recursion guard' WHEN event_id % 5 = 0 THEN 'environment' WHEN event_id % 3 = 0 THEN 'config.disabled' WHEN event_id % 2 = 0 THEN 'invalid config: x' ELSE '' END AS reason FROM events")
def p6_inactive_reason(spark, sf_dir):
    i = F.col("event_id")
    on = lambda n: F.when(i % n == 0, "1").otherwise("")
    reason = P.inactive_reason(on(7), on(5), i % 3 == 0, F.when(i % 2 == 0, "x").otherwise(""))
    return _table(spark, sf_dir, "events").select("event_id", reason.alias("reason"))


@query(f"WITH {_LEDGER} SELECT event_id, coalesce(CASE WHEN k % 2 = 0 THEN NULL ELSE k END, 0) <> 0 OR event_id % 4 <> 0 AS targeted FROM l")
def p7_targeted_reads(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.select("event_id", P.targeted_read(F.when(F.col("k") % 2 != 0, F.col("k")), F.col("event_id") % 4).alias("targeted"))


@query(f"WITH {_FILES} SELECT path, doc_id % 5 = 0 AND doc_id % 3 <> 0 AS regular FROM f")
def p8_regular_files(spark, sf_dir):
    i = F.col("doc_id")
    return _files(spark, sf_dir).select("path", P.is_regular(F.when(i % 5 == 0, True), i % 3 == 0).alias("regular"))


_MODES = ("", "content", "count", "files_with_matches")


@query(f"WITH {_LEDGER} SELECT event_id, {_sql_pick(_MODES, 'event_id')} <> 'content' OR k > 0 AND k <= 60 AS bypass FROM l")
def p9_grep_bypass(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", P.grep_bypass(_pick(_MODES, F.col("event_id")), F.col("k")).alias("bypass"))


_COMMANDS = ("loom run -- x", "/opt/loom cat a.go", "cat a.txt", "echo hi", "npm run test | tee log", "sudo loom run -- x", "go test ./...", "'loom' run -- 'it''s'", "loom stats")


@query(f"WITH c AS (SELECT event_id, {_sql_pick(_COMMANDS, 'event_id')} AS cmd FROM events) SELECT event_id, regexp_matches(cmd, '^(/opt/loom|loom|''loom'') (run|cat)( |$)') AS own FROM c")
def p11_own_commands(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", P.self_command(_pick(_COMMANDS, F.col("event_id")), "/opt/loom").alias("own"))


_REDIRECT = "'this command tends to produce large output (matched /' || p || '/).' || chr(10) || 'Re-run it as follows so the full output is captured to a log and you get a digest:' || chr(10) || chr(10) || '  /opt/loom run -- '"


@query(f"""WITH c AS (SELECT event_id, {_sql_pick(_COMMANDS, 'event_id')} AS cmd FROM events),
m AS (SELECT *, CASE WHEN cmd = 'cat a.txt' THEN '\\bcat\\s' WHEN contains(cmd, 'npm') THEN 'npm\\s+(run\\s+)?test' WHEN contains(cmd, 'go test') THEN 'go\\s+test' END AS p FROM c)
SELECT event_id, {_REDIRECT} || CASE WHEN contains(cmd, '|') THEN 'sh -c ''' || replace(cmd, '''', '''\\''''') || '''' ELSE cmd END || chr(10) AS instead FROM m""".replace("\\\\", "\\"))
def p13_r18_redirects(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", P.redirect(_pick(_COMMANDS, F.col("event_id")), "/opt/loom").alias("instead"))


@query("SELECT doc_id, n_chars > 0 AND doc_id % 700 > 0 AND doc_id % 700 < n_chars AS is_partial FROM documents")
def p15_partial_coverage(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", P.partial(F.col("doc_id") % 700, F.col("n_chars")).alias("is_partial"))


_DIGESTS = (
    '{"summary":"s","map":[{"lines":"1-3","kind":"a"},{"lines":"7","kind":"b"}]}', '{"summary":"","map":[{"lines":"1","kind":"a"}]}', '{"summary":"s","map":[]}', '{"summary":"s","map":[{"lines":"1-","kind":"a"}]}',
    '{"summary":"s","clusters":[{"where":"a","matches":2,"gist":"g"}],"total":2}', '{"summary":"s","clusters":[]}', '{"summary":"s","key_lines":[],"exit_code":1}', "not json", '{"escalate":true}', '{"escalate":"no"}',
)


@query("SELECT event_id, event_id % 10 = 0 AS is_map, event_id % 10 = 4 AS is_clusters, event_id % 10 IN (0, 2, 3, 4, 5, 6) AS is_run, event_id % 10 = 8 AS escalates FROM events")
def p17_p18_digest_checks(spark, sf_dir):
    raw = _pick(_DIGESTS, F.col("event_id"))
    d = _table(spark, sf_dir, "events").select("event_id", raw.alias("raw"))
    d = d.select("event_id", "raw", *[F.from_json("raw", t).alias(n) for n, t in (("m", render.MAP_TYPE), ("c", render.CLUSTERS_TYPE), ("r", render.RUN_TYPE))])
    no = F.lit(False)
    return d.select("event_id", F.coalesce(P.valid_map(F.col("m")), no).alias("is_map"), P.valid_clusters(F.col("c")).alias("is_clusters"), P.valid_run(F.col("r")).alias("is_run"), P.escalates(F.col("raw")).alias("escalates"))


_NAMES = ("a.go", "a_test.go", "b/c_test.go", "go.sum", "test.go", "Cargo.lock", "package-lock.json")


@query(f"WITH n AS (SELECT event_id, {_sql_pick(_NAMES, 'event_id')} AS n FROM events) SELECT event_id, n LIKE '%\\_test.go' ESCAPE '\\' AS go_test, n IN ('Cargo.lock', 'package-lock.json') AS locked FROM n")
def p19_p20_tests_and_locks(spark, sf_dir):
    n = _pick(_NAMES, F.col("event_id"))
    return _table(spark, sf_dir, "events").select("event_id", P.is_go_test(n).alias("go_test"), P.is_lock_file(n).alias("locked"))


_MODELS = ("claude-haiku-4-5", "SONNET", "claude-opus-5-5", "other", "")


@query(f"SELECT event_id, {_sql_pick(('haiku', 'sonnet', 'opus', '', ''), 'event_id')} AS family FROM events")
def p22_model_families(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", P.model_family(_pick(_MODELS, F.col("event_id"))).alias("family"))


@query(f"SELECT k AS number, p AS parser FROM (VALUES {', '.join(f'({i}, {_sql_text(p)})' for i, p in enumerate(sorted(P.PARSERS)))}) AS v(k, p) UNION ALL SELECT -1, NULL")
def p21_every_parser(spark, sf_dir):
    paths = [(i, f"x/A{P.PARSERS[p][-1].upper() if p != 'dockerfile' else P.PARSERS[p][0]}") for i, p in enumerate(sorted(P.PARSERS))] + [(-1, "x/a.unknown")]
    return spark.createDataFrame(paths, "number int, path string").select("number", P.parser_of(F.col("path")).alias("parser"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = l_linenumber + l_suppkey % 3 THEN l_linenumber::VARCHAR ELSE l_linenumber || '-' || (l_linenumber + l_suppkey % 3) END AS lines FROM lineitem")
def p23_line_ranges(spark, sf_dir):
    start = F.col("l_linenumber")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.line_range(start, start + F.col("l_suppkey") % 3).alias("lines"))


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey::INTEGER AS s_suppkey, s_name AS text, strlen(s_name)::BIGINT AS length, substr(s_name, 1, 8) AS head FROM supplier")
def s1_s2_p8_files_read_back(spark, sf_dir):
    """Each supplier's name is written as a file of its own; files are listed, read whole and read in part."""
    path = _temporary(spark, "files")
    s = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.col("s_name").alias("value"))
    s.write.partitionBy("key").text(path)
    key = F.regexp_extract("path", r"key=(\d+)/", 1).cast("int").alias("s_suppkey")
    whole = sources.read_whole(spark, f"{path}/*/*.txt").select(key, F.regexp_replace("text", "\n$", "").alias("text"))
    heads = sources.read_capped(spark, f"{path}/*/*.txt", 8).select(key, F.col("content").cast("string").alias("head"))
    listed = sources.regular_files(spark, path).where(F.endswith("path", F.lit(".txt"))).select(key, (F.col("length") - 1).alias("length"))
    return whole.join(heads, "s_suppkey").join(listed, "s_suppkey").select("s_suppkey", "text", "length", "head")


@query(f"WITH {_LEDGER}, r AS (SELECT tool, strategy, saved_est FROM l UNION ALL SELECT tool, strategy, saved_est FROM l WHERE event_id % 2 = 0) SELECT tool, count(*) AS calls, sum(saved_est)::BIGINT AS saved FROM r WHERE tool <> '' GROUP BY tool")
def s4_ledger_appended(spark, sf_dir):
    """Two writes to one log."""
    path, e = _temporary(spark, "ledger"), _events(spark, sf_dir).select("tool", "strategy", "saved_est")
    ledger.write_log(e, path)
    ledger.write_log(_events(spark, sf_dir).where("event_id % 2 = 0").select("tool", "strategy", "saved_est"), path)
    return ledger.by_tool(ledger.parse_log(spark.read.text(path), ledger.LEDGER_SCHEMA)).select("tool", "calls", "saved")


@query(f"WITH {_LEDGER} SELECT tool, count(*) AS n, max(saved_est)::BIGINT AS most FROM l WHERE event_id % 3 <> 0 GROUP BY tool")
def s6_decision_log_scan(spark, sf_dir):
    """Decisions over the log's size for a line, or broken off, are left out."""
    path = _temporary(spark, "decisions")
    d = _events(spark, sf_dir).select("event_id", "tool", F.col("saved_est").alias("reuse_count"))
    line = F.to_json(F.struct("tool", F.col("reuse_count").cast("int").alias("reuse_count"), F.when(F.col("event_id") % 3 == 0, F.repeat(F.lit("x"), 600)).alias("reason")))
    d.select(line.alias("value")).write.text(path)
    rows = ledger.parse_log(spark.read.text(path), ledger.DECISION_SCHEMA, max_bytes=512)
    return rows.groupBy("tool").agg(F.count("*").alias("n"), F.max("reuse_count").cast("long").alias("most"))


@query("SELECT c_custkey, c_name, c_nationkey + 1 AS c_nationkey FROM customer")
def s7_state_saved_and_loaded(spark, sf_dir):
    path, state = _temporary(spark, "state"), _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
    sources.write_state(state, path)
    sources.write_state(state.withColumn("c_nationkey", F.col("c_nationkey") + 1), path)
    return spark.read.schema(state.schema).json(path)


@query("""WITH c AS (SELECT doc_id % 50 AS key, doc_id AS mtime, n_chars AS bytes FROM documents), p AS (SELECT key, max(mtime) AS mtime, max_by(bytes, mtime) AS bytes FROM c GROUP BY key)
SELECT count(*) AS entries, sum(bytes)::BIGINT // 1024 AS kb, count(*) FILTER (TIMESTAMP '2024-01-01' + to_hours(mtime) < TIMESTAMP '2024-02-10' - INTERVAL 7 DAY) AS swept FROM p""")
def s8_a16_cache_put_and_counts(spark, sf_dir):
    """Documents as entries of fifty keys, put in two parts; the latest stands."""
    d = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("key"), F.timestamp_add("HOUR", F.col("doc_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("mtime"), F.col("n_chars").alias("bytes"), "doc_id")
    one, two = d.where("doc_id % 3 = 0").drop("doc_id"), d.where("doc_id % 3 <> 0").drop("doc_id")
    return cost.cache_counts(cost.cache_put(one, two), F.lit("2024-02-10 00:00:00").cast("timestamp_ntz"))


@query(f"""WITH {_LEDGER} SELECT event_id, {_sql_pick(('Read', 'Bash', 'Grep'), 'event_id')} AS tool, CASE WHEN event_id % 3 = 0 THEN 'f' || k END AS file_path, CASE WHEN event_id % 3 = 1 THEN 'run ' || k END AS command, CASE WHEN event_id % 3 = 2 THEN k END AS after FROM l WHERE event_id % 11 <> 0""")
def s9_hook_events(spark, sf_dir):
    e = _events(spark, sf_dir)
    i, k = F.col("event_id"), F.col("k").cast("string")
    inner = F.when(i % 3 == 0, F.format_string('{"file_path":"f%s","offset":1}', k)).when(i % 3 == 1, F.format_string('{"command":"run %s"}', k)).otherwise(F.format_string('{"pattern":"p","-A":%s}', k))
    value = F.when(i % 11 == 0, "{broken").otherwise(F.concat(F.lit('{"tool_name":"'), _pick(("Read", "Bash", "Grep"), i), F.lit('","cwd":"'), i.cast("string"), F.lit('","tool_input":'), inner, F.lit("}")))
    h = sources.hook_events(e.select(value.alias("value")))
    return h.select(F.col("cwd").cast("long").alias("event_id"), F.col("tool_name").alias("tool"), "read.file_path", "bash.command", F.col("grep.-A").alias("after"))


@query("""SELECT event_id, '{"hookSpecificOutput":{"hookEventName":"PreToolUse","permissionDecision":"deny","permissionDecisionReason":"' || event_type || '"}}' AS out FROM events WHERE event_id % 2 = 0""")
def s10_decisions_out(spark, sf_dir):
    return _table(spark, sf_dir, "events").where("event_id % 2 = 0").select("event_id", render.deny(F.col("event_type")).alias("out"))


@query(f"WITH {_FILES} SELECT path, len(regexp_extract_all(text, '[.]' || chr(10) || 'The')) AS matches FROM f WHERE suffix(path, '.py') AND regexp_matches(text, '[.]' || chr(10) || 'The') UNION ALL SELECT path, len(regexp_extract_all(text, 'a.The')) FROM f WHERE suffix(path, '.py') AND regexp_matches(text, 'a.The')")
def s11_multiline_by_type(spark, sf_dir):
    """A pattern over a line's end, and one whose dot doesn't cross it; in files of one type."""
    f = _files(spark, sf_dir)
    return search.count_multiline(f, r"[.]\nThe", kind="py").union(search.count_multiline(f, "a.The", kind="py"))


@query(f"WITH {_LEDGER}, t AS (SELECT event_id AS seq, tool FROM l ORDER BY event_id DESC LIMIT 5) SELECT * FROM t")
def s13_log_tail(spark, sf_dir):
    return ledger.last(_events(spark, sf_dir).select(F.col("event_id").alias("seq"), "tool"), 5)


@query("SELECT (r_regionkey * 4 + k + 1)::BIGINT AS line_no, CASE k WHEN 0 THEN 'func Work' || r_regionkey || '(n int) int {' WHEN 1 THEN chr(9) || 'return n' WHEN 2 THEN '}' ELSE '' END AS raw FROM region, (VALUES (0), (1), (2), (3)) AS v(k)")
def s14_synthetic_source(spark, sf_dir):
    return measure.synthetic_source(spark, _table(spark, sf_dir, "region").count())


_SHOWN = "list_filter(string_split(text, chr(10)), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT doc_id, text, len({_SHOWN}) AS n, trim(({_SHOWN})[1], ' ') AS f FROM documents WHERE len({_SHOWN}) > 0)
SELECT doc_id::VARCHAR AS op, (len(string_split(text, chr(10))) - (suffix(text, chr(10)))::INT) || ' lines, from: ' || f AS summary, 11::BIGINT AS input_tokens, 0.0425::DOUBLE AS cost_usd FROM d WHERE length(f) <= 60 AND regexp_matches(f, '^[ -~]+$')""")
def s15_r16_worker_digests(spark, sf_dir):
    """Documents asked of the stand-in; those whose first line fits a summary whole."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("op"), "text")
    asked = d.select("op", worker.prompt(F.lit("file_map"), F.col("op"), F.col("text"), F.lit(False), F.lit(False)).alias("prompt"))
    got = worker.summarise(asked).select("op", F.from_json("raw", render.MAP_TYPE).alias("d"), "input_tokens", "cost_usd")
    first = F.trim(F.get(F.filter(F.split("text", "\n"), lambda x: x != ""), 0))
    some = d.where((F.length(first) <= 60) & first.rlike("^[ -~]+$")).select("op")
    return got.join(some, "op").select("op", "d.summary", "input_tokens", "cost_usd")


@query("SELECT event_id::VARCHAR AS op, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END::BIGINT AS attempts, CASE WHEN event_id % 4 = 0 THEN 'sonnet' ELSE 'haiku' END AS model, CASE WHEN event_id % 4 = 0 THEN 22 ELSE 11 END::BIGINT AS input_tokens, 22::BIGINT AS output_tokens FROM events WHERE event_id % 100 < 8")
def r5_escalation_tiers(spark, sf_dir):
    """A file too long for the first tier goes to the next."""
    e = _table(spark, sf_dir, "events").where("event_id % 100 < 8").select(F.col("event_id").cast("string").alias("op"), F.when(F.col("event_id") % 4 == 0, 2100).otherwise(3).alias("n"))
    asked = e.select("op", worker.prompt(F.lit("file_map"), F.col("op"), F.repeat(F.lit("x\n"), F.col("n")), F.lit(False), F.lit(True)).alias("prompt"))
    return cost.escalation_usage(worker.escalated(asked)).select("op", "attempts", "model", "input_tokens", "output_tokens")


# --- windows and lists ------------------------------------------------------------------------------------------------

_DOC_LINES = "n AS (SELECT doc_id, CASE WHEN string_split(text, chr(10))[-1] = '' THEN string_split(text, chr(10))[1:-2] ELSE string_split(text, chr(10)) END AS ls FROM documents), u AS (SELECT doc_id, i AS line_no, ls[i] AS raw FROM n, unnest(range(1, len(ls) + 1)) AS t(i))"


def _doc_lines(spark, sf_dir) -> DataFrame:
    return T.explode_lines(_table(spark, sf_dir, "documents"), "text", ("doc_id",))


@query(f"WITH {_DOC_LINES}, h AS (SELECT *, max(line_no) OVER (PARTITION BY doc_id) AS last FROM u), s AS (SELECT * FROM h WHERE regexp_matches(raw, '^(The|A|De|La)')) SELECT doc_id, line_no::INTEGER AS start_line, coalesce(lead(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) - 1, last)::INTEGER AS end_line FROM s")
def w3_sections(spark, sf_dir):
    return T.with_section(_doc_lines(spark, sf_dir), F.col("raw").rlike("^(The|A|De|La)"), "doc_id").select("doc_id", "start_line", "end_line")


@query(f"""WITH {_DOC_LINES}, m AS (SELECT doc_id, line_no, (len(raw) - len(replace(raw, 'a', '')))::BIGINT - (len(raw) - len(replace(raw, 'e', ''))) AS d FROM u), s AS (SELECT *, sum(d) OVER (PARTITION BY doc_id ORDER BY line_no) AS s FROM m),
c AS (SELECT doc_id, line_no, (s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY line_no)))::BIGINT AS depth FROM s)
SELECT doc_id, line_no::INTEGER AS line_no, depth, coalesce(lag(depth) OVER (PARTITION BY doc_id ORDER BY line_no), 0)::BIGINT AS depth_before FROM c""")
def w4_w5_depths(spark, sf_dir):
    """Depth of lines, where an a opens and an e closes."""
    count = lambda x: F.length("raw") - F.length(F.replace("raw", F.lit(x), F.lit("")))
    return T.with_depth(_doc_lines(spark, sf_dir), count("a") - count("e"), "doc_id", "line_no").select("doc_id", "line_no", "depth", "depth_before")


@query(f"WITH {_DOC_LINES}, m AS (SELECT *, CASE WHEN contains(raw, '.') THEN line_no END AS mark FROM u) SELECT doc_id, line_no::INTEGER AS line_no, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no)::INTEGER AS mark FROM m")
def w9_sticky_marks(spark, sf_dir):
    return _doc_lines(spark, sf_dir).select("doc_id", "line_no", T.sticky(F.when(F.contains("raw", F.lit(".")), F.col("line_no")), "doc_id", "line_no").alias("mark"))


_TS = "import a from 'a'\nimport b from 'b'\n{}\nexport function f() {{\n  function inner() {{\n  }}\n}}\n"
_PY = "import os\n{}\n@one\n@two(1)\ndef f():\n    pass\n\ndef g():\n    pass\nx = 1\n"


@query("SELECT s_suppkey, 1 AS import_start, 2 + 0 AS import_end, 4 + s_suppkey % 3 AS block_start, 7 + s_suppkey % 3 AS block_end FROM supplier")
def w2_w6_import_blocks(spark, sf_dir):
    """Files with a gap of so many lines between imports and a function that holds another."""
    gap = F.repeat(F.lit("\n"), F.pmod("s_suppkey", F.lit(3)).cast("int"))
    text = F.concat(F.lit(_TS.split("{}")[0]), gap, F.lit(_TS.split("{}")[1].replace("{{", "{").replace("}}", "}")))
    f = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), text.alias("text"))
    o = scanners.outline(f, "typescript").groupBy("path").pivot("kind", ["imports", "export function f"]).agg(F.first("start_line").alias("s"), F.first("end_line").alias("e"))
    return o.select(F.col("path").cast("long").alias("s_suppkey"), F.col("imports_s").alias("import_start"), F.col("imports_e").alias("import_end"), F.col("export function f_s").alias("block_start"), F.col("export function f_e").alias("block_end"))


@query("SELECT s_suppkey, kind, s + s_suppkey % 4 AS start_line, e + s_suppkey % 4 AS end_line FROM supplier, (VALUES ('def f', 3, 7), ('def g', 8, 10)) AS v(kind, s, e)")
def w7_w11_function_ranges(spark, sf_dir):
    """Decorators move a function's start up; it ends before the next."""
    gap = F.repeat(F.lit("\n"), F.pmod("s_suppkey", F.lit(4)).cast("int"))
    f = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.concat(F.lit(_PY.split("{}")[0]), gap, F.lit(_PY.split("{}")[1])).alias("text"))
    return outline.outline(f, "python").where("kind like 'def %'").select(F.col("path").cast("long").alias("s_suppkey"), "kind", "start_line", "end_line")


@query("SELECT doc_id, array_to_string(w[1:3], ', ') || CASE WHEN len(w) > 3 THEN ' (+' || (len(w) - 3) || ')' ELSE '' END AS shown FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def l5_first_words(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.first_k(F.split("text", " "), 3).alias("shown"))


@query("WITH d AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, len(w) > 40 AS more FROM d WHERE len(w) > 0")
def l4_capped_symbols(spark, sf_dir):
    """Words of documents as symbols of a map; a map shows forty and says how many more there are."""
    d = _table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    entry = F.array(F.struct(F.lit("1").alias("lines"), F.lit("k").alias("kind")))
    one = F.lit(1)
    m = F.struct(F.lit("s").alias("summary"), entry.alias("map"), F.col("w").alias("symbols"), F.lit("").alias("notes"))
    out = render.file_map(m, F.lit("p"), "loom", one, one, one, one)
    return d.select("doc_id", F.contains(out, F.format_string(" (+%d more)\n", F.size("w") - 40)).alias("more"))


@query("WITH k AS (SELECT s_suppkey, list_sort(['z' || s_suppkey, 'b', 'a' || s_suppkey % 7, 'd', 'c']) AS k FROM supplier) SELECT s_suppkey, 'x: object {' || array_to_string(k[1:4], ', ') || ', ...} (5 keys)' AS kind FROM k")
def l8_sorted_keys(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit('{"x": {"z'), k, F.lit('": 1, "b": 2, "a'), F.pmod("s_suppkey", F.lit(7)).cast("string"), F.lit('": 3, "d": 4, "c": 5}}'))
    f = _table(spark, sf_dir, "supplier").select(k.alias("path"), text.alias("text"))
    return scanners.outline(f, "json").select(F.col("path").cast("long").alias("s_suppkey"), "kind")


@query("SELECT event_type AS tool, count(*) AS calls FROM events GROUP BY event_type")
def l2_name_sorted_tools(spark, sf_dir):
    return ledger.by_tool(_events(spark, sf_dir)).select("tool", "calls").orderBy("tool")


@query("WITH o AS (SELECT o_custkey, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY ALL), a AS (SELECT o_custkey, string_agg(n || ' ' || p || CASE WHEN n = 1 THEN '' ELSE 's' END, ', ' ORDER BY list_position(['1-URGENT', '3-MEDIUM', '2-HIGH'], p)) AS summary FROM o WHERE p IN ('1-URGENT', '3-MEDIUM', '2-HIGH') GROUP BY o_custkey) SELECT * FROM a")
def a13_kind_histograms(spark, sf_dir):
    return ledger.kind_histogram(_table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderpriority").alias("kind")), ["1-URGENT", "3-MEDIUM", "2-HIGH"], "o_custkey")


_ARRAYS = ("[1, 2]", '["a", "b", "c"]', '[1, "a"]', "[true, false]", "[{}, {}]", "[[1], 2, null]")


@query(f"SELECT event_id, {_sql_pick(('array of 2 number items', 'array of 3 string items', 'array of 2 mixed items', 'array of 2 boolean items', 'array of 2 object items', 'array of 3 mixed items'), 'event_id')} AS kind FROM events")
def a15_array_types(spark, sf_dir):
    f = _table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), _pick(_ARRAYS, F.col("event_id")).alias("text"))
    return scanners.outline(f, "json").select(F.col("path").cast("long").alias("event_id"), "kind")


@query("SELECT s_suppkey, kind || CASE WHEN (s_suppkey + o) % 2 = 0 THEN ' (phony)' ELSE '' END || ': run' AS kind FROM supplier, (VALUES ('a', 0), ('b', 1)) AS v(kind, o)")
def j6_phony_targets(spark, sf_dir):
    """Targets that a line further down names as phony."""
    name = F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("b")
    f = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.concat(F.lit("a:\n\trun\nb:\n\trun\n.PHONY: "), name, F.lit("\n")).alias("text"))
    return outline.outline(f, "makefile").select(F.col("path").cast("long").alias("s_suppkey"), "kind")


@query("SELECT s_suppkey, 'class A' || CASE WHEN s_suppkey % 3 = 0 THEN ' — go' ELSE '' END AS kind FROM supplier")
def j7_words_that_are_no_names(spark, sf_dir):
    """`return x(` and `new T(` look like methods; their words are none."""
    body = F.when(F.col("s_suppkey") % 3 == 0, "  void go() {").when(F.col("s_suppkey") % 3 == 1, "  else if (x) {").otherwise("  int while (x) {")
    f = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("path"), F.concat(F.lit("class A {\n"), body, F.lit("\n  }\n}\n")).alias("text"))
    return scanners.outline(f, "java").select(F.col("path").cast("long").alias("s_suppkey"), "kind")


# --- plans and renderings ---------------------------------------------------------------------------------------------


@query(f"WITH {_LEDGER} SELECT event_id, round((k * 1.0::DOUBLE + 10 * 1.0::DOUBLE * 1.25 + 20 * 1.0::DOUBLE * 0.10 + saved_est * 5.0::DOUBLE) / 1e6, 12) AS usd FROM l")
def r6_direct_costs(spark, sf_dir):
    _, p_in, p_out = cost.DIRECT_PRICES[0]
    usd = cost.direct_cost(F.col("k"), F.col("saved_est"), F.lit(10), F.lit(20), F.lit(p_in), F.lit(p_out))
    return _events(spark, sf_dir).select("event_id", F.round(usd, 12).alias("usd"))


@query(f"""WITH m AS (SELECT doc_id, doc_id % 3 = 0 AS g, doc_id % 5 AS reuse, strlen(text) AS b, (strlen(text) + 3) // 4 AS t, len(text) - len(replace(text, chr(10), '')) + (strlen(text) > 0 AND NOT suffix(text, chr(10)))::INT AS n FROM documents),
p AS (SELECT *, trunc(t * 0.3::DOUBLE)::BIGINT AS o, n > 8 OR b > 2000 AS over FROM m), e AS (SELECT *, (t + 650) * 0.8::DOUBLE / 1e6 + o * 4.0::DOUBLE / 1e6 AS c, (t - o) * 15.0::DOUBLE / 1e6 AS g2 FROM p)
SELECT doc_id, CASE WHEN NOT over THEN 'PASSTHROUGH' WHEN g THEN 'DETERMINISTIC' WHEN o < t AND g2 > c * 1.5 AND g2 - c >= 0.001 THEN 'CHEAP_WORKER' ELSE 'DIRECT' END AS strategy, CASE WHEN over THEN reuse ELSE 0 END::INTEGER AS reuse_count FROM e""")
def r2_read_plans(spark, sf_dir):
    """Threshold, outline, economics: with thresholds that both sides of the documents meet."""
    m = measure.measure(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumns({"mapped": F.col("doc_id") % 3 == 0, "reuse": F.col("doc_id") % 5})
    plans = cost.plan_reads(m, "bytes", "lines", cost.pricing(spark), max_lines=8, max_bytes=2000, mapped="mapped", reuse="reuse")
    return plans.select("doc_id", "strategy", "reuse_count")


@query("""SELECT s_suppkey, CASE WHEN n <= 3 THEN 'PASSTHROUGH' WHEN s_suppkey % 4 < 2 THEN 'DETERMINISTIC' ELSE 'DIRECT' END AS strategy, CASE WHEN n > 3 AND s_suppkey % 4 < 2 THEN CASE s_suppkey % 4 WHEN 0 THEN 'Package p' ELSE 'SQL schema — 1 table' END END AS summary
FROM (SELECT *, CASE s_suppkey % 4 WHEN 3 THEN 1 ELSE 5 END AS n FROM supplier)""")
def r2_f_reads_with_outlines(spark, sf_dir):
    """Go, SQL and two kinds of plain files: measured, outlined where they are large, planned."""
    i = F.col("s_suppkey")
    text = _pick(("package p\n\nfunc F() {\n}\n\n", "CREATE TABLE t (\n  a int,\n  b int,\n  c int\n);\n", "1\n2\n3\n4\n5\n", "one line\n"), i)
    f = _table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(i.cast("string"), _pick((".go", ".sql", ".txt", ".go"), i)).alias("path"), text.alias("text"))
    return reading.read_plans(spark, f, max_lines=3, parsers=("go", "sql")).select("s_suppkey", "strategy", "summary")


@query(f"""WITH {_LEDGER}, e AS (SELECT * FROM l WHERE event_id % 50 = 0)
SELECT event_id, 'Operation:  ' || tool || ' f' || event_id || chr(10) || 'Strategy:   ' || strategy || chr(10) || CASE WHEN event_id % 100 = 0 THEN 'Reuse:      seen 3 time(s) this session' || chr(10) ELSE '' END || 'Reason:     why' || chr(10) || CASE WHEN event_id % 150 = 0 THEN '[dry-run — decision logged, tool call not intercepted]' || chr(10) ELSE '' END || chr(10) AS text FROM e""")
def r11_decision_texts(spark, sf_dir):
    e = _events(spark, sf_dir).where("event_id % 50 = 0")
    i, nothing = F.col("event_id"), F.lit(0.0)
    none = dict.fromkeys(("est_orig_cost_usd", "est_worker_cost_usd", "est_net_savings_usd", "predicted_ratio", "compress_ratio", "actual_worker_cost_usd", "actual_output_ratio"), nothing)
    cols = none | {"tool": F.col("tool"), "target": F.concat(F.lit("f"), i.cast("string")), "strategy": F.col("strategy"), "compressor_kind": F.lit(""), "reuse_count": F.when(i % 100 == 0, 3).otherwise(0), "reason": F.lit("why"), "dry_run": i % 150 == 0}
    return e.select("event_id", render.decision(cols).alias("text"))


_HEAD = _sql_text(render.FRAMING)


@query(f"""SELECT c_custkey, {_HEAD} || c_nationkey + 5 || ' matches — digest instead of full results.' || chr(10) || chr(10) || c_name || chr(10) || chr(10) || '  ' || lpad((c_nationkey + 5)::VARCHAR, 4, ' ') || '  ' || rpad('src', 24, ' ') || ' gist' || chr(10) || chr(10) || 'Representative files:' || chr(10) || '  a.go' || chr(10) || chr(10)
|| 'Narrow the pattern or scope, or Grep a listed file directly, for exact matches.' || chr(10) AS text FROM customer""")
def r9_cluster_texts(spark, sf_dir):
    n = (F.col("c_nationkey") + 5).cast("int")
    c = F.struct(F.col("c_name").alias("summary"), F.array(F.struct(F.lit("src").alias("where"), n.alias("matches"), F.lit("gist").alias("gist"))).alias("clusters"), n.alias("total"), F.array(F.lit("a.go")).alias("representative_files"))
    return _table(spark, sf_dir, "customer").select("c_custkey", render.clusters(c).alias("text"))


@query(f"""SELECT c_custkey, {_HEAD} || 'command output captured (exit ' || c_nationkey % 3 || ').' || chr(10) || chr(10) || CASE WHEN c_nationkey > 12 THEN 'PARTIAL: ' || c_nationkey || ' bytes of output were captured; this digest summarises' || chr(10) || 'only the LAST 12 bytes. Earlier output is in the log, not below.' || chr(10) || chr(10) ELSE '' END
|| c_name || chr(10) || chr(10) || 'Key lines:' || chr(10) || '  k' || chr(10) || chr(10) || 'Full output: /l' || chr(10) AS text FROM customer""")
def r10_run_texts(spark, sf_dir):
    n = F.col("c_nationkey")
    r = F.struct(F.col("c_name").alias("summary"), F.array(F.lit("k")).alias("key_lines"), (n % 3).cast("int").alias("exit_code"), F.lit("/l").alias("log_path"))
    return _table(spark, sf_dir, "customer").select("c_custkey", render.run(r, F.least(n, F.lit(12)), n).alias("text"))


@query(f"""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'PARTIAL: this digest covers only lines 1-2 of ' || (2 + c_nationkey + 1) || ' (50% of the file).' WHEN c_custkey % 3 = 1 THEN 'PARTIAL: this digest is based on the first 10 of 20 bytes (50%).' ELSE 'Structure:' END AS line FROM customer""")
def r8_partial_banners(spark, sf_dir):
    i = F.col("c_custkey")
    entry = F.array(F.struct(F.lit("1").alias("lines"), F.lit("k").alias("kind")))
    m = F.struct(F.lit("s").alias("summary"), entry.alias("map"), F.array().cast("array<string>").alias("symbols"), F.lit("").alias("notes"))
    lines = F.when(i % 3 == 0, 2 + F.col("c_nationkey") + 1).otherwise(F.lit(2))
    out = render.file_map(m, F.lit("p"), "loom", F.lit(10), F.when(i % 3 == 2, 10).otherwise(20), F.lit(2), lines)
    return _table(spark, sf_dir, "customer").select("c_custkey", F.get(F.split(out, "\n"), 5).alias("line"))


@query("SELECT doc_id, CASE WHEN n <= 10 THEN n ELSE 10 END::INTEGER AS shown, n > 10 AS more FROM (SELECT doc_id, 3 + doc_id % 20 AS n FROM documents)")
def l6_capped_paths(spark, sf_dir):
    """Changed files of a status, of which ten are shown."""
    n = (F.lit(3) + F.col("doc_id") % 20).cast("int")
    changed = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("\tmodified:   file"), i.cast("string"), F.lit(".go"))), "\n")
    text = F.concat(F.lit("On branch main\nYour branch is up to date.\n\nChanges not staged for commit:\n  (use \"git add <file>...\" to update what will be committed)\n  (use \"git restore <file>...\" to discard changes in working directory)\n"), changed, F.lit("\n\nno changes added to commit (use \"git add\" and/or \"git commit -a\")\n"))
    d = reduce.reduce_output(_table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    return d.select("doc_id", F.size(F.expr("regexp_extract_all(output, 'modified: ', 0)")).alias("shown"), F.contains("output", F.lit("more]")).alias("more"))


_RATIOS = (("_worker", 12, 0.25, 0.125, 0.5), ("build", 3, 0.5, 0.25, 0.25))
_PRICE_LINES = [(1001 + i, f"  {m:<28s} {a:8.2f} {b:8.2f} {c:8.2f} {d:8.2f}") for i, (m, a, b, c, d) in enumerate(sorted(cost.PRICES))]
_RATIO_LINES = [(2001 + i, f"  {k:<16s} n={n} mean={m:.3f} sd={sd:.3f} conservative={r:.3f}") for i, (k, n, m, sd, r) in enumerate(sorted(_RATIOS))]


@query(f"SELECT * FROM (VALUES {', '.join(f'({o}, {_sql_text(x)})' for o, x in [*_PRICE_LINES, *_RATIO_LINES])}) AS v(ord, line)")
def r13_pricing_report(spark, sf_dir):
    ratios = spark.createDataFrame(list(_RATIOS), "kind string, count long, mean_ratio double, stddev double, conservative_ratio double")
    return reports.pricing(spark, ratios)
