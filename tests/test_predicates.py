from pyspark.sql import functions as F

from ledgerloom.functions import predicates as P
from ledgerloom.functions import text as T
from ledgerloom.operators import measure


def rows(spark, values, *cols):
    return [tuple(r) for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").orderBy("i").select(*cols).collect()]


def test_sizes(spark):
    cases = [("a\nb\nc\nd\n", 2, 4, 4), ("a\nb\nc", 10, 3, 5), ("aa\nbb\ncc", 2, 3, 6), ("", 5, 0, 0), ("héllo\nwörld\nx\n", 2, 3, 14)]
    for text, n, lines, prefix in cases:
        r = measure.measure(spark.createDataFrame([(text,)], "text string"), n).first()
        assert (r["lines"], r["prefix_bytes"]) == (lines, prefix)


def test_tokens(spark):
    got = spark.createDataFrame([(b,) for b in (0, 1, 4, 5, 4000)], "b int").select(T.token_estimate(F.col("b")).alias("t")).collect()
    assert [r["t"] for r in got] == [0, 1, 1, 2, 1000]


def test_noisy_commands(spark):
    got = rows(spark, ["cat foo.txt", "go test ./...", "echo hi", "concatenate"], P.first_match(F.col("x"), [*P.NOISY_COMMANDS, "("]))
    assert got == [(r"\bcat\s",), (r"go\s+test",), (None,), (None,)]


def test_globs(spark):
    paths = ["/p/README.md", "/p/go.mod", "/p/.claude/x.json", "/p/main.go", "/p/notes.md.backup"]
    assert [r[0] for r in rows(spark, paths, P.passes_through(F.col("x"), list(P.PASSTHROUGH_GLOBS)))] == [True, True, True, False, False]


def test_self_command_and_quotes(spark):
    own = "/opt/my tools/loom"
    got = rows(spark, ["loom run x", "'/opt/my tools/loom' cat a", "loom other", "echo loom run"], P.self_command(F.col("x"), own))
    assert [r[0] for r in got] == [True, True, False, False]
    assert rows(spark, ["it's"], P.shell_quote(F.col("x"))) == [("'it'\\''s'",)]


def test_line_helpers(spark):
    assert rows(spark, ['a { "}" // }', "}}", "x"], T.net_braces(F.col("x"))) == [(1,), (-2,), (0,)]
    assert rows(spark, ["```go\nx\n```", "plain "], T.strip_fence(F.col("x"))) == [("x",), ("plain",)]
    assert rows(spark, ["One. Two", "no end"], T.first_sentence(F.col("x"))) == [("One.",), ("no end",)]
