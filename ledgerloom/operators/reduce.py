"""Reducers of command output, in one expression a text: its lines are an array that is filtered, folded and joined.

Each reducer has a trigger, an output and a flag whether the output needs no more work; the first whose trigger holds
is taken, and an output that is no shorter than the text is the text itself. No row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import newline_count, trim_space

SENSITIVE = ("password", "secret", "token", "key", "Error", "error", "panic", "TODO", "FIXME", "HACK")


def has_any(x: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(x, F.lit(p))
    return out


def opens_with(x: Column, *parts: str) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.startswith(x, F.lit(p))
    return out


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def _strings() -> Column:
    return F.array().cast("array<string>")


def _join(items: Column) -> Column:
    return F.array_join(items, "\n")


def error_line(t: Column) -> Column:
    """A colon (not the first sign) that a digit follows, or that follows a name with a dot or slash."""
    return t.rlike(r"(?s)^.[^:]*(:[^:]*)*?:[0-9]|^.+:[0-9]") | t.rlike(r"(?s)^[^:]*[./\\][^:]*:") | t.rlike(r"(?s)^.+[./\\].*:")


def go_test(text: Column) -> tuple[Column, Column]:
    seen = has_any(text, "--- FAIL", "--- PASS", "=== RUN", "PASS\n", "FAIL\n") & has_any(text, "\t", "go test")

    def keep(line: Column) -> Column:
        t = trim_space(line)
        noise = opens_with(t, "=== RUN", "=== PAUSE", "=== CONT", "--- PASS")
        summary = (opens_with(t, "ok  ", "FAIL", "?   ") & F.contains(t, F.lit("\t"))) | opens_with(t, "coverage:")
        trace = opens_with(t, "panic:", "goroutine ", "runtime/debug.Stack", "testing.") | has_any(t, "goroutine 1 [running]")
        return ~noise & (opens_with(t, "--- FAIL") | summary | trace | opens_with(line, "\t", "    ") | t.isin("PASS", "FAIL"))

    lines = lines_of(text)
    passed = F.size(F.filter(lines, lambda x: opens_with(trim_space(x), "--- PASS")))
    head = F.when(passed > 0, F.array(F.format_string("[%d tests passed — output omitted]", passed))).otherwise(_strings())
    return seen, _join(F.concat(head, F.filter(lines, keep)))


def git_status(text: Column) -> tuple[Column, Column]:
    seen = has_any(text, "On branch", "HEAD detached") & has_any(text, "modified:", "new file:", "deleted:", "untracked:", "Untracked files:")
    lines = lines_of(text)

    def kind(line: Column) -> Column:
        t = trim_space(line)
        other = (t != "") & ~opens_with(t, "#", "(use", "Changes", "Untracked", "no changes") & opens_with(line, "\t")
        return (
            F.when(opens_with(t, "On branch", "HEAD detached", "Your branch", "nothing to commit"), "h")
            .when(opens_with(t, "modified:", "deleted:", "renamed:", "both modified:"), "c").when(opens_with(t, "new file:"), "s").when(other, "u").otherwise("")
        )

    of = lambda k: F.filter(lines, lambda x: kind(x) == k)
    tabbed = lambda x: F.transform(x, lambda y: F.concat(F.lit("\t"), trim_space(y)))
    block = lambda title, x, rest: F.when(F.size(x) > 0, F.concat(F.array(F.format_string(f"{title} (%d):", F.size(x))), F.slice(x, 1, 10), F.when((F.size(x) > 10) & F.lit(rest), F.array(F.format_string("\t[+%d more]", F.size(x) - 10))).otherwise(_strings()))).otherwise(_strings())
    return seen, _join(F.concat(F.transform(of("h"), trim_space), block("Changes", tabbed(of("c")), True), block("Staged", tabbed(of("s")), False), block("Untracked", of("u"), False)))


def git_diff(text: Column) -> tuple[Column, Column]:
    """Counts by file and the hunks that hold sensitive words; one piece of the text a file, one piece of it a hunk."""
    seen = F.contains(text, F.lit("diff --git"))
    files = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=diff --git)"), lambda x: opens_with(x, "diff --git"))

    def read(piece: Column) -> Column:
        lines = lines_of(piece)
        head = F.filter(F.split(F.element_at(lines, 1), r"[\t\n\f\r ]+"), lambda x: x != "")
        path = F.when(F.size(head) >= 4, F.regexp_replace(F.get(head, 3), "^b/", "")).otherwise("")
        plus = F.size(F.filter(lines, lambda x: opens_with(x, "+") & ~opens_with(x, "+++")))
        minus = F.size(F.filter(lines, lambda x: opens_with(x, "-") & ~opens_with(x, "---")))
        hunks = F.filter(F.split(piece, r"\n(?=@@)"), lambda x: opens_with(x, "@@") & has_any(x, *SENSITIVE))
        return F.struct(path.alias("path"), plus.alias("added"), minus.alias("removed"), hunks.alias("hunks"))

    parsed = F.transform(files, read)
    total = lambda f: F.aggregate(parsed, F.lit(0), lambda a, x: a + x[f])
    head = F.format_string("git diff — %d file(s), +%d -%d lines\n\n", F.size(files), total("added"), total("removed"))
    table = F.array_join(F.transform(parsed, lambda x: F.format_string("  %-50s +%-4d -%d\n", x["path"], x["added"], x["removed"])), "")
    kept = F.array_join(F.flatten(F.transform(parsed, lambda x: F.transform(x["hunks"], lambda h: F.concat(F.lit("\n["), x["path"], F.lit(" — sensitive hunk]\n"), h, F.lit("\n"))))), "")
    return seen & (F.size(files) > 0), F.concat(head, table, kept)


def git_log(text: Column) -> tuple[Column, Column]:
    commits = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=commit .)"), lambda x: opens_with(x, "commit ") & (F.length(F.element_at(F.split(x, "\n"), 1)) > 7))
    seen = has_any(text, "commit ", "Author:", "Date:") & (newline_count(text) >= 30) & (F.size(commits) > 0)

    def read(piece: Column) -> Column:
        lines = lines_of(piece)
        rest = F.slice(lines, 2, F.greatest(F.lit(0), F.size(lines) - 1))
        field = lambda p: F.element_at(F.concat(F.array(F.lit("")), F.filter(rest, lambda x: opens_with(x, p))), -1)
        author = F.regexp_replace(F.regexp_replace(field("Author: "), "^Author: ", ""), "(?<=.) <.*$", "")
        date = F.regexp_replace(trim_space(F.regexp_replace(field("Date:   "), "^Date:   ", "")), "(?<=.) .*$", "")
        subject = F.coalesce(F.get(F.filter(rest, lambda x: (trim_space(x) != "") & ~opens_with(x, "Author: ", "Date:   ", "    Merge:")), 0), F.lit(""))
        return F.concat(F.substring(F.element_at(lines, 1), 8, 7), F.lit("  "), date, F.lit("  "), author, F.lit("\n    "), trim_space(subject), F.lit("\n"))

    return seen, F.concat(F.format_string("%d commits:\n\n", F.size(commits)), F.array_join(F.transform(commits, read), ""))


def build(text: Column) -> tuple[Column, Column]:
    like = has_any(text, "./...", "build failed", "FAILED", "compile error", ": undefined:", ": cannot use", ": no field", ": declared and not used", "TS2", "error TS") | (F.contains(text, F.lit("#")) & F.contains(text, F.lit("go build")))

    def keep(line: Column) -> Column:
        t = trim_space(line)
        return (t != "") & (
            error_line(t) | opens_with(t, "FAILED", "error[", "warning[", "note:", "help:", "aborting") | has_any(t, "error(s)", "warning(s)") | (opens_with(t, "#") & F.contains(t, F.lit("/"))) | (F.contains(t, F.lit("TS")) & F.contains(t, F.lit("error")))
        )

    kept = F.filter(lines_of(text), keep)
    return like & (F.size(kept) > 0), _join(kept)


def generic_test(text: Column) -> tuple[Column, Column]:
    """Failures with what follows them up to a blank or summary line: a fold over the lines with one sticky flag."""
    like = has_any(text, "PASSED", "FAILED", "pytest", "jest", "mocha", "cargo test", "npm test", "✓", "✗", "✘")
    state = F.struct(_strings().alias("out"), F.lit(False).alias("inside"))

    def step(a: Column, line: Column) -> Column:
        t = trim_space(line)
        passed, failed = t.rlike(r" PASSED\)?$"), t.rlike(r" FAILED\)?$| ERROR$")
        summary = has_any(t, "passed", "failed", "error", "warning") & has_any(t, "===", "---", "FAILED", "passed in")
        dots = t.rlike("^[.FEsx ]{4,}$")
        times = F.when(passed, 0).when(failed | summary, 1).when(dots, 0).otherwise(a["inside"].cast("int") + error_line(t).cast("int"))
        inside = F.when(passed, a["inside"]).when(failed, F.lit(True)).when(summary, F.lit(False)).when(dots, a["inside"]).otherwise(a["inside"] & (t != ""))
        return F.struct(F.concat(a["out"], F.array_repeat(line, times)).alias("out"), inside.alias("inside"))

    out = F.aggregate(lines_of(text), state, step)["out"]
    return like & (F.size(out) > 0), _join(out)


#: Kind, reducer, and whether its output needs no more work; the first that holds wins.
REDUCERS = (("go_test", go_test, True), ("git_status", git_status, True), ("git_diff", git_diff, False), ("git_log", git_log, True), ("build", build, True), ("generic_test", generic_test, True))


def reduce_output(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds output, kind ('' if no reducer holds), reduced, complete and ratio (bytes)."""
    x = F.col(text)
    kind, out, complete = F.lit(""), x, F.lit(False)
    for name, reducer, done in reversed(REDUCERS):
        holds, made = reducer(x)
        holds = F.coalesce(holds, F.lit(False))
        kind, out, complete = F.when(holds, F.lit(name)).otherwise(kind), F.when(holds, made).otherwise(out), F.when(holds, F.lit(done)).otherwise(complete)
    made = df.withColumn("kind", kind).withColumn("_made", out).withColumn("complete", complete)
    size, own = F.octet_length("_made"), F.octet_length(text)
    shorter = (F.col("kind") != "") & (size < own)
    return made.withColumns({"output": F.when(shorter, F.col("_made")).otherwise(x), "reduced": shorter, "ratio": F.when(shorter & (own > 0), size / own).otherwise(F.lit(1.0))}).drop("_made")
