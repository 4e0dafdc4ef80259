"""Pattern search over files: counting, clusters, context and the plan for large results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import glob_regex
from ..functions.text import dir_name, explode_lines, extension


# Extensions by type of file.
TYPES = {
    "c": ("c", "h"), "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "h"), "css": ("css", "scss"), "go": ("go",), "html": ("html", "htm"), "java": ("java", "jsp"), "js": ("js", "jsx", "mjs", "cjs"), "json": ("json",), "md": ("md", "markdown"),
    "py": ("py", "pyi"), "ruby": ("rb", "gemspec"), "rust": ("rs",), "sh": ("sh", "bash", "zsh"), "sql": ("sql",), "ts": ("ts", "tsx", "mts", "cts"), "yaml": ("yaml", "yml"),
}


def scoped(files: DataFrame, glob: str | None = None, kind: str | None = None) -> DataFrame:
    """Files whose path fits the glob and whose extension is of the type."""
    out = files.where(F.col("path").rlike(glob_regex(glob))) if glob else files
    if kind is not None:
        if kind not in TYPES:
            raise ValueError(f"unknown type of file {kind!r} (known: {sorted(TYPES)})")
        out = out.where(extension(F.col("path")).isin(*[f".{x}" for x in TYPES[kind]]))
    return out


def matching_lines(files: DataFrame, pattern: str, ignore_case: bool = False, glob: str | None = None, text: str = "text", kind: str | None = None) -> DataFrame:
    """(path, line_no, raw) of lines that hold the pattern. A prefilter on whole texts spares files without it."""
    p = f"(?i){pattern}" if ignore_case else pattern
    some = scoped(files, glob, kind)
    return explode_lines(some.where(F.col(text).rlike(f"(?m){p}")), text, ("path",)).where(F.col("raw").rlike(p))


def count_matches(files: DataFrame, pattern: str, **how) -> DataFrame:
    """Matching lines by file (lines, not occurrences)."""
    return matching_lines(files, pattern, **how).groupBy("path").agg(F.count("*").alias("matches"))


def count_multiline(files: DataFrame, pattern: str, ignore_case: bool = False, glob: str | None = None, text: str = "text", kind: str | None = None) -> DataFrame:
    """Matches by file that may run over lines; a dot still ends at a line's end."""
    n = F.regexp_count(text, F.lit(f"(?m{'i' if ignore_case else ''}){pattern}"))
    return scoped(files, glob, kind).select("path", n.alias("matches")).where("matches > 0")


def total_matches(files: DataFrame, pattern: str, **how) -> DataFrame:
    """Counts by file, and the grand total under a null path."""
    return matching_lines(files, pattern, **how).rollup("path").agg(F.count("*").alias("matches"))


def context_lines(files: DataFrame, pattern: str, before: int = 0, after: int = 0, around: int | None = None, text: str = "text") -> DataFrame:
    """Matching lines with those before and after them; around stands for both. One file a window."""
    before, after = (around, around) if around is not None else (before, after)
    lines = explode_lines(files.where(F.col(text).rlike(f"(?m){pattern}")), text, ("path",)).withColumn("hit", F.col("raw").rlike(pattern).cast("int"))
    near = F.max("hit").over(Window.partitionBy("path").orderBy("line_no").rowsBetween(-after, before))
    return lines.withColumn("near", near).where("near = 1").select("path", "line_no", "raw", (F.col("hit") == 1).alias("is_match"))


def clusters(matches: DataFrame, top: int = 10, files: int = 5) -> DataFrame:
    """Matches by directory: count, the first matching line as gist, and the files with most of them. Files are ranked
    before they are gathered, so a directory of any size sends a few rows to one place."""
    m = matches.withColumn("where", dir_name(F.col("path")))
    by_file = m.groupBy("where", "path").agg(F.count("*").alias("n"), F.min_by("raw", "line_no").alias("gist"))
    totals = by_file.groupBy("where").agg(F.sum("n").alias("matches"), F.min_by("gist", "path").alias("gist")).orderBy(F.desc("matches"), "where").limit(top)
    best = by_file.select("where", "path", "n").withColumn("rank", F.row_number().over(Window.partitionBy("where").orderBy(F.desc("n"), "path"))).where(F.col("rank") <= files)
    listed = best.groupBy("where").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("representative_files"))
    return totals.join(listed, "where").select("where", "matches", "gist", "representative_files").orderBy(F.desc("matches"), "where")


def over_limit(counts: DataFrame, most: int = 60) -> DataFrame:
    """The total, if it is large enough to be condensed."""
    return counts.agg(F.coalesce(F.sum("matches"), F.lit(0)).alias("total")).where(F.col("total") > most)


def sample_bytes(matches: DataFrame, most: int = 32 << 10) -> DataFrame:
    """By file, the first bytes of its matching lines as path:line:text. Lines beyond them are left out before any are
    gathered."""
    line = F.concat_ws(":", "path", F.col("line_no").cast("string"), "raw")
    before = F.sum(F.octet_length("x") + 1).over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    some = matches.select("path", "line_no", line.alias("x")).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < most)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "x"))), lambda v: v["x"])
    return some.groupBy("path").agg(F.substring(F.array_join(ordered, "\n").cast("binary"), 1, most).cast("string").alias("sample"))
