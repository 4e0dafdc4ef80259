"""Column functions over texts, paths and line ranges. Lengths are bytes unless a name says characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: White space that trimming removes at either end.
EDGE_SPACE = r"[\s\u0085 ]+"


def trim_space(x: Column) -> Column:
    return F.regexp_replace(x, f"^{EDGE_SPACE}|{EDGE_SPACE}$", "")


def byte_slice(x: Column, start: Column | int, size: Column | int) -> Column:
    """size bytes from the 1-based byte start, as binary."""
    start, size = (F.lit(v) if isinstance(v, int) else v for v in (start, size))
    return F.substring(x.cast("binary"), start, size)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, '' without one."""
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def newline_count(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def line_count(text: Column) -> Column:
    """Line feeds, plus one for an unterminated tail; 0 for an empty text."""
    tail = (F.octet_length(text) > 0) & ~F.endswith(text, F.lit("\n"))
    return newline_count(text) + tail.cast("int")


def prefix_bytes(text: Column, lines: int) -> Column:
    """Bytes of the first lines, their line feeds included; all bytes if there are fewer."""
    return F.when(newline_count(text) < lines, F.octet_length(text)).otherwise(F.octet_length(F.substring_index(text, "\n", lines)) + 1)


def explode_lines(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a line (line_no from 1, raw): a trailing empty line goes, as does a carriage return at a line's end."""
    parts = F.split(F.col(text), "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return df.select(*keep, F.posexplode(parts).alias("pos", "raw")).select(*keep, (F.col("pos") + 1).alias("line_no"), F.regexp_replace("raw", "\r$", "").alias("raw"))


def join_lines(lines: DataFrame, keys: list[str], line: str = "raw", out: str = "text") -> DataFrame:
    """Lines put together again in line_no order."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", line)))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[line]), "\n").alias(out))


def line_range(start: Column, end: Column) -> Column:
    return F.when(start == end, start.cast("string")).otherwise(F.concat_ws("-", start.cast("string"), end.cast("string")))


def token_estimate(size: Column) -> Column:
    """A token every four bytes, rounded up; 0 for nothing."""
    return F.when(size <= 0, F.lit(0)).otherwise(F.expr("1L") * F.floor((size + 3) / 4))


def first_sentence(text: Column, most: int = 80) -> Column:
    """Up to the first . ! or ? before a space or the end; else the text, cut with dots beyond most characters."""
    flat = trim_space(F.regexp_replace(text, r"[\t\n\f\r ]+", " "))
    found = F.regexp_extract(flat, r"^(.*?[.!?])(?: |$)", 1)
    cut = F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)
    return F.when(found != "", found).otherwise(cut)


def strip_fence(text: Column) -> Column:
    """What stands inside a code fence that opens the text and closes it; else the text, trimmed."""
    t = trim_space(text)
    inner = F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*?)\n?```$", 1)
    return F.when(t.rlike(r"(?s)^```[^\n]*\n.*```$"), trim_space(inner)).otherwise(t)


def first_k(items: Column, k: int, sep: str = ", ", rest: str = " (+%d)") -> Column:
    """The first k items, and how many more there are."""
    shown = F.array_join(F.slice(items, 1, k), sep)
    return F.when(F.size(items) > k, F.concat(shown, F.format_string(rest, F.size(items) - k))).otherwise(shown)


def net_braces(line: Column, opening: str = "{", closing: str = "}") -> Column:
    """Opening less closing signs of one line, outside quotes and line comments."""
    bare = F.regexp_replace(line, r"""("(?:[^"\\]|\\.)*("|$)|'(?:[^'\\]|\\.)*('|$)|`[^`]*(`|$)|//.*$)""", "")
    count = lambda sign: F.length(bare) - F.length(F.replace(bare, F.lit(sign), F.lit("")))
    return count(opening) - count(closing)


def with_depth(df: DataFrame, net: Column, by: str, order: str) -> DataFrame:
    """Adds depth_before and depth: the clamped running sum of net before and after each row."""
    w = Window.partitionBy(by).orderBy(order)
    out = df.withColumn("_sum", F.sum(net).over(w))
    out = out.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w)))
    return out.withColumn("depth_before", F.coalesce(F.lag("depth").over(w), F.lit(0))).drop("_sum")


def with_section(lines: DataFrame, opens: Column, by: str = "path", order: str = "line_no") -> DataFrame:
    """One row a section: where a line opens it, up to the line before the next opening, else to the last line."""
    w = Window.partitionBy(by).orderBy(order)
    heads = lines.withColumn("_last", F.max(order).over(Window.partitionBy(by))).where(opens)
    return heads.withColumn("end_line", F.coalesce(F.lead(order).over(w) - 1, F.col("_last"))).withColumnRenamed(order, "start_line").drop("_last")


def sticky(mark: Column, by: str, order: str) -> Column:
    """The last mark that is not null, up to each row."""
    return F.last(mark, ignorenulls=True).over(Window.partitionBy(by).orderBy(order))
