"""Sizes of texts, head and tail caps, and synthetic fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_count, prefix_bytes, token_estimate


def measure(files: DataFrame, lines: int = 2000, text: str = "text") -> DataFrame:
    x = F.coalesce(F.col(text), F.lit(""))
    return files.withColumns({"lines": line_count(x), "bytes": F.octet_length(x), "prefix_bytes": prefix_bytes(x, lines)}).withColumn("tokens", token_estimate(F.col("bytes")))


def head(files: DataFrame, lines: int = 2000, size: int = 128 << 10, text: str = "text") -> DataFrame:
    """The first lines, then the first bytes of them."""
    cut = F.substring_index(F.col(text), "\n", lines)
    return files.withColumn("head", F.substring(cut.cast("binary"), 1, size).cast("string"))


def tail(files: DataFrame, size: int = 16 << 10, text: str = "text") -> DataFrame:
    """The last bytes."""
    x = F.col(text).cast("binary")
    n = F.octet_length(F.col(text))
    return files.withColumn("tail", F.substring(x, F.greatest(F.lit(1), n - (size - 1)), F.lit(size)).cast("string"))


def first_lines(files: DataFrame, n: int, text: str = "text") -> DataFrame:
    return files.withColumn("first", F.substring_index(F.col(text), "\n", n))


def synthetic_source(spark: SparkSession, functions: int = 400) -> DataFrame:
    """A generated source file of so many functions, one row a line."""
    body = F.array(F.format_string("func Work%d(n int) int {", F.col("id")), F.lit("\treturn n"), F.lit("}"), F.lit(""))
    return spark.range(functions).select(F.col("id"), F.posexplode(body).alias("k", "raw")).select((F.col("id") * 4 + F.col("k") + 1).alias("line_no"), "raw")
