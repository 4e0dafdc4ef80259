"""Plans of reading files: measured, outlined where they are over the threshold and their format is known, and priced."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import cost, measure, outline, scanners


def outlines(files: DataFrame, parsers: Collection[str] = tuple(P.PARSERS)) -> DataFrame:
    """files(path, text) to path and the outline's summary, symbols and notes, for files that have an outline of one of
    the parsers. One pass for the formats that are scanned; configuration formats and Python, whose outlines are
    windows, one each."""
    known = files.select("path", "text", P.parser_of(F.col("path")).alias("parser")).where(F.col("parser").isin(*parsers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, found[1:]) for p, t, k in zip(*(b.column(c).to_pylist() for c in ("path", "text", "parser")), strict=True) if (found := scanners.scan(k, t or "", p))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), pa.array([f[0] for _, f in rows], pa.string()), pa.array([f[1] for _, f in rows], pa.list_(pa.string())), pa.array([f[2] for _, f in rows], pa.string())], ["path", "summary", "symbols", "notes"])

    out = known.where(F.col("parser").isin(*scanners.SCANNERS)).mapInArrow(run, "path string, summary string, symbols array<string>, notes string")
    for parser in set(outline.OUTLINES) & set(parsers):
        out = out.unionByName(outline.described(known.where(F.col("parser") == parser), parser))
    return out


def read_plans(spark: SparkSession, files: DataFrame, max_lines: int = 150, max_bytes: int = 60_000, reuse: str | None = None, parsers: Collection[str] = tuple(P.PARSERS)) -> DataFrame:
    """files(path, text, ...) with sizes, plan and, where it is the plan, the outline's summary, symbols and notes. Files
    below the threshold are not scanned."""
    sized = measure.measure(files)
    large = sized.where(P.exceeds(F.col("lines"), F.col("bytes"), max_lines, max_bytes))
    found = outlines(large.select("path", "text"), parsers).withColumn("mapped", F.lit(True))
    return cost.plan_reads(sized.join(found, "path", "left"), "bytes", "lines", cost.pricing(spark), max_lines=max_lines, max_bytes=max_bytes, mapped="mapped", reuse=reuse)
