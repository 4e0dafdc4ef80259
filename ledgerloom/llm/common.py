"""Shared plumbing of the training-data operators: staged tables, clean-up, grouped batches and input normalising."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a new one if all runs in
    this process's machine (tests), else an error."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if (own := spark.sparkContext.getCheckpointDir()) is not None:
        return own.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts cross to Python workers and back in batches of at most so many rows: each running task holds two."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def lean(spark: SparkSession) -> None:
    """Lets executors and driver give back memory that what ran before has left: a JVM's heap stays as large as it once
    was until it is collected whole, and the next operator's Python workers stand beside it. One short task a core."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Stage:
    """Intermediate tables of one run, written to the shared folder; a lost executor costs no recomputation beyond them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        small_batches(spark)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """df as a written table; its lineage ends here."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(path)
        del df
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes staged tables that are read no more. Paths are compared without their scheme: /x, file:/x and
        file:///x are one folder."""
        jvm, hadoop = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.root).toUri().getPath()
        for df in tables:
            for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                p = jvm.org.apache.hadoop.fs.Path(path)
                if p.toUri().getPath().startswith(root + "/"):
                    p.getFileSystem(hadoop).delete(p, True)

    def release(self) -> None:
        """Lets Spark's cleaner drop shuffle files whose plans are finished, so disk holds one phase at a time."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def fields(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, cast: other columns, whatever their names, take no part."""
    return df.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in wanted.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(doc_id: str | Column, text: str | Column) -> list[Column]:
    """A row's own key, of 96 bits, which holds where doc_ids are missing or repeat; equal rows share it."""
    return [F.xxhash64(doc_id, text), F.hash(text, doc_id)]


def handed_out(df: DataFrame, most: int = 1 << 20) -> DataFrame:
    """df, a few numbers a row, marked to be handed to all tasks if it has at most `most` rows; else as it is, for a
    shuffled join."""
    return F.broadcast(df) if df.count() <= most else df


def by_key(df: DataFrame, *then: str) -> DataFrame:
    """df with the rows of a `key` (long) in one partition, in the order of key and `then`."""
    return df.repartition(shuffle_partitions(df.sparkSession), "key").sortWithinPartitions("key", *then)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of by_key, cut between keys."""
    held: list[pa.RecordBatch] = []
    key = 0

    def joined() -> pa.RecordBatch:
        return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        k = b.column("key").to_numpy()
        cut = 0
        if held:
            cut = int(np.searchsorted(k, key, "right"))
            if cut:
                held.append(b.slice(0, cut))
        if cut < b.num_rows:
            if held:
                yield joined()
            key = int(k[-1])
            last = int(np.searchsorted(k, key))
            if last > cut:
                yield b.slice(cut, last - cut)
            held = [b.slice(last)]
    if held:
        yield joined()
