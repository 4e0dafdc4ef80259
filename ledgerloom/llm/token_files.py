"""Operator 6: token ids as ORC files, and readers of them.

Each document's ids (the tokenizers library's, then an end id) are one array<int> in an ORC row, which the format
stores by integer run-length encoding in stripes, with row indexes and a Bloom filter on doc_id. Files are written in
ascending doc_id order (range partitions, sorted inside), so stripe statistics and Bloom filters let a reader skip
stripes for given documents, and stripes are read in parallel. The text crosses the shuffle, not the wider ids;
encoding comes after it, in order, and streams in chunks.

The library encodes every distinct pre-token a worker has not met; a bounded memo gives the ids of the others. That
is exact: a byte-level pre-token's ids don't depend on its surroundings.

Nulls are empty texts: their row holds the end id alone. Rows of one doc_id follow each other in the order of their texts' hashes; null
doc_ids come first. Other columns are ignored. An empty table gives an empty result and no rows on file.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import wordkernel as wk
from .bpe import _whole, default_vocabulary
from .common import Stage, fields, shuffle_partitions, table
from .pieces import SPECIAL, Encoder


@functools.lru_cache(2)
def _library(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a worker
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def pieces(words: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in words]
        for s in range(0, len(words), 4096):
            got = tokenizer.encode(words[s : s + 4096], is_pretokenized=True, add_special_tokens=False)
            for i, w in zip(got.ids, got.word_ids, strict=True):
                out[s + w].append(i)
        return out

    return Encoder(pieces, tokenizer.token_to_id(SPECIAL))


def _encode(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seq = _library(path), 0
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(b.column("text")):
                ids, first = _whole(encoder, data, offsets)
                rows = hi - lo
                ids = np.insert(ids, first[1:], end_id).astype(np.int32)
                first = first + np.arange(rows + 1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, rows), pa.array(np.arange(seq, seq + rows)), pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], ["doc_id", "seq", "n_tokens", "ids"]
                )
                seq += rows

    return run


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, files: int | None = None, stripe_bytes: int = 16 << 20) -> None:
    """Writes docs(doc_id, text) as ORC rows (doc_id, seq: the row's place in its file, n_tokens, ids)."""
    docs = fields(docs, doc_id="long", text="string")
    ordered = docs.repartitionByRange(files or shuffle_partitions(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    encoded = ordered.mapInArrow(_encode(vocabulary, end_id), "doc_id long, seq long, n_tokens long, ids array<int>")
    encoded.write.options(**{"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "2000", "orc.stripe.size": str(stripe_bytes), "orc.compress": "ZSTD"}).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The rows of write_ids; a filter on doc_id reaches the stripes' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, seq long, n_tokens long, ids array<int>").orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("ids")
        values = lists.flatten().to_numpy().astype("<u4", copy=False)
        stop = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        crc = [zlib.crc32(values[s:e].tobytes()) for s, e in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("file"), b.column("doc_id"), b.column("seq"), pa.array(np.diff(stop)), pa.array(crc, pa.int64())], ["file", "doc_id", "seq", "n_tokens", "ids_crc32"])


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row on file; start counts all ids before it in file order."""
    rows = read_ids(spark, path).select(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file"), "doc_id", "seq", "ids")
    rows = rows.mapInArrow(_checksums, "file int, doc_id long, seq long, n_tokens long, ids_crc32 long")
    # sums by file come from a column read of their own; a row a file is all that meets in one place
    sums = read_ids(spark, path).groupBy(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("file")).agg(F.sum("n_tokens").alias("total"))
    before = sums.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("seq")) - F.col("n_tokens")
    return rows.withColumn("inside", inside).join(before, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op6_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Stage(spark, 'token-orc').root}/ids"
    write_ids(table(spark, sf_dir, "documents"), path, default_vocabulary())
    return file_digests(spark, path)
