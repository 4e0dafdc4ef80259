"""Operator 5: removal of word passages that occur more than once, by difference-cover anchors.

A window is `window` consecutive words of one document. With a difference cover D modulo v, any two positions i, j
have one shift d < v that brings both onto cover positions; so two equal windows share an equal aligned anchor of
window - v + 1 words. Steps, each a written table or one shuffle:

1. hash the anchors at cover positions only (5 of 21 positions), count by hash, keep hashes seen twice or more;
2. bring these back to their documents (a Bloom filter of fixed size keeps most other anchors from moving); a window that holds a repeated anchor is a candidate (every repeated window
   does, at the shift it shares with its copy);
3. extend: texts are dealt into units of about 1 MB by their keys; a unit hashes its candidate windows and sends each
   hash once, packed, to the bucket of that hash; buckets find the hashes that start at two places or more and answer
   each unit with a bit a hash;
4. units read the bits beside the same texts; each word that a repeated window covers is removed.

Counts of anchors are pre-aggregated in each task, and the join that brings anchors back is a plain inner join, which
adaptive execution splits; so a passage held by a third of all documents is a row a task, and later a hash a unit. No
window moves with its place: 12 bytes go out, a bit comes back. Windows are judged on the input.

Nulls and texts without words: n_words 0, nothing removed, the hash of an empty string. Repeated rows are copies of
one another: their windows repeat, so each loses them all. A null doc_id takes part and is returned as null.
Other columns, whatever their names, are ignored. Empty table: empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordkernel as wk
from .common import Stage, by_key, fields, handed_out, row_key, shuffle_partitions, table, whole_groups

#: Perfect difference sets by period: every residue is a difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
ROW = ["row_id", "row_no"]


def cover_for(window: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of at least a third of the window; (1, (0,)) for tiny windows."""
    fit = [v for v in COVERS if window - v + 1 >= max(2, window // 3)]
    v = max(fit, default=1)
    return v, COVERS.get(v, (0,))


def _anchors(w: wk.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index, row and hash of each anchor of rows that hold a window."""
    v, cover = cover_for(window)
    at, h = wk.runs(w, window - v + 1)
    row = np.searchsorted(w.first, at, side="right") - 1
    is_cover = np.zeros(v, bool)
    is_cover[list(cover)] = True
    keep = is_cover[(at - w.first[row]) % v] & (np.diff(w.first)[row] >= window)
    return at[keep], row[keep], h[keep]


def _count_anchors(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in wk.chunks(b.column("text")):
                h, n = np.unique(_anchors(wk.words(data, offsets, False), window)[2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(wk.signed(h)), pa.array(n)], ["h", "n"])

    return run


BLOOM_BITS = 1 << 25


def _bloom(hashes: DataFrame) -> np.ndarray:
    """Bits at two places a hash, of a fixed number: what reaches the driver is at most their 4 MB, by word, with the
    words' numbers."""
    mask = F.lit(BLOOM_BITS - 1)
    at = F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask)))
    words = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    got = words.toArrow()
    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def _in_bloom(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    mask, found = np.uint64(BLOOM_BITS - 1), np.ones(len(h), bool)
    for at in (h & mask, (h >> np.uint64(32)) & mask):
        found &= (bloom[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _place_anchors(window: int, bloom: np.ndarray):
    """Places of anchors that may be repeated ones; few others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(b.column("text")):
                w = wk.words(data, offsets, False)
                at, row, h = _anchors(w, window)
                some = _in_bloom(bloom, h)
                at, row, h = at[some], row[some], h[some]
                pos = (at - w.first[row]).astype(np.int32)
                ids = [b.column(c).slice(lo, hi - lo).take(pa.array(row)) for c in ROW]
                yield pa.RecordBatch.from_arrays([pa.array(wk.signed(h)), *ids, pa.array(pos)], ["h", "row_id", "row_no", "pos"])

    return run


#: Bytes of texts a unit, and bytes of texts whose windows share a bucket.
UNIT_BYTES, BUCKET_BYTES = 1 << 20, 1 << 24


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Each key of by_key with its rows."""
    for b in whole_groups(batches):
        k = b.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for lo, hi in pairwise(cuts):
            yield int(k[lo]), b.slice(lo, hi - lo)


class Unit(NamedTuple):
    rows: list[tuple[int, int]]  # keys of the rows with candidate windows, in order
    row: np.ndarray  # by candidate window: its row's index in rows
    pos: np.ndarray  # its start
    which: np.ndarray  # its hash's index in h
    h: np.ndarray  # different hashes in order, of 64 and 32 bits
    g: np.ndarray
    many: np.ndarray  # whether a hash occurs twice or more in this unit
    cuts: np.ndarray  # where each bucket's hashes begin


def _unit(part: pa.RecordBatch, window: int, buckets: int) -> Unit:
    """Candidate windows of a unit's rows of kind 0 (at: repeated anchors' positions) and 1 (texts), each kind in the
    order of row keys; equal rows are alike, so the result is the same whenever it is computed."""
    v, _ = cover_for(window)
    begin, end = np.searchsorted(part.column("kind").to_numpy(), (1, 2)).tolist()
    places, texts = part.slice(0, begin), part.slice(begin, end - begin)
    known = {k: i for i, k in enumerate(zip(*(places.column(c).to_pylist() for c in ROW), strict=True))}
    rows = list(zip(*(texts.column(c).to_pylist() for c in ROW), strict=True))
    some = [i for i, k in enumerate(rows) if k in known]
    rows = [rows[i] for i in some]
    all_lists = places.column("at").take(pa.array([known[k] for k in rows], pa.int64()))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32))]
    for lo, hi, data, offsets in wk.chunks(texts.column("text").take(pa.array(some, pa.int64()))):
        w = wk.words(data, offsets, False)
        n = len(w.hash)
        lists = all_lists.slice(lo, hi - lo)
        row_of = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
        seen = np.zeros(n + 1, np.int64)
        seen[w.first[row_of] + lists.flatten().to_numpy()] = 1
        hits = np.zeros(n + 1, np.int64)
        np.cumsum(seen[:n], out=hits[1:])
        at, h = wk.runs(w, window)
        good = hits[at + v] > hits[at]
        at, h = at[good], h[good]
        # a second hash, over other values of the words
        g = (wk.segment_hash(wk.mix(w.hash ^ np.uint64(0xA0761D6478BD642F)), at, at + window, wk._BASE) >> np.uint64(32)).astype(np.uint32)
        row = np.searchsorted(w.first, at, side="right") - 1
        found.append((lo + row, at - w.first[row], h, g))
    row, pos, h, g = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((g, h))
    h, g = h[order], g[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    h, g, many = h[first], g[first], np.diff(first, append=len(new)) > 1
    bucket = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    return Unit(rows, row, pos, which, h, g, many, np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64)))


ASKED = "key long, unit long, h binary, g binary, many binary"
ANSWERS = "key long, bucket int, bits binary"


def _ask(window: int, buckets: int):
    """Of units: their different hashes, packed, by bucket (key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, part in _parts(batches):
            u = _unit(part, window, buckets)
            to = np.flatnonzero(np.diff(u.cuts))
            ends = list(zip(u.cuts[to].tolist(), u.cuts[to + 1].tolist(), strict=True))
            packed = [pa.array([x[lo:hi].tobytes() for lo, hi in ends], pa.binary()) for x in (u.h, u.g)]
            many = pa.array([np.packbits(u.many[lo:hi]).tobytes() for lo, hi in ends], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), pa.array(np.full(len(to), unit, np.int64)), *packed, many], ["key", "unit", "h", "g", "many"])

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of what was asked, by bucket: for each unit (key) a bit a hash, set if it occurs twice or more anywhere."""
    for bucket, part in _parts(batches):
        packed = part.column("h").to_pylist()
        sizes = [len(x) // 8 for x in packed]
        h = np.frombuffer(b"".join(packed), np.uint64)
        g = np.frombuffer(b"".join(part.column("g").to_pylist()), np.uint32)
        again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(part.column("many").to_pylist(), sizes, strict=True)]).astype(bool)
        order = np.lexsort((g, h))
        same = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        ends = np.cumsum(sizes).tolist()
        bits = [np.packbits(again[hi - n : hi]).tobytes() for n, hi in zip(sizes, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("unit"), pa.array(np.full(len(bits), bucket, np.int32)), pa.array(bits, pa.binary())], ["key", "bucket", "bits"])


def _read_answers(window: int, buckets: int):
    """Of units with their answers (kind 2): by row key, the starts of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, part in _parts(batches):
            u = _unit(part, window, buckets)
            answers = part.slice(int(np.searchsorted(part.column("kind").to_numpy(), 2)))
            again = np.zeros(len(u.h), bool)
            if answers.num_rows != np.count_nonzero(np.diff(u.cuts)):
                raise ValueError(f"unit {unit} has {answers.num_rows} answers")
            for q, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
                lo, hi = u.cuts[q : q + 2]
                if len(bits) != (hi - lo + 7) // 8:
                    raise ValueError(f"unit {unit} asked other hashes of bucket {q}")
                again[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
            first = np.array([not i or k != u.rows[i - 1] for i, k in enumerate(u.rows)], bool)  # one of equal rows
            good = again[u.which] & first[u.row]
            n = np.bincount(u.row[good], minlength=len(u.rows))
            rows = [u.rows[i] for i in np.flatnonzero(n).tolist()]
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n[n > 0]))).astype(np.int32), pa.array(u.pos[good].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.int64()), pa.array([k[1] for k in rows], pa.int32()), lists], [*ROW, "at"])

    return run


def _kept(b: pa.RecordBatch, window: int, at: str = "at") -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[bytes]]]:
    """By chunk: first and end row, words, words removed, and the kept words of each row joined by one space."""
    for lo, hi, data, offsets in wk.chunks(b.column("text")):
        w = wk.words(data, offsets, False)
        rows, n = hi - lo, len(w.hash)
        lists = b.column(at).slice(lo, rows).fill_null([])
        row_of = np.repeat(np.arange(rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        begin = w.first[row_of] + lists.flatten().to_numpy()
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.subtract.at(cover, begin + window, 1)
        gone = np.cumsum(cover)[:n] > 0
        total = np.diff(w.first)
        lost = np.zeros(n + 1, np.int64)
        lost[1:] = np.cumsum(gone)
        removed = lost[w.first[1:]] - lost[w.first[:-1]]
        raw = data.tobytes()
        keep: list[bytes] = []
        for r in range(rows):
            if not removed[r]:
                keep.append(b" ".join(raw[offsets[r] : offsets[r + 1]].split()))  # bytes.split() knows the same six white-space bytes
            elif removed[r] == total[r]:
                keep.append(b"")
            else:
                i = np.arange(w.first[r], w.first[r + 1])[~gone[w.first[r] : w.first[r + 1]]]
                keep.append(b" ".join(raw[s:e] for s, e in zip(w.starts[i].tolist(), w.ends[i].tolist(), strict=True)))
        yield lo, hi, total, removed, keep


def _digest(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, total, removed, keep in _kept(b, window):
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(lo, hi - lo), pa.array(total.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in keep], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
                )

    return run


def _replace(window: int, names: list[str], at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, _, removed, keep in _kept(b, window, at):
                part = b.slice(lo, hi - lo)
                text = [t if not x else k.decode() for t, x, k in zip(part.column("text").to_pylist(), removed.tolist(), keep, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()) if c == "text" else part.column(c) for c in names], names)

    return run


def _beside(keyed: DataFrame, lists: DataFrame, row: list[str]) -> DataFrame:
    """keyed rows with the lists of their keys, or null. While the keys are few, other rows' texts stay where they are."""
    wanted = lists.select(*row)
    some = handed_out(wanted)
    if some is wanted:
        return keyed.join(lists, row, "left")
    with_list = keyed.join(some, row, "left_semi").join(lists, row)
    return keyed.join(some, row, "left_anti").withColumn(lists.columns[-1], F.lit(None).cast("array<int>")).unionByName(with_list)


def _repeated_windows(stage: Stage, keyed: DataFrame, window: int) -> DataFrame:
    """keyed(row_id, row_no, text) to the row and the start of each window that starts anywhere else too. Windows are
    told apart by 96 bits of two hashes."""
    repeated = stage.write(
        keyed.select("text").mapInArrow(_count_anchors(window), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"), "anchors"
    )
    stage.release()
    placed = keyed.select(*ROW, "text").mapInArrow(_place_anchors(window, _bloom(repeated)), "h long, row_id long, row_no int, pos int")
    found = stage.write(placed.join(repeated, "h").groupBy(*ROW).agg(F.collect_list("pos").alias("at")), "places")
    stage.drop(repeated)
    stage.release()
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    units, buckets = size // UNIT_BYTES + 1, max(shuffle_partitions(stage.spark), size // BUCKET_BYTES + 1)
    with_key = [F.pmod("row_id", F.lit(units)).alias("key"), *ROW]
    texts, wanted = keyed, found.select(*ROW)
    if (some := handed_out(wanted)) is not wanted:  # other rows' texts stay where they are
        texts = keyed.join(some, ROW, "left_semi")
    dealt = found.select(*with_key, "at", F.lit(0).alias("kind")).unionByName(texts.select(*with_key, "text", F.lit(1).alias("kind")), allowMissingColumns=True)
    order = ["kind", *ROW]
    asked = by_key(dealt, *order).mapInArrow(_ask(window, buckets), ASKED)
    answers = stage.write(by_key(asked).mapInArrow(_answer, ANSWERS), "answers")
    stage.release()
    answered = dealt.unionByName(answers.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    gone = stage.write(by_key(answered, *order).mapInArrow(_read_answers(window, buckets), "row_id long, row_no int, at array<int>"), "gone")
    stage.drop(found, answers)
    stage.release()
    return gone


def remove_repeats(spark: SparkSession, docs: DataFrame, window: int = 35) -> DataFrame:
    """docs(doc_id, text) to one row a document: doc_id, n_words, n_removed, kept_sha256."""
    docs = fields(docs, doc_id="long", text="string")
    keyed = docs.withColumns(dict(zip(ROW, row_key("doc_id", "text"), strict=True)))
    gone = _repeated_windows(Stage(spark, "substring-dedup"), keyed, window)
    return _beside(keyed, gone, ROW).select("doc_id", "text", "at").mapInArrow(_digest(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(spark: SparkSession, docs: DataFrame, window: int = 35) -> DataFrame:
    """docs with all their columns; texts that lose words become their kept words joined by one space, others stay as
    they are. n_chars, where there is one, is counted anew."""
    names = docs.columns
    lower = {n.lower() for n in names}
    key, no, at = (next(n for n in (f"_{x}{'_' * i}" for i in range(len(names) + 1)) if n not in lower) for x in ("row", "no", "at"))
    keyed = docs.withColumns(dict(zip((key, no), row_key("doc_id", "text"), strict=True)))
    gone = _repeated_windows(Stage(spark, "substring-dedup"), keyed.select(F.col(key).alias("row_id"), F.col(no).alias("row_no"), F.col("text").cast("string").alias("text")), window)
    out = _beside(keyed, gone.toDF(key, no, at), [key, no]).select(*[F.col(f"`{c}`") for c in names], at).mapInArrow(_replace(window, names, at), docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents"))


_W = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE = f"""
WITH w AS (SELECT doc_id, {_W} AS ws FROM documents),
p AS (SELECT doc_id, i, list_slice(ws, i, i + 34) AS win FROM w, unnest(range(1, len(ws) - 33)) AS u(i)),
r AS (SELECT md5(array_to_string(win, ' ')) AS h FROM p GROUP BY 1 HAVING count(*) > 1),
g AS (SELECT doc_id, list(i) AS places FROM p WHERE md5(array_to_string(win, ' ')) IN (SELECT h FROM r) GROUP BY doc_id),
c AS (SELECT DISTINCT doc_id, j FROM g, unnest(places) AS a(i), unnest(range(i, i + 35)) AS b(j)),
n AS (SELECT doc_id, count(*) AS n, list(j) AS js FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(list_transform(ws, lambda x, k: CASE WHEN list_contains(js, k) THEN NULL ELSE x END), lambda x: x IS NOT NULL), ' '), '')) AS kept_sha256
FROM w LEFT JOIN n USING (doc_id)
"""
