"""Operator 8: exact top-k inner products by no-random-access aggregation.

Candidates come in blocks of rows; in a block every component has its sorted list. A query reads the lists from the
end that suits the sign of its component, all to the same depth. What has been read gives each candidate a lower bound
(unread components count as the list's worst) and an upper bound (they count as the list's frontier). A candidate
whose upper bound is below the k-th lower bound cannot qualify. Reading goes deeper, over those still open, until few are
open or the last depth is reached; the scores of those left, and of no others, are resolved. The k-th bound a query has from
earlier blocks of a task carries over. `depth` tells the share of the lists that was read for a query, at most.

Queries of up to `query_bytes` are handed to all tasks, which read their candidates once. Beyond that every query block meets
every candidate block under its own key, which deals the work evenly. The k best of each query leave a task; the k
best of those remain. Ties go to the smaller id.

Vectors null or holding null or non-finite components take no part; vectors meet those of their own length only (no
other product is defined). Sums beyond 2**53 are taken in whole numbers of any size, and stop at a long's ends. Rows
are vectors of their own, also where ids or vectors repeat: a query row meets every row but itself, and has its own
ranks. Null ids take no part. Fewer candidates than k: all. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stage, shuffle_partitions, table

DEPTHS = (0.25, 0.5, 0.75, 0.9)
FEW = 8  # open candidates, in multiples of k, that end the reading


class Block:
    """Candidates of one length with their sorted lists."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray):
        self.rows, self.ids, self.x = rows, ids, x
        order = np.argsort(-x, axis=0, kind="stable")
        self.rank = np.empty(x.shape, np.int32)
        np.put_along_axis(self.rank, order, np.arange(len(x), dtype=np.int32)[:, None], axis=0)
        self.top = np.take_along_axis(x, order, axis=0)  # each list from its largest value down


def best_of_block(q: np.ndarray, block: Block, k: int, floor: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each query, the candidates that can be among its k best above floor, their scores, and the depth that was
    read. floor rises in place."""
    x, top, (n, dims) = block.x, block.top, block.x.shape
    if dims * np.abs(q).max(initial=0) * np.abs(x).max(initial=0) >= 2.0**53:  # beyond exact doubles
        whole = np.vectorize(int, otypes=[object])
        exact = np.clip(whole(q) @ whole(x).T, -(2**63), 2**63 - 1).astype(np.int64)
        return [(np.arange(n), exact[i], 1.0) for i in range(len(q))]
    depth = np.zeros(len(q))
    alive = np.ones((len(q), n), bool)
    if n > FEW * k:
        pos, neg = np.maximum(q, 0.0), np.minimum(q, 0.0)
        worst = pos @ top[-1] + neg @ top[0]  # all components at the list's worst end
        for part in DEPTHS:
            open_q = np.flatnonzero(alive.sum(1) > FEW * k)  # the others need no deeper reading
            if not len(open_q):
                break
            open_c = np.flatnonzero(alive[open_q].any(0))
            deep = max(1, int(n * part))
            rank, rows, p, m = block.rank[open_c], x[open_c], pos[open_q], neg[open_q]
            high, low = rank < deep, rank >= n - deep  # read from the upper end; from the lower end
            ahead, behind = top[min(deep, n - 1)], top[max(n - deep - 1, 0)]  # the frontiers
            # what the read components add over the worst end and over the frontier
            lower = worst[open_q, None] + p @ np.where(high, rows - top[-1], 0.0).T + m @ np.where(low, rows - top[0], 0.0).T
            if len(open_c) >= k:
                lower[~alive[np.ix_(open_q, open_c)]] = -np.inf
                floor[open_q] = np.maximum(floor[open_q], np.partition(lower, len(open_c) - k, axis=1)[:, len(open_c) - k])
            upper = (p @ ahead + m @ behind)[:, None] + p @ np.where(high, rows - ahead, 0.0).T + m @ np.where(low, rows - behind, 0.0).T
            alive[np.ix_(open_q, open_c)] &= upper >= floor[open_q, None]
            depth[open_q] = part
    out = []
    for i in range(len(q)):
        at = np.flatnonzero(alive[i])
        score = x[at] @ q[i]
        if len(at) > k:
            floor[i] = max(floor[i], np.partition(score, len(at) - k)[len(at) - k])
        keep = score >= floor[i]
        out.append((at[keep], score[keep].astype(np.int64), float(depth[i])))
    return out


class Best:
    """The k best of each query so far; queries of one length."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, q: np.ndarray, k: int):
        self.rows, self.ids, self.q, self.k = rows, ids, q, k
        self.floor = np.full(len(q), -np.inf)
        self.depth = np.zeros(len(q))
        none = np.zeros(0, np.int64)
        self.best = [(none, none, none) for _ in ids]  # score, id, row

    def meet(self, block: Block, step: int = 256) -> None:
        for s in range(0, len(self.q), step):
            part = self.floor[s : s + step]
            # a query's own row never counts: one more place is kept for it
            for i, (at, score, depth) in enumerate(best_of_block(self.q[s : s + step], block, self.k + 1, part), s):
                self.depth[i] = max(self.depth[i], depth)
                other = block.rows[at] != self.rows[i]
                if other.any():
                    old = self.best[i]
                    score, ids, rows = (np.concatenate(z) for z in zip(old, (score[other], block.ids[at[other]], block.rows[at[other]]), strict=True))
                    first = np.lexsort((rows, ids, -score))[: self.k]
                    self.best[i] = (score[first], ids[first], rows[first])
                    if len(first) == self.k:
                        self.floor[i] = max(self.floor[i], float(score[first[-1]]))

    def batch(self) -> pa.RecordBatch:
        size = [len(x[0]) for x in self.best]
        score, ids, rows = (np.concatenate([x[c] for x in self.best]) if size else np.zeros(0, np.int64) for c in range(3))
        spread = lambda x: pa.array(np.repeat(x, size))
        return pa.RecordBatch.from_arrays([spread(self.rows), spread(self.ids), pa.array(rows), pa.array(ids), pa.array(score), spread(self.depth)], ["q_row", "query_id", "row", "vec_id", "score", "depth"])


_FOUND = "q_row long, query_id long, row long, vec_id long, score long, depth double"


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dims)


def _stream(told: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, c_rows: int):
    """Candidates of a task, in blocks by length, against queries that all tasks hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: Best(*q, k) for d, q in told.items()}
        held: dict[int, list[pa.RecordBatch]] = {}

        def meet(d: int) -> None:
            b = pa.Table.from_batches(held.pop(d)).combine_chunks().to_batches()[0]
            best[d].meet(Block(b.column("row").to_numpy(), b.column("id").to_numpy(), _matrix(b.column("v"), d)))

        for b in batches:
            dims = b.column("dims").to_numpy()
            for d in np.unique(dims).tolist():
                if d in best:
                    own = b if (dims == d).all() else b.filter(pa.array(dims == d))
                    for s in range(0, own.num_rows, c_rows):
                        held.setdefault(d, []).append(own.slice(s, c_rows))
                        if sum(x.num_rows for x in held[d]) >= c_rows:
                            meet(d)
        for d in list(held):
            meet(d)
        for d in best:
            yield best[d].batch()

    return run


def _pairs(k: int):
    """A query block and a candidate block a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dims = b.column("dims")[r].as_py()
                part = {c: np.asarray(b.column(c)[r].values) for c in ("q_rows", "q_ids", "q_values", "c_rows", "c_ids", "c_values")}
                best = Best(part["q_rows"], part["q_ids"], part["q_values"].reshape(-1, dims), k)
                best.meet(Block(part["c_rows"], part["c_ids"], part["c_values"].reshape(-1, dims)))
                yield best.batch()

    return run


def top_k(spark: SparkSession, vectors: DataFrame, k: int = 5, every: int = 50, q_rows: int = 1024, c_rows: int = 4096, query_bytes: int = 32 << 20) -> DataFrame:
    """vectors(vec_id, embedding): for rows whose id is divisible by `every`, the k largest inner products with other
    rows: query_id, rank, vec_id, score, depth."""
    stage = Stage(spark, "topk")
    good = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e")).where(
        "id is not null and e is not null and size(e) > 0 and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    )
    whole = F.transform("e", lambda x: F.when(F.abs(x) < 2.0**45, F.floor(x * 256).cast("double")).otherwise(x * 256))  # larger ones are whole
    good = stage.write(good.select("id", whole.alias("v"), F.size("e").alias("dims")).repartition(shuffle_partitions(spark), "id").withColumn("row", F.monotonically_increasing_id()), "vectors")
    asked = good.where(F.col("id") % every == 0)
    # counts by length, of as many lengths as fit the bound: more lengths have more bytes
    size = asked.agg(F.coalesce(F.sum(F.col("dims") * 8 + 16), F.lit(0))).first()[0]
    if size <= query_bytes:
        told: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        got = asked.select("row", "id", "dims", "v").toArrow().combine_chunks()  # at most query_bytes
        for d in got["dims"].unique().to_pylist():
            own = got.filter(pc.equal(got["dims"], d)).sort_by("row").combine_chunks()
            told[d] = (own["row"].to_numpy(), own["id"].to_numpy(), _matrix(pa.concat_arrays(own["v"].chunks), d))
        found = good.select("row", "id", "dims", "v").mapInArrow(_stream(told, k, c_rows), _FOUND)
    else:
        def blocks(df: DataFrame, rows: int, p: str) -> DataFrame:
            """Rows packed in blocks, numbered from 0 by length of vector."""
            many = df.groupBy("dims").agg(F.ceil(F.count("*") / rows).alias("of"))
            dealt = df.join(many, "dims").withColumn("block", F.pmod(F.xxhash64("row"), F.col("of")))
            lists = [F.collect_list("row").alias(f"{p}_rows"), F.collect_list("id").alias(f"{p}_ids"), F.flatten(F.collect_list("v")).alias(f"{p}_values")]
            return stage.write(dealt.groupBy("dims", "block").agg(*lists), p).withColumnRenamed("block", f"{p}_block")

        q, c = blocks(asked, q_rows, "q"), blocks(good, c_rows, "c")
        # each side names its partners by number, so the join is on equal keys, one row of either side a key
        partners = lambda df, p: df.groupBy("dims").agg(F.max(f"{p}_block").alias("last"))
        left = q.join(partners(c, "c"), "dims").withColumn("c_block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
        right = c.join(partners(q, "q"), "dims").withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).drop("last")
        found = left.join(right, ["dims", "q_block", "c_block"]).select("dims", "q_rows", "q_ids", "q_values", "c_rows", "c_ids", "c_values").mapInArrow(_pairs(k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "depth")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark, table(spark, sf_dir, "embeddings")).drop("depth")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
