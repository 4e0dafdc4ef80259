"""Operator 3: near-duplicate documents by a chosen-path set similarity join.

A document's set: distinct k-word shingles (A-Z lower-cased; with fewer words the whole sequence). Equal sets are
folded to one vertex. Each set gets minwise values at COORDINATES coordinates; four bits of each make its sketch.

Search (on sketches only). Each of `roots` independent trees puts a set at the root node of its minwise value. A node
of at most `leaf` sets is compared exhaustively. A larger one is compared with PIVOTS of its sets: whatever is within
near + CORE sketch positions of a pivot is tied to it. Sets not tied to the pivots that most are tied to, if they are few, meet
all sets of the node. If they are many, they branch, with those tied but further than CORE from all pivots, to `branches`
child nodes by their values at two coordinates each, chosen by the node's own hash. (Whatever is near a set within CORE of
a pivot is tied to that pivot, by the triangle inequality: those sets are done.) A node beyond `levels` is compared in
full, so no pair is dropped. Two sets of similarity s share a root but for (1 - s)**9 (4e-8 at 0.85, 5e-7 at 0.8), a
child node of one tree but for about (1 - s * s)**10 a level (3e-6 and 4e-5), and their sketches agree in at least `agree` of 64 positions (38 at
0.85, 34 at 0.8) but for 1e-7. A task ties the sets of a node together by links of about as many as it has sets; never
by all of its pairs.

Confirmation (on full sets). What is tied together is a cluster; two linked sets are in one. A cluster's full sets meet in
one task, which finds its true components: from each set reached, all sets not yet reached are compared, exactly, so
copies of one text are settled by one set's comparisons. A cluster beyond `task_sets` or `task_hashes` is dealt out
in parts that all hold a few of its sets; then those outside its largest component meet all of it, block by block.
Links join into components by distributed star rounds.

Hot nodes, those with over 1/16384 of all entries or HOT of them, are dealt out over tasks in parts of about CHUNK, each
part with the node's pivots. Their names are broadcast behind a check of their number.

Nulls and texts without words: empty set, linked with nothing, component of its own. Rows are documents of their own,
also where doc_ids repeat or are null: rows of one id with different texts have different sets. component_id is the
least doc_id reachable, null if rows without an id reach none. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordkernel as wk
from .common import Stage, by_key, fields, handed_out, row_key, table, whole_groups
from .components import components

COORDINATES, POOL = 64, 24
PIVOTS, CORE = 4, 4
CHUNK = 2048  # sets a task takes of a hot node
HOT = 1 << 16  # sets of a node that one task may take
FEW, WORK = 4096, 1 << 23  # others of a hot node that all its sets meet; comparisons of others in a node's task
TIE, MAIN, OTHER, RIM = range(4)  # rows of the search: ties; a part's main pivot; sets not tied to it; those tied, but far
_ODD = np.random.default_rng(7).integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEYS = ["k1", "k2", "k3", "k4"]  # four bits of each coordinate, sixteen coordinates a long
_ONES = np.uint64(0x1111111111111111)


def shingle_sets(w: wk.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, row after row, each row's ascending; and where each row's begin."""
    at, h = wk.runs(w, k)
    row = np.searchsorted(w.first, at, side="right") - 1
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        h = np.concatenate([h, wk.segment_hash(w.hash, w.first[short], w.first[short + 1], wk._WORD_BASE)])
        row = np.concatenate([row, short])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    return h, np.searchsorted(row, np.arange(len(w.first)))


def _identity(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's set; 0 of an empty one."""
    size = np.diff(first)
    full = np.flatnonzero(size)
    one, two = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    if len(full):
        at = first[full]
        one[full] = wk.mix(np.add.reduceat(h, at))
        two[full] = wk.mix(np.bitwise_xor.reduceat(wk.mix(h ^ np.uint64(0x5851F42D4C957F2D)), at) + size[full].astype(np.uint64))
    return one, two


def _summaries(k: int, roots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = roots + POOL
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(b.column("text")):
                h, first = shingle_sets(wk.words(data, offsets, True), k)
                size = np.diff(first)
                full = np.flatnonzero(size)
                one, two = _identity(h, first)
                least = np.zeros((len(size), COORDINATES), np.uint64)
                if len(full):
                    for j in range(COORDINATES):
                        least[full, j] = np.minimum.reduceat(h * _ODD[j], first[full])
                nibble = wk.mix(least) >> np.uint64(60)
                keys = [wk.signed(np.bitwise_or.reduce(nibble[:, g : g + 16] << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1)) for g in range(0, COORDINATES, 16)]
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * wide), pa.array(wk.signed(np.ascontiguousarray(least[:, :wide])).ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in ("doc_id", "r", "no")), pa.array(size.astype(np.int64)), pa.array(wk.signed(one)), pa.array(wk.signed(two)), *map(pa.array, keys), values], ["doc_id", "r", "no", "n", "s1", "s2", *KEYS, "sig"])

    return run


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch positions in which rows differ."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & _ONES).sum(-1, dtype=np.int64)


class Search:
    """Ties within nodes; sets that have to branch."""

    def __init__(self, near: int, percent: int, leaf: int, last: bool):
        self.near, self.percent, self.leaf, self.last = near, percent, leaf, last
        self.ties: list[np.ndarray] = []
        self.rows: list[tuple[int, np.ndarray, int]] = []  # node, sets, kind

    def close(self, k: np.ndarray, n: np.ndarray, k2: np.ndarray, n2: np.ndarray) -> np.ndarray:
        return (np.minimum(n, n2) * 100 >= np.maximum(n, n2) * self.percent) & (_apart(k, k2) <= self.near)

    def small(self, key: np.ndarray, v: np.ndarray, n: np.ndarray, k: np.ndarray, size: np.ndarray) -> None:
        """Nodes of at most 16 sets: all of a batch at once, by distance in the order."""
        pairs = []
        for d in range(1, int(min(16, size.max(initial=1)))):
            i = np.flatnonzero((key[d:] == key[:-d]) & (size[d:] <= 16))
            if not len(i):
                break
            i = i[self.close(k[i], n[i], k[i + d], n[i + d])]
            pairs.append(np.stack([i, i + d], 1))
        head: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := head.get(x, x)) != x:
                x = y
            return x

        keep = []
        for i, j in np.concatenate(pairs).tolist() if pairs else ():
            a, b = top(i), top(j)
            if a != b:
                head[max(a, b)] = min(a, b)
                keep.append((i, j))
        if keep:
            self.ties.append(v[np.array(keep)])

    def all(self, v: np.ndarray, n: np.ndarray, k: np.ndarray) -> None:
        """From each set reached, all that are not yet reached are compared."""
        left = np.arange(1, len(v))
        queue = [0]
        while len(left):
            if not queue:
                queue, left = [int(left[0])], left[1:]
                continue
            i = queue.pop()
            hit = self.close(k[left], n[left], k[i], n[i])
            if hit.any():
                found = left[hit]
                self.ties.append(np.stack([np.full(len(found), v[i]), v[found]], 1))
                queue += found.tolist()
                left = left[~hit]

    def join(self, some: np.ndarray, v: np.ndarray, n: np.ndarray, k: np.ndarray) -> None:
        """Some sets meet all; one is tied only to what no earlier tie reaches."""
        label = np.arange(len(v))
        for i in some.tolist():
            hit = np.flatnonzero(self.close(k, n, k[i], n[i]) & (label != label[i]))
            if len(hit):
                old, one = np.unique(label[hit], return_index=True)
                self.ties.append(np.stack([np.full(len(one), v[i]), v[hit[one]]], 1))
                label[np.isin(label, old)] = label[i]

    def large(self, node: int, v: np.ndarray, n: np.ndarray, k: np.ndarray, hot: bool) -> None:
        """Pivots: a node's first sets. Sets tied to the pivots most are tied to are settled among themselves; the
        others meet all sets, here if these are all of the node and few enough."""
        pv, pk = v[:PIVOTS], k[:PIVOTS]
        apart = np.stack([_apart(k, p) for p in pk], 1)
        tied = apart <= self.near + CORE
        first, some = np.argmax(tied, 1), tied.any(1)
        self.ties.append(np.stack([pv[first[some]], v[some]], 1))
        part = np.arange(len(pv))  # pivots tied by a set they share
        for p in range(1, len(pv)):
            for q in np.unique(first[tied[:, p]]).tolist():
                self.ties.append(np.array([[pv[q], pv[p]]]))
                part[part == part[p]] = part[q]
        mine = np.where(some, part[first], -1)
        main = int(np.bincount(mine[some]).argmax())
        other = np.flatnonzero(mine != main)
        if hot:
            self.rows.append((node, pv[[main]], MAIN))
        elif len(other) * len(v) <= WORK:
            self.join(other, v, n, k)
            return
        self.rows.append((node, np.unique(v[other]), OTHER))
        self.rows.append((node, np.unique(v[(mine == main) & (apart.min(1) > CORE)]), RIM))

    def take(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key, node, v, n = (b.column(c).to_numpy() for c in ("key", "node", "v", "n"))
        hot = b.column("hot").to_numpy(zero_copy_only=False)
        k = np.stack([b.column(c).to_numpy().view(np.uint64) for c in KEYS], 1)
        self.ties, self.rows = [], []
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        self.small(key, v, n, k, np.where(np.repeat(hot[edge[:-1]], size), 17, np.repeat(size, size)))
        for g in np.flatnonzero((size > 16) | hot[edge[:-1]]).tolist():
            s, e = int(edge[g]), int(edge[g + 1])
            if (size[g] > self.leaf or hot[s]) and not self.last:
                self.large(int(node[s]), v[s:e], n[s:e], k[s:e], bool(hot[s]))
            else:
                self.all(v[s:e], n[s:e], k[s:e])
        yield from self.out()

    def out(self) -> Iterator[pa.RecordBatch]:
        ties = np.concatenate(self.ties) if self.ties else np.zeros((0, 2), np.int64)
        ties = ties[ties[:, 0] != ties[:, 1]]
        for at, x, kind in [(ties[:, 0], ties[:, 1], TIE), *((np.full(len(x), node), x, kind) for node, x, kind in self.rows)]:
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(x), pa.array(np.full(len(x), kind, np.int32))], ["a", "b", "kind"])

    def meet(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Sets of role 1 meet all of their key; a set that meets several is tied to each."""
        key, v, n, role = (b.column(c).to_numpy() for c in ("key", "v", "n", "role"))
        k = np.stack([b.column(c).to_numpy().view(np.uint64) for c in KEYS], 1)
        self.ties, self.rows = [], []
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            self.join(np.flatnonzero(role[s:e]), v[s:e], n[s:e], k[s:e])
        yield from self.out()


def _meet(near: int, percent: int, leaf: int, last: bool, others: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(near, percent, leaf, last)
        for b in whole_groups(batches):
            yield from search.meet(b) if others else search.take(b)

    return run


def _sets(k: int):
    """Rows with their text to the bytes of their set's ascending 64-bit hashes, where it is the set that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(b.column("text")):
                h, first = shingle_sets(wk.words(data, offsets, True), k)
                one, two = _identity(h, first)
                part = b.slice(lo, hi - lo)
                right = (wk.signed(one) == part.column("s1").to_numpy()) & (wk.signed(two) == part.column("s2").to_numpy())
                raw = h.tobytes()
                out = [raw[8 * s : 8 * e] for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("v"), part.column("cluster"), pa.array(np.diff(first)), pa.array(out, pa.binary())], ["v", "cluster", "n", "set"]).filter(pa.array(right))

    return run


class Overlaps:
    """Exact intersections of the sets of one group, by bits over the elements that two or more of them hold."""

    def __init__(self, sets: list[np.ndarray], most_bits: int = 1 << 29):
        size = np.array([len(s) for s in sets])
        _, back, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = many > 1
        number = np.cumsum(shared) - 1
        row = np.repeat(np.arange(len(sets)), size)
        keep = shared[back]
        row, col = row[keep], number[back[keep]]
        wide = int(shared.sum())
        self.bits = self.order = None
        if len(sets) * max(64, wide) <= most_bits:
            self.bits = np.zeros((len(sets), -(-max(wide, 1) // 64)), np.uint64)
            np.bitwise_or.at(self.bits, (row, col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))
        else:  # lists of the sets that hold an element
            self.col, self.first = col, np.searchsorted(row, np.arange(len(sets) + 1))
            by = np.argsort(col, kind="stable")
            self.order, self.start = row[by], np.searchsorted(col[by], np.arange(wide + 1))
            self.rows = len(sets)

    def of(self, i: int, others: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[others] & self.bits[i]).sum(1, dtype=np.int64)
        own = self.col[self.first[i] : self.first[i + 1]]
        hits = [self.order[s:e] for s, e in zip(self.start[own].tolist(), self.start[own + 1].tolist(), strict=True)]
        return np.bincount(np.concatenate(hits), minlength=self.rows)[others] if hits else np.zeros(len(others), np.int64)


def _links(percent: int):
    """Of each key's sets: links that give its components. Sets of role 1, if there are any, meet all of another label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in whole_groups(batches):
            key = b.column("key").to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            a_out, b_out = [], []
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                if e - s < 2:
                    continue
                part = b.slice(s, e - s)
                v, role, label = (part.column(c).to_numpy() for c in ("v", "role", "label"))
                v, one = np.unique(v * 2 + role, return_index=True)  # a row that repeats is one set
                role, label = role[one], label[one]
                v >>= 1
                sets = [np.frombuffer(part.column("set")[i].as_buffer(), np.uint64) for i in one.tolist()]
                n = np.array([len(x) for x in sets])
                over = Overlaps(sets)

                def linked(i: int, others: np.ndarray) -> np.ndarray:
                    both = over.of(i, others)  # noqa: B023
                    return 100 * both >= percent * (n[others] + n[i] - both)  # noqa: B023

                if not role.any():
                    left, queue = np.arange(1, len(v)), [0]
                    while len(left):
                        if not queue:
                            queue, left = [int(left[0])], left[1:]
                            continue
                        i = queue.pop()
                        hit = linked(i, left)
                        if hit.any():
                            found = left[hit]
                            a_out.append(np.full(len(found), v[i]))
                            b_out.append(v[found])
                            queue += found.tolist()
                            left = left[~hit]
                else:
                    every = np.flatnonzero(role == 0)
                    for i in np.flatnonzero(role).tolist():
                        others = every[label[every] != label[i]]
                        found = others[linked(i, others)]
                        found = found[np.unique(label[found], return_index=True)[1]]  # one link a component
                        a_out.append(np.full(len(found), v[i]))
                        b_out.append(v[found])
            if a_out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a_out)), pa.array(np.concatenate(b_out))], ["a", "b"])

    return run


def _ties(stage: Stage, heads: DataFrame, percent: int, roots: int, branches: int, levels: int, leaf: int, near: int) -> DataFrame:
    """heads(v, n, k1..k4, sig) to ties (a, b): linked sets are tied together."""

    first = F.explode(F.transform(F.sequence(F.lit(0), F.lit(roots - 1)), lambda i: F.struct(i.alias("i"), F.get("sig", i).alias("x")))).alias("c")
    # a child is named by the values at two coordinates, which differ from node to node
    pool = lambda i, j: F.get("sig", F.pmod(F.xxhash64("node", i, F.lit(j)), F.lit(POOL)).cast("int") + roots)
    child = F.explode(F.transform(F.sequence(F.lit(0), F.lit(branches - 1)), lambda i: F.struct(i.alias("i"), pool(i, 0).alias("x"), pool(i, 1).alias("y")))).alias("c")
    found: list[DataFrame] = []
    rows = heads.select("v", "n", *KEYS, first).select(F.xxhash64("c.i", "c.x").alias("node"), "v", "n", *KEYS)
    total, down = heads.count() * roots, None
    zero = F.lit(0).cast("long")
    parts, seat = F.ceil(F.col("c") / CHUNK), F.pmod(F.xxhash64("v"), F.ceil(F.col("c") / CHUNK))
    spread = F.explode(F.sequence(zero, parts - 1)).alias("part")
    for level in range(levels + 1):
        last = level == levels
        dealt = rows.withColumn("key", F.col("node")).withColumn("hot", F.lit(False)).withColumn("role", F.lit(1))
        hot = None
        if not last:
            hot = stage.write(rows.groupBy("node").agg(F.count("*").alias("c")).where(F.col("c") > min(max(CHUNK, total // 16384), HOT)), "hot")
            many = hot.count()
            hot = handed_out(hot) if many else None
        if hot is not None:
            key, order = F.xxhash64("node", "part").alias("key"), F.xxhash64("v", F.lit(level))
            pivots = rows.join(hot, "node").groupBy("node", "c", F.pmod(order, F.lit(PIVOTS))).agg(F.min(F.struct(order.alias("s"), "v", "n", *KEYS)).alias("p"))
            led = pivots.select("node", "p.v", "p.n", *[f"p.{x}" for x in KEYS], spread).select("node", "v", "n", *KEYS, key, F.lit(True).alias("hot"), F.lit(0).alias("role"))
            dealt = rows.join(hot, "node", "left").withColumn("part", seat)
            dealt = dealt.select("node", "v", "n", *KEYS, F.when(F.col("c").isNull(), F.col("node")).otherwise(F.xxhash64("node", "part")).alias("key"), F.col("c").isNotNull().alias("hot"), F.lit(1).alias("role")).unionByName(led)
        met = stage.write(by_key(dealt, "role", "v").mapInArrow(_meet(near, percent, leaf, last), _MET), "met")
        found.append(met.where(F.col("kind") == TIE).select("a", "b"))
        rest = met.where(F.col("kind") >= OTHER).select(F.col("a").alias("node"), F.col("b").alias("v"), "kind")
        if hot is not None:
            # hot nodes with one main pivot and few others: these meet all sets of the node, part by part
            count = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
            told = met.where(F.col("kind") != TIE).groupBy(F.col("a").alias("node")).agg(F.min(F.when(F.col("kind") == MAIN, F.col("b"))).alias("m0"), F.max(F.when(F.col("kind") == MAIN, F.col("b"))).alias("m1"), count(OTHER).alias("others"))
            settled = stage.write(told.where((F.col("m0") == F.col("m1")) & (F.col("others") <= FEW)).select("node", "others"), "settled")
            rest = rest.join(settled, "node", "left_anti")
            some = settled.where("others > 0")
            if not some.isEmpty():
                every = rows.join(hot, "node").join(some, "node")
                out = met.where(F.col("kind") == OTHER).select(F.col("a").alias("node"), F.col("b").alias("v")).join(some, "node")
                out = out.join(hot, "node").join(heads.select("v", "n", *KEYS), "v").select("node", "v", "n", *KEYS, spread, F.lit(1).alias("role"))
                every = every.select("node", "v", "n", *KEYS, seat.alias("part"), F.lit(0).alias("role")).unionByName(out).withColumn("key", F.xxhash64("node", "part"))
                found.append(stage.write(by_key(every, "v").mapInArrow(_meet(near, percent, leaf, last, True), _MET), "others").select("a", "b"))
        stage.release()
        if last:
            break
        down = stage.write(rest.select("node", "v").distinct().join(heads.select("v", "n", *KEYS, "sig"), "v"), "down")
        if (total := down.count() * branches) == 0:
            break
        rows = down.select("v", "n", *KEYS, "node", child).select(F.xxhash64(F.lit(level + 1), "node", "c.i", "c.x", "c.y").alias("node"), "v", "n", *KEYS)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out.toDF("u", "v")


_MET = "a long, b long, kind int"


def row_groups(
    spark: SparkSession, docs: DataFrame, percent: int = 80, shingle: int = 5, roots: int = 9, branches: int = 10, levels: int = 4, leaf: int = 2048, agree: int = 34, task_sets: int = 4096, task_hashes: int = 1 << 21
) -> DataFrame:
    """docs(doc_id, text) to doc_id, r, no, n, label, component_id for every row: r and no are row_key's hashes, n the
    size of the row's set, label its group (null for empty sets), component_id the least doc_id there. `agree` belongs to
    `percent`."""
    stage = Stage(spark, "near-dedup")
    docs = fields(docs, doc_id="long", text="string")
    docs = docs.withColumns(dict(zip(("r", "no"), row_key("doc_id", "text"), strict=True)))
    every = stage.write(docs.mapInArrow(_summaries(shingle, roots), f"doc_id long, r long, no int, n long, s1 long, s2 long, {', '.join(f'{k} long' for k in KEYS)}, sig array<long>"), "sets")
    # equal sets fold to one vertex, which the row of the least r stands for
    vertex = every.where("n > 0").groupBy("s1", "s2", "n", *KEYS, "sig").agg(F.min("doc_id").alias("id"), F.min("r").alias("r"))
    heads = stage.write(vertex.withColumn("v", F.monotonically_increasing_id()), "heads")
    stage.release()
    tied = components(stage, _ties(stage, heads, percent, roots, branches, levels, leaf, COORDINATES - agree))
    clusters = stage.write(tied.select(F.col("node").alias("v"), F.col("component").alias("cluster")).join(heads.select("v", "n", "r", "s1", "s2"), "v"), "clusters")
    stage.release()

    # full sets of the clusters' rows; up to a million row keys are handed out, so that other texts stay where they are
    asked = clusters.select("r", "v", "cluster", "s1", "s2")
    texts = docs.select("r", "text")
    wanted = clusters.select("r")
    if (some := handed_out(wanted)) is not wanted:
        texts = texts.join(some, "r", "left_semi")
    sets = stage.write(texts.join(asked, "r").select("v", "cluster", "s1", "s2", "text").mapInArrow(_sets(shingle), "v long, cluster long, n long, set binary"), "full")
    stage.release()
    size = clusters.groupBy("cluster").agg(F.count("*").alias("c"), F.sum("n").alias("hashes"))
    parts = F.ceil(F.greatest(F.col("c") / task_sets, F.col("hashes") / task_hashes))
    large = stage.write(size.where((F.col("c") > task_sets) | (F.col("hashes") > task_hashes)).select("cluster", (parts * 2).cast("long").alias("parts")), "large")
    none = [F.lit(0).cast("long").alias("role"), F.lit(0).cast("long").alias("label")]
    confirm = lambda rows, name: stage.write(by_key(rows).mapInArrow(_links(percent), "a long, b long"), name).toDF("u", "v")
    one = sets.join(large, "cluster", "left_anti").select(F.col("cluster").alias("key"), "v", *none, "set")
    links = confirm(one, "links")
    if not large.isEmpty():
        big = stage.write(sets.join(large, "cluster"), "big")
        part = F.pmod(F.xxhash64("v"), F.col("parts"))
        # a few sets of a cluster are in all of its parts
        chosen = big.groupBy("cluster", F.pmod(F.xxhash64("v"), F.lit(2 * PIVOTS))).agg(F.min("v").alias("v")).select("v", F.lit(True).alias("leads"))
        whole = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)
        dealt = big.join(chosen, "v", "left").withColumn("part", F.explode(F.when(F.col("leads"), whole).otherwise(F.array(part))))
        links = links.union(confirm(dealt.select(F.xxhash64("cluster", "part").alias("key"), "v", *none, "set"), "links"))
        # whatever is outside a cluster's largest component meets all of it, block by block
        known = components(stage, links).select(F.col("node").alias("v"), F.col("component").alias("label"))
        named = stage.write(big.select("v", "cluster", "parts", "n").join(known, "v", "left").withColumn("label", F.coalesce("label", "v")), "named")
        most = named.groupBy("cluster", "label").agg(F.count("*").alias("c")).groupBy("cluster").agg(F.max_by("label", "c").alias("most"))
        others = named.join(most, "cluster").where("label <> most").select("v", "cluster", "n")
        blocks = F.ceil(F.greatest(F.count("*") / (task_sets // 4), F.sum("n") / (task_hashes // 4))).cast("long")
        blocks = stage.write(others.groupBy("cluster").agg(blocks.alias("blocks")), "blocks")
        if not blocks.isEmpty():
            rows = big.select("v", "set").join(named.join(blocks, "cluster").join(most, "cluster"), "v")
            whole, block = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.pmod(F.xxhash64("v", F.lit(1)), F.col("blocks"))
            all_of = rows.select("cluster", "v", "label", "set", F.lit(0).cast("long").alias("role"), part.alias("part"), F.explode(whole).alias("block"))
            out_of = rows.where("label <> most").select("cluster", "v", "label", "set", F.lit(1).cast("long").alias("role"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), block.alias("block"))
            met = all_of.unionByName(out_of).select(F.xxhash64("cluster", "part", "block").alias("key"), "v", "role", "label", "set")
            links = links.union(confirm(met, "links"))
        stage.drop(big)
    label = components(stage, links).select(F.col("node").alias("v"), F.col("component").alias("label"))
    named = stage.write(heads.select("v", "s1", "s2", "id").join(label, "v", "left").withColumn("label", F.coalesce("label", "v")), "labels")
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = stage.write(named.join(least, "label").select("s1", "s2", "label", "component_id"), "components")
    stage.drop(sets, clusters, heads)
    out = stage.write(every.select("doc_id", "r", "no", "n", "s1", "s2").join(named, ["s1", "s2"], "left").drop("s1", "s2"), "rows")
    stage.drop(every, named)
    stage.release()
    return out


def near_duplicates(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id, kept for every row; how: row_groups' parameters."""
    rows = row_groups(spark, docs, **how)
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_copies(spark: SparkSession, docs: DataFrame, **how) -> DataFrame:
    """docs, with all their columns, less the near copies: of each group the row of the least doc_id stays, of rows
    without one the first by hash; of equal rows one. Rows without words all stay. Kept texts are not moved, but for those
    of rows that repeat."""
    rows = row_groups(spark, docs, **how).where("n > 0")
    stage = Stage(spark, "without-copies")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "r", "no")
    stay = rows.groupBy("label").agg(F.min(rank).alias("k"), F.count("*").alias("c")).select("k.r", "k.no", "c")
    keys = rows.groupBy("r", "no").agg(F.count("*").alias("n")).join(stay.select("r", "no", F.lit(True).alias("stays")), ["r", "no"], "left")
    keys = stage.write(keys.where("stays is null or n > 1"), "keys")
    lower = {c.lower() for c in docs.columns}
    own = [next(x for i in range(len(docs.columns) + 1) if (x := f"_{c}{'_' * i}") not in lower) for c in ("r", "no")]
    keyed = docs.withColumns(dict(zip(own, row_key(docs["doc_id"].cast("long"), docs["text"].cast("string")), strict=True)))
    left = keyed.join(handed_out(keys.where("stays is null").select("r", "no").toDF(*own)), own, "left_anti")
    again = keys.where("stays").select("r", "no").toDF(*own)
    if not again.isEmpty():
        again = handed_out(again)
        left = left.join(again, own, "left_anti").unionByName(left.join(again, own, "left_semi").dropDuplicates(own))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark, table(spark, sf_dir, "documents"), percent=85, agree=38)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(list_slice(ws, i, i + 4), ' ') END AS g
  FROM w, unnest(range(1, greatest(2, len(ws) - 3))) AS u(i) WHERE len(ws) > 0),
z AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM (SELECT * FROM s SEMI JOIN f USING (g)) x JOIN (SELECT * FROM s SEMI JOIN f USING (g)) y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
k AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN k ON k.node = d.doc_id LEFT JOIN z ON z.doc_id = d.doc_id
"""
