"""Operator 10: language-model scores of texts from a hidden Markov model trained by Baum-Welch.

Tokens: white-space words (A-Z lower-cased), then one end. Corpus counts of every word are taken over all training
texts (pre-aggregated in each chunk). The model: `states` latent states emit symbols; the `own` most frequent words
and the end are symbols of their own, every other word belongs to a class (by its last two bytes), and the word within
its class has probability (c + 0.1) / (N_class + 0.1 * (V_class + 1)), so that unseen words have some. Training is
incremental Baum-Welch: the training texts are dealt into `rounds` equal parts by hash, and each round runs the scaled
forward and backward recursions over its part, so that a pass counts every training text once. Expected transitions
and emissions are summed by chunk, then by partition, then over the part; what reaches the driver is the model's own
size. In the first pass new sums replace all but `keep` of the earlier ones; in later ones they replace their own
part's, so that the model then rests on all texts. Passes go on until the mean log likelihood of a token, of which
`trace` has a value a pass, gains less than `gain`, at most `passes`. A text's score is its exact log10 likelihood by the scaled forward recursion plus its words' log10 shares of their classes.

The `table_words` most frequent words' counts (a fixed bound) are handed to the tasks; the counts of all others are
joined by hash, so no count is dropped. Encoded texts (two bytes a token) are kept as a table for the rounds.

Nulls and empty texts: the end token alone. Without training texts all counts are 0 and the model is uniform.
Repeated rows and null doc_ids (counted as training text with an empty id) are scored row by row; other columns are
ignored. An empty table gives an empty result. Both recursions are exact over texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordkernel as wk
from .common import Stage, fields, table

CLASSES = 509
END = np.uint64(0x656E64)
TEN = float(np.log(10.0))


class Lexicon(NamedTuple):
    hashes: np.ndarray  # ascending, of the most frequent words
    counts: np.ndarray
    symbols: np.ndarray  # own symbol, or CLASSES' number


def classes_of(w: wk.Words) -> np.ndarray:
    low = wk._LOWER[w.data]
    last = low[w.ends - 1].astype(np.int64)
    before = np.where(w.ends - w.starts > 1, low[np.maximum(w.ends - 2, 0)], 0)
    return (last * 251 + before) % CLASSES


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, _, data, offsets in wk.chunks(b.column("text")):
            w = wk.words(data, offsets, True)
            h, one, n = np.unique(w.hash, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(wk.signed(h)), pa.array(classes_of(w)[one].astype(np.int32)), pa.array(n)], ["h", "class", "n"])


def _encode(lexicon: Lexicon, base_log: np.ndarray, share_log: np.ndarray, end: int, end_log: float, end_known: int):
    """Each text as symbols, with the sums over words of the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(b.column("text")):
                w = wk.words(data, offsets, True)
                at = np.minimum(np.searchsorted(lexicon.hashes, w.hash), max(0, len(lexicon.hashes) - 1))
                known = lexicon.hashes[at] == w.hash if len(lexicon.hashes) else np.zeros(len(w.hash), bool)
                symbol = classes_of(w) if len(w.hash) else np.zeros(0, np.int64)
                if known.any():
                    own = lexicon.symbols[at]
                    symbol = np.where(known & (own >= 0), own, symbol)
                sums = [np.zeros(len(w.hash) + 1) for _ in range(3)]
                if known.any():
                    for s, v in zip(sums, (base_log[at], share_log[at], 1.0), strict=True):
                        np.cumsum(np.where(known, v, 0.0), out=s[1:])
                base, share, many = (s[w.first[1:]] - s[w.first[:-1]] for s in sums)
                sizes = np.diff(w.first) + 1
                flat = np.insert(symbol, w.first[1:], end).astype("<u2")
                stop = np.concatenate([[0], np.cumsum(sizes)])
                raw = flat.tobytes()
                packed = [raw[2 * s : 2 * e] for s, e in zip(stop[:-1].tolist(), stop[1:].tolist(), strict=True)]
                rows = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(lo, rows) for c in ("doc_id", "row_id", "row_no", "held_out")), pa.array(sizes), pa.array(np.rint(many).astype(np.int64) + end_known), pa.array(sizes - 1 - np.rint(many).astype(np.int64)), pa.array(base + end_log), pa.array(share), pa.array(packed, pa.binary())],
                    ["doc_id", "row_id", "row_no", "held_out", "n_tokens", "n_known", "n_rare", "base", "share", "symbols"],
                )

    return run


def _rare(hashes: np.ndarray):
    """(row_id, hash, class, count) of each text's words outside the lexicon."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(b.column("text")):
                w = wk.words(data, offsets, True)
                at = np.minimum(np.searchsorted(hashes, w.hash), max(0, len(hashes) - 1))
                rare = np.flatnonzero(hashes[at] != w.hash) if len(hashes) else np.arange(len(w.hash))
                row = (np.searchsorted(w.first, rare, side="right") - 1).astype(np.int32)
                kind = classes_of(w)[rare].astype(np.int32) if len(w.hash) else np.zeros(0, np.int32)
                ids = [b.column(c).slice(lo, hi - lo).take(pa.array(row)) for c in ("row_id", "row_no")]
                yield pa.RecordBatch.from_arrays([pa.array(wk.signed(w.hash[rare])), *ids, pa.array(kind)], ["h", "row_id", "row_no", "class"])

    return run


class Model(NamedTuple):
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # symbols x states


def initial(states: int, weights: np.ndarray, seed: int = 11) -> Model:
    """Sticky transitions; each state's emissions are the corpus' own, perturbed."""
    rng = np.random.default_rng(seed)
    emit = (weights / weights.sum())[:, None] * rng.gamma(1.0, 1.0, (len(weights), states)) + 1e-12
    return Model(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emit / emit.sum(0))


def batches_of(texts: list[np.ndarray], cells: int = 1 << 18) -> Iterator[list[int]]:
    """Texts of like length together, so that padding stays small."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    lo = 0
    while lo < len(order):
        hi = lo + max(1, cells // len(texts[order[lo]]))
        yield order[lo:hi]
        lo = hi


def padded(texts: list[np.ndarray], rows: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols by time and text (longest first), and how many texts are still running at each time."""
    size = np.array([len(texts[i]) for i in rows])
    out = np.zeros((size[0], len(rows)), np.int64)
    for c, i in enumerate(rows):
        out[: len(texts[i]), c] = texts[i]
    return out, np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")


def log10_likelihood(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Exact, by the scaled forward recursion; memory does not grow with the states' history."""
    out = np.zeros(len(texts))
    turn, emit = np.ascontiguousarray(m.move.T), np.ascontiguousarray(m.emit.T)
    for rows in batches_of(texts):
        sym, live = padded(texts, rows)
        scales = np.ones(sym.shape)
        state = np.repeat(m.start[:, None], len(rows), axis=1)
        for t in range(len(sym)):
            k = live[t]
            a = (state[:, :k] if not t else turn @ state[:, :k]) * emit[:, sym[t, :k]]
            c = np.add.reduce(a, 0, out=scales[t, :k])
            state = a / c
        out[rows] = np.log(scales).sum(0) / TEN
    return out


def expected(m: Model, texts: list[np.ndarray], segment: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch sums over texts: starts, transitions, emissions; and the log likelihood.

    Texts longer than `segment` are read forwards once, many side by side, keeping the state before each segment; then segments are taken
    from the last to the first, each with the backward values of the one behind it. So sums are exact at any length,
    and memory holds one segment of a batch."""
    n, states = m.emit.shape
    begin, move, emit, log = np.zeros(states), np.zeros((states, states)), np.zeros((n, states)), 0.0
    turn, emits = np.ascontiguousarray(m.move.T), np.ascontiguousarray(m.emit.T)
    before: dict[tuple[int, int], np.ndarray] = {}  # the state ahead of a text's segment
    long = sorted((i for i, t in enumerate(texts) if len(t) > segment), key=lambda i: -len(texts[i]))
    for lo in range(0, len(long), 64):  # side by side
        rows = long[lo : lo + 64]
        state = np.repeat(m.start[:, None], len(rows), axis=1)
        for s in range(0, len(texts[rows[0]]) - segment, segment):
            rows = [i for i in rows if len(texts[i]) > s + segment]
            state = state[:, : len(rows)]
            for t, x in enumerate(np.stack([texts[i][s : s + segment] for i in rows], axis=1), s):
                a = (state if not t else turn @ state) * emits[:, x]
                state = a / np.add.reduce(a, 0)
            before.update(((i, s + segment), state[:, c].copy()) for c, i in enumerate(rows))
    behind: dict[int, np.ndarray] = {}  # backward values that the segment behind hands on
    carried = [(t[s : s + segment], i, s) for i, t in enumerate(texts) for s in range(0, len(t), segment)]
    for wave in sorted({s for _, _, s in carried}, reverse=True):
        part = [(t, i) for t, i, s in carried if s == wave]
        for rows in batches_of([t for t, _ in part]):
            sym, live = padded([t for t, _ in part], rows)
            size, width = sym.shape
            alpha, weight = np.zeros((size, states, width)), np.zeros((size, states, width))
            ahead_of = np.array([before[part[r][1], wave] if wave else m.start for r in rows]).T
            first = turn @ ahead_of if wave else ahead_of
            for t in range(size):
                k = live[t]
                e = emits[:, sym[t, :k]]
                a = (first[:, :k] if not t else turn @ alpha[t - 1, :, :k]) * e
                c = 1.0 / np.add.reduce(a, 0)
                log -= float(np.log(c).sum())
                np.multiply(a, c, out=alpha[t, :, :k])
                np.multiply(e, c, out=weight[t, :, :k])
            beta = np.ones((states, width))
            for c, r in enumerate(rows):
                if (got := behind.pop(part[r][1], None)) is not None:
                    beta[:, c] = got
            for t in range(size - 1, -1, -1):
                k = live[t]
                ahead = weight[t, :, :k] * beta[:, :k]
                if t or wave:
                    move += (alpha[t - 1, :, :k] if t else ahead_of[:, :k]) @ ahead.T
                alpha[t, :, :k] *= beta[:, :k]
                if t or wave:
                    beta[:, :k] = m.move @ ahead
                else:
                    begin += alpha[t, :, :k].sum(1)
            if wave:
                for c, r in enumerate(rows):
                    behind[part[r][1]] = beta[:, c].copy()
            on = np.arange(width)[None, :] < live[:, None]
            flat = sym[on]
            for s in range(states):
                emit[:, s] += np.bincount(flat, alpha[:, s, :][on], n)
    return begin, move * m.move, emit, np.array([log])


def _texts(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2").astype(np.int64) for x in column]


def _groups(b: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most about `most` tokens."""
    sizes = np.cumsum(b.column("n_tokens").to_numpy())
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, side="right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def _round(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for g in _groups(b):
                got = np.concatenate([x.ravel() for x in expected(m, _texts(g.column("symbols")))])
                total = got if total is None else total + got
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "x"])

    return run


def _score(m: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in _groups(b):
                s = log10_likelihood(m, _texts(g.column("symbols")))
                names = [c for c in g.schema.names if c != "symbols"]
                yield pa.RecordBatch.from_arrays([*(g.column(c) for c in names), pa.array(s)], [*names, "chain"])

    return run


def train_model(encoded: DataFrame, weights: np.ndarray, states: int, rounds: int, keep: float, passes: int, gain: float, trace: list[float] | None = None) -> Model:
    """encoded(row_id, n_tokens, symbols) to a model."""
    n, model, trace = len(weights), initial(states, weights), [] if trace is None else trace
    parts: list[np.ndarray] = []  # each part's latest sums
    x = np.zeros(states + states * states + n * states)
    for turn in range(passes):
        log = 0.0
        for at in range(rounds):
            part = F.pmod(F.xxhash64("row_id"), F.lit(rounds)) == at
            sums = encoded.where(part).select("n_tokens", "symbols").mapInArrow(_round(model), "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).toPandas()  # the model's size
            new = np.zeros(len(x) + 1)
            new[sums["cell"].to_numpy(np.int64)] = sums["x"].to_numpy()
            log, new = log + new[-1], new[:-1]
            if not turn:
                x = x * keep + new
                parts.append(new)
            else:
                parts[at] = new
                x = np.sum(parts, axis=0)
            begin, move, emit = x[:states] + 1e-3, x[states : states + states * states].reshape(states, states) + 1e-3, x[states + states * states :].reshape(n, states)
            emit = emit + weights[:, None] / weights.sum() * 5.0  # the corpus as prior, so that no symbol is impossible
            model = Model(begin / begin.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        total = sum(float(p[states + states * states :].sum()) for p in parts)  # tokens
        trace.append(log / total if total else 0.0)
        if turn and trace[-1] - trace[-2] < gain:
            break
    return model


def scores(
    spark: SparkSession, docs: DataFrame, states: int = 8, own: int = 2000, table_words: int = 1 << 16, rounds: int = 4, keep: float = 0.5, passes: int = 2, gain: float = 0.01, trace: list[float] | None = None
) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    stage = Stage(spark, "hmm")
    docs = fields(docs, doc_id="long", text="string")
    docs = docs.withColumns({"row_id": F.xxhash64("doc_id", "text"), "row_no": F.hash("text", "doc_id")}).withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0)
    train = docs.where("not held_out")
    counts = stage.write(train.select("text").mapInArrow(_counts, "h long, class int, n long").groupBy("h").agg(F.sum("n").alias("c"), F.min("class").alias("class")), "counts")
    ends = train.count()
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    total, kinds = words + ends, kinds + (ends > 0)
    norm = float(np.log10(total + 0.1 * (kinds + 1)))
    # the most frequent words: whole classes of like counts, as many as fit; a few hundred rows tell which
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    sizes = sorted(((r["level"], r["many"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("many")).collect()), reverse=True)
    fit = [lv for (lv, _), so_far in zip(sizes, np.cumsum([m for _, m in sizes]), strict=True) if so_far <= table_words]
    top = counts.where(level >= (fit[-1] if fit else 1 << 30)).toPandas().sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    order = np.argsort(top["h"].to_numpy().view(np.uint64))
    c = top["c"].to_numpy(np.float64)
    symbol = np.full(len(top), -1)
    symbol[: min(own, len(top))] = CLASSES + 1 + np.arange(min(own, len(top)))
    lexicon = Lexicon(top["h"].to_numpy().view(np.uint64)[order], c[order], symbol[order])
    # words that are symbols of their own leave their class
    own_rows = spark.createDataFrame(top.iloc[: min(own, len(top))][["h"]].astype("int64"), "h long") if len(top) else spark.createDataFrame([], "h long")
    by_class = counts.join(F.broadcast(own_rows), "h", "left_anti").groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).toPandas()  # a row a class
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    n_class[by_class["class"]], v_class[by_class["class"]] = by_class["n"], by_class["v"]
    class_norm = np.log10(n_class + 0.1 * (v_class + 1))
    is_own = lexicon.symbols >= 0
    share = np.where(is_own, 0.0, np.log10(lexicon.counts + 0.1) - class_norm[top["class"].to_numpy()[order]]) if len(top) else np.zeros(0)
    base = np.log10(lexicon.counts + 0.1) - norm
    end_log = float(np.log10(ends + 0.1)) - norm
    encoded = stage.write(docs.mapInArrow(_encode(lexicon, base, share, CLASSES, end_log, int(ends > 0)), "doc_id long, row_id long, row_no int, held_out boolean, n_tokens long, n_known long, n_rare long, base double, share double, symbols binary"), "symbols")
    stage.release()
    weights = np.concatenate([n_class + 1.0, [ends + 1.0], c[: min(own, len(top))]])
    model = train_model(encoded.where("not held_out"), weights, states, rounds, keep, passes if ends else 0, gain, trace)
    chain = encoded.mapInArrow(_score(model), "doc_id long, row_id long, row_no int, held_out boolean, n_tokens long, n_known long, n_rare long, base double, share double, chain double")
    levels = F.element_at(F.array(*map(F.lit, class_norm.tolist())), F.col("class") + 1)
    rare = docs.select("row_id", "row_no", "text").mapInArrow(_rare(lexicon.hashes), "h long, row_id long, row_no int, class int").join(counts.select("h", "c"), "h", "left")
    lg = F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.1))
    seen = rare.groupBy("row_id", "row_no").agg(F.sum(lg - F.lit(norm)).alias("base2"), F.sum(lg - levels).alias("share2"), F.count("c").alias("known2"), F.count("*").alias("many"))
    copies = chain.join(stage.write(seen, "rare"), ["row_id", "row_no"], "left")
    # rows that repeat share a key, and each has the sums of one
    once = lambda x: F.coalesce(F.col(x) * F.col("n_rare") / F.col("many"), F.lit(0.0))
    return copies.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.round(once("known2")).cast("long")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + once("base2")).alias("base_score"), (F.col("chain") + F.col("share") + once("share2")).alias("score"),
    )


def op10_hmm_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, table(spark, sf_dir, "documents"))
