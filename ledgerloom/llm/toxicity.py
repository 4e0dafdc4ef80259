"""Operator 7: toxicity of texts, read through noise.

A noisy channel turns words into what is written: letters into look-alikes (1d10t), letters doubled (idiooot), letters
apart (i d i o t, i.d.i.o.t). A token that the channel may have touched becomes a lattice of what each of its
characters can stand for; Viterbi decoding under a character trigram model finds the likeliest reading. A token of
letters alone, none of them twice in a row, has one reading and is taken as it stands; one whose letters stand twice at
most is decoded pair by pair, which is exact too. Look-alikes at a token's end may
be letters or punctuation, and a doubled letter may be meant: such tokens have several readings, which count as one
word, by the best of them. Features of the restored text are its words and their first four and five bytes.

Trained here: the character model from all documents (counts summed in each task, then over the corpus); label weights
from at most `max_train_rows` labelled rows whose crc32(doc_id as text) mod 5 is not 0, taken in hash order, equal
texts of one label counted once. A feature gets its log odds if its G2 statistic passes a bar. The bar, one of BARS,
and the threshold are those with the fewest errors when every training row is judged by counts that it is taken out of:
features that only a few texts speak for, as words of copies do, then err on other texts. A text's score is the
logistic of its distinct words' weights over the threshold. lang, source, labels and ids are no inputs of a score.

Nulls and empty texts: score of no evidence. No usable labels: every score is 0.0. A label given twice counts as toxic
if one of them says so. Repeated rows are scored row by row; a null doc_id is held out if the crc32 of the empty text
says so; other columns are ignored. Empty table: empty result. Long texts and long tokens are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordkernel as wk
from .common import Stage, fields, shuffle_partitions, table

SYMBOLS = 60
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "(": "c"}
APART = ".-_*~'`,"
SUBSTITUTED, DROPPED, REPEATED, BROKEN = 1.0, 4.5, 0.7, 3.0  # costs of the channel, in nats
ENDING = "!$|+()@"  # look-alikes that also end words
ENDS = 16  # runs of look-alikes at a token's end, each of which may be letters or punctuation
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[128:] = True
_NOISE = np.zeros(256, bool)
_NOISE[[ord(c) for c in [*LOOKS, *APART]]] = True
_LOOK = np.zeros(256, bool)
_LOOK[[ord(c) for c in LOOKS]] = True
_SYMBOL = np.zeros(256, np.int64)  # 0: everything that is no letter
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27 + np.arange(128) % 32
KINDS = (0, 4, 5)  # the whole word, its first four and five bytes
_SALT = wk.mix(np.arange(1, 4, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null("") if column.null_count else column)


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    for b in batches:
        for _, _, data, _ in wk.chunks(_lower(b.column("text"))):
            s = _SYMBOL[data]
            if len(s) > 2:
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])


def character_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b), by absolute counts interpolated with bigrams and single symbols."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    one = three.sum((0, 1)) + 0.5
    two = three.sum(0) + 8 * one / one.sum()
    two /= two.sum(1, keepdims=True)
    three = three + 8 * two[None]
    return -np.log(three / three.sum(2, keepdims=True))


def restore(token: str, model: np.ndarray) -> str:
    """The likeliest reading of one token (lower case); spaces part words."""
    return _viterbi(token, model, [len(token)])[0].strip()


_nested: tuple[np.ndarray | None, list] = (None, [])


def _as_lists(model: np.ndarray) -> list:
    """The model as nested lists, which are read faster one by one."""
    global _nested
    if _nested[0] is not model:
        _nested = (model, model.tolist())
    return _nested[1]


def _viterbi(token: str, model: np.ndarray, cuts: list[int]) -> list[str]:
    """The likeliest readings of the token's first characters, for each number in cuts. Exact: every pair of symbols
    that readings so far may end in is kept, with the cheapest way there."""
    paths: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    last, out, ends, costs = "", [], set(cuts), _as_lists(model)
    for i, c in enumerate(token, 1):
        readings: list[tuple[str, float]] = []
        if c.isalpha():
            readings.append((c, 0.0))
            if c == last:
                readings.append(("", REPEATED))
        elif c in LOOKS:
            readings += [(x, SUBSTITUTED) for x in LOOKS[c]] + [("", DROPPED), (" ", BROKEN)]
        else:
            readings += [("", REPEATED if c in APART or c == " " else DROPPED), (" ", BROKEN)]
        last = c
        symbols = {x: _SYMBOL[list(x.encode())].tolist() if x else [] for x, _ in readings}
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (p, q), (cost, way) in paths.items():
            for x, price in readings:
                total, a, b = cost + price, p, q
                for s in symbols[x]:
                    total += costs[a][b][s]
                    a, b = b, s
                if (a, b) not in after or total < after[a, b][0]:
                    after[a, b] = (total, (way, x) if x else way)
        paths = after
        if i in ends:
            way = min((cost + costs[p][q][0], p, q) for (p, q), (cost, _) in paths.items())
            step, text = paths[way[1], way[2]][1], []
            while step is not None:
                step, x = step
                text.append(x)
            out.append("".join(reversed(text)))
    return out


def readings(token: str, model: np.ndarray) -> tuple[str, ...]:
    """What a token may stand for, once without the look-alikes at its end and once with each run of them (with all, if
    they are over ENDS runs); and its letters as they are, if it has no others."""
    whole = token.rstrip(APART)
    stem = whole.rstrip(ENDING + APART)
    end = whole[len(stem) :]
    runs = [len(stem) + i for i in range(1, len(end)) if end[i] != end[i - 1]]
    cuts = sorted({n for n in [len(stem), *(runs if len(runs) <= ENDS else []), len(whole)] if n})
    found = [x.strip() for x in _viterbi(whole, model, cuts)]
    return tuple(dict.fromkeys([*found, stem] if stem.isalpha() else found))


_tokens: dict[bytes, tuple[bytes, ...]] = {}


def _readings(token: bytes, model: np.ndarray) -> tuple[bytes, ...]:
    if (got := _tokens.get(token)) is None:
        got = tuple(x.encode() + b" " for x in readings(token.decode("utf-8", "replace"), model))
        if len(_tokens) > 50_000:
            _tokens.clear()
        if len(token) <= 64:
            _tokens[token] = got
    return got


def suspects(w: wk.Words) -> list[tuple[int, int]]:
    """Byte spans of tokens, or of runs of single letters, that need a lattice: look-alikes, marks before letters,
    letters three times in a row, letters of more bytes twice."""
    d, n = w.data, len(w.data)
    if not len(w.starts):
        return []
    letter, noise = _LETTER[d], _NOISE[d]
    mark = np.zeros(n + 1, bool)
    mark[: n - 1] |= noise[:-1] & letter[1:]  # a mark before a letter
    mark[:n] |= _LOOK[d]
    mark[2:n] |= letter[2:] & (d[2:] == d[1:-1]) & (d[2:] == d[:-2]) & (d[2:] < 128)
    for wide, lead in ((2, 0xC2), (3, 0xE0)):  # letters of more bytes twice
        if n >= 2 * wide:
            same = d[wide:] == d[:-wide]
            twice = (d[: n - 2 * wide + 1] >= lead) & (d[: n - 2 * wide + 1] < (0xE0, 0xF0)[wide - 2])
            for i in range(wide):
                twice &= same[i : n - 2 * wide + 1 + i]
            mark[: n - 2 * wide + 1] |= twice
    count = np.zeros(n + 2, np.int64)
    np.cumsum(mark, out=count[1:])
    signs = np.zeros(n + 1, np.int64)
    np.cumsum(letter | _LOOK[d], out=signs[1:])
    odd = (count[w.ends] > count[w.starts]) & (signs[w.ends] - signs[w.starts] > 1)
    out = list(zip(w.starts[odd].tolist(), w.ends[odd].tolist(), strict=True))
    single = np.flatnonzero((w.ends - w.starts == 1) & (letter[w.starts] | noise[w.starts]))
    if len(single) > 1:
        row = np.searchsorted(w.first, single, side="right")
        cut = np.flatnonzero((np.diff(single) != 1) | (np.diff(row) != 0)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(single)]]) - 1
        many = last > first
        out += zip(w.starts[single[first[many]]].tolist(), w.ends[single[last[many]]].tolist(), strict=True)
    return out


def _runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters."""
    letter = np.zeros(len(data) + 2, bool)
    letter[1:-1] = _LETTER[data]
    edge = np.flatnonzero(letter[1:] != letter[:-1])
    return edge[::2], edge[1::2]


def doubled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The second letters of pairs in runs of letters that the likeliest reading drops. A pair's two readings leave the
    same two symbols behind after the next letter, so pairs are decided one by one, all at once; longer repetitions
    are none of theirs."""
    n = len(data)
    if n < 2:
        return np.zeros(0, np.int64)
    same = np.zeros(n + 1, bool)
    same[1:n] = (data[1:] == data[:-1]) & _LETTER[data[1:]] & (data[1:] < 128)
    at = np.flatnonzero(same[:n] & ~same[1:])
    at = at[~same[at - 1]]
    if not len(at):
        return at
    run = np.searchsorted(starts, at, side="right") - 1
    sym = _SYMBOL[data]
    c = sym[at]
    q = np.where(at - 1 > starts[run], sym[np.maximum(at - 2, 0)], 0)
    r = np.where(at + 1 < ends[run], sym[np.minimum(at + 1, n - 1)], 0)
    return at[model[q, c, c] + model[c, c, r] > model[q, c, r] + REPEATED]


def features(data: np.ndarray, offsets: np.ndarray, model: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hashes by kind, word) of every word of the restored texts; hash 0 where a word is too short for the kind.
    word is the word's own hash; in further readings of a token it is that of the token's first word."""
    w = wk.words(data, offsets, False)
    spans = suspects(w) if model is not None else []
    extra: list[bytes] = []
    span: list[int] = []
    first: list[bool] = []
    if spans:
        raw = data.tobytes()
        data = data.copy()
        rows = np.searchsorted(offsets, [s for s, _ in spans], side="right") - 1
        for i, (s, e) in enumerate(spans):
            data[s:e] = 32
            for k, x in enumerate(_readings(raw[s:e], model)):
                extra.append(x)
                span.append(i)
                first.append(not k)
    starts, ends = _runs(data)
    row, h = np.searchsorted(offsets, starts, side="right") - 1, _hashes(data, starts, ends)
    out = [(row, h, h[0].copy())]
    if model is not None and len(gone := doubled(data, starts, ends, model)):
        run = np.unique(np.searchsorted(starts, gone, side="right") - 1)
        keep = np.ones(len(data), bool)
        keep[gone] = False
        less = np.zeros(len(data) + 1, np.int64)
        np.cumsum(keep, out=less[1:])
        short = _hashes(data[keep], less[starts[run]], less[ends[run]])
        name = np.where(short[0] > 0, short[0], h[0, run])  # both readings count as one word
        out[0][2][run] = name
        out.append((row[run], short, name))
    if spans:
        tail = np.concatenate([[0], np.cumsum([len(x) for x in extra])])
        joined = np.frombuffer(b"".join(extra), np.uint8)
        s, e = _runs(joined)
        at, more = np.searchsorted(tail, s, side="right") - 1, _hashes(joined, s, e)
        own, main = np.asarray(span, np.int64)[at], np.asarray(first, bool)[at]
        long = np.flatnonzero(more[0])
        token, place = np.unique(own[long], return_index=True)  # each token's first word
        head = np.zeros(len(spans), np.uint64)
        head[token] = more[0][long[place]]
        out.append((rows[own], more, np.where(main, more[0], head[own])))
    if len(out) == 1:
        return out[0]
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out], axis=1), np.concatenate([x[2] for x in out])


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """By kind, the hashes of runs."""
    n = len(data)
    p, inv = wk.powers(wk._BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(wk._BYTE[data] * p[:n], out=sums[1:])
    out = np.zeros((len(KINDS), len(starts)), np.uint64)
    for i, k in enumerate(KINDS):
        stop = ends if not k else np.minimum(starts + k, ends)
        h = wk.mix((sums[stop] - sums[starts]) * inv[starts] + _SALT[i])
        out[i] = np.where(ends - starts > (k or 2), h, 0)
    return out


class Weights(NamedTuple):
    hashes: np.ndarray  # ascending
    values: np.ndarray
    threshold: float


def evidence(row: np.ndarray, h: np.ndarray, word: np.ndarray, rows: int, weights: Weights) -> np.ndarray:
    """Sum of each row's distinct words' weights, a word having its best kind's and reading's."""
    out = np.zeros(rows)
    if not len(weights.hashes) or not len(row):
        return out
    sieve = np.zeros(1 << 16, bool)
    sieve[weights.hashes & np.uint64(0xFFFF)] = True
    near = np.flatnonzero(sieve[h & np.uint64(0xFFFF)].any(0))
    if not len(near):
        return out
    best = np.zeros(len(near))
    for i in range(len(KINDS)):
        x = h[i, near]
        at = np.minimum(np.searchsorted(weights.hashes, x), len(weights.hashes) - 1)
        best = np.maximum(best, np.where(weights.hashes[at] == x, weights.values[at], 0.0))
    word, own = np.where(word[near] > 0, word[near], 1), row[near]
    order = np.lexsort((-best, word, own))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (own[order][1:] != own[order][:-1]) | (word[order][1:] != word[order][:-1])
    np.add.at(out, own[order[fresh]], best[order[fresh]])
    return out


def _label_counts(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(_lower(b.column("text"))):
                row, h, _ = features(data, offsets, model)
                toxic = b.column("toxic").slice(lo, hi - lo).to_numpy().astype(np.int64)
                pair = np.unique(np.stack([np.tile(row, len(KINDS)).astype(np.uint64), h.ravel()])[:, h.ravel() > 0], axis=1)
                feature, at = np.unique(pair[1], return_inverse=True)
                t = np.bincount(at, toxic[pair[0].astype(np.int64)], len(feature)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(wk.signed(feature)), pa.array(t), pa.array(np.bincount(at, minlength=len(feature)).astype(np.int64) - t)], ["f", "t", "c"])

    return run


def _evidence(model: np.ndarray, weights: Weights, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(_lower(b.column("text"))):
                x = evidence(*features(data, offsets, model), hi - lo, weights)
                yield pa.RecordBatch.from_arrays([b.column(column).slice(lo, hi - lo), pa.array(x)], [column, "x"])

    return run


def _restore_texts(model: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(_lower(b.column("text"))):
                raw, rest = data.tobytes(), data.copy()
                changes = []
                done = 0
                for s, e in sorted(suspects(wk.words(data, offsets, False))):
                    if s >= done:
                        changes.append((s, e, restore(raw[s:e].decode("utf-8", "replace"), model).encode()))
                        rest[s:e] = 32
                        done = e
                changes += [(i, i + 1, b"") for i in doubled(rest, *_runs(rest), model).tolist()]
                changes.sort()
                out, k = [], 0
                for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    parts, at = [], s
                    while k < len(changes) and changes[k][0] < e:
                        parts += [raw[at : changes[k][0]], changes[k][2]]
                        at = changes[k][1]
                        k += 1
                    out.append((b"".join(parts) + raw[at:e]).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(out, pa.string())], ["doc_id", "text"])

    return run


def fit_character_model(docs: DataFrame) -> np.ndarray:
    """Of all texts; what reaches the driver has the model's size."""
    got = docs.select("text").mapInArrow(_trigrams, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[got["cell"].to_numpy()] = got["n"].to_numpy()
    return character_model(counts)


def restored(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """docs(doc_id, text) with texts in lower case as decoded."""
    return fields(docs, doc_id="long", text="string").mapInArrow(_restore_texts(model), "doc_id long, text string")


def _first(df: DataFrame, order, most: int) -> int:
    """The value of order (a long from 0 to 2**60) below which df has at most `most` rows, and nearly as many if it has
    more. Found twelve bits at a time: at most 4096 counts are gathered at once."""
    prefix, taken = 0, 0
    for shift in (48, 36, 24, 12, 0):
        inside = F.shiftright(order, shift + 12) == prefix if shift < 48 else F.lit(True)
        slot = F.shiftright(order, shift).bitwiseAND(F.lit(4095).cast("long"))
        sizes = sorted((r["slot"], r["n"]) for r in df.where(inside).groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).collect())
        for at, n in sizes:
            if taken + n > most:
                break
            taken += n
        else:
            return 1 << 60 if shift == 48 else (prefix + 1) << (shift + 12)
        prefix = prefix << 12 | at
        if taken >= 0.9 * most:
            return prefix << shift
    return prefix


def training_rows(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """toxic and text of the labelled rows, equal texts of one label once."""
    return docs.join(F.broadcast(sample), "doc_id").select("toxic", "text").distinct()


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, max_train_rows: int = 40_000, max_features: int = 20_000) -> tuple[np.ndarray, Weights]:
    stage = Stage(spark, "toxicity")
    docs = fields(docs, doc_id="long", text="string")
    model = fit_character_model(docs)
    mine = fields(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    order = F.shiftrightunsigned(F.xxhash64("doc_id"), 4)
    sample = mine.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    sample = sample.where(order < _first(sample, order, max_train_rows))
    # at most max_train_rows ids and labels are handed to the tasks
    train = stage.write(training_rows(docs, sample).repartition(shuffle_partitions(spark)), "train")  # few rows, much work
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    nothing = Weights(np.zeros(0, np.uint64), np.zeros(0), math.inf)
    if not toxic or not clean:
        return model, nothing
    counted = stage.write(train.mapInArrow(_label_counts(model), "f long, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c")), "counts")
    n, T, C, t, c = float(toxic + clean), float(toxic), float(clean), F.col("t"), F.col("c")
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    both = t + c
    g2 = 2 * (term(t, both * T / n) + term(c, both * C / n) + term(T - t, (n - both) * T / n) + term(C - c, (n - both) * C / n))
    odds = F.log((t + 0.5) / (T + 1)) - F.log((c + 0.5) / (C + 1))
    found = counted.select("f", "t", "c", g2.alias("g2")).where((odds > ODDS) & (F.col("g2") > LEAST_G2))
    # strong ones first, in classes of like strength, by hash in a class
    rank = (F.lit(4095) - F.least(F.floor(F.log2("g2") * 64), F.lit(4095))).cast("long") * F.lit(1 << 48) + F.shiftrightunsigned(F.xxhash64("f"), 16)
    kept = found.where(rank < _first(found, rank, max_features)).toPandas()
    h = kept["f"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    h, t_of, c_of = h[order], kept["t"].to_numpy(float)[order], kept["c"].to_numpy(float)[order]
    if not len(h):
        return model, nothing
    bars = np.geomspace(LEAST_G2, max(float(kept["g2"].max()) * 0.99, LEAST_G2 + 1), BARS)
    # a row is judged by counts that it is taken out of
    tables = [[_values(t_of - y, c_of - 1 + y, T - y, C - 1 + y, bar) for bar in bars] for y in (0, 1)]
    bins = train.mapInArrow(_left_out(model, h, tables), "bar int, toxic int, x int, n long").groupBy("bar", "toxic", "x").agg(F.sum("n").alias("n")).toPandas()
    best: tuple[float, int, float] | None = None
    for bar in range(BARS):
        own = bins[bins["bar"] == bar]
        errors, threshold = _threshold(own["x"].to_numpy(float) / 4, own["toxic"].to_numpy(int), own["n"].to_numpy(float))
        if best is None or (errors, -bar) < best[:2]:
            best = (errors, -bar, threshold)
    values = _values(t_of, c_of, T, C, bars[-best[1]])
    some = values > 0
    return model, Weights(h[some], values[some], best[2])


ODDS, LEAST_G2, BARS = 1.5, 14.0, 16


def _values(t: np.ndarray, c: np.ndarray, toxic: float, clean: float, bar: float) -> np.ndarray:
    """Log odds of features whose G2 statistic passes the bar, 6 at most; 0 for others."""
    t, c, n = np.maximum(t, 0.0), np.maximum(c, 0.0), toxic + clean
    both = t + c
    g2 = np.zeros(len(t))
    with np.errstate(divide="ignore", invalid="ignore"):
        for x, e in ((t, both * toxic / n), (c, both * clean / n), (toxic - t, (n - both) * toxic / n), (clean - c, (n - both) * clean / n)):
            g2 += np.where(x > 0, 2 * x * np.log(x / e), 0.0)
    odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
    return np.where((odds > ODDS) & (g2 > bar), np.minimum(odds, 6.0), 0.0)


def _left_out(model: np.ndarray, hashes: np.ndarray, tables: list[list[np.ndarray]]):
    """Counts of rows by bar, label and evidence (in quarters), by the tables of the row's own label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], int] = {}
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(_lower(b.column("text"))):
                found = features(data, offsets, model)
                toxic = b.column("toxic").slice(lo, hi - lo).to_numpy()
                for y in (0, 1):
                    for bar, values in enumerate(tables[y]):
                        x = evidence(*found, hi - lo, Weights(hashes, values, 0.0))[toxic == y]
                        for q, n in zip(*np.unique(np.rint(np.minimum(x, 60.0) * 4).astype(int), return_counts=True), strict=True):
                            total[bar, y, int(q)] = total.get((bar, y, int(q)), 0) + int(n)
        keys = list(total)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array([total[k] for k in keys], pa.int64())], ["bar", "toxic", "x", "n"])

    return run


def _threshold(x: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """The fewest errors, and the middle of the first gap that has them."""
    cuts = np.unique(x)
    middles = np.concatenate([(cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 0.5]])
    errors = [float(n[(x > m) & (toxic == 0)].sum() + n[(x <= m) & (toxic == 1)].sum()) for m in middles]
    at = int(np.argmin(errors))
    return errors[at], float(middles[at])


def scores(docs: DataFrame, model: np.ndarray, weights: Weights) -> DataFrame:
    """docs(doc_id, text) to doc_id, held_out, score, predicted."""
    found = fields(docs, doc_id="long", text="string").mapInArrow(_evidence(model, weights, "doc_id"), "doc_id long, x double")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    score = 1 / (1 + F.exp(F.lit(weights.threshold) - F.col("x"))) if math.isfinite(weights.threshold) else F.lit(0.0)
    return found.select("doc_id", held.alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _clean_rows(model: np.ndarray, weights: Weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in wk.chunks(_lower(b.column("text").cast(pa.string()))):
                yield b.slice(lo, hi - lo).filter(pa.array(evidence(*features(data, offsets, model), hi - lo, weights) < weights.threshold))

    return run


def without_toxic(docs: DataFrame, model: np.ndarray, weights: Weights) -> DataFrame:
    """docs, with all their columns, less the rows whose predicted label is 1."""
    return docs.mapInArrow(_clean_rows(model, weights), docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scores(docs, *fit(spark, docs, table(spark, sf_dir, "labels")))
