import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import near_dedup, substring_dedup
from ledgerloom.llm import wordkernel as wk
from ledgerloom.llm.common import Stage
from ledgerloom.llm.near_dedup import near_duplicates, shingle_sets
from ledgerloom.llm.substring_dedup import cleaned, cover_for, remove_repeats

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é\t\n\x0b日 ", max_size=30), max_size=8))
def test_words_are_those_of_the_rule(texts):
    got = []
    for _, _, data, offsets in wk.chunks(pa.array(texts, pa.string()), 16):
        w = wk.words(data, offsets, False)
        raw = data.tobytes()
        for r in range(len(offsets) - 1):
            got.append([raw[w.starts[i] : w.ends[i]].decode() for i in range(w.first[r], w.first[r + 1])])
    assert got == [SPACE.findall(t) for t in texts]


def test_equal_runs_hash_alike_anywhere():
    texts = pa.array(["x y a b c", "a b c", "A b c q"])
    (_, _, data, offsets), *_ = list(wk.chunks(texts))
    w = wk.words(data, offsets, True)
    at, h = wk.runs(w, 3)
    start = {int(a): int(x) for a, x in zip(at, h, strict=True)}
    assert start[2] == start[5] == start[8] and len(set(start.values())) == len(start) - 2


def test_covers_align_every_pair():
    v, cover = cover_for(35)
    assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def brute_repeats(texts, n):
    words = [SPACE.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_substrings_against_brute_force(spark, odd):
    rng = np.random.default_rng(3)
    passages = [[f"p{k}_{i}" for i in range(int(rng.integers(30, 80)))] for k in range(6)]
    texts = []
    for _ in range(60):
        parts = [f"u{x}" for x in rng.integers(0, 10**6, int(rng.integers(0, 60)))]
        for k in rng.integers(0, 6, int(rng.integers(0, 3))):
            s = int(rng.integers(0, 10))
            parts += passages[k][s:] + [f"v{x}" for x in rng.integers(0, 10**6, 5)]
        texts.append(" ".join(parts))
    rows = [(100 + i, t) for i, t in enumerate(texts)] + [(r["doc_id"], r["text"]) for r in odd.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(spark, df).collect())
    assert got == Counter((i, *x) for (i, _), x in zip(rows, brute_repeats([t for _, t in rows], 35), strict=True))


def test_windows_that_do_not_repeat_are_never_stored(spark, monkeypatch):
    """Phrases of 25 words in many texts: nearly every window is a candidate, few repeat, in many units and
    buckets. No table holds a row a window."""
    monkeypatch.setattr(substring_dedup, "UNIT_BYTES", 1 << 16)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 1 << 17)
    rng = np.random.default_rng(11)
    phrases = [[f"{'lengthy' * 3}{k}_{i}" for i in range(25)] for k in range(40)]
    texts = [" ".join(x for k in rng.integers(0, 40, 20) for x in [*phrases[k], f"u{rng.integers(0, 10**9)}"]) for _ in range(300)]
    texts += [f"{texts[0]} a", " ".join(f"q{i}" for i in range(60))]
    sizes, write = {}, Stage.write
    monkeypatch.setattr(Stage, "write", lambda self, df, name: sizes.setdefault(name, write(self, df, name)))
    counts, drop = {}, Stage.drop

    def counted(self, *tables):
        counts.update((n, t.count()) for n, t in sizes.items() if any(t is x for x in tables))
        drop(self, *tables)

    monkeypatch.setattr(Stage, "drop", counted)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in remove_repeats(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 35)))
    assert 0 < sum(x[1] for x in got.values()) < sum(x[0] for x in got.values()) / 20
    assert {"anchors", "places", "answers"} <= set(counts) and max(counts.values()) < sum(x[0] for x in got.values()) / 10


def test_cleaned_keeps_columns(spark, odd, none):
    out = cleaned(spark, odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert remove_repeats(spark, none).count() == 0


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, i = [], 0
    for size in (1, 1, 2, 3, 40, 25):
        base = [f"b{x}" for x in rng.integers(0, 10**6, 200)]
        for _ in range(size):
            w = list(base)
            for k in rng.integers(0, len(w), int(rng.integers(0, 5))):
                w[k] = f"e{rng.integers(0, 10**6)}"
            rows.append((i, " ".join(w)))
            i += 1
    shared = " ".join(f"s{k}" for k in range(60))  # a passage that different texts share
    rows += [(i + k, shared + " " + " ".join(f"z{x}" for x in rng.integers(0, 10**6, 40))) for k in range(40)]
    rows += [(500, None), (501, ""), (502, "a b"), (503, "A  b"), (504, "a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_components(rows)
    for how in ({}, {"leaf": 4}, {"leaf": 2, "levels": 1, "task_sets": 8}):  # small nodes; nodes that must branch; clusters beyond a task
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark, df, percent=85, agree=38, **how).collect()}
        assert got == want


def test_hot_nodes_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 8)
    rng = np.random.default_rng(8)
    rows = []
    for size in (70, 30, 3):
        base = [f"h{x}" for x in rng.integers(0, 10**6, 120)]
        for _ in range(size):
            w = list(base)
            for k in rng.integers(0, len(w), int(rng.integers(0, 4))):
                w[k] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({"leaf": 8}, {"leaf": 2, "levels": 2, "task_hashes": 1000}):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(spark, df, percent=85, agree=38, **how).collect()}
        assert got == brute_components(rows)


def test_one_id_with_two_texts_links_both(spark):
    a, b = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (7, " ".join([*a, "x"])), (8, " ".join([*b, "y"])), (None, " ".join([*a, "z"]))]
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got) == [(0, 5), (5, 5), (5, 5), (7, 5), (8, 5)]


def test_near_duplicates_edge_cases(spark, odd, none):
    rows = near_duplicates(spark, odd).collect()
    assert len(rows) == odd.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[6]["component_id"] == 5 and not by[6]["kept"] and by[1]["component_id"] == 1 and by[1]["kept"]
    assert near_duplicates(spark, none).count() == 0


def test_sets_of_short_texts():
    (_, _, data, offsets), *_ = list(wk.chunks(pa.array(["a b", "", "a b c d e f", "x x x x x x x"])))
    h, first = shingle_sets(wk.words(data, offsets, True), 5)
    assert list(np.diff(first)) == [1, 0, 2, 1] and len(h) == 4


def test_recall_of_the_defaults(spark):
    rng = np.random.default_rng(17)
    rows, near = [], 0
    for i in range(150):  # pairs from about 0.75 to 0.95
        a = [f"p{x}" for x in rng.integers(0, 10**6, 300)]
        b = list(a)
        for k in rng.choice(300, int(rng.integers(2, 9)), replace=False):
            b[k] = "edit"
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        x, y = ({tuple(w[k : k + 5]) for k in range(296)} for w in (a, b))
        near += 100 * len(x & y) >= 80 * len(x | y)
    got = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).where("not kept").count()
    assert near > 80 and got == near
