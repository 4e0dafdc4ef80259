import hashlib
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from ledgerloom.llm import bpe


def words(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


def changed(base, *at):
    return [f"x{i}" if i in at else w for i, w in enumerate(base)]


def test_near_copies_from_four_fifths_on_go(spark):
    base = words("b", 104)  # 100 shingles; a change inside takes five of them away
    rows = [(1, base), (2, changed(base, 50, 70)), (3, words("c", 104)), (4, changed(words("c", 104), 20, 40, 60))]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 3, 4]  # 90 of 110; 85 of 115


def test_rows_without_an_id_are_rows_of_their_own(spark, tmp_path):
    copy, other, near, leak = words("b", 104), words("c", 104), changed(words("c", 104), 50), words("i", 30)
    rows = [(1, copy), (None, copy), (None, copy), (None, other), (None, other), (None, near), (None, words("d", 40)), (None, [*words("e", 9), *leak]), (None, []), (7, words("f", 40)), (7, words("g", 40)), (7, leak)]
    docs = spark.createDataFrame([(i, " ".join(w), "x") for i, w in rows], "doc_id long, text string, row_key string")
    once = corpus_pipeline.near_duplicates(spark, docs, "")
    assert once.columns == docs.columns
    left = [(r["doc_id"], r["text"].split()) for r in once.collect()]
    kept = [(1, copy), (None, words("d", 40)), (None, [*words("e", 9), *leak]), (None, []), (7, words("f", 40)), (7, words("g", 40)), (7, leak)]
    assert len(left) == len(kept) + 1 and all(x in left for x in kept)
    assert ((None, other) in left) != ((None, near) in left)
    spark.createDataFrame([(1, " ".join(leak))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = corpus_pipeline.decontamination(spark, once, str(tmp_path))
    assert clean.columns == docs.columns
    gone = [(None, [*words("e", 9), *leak]), (7, leak)]
    assert sorted(map(str, ((r["doc_id"], r["text"].split()) for r in clean.collect()))) == sorted(map(str, (x for x in left if x not in gone)))


SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def plain_near(rows):
    """Rows that stay: of each group linked at four fifths, the one of the least id."""
    sets = []
    for _, t in rows:
        w = SPACE.findall(t.lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for g in sorted(set(group)):
        own = [rows[i] for i in range(len(rows)) if group[i] == g]
        out.append(min(own, key=lambda r: (r[0] is None, r[0] or 0)))
    return out


def plain_substrings(rows, n=35):
    words = [SPACE.findall(t) for _, t in rows]
    seen = Counter(tuple(w[i : i + n]) for w in words for i in range(len(w) - n + 1))
    out = []
    for (i, t), w in zip(rows, words, strict=True):
        gone = {j for s in range(len(w) - n + 1) if seen[tuple(w[s : s + n])] > 1 for j in range(s, s + n)}
        out.append((i, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    return out


def plain_clean(rows, items):
    def shingles(t, k=5):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    return [r for r in rows if not any(len(shingles(r[1]) & shingles(x)) >= 0.8 * len(shingles(x)) for x in items)]


def test_the_whole_run_against_plain_stages(spark, tmp_path):
    rng = np.random.default_rng(21)
    say = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    rows, labels = [], []
    for i in range(80):
        w = say(60)
        if i % 4 == 0:
            w[5:5] = ["idiot", "moron"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    base, passage, item = say(150), say(50), say(40)
    for _ in range(6):  # near copies and copies
        w = list(base)
        w[int(rng.integers(0, 150))] = "edit"
        rows.append((len(rows), " ".join(w)))
    rows += [(200, " ".join(say(40))), (201, " ".join([*say(30), *passage, *say(9)])), (202, " ".join([*say(9), *passage])), (203, " ".join([*say(30), *item, *say(30)])), (None, " ".join(say(30))), (None, ""), (204, "")]
    rows += [rows[-7], (300, rows[-7][1]), (205, "an i d i o t and a m0r0n " + " ".join(say(50)))]
    spark.createDataFrame([(i, t, "x", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    bad = lambda t: "idiot" in t or "m0r0n" in t
    left = plain_clean(plain_substrings(plain_near([r for r in rows if not bad(r[1])])), [" ".join(item)])
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_vocabulary())
    want = Counter((i, len(library.encode(t, add_special_tokens=False).ids), hashlib.sha256(t.encode()).hexdigest()) for i, t in left)
    assert got == want


def test_stages_take_empty_tables(spark, none, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = none
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(tmp_path))
        assert docs.count() == 0, name
        assert name == "bpe" or docs.columns == none.columns


def test_stages_begin_with_heaps_given_back(spark, odd, tmp_path):
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    whole = lambda: sum(b.getCollectionCount() for b in beans() if any(x in b.getName() for x in ("Old", "MarkSweep")))
    odd.select("doc_id", "text").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    docs, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), whole()
    assert corpus_pipeline.encoding(spark, docs, str(tmp_path)).count() == 0
    assert whole() > before  # the stages before it have left their JVMs' heaps as large as they once were
