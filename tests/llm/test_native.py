import re

from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, licenses


def test_decontamination_against_brute_force(spark, odd, none):
    item = " ".join(f"q{i}" for i in range(40))
    docs = [(1, "x y " + item + " z"), (2, " ".join(f"q{i}" for i in range(36))), (3, " ".join(f"q{i}" for i in range(30))), (4, "tiny item"), (5, None), (6, "this tiny ITEM here"), (7, " ".join(f"q{i}" if i != 20 else "no" for i in range(40)))]
    items = [(1, item), (2, "tiny item"), (3, None), (4, ""), (5, "never seen anywhere at all here")]
    d = spark.createDataFrame(docs, "doc_id long, text string").union(odd.select(F.col("doc_id") + 100, "text"))
    got = {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in decontaminate.contaminated(spark, d, spark.createDataFrame(items, "item_id long, text string")).collect()}

    def sets(t, k):
        w = (t or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = {}
    for i, t in items:
        k = min(5, len((t or "").split()))
        for r in d.collect() if k else ():
            shared = len(sets(t, k) & sets(r["text"], k))
            if shared >= 0.8 * len(sets(t, k)) and r["doc_id"] is not None:
                want[r["doc_id"], i] = (len(sets(t, k)), shared)
    assert got == want and (1, 1) in got and (6, 2) in got
    shuffled = decontaminate.contaminated(spark, d, spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=0)
    assert {(r["doc_id"], r["item_id"]): (r["n_item"], r["n_shared"]) for r in shuffled.collect()} == want
    assert decontaminate.contaminated(spark, none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(spark, d, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_licenses(spark, odd, none):
    docs = [
        (1, "Text. Released under the MIT License. And under the mit-license again"), (2, "Licensed under the Apache License, Version 2.0."), (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "x CC BY-NC y"), (5, "mit dem und the license"), (6, None), (7, ""), (8, "w " * 500 + "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").union(odd.select(F.col("doc_id") + 100, "text"))
    got = {r["doc_id"]: r for r in licenses.scan(spark, df).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"], got[1]["labels"], got[1]["score"]) == (2, 2, 7, "mit", "mit", 1.0)
    assert got[2]["labels"] == "apache-2" and got[2]["base_labels"] == "apache-2"
    assert (got[3]["base_labels"], got[3]["labels"], got[3]["score"]) == ("", "gpl-3", 1.0)
    assert got[4]["labels"] == "cc-by-nc" and got[5]["labels"] == "" and got[5]["score"] == 0.0
    assert (got[6]["n_words"], got[6]["first_word"], got[6]["labels"]) == (0, None, "")
    assert got[8]["labels"] == "mit" and got[8]["base_labels"] == ""
    for r in df.collect():
        t = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        assert r["doc_id"] is None or got[r["doc_id"]]["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t))
    body = next(t for _, t in licenses.TEMPLATES if len(t.split()) > 48)
    far = "x " * 333 + body.replace("free of charge", "free  of\ncharge,").upper() + " y" * 100
    rows = licenses.scan(spark, spark.createDataFrame([(1, far), (2, far.replace("SUBLICENSE AND OR SELL", "X")), (3, "x " * 500)], "doc_id long, text string"), (("body", body),)).collect()
    assert {r["doc_id"]: r["labels"] for r in rows} == {1: "body", 2: "body", 3: ""} and {r["doc_id"]: r["score"] for r in rows}[2] < 1.0
    assert licenses.scan(spark, df).count() == df.count() and licenses.scan(spark, none).count() == 0
