import hashlib

from ledgerloom.plans import registry


def test_tails_of_all_texts_by_byte(spark, tmp_path):
    texts = ["x" * 70, "\u00e9" * 40 + "x", "\u65e5\u672c" * 30, "short \u00fc", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["tail"] for r in registry.QUERIES["s12_byte_tails"](spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else hashlib.md5(t.encode()[-64:]).hexdigest() for i, t in enumerate(texts)}
