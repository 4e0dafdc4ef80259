"""Operator 4 (native): benchmark items inside documents by size-partitioned MinHash containment search.

Both sides become sets of hashed k-word shingles (lower case; items of fewer words are one shingle of their own
length, looked for at that length). Items are partitioned by size (powers of two). An item's sketch is the bottom part
of its shingles in hash order, its minwise values; the partition fixes how many: with containment threshold t a
document that holds an item of n shingles lacks at most n - ceil(t * n) of them, so of any n - ceil(t * n) + 1 it holds
one. With sketches of that size (taken at the partition's upper bound, never fewer) no document at the threshold is
missed, however long it is. Documents too small for a partition are skipped. Candidates are verified by exact
containment of the whole item in the whole document.

Document shingles stream through the join with the sketches, which are handed to all tasks behind a check of their
number, as the items' own shingles are behind a check of theirs; beyond either both are shuffled. Only verified pairs (doc_id, item_id) are aggregated, in each task first. Everything is
DataFrame expressions.

Nulls, empty texts and items without words match nothing. Repeated items count each by item_id; items sharing an id
are one item each text. Documents sharing a doc_id are one result row an item, with the best containment. Null
doc_ids or item_ids take no part. Other columns are ignored. Empty tables: empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, fields, handed_out, table


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingles_of(words: str, k: Column) -> Column:
    """Distinct hashes of all runs of k words."""
    w = F.col(words)
    return F.when(F.size(w) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, k))))).otherwise(F.array().cast("array<bigint>"))


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, threshold: float = 0.8, shingle: int = 5, broadcast_rows: int = 1 << 17, broadcast_hashes: int = 1 << 22) -> DataFrame:
    """doc_id, item_id, n_item, n_shared, containment for every document that holds at least threshold of an item.

    Up to broadcast_rows sketch rows (24 bytes each) and items of up to broadcast_hashes shingles (8 bytes each) are
    handed to all tasks, and a candidate is verified where its document's shingles are; beyond that candidates are found by a shuffled join and verified in a
    second reading of their documents."""
    stage = Stage(spark, "decontaminate")
    docs = fields(docs, doc_id="long", text="string").where("doc_id is not null")
    need = lambda n: F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int")
    items = fields(items, item_id="long", text="string").where("item_id is not null").withColumn("w", words_of("text")).where("size(w) > 0")
    items = items.select("item_id", F.least(F.size("w"), F.lit(shingle)).alias("k"), "w")
    items = items.withColumn("own", F.sort_array(shingles_of("w", F.col("k")))).withColumn("n", F.size("own")).withColumn("part", F.ceil(F.log2(F.col("n").cast("double"))).cast("int")).select("item_id", "k", "own", "n", "part")
    items = items.withColumn("upper", F.least(F.expr("cast(pow(2, part) as int)"), F.lit(1 << 30)))
    spare = F.greatest(F.col("upper") - need(F.col("upper")), F.col("n") - need(F.col("n"))) + 1
    # items that share an id are one item each text, so they need a name of their own
    items = stage.write(items.withColumn("item", F.monotonically_increasing_id()), "named")
    sketch = items.select("item", "item_id", "k", "n", F.explode(F.slice("own", 1, F.least(spare, F.col("n")))).alias("h"))
    lengths = {r["k"]: r["many"] for r in sketch.groupBy("k").agg(F.count("*").alias("many")).collect()}  # at most `shingle` rows
    hashes = {r["k"]: r["many"] for r in items.groupBy("k").agg(F.sum("n").alias("many")).collect()}
    out = spark.createDataFrame([], "doc_id long, item_id long, n_item int, n_shared int")
    for k, many in sorted(lengths.items()):
        sets = docs.select("doc_id", words_of("text").alias("w")).select("doc_id", shingles_of("w", F.lit(k)).alias("s"))
        mine = sketch.where(F.col("k") == k).drop("k")
        shared = F.size(F.array_intersect("own", "s")).alias("n_shared")
        # outer: a filter inferred for explode would be pushed below the words and split the text for every shingle
        if many <= broadcast_rows and hashes[k] <= broadcast_hashes:
            told = sets.select("doc_id", "s", F.size("s").alias("size"), F.explode_outer("s").alias("h"))
            met = told.join(F.broadcast(mine), "h").where(F.col("size") >= need(F.col("n")))
            both = met.join(F.broadcast(items.select("item", "own")), "item").select("doc_id", "item_id", F.col("n").alias("n_item"), shared)
        else:
            told = sets.select("doc_id", F.size("s").alias("size"), F.explode_outer("s").alias("h"))
            met = stage.write(told.join(mine, "h").where(F.col("size") >= need(F.col("n"))).select("doc_id", "item").distinct(), "candidates")
            stage.release()
            whole = met.join(sets, "doc_id").join(items.select("item", "item_id", "own", "n"), "item")
            both = whole.select("doc_id", "item_id", F.col("n").alias("n_item"), shared)
        out = out.union(both.where(F.col("n_shared") >= need(F.col("n_item"))))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_item", "n_shared")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_item", "m.n_shared", "m.containment")


def without_items(spark: SparkSession, docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs, with all their columns, less the rows that hold an item; equal rows share a verdict. Texts are not moved
    while the rows found are few."""
    lower = {c.lower() for c in docs.columns}
    key = next(x for i in range(len(docs.columns) + 1) if (x := f"_row{'_' * i}") not in lower)
    # the search takes one number a row; two rows that share it by chance share the verdict of either
    keyed = docs.withColumn(key, F.xxhash64(docs["doc_id"], docs["text"]))
    found = Stage(spark, "without-items").write(contaminated(spark, keyed.select(F.col(key).alias("doc_id"), docs["text"].alias("text")), items, **how).select(F.col("doc_id").alias(key)).distinct(), "found")
    return keyed.join(handed_out(found), key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SETS = r"""(SELECT {id}, list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))) AS s
  FROM (SELECT {id}, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS w FROM {of}) WHERE len(w) > 0)"""
#: Items of five words or more, as all of the table's are.
ORACLE = f"""
WITH d AS {_SETS.format(id="doc_id", of="documents")}, i AS {_SETS.format(id="item_id", of="benchmark")},
x AS (SELECT item_id, unnest(s) AS g FROM i), y AS (SELECT doc_id, unnest(s) AS g FROM d),
c AS (SELECT doc_id, item_id, count(*)::INTEGER AS n_shared FROM x JOIN y USING (g) GROUP BY ALL)
SELECT doc_id, item_id, len(s)::INTEGER AS n_item, n_shared, n_shared / len(s) AS containment FROM c JOIN i USING (item_id) WHERE n_shared >= ceil(len(s) * 0.8 - 1e-9)
"""
