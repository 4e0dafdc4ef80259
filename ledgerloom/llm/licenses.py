"""Operator 1 (native): license notices in documents by an exact set-similarity join with templates.

Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after A-Z are lower-cased. A document's text blocks are its runs
of `block` words, one each half block, so that any passage of half a block lies inside one; templates of more than half
a block have blocks of twice the size, and so on, so that licence bodies fit too. Block and template are token sets; a block matches a template if it holds at least ceil(threshold * |T|) of its tokens. Tokens are ordered by
global document frequency, counted over all documents, rarest first:

- prefix filter: only blocks that hold one of T's |T| - need + 1 rarest tokens can match;
- length filter: blocks with fewer distinct template tokens than `need` can't;
- positional filter: with the first shared token at place p of T and place q of the block's ordered tokens, at most
  1 + min(|T| - p - 1, |B| - q - 1) can be shared.

What is left is verified on the whole sets, so every matching block is found and nothing else. Templates are a fixed
list; they alone are broadcast. Base: the phrases' words standing consecutively, counted at all places.

Nulls are empty texts: 0 words, no labels ('' for both label columns), score 0.0. Documents are judged row by row
(rows that repeat get equal results), null doc_ids included; other columns are ignored; an empty table gives an empty
result. score: 1.0 with a base label, else the best containment of a matching template, else 0.0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, fields, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Label and text of each template; several texts may carry one label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "under the terms of the gnu general public license version 2"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    ),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
)


def block_of(template: str, block: int = 48) -> int:
    """Words of the blocks that a template is looked for in: half of them hold it whole."""
    while len(template.split()) > block // 2:
        block *= 2
    return block


def _texts(values: list[str]) -> Column:
    """A constant array."""
    return F.split(F.lit(" ".join(values)), " ")


def _words() -> Column:
    return F.filter(F.split(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), GAP), lambda w: w != "")


def _places(phrase: str) -> Column:
    """Word index of every place where the phrase's words stand consecutively; cheap where one of them is missing."""
    p = phrase.split()
    w = F.col("w")

    def starts(i: Column) -> Column:
        found = F.get(w, i) == p[0]
        for k, word in enumerate(p[1:], 1):
            found = found & (F.get(w, i + k) == word)
        return found

    here = F.filter(F.sequence(F.lit(0), F.size(w) - len(p)), starts)
    has = F.size(w) >= len(p)
    for word in sorted(p, key=len, reverse=True):
        has = has & F.array_contains(w, word)
    return F.when(has, here).otherwise(F.array().cast("array<int>"))


def _runs(size: int, words: list[str]) -> Column:
    """Runs of `size` words, one each half of that, as sets of those of the given words that they hold."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size // 2), F.lit(size // 2))
    return F.transform(starts, lambda s: F.struct(F.lit(size).alias("size"), F.array_intersect(F.slice("w", s, size), _texts(words)).alias("b")))


def scan(spark: SparkSession, docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.9, block: int = 48) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    stage = Stage(spark, "licenses")
    docs = fields(docs, doc_id="long", text="string")
    tokens = [sorted(set(t.split())) for _, t in templates]
    vocabulary = sorted({w for t in tokens for w in t})
    sizes = [block_of(t, block) for _, t in templates]
    key = F.struct(F.xxhash64("doc_id", "text").alias("a"), F.hash("text", "doc_id").alias("b"))  # 96 bits
    read = docs.select("doc_id", key.alias("row_id"), _words().alias("w"))
    need = [math.ceil(threshold * len(t) - 1e-9) for t in tokens]
    # one pass over the texts: base results, each document's template tokens, and the blocks of those documents that
    # hold enough tokens of some template (no other can have a matching block)
    none = F.array().cast("array<struct<size:int,b:array<string>>>")
    cuts = []
    for size in sorted(set(sizes)):
        mine = [(own, n) for own, n, x in zip(tokens, need, sizes, strict=True) if x == size]
        # a token stands for no set larger than its own template's words
        words = sorted({t for own, _ in mine for t in own})
        enough = F.lit(False)
        for own, n in mine:
            enough = enough | (F.size(F.array_intersect("own", _texts(own))) >= n)
        cut = _runs(size, words)
        cuts.append(F.when(enough, cut).otherwise(none))
    places = [_places(p) for p in PHRASES.values()]
    base = read.select(
        "doc_id", "row_id", F.size("w").cast("long").alias("n_words"),
        F.struct(*[x.alias(f"p{i}") for i, x in enumerate(places)]).alias("p"),
        F.array_intersect("w", _texts(vocabulary)).alias("own"), "w",
    ).withColumn("blocks", F.array_distinct(F.concat(*cuts))).withColumn("all", F.concat(*[F.col(f"p.p{i}") for i in range(len(places))]))
    base_labels = F.array_sort(F.array_compact(F.array(*[F.when(F.size(F.col(f"p.p{i}")) > 0, F.lit(k)) for i, k in enumerate(PHRASES)])))
    base = stage.write(
        base.select("doc_id", "row_id", "n_words", F.size("all").cast("long").alias("n_base"), F.array_min("all").cast("long").alias("first_word"), F.array_max("all").cast("long").alias("last_word"), base_labels.alias("base"), "own", "blocks"), "base"
    )
    seen = {r["t"]: r["n"] for r in base.select(F.explode("own").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()}  # a row a template token
    order = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (seen.get(t, 0), t)))}
    rows = []
    for number, ((label, _), own) in enumerate(zip(templates, tokens, strict=True)):
        own = sorted(own, key=order.__getitem__)
        rows += [(number, label, t, place, len(own), need[number], own, sizes[number]) for place, t in enumerate(own[: len(own) - need[number] + 1])]
    prefix = spark.createDataFrame(rows, "template int, label string, token string, place int, size int, need int, tokens array<string>, block int")
    rare = sorted({r[2] for r in rows})
    blocks = base.where("size(blocks) > 0").select("row_id", F.explode("blocks").alias("x")).select("row_id", F.col("x.size").alias("block"), F.col("x.b").alias("b")).where(F.arrays_overlap("b", _texts(rare))).distinct()
    rank = F.create_map(*[x for t, i in order.items() for x in (F.lit(t), F.lit(i))])
    ordered = F.array_sort(F.transform("b", lambda t: F.struct(F.element_at(rank, t).alias("r"), t.alias("t"))))
    told = blocks.select("row_id", "block", "b", F.posexplode(ordered).alias("q", "x")).select("row_id", "block", "b", "q", F.col("x.t").alias("token"))
    shared = F.size(F.array_intersect("b", "tokens"))
    met = (
        told.join(F.broadcast(prefix), ["token", "block"])
        .where(F.size("b") >= F.col("need"))
        .where(1 + F.least(F.col("size") - F.col("place") - 1, F.size("b") - F.col("q") - 1) >= F.col("need"))
        .where(shared >= F.col("need"))
    )
    method = met.groupBy("row_id").agg(F.collect_set("label").alias("found"), F.max(shared / F.col("size")).alias("best"))
    none = F.array().cast("array<string>")
    out = base.drop("own", "blocks").join(method, "row_id", "left")
    every = F.array_sort(F.array_union("base", F.coalesce("found", none)))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, table(spark, sf_dir, "documents"))


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _oracle(threshold: float = 0.9, block: int = 48) -> str:
    """Each block against each template, without any filter."""
    temps = ", ".join(f"('{label}', {_sql_list(sorted(set(t.split())))}, {block_of(t, block)})" for label, t in TEMPLATES)
    sizes = ", ".join(f"({x})" for x in sorted({block_of(t, block) for _, t in TEMPLATES}))
    places = {k: f"list_filter(range(1, len(w) - {len(p.split()) - 2}), lambda i: " + " AND ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(p.split())) + ")" for k, p in PHRASES.items()}
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
p AS (SELECT doc_id, w, {", ".join(f'{x} AS "{k}"' for k, x in places.items())} FROM w),
a AS (SELECT *, list_concat(list_concat("mit", "apache-2"), "cc-by-nc") AS a,
  list_filter([{", ".join(f"""CASE WHEN len("{k}") > 0 THEN '{k}' END""" for k in PHRASES)}], lambda x: x IS NOT NULL) AS base FROM p),
t(label, tokens, z) AS (VALUES {temps}), z(z) AS (VALUES {sizes}),
b AS (SELECT doc_id, z, list_slice(w, s, s + z - 1) AS b FROM w, z, unnest(range(1, greatest(1, len(w) - z // 2) + 1, z // 2)) AS u(s) WHERE len(w) > 0),
m AS (SELECT doc_id, label, len(list_intersect(b, tokens)) AS n, len(tokens) AS size FROM b JOIN t USING (z) WHERE list_has_any(b, tokens)),
f AS (SELECT doc_id, list(DISTINCT label) AS found, max(n / size) AS best FROM m WHERE n >= ceil({threshold} * size - 1e-9) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(a)::BIGINT AS n_base, (list_min(a) - 1)::BIGINT AS first_word, (list_max(a) - 1)::BIGINT AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(found, [])))), ',') AS labels,
  CASE WHEN len(a) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM a LEFT JOIN f USING (doc_id)
"""


ORACLE = _oracle()
