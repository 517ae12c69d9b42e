"""License scans by diagonal voting.

Texts and templates are words; every k words that follow each other are a gram. The grams of all texts are joined by
hash with the grams of the templates, and a hit, confirmed on its words, votes for the diagonal of its
place in the text less its place in the template. Diagonals within SHIFT of each other are one copy with
words put in or left out: each diagonal takes in its neighbours' votes, and stands where it is the fullest of them.
A span is verified by the share of the template's words that its grams cover. Exact templates (phrases) need all of them on one diagonal.

The templates are a list of the caller's, of MOST_WORDS words at most, so they may be broadcast: texts are
read once, and only votes and a thin row a document are shuffled. Nothing leaves the JVM.

Defined cases: a null or empty text has no words, no labels and a score of 0; very long texts are scanned whole; repeated rows give equal rows; an empty
table gives no rows; a null doc_id is carried; columns other than doc_id and text are not read; a template of fewer than k words is refused.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRAM = 3
#: Diagonals so far apart are merged: so many words may be put in or left out.
SHIFT = 3
#: The share of a template's words that a span must cover.
LEAST = 0.8
#: Words of all templates together, at most: the bound of what is broadcast.
MOST_WORDS = 100_000

# The phrases whose places count, with their labels.
PHRASES = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
# Notices of well-known licenses.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
TEMPLATES = [(label, text, True) for label, text in PHRASES] + [(label, text, False) for label, text in NOTICES]

_WORD, _BETWEEN = (rf"[{no}\x00-\x2F\x3A-\x60\x7B-\x7F]+" for no in ("^", ""))


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case.

    lower() changes no word's ends and makes ASCII of no other letter but the Kelvin sign, which goes first; so it
    leaves words equal to a template's (which are ASCII) exactly where lower-casing A-Z alone does.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u212b")))
    return F.array_remove(F.split(low, _BETWEEN), "")  # far faster than to extract the words one by one


def grams(own: Column, k: int = GRAM) -> Column:
    """The hashes of the runs of k words, in order."""
    at = F.when(F.size(own) >= k, F.sequence(F.lit(0), F.size(own) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(own, i + j) for j in range(k)]))


def template_grams(spark: SparkSession, templates: list[tuple[str, str, bool]], k: int = GRAM) -> DataFrame:
    """template, label, exact, size in words, t_pos, t_gram and t_words of each gram of the templates (label, text, exact)."""
    sizes = [len(re.findall(_WORD, text.lower())) for _, text, _ in templates]
    if any(n < k for n in sizes) or any(not text.isascii() for _, text, _ in templates):
        raise ValueError(f"a template needs {k} words of ASCII at least")
    if sum(sizes) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words together")
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"), F.lit(exact).alias("exact")) for i, (label, text, exact) in enumerate(templates)])
    own = spark.range(1).select(F.inline(rows)).select("template", "label", "exact", words(F.col("text")).alias("own"))
    each = own.select("template", "label", "exact", F.size("own").alias("size"), "own", F.posexplode(grams(F.col("own"), k)).alias("t_pos", "t_gram"))
    return each.select("template", "label", "exact", "size", "t_pos", "t_gram", F.slice("own", F.col("t_pos") + 1, F.lit(k)).alias("t_words"))


def votes(docs: DataFrame, templates: list[tuple[str, str, bool]] = TEMPLATES, k: int = GRAM) -> DataFrame:
    """row, doc_id, n_words, template, label, exact, size, diagonal and t_pos of each hit, and a row with null template a document.

    That row comes through the same join, from a last gram past the end of each text, so that the texts are read and taken apart once.
    """
    known = template_grams(docs.sparkSession, templates, k)
    past = F.lit(None)
    end = docs.sparkSession.range(1).select(past.cast("int").alias("template"), past.cast("string").alias("label"), past.cast("boolean").alias("exact"), past.cast("int").alias("size"), past.cast("int").alias("t_pos"), F.lit(0).cast("long").alias("t_gram"), past.cast("array<string>").alias("t_words"))
    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("own"))
    own = own.select("row", "doc_id", "own", F.size("own").alias("n_words"), F.concat(grams(F.col("own"), k), F.array(F.lit(0).cast("long"))).alias("grams"))
    placed = own.select("row", "doc_id", "own", "n_words", F.posexplode_outer("grams").alias("pos", "gram"))
    last = F.greatest(F.col("n_words") - k + 1, F.lit(0))
    agrees = F.when(F.col("t_pos").isNull(), F.col("pos") == last).otherwise((F.col("pos") < last) & F.expr(" and ".join(f"get(own, pos + {j}) = t_words[{j}]" for j in range(k))))
    hit = placed.join(F.broadcast(known.union(end)), (F.col("gram") == F.col("t_gram")) & agrees)
    return hit.select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), "template", "label", "exact", "size", (F.col("pos") - F.col("t_pos")).cast("long").alias("diagonal"), "t_pos")


def merged(hits: DataFrame, k: int = GRAM, shift: int = SHIFT) -> DataFrame:
    """row, doc_id, n_words, template, label, exact, size, diagonal, covered (the template's words under the votes of the diagonal and its neighbours; of exact templates, of itself), first and last (the span's words), stands."""
    key = ["row", "doc_id", "n_words", "template", "label", "exact", "size"]
    dealt = hits.repartition("row")  # all that follows is by row, within its partitions
    own = dealt.groupBy(*key, "diagonal").agg(F.collect_set("t_pos").alias("t"))  # a template's grams at most
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-shift, shift)
    all_of = F.when(F.col("exact"), F.col("t")).otherwise(F.flatten(F.collect_list("t").over(near)))
    under = F.size(F.array_distinct(F.flatten(F.transform(all_of, lambda x: F.sequence(x, x + k - 1)))))
    wide = lambda of, end: F.when(F.col("exact"), end).otherwise(of(end).over(near))
    out = own.select(*key, "diagonal", F.when(F.col("template").isNotNull(), under).alias("covered"), wide(F.min, F.col("diagonal") + F.array_min("t")).alias("first"), (wide(F.max, F.col("diagonal") + F.array_max("t")) + k - 1).alias("last"))
    rank = F.struct("covered", (-F.col("diagonal")).alias("order"))
    return out.withColumn("stands", F.col("exact") | (F.max(rank).over(near) == rank))


def verified(found: DataFrame, least: float = LEAST) -> DataFrame:
    """merged() with coverage and good: whether the span is a copy of its template."""
    share = F.col("covered") / F.col("size")
    return found.withColumn("coverage", share).withColumn("good", F.coalesce(F.col("stands") & F.when(F.col("exact"), F.col("covered") == F.col("size")).otherwise(share >= least), F.lit(False)))


def spans(docs: DataFrame, templates: list[tuple[str, str, bool]] = TEMPLATES) -> DataFrame:
    """doc_id, label, template (its place in the list), first_word, last_word (from 0, the last included) and coverage of each verified span."""
    found = verified(merged(votes(docs, templates))).where("good")
    return found.select("doc_id", "label", "template", F.col("first").alias("first_word"), F.col("last").alias("last_word"), "coverage")


def scan(docs: DataFrame, templates: list[tuple[str, str, bool]] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each document; base is what exact templates find."""
    found = verified(merged(votes(docs, templates)))
    base = F.col("good") & F.col("exact")
    names = lambda when: F.array_join(F.array_sort(F.collect_set(F.when(when, F.col("label")))), ",")
    out = found.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("diagonal"))).alias("first_word"), F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
        names(base).alias("base_labels"), names(F.col("good")).alias("labels"), F.coalesce(F.max(F.when(F.col("good"), F.col("coverage"))), F.lit(0.0)).alias("score"),
    )
    return out.drop("row")


def op11_diagonal_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    lists = ", ".join(f"({i}, '{label}', {str(exact).lower()}, {text.split()})" for i, (label, text, exact) in enumerate(TEMPLATES))
    return rf"""WITH t(template, label, exact, words) AS (VALUES {lists}),
g AS (SELECT template, label, exact, len(words) AS size, i - 1 AS t_pos, words[i:i + {GRAM - 1}] AS gram FROM t, unnest(range(1, len(words) - {GRAM - 2})) u(i)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
p AS (SELECT r, i - 1 AS pos, w[i:i + {GRAM - 1}] AS gram FROM d, unnest(range(1, len(w) - {GRAM - 2})) u(i)),
v AS (SELECT r, template, label, exact, size, pos - t_pos AS diagonal, t_pos FROM p JOIN g USING (gram)),
a AS (SELECT r, template, label, exact, size, diagonal FROM v GROUP BY ALL),
m AS (SELECT a.r, a.template, a.label, a.exact, a.size, a.diagonal, count(DISTINCT v.t_pos + o) AS covered FROM a JOIN v ON a.r = v.r AND a.template = v.template AND abs(a.diagonal - v.diagonal) <= if(a.exact, 0, {SHIFT}), unnest(range(0, {GRAM})) u(o) GROUP BY ALL),
f AS (SELECT *, covered / size AS coverage, if(exact, covered = size, covered / size >= {LEAST}) AS good FROM m)
SELECT any_value(d.doc_id) AS doc_id, any_value(len(w))::bigint AS n_words, count(*) FILTER (good AND exact) AS n_base, (min(diagonal) FILTER (good AND exact))::bigint AS first_word, (max(diagonal) FILTER (good AND exact))::bigint AS last_word,
coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good AND exact), '') AS base_labels, coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good), '') AS labels, coalesce(max(coverage) FILTER (good), 0)::double AS score
FROM d LEFT JOIN f ON d.r = f.r GROUP BY d.r"""


OP11_SQL = _sql()
