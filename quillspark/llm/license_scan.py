"""License scans: diagonal voting over rolling word k-grams. [native]

Every rolling k-gram of a document's words is joined by hash to the positions of the same k-gram in the templates; the
words are compared too, so hash collisions don't count. A match votes for its diagonal (document position minus
template position). Votes are summed for each diagonal, diagonals at most `slack` apart are merged (a word more or
less moves the rest of a copy to the next diagonal), and merged spans are verified: the share of the template's
k-grams that matched must reach `min_cover`. A phrase is a template that must match whole, on one diagonal.

The template table is a constant of this module, so its broadcast has a fixed size, and so has the set of its hashes:
k-grams whose hash it lacks go before any row is made of them. Null or empty texts have no words and no labels. Rows equal
in doc_id and text are one document (told by the id and 128 bits) and get the same result each; null ids are kept. The
words of a document never leave it, whatever its length; only matches are shuffled. An empty table gives none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROW, Scratch, alnum_array, join_rows, with_row_key

#: Phrases that count wherever their words stand consecutively.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Wording of public licences, found also when changed a little.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
K = 3


def _hash(words: Column, at: Column) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(K)])


def _grams(spark: SparkSession) -> DataFrame:
    rows = []
    for kind, group in ((1, PHRASES), (0, TEMPLATES)):
        for label, text in group:
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
            n, number = len(words) - K + 1, len(rows)
            rows += [(number, label, kind, i, n, *words[i : i + K]) for i in range(n)]
    names = "tpl int, label string, phrase int, tpos int, n_grams int, t0 string, t1 string, t2 string"
    return spark.createDataFrame(rows, names).withColumn("th", F.xxhash64("t0", "t1", "t2"))


def scan_licenses(spark: SparkSession, docs: DataFrame, slack: int = 3, min_cover: float = 0.6) -> DataFrame:
    """doc_id, text in; a row for each row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score
    (the best cover of a template, 1 for a whole phrase) and spans (label, first and last word of each verified span)."""
    templates = _grams(spark)
    known = [r["th"] for r in templates.select("th").distinct().collect()]
    words = with_row_key(docs.select("doc_id", "text")).select(*ROW, alnum_array(F.col("text")).alias("w"))
    places = F.filter(F.when(F.size("w") >= K, F.sequence(F.lit(0), F.size("w") - K)), lambda i: _hash(F.col("w"), i).isin(known))
    found = F.transform(places, lambda i: F.struct(i.alias("pos"), *[F.get("w", i + k).alias(f"w{k}") for k in range(K)], _hash(F.col("w"), i).alias("h")))
    rows = Scratch(spark, "licenses").stash(words.select(*ROW, F.size("w").cast("long").alias("n_words"), found.alias("found")), "rows")
    grams = rows.select(*ROW, F.explode("found").alias("g")).select(*ROW, "g.*")
    t = F.broadcast(templates)
    same = (F.col("h") == F.col("th")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    votes = (
        grams.join(t, same)
        .select(*ROW, "tpl", "label", "phrase", "n_grams", "tpos", (F.col("pos") - F.col("tpos")).alias("diag"))
        .groupBy(*ROW, "tpl", "label", "phrase", "n_grams", "diag")
        .agg(F.collect_set("tpos").alias("hits"))
    )
    # Diagonals of a document and template lie side by side; a gap of more than `slack` begins another span.
    by = Window.partitionBy(*ROW, "tpl").orderBy("diag")
    merged = (
        votes.withColumn("new", F.when((F.col("phrase") == 1) | (F.col("diag") - F.lag("diag").over(by) > slack), 1).otherwise(0))
        .withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*ROW, "tpl", "label", "phrase", "n_grams", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("votes"),
            F.min(F.col("diag") + F.array_min("hits")).alias("first"),
            F.max(F.col("diag") + F.array_max("hits") + K - 1).alias("last"),
        )
        .withColumn("cover", F.col("votes") / F.col("n_grams"))
        # Verified: enough of the template, within a stretch not much longer than it; a phrase has to be whole.
        .filter(F.when(F.col("phrase") == 1, F.col("votes") == F.col("n_grams")).otherwise(
            (F.col("cover") >= min_cover) & (F.col("last") - F.col("first") + 1 <= 1.5 * (F.col("n_grams") + K))))
    )
    base = F.col("phrase") == 1
    join_sorted = lambda c: F.array_join(F.array_sort(c), ",")
    found = merged.groupBy(*ROW).agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        join_sorted(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        join_sorted(F.collect_set("label")).alias("labels"),
        F.max("cover").alias("score"),
        F.array_sort(F.collect_list(F.struct("first", "last", "label"))).alias("spans"),
    )
    return join_rows(rows.select(*ROW, "n_words"), found, "left").select(
        F.col(ROW[0]).alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )
