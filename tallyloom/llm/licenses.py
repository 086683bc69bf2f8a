"""License scans by diagonal voting, with DataFrame operations only.

All rolling word k-gram hashes of every text join the template positions, and a
hit counts if its words are the template's, word by word; hits vote for the
diagonal (position in the text less position in the template); neighbouring
diagonals merge; a merged run counts as a find if its span, of about the
template's length at most, has enough of the template's words in place.

Defined results: null text is empty, with no words and no labels; repeated rows
and rows without an id are each their own document; ties, that is several finds
of a label, each count for n_base and give the label once; very long texts are
scanned whole; extra columns are left alone, whatever their names; an empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only

GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Phrases and labels of the base scan.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public licence notices, label first.
TEMPLATES = (
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-notice", "released under the mit license"),
    ("bsd-grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
)

WIDTH, NEIGHBOURS, COVER, STRETCH = 3, 4, 0.7, 1.5
_DOC = "-"


def template_table(spark: SparkSession) -> DataFrame:
    """(h, w, k, label, kind, tpos, parts, n): every k-gram of every phrase and template; a few hundred rows, fixed by the lists above."""
    rows = [(None, 0, _DOC, "doc", 0, 1, 1)]
    for text, label in PHRASES.items():
        w = text.split()
        rows += [(w[i : i + 2], 2, label, "base", i, len(w) - 1, len(w)) for i in range(len(w) - 1)]
    for label, text in TEMPLATES:
        w = text.split()
        rows += [(w[i : i + WIDTH], WIDTH, label, "own", i, len(w) - WIDTH + 1, len(w)) for i in range(len(w) - WIDTH + 1)]
    t = spark.createDataFrame(rows, "w array<string>, k int, label string, kind string, tpos int, parts int, n int")
    hashes = F.transform("w", lambda x: F.xxhash64(x))
    t = t.withColumn("h", hashes)
    two = F.xxhash64(F.lit(2), F.get("h", F.lit(0)), F.get("h", F.lit(1)))
    more = F.xxhash64(F.lit(WIDTH), *(F.get("h", F.lit(j)) for j in range(WIDTH)))
    return t.withColumn("h", F.when(F.col("k") == 0, F.lit(0).cast("long")).when(F.col("k") == 2, two).otherwise(more)).withColumn("w", F.coalesce("w", F.array().cast("array<string>")))


#: The one letter beyond A-Z whose lower case is in a-z; with it out of the way, lower() turns no other letter into one of a template's.
_KELVIN = "\u212a"


def license_hits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a k-gram that a template also has, and one of kind doc for each document, whose pos is its number of words."""
    templates = template_table(df.sparkSession)
    known = F.lit([r["h"] for r in templates.where("k > 0").select("h").distinct().collect()])  # a few hundred, as the templates
    d = only(df, doc_id=id_col, text=text_col).withColumn("rid", F.monotonically_increasing_id())
    text = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit(_KELVIN), F.lit("\u2126")))
    d = d.withColumn("w", F.array_remove(F.split(text, GAP, -1), ""))
    d = d.select("rid", "doc_id", "w", F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    n = F.size("h")

    def grams(width):
        rolled = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(F.lit(width), *(F.get("h", i + j) for j in range(width))))
        return F.when(n >= width, rolled).otherwise(F.array().cast("array<bigint>"))

    # hits with their words; a text without any, as nearly all are, is done with here
    d = d.withColumn("g2", grams(2)).withColumn("g3", grams(WIDTH))
    d = d.withColumn("met", F.array_intersect(F.concat("g2", "g3"), known))

    def hits(g, width):
        at = F.transform(g, lambda h, i: F.when(F.array_contains("met", h), F.struct(h.alias("h"), i.alias("pos"), F.slice("w", i + 1, width).alias("words"))))
        return F.when(F.size("met") > 0, F.filter(at, lambda x: x.isNotNull())).otherwise(F.array().cast("array<struct<h:bigint,pos:int,words:array<string>>>"))

    own = F.array(F.struct(F.lit(0).cast("long").alias("h"), n.alias("pos"), F.array().cast("array<string>").alias("words")))
    d = d.select("rid", "doc_id", F.inline(F.concat(own, hits("g2", 2), hits("g3", WIDTH))))
    t = F.broadcast(templates)  # fixed lists: a few hundred rows at any size of input
    return d.join(t, "h").where(F.col("words") == F.col("w")).drop("w", "words")


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: n_words, base places and labels, own labels with spans, score."""
    hits = license_hits(df, id_col, text_col).repartition("rid").withColumn("diagonal", F.col("pos") - F.col("tpos"))
    key = ["rid", "doc_id", "kind", "label", "parts", "n"]
    votes = hits.groupBy(*key, "diagonal").agg(
        F.count_distinct("tpos").alias("votes"),
        F.collect_set("tpos").alias("tposs"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
    )
    line = Window.partitionBy("rid", "doc_id", "kind", "label").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(line) > NEIGHBOURS, F.lit(True))
    alone = F.col("kind") != "own"
    runs = (
        votes.withColumn("apart", (apart | alone).cast("int"))
        .withColumn("run", F.sum("apart").over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*key, "run")
        .agg(
            F.array_distinct(F.flatten(F.collect_list("tposs"))).alias("tposs"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.min("diagonal").alias("start"),
        )
        .withColumn("votes", F.size("tposs"))
        .withColumn("covered", F.size(F.array_distinct(F.flatten(F.transform("tposs", lambda t: F.sequence(t, t + WIDTH - 1))))))
    )
    # verification: of the template's words, those that stand in place within the span
    share = F.col("votes") / F.col("parts")
    length = F.col("last") - F.col("first") + WIDTH
    in_place = F.col("covered") / F.col("n")
    found = F.when(F.col("kind") == "base", share == 1.0).when(
        F.col("kind") == "own", (share >= COVER) & (in_place >= COVER) & (length <= STRETCH * F.col("n") + NEIGHBOURS)
    ).otherwise(F.lit(True))
    is_base, is_own = F.col("kind") == "base", F.col("kind") == "own"
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return (
        runs.where(found)
        .groupBy("rid", "doc_id")
        .agg(
            F.max(F.when(F.col("kind") == "doc", F.col("first"))).cast("long").alias("n_words"),
            F.count(F.when(is_base, 1)).alias("n_base"),
            F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
            F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
            labels(is_base).alias("base_labels"),
            labels(is_base | is_own).alias("labels"),
            F.coalesce(F.max(F.when(is_base | is_own, share)), F.lit(0.0)).alias("score"),
            F.collect_list(F.when(is_own, F.struct("label", "first", (F.col("last") + WIDTH).alias("end"), share.alias("share")))).alias("spans"),
        )
        .drop("rid")
    )
