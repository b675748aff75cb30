"""License notices by diagonal voting, in DataFrame operations alone.

Every rolling hash of three words is joined to the positions it has in a
template. Hits of one copy of a template lie on one diagonal (position in the
document minus position in the template); words put in or left out move it by a
few. Votes are counted by diagonal, neighbouring diagonals are merged, and a
merged span is verified by the share of the template that it covers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

K = 3
#: Fixed phrases whose every exact place counts, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Fixed wording of public license notices, and their labels.
NOTICES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "mit"),
    ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "mit"),
    ("Released under the MIT License", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2"),
    ("you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd-3"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    ("licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "cc-by-nc"),
)
#: Diagonals up to this far apart are merged; a span is verified from this share of its template's hashes.
NEIGHBOURS, VERIFIED = 3, 0.6

#: Runs of ASCII characters other than letters and digits separate words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> str:
    """SQL for the words of a text, A-Z in lower case.

    lower() also maps letters beyond ASCII, which no template has; the two that
    it maps to ASCII letters (Kelvin sign, dotted I) are replaced by another
    letter first.
    """
    safe = f"replace(replace(coalesce({text}, ''), '\u212a', '\u0138'), '\u0130', '\u0138')"
    return f"filter(split(lower({safe}), '{SEPARATORS.replace(chr(92), chr(92) * 2)}'), w -> w <> '')"


def template_rows(k: int = K) -> list[tuple[int, str, bool, int, int, list[str]]]:
    """(tid, label, exact, grams, tpos, words) for every k-gram of the phrases and notices; a few hundred rows."""
    rows = []
    for tid, (words, label) in enumerate([*PHRASES, *NOTICES]):
        own = re.findall(r"[a-z0-9]+", words.lower())
        rows += [(tid, label, tid < len(PHRASES), len(own) - k + 1, p, own[p : p + k]) for p in range(len(own) - k + 1)]
    return rows


def templates(spark: SparkSession, k: int = K) -> DataFrame:
    """The template rows with h, the hash of their words."""
    grams = spark.createDataFrame(template_rows(k), "tid int, label string, exact boolean, grams int, tpos int, w array<string>")
    return grams.select(F.xxhash64(*[F.col("w")[i] for i in range(k)]).alias("h"), "tid", "label", "exact", "grams", "tpos")


def license_hits(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, key, tid, label, exact, grams, diagonal, tpos), once each, for every k-gram of docs that a template has."""
    grams = ", ".join(f"w[i + {j}]" for j in range(k))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.expr(words_of("text")).alias("w")).filter(F.size("w") >= k)
    rows = rows.select("doc_id", "key", F.posexplode(F.expr(f"transform(sequence(0, size(w) - {k}), i -> xxhash64({grams}))")).alias("pos", "h"))
    hits = rows.join(F.broadcast(templates(docs.sparkSession, k)), "h")
    return hits.groupBy("doc_id", "key", "tid", "label", "exact", "grams", (F.col("pos") - F.col("tpos")).alias("diagonal"), "tpos").agg(F.count("*").alias("n"))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Places of license phrases and labels of license notices for every row of docs.

    doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.
    A null text counts as empty: no words, no labels, score 0. Repeated rows
    are returned as often as they come and equal rows get equal results; rows
    with the same doc_id and other texts are told apart by the texts' hash.
    Extra columns are not read; an empty table gives an empty result.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hits = license_hits(source)
    spot = ["doc_id", "key", "tid", "label", "exact", "grams"]
    votes = hits.groupBy(*spot, "diagonal").agg(F.collect_set("tpos").alias("seen"))
    by_template = Window.partitionBy("doc_id", "key", "tid").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal", 1).over(by_template) > NEIGHBOURS).cast("int")
    spans = votes.withColumn("span", F.sum(F.coalesce(apart, F.lit(0))).over(by_template))
    whole = F.col("exact") & (F.size("seen") == F.col("grams"))
    spans = spans.groupBy(*spot, "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("covered"),
        F.count_if(whole).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last"),
    )
    share = F.when(F.col("exact"), F.when(F.col("places") > 0, 1.0).otherwise(0.0)).otherwise(F.col("covered") / F.col("grams"))
    found = spans.withColumn("share", share).groupBy("doc_id", "key").agg(
        F.sum("places").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("places") > 0, F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.sort_array(F.collect_set(F.when(F.col("share") >= VERIFIED, F.col("label"))))).alias("labels"),
        F.max("share").alias("score"),
    )
    found = found.withColumnsRenamed({"doc_id": "of", "key": "at"})
    words = source.select("doc_id", F.xxhash64("text").alias("key"), F.expr(f"cast(size({words_of('text')}) as long)").alias("n_words"))
    rows = words.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("at")), "left")
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.round(F.coalesce("score", F.lit(0.0)), 6).alias("score"),
    )
