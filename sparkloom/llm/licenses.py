"""License notices in texts: diagonal voting over rolling word grams, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER

#: The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices and license texts that the method adds, as (text, label). A span counts with MIN_SHARE of its words in place.
NOTICES = (
    ("Licensed under the Apache License", "apache-notice"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "apache-2.0"),
    ("Released under the MIT License", "mit-notice"),
    ("Licensed under the MIT License", "mit-notice"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit-text"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "mit-full"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc-full"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd-notice"),
    ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "bsd-full"),
    ("This work is licensed under the GNU General Public License", "gpl-notice"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "gpl-3.0-or-later"),
    ("GNU Lesser General Public License", "lgpl-notice"),
    ("Licensed under the Mozilla Public License", "mpl-notice"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", "mpl-2.0"),
    ("Licensed under CC BY", "cc-notice"),
    ("Creative Commons Attribution", "cc-notice"),
    ("The software is provided \"as is\", without warranty of any kind", "warranty-text"),
)
MIN_SHARE = 0.8
#: Words of the grams that base phrases, and notices, are cut into; the shortest phrases have two, and three.
BASE_WORDS, NOTICE_WORDS = 2, 3
#: Diagonals this near, of one template in one text, are one span with a word added or left out.
NEAR_DIAGONALS = 2
#: What is not in a word, of lower-cased text.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), _BETWEEN), "")


def template_table(spark: SparkSession, notices: Iterable[tuple[str, str]] = NOTICES) -> DataFrame:
    """text, label, base (whether it is a base phrase): what scan() looks for."""
    rows = [*((w, x, True) for w, x in BASE.items()), *((w, x, False) for w, x in notices)]
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(w).alias("text"), F.lit(x).alias("label"), F.lit(b).alias("base")) for w, x, b in rows])))


def _templates(templates: DataFrame) -> DataFrame:
    """Per template gram: hash h, template t, its place q; n words of the template, k of the gram."""
    k = F.when(F.col("base"), BASE_WORDS).otherwise(NOTICE_WORDS)
    table = templates.select(F.xxhash64("text", "label").alias("t"), "label", "base", _words(F.col("text")).alias("w"), k.alias("k")).withColumn("n", F.size("w")).filter("n >= k")
    grams = table.select("t", "label", "base", "n", "k", "w", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("k"))).alias("q"))
    word = lambda i: F.element_at("w", F.col("q") + 1 + i)
    hashed = grams.select(F.when(F.col("base"), F.xxhash64(word(0), word(1))).otherwise(F.xxhash64(word(0), word(1), word(2))).alias("h"), "t", "label", "base", "n", "k", "q")
    # a text's last row: it counts the words and keeps texts without a hit
    last = templates.sparkSession.range(1).select(F.lit(0).cast("long").alias("h"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("n"), F.lit(0).alias("k"), F.lit(0).alias("q"))
    return hashed.unionByName(last)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: DataFrame | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    Every text is cut into words and all its rolling grams (of two words for base phrases, three for notices) are hashed
    and joined to the templates' grams; `templates` is a small table of texts, broadcast. A gram at word p that is the
    q-th of a template votes for diagonal p - q. Votes are counted by text, template and diagonal; diagonals within
    NEAR_DIAGONALS are merged. A span is verified by its distinct places: the template's words that its grams cover must
    reach MIN_SHARE of them, for a base phrase all its grams on one diagonal. The score is the best share.

    Votes are added up within the task that read the text, so only hits are shuffled. Hashes of grams are 64 bits.
    Null and empty texts have no words and score 0. Rows that repeat a doc_id are scanned each: rows are told apart by a
    row number of the scan. An empty table gives no rows. Templates of fewer words than a gram are never found.
    """
    templates = template_table(docs.sparkSession) if templates is None else templates
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), _words(F.col(text)).alias("w"))
    after = lambda i: F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0)))
    places = rows.select("doc_id", "row", F.posexplode(F.arrays_zip(F.concat("w", F.array(F.lit(""))).alias("w0"), after(1).alias("w1"), after(2).alias("w2"))).alias("p", "x"))
    grams = F.when(F.col("x.w0") == "", F.array(F.lit(0).cast("long"))).otherwise(F.array(F.xxhash64("x.w0", "x.w1"), F.xxhash64("x.w0", "x.w1", "x.w2")))
    hits = places.select("doc_id", "row", "p", F.explode(grams).alias("h")).join(F.broadcast(_templates(templates)), "h")
    votes = hits.groupBy("row", "doc_id", "t", "label", "base", "n", "k", (F.col("p") - F.col("q")).alias("diagonal")).agg(F.collect_set("q").alias("places"))  # at most the template's

    # neighbouring diagonals of a template in one text: a new span starts where the step is larger
    by_place = Window.partitionBy("row", "t").orderBy("diagonal")
    step = F.col("diagonal") - F.lag("diagonal").over(by_place)
    whole = F.size("places") == F.col("n") - F.col("k") + 1
    opens = F.col("t").isNull() | F.col("base") | step.isNull() | (step > NEAR_DIAGONALS) | whole | F.lag(whole).over(by_place)
    spans = (votes.withColumn("_span", F.sum(F.when(opens, 1).otherwise(0)).over(by_place))
             .groupBy("row", "doc_id", "t", "label", "base", "n", "k", "_span")
             .agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("diagonal").alias("start")))
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda q: F.sequence(q, q + F.col("k") - 1)))))
    share = F.when(F.col("t").isNotNull(), covered / F.col("n"))
    found = F.when(F.col("base"), F.size("places") == F.col("n") - F.col("k") + 1).otherwise(F.coalesce(share >= MIN_SHARE, F.lit(False)))
    spans = spans.select("row", "doc_id", "t", "label", "base", "start", share.alias("share"), found.alias("found"))
    base_found = F.col("found") & F.col("base")
    labels = lambda c: F.concat_ws(",", F.array_sort(F.collect_set(F.when(c, F.col("label")))))  # noqa: E731  as many as there are templates
    return spans.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("t").isNull(), F.col("start"))).cast("long").alias("n_words"), F.count_if(base_found).alias("n_base"),
        F.min(F.when(base_found, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base_found, F.col("start"))).cast("long").alias("last_word"),
        labels(base_found).alias("base_labels"), labels(F.col("found")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"), F.count_if("found").alias("n_spans")).drop("row")


#: DuckDB SQL for op4's base columns.
BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), starts AS (
  SELECT doc_id, len(ws) AS n, list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'cc' AND ws[i + 1] = 'by') AS c,
         list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'general' AND ws[i + 1] = 'public' AND ws[i + 2] = 'license') AS g,
         list_filter(range(1, len(ws) + 1), lambda i: ws[i] = 'all' AND ws[i + 1] = 'rights' AND ws[i + 2] = 'reserved') AS r
  FROM w
), placed AS (SELECT *, list_concat(list_concat(c, g), r) AS s FROM starts)
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(len(s) AS BIGINT) AS n_base, CAST(list_min(s) - 1 AS BIGINT) AS first_word,
       CAST(list_max(s) - 1 AS BIGINT) AS last_word,
       concat_ws(',', CASE WHEN len(c) > 0 THEN 'cc-by' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(r) > 0 THEN 'reserved' END) AS base_labels
FROM placed
"""
