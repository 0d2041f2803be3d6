"""License scan by diagonal voting, with DataFrame functions alone.

Every rolling 2-gram of a document's words is joined by its hash (and then by its words) to the places
at which the templates have it.  A match votes for the diagonal document place - template place.
Votes are summed by diagonal; neighbouring diagonals, which an inserted or missing word shifts, are
merged; a merged span is verified by the best of its windows of at most ``STRETCH`` templates in length: the
share of distinct template places that the window's votes cover.  So stray matches beside a notice, which may
lengthen a span, do not hide it.  The templates are a fixed table, so they are broadcast whatever the corpus;
documents are scanned once, and only matches and one row per document are shuffled.

Results that are defined: a null text counts as empty (no words, no places, null first and last word);
rows that repeat an id are scanned one by one; a text of any length counts whole; extra columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import narrow

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"
#: Phrases whose exact places are counted.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Opening words of public licence notices; a place covers one in part.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-4.0": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "copyright": "copyright c all rights reserved",
    "gpl-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
}
#: Short reference lines, each a template of its own length beside the notices; 0.7 of one takes its name and version.
REFERENCES = [
    ("apache-2.0", "the apache license version 2 0"),
    ("bsd", "the bsd license"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("bsd", "2 clause bsd license"),
    ("bsd", "3 clause bsd license"),
    ("isc", "the isc license"),
    ("mit", "the mit license"),
    ("mit", "under mit license"),
    ("mpl-2.0", "the mozilla public license version 2 0"),
    ("mpl-2.0", "the mozilla public license v 2 0"),
]
#: Diagonals at most so far apart are one span; it must cover this share of a notice's 2-grams.
GAP = 2
COVER = 0.7
STRETCH = 1.5
UNIT = 1 << 20


def templates(spark: SparkSession) -> DataFrame:
    """(h, a, b, template, label, exact, tpos, grams) of every 2-gram of every template."""
    rows = []
    for exact, table in ((True, BASE.items()), (False, [*NOTICES.items(), *REFERENCES])):
        for label, text in table:
            words = text.split()
            grams = list(zip(words, words[1:]))
            assert len(grams) <= 62, label  # places fit the bits of a long
            rows += [(a, b, text, label, exact, i, len(grams)) for i, (a, b) in enumerate(grams)]
    table = spark.createDataFrame(rows, "a string, b string, template string, label string, exact boolean, tpos int, grams int")
    return table.select(F.xxhash64("a", "b").alias("h"), "a", "b", "template", "label", "exact", "tpos", "grams")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(1))


def _votes(docs: DataFrame) -> DataFrame:
    """Matches of all documents, and one row for each document (without a label) that carries n_words."""
    words = docs.select("doc_id", F.monotonically_increasing_id().alias("row_key"), words_of(F.col("text")).alias("w"))
    pairs = words.select(
        "doc_id",
        "row_key",
        F.size("w").cast("long").alias("n_words"),
        F.posexplode_outer(F.arrays_zip(F.col("w").alias("a"), F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("b"))).alias("dpos", "g"),
    )
    grams = pairs.select("doc_id", "row_key", "n_words", "dpos", F.col("g.a").alias("da"), F.col("g.b").alias("db"), F.xxhash64("g.a", "g.b").alias("dh"))
    table = templates(docs.sparkSession)
    same = (F.col("dh") == F.col("h")) & (F.col("da") == F.col("a")) & (F.col("db") == F.col("b"))
    joined = grams.join(F.broadcast(table), same, "left")  # a fixed table of a few hundred rows
    kept = joined.where(F.col("label").isNotNull() | (F.coalesce("dpos", F.lit(0)) == 0))
    return kept.select("doc_id", "row_key", "n_words", "template", "label", "exact", "grams", "tpos", "dpos")


def license_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Merged diagonals: row_key, doc_id, n_words, label, exact, first_word, end_word, score, verified.

    A document without matches has one row without a label.
    """
    votes = _votes(narrow(df, id_col, text_col)).repartition("row_key")
    votes = votes.withColumn("diagonal", F.col("dpos") - F.col("tpos"))
    # Votes of an exact phrase stay on their own diagonal; for notices neighbours merge.
    by = ["row_key", "template", "label", "exact"]
    order = Window.partitionBy(*by).orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(order) <= F.when(F.col("exact"), 0).otherwise(GAP), 0).otherwise(1)
    marked = votes.withColumn("new", apart).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # A window of a span begins at a vote and reaches as far as a notice may be stretched.  Places are scaled, so that
    # one frame fits all templates: d places times floor(UNIT / reach) are within UNIT exactly where d <= reach < 1000.
    reach = F.floor(STRETCH * (F.col("grams") + 1) - 2)
    scaled = F.col("dpos").cast("long") * F.floor(UNIT / reach)
    window = Window.partitionBy(*by, "span").orderBy("scaled").rangeBetween(Window.currentRow, UNIT)
    windows = marked.withColumn("scaled", scaled).select(
        *by,
        "span",
        "doc_id",
        "n_words",
        "grams",
        "dpos",
        F.bit_count(F.expr("bit_or(shiftleft(1L, tpos))").over(window)).alias("covered"),
        F.max("dpos").over(window).alias("high"),
    )
    best = F.struct("covered", (-F.col("high") + F.col("dpos")).alias("shortness"), (-F.col("dpos")).alias("early"), "dpos", "high")
    spans = windows.groupBy(*by, "span").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.first("grams").alias("grams"),
        F.max(best).alias("best"),
    )
    score = F.when(F.col("label").isNull(), 0.0).otherwise(F.col("best.covered") / F.col("grams"))
    verified = F.when(F.col("exact"), score == 1).otherwise(score >= COVER)
    return spans.select(
        "row_key",
        "doc_id",
        "n_words",
        "label",
        "exact",
        F.col("best.dpos").cast("long").alias("first_word"),
        (F.col("best.high") + 2).cast("long").alias("end_word"),
        score.alias("score"),
        F.coalesce(verified, F.lit(False)).alias("verified"),
    )


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spans = license_spans(df, id_col, text_col)
    base = F.col("verified") & F.col("exact")

    def labels(condition: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("label")))), ",")

    found = spans.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("verified")).alias("labels"),
        F.max(F.when(F.col("verified"), F.col("score")).otherwise(0.0)).alias("score"),
    )
    return found.drop("row_key")
