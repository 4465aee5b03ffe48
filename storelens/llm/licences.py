"""Operator 10: licence scans by diagonal voting, in DataFrame functions only.

All rolling hashes of two consecutive words of every text are joined to the
places of the same hashes in licence templates. Each match votes for the
diagonal "place in the text less place in the template", verified by comparing
its words with the template's. Votes are gathered by diagonal, and neighbouring
diagonals (words put in or left out) are merged into spans. A word of the
template counts once in a span, on however many diagonals it stands.

A phrase template counts only where it stands word for word: a diagonal with
all its votes. Sentence templates give a label where the share of the
template's words found in one span reaches COVERAGE, if the span holds all words
that tell the template from similar ones of other labels.

A null or empty text has no words, labels or places and score 0. Repeated rows
are rows of their own. Kept columns may have any names but those of the added ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 2
# A template's label needs this share of its words in one span.
COVERAGE = 0.7
# Diagonals at most so far apart are one span.
DRIFT = 3
# Templates are broadcast; a longer list is refused.
MOST_TEMPLATE_WORDS = 200_000

# Fixed phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Fixed sentences of public licence notices.
SENTENCES = (
    ("all rights reserved", "all-rights-reserved"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of letters and digits, A-Z lower-cased; all characters beyond ASCII count as letters."""
    split = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), SEPARATORS)
    return F.array_remove(split, "")


def gram_hashes(found: Column, size: int = GRAM) -> Column:
    """Rolling hashes of `size` words in order; empty for shorter lists."""
    spots = F.when(F.size(found) >= size, F.sequence(F.lit(0), F.size(found) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.xxhash64(*[F.get(found, i + k) for k in range(size)]))


def own_places(sentence: str, label: str, sentences) -> list[int]:
    """Places of the words that a sentence has and a similar one of another label (COVERAGE of its words) has not."""
    mine, own = sentence.split(), set()
    for other, its in sentences:
        lacking = {i for i, word in enumerate(mine) if word not in other.split()}
        if its != label and len(mine) - len(lacking) >= COVERAGE * len(mine):
            own |= lacking
    return sorted(own)


def templates(spark, phrases=PHRASES, sentences=SENTENCES) -> DataFrame:
    """One row per template: number, label, whether it is a phrase, its words, their number and its own_places()."""
    rows = [(text, label, True, []) for text, label in phrases] + [(text, label, False, own_places(text, label, sentences)) for text, label in sentences]
    if sum(len(r[0].split()) for r in rows) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MOST_TEMPLATE_WORDS} words")
    made = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(t).alias("text"), F.lit(x).alias("label"), F.lit(p).alias("phrase"), F.array(*map(F.lit, o)).cast("array<int>").alias("own")) for i, (t, x, p, o) in enumerate(rows)))
    listed = spark.range(1).select(F.explode(made).alias("t")).select("t.*")
    return listed.select("template", "label", "phrase", "own", words(F.col("text")).alias("t_words")).withColumn("size", F.size("t_words"))


def votes(docs: DataFrame, listed: DataFrame, keep: list[str], text: str) -> DataFrame:
    """Every match of a text's word pair with a template's, and one row without a template for each text."""
    places = listed.select("template", "label", "phrase", "own", "t_words", "size", F.posexplode(gram_hashes(F.col("t_words"))).alias("offset", "hash"))
    # Kept columns travel as one, so that none of their names can clash.
    kept = F.struct(*keep) if keep else F.struct(F.lit(1).alias("_"))
    split = docs.select(kept.alias("_keep"), F.monotonically_increasing_id().alias("_row"), words(F.col(text)).alias("_words"))
    split = split.withColumn("_grams", F.concat(F.array(F.lit(None).cast("long")), gram_hashes(F.col("_words"))))
    rolled = split.select("_keep", "_row", "_words", F.posexplode("_grams").alias("_place", "_gram"))
    met = rolled.join(F.broadcast(places), F.col("_gram") == F.col("hash"), "left")
    same = F.lit(True)
    for k in range(GRAM):
        same = same & (F.get("_words", F.col("_place") - 1 + k) == F.get("t_words", F.col("offset") + k))
    met = met.where(F.col("_place").eqNullSafe(F.lit(0)) | (F.col("hash").isNotNull() & same))
    return met.select(
        "_keep", "_row", F.size("_words").cast("long").alias("n_words"), "template", "label", "phrase", "own", "size",
        (F.col("_place") - 1 - F.col("offset")).alias("diagonal"), "offset",
    )


def spans(found: DataFrame) -> DataFrame:
    """Merged spans: one row per text, template and run of neighbouring diagonals, with the share of the template's
    words found, whether its own_places() are among them, the span's first and last start and, for a phrase, the
    number of its places; and a row without a template for each text."""
    text = ["_keep", "_row", "n_words"]
    # Placed by text once; all later groups and windows lie within one. A list of offsets is no longer than its template.
    lines = found.repartition("_row").groupBy(*text, "template", "label", "phrase", "own", "size", "diagonal").agg(F.collect_set("offset").alias("offsets"))
    # A phrase stands where its diagonal has all votes.
    whole = F.size("offsets") == F.col("size") - GRAM + 1
    lines = lines.where(F.col("template").isNull() | ~F.col("phrase") | whole)
    order = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("phrase") | (F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT), F.lit(True))
    runs = lines.withColumn("run", F.when(~F.col("phrase"), F.sum(apart.cast("int")).over(order)))
    # Taken apart again, so that a run of very many diagonals holds each offset once.
    parts = runs.select("*", F.explode_outer("offsets").alias("offset"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("offset"), lambda o: F.sequence(o, o + GRAM - 1))))
    return parts.groupBy(*text, "template", "label", "phrase", "own", "size", "run").agg(
        F.when(F.col("phrase"), F.count_if(F.col("offset") == 0)).alias("places"),
        F.min("diagonal").cast("long").alias("first"),
        F.max("diagonal").cast("long").alias("last"),
        F.when(F.col("template").isNotNull(), F.size(covered) / F.col("size")).alias("share"),
        (F.size(F.array_except("own", covered)) == 0).alias("own_found"),
    )


def scan(docs: DataFrame, keep: list[str], text: str = "text", phrases=PHRASES, sentences=SENTENCES) -> DataFrame:
    """`keep` columns, `n_words`, `n_base` (places of all phrases), `first_word`, `last_word`, `base_labels`,
    `labels` (the sentences' too) and `score` (the best verified share), for every row of `docs`."""
    listed = templates(docs.sparkSession, phrases, sentences)
    found = spans(votes(docs, listed, keep, text))
    said = F.col("phrase") | ((F.col("share") >= COVERAGE) & F.col("own_found"))
    base = F.col("phrase")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    done = found.groupBy("_keep", "_row", "n_words").agg(
        F.coalesce(F.sum("places"), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("last"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined(F.when(said, F.col("label"))).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return done.select(*(F.col("_keep")[c].alias(c) for c in keep), *done.columns[2:])
