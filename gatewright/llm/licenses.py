"""License scans: an exact set-similarity join of text blocks with license notices, in DataFrame functions only.

A block is a line, or a window over the words of the whole text, so that notices wrapped over several lines are found too; a window has
as many words as the notice divided by the threshold. A notice is found where the share of its distinct words that the block holds
reaches the threshold. Words are ordered by how many blocks of the corpus hold them; a block that reaches the threshold must hold one of the notice's few rarest words
(prefix filter), be long enough (length filter) and have enough words left from the first common one on (positional filter). What
passes is verified.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that mark a license wherever their words stand consecutively, and the labels.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
# Public notices of licenses, as word lists.
NOTICES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

WORD_CHARS = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # everything else is part of a word; A-Z stand for a-z
WORD, GAP = f"[^{WORD_CHARS}]+", f"[{WORD_CHARS}]+"


def whole_words(alternatives: str) -> str:
    """A pattern for these words as whole words; in Java, (?i) folds A-Z only."""
    return f"(?i)(?<![^{WORD_CHARS}])(?:{alternatives})(?![^{WORD_CHARS}])"


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def phrase_places(text: Column, phrases: dict[str, str] = PHRASES) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base_labels of a text, by the phrases alone."""
    patterns = {label: whole_words(GAP.join(p.split())) for label, p in phrases.items()}
    text = F.coalesce(text, F.lit(""))
    any_of = text.rlike("|".join(f"(?:{p})" for p in patterns.values()))

    def words_in(part: Column) -> Column:
        return F.regexp_count(part, F.lit(WORD)).cast("long")

    firsts, lasts, counts, labels = [], [], [], []
    for label, p in patterns.items():
        there = text.rlike(p)
        counts.append(F.regexp_count(text, F.lit(p)))
        firsts.append(F.when(there, words_in(F.regexp_extract(text, f"(?s)^(.*?){p}", 1))))
        lasts.append(F.when(there, words_in(F.regexp_extract(text, f"(?s)^(.*){p}", 1))))
        labels.append(F.when(there, F.lit(label)))
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    none = F.lit(None).cast("long")
    return {
        "n_words": words_in(text), "n_base": F.when(any_of, total.cast("long")).otherwise(F.lit(0).cast("long")),
        "first_word": F.when(any_of, F.least(*firsts)).otherwise(none), "last_word": F.when(any_of, F.greatest(*lasts)).otherwise(none),
        "_base": F.when(any_of, F.array_compact(F.array(*labels))).otherwise(F.array().cast("array<string>")),
    }


def blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """The lines of every text, as column `_block`, with all other columns but the text."""
    return docs.withColumn("_block", F.explode(F.split(F.col(text), "\n"))).drop(text)


def word_counts(lines: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many blocks of the corpus each word of the notices stands: at most as many rows as they have words."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("_block", F.lit(whole_words("|".join(vocabulary))), F.lit(0)), _lower))
    rows = lines.select(F.explode(found).alias("word")).groupBy("word").count().collect()
    return {r[0]: r[1] for r in rows}


def notices_found(docs: DataFrame, threshold: float = 0.8, notices: list[tuple[str, str]] = NOTICES, text: str = "text") -> DataFrame:
    """All (block, notice) pairs whose containment reaches the threshold: the columns of docs but the text, `label`, `containment`.

    Windows come up as the best one around each rare word of the notice, in texts of several lines only: within a line they hold no
    more than the line. Null and empty texts have no blocks. Repeated rows give repeated pairs. Notices that share a label are found
    separately.
    """
    sets = [(i, label, sorted(set(words.split()))) for i, (label, words) in enumerate(notices)]
    vocabulary = sorted({w for _, _, words in sets for w in words})
    lines = blocks(docs, text)
    count = word_counts(lines, vocabulary)
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (count.get(w, 0), w)))}
    spans = [math.ceil(len(words.split()) / threshold - 1e-9) for _, words in notices]
    prefix, members = [], []
    for i, label, words in sets:
        ordered = sorted(words, key=rank.__getitem__)
        need = math.ceil(threshold * len(words) - 1e-9)
        members.append((i, label, ordered, need, spans[i]))
        prefix += [(w, i, at) for at, w in enumerate(ordered[: len(words) - need + 1])]
    spark = docs.sparkSession
    # both small: as many rows as the notices have words
    heads = F.broadcast(spark.createDataFrame(prefix, "_word string, _notice int, _at int"))
    notice = F.broadcast(spark.createDataFrame(members, "_notice int, label string, _words array<string>, _need int, _span int"))
    order = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])
    rare = sorted({w for w, _, _ in prefix})
    any_rare = whole_words("|".join(rare))
    held_docs = docs.where(F.col(text).rlike(any_rare))
    head = blocks(held_docs, text).where(F.col("_block").rlike(any_rare))
    own = F.array_distinct(F.transform(F.regexp_extract_all("_block", F.lit(whole_words("|".join(vocabulary))), F.lit(0)), _lower))
    own = F.transform(F.array_sort(F.transform(own, lambda w: F.struct(F.element_at(order, w).alias("r"), w.alias("w")))), lambda s: s["w"])
    held = head.withColumn("_own", own)
    kept = [c for c in held.columns if c not in ("_block",)]
    hits = held.select(*kept, F.posexplode("_own").alias("_pos", "_word")).join(heads, "_word").join(notice, "_notice")
    left = F.least(F.size("_words") - F.col("_at"), F.size("_own") - F.col("_pos"))
    # the rarest common word alone decides, so a pair comes up once
    earlier = F.size(F.array_intersect(F.slice("_own", 1, F.col("_pos")), "_words")) == 0
    candidates = hits.where((F.size("_own") >= F.col("_need")) & (left >= F.col("_need")) & earlier)
    common = F.size(F.array_intersect("_own", "_words"))
    verified = candidates.where(common >= F.col("_need")).withColumn("containment", common / F.size("_words"))
    kept = [c for c in docs.columns if c != text]
    wrapped = _windows(held_docs.where(F.col(text).contains("\n")), text, rare, heads, notice, max(spans))
    return verified.select(*kept, "label", "containment").union(wrapped.select(*kept, "label", "containment"))


def _windows(docs: DataFrame, text: str, rare: list[str], heads: DataFrame, notice: DataFrame, longest: int) -> DataFrame:
    """The windows around the rare words, as rows of docs with `label` and `containment`. heads and notice are broadcast."""
    words = docs.withColumn("_all", F.regexp_extract_all(_lower(F.col(text)), F.lit(WORD), F.lit(0))).drop(text)
    places = F.filter(F.sequence(F.lit(1), F.size("_all")), lambda p: F.array_contains(F.array(*map(F.lit, rare)), F.element_at("_all", p)))
    hit = F.transform(places, lambda p: F.struct(
        F.element_at("_all", p).alias("_word"), F.slice("_all", F.greatest(p - (longest - 1), F.lit(1)), F.lit(2 * longest - 1)).alias("_near"), F.least(p, F.lit(longest)).alias("_pos")))
    hits = words.select(*[c for c in words.columns if c != "_all"], F.inline(hit)).join(heads, "_word").join(notice, "_notice")
    start = F.greatest(F.col("_pos") - F.col("_span") + 1, F.lit(1))
    hits = hits.withColumn("_near", F.slice("_near", start, F.col("_pos") - start + F.col("_span")))
    # a window whose rarest common word this is has its other common words among those that follow
    left = F.size(F.array_intersect(F.slice("_words", F.col("_at") + 1, F.size("_words")), "_near"))
    hits = hits.where((F.size("_near") >= F.col("_need")) & (left >= F.col("_need")))
    starts = F.sequence(F.lit(1), F.greatest(F.size("_near") - F.col("_span") + 1, F.lit(1)))
    best = F.array_max(F.transform(starts, lambda s: F.size(F.array_intersect(F.slice("_near", s, F.col("_span")), "_words"))))
    return hits.withColumn("_best", best).where(F.col("_best") >= F.col("_need")).withColumn("containment", F.col("_best") / F.size("_words"))


def scan(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels (phrases and notices), score (0 to 1).

    The score is 1 where a phrase stands, else the largest containment found, else 0. Null texts are empty. Rows of equal id and
    text get equal results.
    """
    key = [F.col(id_col).alias("_doc"), F.xxhash64(text).alias("_hash"), F.length(text).alias("_length")]
    mine = docs.select(F.col(id_col), *key, *[c.alias(n) for n, c in phrase_places(F.col(text)).items()])
    found = notices_found(docs.select(*key, F.col(text).alias("text")), threshold)
    by = found.groupBy("_doc", "_hash", "_length").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_best"))
    by = by.toDF("_d", "_h", "_n", "_labels", "_best")
    joined = mine.join(by, F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_hash") == F.col("_h")) & (F.col("_length") == F.col("_n")), "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("_base"), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union("_base", F.coalesce("_labels", empty))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0))).alias("score"),
    )
