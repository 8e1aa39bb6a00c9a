"""Operator 8: license scan by an exact set-similarity join, with DataFrame functions only.

Templates are dealt into size classes, and for each class texts are cut into word blocks that overlap by
half and are at least twice as long as its templates, so that a notice of any length lies in one of
them. A block meets a template of its class if it holds at least ``CONTAINMENT`` of the template's
distinct words. Words that templates use are ordered by their frequency in the whole corpus, rarest
first. To hold enough of a template a block must hold one of the first words of its order (prefix
filter), must have enough template words at all (length filter), and must have enough left from the
first common word on (positional filter); pairs that pass are verified by counting. No pair that meets
the threshold is lost, and no template.

Besides, phrases are looked up word by word. Cases: null text counts as empty (no words, no labels);
repeated rows give repeated results; an empty table an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_BLOCK = 64
CONTAINMENT = 0.9

#: The phrases to look up, with their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Notices that license texts ask to be used, and two whole licenses, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("gpl-3", "Licensed under the GNU General Public License, version 3"),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        " the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS"
        " ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE"
        " AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE,"
        " DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE"
        " OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal"
        " in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,"
        " sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the"
        " following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE"
        " WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
)

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a lower-cased text.

    ``lower`` also changes letters beyond A-Z, which moves no word's bounds and makes no word of
    the phrases and templates out of another.
    """
    return F.array_remove(F.split(F.lower(text), _BREAK), "")


def _in_order(notice: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in notice.lower()).split()


def template_words(notice: str) -> list[str]:
    """Distinct words of an ASCII notice."""
    return sorted(set(_in_order(notice)))


def block_length(notice: str) -> int:
    """Words in a block of the notice's size class: a power of two, at least twice the notice."""
    return max(LEAST_BLOCK, 1 << (2 * len(_in_order(notice)) - 1).bit_length())


def _with_words(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text (``mark``), and its words; the words are made once (generator)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        "doc_id", F.xxhash64("text").alias("mark"), F.explode(F.array(words_of(F.col("text")))).alias("words")
    )


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """Template words by frequency in the corpus, rarest first. At most one row per template word."""
    wanted = F.array(*map(F.lit, vocabulary))
    some = _with_words(docs).where(F.arrays_overlap("words", wanted))
    each = some.select(F.explode(F.filter("words", lambda w: w.isin(vocabulary))).alias("word"))
    found = {r["word"]: r["n"] for r in each.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (found.get(w, 0), w))


def _template_rows(order: list[str], templates, containment: float) -> list[tuple]:
    """One row for each template and each word of its prefix."""
    rank, rows = {w: i for i, w in enumerate(order)}, []
    for number, (label, notice) in enumerate(templates):
        own = sorted(template_words(notice), key=rank.__getitem__)
        need = math.ceil(containment * len(own) - 1e-9)
        for place in range(len(own) - need + 1):
            rows.append((number, label, own, len(own), need, own[place], place, block_length(notice)))
    return rows


def block_matches(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """Blocks that meet a template.

    Block k of length n starts at word k * n / 2; n is ``block_length`` of the template, which must have
    a word. Returns doc_id, mark (hash of the text), length, block, template (its number), label and share
    (the part of the template's words that the block holds).
    """
    spark = docs.sparkSession
    if any(not template_words(notice) for _, notice in templates):
        raise ValueError("a template without words meets everything")
    vocabulary = sorted({w for _, notice in templates for w in template_words(notice)})
    order = word_order(docs, vocabulary)
    prefix_rows = _template_rows(order, templates, containment)
    prefixes = spark.createDataFrame(
        prefix_rows, "template int, label string, own array<string>, size int, need int, word string, place int, length int"
    )
    # a block that meets a template holds one of its prefix words: other texts are left aside here
    rare = sorted({r[5] for r in prefix_rows})
    rank = F.create_map(*[F.lit(x) for i, w in enumerate(order) for x in (w, i)])
    some = _with_words(docs).where(F.arrays_overlap("words", F.array(*map(F.lit, rare))))
    hits = some.select("doc_id", "mark", F.posexplode("words").alias("at", "word")).where(F.col("word").isin(vocabulary))
    # a word goes to the two blocks that hold it in each class that has the word
    classes = {}
    for _, notice in templates:
        classes.setdefault(block_length(notice), set()).update(template_words(notice))
    number = lambda n: (F.col("at") / (n // 2)).cast("long")
    spots = [
        F.when(F.col("word").isin(sorted(own)), F.struct(F.lit(n).alias("length"), (number(n) - back).alias("block")))
        for n, own in sorted(classes.items())
        for back in (0, 1)
    ]
    blocks = (
        hits.select("doc_id", "mark", "word", F.inline(F.array_compact(F.array(*spots))))
        .groupBy("doc_id", "mark", "length", "block")
        .agg(F.collect_set("word").alias("held"))
        .select("doc_id", "mark", "length", "block", F.expr("array_sort(held)").alias("held"))
    )
    ranked = F.transform(F.array_sort(F.transform("held", lambda w: F.struct(rank[w].alias("rank"), w.alias("word")))), lambda s: s["word"])
    ordered = blocks.select("doc_id", "mark", "length", "block", F.explode(F.array(ranked)).alias("held"))
    probes = ordered.select("doc_id", "mark", "length", "block", "held", F.posexplode("held").alias("spot", "word"))
    pairs = (
        probes.join(F.broadcast(prefixes), ["word", "length"])  # rows: words of all templates, fixed
        .where(F.size("held") >= F.col("need"))
        .where(F.least(F.col("size") - F.col("place"), F.size("held") - F.col("spot")) + F.least("place", "spot") >= F.col("need"))
        .withColumn("share", F.size(F.array_intersect("held", "own")) / F.col("size"))
    )
    met = pairs.where(F.size(F.array_intersect("held", "own")) >= F.col("need"))
    return met.groupBy("doc_id", "mark", "length", "block", "template", "label").agg(F.max("share").alias("share"))


def phrase_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words."""
    parts = phrase.split()
    same = lambda i: F.get(words, i) == parts[0]
    def all_same(i: Column) -> Column:
        ok = same(i)
        for k, part in enumerate(parts[1:], 1):
            ok = ok & (F.get(words, i + k) == part)
        return F.coalesce(ok, F.lit(False))
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), all_same)


def license_scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """License labels of every whole text.

    Returns doc_id, n_words, n_base (places of phrases), first_word and last_word (their smallest and
    largest start; null without any), base_labels and labels (the templates' too; distinct, sorted,
    comma-joined) and score: 1 with a phrase, else the largest share of a template met, else 0.
    """
    # rows are matched by doc_id and text hash; rows equal in both have equal results
    none = F.array().cast("array<int>")
    words = F.col("words")
    placed = _with_words(docs)
    places, ready = [], placed
    for k, (phrase, _) in enumerate(phrases):
        # the rarest word is asked first, so that other texts aren't walked
        key = F.array(F.lit(max(phrase.split(), key=len)))
        first = F.arrays_overlap(words, key) & F.arrays_overlap(words, F.array(F.lit(phrase.split()[0])))
        places.append(F.when(first, phrase_places(words, phrase)).otherwise(none).alias(f"at_{k}"))
    ready = placed.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"), *places)
    every = F.concat(*[F.col(f"at_{k}") for k in range(len(phrases))])
    found = F.array_compact(F.array(*[F.when(F.size(f"at_{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases)]))
    base = ready.select(
        "doc_id",
        "mark",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(found)).alias("base"),
    )
    met = block_matches(docs, templates, containment)
    own = met.groupBy(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark")).agg(
        F.collect_set("label").alias("own"), F.max("share").alias("share")
    )
    both = base.join(own, base["doc_id"].eqNullSafe(own["own_id"]) & (base["mark"] == own["own_mark"]), "left")
    nothing = F.array().cast("array<string>")
    return both.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", nothing))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
