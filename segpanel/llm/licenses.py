"""Licence scans by exact set-similarity join.

A text block is a run of consecutive words of the whole text, across line breaks and comment marks, half as
long again as the template; it meets the template if it holds at least ``threshold`` of the
template's distinct words. Words are ordered by how many documents hold them, rarest first. A block that meets a
template holds one of the template's first ``size - need + 1`` words in that order (prefix filter), has
at least ``need`` words of it (length filter), and these lie within the block (positional filter); what
passes is verified on the whole sets. It is enough to try blocks that start at a template word. The templates
are a parameter and small, so their words and prefixes travel to the text, and no text is shuffled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segpanel.llm.stage import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    label: str
    text: str


#: Notices as their licences word them.
TEMPLATES = (
    Template("mit", "Released under the MIT License."),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                    "associated documentation files, to deal in the Software without restriction"),
    Template("apache", "Licensed under the Apache License, Version 2.0."),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                    "General Public License as published by the Free Software Foundation"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met"),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    Template("cc-by", "Licensed under the Creative Commons Attribution 4.0 International License."),
)


def bare(text: Column) -> Column:
    """Words of a text, lower-cased and joined by one blank."""
    return F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), NO_WORD, " "))


def word_list(text: str) -> list[str]:
    words = "".join(c if "a" <= c <= "z" or c.isascii() and c.isdigit() or ord(c) > 127 else " "
                    for c in text.translate(str.maketrans(UPPER, LOWER))).split(" ")
    return [w for w in words if w]


def word_set(text: str) -> list[str]:
    return sorted(set(word_list(text)))


def _words(c: Column) -> Column:
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, " "))


def scan_base(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, row_key, n_words, n_base, first_word, last_word, base (labels), hits (words of ``vocabulary``).

    Words are laid out as " word " each, so every place of a phrase is found, neighbours too.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), bare(text).alias("_bare"))
    rows = rows.withColumn("n_words", F.when(F.col("_bare") == "", 0).otherwise(
        F.length("_bare") - F.length(F.translate("_bare", " ", "")) + 1).cast("long"))
    rows = rows.withColumn("_laid", F.when(F.contains("_bare", F.lit("license")), F.concat(
        F.lit(" "), F.replace("_bare", F.lit(" "), F.lit("  ")), F.lit(" "))))
    rows = rows.withColumn("_back", F.reverse("_laid"))
    places, firsts, lasts, labels = F.lit(0), [], [], []

    def words_before(c: Column, at: Column) -> Column:
        head = F.substr(c, F.lit(1), at - 1)
        return (F.length(head) - F.length(F.translate(head, " ", ""))) / 2
    for phrase, label in PHRASES.items():
        laid = " " + phrase.replace(" ", "  ") + " "
        found = F.coalesce(F.length("_laid") - F.length(F.replace("_laid", F.lit(laid), F.lit(""))), F.lit(0)) / len(laid)
        at, end = F.instr("_laid", laid), F.instr("_back", laid[::-1])
        places = places + found
        firsts.append(F.when(at > 0, words_before(F.col("_laid"), at)))
        lasts.append(F.when(at > 0, F.col("n_words") - len(phrase.split()) - words_before(F.col("_back"), end)))
        labels.append(F.when(at > 0, F.lit(label)))
    return rows.select(
        "doc_id", "row_key", "n_words", places.cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"), F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
        F.array_intersect(F.array(*map(F.lit, vocabulary)), _words(F.col("_bare"))).alias("hits"))


def span(template: Template) -> int:
    """Words of a block: half as many again as the template has, for marks and line numbers between the lines."""
    n = len(word_list(template.text))
    return n + -(-n // 2)


def matching_blocks(docs: DataFrame, templates: tuple[Template, ...], order: dict[str, int], threshold: float) -> DataFrame:
    """doc_id, row_key, label, template (its number), overlap, containment, spans for every template of which a text holds enough words.

    ``order`` is the global place of every template word (by document frequency). overlap and containment are
    those of the best block, null where none meets the template; ``spans`` has, for each block that does, the places
    of the word with which it does (``end``) and of its first word (``start``).
    """
    sets = [sorted(word_set(t.text), key=order.__getitem__) for t in templates]
    needs = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
    prefixes = [s[:len(s) - need + 1] for s, need in zip(sets, needs)]
    probes = sorted({w for p in prefixes for w in p})
    vocabulary = sorted({w for s in sets for w in s})
    # Texts that hold a prefix word; tested before anything is split.
    probe = "(?<![a-z0-9\\x{80}-\\x{10FFFF}])(?:" + "|".join(probes) + ")(?![a-z0-9\\x{80}-\\x{10FFFF}])"
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), F.translate(text, UPPER, LOWER).alias("_low")).filter(F.col("_low").rlike(probe))
    # Template words of the text with their places; other words cannot add to an overlap.
    laid = F.transform(_words(bare(F.col("_low"))), lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    rows = rows.select("doc_id", "row_key", F.filter(laid, lambda x: x["word"].isin(vocabulary)).alias("_hits")).filter(F.size("_hits") >= min(needs))
    each = F.array(*[F.struct(
        F.lit(k).alias("template"), F.lit(t.label).alias("label"), F.lit(len(s)).alias("size"), F.lit(need).alias("need"),
        F.lit(span(t)).alias("span"), F.array(*map(F.lit, s)).alias("words"), F.array(*map(F.lit, p)).alias("prefix"),
    ) for k, (t, s, need, p) in enumerate(zip(templates, sets, needs, prefixes))])
    rows = rows.select("doc_id", "row_key", "_hits", F.inline(each))
    rows = rows.withColumn("_own", F.filter("_hits", lambda x: F.array_contains(F.col("words"), x["word"]))).drop("_hits")
    rows = rows.filter(F.size("_own") >= F.col("need"))
    # Starts from which ``need`` template words lie within the block.
    far = F.slice("_own", F.col("need"), F.size("_own"))
    starts = F.zip_with(F.slice("_own", F.lit(1), F.size("_own") - F.col("need") + 1), F.transform(far, lambda x, i: F.struct(x["at"].alias("at"), i.alias("i"))),
                        lambda a, b: F.struct(b["i"].alias("i"), a["at"].alias("at"), (b["at"] < a["at"] + F.col("span")).alias("near")))
    blocks = F.transform(F.filter(starts, lambda a: a["near"]), lambda a: F.filter(
        F.slice("_own", a["i"] + 1, F.col("span")), lambda x: x["at"] < a["at"] + F.col("span")))
    rows = rows.withColumn("_blocks", F.filter(blocks, lambda b: F.exists(b, lambda x: F.array_contains(F.col("prefix"), x["word"])))).drop("_own")
    # Each template word where the block holds it first.
    firsts = F.transform("_blocks", lambda b: F.filter(b, lambda x, i: F.array_position(F.transform(b, lambda y: y["word"]), x["word"]) == i + 1))
    rows = rows.withColumn("_met", F.filter(firsts, lambda b: F.size(b) >= F.col("need"))).drop("_blocks")
    # No filter on _met: it would be pushed through the projections, and the arrays below be made anew for every start.
    return rows.select(
        "doc_id", "row_key", "label", "template", F.array_max(F.transform("_met", lambda b: F.size(b))).alias("overlap"), "size",
        F.transform("_met", lambda b: F.struct(F.element_at(b, F.col("need"))["at"].alias("end"), b[0]["at"].alias("start"))).alias("spans"),
    ).withColumn("containment", F.col("overlap") / F.col("size")).drop("size")


def _apart(spans: Column) -> Column:
    """The greatest number of spans that do not overlap."""
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(F.array_sort(spans), start, lambda a, x: F.when(
        x["start"] > a["end"], F.struct(x["end"].alias("end"), (a["n"] + 1).alias("n"))).otherwise(a), lambda a: a["n"])


def document_frequencies(hits: DataFrame) -> DataFrame:
    """word, n: documents that hold it. As many rows as the templates have words."""
    return hits.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def license_labels(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = 0.9) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks for every row.

    score is 1 where a phrase stands, else the greatest containment of a block found, else 0;
    n_blocks is the greatest number of blocks found that do not overlap. Null and
    empty texts have no words and no labels; repeated rows get a row each; other columns are not looked at.
    """
    vocabulary = sorted({w for t in templates for w in word_set(t.text)})
    base = staged(scan_base(docs, vocabulary), "licence-base")
    counts = {r["word"]: r["n"] for r in document_frequencies(base).collect()}  # one row for each template word at most
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    blocks = matching_blocks(docs.select("doc_id", "text"), templates, order, threshold)
    found = blocks.groupBy("row_key").agg(
        F.collect_set(F.when(F.size("spans") > 0, F.col("label"))).alias("found"), F.max("containment").alias("best"), _apart(F.flatten(F.collect_list("spans"))).alias("blocks"))
    out = base.join(found, "row_key", "left")
    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("blocks", F.lit(0)).cast("long").alias("n_blocks"))
