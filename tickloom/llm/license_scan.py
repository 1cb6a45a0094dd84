"""License scans by an exact set-similarity join of text blocks with license templates.

A text's words are cut into overlapping blocks of three times the longest template's words, a new one each time that many words on, so
every run of up to twice those words and one more (33) lies within one, whatever stands between a grant's words. A block matches a template if it holds at least ``threshold`` of the template's distinct words.
The words of all templates are ordered by how many documents hold them, rarest first; a block that matches must hold one
of a template's first words in that order (prefix filter), be long enough (length filter), and have enough words left
behind the first shared one (positional filter). Candidates meet in a join on those words and are verified in full.

All of it is DataFrame expressions.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.bind import let

# Words after lower-casing are runs of ASCII digits, ASCII letters and all other characters beyond ASCII.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases and labels of the base.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Words of a block, in words of the longest template.
BLOCK = 3

# Sentences by which common licenses are granted, without version numbers.
TEMPLATES = (
    ("apache", "licensed under the apache license version"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("gpl", "this work is licensed under the gnu general public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("public-domain", "this is free and unencumbered software released into the public domain"),
    ("reserved", "copyright all rights reserved"),
)


def words_of(text: Column) -> Column:
    """Only A-Z are lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), BETWEEN), "")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def rarity(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """``vocabulary`` by the number of documents that hold a word, rarest first; ties by code point. One row per word reaches the driver."""
    held = docs.select(F.explode(F.array_intersect(words_of(F.col("text")), _strings(vocabulary))).alias("word"))
    seen = dict(held.groupBy("word").count().collect())
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def _places(words: Column, phrases: dict[str, str]) -> Column:
    """The places of all phrases, as an array of (start, label), phrase by phrase."""
    return F.concat(*[_places_of(words, phrase.split(), label) for phrase, label in phrases.items()])


def _places_of(words: Column, phrase: list[str], label: str) -> Column:
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull())
    whole = F.filter(starts, lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(phrase) if k]))
    places = F.transform(whole, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    return F.when(_all([F.array_contains(words, w) for w in phrase]), places).otherwise(none)


def _all(parts: list[Column]) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & F.coalesce(p, F.lit(False))
    return out


def scan_licenses(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = 0.9) -> DataFrame:
    """(doc_id, n_words, places, blocks, score) for every row of ``docs`` (doc_id, text).

    ``places`` lists (start, label) of the consecutive words of every phrase, ``blocks`` the sorted (start, label, containment) of
    every block that holds at least ``threshold`` of a template's distinct words; ``start`` counts words from 0. ``score`` is the largest
    containment of those, 1 if there is a place, else 0. A missing text counts as empty; a text without words has neither places nor
    blocks. Rows are scanned one by one: repeated rows repeat, a null id stays null, an empty table gives no rows, other columns are ignored.
    """
    kinds = [(label, sorted(set(text.split()))) for label, text in templates]
    order = rarity(docs, sorted({w for _, ws in kinds for w in ws}))
    place = {w: i for i, w in enumerate(order)}
    stride = max(len(text.split()) for _, text in templates)
    rows = []
    for label, ws in kinds:
        ws = sorted(ws, key=place.get)
        least = math.ceil(threshold * len(ws) - 1e-9)
        rows += [(label, w, k, least, ws) for k, w in enumerate(ws[: len(ws) - least + 1])]
    prefixes = sorted({r[1] for r in rows})
    # bounded by the templates given, whatever the documents
    table = docs.sparkSession.createDataFrame(rows, "label string, word string, at int, least int, template array<string>")

    def blocks(words: Column) -> Column:
        begins = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), F.lit(stride))
        each = F.transform(begins, lambda s: let(F.slice(words, s + 1, BLOCK * stride), lambda b: F.struct(
            s.cast("long").alias("start"), F.array_intersect(_strings(order), b).alias("held"))))
        some = F.filter(each, lambda b: F.arrays_overlap(b["held"], _strings(prefixes)))
        return F.when(F.arrays_overlap(words, _strings(prefixes)), some)

    row = let(words_of(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), _places(w, phrases).alias("places"), blocks(w).alias("blocks")))
    scanned = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), row.alias("r"))
    scanned = scanned.select("row", "doc_id", "r.n_words", "r.places", F.explode_outer("r.blocks").alias("block"))
    tokens = scanned.select("*", F.explode_outer(F.array_intersect(F.col("block.held"), _strings(prefixes))).alias("word"))
    met = tokens.join(F.broadcast(table), "word", "left")
    # the filters: enough words in the block, and enough words behind the shared one in both orders
    behind = F.least(F.size("template") - F.col("at"), F.size("block.held") - F.array_position(F.col("block.held"), F.col("word")) + 1)
    may = (F.size("block.held") >= F.col("least")) & (behind + F.col("at") >= F.col("least"))
    share = F.when(may, F.size(F.array_intersect("block.held", "template")) / F.size("template"))
    hit = F.when(share >= threshold - 1e-9, F.struct(F.col("block.start").alias("start"), "label", share.alias("containment")))
    found = met.withColumn("hit", hit).groupBy("row", "doc_id").agg(
        F.first("n_words").alias("n_words"), F.first("places").alias("places"), F.sort_array(F.collect_set("hit")).alias("blocks"))
    best = F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)))
    return found.select("doc_id", "n_words", "places", "blocks", best.alias("score"))
