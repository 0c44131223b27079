"""License scans as an exact set-similarity join, in DataFrame functions only.

Base: the places where the words of a known phrase stand consecutively. They
are found in the text of normalised words parted by single blanks, and counted
by cutting that text at the phrase: the words before each cut are the places.

The method adds labels by a join of text blocks with license templates. A block
meets a template if it holds at least ``CONTAINED`` of the template's distinct
words. Blocks are the lines of the text, and the runs of as many consecutive
words as the template's text has, so that a notice wrapped over lines is found.
The join is exact and does no more than it must:

* tokens of all templates are ordered by the number of documents that hold
  them, counted over all documents; rare tokens come first;
* prefix filter: a block that meets a template of n tokens holds one of its
  first n - ceil(c n) + 1 tokens in that order; only blocks with such a token
  are joined, by an equi-join on it;
* length filter: such a block has ceil(c n) distinct template tokens at least;
* positional filter: a line's template tokens are put in the same order; what
  stands from the first common token on, in the line and in the template, bounds
  the overlap, and must still reach ceil(c n);
* runs are looked at only around a word of the prefix; the words that any such
  run can hold bound the overlap first;
* what is left is verified by the exact intersection.

Templates may be of any number and length. Their tokens are literals of a plan,
so they are joined in groups of about ``GROUP_TOKENS`` distinct tokens, one
after the other; a template's blocks do not depend on the other templates, so
the groups change no result. Blocks are exploded only from documents that hold a
prefix token of some template of the group.

Defined cases: null and empty texts have no words, no label and score 0;
repeated rows and ids are scanned each on its own; other columns are ignored.
Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONTAINED = 0.8
#: Distinct tokens of the templates that are joined together; a longer template is a group of its own.
GROUP_TOKENS = 2000

#: Phrase and label of the base scan.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label and template text of the set-similarity join.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)


def _words(text: str) -> list[str]:
    return [w for w in re.split(NOT_WORD, text.lower()) if w]


def tokens(text: str) -> list[str]:
    """Distinct normalised words of a template, in order of the text."""
    return list(dict.fromkeys(_words(text)))


def normalised(text: Column) -> Column:
    """Words of a text, lower-cased, with single blanks between and around them; two blanks if there are none."""
    plain = F.regexp_replace(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), NOT_WORD, " ")
    return F.concat(F.lit(" "), F.trim(plain), F.lit(" "))


def n_words(norm: Column) -> Column:
    """Words of a normalised text: its blanks less one."""
    return F.when(norm == "  ", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) - 1)


def _places(norm: Column, phrase: str) -> Column:
    """Word index of each place where the phrase starts.

    The text is cut before each place, by a pattern of no width, so that places
    that overlap are all found; each piece's words precede the next place.
    """
    # A pattern of no width does not cut at the very start, so something stands before.
    pieces = F.split(F.concat(F.lit("."), norm), f"(?= {phrase} )")
    count = F.transform(pieces, lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))))
    heads = F.slice(count, 1, F.size(count) - 1)
    return F.transform(heads, lambda _, i: F.aggregate(F.slice(count, 1, i + 1), F.lit(0), lambda a, x: a + x))


def base_places(norm: Column) -> dict[str, Column]:
    """Places of each phrase; an empty array for the many texts without it."""
    none = F.array().cast("array<int>")
    return {phrase: F.when(norm.contains(f" {phrase} "), _places(norm, phrase)).otherwise(none) for phrase, _ in PHRASES}


def _template_order(docs: DataFrame, templates: list[tuple[str, list[str]]]) -> dict[str, int]:
    """Rank of each template token by the documents that hold it, rarest first; ties by token."""
    words = sorted({w for _, t in templates for w in t})
    held = docs.select(F.array_intersect(F.split("norm", " "), F.array(*[F.lit(w) for w in words])).alias("w"))
    counted = dict(held.select(F.explode("w").alias("w")).groupBy("w").count().collect()) if words else {}
    return {w: k for k, w in enumerate(sorted(words, key=lambda w: (counted.get(w, 0), w)))}


def _by_place(hits: DataFrame) -> DataFrame:
    """Hits whose common token may be the first one: what follows it on both sides reaches ``need``. The length filter is part of it."""
    return hits.where(F.least(F.size("have") - F.col("at"), F.size("words") - F.col("place")) >= F.col("need"))


def _runs(docs: DataFrame, key: str, prefix: list[str], longest: int, wanted: DataFrame) -> DataFrame:
    """Runs of a template's length that meet it: key, label, both, words.

    A run that meets a template holds a word of its prefix, so for each such
    word the best of the runs that hold it is taken.
    """
    # The word, its place in the cut, and the cut: the words that a run with it can hold.
    first = lambda i: F.greatest(i - (longest - 1), F.lit(0))
    cut = lambda i: F.slice("every_word", first(i) + 1, i - first(i) + longest)
    place = lambda w, i: F.when(w.isin(prefix), F.struct(w.alias("token"), (i - first(i)).alias("mid"), cut(i).alias("cut")))
    split = docs.select(key, F.split(F.trim("norm"), " ").alias("every_word"))
    near = split.select(key, F.explode(F.array_compact(F.transform("every_word", place))).alias("near")).select(key, "near.*")
    near = near.join(wanted, "token").where(F.size(F.array_intersect("cut", "words")) >= F.col("need"))
    starts = F.sequence(F.greatest(F.col("mid") - F.col("span") + 1, F.lit(0)), F.col("mid"))
    both = F.array_max(F.transform(starts, lambda a: F.size(F.array_intersect(F.slice("cut", a + 1, F.col("span")), F.col("words")))))
    return near.withColumn("both", both).where(F.col("both") >= F.col("need")).select(key, "label", "both", "words")


def _groups(templates) -> list[list[tuple[str, str]]]:
    """Templates in order, in groups of about ``GROUP_TOKENS`` distinct tokens; at least one group."""
    out, seen = [[]], set()
    for label, text in templates:
        mine = set(tokens(text))
        if out[-1] and len(seen | mine) > GROUP_TOKENS:
            out.append([])
            seen = set()
        out[-1].append((label, text))
        seen |= mine
    return out


def similarity_join(docs: DataFrame, key: str, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """Blocks that meet a template: key, label, overlap (share of the template's words).

    ``docs`` has the columns key, text and norm.
    """
    out = None
    for group in _groups(templates):
        found = _join_group(docs, key, group, contained)
        out = found if out is None else out.unionByName(found)
    return out


def _join_group(docs: DataFrame, key: str, templates: list[tuple[str, str]], contained: float) -> DataFrame:
    spark = docs.sparkSession
    listed = [(label, t) for label, text in templates if (t := tokens(text))]
    spans = [len(_words(text)) for _, text in templates if tokens(text)]
    rank = _template_order(docs, listed)
    rows, prefix = [], set()
    for k, (label, words) in enumerate(listed):
        ordered = sorted(words, key=rank.__getitem__)
        need = max(1, math.ceil(contained * len(ordered) - 1e-9))
        for i, w in enumerate(ordered[: len(ordered) - need + 1]):
            prefix.add(w)
            rows.append((w, k, label, i, need, spans[k], ordered))
    wanted = spark.createDataFrame(rows, "token string, template int, label string, place int, need int, span int, words array<string>")
    if not prefix:
        return docs.select(key, F.lit("").alias("label"), F.lit(0.0).alias("overlap")).where(F.lit(False))
    # One pattern, so that the text is normalised once where this filter is pushed to the scan.
    holds = F.col("norm").rlike(f" (?:{'|'.join(sorted(prefix))}) ")
    every = F.array(*[F.lit(w) for w in sorted(rank, key=rank.__getitem__)])
    lines = docs.where(holds).select(key, F.posexplode(F.split(F.col("text"), "\n")).alias("line", "block"))
    blocks = lines.select(key, "line", F.array_intersect(every, F.split(normalised(F.col("block")), " ")).alias("have"))
    least = min(r[4] for r in rows)
    blocks = blocks.where(F.size("have") >= least)
    hits = blocks.select(key, "have", F.posexplode("have").alias("at", "token")).where(F.col("token").isin(sorted(prefix)))
    hits = _by_place(hits.join(F.broadcast(wanted), "token"))
    both = F.size(F.array_intersect("have", "words"))
    hits = hits.withColumn("both", both).where(F.col("both") >= F.col("need"))
    runs = _runs(docs.where(holds), key, sorted(prefix), max(spans), F.broadcast(wanted))
    hits = hits.select(key, "label", "both", "words").unionByName(runs)
    return hits.groupBy(key, "label").agg(F.max(F.col("both") / F.size("words")).alias("overlap"))


def scan(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """One row per document: base places, base labels, all labels and a score.

    The score is 1 if a base phrase stands in the text, else the largest share
    of a met template's words that a block holds, else 0.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = text.withColumn("norm", normalised(F.col("text")))
    # Rows are told apart by content and id: equal rows have equal results.
    key = "row_key"
    keyed = text.withColumn(key, F.struct("doc_id", F.xxhash64("text", F.lit(1)).alias("a"), F.xxhash64("text", F.lit(2)).alias("b")))
    met = similarity_join(keyed, key, templates, contained)
    extra = met.groupBy(key).agg(F.collect_set("label").alias("more"), F.max("overlap").alias("overlap"))
    places = base_places(F.col("norm"))
    out = keyed.select(key, "doc_id", n_words(F.col("norm")).cast("long").alias("n_words"), *[c.alias(f"p{k}") for k, c in enumerate(places.values())])
    names = [F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]
    out = out.select(
        key,
        "doc_id",
        "n_words",
        F.concat(*[f"p{k}" for k in range(len(PHRASES))]).alias("at"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*names)))).alias("base"),
    )
    out = out.join(extra, key, "left")
    return out.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("overlap", F.lit(0.0))).alias("score"),
    )
