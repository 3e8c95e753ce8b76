"""License scan: phrases that stand in a text word by word, and text blocks that hold nearly all words of a license template.

A template of up to c words (c: a power of two, 8 at least) is compared with blocks of 2 c words, one beginning at every c-th word, so that each
run of c words lies whole in a block. A block matches a template if it has at least `percent` of the template's distinct words. Of two
templates that match one block, the one whose words are all in the other's is dropped.

The join is exact. Only words of templates can count, so blocks are sets of these. All such words are ordered by the number of
documents that have them, the rarest first. A match of o common words shares a word among the first |T| - o + 1 of the
template and the first |B| - o + 1 of the block (prefix), needs |B| >= o (length), and at the first shared word there have
to be enough words left on both sides (position). What is left is verified by the intersection. Documents that lack
the words as a whole make no blocks; equal texts make theirs once; blocks, not documents, are grouped.

Words: `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. Templates and phrases are ASCII.

Defined results: null and empty texts have no words, empty lists of labels and the score 0; the score of a text with a phrase is 1; rows are kept
as they are (null and repeated doc_ids, equal texts); an empty table gives no rows; other columns are ignored; a long text has more blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.common import materialize, small_batches

#: Phrases looked for word by word, with their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: Notices of public licenses, with labels. Short ones have to be there in full; of longer ones a tenth may be missing.
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl-2", "GNU General Public License, version 2"),
    ("gpl-3", "GNU General Public License, version 3"),
    ("gpl-3", "free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl-3", "GNU Lesser General Public License, version 3"),
    ("agpl-3", "GNU Affero General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("bsl-1", "Boost Software License, Version 1.0"),
    ("epl-2", "Eclipse Public License, Version 2.0"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "CC0 1.0 Universal Public Domain Dedication"),
]

_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: frozenset[str]
    span: int  # blocks have twice as many words
    least: int  # words in common


def templates_of(rows: list[tuple[str, str]], percent: int) -> list[Template]:
    out = []
    for label, text in rows:
        if not text.isascii():
            raise ValueError("templates and phrases have to be ASCII")
        words = "".join(x if x.isalnum() else " " for x in text.lower()).split()
        distinct = frozenset(words)
        out.append(Template(label, distinct, max(8, 1 << (len(words) - 1).bit_length()), -(-len(distinct) * percent // 100)))
    return out


def _words(text: Column) -> Column:
    """Lower-cased words. Of characters beyond ASCII only U+212A becomes an ASCII letter by itself in lower case."""
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u03ba"))), _GAPS), "")


def _literals(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values])


def _places(words: Column, phrase: list[str]) -> Column:
    """Where the phrase's words stand consecutively."""
    here = lambda i: [F.get(words, i + k) == w for k, w in enumerate(phrase)]

    def all_there(i: Column) -> Column:
        out = here(i)[0]
        for c in here(i)[1:]:
            out = out & c
        return out

    return F.filter(F.sequence(F.lit(0), F.size(words) - len(phrase)), all_there)


def _rows(docs: DataFrame, templates: list[Template], phrases: list[tuple[str, str]]) -> DataFrame:
    """One row a document: what its phrases give, which template words it has, and for documents that may match, where they stand."""
    split = [(p.split(), label) for p, label in phrases]
    vocabulary = sorted({w for t in templates for w in t.words} | {w for p, _ in split for w in p})
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("key"), _words(text).alias("words"))
    rows = rows.withColumn("known", F.array_intersect("words", _literals(vocabulary)))
    has = lambda ws: F.size(F.array_intersect("known", _literals(sorted(ws))))
    none = F.array().cast("array<int>")
    places = [F.when(has(set(p)) == len(set(p)), F.when(F.size("words") >= len(p), _places(F.col("words"), p)).otherwise(none)).otherwise(none).alias(f"p{k}") for k, (p, _) in enumerate(split)]
    spans = [F.when(has(t.words) >= t.least, F.lit(t.span)) for t in templates]
    rows = rows.select("*", *places, F.array_distinct(F.array_compact(F.array(*spans))).alias("spans"))
    every = F.concat(*[F.col(f"p{k}") for k in range(len(split))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(split)]))
    standing = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda x: F.array_contains("known", x["word"]))
    return rows.select(
        "doc_id",
        "key",
        F.size("words").cast("long").alias("n_words"),
        "known",
        every.alias("every"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
        "spans",
        F.when(F.size("spans") > 0, standing).alias("standing"),
    )


def _ranked(spark: SparkSession, rows: DataFrame, templates: list[Template]) -> tuple[dict[str, int], DataFrame]:
    """The rank of each template word by the documents that have it (at most as many rows as templates have words), and templates as prefix rows."""
    counts = {r["word"]: r["n"] for r in rows.select(F.explode("known").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    words = sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(words)}
    out = []
    for number, t in enumerate(templates):
        ranks = sorted(rank[w] for w in t.words)
        out += [(t.span, r, number, j, len(ranks), t.least, ranks) for j, r in enumerate(ranks[: len(ranks) - t.least + 1])]
    return rank, spark.createDataFrame(out, "span int, rank int, template int, j int, size int, least int, ranks array<int>")


def _blocks(rows: DataFrame, rank: dict[str, int], prefixes: DataFrame, templates: list[Template]) -> DataFrame:
    """(key, span, block, template, common): every block that holds enough of a template."""
    ranks = F.create_map(*[x for w, r in rank.items() for x in (F.lit(w), F.lit(r))])
    seen = rows.where(F.size("spans") > 0).select("key", "spans", "standing").dropDuplicates(["key"])
    seen = seen.select("key", "spans", F.explode("standing").alias("s")).select("key", "spans", F.col("s.pos").alias("pos"), F.element_at(ranks, F.col("s.word")).alias("rank"))
    seen = seen.where("rank is not null").select("key", "pos", "rank", F.explode("spans").alias("span"))
    at = F.floor(F.col("pos") / F.col("span")).cast("long")
    seen = seen.select("key", "span", "rank", F.explode(F.filter(F.array(at, at - 1), lambda b: b >= 0)).alias("block"))
    blocks = seen.groupBy("key", "span", "block").agg(F.array_sort(F.collect_set("rank")).alias("own"))
    least = {s: min(t.least for t in templates if t.span == s) for s in {t.span for t in templates}}
    enough = F.element_at(F.create_map(*[F.lit(x) for pair in least.items() for x in pair]), F.col("span"))
    blocks = blocks.withColumn("m", F.size("own")).withColumn("enough", enough).where("m >= enough")
    firsts = blocks.select("key", "span", "block", "own", "m", F.posexplode(F.expr("slice(own, 1, m - enough + 1)")).alias("i", "rank"))
    # The prefix table has at most one row for each word of a template.
    pairs = firsts.join(F.broadcast(prefixes), ["span", "rank"]).where("i <= m - least and least(m - i, size - j) >= least")
    pairs = pairs.withColumn("common", F.size(F.array_intersect("own", "ranks"))).where("common >= least")
    return pairs.groupBy("key", "span", "block", "template").agg(F.max("common").alias("common"))


def _undominated(blocks: DataFrame, templates: list[Template]) -> DataFrame:
    """Drops a template where another one that holds all its words matches the same block."""
    above = [[k for k, u in enumerate(templates) if t.words < u.words] for t in templates]
    over = F.array(*[F.array(*[F.lit(k) for k in ks]).cast("array<int>") for ks in above])
    held = blocks.groupBy("key", "span", "block").agg(F.collect_list(F.struct("template", "common")).alias("all"))
    held = held.select("key", "span", "block", F.explode("all").alias("x"), F.transform("all", lambda x: x["template"]).alias("there"))
    return held.where(~F.arrays_overlap("there", F.get(over, F.col("x.template")))).select("key", "span", "block", "x.template", "x.common")


def _prepared(docs: DataFrame, templates: list[tuple[str, str]], phrases: list[tuple[str, str]], percent: int) -> tuple[DataFrame, DataFrame]:
    """Document rows, and blocks (key, label, first_word, last_word, score)."""
    small_batches(docs.sparkSession)
    found = templates_of(templates, percent)
    rows = materialize(_rows(docs, found, phrases), "license-rows")
    rank, prefixes = _ranked(docs.sparkSession, rows, found)
    blocks = _undominated(_blocks(rows, rank, prefixes, found), found)
    label, size = (F.get(F.array(*[F.lit(x) for x in xs]), F.col("template")) for xs in ([t.label for t in found], [len(t.words) for t in found]))
    first = F.col("block") * F.col("span")
    return rows, materialize(blocks.select("key", label.alias("label"), first.alias("first_word"), (first + 2 * F.col("span") - 1).alias("last_word"), (F.col("common") / size).alias("score")), "license-blocks")


def find_blocks(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, percent: int = 90) -> DataFrame:
    """(doc_id, label, first_word, last_word, score): every block of a document that matches a template. score: the part of its distinct words found."""
    rows, blocks = _prepared(docs, templates, PHRASES, percent)
    last = F.least(F.col("last_word"), F.col("n_words") - 1).alias("last_word")
    return rows.where(F.size("spans") > 0).select("doc_id", "key", "n_words").join(blocks, "key").select("doc_id", "label", "first_word", last, "score")


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, percent: int = 90) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row."""
    rows, blocks = _prepared(docs, templates, phrases, percent)
    found = blocks.groupBy("key").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    none = F.array().cast("array<string>")
    out = rows.select("doc_id", "key", "n_words", "every", "base").join(found, "key", "left")
    return out.select(
        "doc_id",
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
