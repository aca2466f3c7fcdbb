"""Licence scans by a positional index of rare words, in DataFrame functions.

Licence sentences are templates: word sequences with a mandatory key phrase in
brackets. The index holds, per template, the postings (template, place) of the
words of its key phrase that are rarest in the corpus, by document frequency.
Each file looks up the index words it has; a word at position p that stands at
a template's place q says that the template starts at p - q. Starts on which
all index places of a template agree are candidates: the intersection of its
postings by relative position. For these, the whole key phrase is verified
word by word, and the share of the sentence's other words found in place is
the score. Nothing that holds a key phrase is missed, since index places are
part of it.

Files are read once: what is kept of them, and what later steps read, is the
positions of words that some template has. The frequencies (as many as the
templates have words) are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.common import stage_table, text_or_empty

#: Runs of ASCII characters that are neither digits nor small letters stand between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels, as the contract names them.
BASE = [
    ("gpl", "[gnu general public license]"),
    ("apache", "[apache license]"),
    ("cc-by", "[cc by]"),
    ("mit", "[mit license]"),
]

#: Sentences of published licences and notices; their mandatory key phrases in brackets.
TEMPLATES = [
    ("apache-2.0", "licensed under the [Apache License, Version 2.0]"),
    ("apache-2.0", "you may not use this file [except in compliance with the License. You may obtain a copy of the "
                   "License at]"),
    ("bsd", "[Redistribution and use in source and binary forms, with or without modification], are permitted "
            "provided that the following conditions are met"),
    ("cc-by-4.0", "licensed under [CC BY 4.0]"),
    ("cc-by-4.0", "licensed under a [Creative Commons Attribution 4.0] International License"),
    ("cc-by-nc-4.0", "licensed under [CC BY-NC 4.0]"),
    ("cc-by-nc-nd-4.0", "licensed under [CC BY-NC-ND 4.0]"),
    ("cc-by-nc-sa-4.0", "licensed under [CC BY-NC-SA 4.0]"),
    ("cc-by-nd-4.0", "licensed under [CC BY-ND 4.0]"),
    ("cc-by-sa-4.0", "licensed under [CC BY-SA 4.0]"),
    ("cc0-1.0", "to the extent possible under law the author has [waived all copyright and related or neighboring "
                "rights]"),
    ("gpl", "this program is free software you can [redistribute it and/or modify it under the terms of the GNU "
            "General Public License]"),
    ("gpl-2.0", "this work is licensed under the [GNU General Public License, version 2]"),
    ("gpl-3.0", "this work is licensed under the [GNU General Public License, version 3]"),
    ("isc", "[permission to use, copy, modify, and/or distribute this software for any purpose with or without fee] "
            "is hereby granted"),
    ("lgpl", "under the terms of the [GNU Lesser General Public License]"),
    ("mit", "released under the [MIT License]"),
    ("mit", "[Permission is hereby granted, free of charge, to any person obtaining a copy] of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the [Mozilla Public License, v. 2.0]"),
    ("unlicense", "this is [free and unencumbered software released into the public domain]"),
]

#: Words of a key phrase that are looked up: those of the highest IDF.
RARE = 3


def words_of(column: Column) -> Column:
    """Words of a text with A-Z lower-cased; a text that starts or ends
    between words has an empty one there."""
    return F.split(F.translate(column, ascii_uppercase, ascii_lowercase), BETWEEN)


def places(templates: Sequence[tuple[str, str]], base: Sequence[tuple[str, str]] = ()
           ) -> list[tuple[int, str, bool, int, str, bool]]:
    """(template, label, is base, place, word, mandatory) of every word."""
    out = []
    for number, (label, text, is_base) in enumerate(
            [(*t, True) for t in base] + [(*t, False) for t in templates]):
        place, inside, word = 0, False, ""
        for c in text.lower() + " ":
            if c in ascii_lowercase or c.isdigit() or c >= "\x80":
                word += c
                continue
            if word:
                out.append((number, label, is_base, place, word, inside))
                place, word = place + 1, ""
            inside = {"[": True, "]": False}.get(c, inside)
    return out


def rare_words(rows: list[tuple], frequency: dict[str, int], rare: int = RARE) -> dict[int, list[str]]:
    """Per template, the ``rare`` words of its key phrase that the fewest
    documents have, ties in order of the words."""
    out: dict[int, list[str]] = {}
    for number in {r[0] for r in rows}:
        words = {r[4] for r in rows if r[0] == number and r[5]}
        out[number] = sorted(words, key=lambda w: (frequency.get(w, 0), w))[:rare]
    return out


def _table(spark: SparkSession, rows: list[tuple], columns: str) -> DataFrame:
    """A table of a few constants, as SQL VALUES."""
    def said(x: object) -> str:
        return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else str(x)

    values = ", ".join("(" + ", ".join(map(said, r)) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
         base: Sequence[tuple[str, str]] = tuple(BASE), rare: int = RARE) -> DataFrame:
    """Licences of every document.

    ``docs``: ``doc_id`` and ``text``; other columns are ignored. Returns one
    row per row: ``doc_id``, ``n_words``, ``n_base`` (places of base
    phrases), ``first_word`` and ``last_word`` (the smallest and largest word
    number at which a base phrase starts, else null), ``base_labels``,
    ``labels`` (those and the templates' own; distinct, sorted, joined by
    commas; empty if none), ``score`` (the largest share of a sentence found
    in place where its key phrase is there, 1 for a base phrase, else 0) and
    ``n_places`` (places of all key phrases).

    Null and empty texts have no words and no labels. Repeated rows, and rows
    that share a doc_id or have none, go by their own text each. A phrase
    across a line or punctuation counts; an empty table gives an empty
    result. Long texts are read whole: their words are rows by the time
    anything is compared, so one text with very many licences costs time in
    proportion.
    """
    spark = docs.sparkSession
    rows = places(templates, base)
    vocabulary = sorted({r[4] for r in rows})
    texts = docs.select(F.col("doc_id"), words_of(text_or_empty()).alias("words"))
    lead = F.when(F.get("words", F.lit(0)) == "", 1).otherwise(0)
    numbered = F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    marked = stage_table(texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.size(F.filter("words", lambda w: w != "")).cast("long").alias("n_words"), lead.alias("lead"),
        F.filter(numbered, lambda x: x["word"].isin(vocabulary)).alias("marks")), "marked")

    frequency = {r["word"]: r["n"] for r in marked.select(
        F.explode(F.array_distinct("marks.word")).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    index = rare_words(rows, frequency, rare)
    postings = [(r[0], r[3], r[4]) for r in rows if r[5] and r[4] in index[r[0]]]
    needed = {t: sum(p[0] == t for p in postings) for t in index}
    looked_up = sorted({p[2] for p in postings})
    postings = _table(spark, postings, "template, place, word")
    known = _table(spark, [
        (t, needed[t], sum(r[0] == t and r[5] for r in rows), sum(r[0] == t for r in rows),
         *next((r[1], r[2]) for r in rows if r[0] == t)) for t in sorted(index)],
        "template, needed, mandatory, length, label, is_base")
    found = marked.select("row", "lead", F.explode(F.filter("marks", lambda x: x["word"].isin(looked_up))).alias("mark"))
    votes = (found.select("row", (F.col("mark.at") - F.col("lead")).alias("at"), F.col("mark.word").alias("word"))
             .join(postings, "word")
             .groupBy("row", "template", (F.col("at") - F.col("place")).alias("start"))
             .agg(F.count(F.lit(1)).alias("votes")))
    starts = stage_table(votes.join(known.select("template", "needed"), "template").filter(
        F.col("votes") == F.col("needed")).select("row", "template", "start"), "starts")

    # every word of a candidate's sentence against the words of its file
    sentence = _table(spark, [(r[0], r[3], r[4], r[5]) for r in rows], "template, place, word, key")
    wanted = starts.join(sentence, "template").withColumn("at", F.col("start") + F.col("place"))
    there = (marked.join(starts.select("row").distinct(), "row", "left_semi")
             .select("row", "lead", F.explode("marks").alias("mark"))
             .select("row", (F.col("mark.at") - F.col("lead")).alias("at"), F.col("mark.word").alias("word")))
    matched = (wanted.join(there, ["row", "at", "word"]).groupBy("row", "template", "start")
               .agg(F.sum(F.col("key").cast("int")).alias("keys"), F.count(F.lit(1)).alias("words"))
               .join(known, "template").filter(F.col("keys") == F.col("mandatory")))
    is_base, start = F.col("is_base"), F.col("start").cast("long")
    of_row = matched.groupBy("row").agg(
        F.sum(is_base.cast("long")).alias("n_base"), F.count(F.lit(1)).alias("n_places"),
        F.min(F.when(is_base, start)).alias("first_word"), F.max(F.when(is_base, start)).alias("last_word"),
        F.collect_set(F.when(is_base, F.col("label"))).alias("_base"), F.collect_set("label").alias("_all"),
        F.max(F.col("words") / F.col("length")).alias("score"))

    def joined(labels: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(labels), ","), F.lit(""))

    return marked.select("row", "doc_id", "n_words").join(of_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        joined("_base").alias("base_labels"), joined("_all").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("n_places", F.lit(0).cast("long")).alias("n_places"))


def oracle(templates: Sequence[tuple[str, str]] = tuple(TEMPLATES), base: Sequence[tuple[str, str]] = tuple(BASE)) -> str:
    """The same in SQL for DuckDB, without the index: every key phrase at every place."""
    values = ", ".join(f"({t}, '{label}', {is_base}, {place}, '{word}', {key})"
                       for t, label, is_base, place, word, key in places(templates, base))
    return rf"""
WITH t(template, label, is_base, place, word, is_key) AS (VALUES {values}),
k AS (SELECT template, label, is_base, count(*) AS length, count(*) FILTER (WHERE is_key) AS mandatory FROM t GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
  '{ascii_uppercase}', '{ascii_lowercase}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM d),
m AS (SELECT r, template, pos - place AS start, count(*) AS n, count(*) FILTER (WHERE is_key) AS keys
  FROM w JOIN t USING (word) GROUP BY ALL),
f AS (SELECT m.*, label, is_base, n / length AS share FROM m JOIN k USING (template) WHERE keys = mandatory),
g AS (SELECT r, count(*) FILTER (WHERE is_base) AS n_base, count(*) AS n_places,
  min(start) FILTER (WHERE is_base) AS first_word, max(start) FILTER (WHERE is_base) AS last_word,
  string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(coalesce(score, 0) AS DOUBLE) AS score, coalesce(n_places, 0) AS n_places
FROM d LEFT JOIN g USING (r)"""
