"""Licence scans by a positional index of rare words; built-in functions only.

Templates are licence notices as words with their places. The index has the words
of each template that the fewest documents hold (the highest IDF), with all their
places in it. A file looks up every one of its words that the index has; lookups
that agree on where a template would begin count together, and places where
enough do are verified by the template's mandatory phrases.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm.common import lowered

#: Phrases and the labels that they stand for.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices in common use: label, text, phrases that must stand near their places.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license version 2 0"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-3.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ["gnu general public license", "either version 3", "any later version"]),
    ("gpl-2.0-or-later", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", ["gnu general public license", "either version 2", "any later version"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ["cc by nc 4 0"]),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["released into the public domain"]),
]
#: Index words of a template, and how far from its place a mandatory phrase may stand, in words.
SEEDS, SLACK = 4, 12
#: The score of a text that only has base phrases.
BASE_SCORE = 0.5
PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """array<string>: runs of digits, a-z and what is not ASCII, once A-Z are in lower case."""
    return F.array_remove(F.split(lowered(F.coalesce(text.cast("string"), F.lit(""))), PARTS, -1), "")


def plain_words(text: str) -> list[str]:
    """The words of a template."""
    return [w for w in re.split(PARTS, text.lower()) if w]


@dataclass(frozen=True)
class Index:
    """Templates by number: labels, index words with (template, place), places each has, and phrases with their places."""

    labels: list[str]
    postings: dict[str, list[tuple[int, int]]]
    n_seeds: list[int]
    phrases: list[list[tuple[int, list[str]]]]


def document_counts(docs: DataFrame, words: list[str], text_col: str = "text") -> dict[str, int]:
    """How many of all documents hold each of the words; one count for each word reaches the driver."""
    held = F.array_distinct(F.filter(words_of(docs[text_col]), lambda w: w.isin(words)))
    return {r["word"]: r["n"] for r in docs.select(F.explode(held).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}


def index_of(templates: list[tuple[str, str, list[str]]], counts: dict[str, int]) -> Index:
    """Of each template the SEEDS words with the fewest documents, the first of equals; a phrase must be part of its template."""
    postings: dict[str, list[tuple[int, int]]] = {}
    n_seeds, phrases = [], []
    for t, (_, text, wanted) in enumerate(templates):
        words = plain_words(text)
        rare = sorted(set(words), key=lambda w: (counts.get(w, 0), w))[:SEEDS]
        places = [(w, j) for j, w in enumerate(words) if w in rare]
        for w, j in places:
            postings.setdefault(w, []).append((t, j))
        n_seeds.append(len(places))
        split = [plain_words(p) for p in wanted]
        phrases.append([(next(j for j in range(len(words)) if words[j : j + len(p)] == p), p) for p in split])
    return Index([label for label, _, _ in templates], postings, n_seeds, phrases)


def scan(docs: DataFrame, templates: list[tuple[str, str, list[str]]] | None = None, base: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places, base_labels, matches): a row for each document, without a shuffle.

    places: where base phrases begin, ascending; base_labels: theirs, sorted.
    matches: array<struct<template, label, at, score>>, the templates that stand in
    the text, where they begin, and the share of their index words that stand in
    place, at least half. Every index word of a file is looked up, in texts of any
    length. A null text has no words; null and repeated ids, and other columns, play
    no part. An empty table gives no rows. The templates must be few: they are part
    of the plan.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = {tuple(plain_words(p)): label for p, label in (BASE if base is None else base).items()}
    vocabulary = sorted({w for _, text, _ in templates for w in plain_words(text)})
    index = index_of(templates, document_counts(docs, vocabulary, text_col))
    keys = sorted({p[0] for p in phrases} | set(index.postings))
    posting = lambda x: F.struct(F.lit(x[0]).alias("t"), F.lit(x[1]).alias("j"))
    postings = F.create_map(*(c for w, own in index.postings.items() for c in (F.lit(w), F.array(*map(posting, own)))))
    wanted = F.array(*(F.array(*(F.struct(F.lit(j).alias("j"), F.array(*map(F.lit, p)).alias("words")) for j, p in own)) for own in index.phrases))
    labels, n_seeds = F.array(*map(F.lit, index.labels)), F.array(*map(F.lit, index.n_seeds))
    word, most = lambda i: F.get("words", i), max(index.n_seeds)

    def begins(phrase: tuple[str, ...]) -> Column:
        stands = lambda i: F.forall(F.array(*(F.coalesce(word(i + k) == w, F.lit(False)) for k, w in enumerate(phrase))), lambda x: x)
        return F.filter("marks", stands)

    # where each template would begin, by each index word of the file
    starts = F.flatten(F.transform("marks", lambda i: F.transform(F.coalesce(F.try_element_at(postings, word(i)), F.array().cast("array<struct<t:int,j:int>>")), lambda p: F.struct(p["t"].alias("t"), (i - p["j"]).alias("at")))))

    def same(k: Column) -> Column:
        return F.size(F.filter(F.slice("starts", k + 1, most), lambda x: x == F.get("starts", k)))

    first = F.filter(F.sequence(F.lit(0), F.size("starts") - 1), lambda k: F.get("starts", k).isNotNull() & ~F.coalesce(F.get("starts", k) == F.get("starts", k - 1), F.lit(False)))
    agreed = F.transform("first", lambda k: F.struct(F.get("starts", k)["t"].alias("t"), F.get("starts", k)["at"].alias("at"), same(k).alias("n")))

    def stands_near(at: Column, phrase: Column) -> Column:
        place = lambda by: F.greatest(at + phrase["j"] + by, F.lit(0))
        return F.exists(F.sequence(place(-SLACK), place(SLACK)), lambda i: F.slice("words", i + 1, F.size(phrase["words"])) == phrase["words"])

    enough = F.filter("agreed", lambda a: a["n"] * 2 >= F.get(n_seeds, a["t"]))
    verified = F.filter("enough", lambda a: F.forall(F.get(wanted, a["t"]), lambda p: stands_near(a["at"], p)))
    match = lambda a: F.struct(a["t"].alias("template"), F.get(labels, a["t"]).alias("label"), a["at"].alias("at"), (a["n"] / F.get(n_seeds, a["t"])).alias("score"))
    # each step is used more than once by the next, so that the planner keeps it as a step
    own = docs.select(docs[id_col].alias("id"), words_of(docs[text_col]).alias("words"))
    own = own.select("id", "words", F.size("words").cast("long").alias("n_words"), F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(keys), i))).alias("marks"))
    own = own.select("id", "words", "n_words", "marks", *(begins(p).alias(f"p{k}") for k, p in enumerate(phrases)), F.array_sort(starts).alias("starts"))
    own = own.select("*", first.alias("first")).select("*", agreed.alias("agreed")).select("*", enough.alias("enough")).select("*", verified.alias("verified"))
    places = F.array_sort(F.flatten(F.array(*(F.col(f"p{k}") for k in range(len(phrases))))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"p{k}") > 0, label) for k, label in enumerate(phrases.values()))))
    return own.select("id", "n_words", places.alias("places"), F.sort_array(F.array_distinct(base_labels)).alias("base_labels"), F.transform("verified", match).alias("matches"))


def report(scanned: DataFrame) -> DataFrame:
    """scan()'s rows in short: counts, outermost places, labels joined by commas, and a score.

    The score is the best match's, or BASE_SCORE if that is more and there is a base phrase; 0 without either.
    """
    labels = F.sort_array(F.array_distinct(F.concat("base_labels", F.transform("matches", lambda m: m["label"]))))
    score = F.greatest(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)), F.when(F.size("places") > 0, BASE_SCORE).otherwise(0.0))
    outer = (F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"))
    return scanned.select("id", "n_words", F.size("places").cast("long").alias("n_base"), *outer, F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def oracle() -> str:
    """The report of documents in SQL: words as rows, index words and verified places by joins."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    base = ", ".join(f"({quoted(plain_words(p))}, '{label}')" for p, label in BASE.items())
    listed = ", ".join(f"({t}, '{label}', {quoted(plain_words(text))})" for t, (label, text, _) in enumerate(TEMPLATES))
    placed = index_of(TEMPLATES, {}).phrases
    phrases = ", ".join(f"({t}, {j}, {quoted(p)})" for t, own in enumerate(placed) for j, p in own)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
w AS (SELECT r, ws[i + 1] AS word, i FROM (SELECT r, ws, unnest(range(len(ws))) AS i FROM d)),
base(words, label) AS (VALUES {base}),
places AS (SELECT w.r, i, label FROM w JOIN base ON word = words[1] JOIN d ON d.r = w.r WHERE ws[i + 1 : i + len(words)] = words),
template(t, label, words) AS (VALUES {listed}),
phrase(t, j, words) AS (VALUES {phrases}),
tw AS (SELECT t, j, words[j + 1] AS word FROM (SELECT t, words, unnest(range(len(words))) AS j FROM template)),
df AS (SELECT word, count(DISTINCT r) AS n FROM w WHERE word IN (SELECT word FROM tw) GROUP BY word),
rare AS (
  SELECT t, word FROM (SELECT DISTINCT t, word FROM tw) LEFT JOIN df USING (word)
  QUALIFY row_number() OVER (PARTITION BY t ORDER BY coalesce(n, 0), word) <= {SEEDS}),
seeds AS (SELECT t, j, word, count(*) OVER (PARTITION BY t) AS n_seeds FROM tw JOIN rare USING (t, word)),
agreed AS (
  SELECT r, t, i - j AS start, count(*) / any_value(n_seeds) AS score FROM w JOIN seeds USING (word)
  GROUP BY r, t, i - j HAVING count(*) * 2 >= any_value(n_seeds)),
near AS (
  SELECT a.r, a.t, a.start, a.score, bool_and(len(list_filter(
    range(greatest(start + j - {SLACK}, 0), greatest(start + j + {SLACK}, 0) + 1), lambda x: ws[x + 1 : x + len(words)] = words)) > 0) AS ok
  FROM agreed a JOIN phrase USING (t) JOIN d ON d.r = a.r GROUP BY ALL),
found AS (SELECT r, label, score FROM near JOIN template USING (t) WHERE ok),
counted AS (SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
best AS (SELECT r, max(score) AS score FROM found GROUP BY r),
every AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, label FROM found) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_base, CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  coalesce(c.labels, '') AS base_labels, coalesce(e.labels, '') AS labels, greatest(coalesce(b.score, 0.0), CASE WHEN c.n > 0 THEN {BASE_SCORE} ELSE 0.0 END) AS score
FROM d LEFT JOIN counted c ON c.r = d.r LEFT JOIN best b ON b.r = d.r LEFT JOIN every e ON e.r = d.r
"""
