"""Licenses in texts by an exact set-similarity join with license templates (operator 13).

Everything is DataFrame functions. A text is cut into blocks of BLOCK words every STEP words, so that any STEP words in
a row lie within one block; no template is longer. A template is found in a block when the block has at least
``percent`` of the template's distinct words. Words are ordered by the number of documents that have them, counted
over the whole corpus, rarest first; a block keeps its distinct template words in that order, others match nothing. If
a template of r words needs a of them, its r - a + 1 rarest words and the |block| - a + 1 rarest of the block must share
one: blocks and templates are joined on those prefixes. At the first shared word the length filter (the block has a
words) and the positional filter (both still have enough words after it) rule pairs out, and the rest are counted whole.
Templates are a fixed table of some thousand words, so its side of the join is broadcast.

Of templates that are alike (one ``family``) a block takes the one it has the most words of, of those with as many the
one it contains best, and ties all: the notice of one GNU license contains most of another's.

Defined results: null and empty texts have no words, no labels and score 0; texts of any length are scanned whole;
repeated rows give a row each, null ids are passed through; an empty table gives no rows; extra columns of any name
are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Words of a block, and words from one block's begin to the next one's.
BLOCK, STEP = 128, 64
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Phrases whose places are counted, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


@dataclass(frozen=True)
class Template:
    label: str
    family: str
    percent: int
    text: str

    @property
    def tokens(self) -> list[str]:
        return sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", self.text.translate(str.maketrans(_UPPER, _LOWER)))))


# Passages of public licenses and notices that name them.
TEMPLATES = [
    Template("mit", "mit", 80, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("mit", "mit name", 100, "Released under the MIT License"),
    Template("isc", "isc", 80, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("bsd", "bsd", 80, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    Template("bsd", "bsd binary", 80, "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    Template("bsd-3-clause", "bsd names", 80, "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    Template("apache", "apache", 80, "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("apache", "apache warranty", 80, "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    Template("apache", "apache name", 100, "Licensed under the Apache License, Version 2.0"),
    Template("gpl", "gnu", 80, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("lgpl", "gnu", 80, "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    Template("agpl", "gnu", 80, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("gpl", "gnu name", 100, "licensed under the GNU General Public License"),
    Template("lgpl", "gnu name", 100, "licensed under the GNU Lesser General Public License"),
    Template("agpl", "gnu name", 100, "licensed under the GNU Affero General Public License"),
    Template("mpl", "mpl", 80, "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("epl", "epl", 80, "This program and the accompanying materials are made available under the terms of the Eclipse Public License which is available at"),
    Template("boost", "boost", 80, "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    Template("zlib", "zlib", 80, "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    Template("unlicense", "unlicense", 80, "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    Template("cc0", "cc0", 80, "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work"),
    Template("cc-by", "cc", 100, "licensed under a Creative Commons Attribution International License"),
    Template("cc-by-sa", "cc", 100, "licensed under a Creative Commons Attribution ShareAlike International License"),
    Template("cc-by-nc", "cc", 100, "licensed under a Creative Commons Attribution NonCommercial International License"),
    Template("cc-by-nd", "cc", 100, "licensed under a Creative Commons Attribution NoDerivatives International License"),
    Template("cc-by", "cc short", 100, "licensed under CC BY"),
    Template("cc-by-sa", "cc short", 100, "licensed under CC BY-SA"),
    Template("cc-by-nc", "cc short", 100, "licensed under CC BY-NC"),
    Template("cc-by-nd", "cc short", 100, "licensed under CC BY-ND"),
]


def words(text: Column) -> Column:
    """Words of digits, small letters and characters beyond ASCII, A-Z lower-cased first; null text: none."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(folded, _GAP), lambda w: w != "")


def _listed(tokens: list[str]) -> Column:
    """Tokens as one literal array."""
    return F.split(F.lit(" ".join(tokens)), " ") if tokens else F.array().cast("array<string>")


def _places(own: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    parts = phrase.split()
    hit = lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(own, i + k) == p, F.lit(False)) for k, p in enumerate(parts)])
    starts = F.transform(own, lambda w, i: F.when((w == parts[0]) & hit(i), i.cast("long")))
    found = F.filter(starts, lambda i: i.isNotNull())
    return F.when(F.array_contains(own, parts[-1]), found).otherwise(F.array().cast("array<bigint>"))


def by_frequency(docs: DataFrame, templates: list[Template]) -> list[str]:
    """The templates' words, those of the fewest documents first. What is collected has a row a word of a template."""
    vocabulary = sorted({t for x in templates for t in x.tokens})
    had = docs.select(F.explode(F.array_intersect(_listed(vocabulary), words(F.col("text")))).alias("token"))
    counts = {r.token: r.n for r in had.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def _prefixes(docs: DataFrame, templates: list[Template], order: list[str]) -> DataFrame:
    """(token, i, need, template, label, family, tokens): the rarest words of each template that a match must share."""
    rank, rows = {t: k for k, t in enumerate(order)}, []
    for k, x in enumerate(templates):
        tokens = sorted(x.tokens, key=rank.__getitem__)
        need = -(-x.percent * len(tokens) // 100)
        for i, t in enumerate(tokens[: len(tokens) - need + 1]):
            rows.append((t, i, need, k, x.label, x.family, " ".join(tokens)))
    names = ("token", "i", "need", "template", "label", "family", "tokens")
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows]
    table = docs.sparkSession.range(1).select(F.inline(F.array(*structs)))
    return table.withColumn("tokens", F.split("tokens", " "))


def _needs(x: Template) -> int:
    return -(-x.percent * len(x.tokens) // 100)


def _scanned(docs: DataFrame, templates: list[Template], order: list[str]) -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n_words, places of every phrase, and the blocks that any template's
    rarest words occur in, each with its template words, rarest first."""
    rank = {t: k for k, t in enumerate(order)}
    rare = sorted({t for x in templates for t in sorted(x.tokens, key=rank.__getitem__)[: len(x.tokens) - _needs(x) + 1]})
    least = min(map(_needs, templates), default=1)
    own = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), words(F.col("text")).alias("words"))
    cut = lambda b: F.array_intersect(_listed(order), F.slice("words", b * STEP + 1, BLOCK))
    every = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("words") - 1) / F.lit(STEP)).cast("int")),
        lambda b: F.struct(b.alias("block"), cut(b).alias("has")),
    )
    kept = F.filter(every, lambda b: (F.size(b["has"]) >= least) & F.arrays_overlap(b["has"], _listed(rare)))
    none = F.array().cast("array<struct<block:int,has:array<string>>>")
    blocks = F.when(F.arrays_overlap("words", _listed(rare)), kept).otherwise(none)
    places = [_places(F.col("words"), p).alias(f"p{k}") for k, p in enumerate(PHRASES)]
    return own.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), *places, blocks.alias("blocks"))


def _matched(scanned: DataFrame, templates: list[Template], order: list[str]) -> DataFrame:
    """(doc_id, key, block, template, label, family, common, containment) of every block and template that match."""
    least = min(map(_needs, templates), default=1)
    rows = scanned.filter(F.size("blocks") > 0).select("doc_id", "key", F.explode("blocks").alias("b")).distinct()
    first = F.slice("b.has", F.lit(1), F.size("b.has") - (least - 1))
    rows = rows.select("doc_id", "key", "b.block", "b.has", F.posexplode(first).alias("j", "token"))
    pairs = rows.join(F.broadcast(_prefixes(scanned, templates, order)), "token")  # some hundred rows, whatever the corpus
    j, i, need, has, tokens = (F.col(c) for c in ("j", "i", "need", "has", "tokens"))
    prefix_and_length = j <= F.size(has) - need
    position = F.least(F.size(tokens) - i, F.size(has) - j) >= need
    earlier = F.size(F.array_intersect(F.slice(tokens, F.lit(1), i), F.slice(has, F.lit(1), j)))
    common = F.size(F.array_intersect(has, tokens))
    found = pairs.filter(prefix_and_length & position).filter((earlier == 0) & (common >= need))
    share = (common / F.size(tokens)).alias("containment")
    return found.select("doc_id", "key", "block", "template", "label", "family", common.alias("common"), share)


def matches(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """(doc_id, block, template, label, family, common, containment): every block of ``docs`` and template (a place in
    ``templates``) whose containment reaches the template's percentage. Repeated rows count once."""
    order = by_frequency(docs, templates)
    return _matched(_scanned(docs, templates, order), templates, order).drop("key")


def scan(docs: DataFrame, templates: list[Template] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base (places of PHRASES), first_word and last_word (the smallest
    and largest of their starts, words from 0), base_labels, labels (with those of the templates found), score (1 with
    a phrase, else the greatest containment found, 0 without any)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = by_frequency(docs, templates)
    # written, since the texts are read for it once and two parts of the plan use it
    scanned = Scratch(docs.sparkSession, "op13").table("scanned", _scanned(docs, templates, order))
    best = _matched(scanned, templates, order).groupBy("doc_id", "key", "block", "family")  # as many rows as templates
    rank = F.struct("common", "containment")
    best = best.agg(F.max(rank).alias("top"), F.collect_set(F.struct(rank.alias("rank"), "label")).alias("found"))
    best = best.select("doc_id", "key", "top.containment", F.explode(F.filter("found", lambda x: x["rank"] == F.col("top"))).alias("f"))
    found = best.groupBy("doc_id", "key").agg(F.max("containment").alias("containment"), F.collect_set("f.label").alias("more"))
    found = found.select(F.col("doc_id").alias("id"), F.col("key").alias("k"), "containment", "more")

    names = list(PHRASES.values())
    places = F.concat(*[F.col(f"p{k}") for k in range(len(names))])
    own = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(n)) for k, n in enumerate(names)]))
    n_base = F.size(places).cast("long")
    joined = scanned.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("k")), "left")
    every = F.concat(own, F.coalesce("more", F.array().cast("array<string>")))
    line = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        n_base.alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        line(own).alias("base_labels"),
        line(every).alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    quoted = lambda t: "'" + t + "'"
    listed = lambda tokens: "[" + ", ".join(map(quoted, tokens)) + "]"
    rows = ", ".join(f"({quoted(x.label)}, {quoted(x.family)}, {x.percent}, {listed(x.tokens)})" for x in TEMPLATES)
    places = "\n  UNION ALL ".join(
        f"SELECT rid, i, {quoted(label)} AS label FROM spots WHERE "
        + " AND ".join(f"words[i + {k + 1}] = {quoted(p)}" for k, p in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    return rf"""
WITH templates(label, family, percent, tokens) AS (VALUES {rows}), w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS words
  FROM documents
), spots AS (
  SELECT rid, words, unnest(range(len(words))) AS i FROM w WHERE list_contains(words, 'license')
), places AS (
  {places}
), blocks AS (
  SELECT rid, b, list_distinct(words[b * {STEP} + 1 : b * {STEP} + {BLOCK}]) AS has
  FROM (SELECT rid, words, unnest(range((len(words) + {STEP - 1}) // {STEP})) AS b FROM w)
), pairs AS (
  SELECT rid, b, label, family, len(list_intersect(has, tokens)) AS common, common / len(tokens) AS share
  FROM blocks, templates WHERE 100 * len(list_intersect(has, tokens)) >= percent * len(tokens)
), best AS (
  SELECT rid, label, share FROM pairs QUALIFY (common, share) = max((common, share)) OVER (PARTITION BY rid, b, family)
), labels AS (
  SELECT rid, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM (SELECT rid, label FROM best UNION ALL SELECT rid, label FROM places) GROUP BY rid
), base AS (
  SELECT rid, count(*) AS n, min(i) AS a, max(i) AS z, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels
  FROM places GROUP BY rid
), most AS (SELECT rid, max(share) AS share FROM best GROUP BY rid)
SELECT doc_id, cast(len(words) AS BIGINT) AS n_words, cast(coalesce(n, 0) AS BIGINT) AS n_base, cast(a AS BIGINT) AS first_word,
       cast(z AS BIGINT) AS last_word, coalesce(base.labels, '') AS base_labels, coalesce(labels.labels, '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN labels USING (rid) LEFT JOIN most USING (rid)
"""


#: The same in DuckDB SQL, over ``documents``: every block against every template.
ORACLE = _oracle()
