"""Licence scans by a positional index of rare words, in DataFrame functions only.

A template is the beginning of a licence's text with its mandatory key phrases; a short phrase that names a licence is a
template that is one key phrase. Of each template's mandatory words the ANCHORS rarest are looked up in a file: rarity is
the inverse document frequency over all files (one aggregation, as many numbers as there are licence words). Places of the
rarest word, less its offset in the template, are candidate beginnings; they are intersected with the other rare words'
places by relative position, and where all agree, every key phrase must stand word by word. How many of the template's
words stand at their place is the score. All of it happens inside the row: nothing is shuffled but the word counts.

Which words are rare decides only what is looked up first, never what is found: a beginning at which all key phrases stand
holds all its rare words, so the result is that of a search for the phrases everywhere.

Defined results: words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z; a null or empty text has none, no
places, empty labels and score 0. Overlapping places all count. Repeated rows are scanned each by itself; a null id is
carried. An empty table has no frequencies, and no rows. A very long text is one array of words. Columns beside those named
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm.common import spread
from hushframe.llm.decontaminate import tokens

#: Rare words of a template that are intersected by position.
ANCHORS = 2

#: Phrases that name a licence, and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: How the texts and notices of public licences begin. Mandatory key phrases stand in brackets.
TEXTS = {
    "mit": "[permission is hereby granted free of charge to any person obtaining a copy] of this software and [associated documentation files]",
    "isc": "[permission to use copy modify and] or [distribute this software for any purpose] with or without fee is hereby granted",
    "bsd": "[redistribution and use in source and binary forms] with or without modification [are permitted provided that] the following conditions are met",
    "apache-2": "[licensed under the apache license version 2] 0 the license you may not use this file except in compliance with the license",
    "mpl-2": "[this source code form is subject to the terms of the mozilla public license] v 2 0",
    "gpl": "[this program is free software] you can redistribute it and or modify it [under the terms of the gnu general public license] as published by the free software foundation",
    "lgpl": "[under the terms of the gnu lesser general public license] as published by the free software foundation",
    "agpl": "[under the terms of the gnu affero general public license] as published by the free software foundation",
    "gpl-3": "[licensed under the gnu general public license version 3]",
    "cc-by": "[licensed under a creative commons attribution 4 0] international license",
    "cc-by-sa": "[licensed under a creative commons attribution sharealike] 4 0 international license",
    "cc0": "[has waived all copyright and related or neighboring rights]",
    "boost": "[boost software license version 1] 0",
    "unlicense": "[this is free and unencumbered software released into the public domain]",
    "zlib": "[this software is provided as is without any express or implied warranty] in no event will the authors be held liable",
}


@dataclass(frozen=True)
class Template:
    """words of a template, and its key phrases as (offset, words); base: a phrase of BASE."""

    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool

    @property
    def mandatory(self) -> dict[int, str]:
        return {at + i: w for at, phrase in self.phrases for i, w in enumerate(phrase)}


def template(label: str, text: str, base: bool = False) -> Template:
    """A template from a text whose key phrases stand in brackets (the whole text, if there are none). It begins with a key phrase."""
    words, phrases = [], []
    for k, part in enumerate(text.replace("]", "[").split("[") if "[" in text else ["", text]):
        if k % 2:
            phrases.append((len(words), tuple(part.split())))
        words += part.split()
    if not phrases or phrases[0][0] != 0:
        raise ValueError("a template begins with a key phrase")
    return Template(label, tuple(words), tuple(phrases), base)


TEMPLATES = [template(label, text, True) for text, label in BASE.items()] + [template(label, text) for label, text in TEXTS.items()]


def frequencies(docs: DataFrame, text: str, templates: list[Template]) -> dict[str, float]:
    """Inverse document frequency of each mandatory word, over all files; as many numbers as there are such words."""
    words = sorted({w for t in templates for w in t.mandatory.values()})
    held = docs.select(F.explode(F.array_intersect(tokens(text), F.array(*map(F.lit, words)))).alias("word"))
    found = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: -math.log1p(found.get(w, 0)) for w in words}  # the number of files is the same for all


def anchors(t: Template, idf: dict[str, float]) -> list[tuple[int, str]]:
    """The template's rarest mandatory words, with their offsets, rarest first; ties in order."""
    return sorted(t.mandatory.items(), key=lambda x: (-idf[x[1]], x[0]))[:ANCHORS]


def _places(w: Column, rare: Column, t: Template, idf: dict[str, float]) -> Column:
    """Where a template begins in words w; rare: the places of all templates' rarest words."""
    (first, word), *others = anchors(t, idf)
    begins = F.transform(F.filter(rare, lambda p: F.get(w, p) == word), lambda p: p - first)

    def whole(s: Column) -> Column:
        agree = [F.get(w, s + at) == x for at, x in others]
        stand = [F.slice(w, F.greatest(s + at + 1, F.lit(1)), len(phrase)) == F.array(*map(F.lit, phrase)) for at, phrase in t.phrases]
        return reduce(and_, [s >= 0, *agree, *stand])

    return F.filter(begins, whole)


def _share(w: Column, t: Template, places: Column) -> Column:
    """The largest share of a template's words that stand at their place."""
    mine = F.array(*map(F.lit, t.words))
    same = lambda s: F.aggregate(F.zip_with(F.slice(w, s + 1, len(t.words)), mine, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return F.coalesce(F.array_max(F.transform(places, lambda s: same(s))) / len(t.words), F.lit(0.0))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word, base_labels, labels and score."""
    templates = TEMPLATES if templates is None else templates
    idf = frequencies(docs, text, templates)
    looked_up = sorted({anchors(t, idf)[0][1] for t in templates})
    out = docs.select(F.col(key).alias("__key"), tokens(text).alias("__w"))
    w, rare = F.col("__w"), F.col("__rare")
    at = F.transform(w, lambda x, i: F.when(x.isin(looked_up), i))
    out = out.withColumn("__rare", F.filter(at, lambda p: p.isNotNull()))
    none = F.array().cast("array<int>")
    names = [f"__t{i}" for i in range(len(templates))]
    out = out.withColumns({n: F.when(F.size(rare) > 0, _places(w, rare, t, idf)).otherwise(none) for n, t in zip(names, templates)})
    base = [n for n, t in zip(names, templates) if t.base]
    labels = lambda which: F.array_join(F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(n) > 0, F.lit(t.label)) for n, t in zip(names, templates) if which(t)]), lambda x: x.isNotNull()))), ",")
    every = F.flatten(F.array(*base)) if base else none
    score = F.greatest(F.lit(0.0), F.lit(0.0), *[F.when(F.size(n) > 0, F.lit(1.0) if t.base else _share(w, t, F.col(n))).otherwise(0.0) for n, t in zip(names, templates)])
    return out.select(
        F.col("__key").alias(key), F.size(w).cast("long").alias("n_words"), F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        (labels(lambda t: t.base) if base else F.lit("")).alias("base_labels"), labels(lambda t: True).alias("labels"), score.alias("score"),
    )


def op13_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def oracle(templates: list[Template]) -> str:
    """DuckDB SQL: every template at every word that may begin it."""
    firsts = ", ".join(sorted({f"'{t.words[0]}'" for t in templates}))
    found = " UNION ALL ".join(
        f"SELECT r, s, '{t.label}' AS label, {t.base} AS base, " + ("1.0::DOUBLE" if t.base else f"list_sum(list_transform(range(0, {len(t.words)}), lambda i: CASE WHEN w[s + i] = {_list(t.words)}[i + 1] THEN 1 ELSE 0 END))::DOUBLE / {len(t.words)}")
        + " AS share FROM p WHERE " + " AND ".join(f"w[s + {at}:s + {at + len(phrase) - 1}] = {_list(phrase)}" for at, phrase in t.phrases)
        for t in templates
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
e AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d), p AS (SELECT * FROM e WHERE w[s] IN ({firsts})),
f AS ({found}),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(s - 1) FILTER (base) AS first_word, max(s - 1) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""


QUERIES = {"op13_licences": op13_licences}
ORACLES = {"op13_licences": oracle(TEMPLATES)}
