"""Licence scans by a positional rare-token index, in DataFrame functions only.

Licence passages are templates. Their words with the highest inverse document
frequency (over all files scanned) are index keys, with the places they have in
the templates. A file looks up those of its words that are keys; a posting puts
a template's start at file place less template place, and places where enough
keys agree on a start are verified: the template's mandatory phrase must stand
there word by word.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import lowered

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 4
SHARE = 0.75

# The base phrases and their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
# Passages of public licences with the phrase that must stand in
# each. Label, passage, mandatory phrase.
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this"
     " software and associated documentation files", "obtaining a copy of this software"),
    ("apache-2", "you may not use this file except in compliance with the license",
     "except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are"
     " permitted provided that the following conditions are met", "source and binary forms"),
    ("gpl", "under the terms of the gnu general public license as published by the free software"
     " foundation", "gnu general public license"),
    ("gpl-2", "gnu general public license version 2", "general public license version 2"),
    ("gpl-3", "gnu general public license version 3", "general public license version 3"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or"
     " without fee is hereby granted", "with or without fee"),
    ("cc-by", "creative commons attribution 4 0 international", "creative commons attribution"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0", "attribution sharealike"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0", "attribution noncommercial"),
    ("unlicense", "free and unencumbered software released into the public domain",
     "released into the public domain"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]

Template = tuple[str, list[str], list[str], bool]  # label, words, mandatory words, base


def templates(base=BASE, passages=PASSAGES) -> list[Template]:
    return [(label, p.split(), p.split(), True) for label, p in base] + [
        (label, p.split(), phrase.split(), False) for label, p, phrase in passages
    ]


def words(text: Column) -> Column:
    """All words of the text in order; none for null or blank texts."""
    spaced = F.trim(F.regexp_replace(lowered(text), _GAP, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def frequencies(docs: DataFrame, text: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Rows of the table, and in how many of them each licence word stands.

    At most one row for each word of the templates reaches the driver.
    """
    held = F.array_intersect(words(F.col(text)), _literal(vocabulary))
    counted = docs.select(F.explode(F.array_append(held, F.lit(""))).alias("word")).groupBy("word").count()
    found = {r["word"]: r["count"] for r in counted.collect()}
    return found.pop("", 0), found


def index_keys(forms: list[Template], rows: int, found: dict[str, int], rare: int) -> list[dict[str, list[int]]]:
    """For each template its words of highest IDF with their places; ties by word.

    ``rare`` words, or half of the words of a short template.
    """
    out = []
    for _, body, _, _ in forms:
        idf = {w: log((rows + 1) / (found.get(w, 0) + 1)) for w in body}
        best = sorted(idf, key=lambda w: (-idf[w], w))[: min(rare, -(-len(body) // 2))]
        out.append({w: [i for i, x in enumerate(body) if x == w] for w in best})
    return out


def _find(body: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(body)) if body[i : i + len(phrase)] == phrase)


def scanned(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    forms: list[Template] | None = None,
    rare: int = RARE,
    share: float = SHARE,
) -> DataFrame:
    """One row for each input row.

    ``doc_id, n_words, n_base`` (places of base phrases), ``first_word`` and
    ``last_word`` (smallest and largest start of a base phrase, null without
    one), ``base_labels, labels`` (distinct, sorted, comma-joined) and
    ``score``: the largest share of a template's key places that agree, 0
    without a licence. Null and blank texts have no words; null ids and repeated
    rows keep their rows; an empty table gives an empty result; other columns
    are ignored. Everything about a file happens in its row: no shuffle but
    the counting of licence words.
    """
    forms = forms or templates()
    vocabulary = sorted({w for _, body, _, _ in forms for w in body})
    rows, found = frequencies(docs, text, vocabulary)
    keys = index_keys(forms, rows, found, rare)

    postings: dict[str, list[tuple[int, int]]] = {}
    for t, places in enumerate(keys):
        for word, at in places.items():
            postings.setdefault(word, []).extend((t, i) for i in at)
    total = [sum(map(len, places.values())) for places in keys]
    need = [n if f[3] else max(1, -int(-n * share // 1)) for n, f in zip(total, forms)]
    index = F.create_map(
        *[
            part
            for word, entries in postings.items()
            for part in (
                F.lit(word),
                F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for t, i in entries]),
            )
        ]
    )
    offset = [_find(body, phrase) for _, body, phrase, _ in forms]

    def of(values: list, t: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), t + 1)

    phrases = F.array(*[_literal(phrase) for _, _, phrase, _ in forms])
    w = F.col("w")

    # File places of key words, then template starts that they vote for.
    hits = F.filter(
        F.transform(w, lambda x, i: F.when(x.isin(*postings), F.struct(i.alias("i"), x.alias("x")))),
        lambda h: h.isNotNull(),
    )
    votes = F.array_sort(
        F.flatten(
            F.transform(
                F.col("hits"),
                lambda h: F.transform(
                    F.element_at(index, h["x"]),
                    lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["i"]).alias("at")),
                ),
            )
        )
    )
    # Equal votes stand together: a vote starts a run if the one before differs,
    # and the run is long enough if the vote need-1 places on is the same.
    v = F.col("votes")

    def agreeing(vote: Column, k: Column) -> Column:
        """How many votes from place k on are the same; at most one a key place."""
        return F.size(F.filter(F.slice(v, k + 1, of(total, vote["t"])), lambda x: x == vote))

    starts = F.filter(
        F.transform(
            v,
            lambda vote, k: F.when(
                (k == 0) | (F.get(v, k - 1) != vote),
                F.struct(vote["t"].alias("t"), vote["at"].alias("at"), agreeing(vote, k).alias("n")),
            ),
        ),
        lambda s: s.isNotNull() & (s["n"] >= of(need, s["t"])),
    )

    def stands(s: Column) -> Column:
        at, phrase = s["at"] + of(offset, s["t"]), F.element_at(phrases, s["t"] + 1)
        return F.when(at >= 0, F.slice(w, at + 1, F.size(phrase)) == phrase).otherwise(False)

    verified = F.filter(F.col("starts"), stands)
    base = F.filter(F.col("verified"), lambda s: of([f[3] for f in forms], s["t"]))

    def joined(entries: Column) -> Column:
        labels = F.transform(entries, lambda s: of([f[0] for f in forms], s["t"]))
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    def empty(name: str, value: Column, when: Column) -> Column:
        """Rows without a key word skip the work."""
        return F.when(when, value).otherwise(F.lit(None)).alias(name)

    some = F.size("hits") > 0
    rest = ["doc_id", "n_words"]
    return (
        docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w"))
        .select("doc_id", F.size("w").cast("bigint").alias("n_words"), "w", hits.alias("hits"))
        .select(*rest, "w", empty("votes", votes, some))
        .select(*rest, "w", starts.alias("starts"))
        .select(*rest, F.coalesce(verified, F.array().cast("array<struct<t:int,at:int,n:int>>")).alias("verified"))
        .select(*rest, "verified", base.alias("base"))
        .select(
            *rest,
            F.size("base").cast("bigint").alias("n_base"),
            F.array_min(F.transform("base", lambda s: s["at"])).cast("bigint").alias("first_word"),
            F.array_max(F.transform("base", lambda s: s["at"])).cast("bigint").alias("last_word"),
            joined(F.col("base")).alias("base_labels"),
            joined(F.col("verified")).alias("labels"),
            F.coalesce(
                F.array_max(F.transform("verified", lambda s: s["n"] / of(total, s["t"]))), F.lit(0.0)
            ).alias("score"),
        )
    )
