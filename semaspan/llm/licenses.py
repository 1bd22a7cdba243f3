"""License scans: exact phrases, and a set-similarity join of text blocks with license templates.

A template is the set of words of a license notice. A block is a run of consecutive words of a text, over
line breaks and comment marks, that starts at a word of the template and is STRETCH times as long as the notice.
All pairs are found whose block holds at least THRESHOLD of the template's words (all of them where a template
has fewer than WHOLE), every word that tells this license from others (REQUIRED) and none that names a variant
(EXCLUDED). The join orders words by how few texts hold them and applies three exact filters to pieces of a
text that hold whole blocks: a piece must share one of the template's rarest words (prefix), hold enough words
of templates at all (length), and have enough words left behind the first shared one (position). What passes is
counted exactly, block by block.

Templates are a parameter of bounded size, so their words' counts, one number a word, go through the driver
between the two passes; no row of the corpus is shuffled but these counts.

Defined results: null and empty texts have no words, no places and no labels; a text shorter than a block is one
itself; a very long text is read in pieces, in time linear in its length. Repeated rows give repeated results, an
empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import math
import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8  # share of a template's words that a block must hold
WHOLE = 10  # templates of fewer words must be held whole: one missing word may be the license's name
STRETCH = 1.5  # words of a block for each word of the notice

# Phrases of the base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Public license notices as they are usually written, with labels of their own.
TEMPLATES = {
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "bsd-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-short": "This work is licensed under the GNU General Public License, version 3.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mit-short": "Released under the MIT License.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-notice": "This is free and unencumbered software released into the public domain.",
}

# Words without which a notice is not this license's, and words that make it another one's.
REQUIRED = {
    "apache-notice": "apache",
    "bsd-notice": "redistribution",
    "cc-by-notice": "creative commons attribution",
    "gpl-notice": "gnu general public license",
    "gpl-short": "gnu general public license",
    "mit-notice": "permission hereby granted",
    "mpl-notice": "mozilla public license",
    "unlicense-notice": "unencumbered",
}
EXCLUDED = {
    "cc-by-notice": "noncommercial noderivatives sharealike nc nd sa",
    "cc-by-nc-short": "nd sa",
    "gpl-notice": "affero lesser",
    "gpl-short": "affero lesser",
}

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER)))


def template_words(text: str) -> list[str]:
    return sorted(set(words_of(text)))


def needed_words(text: str, threshold: float = THRESHOLD) -> int:
    """How many different words of a template a block must hold."""
    n = len(template_words(text))
    return n if n < WHOLE else math.ceil(threshold * n - 1e-9)


def block_words(text: str) -> int:
    """How many words a block of a template has."""
    return math.ceil(STRETCH * len(words_of(text)))


def piece_words(templates: dict[str, str]) -> int:
    """Texts are read in pieces that own as many words, the longest block."""
    return max(map(block_words, templates.values()), default=1)


def spaced(text: Column) -> Column:
    """The lower-case words of a text with single spaces around all of them."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD, " ")
    return F.concat(F.lit(" "), F.btrim(plain, F.lit(" ")), F.lit(" "))


def text_counts(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many texts each of some words stands; a text gives at most one row a word."""
    held = F.array_intersect(F.split(spaced(F.col("text")), " "), F.array(*map(F.lit, words)))
    found = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in found}


class Join:
    """Templates over word numbers in global order, rarest first."""

    def __init__(self, templates: dict[str, str], counts: dict[str, int], threshold: float,
                 required: dict[str, str], excluded: dict[str, str]):
        texts = {label: text for label, text in templates.items() if words_of(text)}
        sets = {label: template_words(text) for label, text in texts.items()}
        others = [w for marks in (required, excluded) for text in marks.values() for w in words_of(text)]
        self.order = sorted({w for ws in sets.values() for w in ws}.union(others), key=lambda w: (counts.get(w, 0), w))
        rank = {w: i + 1 for i, w in enumerate(self.order)}
        self.templates = {label: sorted(rank[w] for w in ws) for label, ws in sets.items()}
        self.required = {label: [rank[w] for w in template_words(required.get(label, ""))] for label in texts}
        self.excluded = {label: [rank[w] for w in template_words(excluded.get(label, ""))] for label in texts}
        self.needed = {label: needed_words(text, threshold) for label, text in texts.items()}
        self.length = {label: block_words(text) for label, text in texts.items()}
        self.prefix = {label: t[: len(t) - self.needed[label] + 1] for label, t in self.templates.items()}
        self.piece = piece_words(texts)

    def chunks(self, text: Column) -> Column:
        """The words of a spaced text, `piece` of them a string."""
        return F.regexp_extract_all(F.ltrim(text), F.lit(f"(?:[^ ]++ ){{1,{self.piece}}}"), 0)

    def pieces(self, chunks: Column) -> Column:
        """Every chunk with the one behind it, if it shares a template's prefix: (piece, words, tokens).

        All blocks that start in a chunk lie in its piece. Words are the different numbers in global order,
        tokens (place, number) in order of the text.
        """
        vocabulary = F.array(*map(F.lit, self.order))
        rare = F.array(*[F.lit(self.order[i - 1]) for i in sorted({i for p in self.prefix.values() for i in p})])
        least = min(self.needed.values())
        behind = F.concat(F.slice(chunks, F.lit(2), F.size(chunks)), F.array(F.lit("")))
        words = F.zip_with(chunks, behind, lambda a, b: F.split(F.concat(a, F.coalesce(b, F.lit(""))), " "))
        known = F.transform(
            words,
            lambda w, i: F.struct(i.alias("piece"), F.array_intersect(w, vocabulary).alias("known"), w.alias("all")),
        )
        kept = F.filter(known, lambda p: (F.size(p["known"]) >= least) & F.arrays_overlap(p["known"], rare))

        def number(word: Column) -> Column:
            return F.array_position(vocabulary, word).cast("int")

        def numbered(p: Column) -> Column:
            tokens = F.transform(p["all"], lambda w, i: F.struct(i.alias("place"), number(w).alias("number")))
            return F.struct(
                p["piece"].alias("piece"),
                F.array_sort(F.transform(p["known"], number)).alias("words"),
                F.filter(tokens, lambda t: t["number"] > 0).alias("tokens"),
            )

        return F.transform(kept, numbered)

    def matches(self, pieces: Column) -> Column:
        """(label, piece, containment) of the best block that starts in each piece's own chunk."""

        def of(label: str) -> Column:
            template, needed = self.templates[label], self.needed[label]
            members = F.array(*map(F.lit, template))

            def enough(words: Column) -> Column:
                # by the first shared word of the prefix; the template's side holds by the prefix's length
                left = F.lit(False)
                for number in reversed(self.prefix[label]):
                    place = F.array_position(words, F.lit(number))
                    left = F.when(place > 0, F.size(words) - place + 1 >= needed).otherwise(left)
                return left

            def good(numbers: Column) -> Column:
                fine = F.size(F.array_intersect(numbers, members)) >= needed
                if self.required[label]:
                    told = F.array(*map(F.lit, self.required[label]))
                    fine &= F.size(F.array_intersect(numbers, told)) == len(self.required[label])
                if self.excluded[label]:
                    fine &= ~F.arrays_overlap(numbers, F.array(*map(F.lit, self.excluded[label])))
                return fine

            def best(p: Column) -> Column:
                starts = F.filter(p["tokens"], lambda t: (t["place"] < self.piece) & F.array_contains(members, t["number"]))

                def inside(start: Column) -> Column:
                    reach = start["place"] + self.length[label]
                    block = F.filter(p["tokens"], lambda t: (t["place"] >= start["place"]) & (t["place"] < reach))
                    return F.array_distinct(F.transform(block, lambda t: t["number"]))

                held = F.filter(F.transform(starts, inside), good)
                return F.array_max(F.transform(held, lambda n: F.size(F.array_intersect(n, members)))) / len(template)

            passed = F.filter(pieces, lambda p: (F.size(p["words"]) >= needed) & enough(p["words"]))
            counted = F.transform(
                passed,
                lambda p: F.struct(F.lit(label).alias("label"), p["piece"].alias("piece"), best(p).alias("containment")),
            )
            return F.filter(counted, lambda m: m["containment"].isNotNull())

        return F.flatten(F.array(*[of(label) for label in self.templates]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD,
         required: dict[str, str] | None = None, excluded: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, matches) for each row of `docs`.

    Places of base phrases count words from 0; matches are (label, piece, containment): the best block among
    those that start in words piece * n to piece * n + n - 1, n being `piece_words` of the templates.
    required, excluded: words by label that a block must hold all of, or none of. Those of this module go with
    its templates; without either, own templates are told by their words alone.
    """
    if templates is None:
        templates = TEMPLATES
        required, excluded = REQUIRED if required is None else required, EXCLUDED if excluded is None else excluded
    required, excluded = required or {}, excluded or {}
    words = sorted({w for texts in (templates, required, excluded) for t in texts.values() for w in words_of(t)})
    join = Join(templates, text_counts(docs, words), threshold, required, excluded)
    rows = docs.select("doc_id", spaced(F.col("text")).alias("spaced"))
    phrase = "(?<= )(?:" + "|".join(PHRASES) + ")(?= )"

    def spaces(text: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))

    rows = rows.select(
        "doc_id",
        F.when(F.col("spaced") == "  ", 0).otherwise(spaces(F.col("spaced")) - 1).cast("long").alias("n_words"),
        F.when(F.col("spaced").rlike(phrase), F.col("spaced")).alias("spaced"),
        join.chunks(F.col("spaced")).alias("chunks"),
    )
    rows = rows.select("doc_id", "n_words", "spaced", join.pieces(F.col("chunks")).alias("pieces"))
    # only texts with a place keep their words; what stands before the first and the last place is counted
    before_first = F.regexp_extract("spaced", f"(?s)^(.*?){phrase}", 1)
    before_last = F.regexp_extract("spaced", f"(?s)^(.*){phrase}", 1)
    names = [F.when(F.contains("spaced", F.lit(f" {text} ")), F.lit(label)) for text, label in sorted(PHRASES.items(), key=lambda x: x[1])]
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce(F.regexp_count("spaced", F.lit(phrase)), F.lit(0)).cast("long").alias("n_base"),
        (spaces(before_first) - 1).cast("long").alias("first_word"),
        (spaces(before_last) - 1).cast("long").alias("last_word"),
        F.array_compact(F.array(*names)).alias("base_labels"),
        join.matches(F.col("pieces")).alias("matches"),
    )
