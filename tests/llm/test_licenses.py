import math
import re
import textwrap

from semaspan.llm import licenses as lic
from semaspan.llm.queries import QUERIES

TABLE = str.maketrans(lic.UPPER, lic.LOWER)


def brute(text, threshold=lic.THRESHOLD):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(TABLE))
    places, labels = [], set()
    for phrase, label in lic.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    matches = {}
    for label, notice in lic.TEMPLATES.items():
        template = set(lic.words_of(notice))
        needed = len(template) if len(template) < 10 else math.ceil(threshold * len(template) - 1e-9)
        for i in [i for i, word in enumerate(words) if word in template]:
            block = set(words[i : i + math.ceil(1.5 * len(lic.words_of(notice)))])
            held = len(block & template)
            told = set(lic.REQUIRED.get(label, "").split()) <= block and not set(lic.EXCLUDED.get(label, "").split()) & block
            if held >= needed and told:
                key = (label, i // lic.piece_words(lic.TEMPLATES))
                matches[key] = max(matches.get(key, 0), held / len(template))
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(labels), matches


ODD = [
    None, "", "  \n .", "CC BY", "cc by cc by-cc\nby", "Apache\nLicense", "xmit license", "mit licenses", "é mit license é",
    "released under mit\nreleased under the mit", "license MIT the under released " * 3,
    "Permission is granted free of charge to any person obtaining a copy of this software and associated documentation",
    "word " * 40 + " ".join(lic.TEMPLATES.values()) + " word" * 40, " ".join(lic.TEMPLATES.values()) * 9,
    *[("x " * n) + t for n, t in enumerate(lic.TEMPLATES.values(), 35)],
    "licensed " + "x " * 12 + "under the apache license version 2.0", "the " * 200,
]


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = lic.scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        found = {(m.label, m.piece): m.containment for m in r.matches}
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, found) == brute(texts[r.doc_id]), texts[r.doc_id]


def labels(spark, texts):
    rows = lic.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return [{m.label for m in r.matches} for r in sorted(rows, key=lambda r: r.doc_id)]


def test_wrapped_notices(spark):
    """Each notice is found when it is wrapped and commented, wherever it stands in a long text."""
    names = list(lic.TEMPLATES)
    for mark in ("# ", " * ", "// "):
        wrapped = [textwrap.indent("\n".join(textwrap.wrap(lic.TEMPLATES[n], 30)), mark) for n in names]
        texts = ["some words before it " * (7 * i) + "\n" + t + "\nand behind it" * 50 for i, t in enumerate(wrapped)]
        assert all(n in found for n, found in zip(names, labels(spark, texts), strict=True))


def test_notices_of_others_and_scattered_words(spark):
    texts = [
        "Released under the Apache License, Version 2.0.", "Released under the BSD License.", "Licensed under CC BY 4.0.",
        "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC-SA 4.0.",
        "This work may be used under the terms and released; the license applies",
        "released " + "word " * 10 + "under the MIT license",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        lic.TEMPLATES["gpl-notice"].replace("GNU", "GNU Lesser"), lic.TEMPLATES["apache-notice"].replace("Apache", "Other"),
    ]
    assert labels(spark, texts) == [set()] * len(texts)


def test_one_missing_word_of_a_long_notice(spark):
    notice = lic.TEMPLATES["bsd-notice"]
    assert labels(spark, [notice.replace("binary", ""), notice.replace("Redistribution", "")]) == [{"bsd-notice"}, set()]


def test_very_long_text(spark):
    assert labels(spark, ["the license " * 1_000_000 + lic.TEMPLATES["mit-short"]]) == [{"mit-short"}]


def test_own_templates(spark):
    docs = spark.createDataFrame([(1, "house\nrules apply")], "doc_id long, text string")
    assert [m.label for m in lic.scan(docs, {"own": "House rules apply.", "none": "..."}).first().matches] == ["own"]


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "mit license", "x", 3), (1, "mit license", "x", 3)], "doc_id long, text string, spaced string, blocks int")
    assert [r.n_base for r in lic.scan(docs).collect()] == [1, 1]
    assert lic.scan(docs.limit(0)).count() == 0


def test_query_digest(spark):
    rows = QUERIES["op5_license_scan"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in rows)
