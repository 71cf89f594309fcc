"""License scans by DataFrame functions only: exact phrases, and an exact set-similarity join with license templates."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from skyfold.llm.store import columns, others

# Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Opening words of well-known notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
# [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F] with every character named: Java then looks it up in a table, five times as fast as ranges
_MARKS = "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum())
WORD, GAP = f"[^{_MARKS}]", f"[{_MARKS}]"
THRESHOLD = 0.9
STRIDE = 64


def phrase_pattern(phrase: str) -> str:
    return f"(?<!{WORD})" + f"{GAP}+".join(f"(?i:{w})" for w in phrase.split()) + f"(?!{WORD})"


def word_list(low: Column) -> Column:
    return F.regexp_extract_all(low, F.lit(f"{WORD}+"), F.lit(0))


def holds(text: Column, low: Column, parts: list[str], pattern: str) -> Column:
    """Whether the pattern occurs; plain substrings, which are cheap, are looked for first."""
    there = low.contains(parts[0])
    for p in parts[1:]:
        there = there & low.contains(p)
    return there & text.rlike(pattern)


def tokens_of(template: str) -> list[str]:
    return sorted(set(re.findall(r"[0-9a-z]+", template.lower())))


def ordered(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[str, int]:
    """Template tokens by how often they occur in the whole corpus, rarest first; ties by token."""
    vocab = sorted({t for _, s in templates for t in tokens_of(s)})
    seen = docs.select(F.explode(word_list(F.lower("text"))).alias("w")).filter(F.col("w").isin(vocab)).groupBy("w").count()
    often = {r["w"]: r["count"] for r in seen.collect()}
    return {w: i for i, w in enumerate(sorted(vocab, key=lambda w: (often.get(w, 0), w)))}


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD, stride: int | None = None) -> DataFrame:
    """Columns of ``docs(text, ...)`` but the text, with ``n_words, n_base, first_word, last_word, base_labels, labels, score``.

    Base labels come from phrases of consecutive words.  The join: blocks are windows of ``2 * stride`` words every ``stride``
    words (of the text in lower case), so ``stride`` consecutive words always stand in one block; the stride is STRIDE or, for longer
    templates, the words of the longest divided by the threshold; a stated ``stride`` is taken as it is.  A block matches a template if it holds at least ``threshold`` of
    the template's distinct tokens.  Tokens are ordered by corpus frequency, rarest first.  A match must hold one of the first
    ``n - need + 1`` tokens of the template (prefix filter), at least ``need`` template tokens at all (length filter), and at the first
    common token enough tokens must be left on both sides (positional filter); only then the sets are compared.  The template list is a
    fixed argument of at most 1,000 and goes with the plan, so no row crosses the network.  ``score`` is 1 with a base phrase, else the
    largest containment among matches, else 0.

    Null texts are empty: no words, null positions, empty labels; an empty table gives no rows; columns named like new ones are replaced.
    """
    columns(docs, "text")
    templates = TEMPLATES if templates is None else templates
    if len(templates) > 1000:
        raise ValueError("more than 1,000 templates: scan in several calls")
    stride = stride or max([STRIDE, *(math.ceil(len(re.findall(r"[0-9a-z]+", s.lower())) / threshold) for _, s in templates)])
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "text"]
    keep = others(docs, *new)
    text, low = F.coalesce(F.col("text"), F.lit("")), F.col("__li_low")
    rank = ordered(docs, templates)
    index = []
    for label, s in templates:
        own = sorted(rank[t] for t in tokens_of(s))
        need = math.ceil(threshold * len(own) - 1e-9)
        index.append((label, own, own[: len(own) - need + 1], need))
    prefix = sorted({r for _, _, p, _ in index for r in p})
    names = sorted(rank, key=rank.__getitem__)

    total = F.regexp_count(text, F.lit(f"{WORD}+")).cast("long")
    base, first, last, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in PHRASES.items():
        pattern, size = phrase_pattern(phrase), len(phrase.split())
        there = holds(text, low, phrase.split(), pattern)
        pieces = F.split(text, pattern, -1)
        base = base + F.when(there, F.size(pieces) - 1).otherwise(0)
        first.append(F.when(there, F.regexp_count(F.element_at(pieces, 1), F.lit(f"{WORD}+")).cast("long")))
        last.append(F.when(there, total - F.regexp_count(F.element_at(pieces, -1), F.lit(f"{WORD}+")) - size))
        labels.append(F.when(there, F.lit(label)))
    words = word_list(low)
    gate = F.lit(False)
    for r in prefix:
        gate = gate | holds(low, low, [names[r]], f"(?<!{WORD}){names[r]}(?!{WORD})")
    numbers = F.create_map(*[x for w in names for x in (F.lit(w), F.lit(rank[w]))])
    count = F.size(words)
    last_block = F.greatest(F.lit(0), F.ceil(count / stride).cast("int") - 2)
    blocks = F.transform(F.sequence(F.lit(0), last_block), lambda b: F.slice(words, b * stride + 1, 2 * stride))
    known = F.array(*[F.lit(w) for w in names])
    ranks = F.transform(blocks, lambda b: F.array_sort(F.transform(F.array_intersect(b, known), lambda w: numbers[w])))
    found = F.filter(ranks, lambda r: F.arrays_overlap(r, F.array(*[F.lit(x) for x in prefix]))) if prefix else F.array().cast("array<array<int>>")

    def compare(block: Column) -> Column:
        out = []
        for label, own, pre, need in index:
            mine, pre_ = F.array(*[F.lit(x) for x in own]), F.array(*[F.lit(x) for x in pre])
            common = F.element_at(F.array_intersect(pre_, block), 1)  # both sides ascend, so this is the first common token
            left = F.least(F.size(block) - F.array_position(block, common), len(own) - F.array_position(mine, common)) + 1
            share = F.size(F.array_intersect(block, mine)) / F.lit(float(len(own)))
            passes = (F.size(block) >= need) & F.arrays_overlap(pre_, block) & (left >= need)
            out.append(F.when(passes & (share >= need / len(own)), F.struct(F.lit(label).alias("label"), share.alias("share"))))
        return F.array_compact(F.array(*out))

    matched = F.when(gate, F.flatten(F.transform(found, compare))).otherwise(F.array().cast("array<struct<label:string,share:double>>"))
    lowered = docs.withColumn("__li_low", F.lower(text))
    out = lowered.select(
        *keep, total.alias("n_words"), base.alias("n_base"), F.least(*first).alias("first_word"), F.greatest(*last).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("__li_base"), matched.alias("__li_found"),
    )
    return out.select(
        *keep, "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "__li_base").alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.concat("__li_base", F.transform("__li_found", lambda m: m["label"]))))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("__li_found", lambda m: m["share"])), F.lit(0.0))).alias("score"),
    )


def digest(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text"))
