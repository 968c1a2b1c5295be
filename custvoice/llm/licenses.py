"""Licence scan by a positional index of rare words, in DataFrame functions alone.

Templates are licence statements, short ones and the paragraphs of whole notices.  A text's
words that occur in any template are weighed by how few documents hold them.  A template
stands where ``AGREE`` of its words agree, so of its rarest words, two more than may differ,
two agree at least: these words, with their places in the template, are its postings.  In
a text the places of all posted words are listed; each tells where each template with that
word would begin, the begins of a template's postings are intersected, and where two agree
the mandatory key phrase is verified and the whole template compared.  No statement is lost,
however many others the text holds, and rarer words make fewer begins to verify.

Defined results: a null or empty text has no words and no labels; repeated rows are
scanned each; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvoice.llm.store import only

# Phrases and the labels of the base count.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Label, statement, mandatory phrase.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-3", "licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "general public license version 2"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", "mozilla public license version 2"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
            "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
            "to the following conditions", "without limitation the rights to use copy modify merge publish"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
            "the above copyright notice and this permission notice appear in all copies", "with or without fee is hereby granted"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
            "documentation and or other materials provided with the distribution", "redistributions in binary form must reproduce"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
              "this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may "
                 "obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
                 "without warranties or conditions of any kind either express or implied", "software distributed under the license is distributed"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
              "by the free software foundation either version 3 of the license or at your option any later version", "either version 3 of the license"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
              "by the free software foundation either version 2 of the license or at your option any later version", "either version 2 of the license"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this "
              "file you can obtain one at", "source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
)
AGREE = 0.8  # share of a template's words that must agree on its place

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The two characters beyond ASCII whose lower case holds a letter of ASCII.
_TURNS = ("\u0130", "\u212a")


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def canonical(text: Column) -> Column:
    """The words of the text, A-Z in lower case, one space between them.

    ``lower`` differs from folding A-Z in letters beyond ASCII only, which the phrases
    lack; where it would make a letter of ASCII, ``translate`` takes its place.
    """
    text = F.coalesce(text, F.lit(""))
    turns = F.contains(text, F.lit(_TURNS[0])) | F.contains(text, F.lit(_TURNS[1]))
    lower = F.when(turns, F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.trim(F.regexp_replace(lower, _GAP, " "))


def _strings(items: list[str]) -> Column:
    return F.expr("array(" + ", ".join(f"'{item}'" for item in items) + ")")


def _holds(line: Column, phrases: list[str]) -> Column:
    """Whether one of the phrases stands in the line, at bounds of words."""
    return F.concat(F.lit(" "), line, F.lit(" ")).rlike(" (" + "|".join(phrases) + ") ")


def rarity(lines: DataFrame) -> DataFrame:
    """For each word of a template: in how many of all texts it stands."""
    held = F.array_intersect(_strings(vocabulary()), F.split("line", " "))
    return lines.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))


def postings(tokens: list[str], ranked: list[str]) -> list[tuple[str, int]]:
    """The rarest words of a template with their places: two more than may differ where it stands."""
    may_differ = len(tokens) - math.ceil(AGREE * len(tokens) - 1e-9)
    by_rarity = sorted(range(len(tokens)), key=lambda i: (ranked.index(tokens[i]), i))
    return [(tokens[i], i) for i in by_rarity[: may_differ + 2]]


def _templates(ranked: list[str]) -> Column:
    """The templates as one constant array: tokens, mandatory phrase and where it stands among them, and postings."""
    rows = []
    for label, text, key in TEMPLATES:
        tokens, phrase = text.split(), key.split()
        shift = next(i for i in range(len(tokens)) if tokens[i : i + len(phrase)] == phrase)
        posted = F.array(*(F.struct(F.lit(w).alias("w"), F.lit(at).alias("at")) for w, at in postings(tokens, ranked)))
        rows.append(F.struct(F.lit(label).alias("label"), _strings(tokens).alias("tokens"), _strings(phrase).alias("phrase"), F.lit(shift).alias("shift"),
                             posted.alias("posted")))
    return F.array(*rows)


def _found(template: Column, words: Column, kept: Column) -> Column:
    """The best score of the places of a text where the template stands, or null.

    ``kept`` maps the posted words of the text to the places where they stand.
    """
    tokens = template["tokens"]
    order = F.sequence(F.lit(0), F.size(tokens) - 1)
    none = F.array().cast("array<int>")
    begins = F.array_sort(F.flatten(F.transform(template["posted"], lambda p: F.transform(F.coalesce(F.try_element_at(kept, p["w"]), none), lambda i: i - p["at"]))))
    agreed = F.array_distinct(F.filter(begins, lambda b, i: (i > 0) & (F.get(begins, i - 1) == b)))
    sure = F.filter(agreed, lambda b: (b + template["shift"] >= 0) & (F.slice(words, F.greatest(b + template["shift"], F.lit(0)) + 1, F.size(template["phrase"])) == template["phrase"]))
    scores = F.transform(sure, lambda b: F.size(F.filter(order, lambda j: F.get(words, b + j) == F.get(tokens, j))) / F.size(tokens))
    return F.array_max(F.filter(scores, lambda s: s >= AGREE))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: word count, base places, labels and a score.

    Two passes: the first counts in how many texts each template word stands (a row
    for each word of the fixed templates comes back to the driver), the second looks the
    templates up.  Arrays of words are made only for texts that hold a posted word or a
    base phrase, without which no label can be found.
    """
    lines = only(docs, doc_id="bigint", text="string").select("doc_id", canonical(F.col("text")).alias("line"))
    df = {r["word"]: r["df"] for r in rarity(lines).collect()}
    ranked = sorted(vocabulary(), key=lambda w: (df.get(w, 0), w))
    posted = sorted({w for _, text, _ in TEMPLATES for w, _ in postings(text.split(), ranked)})

    line = F.col("line")
    n_words = F.when(line == "", 0).otherwise(F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1)
    marked = lines.select("doc_id", n_words.cast("bigint").alias("n_words"),
                          F.when(_holds(line, [*posted, *BASE_PHRASES]), F.split(line, " ")).alias("words"))

    words = F.col("words")
    listed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda p: p["w"].isin(posted))
    kept = F.map_from_entries(F.transform(F.array_distinct(F.col("listed.w")), lambda w: F.struct(
        w.alias("w"), F.transform(F.filter("listed", lambda p: p["w"] == w), lambda p: p["i"]).alias("at"))))
    places = F.filter(
        F.transform(words, lambda w, i: _base_at(words, w, i)),
        lambda p: p["label"].isNotNull(),
    )
    read = marked.select("doc_id", "n_words", "words", listed.alias("listed"), places.alias("places"))
    read = read.select("doc_id", "n_words", "words", kept.alias("kept"), "places")
    scores = F.transform(_templates(ranked), lambda t: F.struct(t["label"].alias("label"), _found(t, F.col("words"), F.col("kept")).alias("score")))
    found = read.select("doc_id", "n_words", "places", F.when(F.col("words").isNotNull(), F.filter(scores, lambda s: s["score"].isNotNull())).alias("found"))

    none = F.array().cast("array<string>")
    base = F.coalesce(F.array_distinct(F.col("places.label")), none)
    own = F.coalesce(F.col("found.label"), none)
    return found.select(
        "doc_id", "n_words", F.coalesce(F.size("places"), F.lit(0)).cast("bigint").alias("n_base"),
        F.array_min("places.at").cast("bigint").alias("first_word"), F.array_max("places.at").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, own))), ",").alias("labels"),
        F.greatest(F.when(F.size(base) > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("found.score"), F.lit(0.0))).alias("score"),
    )


def _base_at(words: Column, word: Column, at: Column) -> Column:
    """The label of the base phrase that begins here, if one does, and the place."""
    label = F.lit(None).cast("string")
    for phrase, name in BASE_PHRASES.items():
        label = F.when((word == phrase.split()[0]) & (F.slice(words, at + 1, len(phrase.split())) == _strings(phrase.split())), name).otherwise(label)
    return F.struct(label.alias("label"), at.alias("at"))
