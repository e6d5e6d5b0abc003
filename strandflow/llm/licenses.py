"""Licence scans by sentence rules (DataFrame functions only).

A text is cut into sentences (lines, and sentence ends before white space); each sentence is normalised to lower
case letters and digits with single spaces and mapped to the identifier of a known licence sentence, in its short or
its genuine form. A known sentence may be wrapped: single line ends are allowed between its words, blank lines and
sentence ends only where the genuine text has them. ``n_sentences`` counts the cut pieces. The row of identifiers is matched against ordered rules: a rule fits where its identifiers stand in that order, other known
sentences allowed between them. Of fitting rules those that another fitting rule contains are left out.

Edge cases: null and empty texts have one empty sentence at most and no licence; rows are scanned one by one, so
repeated rows and null doc_ids change nothing; of known sentences that begin alike the longest counts; a very long text
is scanned whole in one row's memory; an empty table gives an empty result; other columns are ignored, whatever their
names. Everything is row by row, so there is no shuffle.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import plain

#: Known sentences (normalised) by identifier.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the apache license version 2 0",
    3: "this work is licensed under the gnu general public license version 3",
    4: "licensed under cc by nc 4 0",
    5: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    6: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    7: "the software is provided as is without warranty of any kind express or implied",
    8: "you may not use this file except in compliance with the license",
    9: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    10: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    11: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    12: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    13: "this work is licensed under a creative commons attribution 4 0 international license",
    14: "this software is provided by the copyright holders and contributors as is",
}
#: The same sentences as the licences themselves have them, where they differ; " | " is a sentence end inside.
GENUINE = {
    2: "licensed under the apache license version 2 0 the license",
    5: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    7: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    12: "this program is free software | you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    14: "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
}
#: Ordered rules: name, licence, identifiers in order.
RULES = [
    ("mit-line", "MIT", [1]),
    ("mit-full", "MIT", [5, 6, 7]),
    ("apache-line", "Apache-2.0", [2]),
    ("apache-header", "Apache-2.0", [2, 8, 9]),
    ("gpl3-line", "GPL-3.0", [3]),
    ("gpl3-header", "GPL-3.0-or-later", [12]),
    ("cc-by-nc-line", "CC-BY-NC-4.0", [4]),
    ("cc-by-line", "CC-BY-4.0", [13]),
    ("bsd2", "BSD-2-Clause", [10, 14]),
    ("bsd3", "BSD-3-Clause", [10, 11, 14]),
]
#: Cuts between sentences, and what normalising turns into one space.
CUT, OTHER = r"\n+|[.!?;:]+\s+", "[^a-z0-9]+"
#: Cuts that no known sentence runs over, and what is normalised when cuts ("|") and line ends ("~") are marked.
FULL_CUT, UNMARKED = r"[.!?;:]+\s+|\n[^\S\n]*\n\s*", "[^a-z0-9|~]+"


def pattern(ids: list[int]) -> str:
    """Matches the comma-framed identifiers (",1,5,6,7,") where the rule's stand in order."""
    return ",(?:[0-9]+,)*".join(map(str, ids)).join((",", ","))


def contained(rules: list[tuple[str, str, list[int]]] = RULES) -> dict[str, list[str]]:
    """Rules by those that contain them in order."""

    def within(a: list[int], b: list[int]) -> bool:
        it = iter(b)
        return len(a) < len(b) and all(x in it for x in a)

    return {n: [m for m, _, other in rules if within(ids, other)] for n, _, ids in rules}


def known_sentences() -> list[tuple[int, str]]:
    """(identifier, normalised sentence) of the built-in table, short and genuine forms."""
    return [*SENTENCES.items(), *GENUINE.items()]


def sentence_pattern(sentences: list[tuple[int, str]]) -> str:
    """Matches a known sentence of a marked text, framed by marks."""
    forms = sorted({s for _, s in sentences}, key=lambda s: (-len(s), s))
    wrapped = [r"(?: [|~])? ".join(part.replace(" ", "(?: ~)? ") for part in s.split(" | ")) for s in forms]
    return f"(?<=[|~] )(?:{'|'.join(wrapped)})(?= [|~])"


def scan(docs: DataFrame, sentences: list[tuple[int, str]] | None = None, rules: list[tuple[str, str, list[int]]] = RULES) -> DataFrame:
    """Per row: doc_id, n_sentences, sentence_ids (comma-joined), rules, licenses (comma-joined, sorted).

    ``sentences``: (identifier, sentence in lower-case letters and digits with single spaces, " | " for a sentence end
    inside), several forms of one identifier allowed; ``rules``: (name, licence, identifiers in order).
    """
    sentences = known_sentences() if sentences is None else sentences
    plain_forms = {s.replace(" | ", " "): i for i, s in sentences}
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(plain_forms.items())])
    low = F.lower(F.coalesce("text", F.lit("")))
    n = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), CUT), lambda s: F.lower(s).rlike("[a-z0-9]"))).cast("long")
    marked = F.regexp_replace(F.regexp_replace(F.translate(low, "|~", ",,"), FULL_CUT, " | "), "\n", " ~ ")
    df = plain(docs, "doc_id", "text").withColumn("text", F.col("text").cast("string"))
    df = df.select("doc_id", n.alias("n_sentences"), F.concat(F.lit("| "), F.btrim(F.regexp_replace(marked, UNMARKED, " ")), F.lit(" |")).alias("marked"))
    hits = F.regexp_extract_all("marked", F.lit(sentence_pattern(sentences)), F.lit(0))
    df = df.select("doc_id", "n_sentences", F.array_join(F.transform(hits, lambda s: F.element_at(known, F.regexp_replace(s, "[|~] ", "")).cast("string")), ",").alias("sentence_ids"))
    framed = F.concat(F.lit(","), F.col("sentence_ids"), F.lit(","))
    df = df.select("*", F.array(*[framed.rlike(pattern(ids)) for _, _, ids in rules]).alias("fits"))
    place, wider = {n: i for i, (n, _, _) in enumerate(rules)}, contained(rules)
    alone = {}
    for n, licence, _ in rules:
        cond = F.get("fits", place[n])
        for m in wider[n]:
            cond = cond & ~F.get("fits", place[m])
        alone[n] = (cond, licence)
    listed = lambda which: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(n if which else lic)) for n, (c, lic) in alone.items()])))), ",")
    return df.select("doc_id", "n_sentences", "sentence_ids", listed(True).alias("rules"), listed(False).alias("licenses"))
