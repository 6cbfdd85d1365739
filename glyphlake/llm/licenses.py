"""Operator 3 (native): licence scan by a positional rare-token index.

Templates are indexed as postings (word, template, position). Corpus-wide document counts of the
licence words give their IDF. For each template with a key phrase in the file, the file's highest-IDF words of
that template are looked up in the postings; every hit votes for the template at a relative position (file position minus template position), the
best-supported place of each template gives its score, and a template's label stands only if one of its
mandatory key phrases is in the file. The base labels come from phrases alone.

A file without the word of any key phrase can get no label, so only files that have one are
indexed; that filter loses nothing. Templates and postings are a fixed, small set; the IDF table
has a row for each licence word at most. Everything happens inside a row, without a shuffle, but for the document counts (one row for
each licence word and task).

A null text has no words; very long texts are taken whole; repeated rows are scanned one by one; of words with equal IDF the
smaller comes first; an empty table gives an empty result; columns besides the id and the text are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.common import documents, let

#: Phrase to base label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices and conditions of public licences in their own wording (case and punctuation don't count), with key phrases of which one is mandatory.
LONG = [
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in
the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind""",
     ["permission is hereby granted free of charge to any person obtaining a copy"]),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and
this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness""",
     ["permission to use copy modify and or distribute this software for any purpose with or without fee"]),
    ("bsd-3-clause", """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code
must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from this software without specific prior written permission""",
     ["may be used to endorse or promote products derived from this software"]),
    ("apache-2.0-notice", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at
unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the
specific language governing permissions and limitations under the license""",
     ["unless required by applicable law or agreed to in writing software"]),
    ("gpl-notice", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either
version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular
purpose see the gnu general public license for more details""",
     ["under the terms of the gnu general public license as published by the free software foundation"]),
    ("lgpl-notice", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation
either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful""",
     ["gnu lesser general public license"]),
    ("agpl-notice", """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation
either version 3 of the license or at your option any later version""",
     ["gnu affero general public license"]),
    ("mpl-2.0-notice", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at""",
     ["if a copy of the mpl was not distributed with this file"]),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code
form or as a compiled binary for any purpose commercial or non commercial and by any means""",
     ["free and unencumbered software released into the public domain"]),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions""",
     ["permission is granted to anyone to use this software for any purpose including commercial applications"]),
    ("bsl-1.0", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use
reproduce display distribute execute and transmit the software and to prepare derivative works of the software""",
     ["boost software license", "obtaining a copy of the software and accompanying documentation covered by this license"]),
    ("cc0-1.0", """to the extent possible under law the author has waived all copyright and related or neighboring rights to this work under the creative commons zero dedication""",
     ["waived all copyright and related or neighboring rights"]),
]
#: (label, short licence wording, key phrases of which one is mandatory), then the long ones.
TEMPLATES = [
    ("mit-notice", "released under the mit license permission is hereby granted free of charge to any person obtaining a copy of this software", ["mit license"]),
    ("apache-2.0", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ["apache license version 2 0"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "this program is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["licensed under cc by nc"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted bsd license", ["bsd license", "redistribution and use in source and binary forms"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    *LONG,
]
#: Words of a file that are looked up for each template, highest IDF first.
RARE = 8
#: Share of a template's looked-up weight that must agree on one place.
AGREE = 0.5

WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"
VOCABULARY = sorted({w for _, wording, keys in TEMPLATES for x in (wording, *keys) for w in x.split()})
#: Every label needs a phrase that has one of these words.
GATE = re.compile("|".join(["license", "licensed", "commons", "redistribution", "permission", "derived", "applicable", "distributed", "unencumbered", "neighboring"]))


def _lower(text: Column) -> Column:
    """A-Z only: other letters stay (the Kelvin sign would turn into k)."""
    return F.lower(F.regexp_replace(text, "\u212a", "\u00c5"))


def _words(text: Column) -> Column:
    return F.filter(F.split(_lower(F.coalesce(text, F.lit(""))), f"[^{WORD}]+"), lambda w: w != "")


def document_counts(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Rows, and rows that hold each licence word; over all rows."""
    mine = F.array_distinct(F.filter(_words(docs[text_col]), lambda w: w.isin(VOCABULARY)))
    # One more word for each row counts the rows.
    words = docs.select(F.explode(F.concat(F.array(F.lit("")), mine)).alias("w"))
    counts = {r["w"]: r["n"] for r in words.groupBy("w").agg(F.count("*").alias("n")).collect()}
    return counts.pop("", 0), counts


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts (from 0) where the phrase's words stand one after another."""
    def here(w: Column, i: Column) -> Column:
        ok = w == phrase[0]
        for k, p in enumerate(phrase[1:], 1):
            ok = ok & (F.get(words, i + k) == p)
        return F.when(ok, i.cast("long"))

    return F.filter(F.transform(words, here), lambda x: x.isNotNull())


def _base(words: Column) -> Column:
    def labelled(places: Column, label: str) -> Column:
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    return F.concat(*[labelled(_places(words, p.split()), label) for p, label in PHRASES.items()])


def _best_place(votes: Column) -> Column:
    """The largest sum of IDF over votes that agree on an offset."""

    def at(m: Column, o: Column) -> Column:
        return F.aggregate(F.filter(m, lambda x: x["offset"] == o), F.lit(0.0), lambda a, x: a + x["idf"])

    return let(votes, lambda m: F.array_max(F.transform(F.array_distinct(F.transform(m, lambda x: x["offset"])), lambda o: at(m, o))))


def _literal_map(values: dict[str, object], to) -> Column:
    return F.create_map(*[c for k, v in values.items() for c in (F.lit(k), to(v))])


def _method(words: Column, idf: dict[str, float]) -> Column:
    """Array of struct(label, score) of the templates that stand in the file."""
    weight = _literal_map(idf, F.lit)
    hits = F.filter(F.transform(words, lambda w, i: F.struct(F.when(w.isin(VOCABULARY), weight[w]).alias("idf"), w.alias("w"), i.alias("at"))), lambda h: h["idf"].isNotNull())

    def score(h: Column, wording: list[str]) -> Column:
        postings = _literal_map({w: [i for i, x in enumerate(wording) if x == w] for w in sorted(set(wording))}, lambda p: F.array(*map(F.lit, p)))

        def of_rare(mine: Column, rare: Column) -> Column:
            chosen = F.filter(mine, lambda x: F.exists(rare, lambda y: y["w"] == x["w"]))
            votes = F.flatten(F.transform(chosen, lambda x: F.transform(postings[x["w"]], lambda i: F.struct((x["at"] - i).alias("offset"), x["idf"].alias("idf")))))
            reach = F.aggregate(rare, F.lit(0.0), lambda a, y: a - y["o"])
            return F.when(reach > 0, F.least(F.lit(1.0), F.coalesce(_best_place(votes), F.lit(0.0)) / reach)).otherwise(F.lit(0.0))

        def of_words(mine: Column) -> Column:
            # The template's highest-IDF words in the file (ties by the word).
            rare = F.slice(F.sort_array(F.array_distinct(F.transform(mine, lambda x: F.struct((-x["idf"]).alias("o"), x["w"].alias("w"))))), 1, RARE)
            return let(rare, lambda r: of_rare(mine, r))

        return let(F.filter(h, lambda x: x["w"].isin(sorted(set(wording)))), of_words)

    def scored(h: Column) -> Column:
        out = []
        for label, wording, keys in TEMPLATES:
            key = F.lit(False)
            for k in keys:
                key = key | (F.size(_places(words, k.split())) > 0)
            out.append(F.when(key, F.struct(F.lit(label).alias("label"), score(h, wording.split()).alias("score"))))
        return F.filter(F.array(*out), lambda x: x.isNotNull() & (x["score"] >= AGREE))

    return let(hits, scored)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    n, counts = document_counts(docs, text_col)
    idf = {w: math.log((1 + n) / (1 + counts.get(w, 0))) + 0.01 for w in VOCABULARY}
    text = F.coalesce(docs[text_col], F.lit(""))

    def found(words: Column) -> Column:
        return F.struct(_base(words).alias("base"), _method(words, idf).alias("method"))

    kind = "struct<base:array<struct<at:bigint,label:string>>,method:array<struct<label:string,score:double>>>"
    gate = F.lower(text).rlike(GATE.pattern)
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        F.regexp_count(text, F.lit(f"[{WORD}]+")).cast("long").alias("n_words"),
        F.when(gate, let(_words(text), found)).otherwise(F.lit(None).cast(kind)).alias("f"),
    )
    rows = rows.select("doc_id", "n_words", F.coalesce("f.base", F.array().cast("array<struct<at:bigint,label:string>>")).alias("b"), F.coalesce("f.method", F.array().cast("array<struct<label:string,score:double>>")).alias("m"))
    labels = lambda c: F.transform(c, lambda x: x["label"])
    joined = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return rows.select(
        "doc_id",
        "n_words",
        F.size("b").cast("long").alias("n_base"),
        F.array_min(F.transform("b", lambda x: x["at"])).alias("first_word"),
        F.array_max(F.transform("b", lambda x: x["at"])).alias("last_word"),
        joined(labels(F.col("b"))).alias("base_labels"),
        joined(F.concat(labels(F.col("b")), labels(F.col("m")))).alias("labels"),
        F.round(F.greatest(F.coalesce(F.array_max(F.transform("m", lambda x: x["score"])), F.lit(0.0)), F.when(F.size("b") > 0, F.lit(AGREE)).otherwise(F.lit(0.0))), 6).alias("score"),
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
