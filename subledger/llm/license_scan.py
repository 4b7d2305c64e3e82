"""License scan over a positional index of rare words of licence notices.

Each template is a notice as words; its key phrase is mandatory. The inverse document frequency of every template word is
counted over all documents. The index has a posting (template, place in it) for each of a template's rarest words, and for its key phrase's. A file's words that are in the index are looked up: the
word's place in the file, less its place in the template, is an offset at which the template could start. Offsets that enough postings of a template agree on are candidates; there the key phrase is
verified word by word, and the rest of the notice is weighed by what stands in its place.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subledger.llm.common import let

#: What stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_at: int
    key_length: int
    base: bool = False

    @property
    def key(self) -> tuple[str, ...]:
        return self.words[self.key_at : self.key_at + self.key_length]


def template(label: str, notice: str, key: str, base: bool = False) -> Template:
    words, phrase = notice.split(), key.split()
    at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
    return Template(label, tuple(words), at, len(phrase), base)


# Phrases of the three base labels, and the wording of common licences' notices, of which the key phrase is mandatory.
TEMPLATES = (
    template("cc-by", "cc by", "cc by", base=True),
    template("gpl", "general public license", "general public license", base=True),
    template("reserved", "all rights reserved", "all rights reserved", base=True),
    template(
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu affero general public license",
    ),
    template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "apache license",
    ),
    template("apache", "apache license version 2 0", "apache license"),
    template(
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "unless required by applicable law or agreed to in writing software distributed under the license",
    ),
    template("boost", "distributed under the boost software license version 1 0", "boost software license"),
    template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer",
        "redistribution and use in source and binary forms",
    ),
    template("bsd", "use of this source code is governed by a bsd style license that can be found in the license file", "governed by a bsd style license"),
    template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    template("eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "gnu general public license",
    ),
    template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "permission to use copy modify and or distribute this software",
    ),
    template(
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
        "lesser general public license",
    ),
    template("lgpl", "gnu lesser general public license", "lesser general public license"),
    template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge to any person obtaining a copy of this software",
    ),
    template("mit", "released under the mit license", "mit license"),
    template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
)
#: Postings of a template: so many of its words of highest inverse document frequency, besides its key phrase.
RARE_WORDS = 8
#: Share of a template's postings that must agree on an offset, key phrase included.
AGREE = 0.4


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.regexp_replace(F.regexp_replace(lower, "^" + BETWEEN, ""), BETWEEN + r"\z", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BETWEEN))


def _texts(words) -> Column:
    """A literal array of words as one expression, so that plans stay small."""
    return F.split(F.lit(" ".join(words)), " ")


#: The index as a literal: ``lead`` is the place of the key phrase's rarest word, ``rare`` are all places with a posting, ``parts`` the words' shares of the summed inverse document frequency,
#: ``enough`` the number of postings that must agree.
_INDEX = "array<struct<label:string,base:boolean,words:array<string>,parts:array<double>,key:array<string>,key_at:int,lead:int,rare:array<int>,enough:int>>"


def _vocabulary(templates) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def word_idf(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> dict[str, float]:
    """The smoothed inverse document frequency, over all documents, of each word of the templates (a fixed list)."""
    vocabulary = _texts(_vocabulary(templates))
    held = docs.select(F.explode(F.concat(F.array_intersect(vocabulary, words_of(F.col(text_col))), F.array(F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = {r["word"]: r["n"] for r in held.collect()}  # one row for each template word, and one for all documents
    return {w: math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in _vocabulary(templates)}


def postings(t: Template, idf: dict[str, float]) -> list[int]:
    """Places in a template that are in the index: its key phrase and its rarest words, rarest first."""
    rarest = sorted(range(len(t.words)), key=lambda i: (-idf[t.words[i]], i))
    key = set(range(t.key_at, t.key_at + t.key_length))
    return [i for i in rarest if i in key or i in rarest[: 0 if t.base else RARE_WORDS]]


def scan_licenses(docs: DataFrame, text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """``docs`` with n_words, places (array of label, start, base; start counts words from 0), labels and score, in the struct ``scan``.

    A null or empty text has no words, no places and score 0. ``score`` is the largest share of a template's summed inverse document frequency that
    stands in its right place around a verified key phrase. A label's places are those of its templates' key phrases, each once. Rows are judged alone, so repeated rows get equal results; every input column stays as it
    is, but for one named ``scan``, which is replaced.
    """
    idf = word_idf(docs, text_col, templates)
    index = []
    for t in templates:
        at, whole = postings(t, idf), sum(idf[w] for w in t.words)
        lead = next(i for i in at if t.key_at <= i < t.key_at + t.key_length)
        enough = t.key_length + (math.ceil(AGREE * (len(at) - t.key_length)) if len(t.words) > t.key_length + RARE_WORDS else 0)
        index.append({"label": t.label, "base": t.base, "words": t.words, "parts": [idf[w] / whole for w in t.words], "key": t.key, "key_at": t.key_at, "lead": lead, "rare": at, "enough": enough})
    #: No place can be without the rarest word of its key phrase; other files need no look-up.
    leads = _texts(sorted({x["words"][x["lead"]] for x in index}))

    def verified(words: Column, t: Column, o: Column) -> Column:
        """Whether enough of a template's postings agree on offset ``o``, and the whole key phrase stands there."""
        agree = F.filter(t["rare"], lambda i: F.coalesce(F.get(words, o + i) == F.get(t["words"], i), F.lit(False)))
        return F.when(o + t["key_at"] >= 0, (F.slice(words, o + t["key_at"] + 1, F.size(t["key"])) == t["key"]) & (F.size(agree) >= t["enough"])).otherwise(False)

    def share(words: Column, t: Column, o: Column) -> Column:
        in_place = F.zip_with(F.transform(t["words"], lambda w, i: F.get(words, o + i) == w), t["parts"], lambda x, p: F.when(x, p).otherwise(0.0))
        return F.least(F.lit(1.0), F.aggregate(in_place, F.lit(0.0), lambda s, x: s + x))

    def look_up(words: Column) -> Column:
        """Array of (label, base, start, share): the verified places of all templates."""
        posted = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))), lambda p: F.array_contains(leads, p["w"]))

        def of(posted: Column, t: Column) -> Column:
            offsets = F.transform(F.filter(posted, lambda p: p["w"] == F.get(t["words"], t["lead"])), lambda p: p["at"] - t["lead"])
            found = F.filter(offsets, lambda o: verified(words, t, o))
            return F.transform(found, lambda o: F.struct(t["label"].alias("label"), (o + t["key_at"]).cast("long").alias("start"), t["base"].alias("base"), share(words, t, o).alias("share")))

        return let(posted, lambda p: F.flatten(F.transform(F.from_json(F.lit(json.dumps(index)), _INDEX), lambda t: of(p, t))))

    none = F.array().cast("array<struct<label:string,start:bigint,base:boolean,share:double>>")

    def judged(words: Column) -> Column:
        hits = F.when(F.arrays_overlap(leads, words), look_up(words)).otherwise(none)
        return let(hits, lambda h: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.array_distinct(F.transform(h, lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["base"].alias("base")))).alias("places"),
            F.coalesce(F.array_max(F.transform(h, lambda x: x["share"])), F.lit(0.0)).alias("score"),
        ))

    return docs.withColumn("scan", let(words_of(F.col(text_col)), judged))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: the places of the base phrases and the labels, as columns."""
    rows = scan_licenses(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "scan")
    base = F.transform(F.filter("scan.places", lambda p: p["base"]), lambda p: p["start"])
    labels = lambda only: F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("scan.places", lambda p: p["base"] if only else F.lit(True)), lambda p: p["label"]))), ",")
    return rows.select(
        "doc_id", F.col("scan.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(base).alias("first_word"), F.array_max(base).alias("last_word"),
        labels(True).alias("base_labels"), labels(False).alias("labels"), F.col("scan.score").alias("score"),
    )
