"""Licence scan with a positional rare-token index, in DataFrame functions only.

Licence templates are lists of words. For a text that may hold one, the template words it contains are
looked up; of each template's key phrase, the word with the highest inverse document frequency (over all
documents) gives candidates: a posting says where it stands in the template, and so where that would begin.
At such a beginning the other words' postings are intersected by relative position, and a template
counts where its mandatory key phrase stands, word for word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    phrase: str

    @property
    def at(self) -> int:
        """Place of the key phrase in the template."""
        w, p = self.words.split(), self.phrase.split()
        return next(i for i in range(len(w)) if w[i : i + len(p)] == p)


#: Notices and opening sentences of public licences, each with its mandatory key phrase.
TEMPLATES = [
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("apache", "licensed under the apache license version 2 0", "apache license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    Template("mpl", "subject to the terms of the mozilla public license version 2 0", "mozilla public license"),
    Template("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "permission to use copy modify and or distribute"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4"),
    Template("cc", "licensed under a creative commons attribution license", "creative commons attribution"),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work cc0", "waived all copyright and related or neighboring rights"),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included in all copies"),
    Template("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless required by applicable law or agreed to in writing software distributed under the license"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license as published by the free software foundation"),
    Template("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "names of its contributors may be used to endorse or promote products"),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
    Template("boost", "distributed under the boost software license version 1 0", "boost software license"),
    Template("cddl", "subject to the terms of the common development and distribution license", "common development and distribution license"),
    Template("eupl", "licensed under the european union public licence", "european union public licence"),
    Template("artistic", "this package is free software you can redistribute it under the artistic license 2 0", "artistic license 2 0"),
]

#: The base phrases and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]


def _array(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _words(text: Column) -> Column:
    """A text's words in their order. It is split between them: an expression that finds each word costs several times that."""
    return F.array_remove(F.split(_lowered(text), BETWEEN), "")


def _maybe(text: Column, templates: list[Template]) -> Column:
    """True for every text that holds a key or base phrase: it contains the longest word of one, or several short ones in a row."""
    low, anchors, rows = F.lower(text), set(), set()
    for phrase in [*(t.phrase for t in templates), *(p for p, _ in BASE)]:
        longest = max(phrase.split(), key=len)
        if len(longest) > 4:
            anchors.add(longest)
        else:
            rows.add(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+".join(phrase.split()[:2]))
    kept = [a for a in anchors if not any(b in a and b != a for b in anchors)]
    found = F.lit(False)
    for a in sorted(kept):
        found = found | low.contains(a)
    return found | low.rlike("|".join(sorted(rows))) if rows else found


def idf(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, float]:
    """Inverse document frequency of the template words over all documents; the vocabulary bounds the result."""
    words = _words(F.coalesce(F.col(text_col), F.lit("")))
    found = docs.select(F.explode(F.array_intersect(words, _array(vocabulary))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {r[0]: r[1] for r in found.collect()}
    total = docs.count()
    return {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 0.01 for w in vocabulary}


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, least_score: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and ``matches``.

    Null and empty texts have no words. ``matches`` lists (label, begin, score) of the templates found;
    ``begin`` can lie before the text's first word where a notice is cut. Without any, the labels are
    empty texts, the word places null and the score 0. Repeated rows get equal results; columns called
    like an added one are replaced. Of each template the rarest word of its key phrase asks the index, so
    every phrase that stands is found, whatever else the text holds.
    """
    templates = TEMPLATES if templates is None else templates
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
    docs = docs.drop(*added)
    vocabulary = sorted({w for t in templates for w in t.words.split()} | {w for p, _ in BASE for w in p.split()})
    weight = idf(docs, vocabulary, text_col)
    totals = [sum(weight[w] for w in t.words.split()) for t in templates]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("n_words", F.size(_words(text)).cast("long")).withColumn("__maybe", _maybe(text, templates))
    rows = rows.withColumn("__w", F.when(F.col("__maybe"), _words(text)))
    spots = F.transform("__w", lambda w, i: F.struct(i.alias("pos"), w.alias("word")))
    rows = rows.withColumn("__hits", F.filter(spots, lambda s: F.array_contains(_array(vocabulary), s["word"])))

    # each template's rarest phrase word asks the index: (template, begin), each once
    asking = []
    for t, x in enumerate(templates):
        phrase = x.phrase.split()
        i = min(range(len(phrase)), key=lambda i: (-weight[phrase[i]], phrase[i], i))
        asking.append(F.struct(F.lit(phrase[i]).alias("word"), F.lit(t).alias("t"), F.lit(x.at + i).alias("off")))
    postings = F.array(*asking)
    asked = F.filter("__hits", lambda h: F.exists(postings, lambda p: p["word"] == h["word"]))
    begins = F.flatten(F.transform(asked, lambda h: F.transform(F.filter(postings, lambda p: p["word"] == h["word"]), lambda p: F.struct(p["t"].alias("t"), (h["pos"] - p["off"]).alias("begin")))))
    rows = rows.withColumn("__begin", F.array_distinct(begins))

    # the key phrase first, as it is exact; then the share of the template's weight that stands in place
    phrase_at = F.array(*[F.lit(t.at) for t in templates])
    phrases = F.array(*[_array(t.phrase.split()) for t in templates])

    def holds(b: Column) -> Column:
        at = b["begin"] + phrase_at[b["t"]]
        return (at >= 0) & (F.slice(F.col("__w"), F.greatest(at, F.lit(0)) + 1, F.size(phrases[b["t"]])) == phrases[b["t"]])

    rows = rows.withColumn("__begin", F.filter("__begin", holds))
    template_words = F.array(*[_array(t.words.split()) for t in templates])
    weights = F.array(*[F.array(*[F.lit(weight[w]) for w in t.words.split()]) for t in templates])
    whole = F.array(*[F.lit(x) for x in totals])
    label_of = _array([t.label for t in templates])

    def scored(b: Column) -> Column:
        inside = F.transform(template_words[b["t"]], lambda w, i: F.when(F.get(F.col("__w"), (b["begin"] + i).cast("int")) == w, F.get(weights[b["t"]], i)).otherwise(0.0))
        share = F.aggregate(inside, F.lit(0.0), lambda acc, x: acc + x) / whole[b["t"]]
        return F.struct(label_of[b["t"]].alias("label"), b["begin"].cast("long").alias("begin"), F.least(F.lit(1.0), share).alias("score"))

    rows = rows.withColumn("__matches", F.filter(F.transform("__begin", scored), lambda m: m["score"] >= least_score))

    def places(words: list[str], label: str) -> Column:
        stand = F.filter("__hits", lambda h: (h["word"] == words[0]) & (F.slice(F.col("__w"), h["pos"] + 1, len(words)) == _array(words)))
        return F.transform(stand, lambda h: F.struct(h["pos"].cast("long").alias("pos"), F.lit(label).alias("label")))

    rows = rows.withColumn("__base", F.concat(*[places(p.split(), label) for p, label in BASE]))
    pos = F.transform("__base", lambda b: b["pos"])
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.array_distinct(F.transform("__base", lambda b: b["label"])), none)
    more = F.coalesce(F.transform("__matches", lambda m: m["label"]), none)
    return rows.select(
        *docs.columns,
        "n_words",
        F.when(F.col("__maybe"), F.size("__base")).otherwise(0).cast("long").alias("n_base"),
        F.array_min(pos).alias("first_word"),
        F.array_max(pos).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, more)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("__matches", lambda m: m["score"])), F.lit(0.0)).alias("score"),
        F.coalesce("__matches", F.array().cast("array<struct<label:string,begin:bigint,score:double>>")).alias("matches"),
    )
