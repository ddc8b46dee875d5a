"""License scans with a positional rare-token index (operator 8).  Built-in functions only.

A template is a licence's usual words.  Of the licence words that a document has, the
rarest by document frequency over all documents are looked up in the index; each
posting gives a relative position (place in the document less place in the template),
and postings of one template that agree on it add up their weights.  A template
whose weight is mostly found, and whose key phrases all stand in the text, labels it.
A template that has none of the document's rarest, as other licences' words took all
the places, is looked up by the rarest of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.llm.common import fold_case, let, settled, written

#: Label, usual words, mandatory key phrases.
TEMPLATES = (
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("affero general public license", "version 3")),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license", "version 2")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd", "released under the bsd 3 clause license", ("bsd 3 clause license",)),
    ("bsd", "released under the bsd license", ("the bsd license",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc0", "dedicated to the public domain under cc0 1 0", ("cc0 1 0",)),
    ("gpl-2", "this program is free software licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("mit", "released under the mit license", ("the mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license", "version 2")),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
)
#: Phrases that are reported wherever their words stand consecutively.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Licence words that are looked up for a document, rarest first; the share of a template's weight among them that has to be found.
LOOKED_UP, THRESHOLD = 8, 0.6

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in text.split()})


def normalised(text: Column) -> Column:
    """Words in lower case (A to Z), each with one blank before and after it."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(fold_case(F.coalesce(text, F.lit(""))), NOT_WORD, " ")), F.lit(" "))


def word_array(norm: Column) -> Column:
    return F.array_remove(F.split(norm, " "), "")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def document_frequencies(prepared: DataFrame) -> tuple[dict[str, int], int]:
    """In how many of all documents each licence word stands, and the number of documents."""
    found = prepared.select(F.explode(F.array_intersect(strings(vocabulary()), "words")).alias("word"))
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}, prepared.count()


def index_rows(frequency: dict[str, int], total: int) -> list[tuple[int, str, int, float]]:
    """The postings: template, word, place in the template, weight (inverse document frequency)."""
    import math

    weight = lambda w: math.log((total + 1) / (frequency.get(w, 0) + 1)) + 0.01
    return [(t, w, place, weight(w)) for t, (_, text, _) in enumerate(TEMPLATES) for place, w in enumerate(text.split())]


def phrase_starts(norm: Column, words: Column, phrase: str) -> Column:
    """The word places where a phrase begins."""
    parts = phrase.split()

    def begins(w: Column, i: Column) -> Column:
        hit = w == parts[0]
        for k, p in enumerate(parts[1:], 1):
            hit = hit & F.coalesce(F.get(words, i + k) == p, F.lit(False))
        return F.when(hit, i.cast("long"))

    none = F.array().cast("array<long>")
    return F.when(F.contains(norm, F.lit(f" {phrase} ")), F.filter(F.transform(words, begins), lambda x: x.isNotNull())).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    Places are word numbers from 0; first_word and last_word are null without a base phrase, labels then empty text.
    score is the greatest share of a template's looked-up weight that was found, 1 for a base phrase, 0 for neither.  A null
    text counts as empty; rows with one doc_id are scanned each; a row without a doc_id as well; other columns are left
    behind.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    prepared = docs.select(normalised(text).alias("norm")).select(word_array(F.col("norm")).alias("words"))
    frequency, total = document_frequencies(prepared)
    postings = index_rows(frequency, total)
    weight = {w: x for _, w, _, x in postings}
    rarest_first = strings(sorted(weight, key=lambda w: (-weight[w], w)))

    key = F.struct(F.col("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    normal = settled(docs.select("doc_id", key.alias("key"), text.alias("_text")), normalised(F.col("_text")).alias("norm")).drop("_text")

    # Documents that have all key phrases of a template, with their rarest licence words and where these stand.
    verified = F.filter(F.array(*[F.when(_all(F.contains("norm", F.lit(f" {p} ")) for p in phrases), F.lit(t)) for t, (_, _, phrases) in enumerate(TEMPLATES)]), lambda x: x.isNotNull())
    some = settled(normal, verified.alias("verified")).where(F.size("verified") > 0)
    own = F.array(*[F.slice(F.array_intersect(strings(sorted(set(t.split()), key=lambda w: (-weight[w], w))), "words"), 1, LOOKED_UP) for _, t, _ in TEMPLATES])
    found = settled(some.select("key", "verified", "norm"), word_array(F.col("norm")).alias("words")).select("key", "verified", "words", F.slice(F.array_intersect(rarest_first, "words"), 1, LOOKED_UP).alias("rare"), own.alias("own"))
    hits = found.select("key", "verified", "rare", "own", F.posexplode_outer("words").alias("place", "word"))
    index = F.broadcast(spark.createDataFrame(postings, "template int, word string, at int, weight double"))  # one row per template word
    met = hits.join(index, "word").where(F.array_contains("verified", F.col("template")))
    met = met.select("key", "template", "rare", F.get("own", F.col("template")).alias("own"), "word", "at", (F.col("place") - F.col("at")).alias("relative"), "weight").distinct()

    def sought(words: str) -> Column:
        """What a template's looked-up words would weigh together, each place once; null if it has none."""
        posted = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w"), F.lit(x).alias("x")) for t, w, _, x in postings])
        return F.nullif(F.aggregate(posted, F.lit(0.0), lambda a, p: a + F.when((p["t"] == F.col("template")) & F.array_contains(words, p["w"]), p["x"]).otherwise(0.0)), F.lit(0.0))

    weighed = lambda words: F.sum(F.when(F.array_contains(words, F.col("word")), F.col("weight")))
    aligned = met.groupBy("key", "template", "rare", "own", "relative").agg(weighed("rare").alias("of_rare"), weighed("own").alias("of_own"))
    most = aligned.groupBy("key", "template", "rare", "own").agg(F.max("of_rare").alias("of_rare"), F.max("of_own").alias("of_own"))
    shares = most.select("key", "template", (F.col("of_rare") / sought("rare")).alias("by_rare"), (F.col("of_own") / sought("own")).alias("by_own"))
    # Where other licences have taken all the places, the template's own words decide.
    scored = shares.select("key", "template", F.coalesce("by_rare", "by_own").alias("share"))
    names = strings(label for label, _, _ in TEMPLATES)
    method = scored.groupBy("key").agg(F.max("share").alias("best"), F.collect_set(F.when(F.col("share") >= THRESHOLD, F.get(names, F.col("template")))).alias("found_labels"))
    method = written(method.select(F.col("key.doc_id").alias("m_id"), F.col("key.h").alias("m_h"), "best", "found_labels"), "license-labels")

    starts = F.array_sort(F.flatten(F.array(*[phrase_starts(F.col("norm"), F.col("words"), p) for p, _ in BASE])))
    base = F.filter(F.array(*[F.when(F.contains("norm", F.lit(f" {p} ")), F.lit(label)) for p, label in BASE]), lambda x: x.isNotNull())
    plain = settled(normal, word_array(F.col("norm")).alias("words")).select("doc_id", "key", F.size("words").cast("long").alias("n_words"), let(starts, lambda s: F.struct(F.size(s).cast("long").alias("n"), F.get(s, F.lit(0)).alias("a"), F.get(s, F.size(s) - 1).alias("b"))).alias("s"), base.alias("base"))
    joined = plain.join(method, F.col("key.doc_id").eqNullSafe(F.col("m_id")) & (F.col("key.h") == F.col("m_h")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found_labels", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id", "n_words", F.col("s.n").alias("n_base"), F.col("s.a").alias("first_word"), F.col("s.b").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.least(F.coalesce("best", F.lit(0.0)), F.lit(1.0))).alias("score"),
    )


def _all(conditions) -> Column:
    first, *rest = conditions
    for c in rest:
        first = first & c
    return first
