"""Emotion inference from verbs, a lexicon and punctuation."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions import values
from quillstream.functions.profile import ENGLISH, Profile, mood_verbs
from quillstream.functions.text import UNICODE_ANY_CASE, let, strip, words

MODES = ("off", "rule", "auto")
RESULT = "struct<label:string,confidence:double,source:string>"


def _result(label, confidence, source: str) -> Column:
    as_column = lambda x, kind: (x if isinstance(x, Column) else F.lit(x)).cast(kind)
    return F.struct(as_column(label, "string").alias("label"), as_column(confidence, "double").alias("confidence"), F.lit(source).alias("source"))


def from_verb(text: Column, profile: Profile | None = None) -> Column:
    """The hint of the first verb that has one; null without."""
    profile = profile or ENGLISH
    hints = mood_verbs(profile)
    if not hints:
        return F.lit(None).cast(RESULT)
    verb = F.lower(F.regexp_extract(text, UNICODE_ANY_CASE + rf"\b({'|'.join(map(re.escape, hints))})\b", 1))
    label = F.element_at(F.create_map(*[F.lit(x) for v in hints for x in (v, hints[v])]), F.when(verb != "", verb))
    return let(label, lambda x: F.when(x.isNotNull(), _result(x, values.VERB_CONFIDENCE, "verb")))


def from_lexicon(text: Column) -> Column:
    """The entry of highest confidence that the text has, the first of equals; null without."""
    best = F.lit(None).cast(RESULT)
    # The last entry in this order that is found wins, so the strongest and earliest comes last.
    for label, entry, confidence in sorted(reversed(values.EMOTION_LEXICON), key=lambda x: x[2]):
        best = F.when(text.rlike(UNICODE_ANY_CASE + rf"\b(?:{'|'.join(entry)})\b"), _result(label, confidence, "lexicon")).otherwise(best)
    # Most texts have none of the words: one search tells, instead of one for each entry.
    every = "|".join(x for _, entry, _ in values.EMOTION_LEXICON for x in entry)
    return F.when(text.rlike(UNICODE_ANY_CASE + rf"\b(?:{every})\b"), best)


def from_punctuation(text: Column) -> Column:
    """Exclamation marks, then words in capitals, then an ellipsis; null without."""
    capital = lambda w: (F.length(w) > 1) & (w == F.upper(w)) & (w != F.lower(w))
    return (
        F.when(text.rlike("!{2,}"), _result("excited", values.EXCLAIM_CONFIDENCE, "punctuation"))
        .when(F.size(F.filter(words(text), capital)) >= values.CAPITAL_WORDS, _result("angry", values.CAPITALS_CONFIDENCE, "punctuation"))
        .when(F.contains(text, F.lit("...")) | F.contains(text, F.lit("…")), _result("sad", values.ELLIPSIS_CONFIDENCE, "punctuation"))
    )


def infer(text: Column, context: Column | None = None, existing: Column | None = None, mode: str = "rule", threshold: float = values.EMOTION_THRESHOLD, profile: Profile | None = None) -> Column:
    """struct(label, confidence, source): a given emotion stays; verb, lexicon and punctuation follow, each if sure enough; else
    neutral with the confidence and source of the first that said anything."""
    if mode not in MODES:
        raise ValueError(f"emotion mode {mode!r}; there are {', '.join(MODES)}")
    if mode == "off":
        return _result("neutral", 0.0, "none")
    both = strip(F.concat(context if context is not None else F.lit(""), F.lit(" "), text))
    found = F.struct(let(both, lambda t: from_verb(t, profile)).alias("verb"), let(both, from_lexicon).alias("lexicon"), from_punctuation(text).alias("punctuation"))
    inferred = let(found, lambda r: decide(r["verb"], r["lexicon"], r["punctuation"], threshold))
    return inferred if existing is None else F.when(F.coalesce(existing, F.lit("")) != "", _result(existing, 1.0, "explicit")).otherwise(inferred)


def decide(verb: Column, lexicon: Column, punctuation: Column, threshold: float) -> Column:
    sure = lambda r: F.when(r["confidence"] >= threshold, r)
    neutral = lambda r: F.when(r.isNotNull(), F.struct(F.lit("neutral").alias("label"), r["confidence"].alias("confidence"), r["source"].alias("source")))
    return F.coalesce(sure(verb), sure(lexicon), sure(punctuation), neutral(verb), neutral(lexicon), neutral(punctuation), _result("neutral", 0.0, "none"))


def apply_emotions(utterances: DataFrame, chapters: DataFrame, mode: str = "rule", threshold: float = values.EMOTION_THRESHOLD, profile: Profile | None = None, exact: bool = False) -> DataFrame:
    """utterances with missing emotions inferred in the light of their chapter's text, and applied (boolean).

    The chapter is searched once and its verb and lexicon results joined to the utterances, which add their own text's.
    A phrase that begins in the chapter's last word and ends in the utterance's first is seen with ``exact`` alone, which
    searches chapter and utterance together for every utterance.
    """
    if mode not in MODES:
        raise ValueError(f"emotion mode {mode!r}; there are {', '.join(MODES)}")
    keys = ["book_id", "chapter_index"]
    if mode == "off":
        return utterances.withColumn("applied", F.lit(False))
    missing = F.coalesce(F.col("emotion"), F.lit("")) == ""
    if exact:
        joined = utterances.join(chapters.select(*keys, "raw_text"), keys)
        found = infer(F.col("text"), F.col("raw_text"), None, mode, threshold, profile)
    else:
        searched = chapters.select(*keys, from_verb(F.col("raw_text"), profile).alias("_verb"), from_lexicon(F.col("raw_text")).alias("_lexicon"))
        joined = utterances.join(searched, keys)
        own = from_lexicon(F.col("text"))
        lexicon = let(own, lambda o: F.when(o["confidence"] > F.coalesce(F.col("_lexicon.confidence"), F.lit(0.0)), o).when((o["confidence"] == F.col("_lexicon.confidence")) & (_rank(o) < _rank(F.col("_lexicon"))), o).otherwise(F.col("_lexicon")))
        found = decide(F.coalesce("_verb", from_verb(F.col("text"), profile)), lexicon, from_punctuation(F.col("text")), threshold)
    rows = joined.withColumn("_found", F.when(missing, found))
    sure = missing & (F.col("_found.label") != "neutral") & (F.col("_found.confidence") >= threshold)
    return rows.select(*[F.when(sure, F.col("_found.label")).otherwise(F.col("emotion")).alias("emotion") if c == "emotion" else F.col(c) for c in utterances.columns], F.coalesce(sure, F.lit(False)).alias("applied"))


def _rank(result: Column) -> Column:
    """A label's place in the lexicon."""
    labels = list(dict.fromkeys(label for label, _, _ in values.EMOTION_LEXICON))
    return F.array_position(F.array(*[F.lit(x) for x in labels]), result["label"])
