"""Speakers of unknown quotes from another tool's attributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import casefold, strip
from quillstream.functions.values import NLP_CONFIDENCE, QUOTE_KEY_CHARS, UNKNOWN

MODES = ("on", "off", "auto")
CHAPTER = ["book_id", "chapter_index"]


def quote_key(text: Column) -> Column:
    return F.substring(casefold(strip(text)), 1, QUOTE_KEY_CHARS)


def resolve(utterances: DataFrame, quotes: DataFrame | None, mode: str = "auto") -> DataFrame:
    """utterances with unknown speakers named by quotes (book_id, chapter_index, quote_no, quote_text, speaker, confidence), and resolved (boolean).

    Of equal keys in a chapter the last confident quote counts.  Without quotes, ``on`` is an error and ``auto`` changes nothing.
    """
    if mode not in MODES:
        raise ValueError(f"resolver mode {mode!r}; there are {', '.join(MODES)}")
    if mode == "on" and quotes is None:
        raise RuntimeError("resolver mode is 'on', but there are no attributions")
    if mode == "off" or quotes is None:
        return utterances.withColumn("resolved", F.lit(False))
    sure = quotes.where((F.col("confidence") > NLP_CONFIDENCE) & (F.col("speaker") != ""))
    named = sure.groupBy(*CHAPTER, quote_key(F.col("quote_text")).alias("_key")).agg(F.max_by("speaker", "quote_no").alias("_speaker"))
    rows = utterances.withColumn("_key", F.when(F.col("speaker") == UNKNOWN, quote_key(F.col("text")))).join(named, [*CHAPTER, "_key"], "left")
    found = F.col("_speaker").isNotNull()
    return rows.select(*[F.coalesce("_speaker", "speaker").alias("speaker") if c == "speaker" else F.col(c) for c in utterances.columns], found.alias("resolved"))


def resolve_stats(resolved: DataFrame) -> DataFrame:
    """chapters_processed, utterances_examined, speakers_resolved and speakers_unchanged of each book."""
    return resolved.groupBy("book_id").agg(
        F.count_distinct("chapter_index").alias("chapters_processed"), F.count("*").alias("utterances_examined"),
        F.count_if("resolved").alias("speakers_resolved"), F.count_if(~F.col("resolved")).alias("speakers_unchanged"))
