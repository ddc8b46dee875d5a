"""Counts over books, chapters and utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import minutes, word_count


def chapter_words(chapters: DataFrame, words_per_minute: int = 150) -> DataFrame:
    """Adds n_words and est_minutes."""
    return chapters.withColumn("n_words", word_count(F.col("raw_text"))).withColumn("est_minutes", minutes(F.col("n_words"), words_per_minute))


def project_info(chapters: DataFrame, utterances: DataFrame | None = None, casting: DataFrame | None = None, words_per_minute: int = 150) -> DataFrame:
    """One row per book: n_chapters, total_words, est_minutes (one decimal), total_seconds, characters_cast, compiled, rendered.

    chapters has book_id, chapter_index, raw_text, duration_seconds and audio_exists; a book is compiled if all its chapters
    have utterances, rendered if all have audio.
    """
    keys = ["book_id", "chapter_index"]
    counted = chapters.withColumn("n_words", word_count(F.col("raw_text")))
    if utterances is not None:
        counted = counted.join(utterances.select(*keys).distinct().withColumn("_compiled", F.lit(True)), keys, "left")
    else:
        counted = counted.withColumn("_compiled", F.lit(None).cast("boolean"))
    info = counted.groupBy("book_id").agg(
        F.count("*").alias("n_chapters"), F.sum("n_words").alias("total_words"), F.sum("duration_seconds").alias("total_seconds"),
        F.bool_and(F.coalesce("_compiled", F.lit(False))).alias("compiled"), F.bool_and(F.coalesce("audio_exists", F.lit(False))).alias("rendered"))
    info = info.withColumn("est_minutes", F.bround(minutes(F.col("total_words"), words_per_minute), 1))
    if casting is None:
        return info.withColumn("characters_cast", F.lit(0).cast("long"))
    cast = casting.groupBy("book_id").agg(F.count("*").alias("characters_cast"))
    return info.join(cast, "book_id", "left").withColumn("characters_cast", F.coalesce("characters_cast", F.lit(0)).cast("long"))


def chapter_stats(utterances: DataFrame) -> DataFrame:
    """n_utterances and n_chars of each chapter."""
    return utterances.groupBy("book_id", "chapter_index").agg(F.count("*").alias("n_utterances"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def chapter_status(chapters: DataFrame, utterances: DataFrame) -> DataFrame:
    """number from 1, title, n_words and status (rendered, compiled or blank) of each chapter."""
    keys = ["book_id", "chapter_index"]
    compiled = utterances.select(*keys).distinct().withColumn("_compiled", F.lit(True))
    status = F.when(F.coalesce("audio_exists", F.lit(False)), F.lit("rendered")).when(F.col("_compiled"), F.lit("compiled")).otherwise(F.lit(""))
    return chapters.join(compiled, keys, "left").select(*keys, (F.col("chapter_index") + 1).alias("number"), "title", word_count(F.col("raw_text")).alias("n_words"), status.alias("status"))


def detected_speakers(utterances: DataFrame) -> DataFrame:
    return utterances.select("book_id", "speaker").distinct()
