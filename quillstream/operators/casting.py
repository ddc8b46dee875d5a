"""The casting table (book_id, speaker_key, name, voice, emotion, description) and what is looked up in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import speaker_key
from quillstream.functions.values import FALLBACK_VOICE, NARRATOR

COLUMNS = ("book_id", "speaker_key", "name", "voice", "emotion", "description")


def keyed(speakers: DataFrame, column: str = "speaker") -> DataFrame:
    return speakers.withColumn("speaker_key", speaker_key(F.col(column)))


def cast(casting: DataFrame, new: DataFrame) -> DataFrame:
    """casting with the rows of new (book_id, seq, name, voice, emotion, description) put in; the last of equal keys replaces the whole record."""
    old = casting.select(*COLUMNS, F.lit(-1).cast("long").alias("seq"))
    added = new.select("book_id", speaker_key(F.col("name")).alias("speaker_key"), "name", "voice", "emotion", "description", F.col("seq").cast("long").alias("seq"))
    record = F.struct(*COLUMNS[2:])
    latest = old.unionByName(added).groupBy("book_id", "speaker_key").agg(F.max_by(record, "seq").alias("r"))
    return latest.select("book_id", "speaker_key", "r.*")


def narrator_cast(books: DataFrame) -> DataFrame:
    """Every new book's first cast: the narrator."""
    null = F.lit(None).cast("string")
    return books.select("book_id", F.lit(NARRATOR).alias("speaker_key"), F.lit(NARRATOR).alias("name"), F.lit(FALLBACK_VOICE).alias("voice"), F.lit("calm").alias("emotion"), null.alias("description")).distinct()


def voice_lookup(utterances: DataFrame, casting: DataFrame, narrator: str = NARRATOR, fallback: str = FALLBACK_VOICE) -> DataFrame:
    """Adds voice and voice_emotion: the speaker's, else the narrator's, else the fallback without emotion."""
    entry = lambda name: F.struct(F.col("voice").alias("voice"), F.col("emotion").alias("voice_emotion")).alias(name)
    own = casting.select("book_id", "speaker_key", entry("_own"))
    told = casting.where(F.col("speaker_key") == narrator).select("book_id", entry("_told"))
    last = F.struct(F.lit(fallback).alias("voice"), F.lit(None).cast("string").alias("voice_emotion"))
    rows = keyed(utterances).join(own, ["book_id", "speaker_key"], "left").join(told, "book_id", "left")
    return rows.withColumn("_voice", F.coalesce("_own", "_told", last)).select(*utterances.columns, "_voice.*")


def voice_mapping(casting: DataFrame) -> DataFrame:
    return casting.select("book_id", speaker_key(F.col("name")).alias("speaker_key"), "voice")


def uncast_speakers(utterances: DataFrame, casting: DataFrame) -> DataFrame:
    """Keys of speakers in the text that are not cast."""
    return keyed(utterances).select("book_id", "speaker_key").distinct().join(casting, ["book_id", "speaker_key"], "left_anti")


def missing_voices(casting: DataFrame, available: DataFrame, fallback: str = FALLBACK_VOICE) -> DataFrame:
    """Voices that are cast, or the fallback, but not to be had."""
    wanted = casting.select(F.col("voice").alias("voice_id"))
    return wanted.union(wanted.sparkSession.range(1).select(F.lit(fallback).alias("voice_id"))).distinct().join(available.select("voice_id"), "voice_id", "left_anti")


def line_counts(utterances: DataFrame, casting: DataFrame) -> DataFrame:
    """How many utterances each cast character speaks."""
    lines = keyed(utterances).groupBy("book_id", "speaker_key").agg(F.count("*").alias("line_count"))
    return casting.join(lines, ["book_id", "speaker_key"], "left").select("book_id", "speaker_key", "name", "voice", F.coalesce("line_count", F.lit(0)).cast("long").alias("line_count"))


def speaker_report(utterances: DataFrame, casting: DataFrame) -> DataFrame:
    """Every detected speaker with voice and lines, or [uncast]; keys here are plain lower case."""
    counts = line_counts(utterances, casting).select("book_id", "speaker_key", "voice", "line_count")
    found = utterances.select("book_id", "speaker").distinct().withColumn("speaker_key", F.lower("speaker"))
    text = F.when(F.col("voice").isNull(), F.lit("[uncast]")).otherwise(F.concat("voice", F.lit(" ("), F.col("line_count").cast("string"), F.lit(" lines)")))
    return found.join(counts, ["book_id", "speaker_key"], "left").select("book_id", "speaker", text.alias("report"))


def filter_voices(voices: DataFrame, gender: str | None = None, search: str | None = None, info: Column | None = None) -> DataFrame:
    """Voices by gender (af_ and bf_ are female, all others male) and by a search word in id or description, any case."""
    out = voices
    if gender:
        female = F.col("voice_id").startswith("af_") | F.col("voice_id").startswith("bf_")
        out = out.where(female if gender == "female" else ~female)
    if search:
        hit = F.contains(F.lower("voice_id"), F.lit(search.lower()))
        out = out.where(hit | F.contains(F.lower(info), F.lit(search.lower())) if info is not None else hit)
    return out.orderBy("voice_id")
