"""The driver's tables in the roles of books, chapters, utterances, casting and render logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.values import VOICE_NOTES

TALK = "talk"
#: Who is cast in the conversations, and which voices are to be had.
CAST = (("narrator", "Narrator", "af_heart", "calm"), ("user", "User", "am_eric", None), ("assistant", "Assistant", "zz_unlisted", "happy"))
VOICES = tuple(v for v, _, _ in VOICE_NOTES) + ("xx_plain",)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one book: a conversation is a chapter, a turn a line, a role a speaker."""
    t = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "narration").otherwise("dialogue")
    return t.select(F.lit(TALK).alias("book_id"), F.col("conv_id").alias("chapter_index"), F.col("turn").alias("line_index"), F.col("role").alias("speaker"), "text", kind.alias("type"), F.when(F.col("turn") % 4 == 1, "calm").alias("emotion"))


def talk_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' chapters; every seventh title comes twice."""
    t = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    number = F.when(F.col("conv_id") % 7 == 6, F.col("conv_id") - 1).otherwise(F.col("conv_id"))
    return t.select(F.lit(TALK).alias("book_id"), F.col("conv_id").alias("chapter_index"), F.concat(F.lit("Talk "), number.cast("string")).alias("title"))


def casting(spark: SparkSession) -> DataFrame:
    rows = [(TALK, k, n, v, e, None) for k, n, v, e in CAST]
    return spark.createDataFrame(rows, "book_id string, speaker_key string, name string, voice string, emotion string, description string")


def voices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(v,) for v in VOICES], "voice_id string")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chapters of a book for each source."""
    t = table(spark, sf_dir, "documents")
    return t.select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_index"), F.concat(F.lit("Chapter "), F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("raw_text"), (F.col("n_chars") / 15.0).alias("duration_seconds"), (F.col("doc_id") % 3 == 0).alias("audio_exists"), F.concat(F.lit("chapter_"), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".wav")).alias("audio_path"))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as books with frontmatter, headings, quotes, overrides and curly quotes: each line becomes a paragraph."""
    def block(line, n):
        k = (F.floor(n / 5) + 1).cast("string")
        return (F.when(n % 5 == 0, F.concat(F.lit("Chapter "), k, F.lit(": Title "), k, F.lit('\n\n"'), line, F.lit('," said Alice.')))
                .when(n % 5 == 1, F.concat(F.lit('Bob whispered. "'), line, F.lit('"')))
                .when(n % 5 == 2, F.concat(F.lit('[Sarah|worried] "'), line, F.lit('"')))
                .when(n % 5 == 3, F.concat(F.lit("He said, “"), line, F.lit("” and left."))).otherwise(line))

    t = table(spark, sf_dir, "documents")
    body = F.array_join(F.transform(F.split(F.replace("text", F.lit('"'), F.lit("'")), "\n"), block), "\n\n")
    head = F.concat(F.lit("---\nTitle: \"Book "), F.col("doc_id").cast("string"), F.lit("\"\nauthor: 'Ann: B'\nnote\n--- \n\n"))
    return t.select(F.col("doc_id").cast("string").alias("book_id"), F.concat(head, body).alias("text"))


def render_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a render log: a user is a chapter."""
    t = table(spark, sf_dir, "events")
    status = F.element_at(F.array(*[F.lit(x) for x in ("rendering", "done", "cached", "failed")]), (F.col("event_id") % 4 + 1).cast("int"))
    return t.select((F.col("user_id") % 10).cast("string").alias("book_id"), F.col("user_id").alias("chapter_index"), F.col("event_id").alias("seq"), status.alias("status"), F.when(status.isin("done", "cached"), F.col("value")).otherwise(0.0).alias("duration_s"), (F.col("event_id") % 500).cast("long").alias("word_count"))
