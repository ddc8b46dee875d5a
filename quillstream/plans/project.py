"""A library of books as one object: its tables, and the steps from text to script and render plan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.profile import language as profile_of
from quillstream.functions.values import CONFIG_DEFAULTS
from quillstream.operators import casting as C
from quillstream.operators import dialogue as D
from quillstream.operators import emotion as E
from quillstream.operators import render as R
from quillstream.operators import resolve as N
from quillstream.operators import review as V
from quillstream.operators import stats as S
from quillstream.operators import suggest as G
from quillstream.sources import books as B


class VoiceNotFound(ValueError):
    """Voices that are cast but not to be had."""


@dataclass(frozen=True)
class Project:
    """Books (book_id, title, author), their chapters, casting, utterances once compiled, and settings.

    A step returns a new project; nothing runs before a table is read or written.
    """

    books: DataFrame
    chapters: DataFrame
    casting: DataFrame
    utterances: DataFrame | None = None
    config: dict | None = None

    @property
    def settings(self) -> dict:
        return CONFIG_DEFAULTS | (self.config or {})

    @classmethod
    def from_books(cls, books: DataFrame, delimiter: str | None = None, **config) -> Project:
        """From books with their text, as the sources give them."""
        profile_of(config.get("language_code", "en"))
        return cls(books.select("book_id", "title", "author", F.col("book_id").alias("source_path")), B.chapters_of(books, delimiter), C.narrator_cast(books), None, config)

    @classmethod
    def from_text(cls, spark: SparkSession, path: str, **config) -> Project:
        return cls.from_books(B.text_books(spark, path), **config)

    @classmethod
    def from_string(cls, spark: SparkSession, text: str, title: str = "Untitled", author: str = "", **config) -> Project:
        return cls.from_books(B.from_string(spark, text, title, author), **config)

    @classmethod
    def from_chapters(cls, spark: SparkSession, chapters: list[tuple[str, str]], title: str = "Untitled", author: str = "", **config) -> Project:
        books = spark.createDataFrame([("book", title, author)], "book_id string, title string, author string")
        return cls(books, B.from_chapters(spark, chapters), C.narrator_cast(books), None, config)

    @classmethod
    def from_epub(cls, spark: SparkSession, path: str, **config) -> Project:
        items, settings = B.epub_items(spark, path), CONFIG_DEFAULTS | config
        chapters = B.epub_chapters(items, settings["min_chapter_words"], settings["keep_titled_short_chapters"])
        books = items.groupBy("book_id").agg(F.coalesce(F.first("title"), F.lit("Untitled")).alias("title"), F.coalesce(F.first("author"), F.lit("")).alias("author"))
        return cls(books, chapters, C.narrator_cast(books), None, config)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Project:
        """Project files, all their fields kept; steps have one set of settings, so files with others than the first are an error."""
        p = B.read_projects(spark, path)
        found = [r["config"].asDict() for r in p.select("config").distinct().limit(2).collect()]
        if len(found) > 1:
            raise ValueError("projects with different settings are loaded one by one")
        return cls(B.project_books(p), B.project_chapters(p), B.project_casting(p), B.project_utterances(p), found[0] if found else None)

    def save(self, path: str) -> None:
        """One JSON document per book."""
        B.write_json(B.project_json(self.books, self.chapters, self._spoken(), self.casting, self.config), path)

    def cast(self, name: str, voice: str, emotion: str | None = None, description: str | None = None) -> Project:
        """Casts a character in every book."""
        new = self.books.select("book_id", F.lit(0).alias("seq"), *[F.lit(v).cast("string").alias(k) for k, v in (("name", name), ("voice", voice), ("emotion", emotion), ("description", description))])
        return replace(self, casting=C.cast(self.casting, new))

    def compile(self, quotes: DataFrame | None = None) -> Project:
        """Dialogue and attribution, then other attributions if there are any, then emotions."""
        p = self.settings
        language = profile_of(p["language_code"])
        found = D.compile_utterances(self.chapters, self.casting.select("book_id", "speaker_key"), language)
        found = N.resolve(found, quotes, p["booknlp_mode"]).drop("resolved")
        if p["emotion_mode"] != "off":
            found = E.apply_emotions(found, self.chapters, p["emotion_mode"], p["emotion_confidence_threshold"], language).drop("applied")
        return replace(self, utterances=found)

    def _spoken(self) -> DataFrame:
        if self.utterances is not None:
            return self.utterances
        return self.chapters.limit(0).select("book_id", "chapter_index", F.lit(0).cast("long").alias("line_index"), *[F.lit("").alias(c) for c in ("speaker", "text", "type", "emotion")])

    def detected_speakers(self) -> DataFrame:
        return S.detected_speakers(self._spoken())

    def uncast_speakers(self) -> DataFrame:
        return C.uncast_speakers(self._spoken(), self.casting)

    def suggest(self, voices: DataFrame) -> DataFrame:
        """A voice for each detected speaker, in the order of names, from its first lines."""
        samples = G.gender_votes(G.first_samples(self._spoken())).select("book_id", "speaker", "gender")
        order = F.row_number().over(D.Window.partitionBy("book_id").orderBy("speaker")).cast("long")
        people = self.detected_speakers().join(samples, ["book_id", "speaker"], "left").withColumn("seq", order)
        return G.suggest_all(people, voices, self.casting.select("book_id", "speaker_key", "voice"))

    def cast_suggested(self, voices: DataFrame) -> Project:
        return replace(self, casting=G.cast_suggested(self.uncast_speakers(), self.casting, voices))

    def review(self) -> DataFrame:
        return V.export(self.books, self.chapters, self._spoken())

    def import_review(self, files: DataFrame) -> Project:
        """Chapters that a review file names take its lines; the others keep theirs."""
        changed = V.updated_chapters(files, self.chapters)
        kept = self._spoken().join(changed, ["book_id", "chapter_index"], "left_anti")
        return replace(self, utterances=kept.unionByName(V.import_reviewed(files, self.chapters)))

    def info(self) -> DataFrame:
        chapters = self.chapters.select("book_id", "chapter_index", "raw_text", F.lit(0.0).alias("duration_seconds"), F.lit(False).alias("audio_exists"))
        return S.project_info(chapters, self._spoken(), self.casting, self.settings["estimated_wpm"])

    def check_voices(self, voices: DataFrame) -> None:
        missing = [r["voice_id"] for r in C.missing_voices(self.casting, voices, self.settings["fallback_voice_id"]).orderBy("voice_id").limit(100).collect()]
        if missing:
            raise VoiceNotFound(", ".join(missing))

    def render_keys(self) -> DataFrame:
        """Each chapter with the three hashes that its audio depends on."""
        p = self.settings
        fallback = self.books.select("book_id", F.lit(p["fallback_voice_id"]).alias("fallback_voice_id"))
        params = self.books.select("book_id", *[F.lit(p[k]).alias(k) for k in ("sample_rate", "narrator_pause_ms", "dialogue_pause_ms")])
        texts = self.chapters.select("book_id", "chapter_index", R.text_hash(F.col("raw_text")).alias("text_hash"))
        return texts.join(R.casting_hash(fallback, self.casting), "book_id").join(R.params_hash(params), "book_id")

    def render_plan(self, manifest: DataFrame, from_chapter: int = 0) -> DataFrame:
        return R.render_plan(self.render_keys(), manifest, from_chapter)
