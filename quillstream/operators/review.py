"""The review script: utterances as text that people edit, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.text import strip

CHAPTER = ["book_id", "chapter_index"]
#: A chapter's marker, and a speaker's tag with an emotion or without.
SECTION = r"(?Ud)\A===\s*(.+?)\s*===$"
SPEAKER = r"(?Ud)\A@(\w+)(?:\s*\(([^)]+)\))?$"
NOT_COMPILED, NO_UTTERANCES, NOT_FOUND = "# (Not compiled)", "# (Chapter not compiled - no utterances)", "# Chapter not found"


def blocks(utterances: DataFrame) -> DataFrame:
    """Adds block, from 0 in each chapter: it goes up where speaker or emotion differs from the line before."""
    order = Window.partitionBy(*CHAPTER).orderBy("line_index")
    changed = ~(F.lag("speaker").over(order).eqNullSafe(F.col("speaker")) & F.lag("emotion").over(order).eqNullSafe(F.col("emotion")))
    marked = utterances.withColumn("_new", F.when((F.row_number().over(order) > 1) & changed, 1).otherwise(0))
    return marked.withColumn("block", F.sum("_new").over(order).cast("long")).drop("_new")


def tag(speaker: Column, emotion: Column) -> Column:
    return F.when(F.coalesce(emotion, F.lit("")) != "", F.concat(F.lit("@"), speaker, F.lit(" ("), emotion, F.lit(")"))).otherwise(F.concat(F.lit("@"), speaker))


def block_texts(utterances: DataFrame) -> DataFrame:
    """One row per block: speaker, emotion, n_lines and text, the tag and a line for each utterance."""
    lines = F.array_sort(F.collect_list(F.struct("line_index", "text")))
    grouped = blocks(utterances).groupBy(*CHAPTER, "block").agg(F.first("speaker").alias("speaker"), F.first("emotion").alias("emotion"), F.count("*").alias("n_lines"), lines.alias("_lines"))
    return grouped.withColumn("text", F.concat_ws("\n", tag(F.col("speaker"), F.col("emotion")), F.array_join(F.transform("_lines", lambda x: x["text"]), "\n"))).drop("_lines")


def chapter_texts(chapters: DataFrame, utterances: DataFrame, marker: str = NO_UTTERANCES) -> DataFrame:
    """body, the review text of each chapter (book_id, chapter_index, title); one without utterances has the marker."""
    texts = F.array_sort(F.collect_list(F.struct("block", "text")))
    joined = block_texts(utterances).groupBy(*CHAPTER).agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n").alias("_body"))
    head = F.concat(F.lit("=== "), F.col("title"), F.lit(" ===\n\n"))
    return chapters.join(joined, CHAPTER, "left").select(*CHAPTER, "title", F.concat(head, F.coalesce("_body", F.lit(marker))).alias("body"))


def preview(chapters: DataFrame, utterances: DataFrame, chapter_index: int = 0) -> DataFrame:
    """book_id and body of one chapter of each book, without the file's head."""
    found = chapter_texts(chapters, utterances, NOT_COMPILED).where(F.col("chapter_index") == chapter_index).select("book_id", "body")
    return chapters.select("book_id").distinct().join(found, "book_id", "left").withColumn("body", F.coalesce("body", F.lit(NOT_FOUND)))


def export(books: DataFrame, chapters: DataFrame, utterances: DataFrame, file_suffix: str = "_review.txt") -> DataFrame:
    """book_id and text, the whole review file of each book (book_id, title, author)."""
    head = F.concat(
        F.lit("# Review file\n# Title: "), F.col("title"), F.lit("\n# Author: "), F.col("author"),
        F.lit("\n#\n# How to edit:\n#   - another speaker: change @OldName to @NewName\n#   - another emotion: change @Name (old) to @Name (new)\n#   - no emotion yet: @narrator -> @narrator (somber)\n"
              "#   - delete a speaker's block to leave it out\n#   - lines that start with # are ignored\n#\n# Import again from: "), F.col("title"), F.lit(file_suffix + "\n\n"))
    parts = F.array_sort(F.collect_list(F.struct("chapter_index", "body")))
    bodies = chapter_texts(chapters, utterances).groupBy("book_id").agg(F.array_join(F.transform(parts, lambda x: x["body"]), "\n\n").alias("_all"))
    return books.join(bodies, "book_id", "left").select("book_id", F.concat(head, F.coalesce("_all", F.lit("")), F.lit("\n")).alias("text"))


def parse(files: DataFrame) -> DataFrame:
    """Sections of review files (book_id, text): book_id, section, title, and blocks as an array of (speaker, emotion, text).

    Comments and blank lines are left out; a section's marker ends the speaker; a tag starts a block; lines of a block are
    joined by blanks; a block without text is dropped; text before a speaker or a section is lost; a section may be empty.
    A file stays in its row: one fold reads its lines in order.
    """
    block = "struct<speaker:string,emotion:string,lines:array<string>>"
    section = f"struct<title:string,blocks:array<{block}>>"
    state = f"struct<done:array<{section}>,title:string,blocks:array<{block}>,open:{block}>"
    lines = F.filter(F.transform(F.split("text", "\n"), strip), lambda x: (x != "") & ~x.startswith("#"))

    def closed(s: Column) -> Column:
        """The blocks with the open one, if it has text."""
        return F.when(F.size(s["open"]["lines"]) > 0, F.concat(s["blocks"], F.array(s["open"]))).otherwise(s["blocks"])

    def finished(s: Column) -> Column:
        return F.when(s["title"].isNotNull(), F.concat(s["done"], F.array(F.struct(s["title"].alias("title"), closed(s).alias("blocks")).cast(section)))).otherwise(s["done"])

    none = F.array().cast(f"array<{block}>")
    no_block = F.struct(F.lit(None).cast("string").alias("speaker"), F.lit(None).cast("string").alias("emotion"), F.array().cast("array<string>").alias("lines")).cast(block)

    def step(s: Column, x: Column) -> Column:
        is_section, is_tag = x.rlike(SECTION), x.rlike(SPEAKER)
        emotion = F.regexp_extract(x, SPEAKER, 2)
        fresh = F.struct(F.regexp_extract(x, SPEAKER, 1).alias("speaker"), F.when(emotion != "", emotion).alias("emotion"), F.array().cast("array<string>").alias("lines")).cast(block)
        longer = F.struct(s["open"]["speaker"].alias("speaker"), s["open"]["emotion"].alias("emotion"), F.concat(s["open"]["lines"], F.array(x)).alias("lines")).cast(block)
        return F.struct(
            F.when(is_section, finished(s)).otherwise(s["done"]).alias("done"),
            F.when(is_section, F.regexp_extract(x, SECTION, 1)).otherwise(s["title"]).alias("title"),
            F.when(is_section, none).when(is_tag, closed(s)).otherwise(s["blocks"]).alias("blocks"),
            F.when(is_section, no_block).when(is_tag, fresh).when(s["open"]["speaker"].isNotNull(), longer).otherwise(s["open"]).alias("open")).cast(state)

    start = F.struct(F.array().cast(f"array<{section}>").alias("done"), F.lit(None).cast("string").alias("title"), none.alias("blocks"), no_block.alias("open")).cast(state)
    return files.select("book_id", F.posexplode(F.aggregate(lines, start, step, finished)).alias("section", "s")).select("book_id", F.col("section").cast("long").alias("section"), "s.title", "s.blocks")


def import_reviewed(files: DataFrame, chapters: DataFrame) -> DataFrame:
    """Utterances of the chapters that a section names (the first chapter of that title); the last section of a chapter counts.

    A chapter whose last section has no block gives no rows; updated_chapters() names it.
    """
    last = _matched(files, chapters).groupBy(*CHAPTER).agg(F.max_by("blocks", "section").alias("blocks"))
    rows = last.select(*CHAPTER, F.posexplode("blocks").alias("line_index", "b"))
    text = F.array_join("b.lines", " ")
    return rows.select(*CHAPTER, F.col("line_index").cast("long").alias("line_index"), "b.speaker", text.alias("text"), F.when(text.startswith('"'), F.lit("dialogue")).otherwise(F.lit("narration")).alias("type"), "b.emotion")


def updated_chapters(files: DataFrame, chapters: DataFrame) -> DataFrame:
    return _matched(files, chapters).select(*CHAPTER).distinct()


def import_stats(files: DataFrame, chapters: DataFrame) -> DataFrame:
    """chapters_updated and utterances_imported (over every section that matched) and speakers_found, sorted, of each file."""
    matched = _matched(files, chapters)
    counted = matched.groupBy("book_id").agg(F.count("*").alias("chapters_updated"), F.sum(F.size("blocks")).cast("long").alias("utterances_imported"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("blocks", lambda b: b["speaker"]))))).alias("speakers_found"))
    return files.select("book_id").join(counted, "book_id", "left").select("book_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("chapters_updated", "utterances_imported")], F.coalesce("speakers_found", F.array().cast("array<string>")).alias("speakers_found"))


def _matched(files: DataFrame, chapters: DataFrame) -> DataFrame:
    first = chapters.groupBy("book_id", "title").agg(F.min("chapter_index").alias("chapter_index"))
    return parse(files).join(first, ["book_id", "title"])
