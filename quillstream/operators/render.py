"""Hashes, the render cache, its plan and summaries, progress and the chapters' timeline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.values import CONFIG_DEFAULTS, WORDS_PER_MINUTE

CHAPTER = ["book_id", "chapter_index"]
HASHES = ["text_hash", "casting_hash", "render_params_hash"]
OK, FAILED = "ok", "failed"


def canonical_json(value: Column) -> Column:
    """JSON of a struct or map whose keys stand in order: nothing between tokens, nulls kept, control characters escaped in lower case."""
    text = F.to_json(value, {"ignoreNullFields": "false"})
    for k in range(32):
        if chr(k) not in "\b\t\n\f\r":
            text = F.replace(text, F.lit(f"\\u{k:04X}"), F.lit(f"\\u{k:04x}")) if f"{k:04X}" != f"{k:04x}" else text
    return text


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def casting_hash(books: DataFrame, casting: DataFrame) -> DataFrame:
    """casting_hash of each book (book_id, fallback_voice_id): of keys, voices and emotions alone."""
    entry = F.struct("speaker_key", F.struct(F.col("emotion").alias("emotion"), F.col("voice").alias("voice")).alias("v"))
    by_book = casting.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("_cast"))
    empty = F.create_map().cast("map<string,struct<emotion:string,voice:string>>")
    rows = books.join(by_book, "book_id", "left").withColumn("_cast", F.coalesce("_cast", empty))
    return rows.select("book_id", F.sha2(canonical_json(F.struct(F.col("_cast").alias("characters"), F.col("fallback_voice_id").alias("fallback_voice_id"))), 256).alias("casting_hash"))


def params_hash(config: DataFrame) -> DataFrame:
    """render_params_hash of each book: of sample rate and the two pauses."""
    return config.select("book_id", F.sha2(canonical_json(F.struct("dialogue_pause_ms", "narrator_pause_ms", "sample_rate")), 256).alias("render_params_hash"))


def render_plan(chapters: DataFrame, manifest: DataFrame, from_chapter: int = 0) -> DataFrame:
    """chapters (keys and the three hashes) with action: skipped before from_chapter, cached where the manifest's entry still holds, else render."""
    old = manifest.select(*CHAPTER, *[F.col(c).alias(f"_{c}") for c in HASHES], F.col("status").alias("_status"), F.col("wav_exists").alias("_exists"))
    valid = (F.col("_status") == OK) & F.col("_exists")
    for c in HASHES:
        valid = valid & (F.col(f"_{c}") == F.col(c))
    action = F.when(F.col("chapter_index") < from_chapter, F.lit("skipped")).when(F.coalesce(valid, F.lit(False)), F.lit("cached")).otherwise(F.lit("render"))
    return chapters.join(old, CHAPTER, "left").withColumn("action", action).select(*chapters.columns, "action")


def upsert(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """The manifest with entries put in; a chapter's entry replaces the whole old one."""
    return manifest.join(entries.select(*CHAPTER), CHAPTER, "left_anti").unionByName(entries.select(manifest.columns))


def run_missing(plan: DataFrame, synthesise, result_schema: str) -> DataFrame:
    """Gives the chapters to render to ``synthesise``, a function of Arrow batches, on the executors."""
    return plan.where(F.col("action") == "render").mapInArrow(synthesise, result_schema)


def render_summary(outcomes: DataFrame) -> DataFrame:
    """n_rendered, n_cached, n_failed, n_total and failed, the failed chapters in order, of each book (status done, cached or failed)."""
    count = lambda s: F.count_if(F.col("status") == s)
    return outcomes.groupBy("book_id").agg(
        count("done").alias("n_rendered"), count("cached").alias("n_cached"), count("failed").alias("n_failed"), F.count("*").alias("n_total"),
        F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("chapter_index")))).alias("failed"))


def latest_state(events: DataFrame) -> DataFrame:
    """The state of each chapter after its events (book_id, chapter_index, seq, status, duration_s, word_count).

    started and cached begin a chapter anew, failed and finished (done) change it; finished counts only for a chapter that
    is known.  word_count is that of the last start, 0 after cached.
    """
    begun = F.min(F.when(F.col("status") != "done", F.col("seq"))).over(Window.partitionBy(*CHAPTER))
    known = events.withColumn("_begun", begun).where((F.col("status") != "done") | (F.col("seq") > F.col("_begun")))
    begins = F.col("status").isin("rendering", "cached")
    words = F.max_by(F.when(F.col("status") == "rendering", F.col("word_count")).otherwise(0), F.when(begins, F.col("seq")))
    return known.groupBy(*CHAPTER).agg(F.max_by(F.struct("status", "duration_s"), "seq").alias("_last"), F.coalesce(words, F.lit(0)).alias("word_count")).select(*CHAPTER, "_last.*", "word_count")


def progress(states: DataFrame, totals: DataFrame) -> DataFrame:
    """Progress of each book: counts, percent, mean seconds and words per minute of what was rendered, and eta_seconds.

    eta_seconds is 0 with nothing left and null with nothing rendered yet.
    """
    done = F.col("status") == "done"
    some = states.groupBy("book_id").agg(
        F.count_if(done).alias("n_rendered"), F.count_if(F.col("status") == "cached").alias("n_cached"), F.count_if(F.col("status") == "failed").alias("n_failed"),
        F.sum(F.when(done, F.col("duration_s"))).alias("_seconds"), F.sum(F.when(done & (F.col("word_count") > 0), F.col("word_count"))).alias("_words"))
    rows = totals.join(some, "book_id", "left").fillna(0, ["n_rendered", "n_cached", "n_failed"])
    finished = F.col("n_rendered") + F.col("n_cached")
    left = F.col("total_chapters") - finished - F.col("n_failed")
    average = F.when(F.col("n_rendered") > 0, F.col("_seconds") / F.col("n_rendered")).otherwise(0.0)
    pace = F.when((F.col("n_rendered") > 0) & F.col("_words").isNotNull() & (F.col("_seconds") != 0), F.col("_words") / (F.col("_seconds") / 60.0)).otherwise(float(WORDS_PER_MINUTE))
    return rows.select(
        "book_id", "total_chapters", "n_rendered", "n_cached", "n_failed",
        F.when(F.col("total_chapters") == 0, 0.0).otherwise(finished / F.col("total_chapters") * 100).alias("percent"),
        average.alias("avg_seconds"), pace.alias("wpm"), F.when(left <= 0, 0.0).when(F.col("n_rendered") > 0, left * average).alias("eta_seconds"))


def eta_text(seconds: Column) -> Column:
    minutes, rest = F.floor(seconds / 60).cast("string"), F.floor(F.pmod(seconds, F.lit(60.0))).cast("string")
    return (F.when(seconds.isNull(), "estimating...").when(seconds <= 0, "done")
            .when(seconds >= 60, F.concat(F.lit("~"), minutes, F.lit("m "), rest, F.lit("s remaining"))).otherwise(F.concat(F.lit("~"), rest, F.lit("s remaining"))))


def progress_text(rows: DataFrame) -> DataFrame:
    """Adds eta and summary, the progress in words; percentages round half to even."""
    text = lambda c: F.col(c).cast("string")
    eta = eta_text(F.col("eta_seconds"))
    failed = F.when(F.col("n_failed") > 0, F.concat(text("n_failed"), F.lit(" failed ")))
    summary = F.concat(
        F.bround("percent", 0).cast("long").cast("string"), F.lit("% complete ("), text("n_rendered"), F.lit(" rendered "), text("n_cached"), F.lit(" cached "),
        F.coalesce(failed, F.lit("")), F.lit("of "), text("total_chapters"), F.lit(" total)"), F.when(eta != "done", F.concat(F.lit(" | "), eta)).otherwise(F.lit("")))
    return rows.withColumn("eta", eta).withColumn("summary", summary)


def timeline(chapters: DataFrame, pause_ms: int = CONFIG_DEFAULTS["chapter_pause_ms"]) -> DataFrame:
    """start_ms and end_ms of each chapter (duration_seconds), with a pause between chapters."""
    length = (F.col("duration_seconds") * 1000).cast("long")
    before = F.sum(length + pause_ms).over(Window.partitionBy("book_id").orderBy("chapter_index").rowsBetween(Window.unboundedPreceding, -1))
    return chapters.withColumn("start_ms", F.coalesce(before, F.lit(0)).cast("long")).withColumn("end_ms", F.col("start_ms") + length)


def ffmetadata(chapters: DataFrame, pause_ms: int = CONFIG_DEFAULTS["chapter_pause_ms"]) -> DataFrame:
    """book_id and metadata, the chapter marks as a metadata file."""
    mark = F.format_string("[CHAPTER]\nTIMEBASE=1/1000\nSTART=%d\nEND=%d\ntitle=%s\n", "start_ms", "end_ms", "title")
    marks = F.array_sort(F.collect_list(F.struct("chapter_index", mark.alias("mark"))))
    return timeline(chapters, pause_ms).groupBy("book_id").agg(F.concat(F.lit(";FFMETADATA1\n"), F.array_join(F.transform(marks, lambda x: x["mark"]), "\n")).alias("metadata"))


def with_book_tags(metadata: Column, title: Column, artist: Column) -> Column:
    """Title and artist after the file's first line."""
    tags = F.concat(F.lit(";FFMETADATA1\ntitle="), title, F.lit("\nartist="), artist)
    return F.concat(tags, F.substr(metadata, F.lit(len(";FFMETADATA1") + 1)))


def concat_plan(chapters: DataFrame, pause_ms: int = CONFIG_DEFAULTS["chapter_pause_ms"]) -> DataFrame:
    """The files to join, in order: each chapter's audio and, between two, a silence."""
    last = F.max("chapter_index").over(Window.partitionBy("book_id"))
    pieces = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("audio").alias("kind"), F.col("audio_path").alias("path"), F.lit(0).alias("silence_ms")),
        F.when((F.col("chapter_index") < F.col("_last")) & (F.lit(pause_ms) > 0), F.struct(F.lit(1).alias("part"), F.lit("silence").alias("kind"), F.lit(None).cast("string").alias("path"), F.lit(pause_ms).alias("silence_ms"))))
    rows = chapters.withColumn("_last", last).select("book_id", "chapter_index", F.inline(F.filter(pieces, lambda p: p.isNotNull())))
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("book_id").orderBy("chapter_index", "part")) - 1).cast("long")).drop("part")


def safe_title(title: Column) -> Column:
    """A title as part of a file name: letters, digits, blanks, - and _ stay."""
    return F.regexp_replace(title, r"[^\p{L}\p{N} \-_]", "_")


def mp3_names(chapters: DataFrame) -> DataFrame:
    return chapters.withColumn("file_name", F.concat(F.lpad((F.col("chapter_index") + 1).cast("string"), 2, "0"), F.lit("_"), safe_title(F.col("title")), F.lit(".mp3")))


def render_log(utterances: DataFrame, outcomes: DataFrame) -> DataFrame:
    """log, one JSON object per chapter: utterances, characters, status, and on failure the line, speaker and text preview (80 characters).

    outcomes has the keys, status, error and error_line.
    """
    stats = utterances.groupBy(*CHAPTER).agg(F.count("*").alias("utterance_count"), F.sum(F.length("text")).alias("total_chars"))
    at = utterances.select(*CHAPTER, F.col("line_index").alias("error_line"), F.col("speaker").alias("error_speaker"), F.substring("text", 1, 80).alias("error_preview"))
    rows = outcomes.join(stats, CHAPTER, "left").join(at, [*CHAPTER, "error_line"], "left")
    log = F.struct("chapter_index", F.coalesce("utterance_count", F.lit(0).cast("long")).alias("utterance_count"), F.coalesce("total_chars", F.lit(0).cast("long")).alias("total_chars"), "status", "error", "error_line", "error_speaker", "error_preview")
    return rows.select(*CHAPTER, F.to_json(log, {"ignoreNullFields": "false"}).alias("log"))
