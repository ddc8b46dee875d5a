"""Paragraphs, inline overrides, quoted spans, attribution and utterances."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions.profile import ENGLISH, Profile, mood_verbs, said_patterns
from quillstream.functions.text import SPACE, UNICODE_ANY_CASE, is_blank, let, speaker_key, strip
from quillstream.functions.values import CONTEXT_CHARS, NARRATOR, UNKNOWN

OVERRIDE = rf"(?U)\A\[([^\]|]+)(?:\|([^\]]+))?\]{SPACE}*"
SPANS = "array<struct<s:int,e:int>>"
SEGMENTS = "array<struct<text:string,is_dialogue:boolean,s:int,e:int>>"


def paragraphs(text: Column) -> Column:
    """What stands between blank lines, stripped, without the empty ones."""
    return F.filter(F.transform(F.split(text, r"(?U)\n" + SPACE + r"*\n"), strip), lambda p: p != "")


def inline_override(text: Column) -> Column:
    """struct(character, emotion, text): a leading [Character] or [Character|emotion] taken off; nulls without one."""
    tag = F.regexp_extract(text, OVERRIDE, 0)
    found = lambda k: F.when(tag != "", strip(F.regexp_extract(text, OVERRIDE, k)))
    emotion = F.when(F.regexp_extract(text, OVERRIDE, 2) != "", found(2))
    return F.struct(found(1).alias("character"), emotion.alias("emotion"), F.substr(text, F.length(tag) + 1).alias("text"))


def _pair_spans(text: Column, pair: tuple[str, str]) -> Column:
    """Spans of one pair of marks, in order; a match is the first place of its own text after the match before."""
    opening, closing = (re.escape(x) for x in pair)
    found = F.regexp_extract_all(text, F.lit(f"{opening}[^{closing}]+{closing}"), F.lit(0))

    def step(spans: Column, match: Column) -> Column:
        at = F.call_function("locate", match, text, F.coalesce(F.try_element_at(spans, F.lit(-1))["e"], F.lit(0)) + 1) - 1
        return F.concat(spans, F.array(F.struct(at.alias("s"), (at + F.length(match)).alias("e")))).cast(SPANS)

    return F.aggregate(found, F.array().cast(SPANS), step)


def quoted_spans(text: Column, profile: Profile | None = None, single: bool = False) -> Column:
    """Spans of all pairs of marks by start; one that starts within a span of an earlier pair is left out."""
    spans = F.array().cast(SPANS)
    for opening, closing, only_single in (profile or ENGLISH).quotes:
        if single or not only_single:
            spans = _merged(spans, _pair_spans(text, (opening, closing)))
    return F.array_sort(spans)


def _merged(old: Column, new: Column) -> Column:
    return let(old, lambda kept: F.concat(kept, F.filter(new, lambda c: ~F.exists(kept, lambda q: (q["s"] <= c["s"]) & (c["s"] < q["e"])))))


def segments(text: Column, profile: Profile | None = None, single: bool = False) -> Column:
    """Dialogue and narration of a paragraph in order: text, is_dialogue, and its start and end.

    Narration is stripped and left out if blank; a quoted span that holds an earlier one's start moves the reading
    place back, so that text after it may come twice.
    """
    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SEGMENTS).alias("out"))
    kind = f"struct<pos:int,out:{SEGMENTS}>"
    between = lambda a, b: F.substring(text, a + 1, b - a)

    def gap(a: Column, b: Column) -> Column:
        words = strip(between(a, b))
        piece = F.array(F.struct(words.alias("text"), F.lit(False).alias("is_dialogue"), a.alias("s"), b.alias("e"))).cast(SEGMENTS)
        return F.when((b > a) & (words != ""), piece).otherwise(F.array().cast(SEGMENTS))

    def step(state: Column, q: Column) -> Column:
        said = F.array(F.struct(between(q["s"] + 1, q["e"] - 1).alias("text"), F.lit(True).alias("is_dialogue"), q["s"].alias("s"), q["e"].alias("e")))
        return F.struct(q["e"].alias("pos"), F.concat(state["out"], gap(state["pos"], q["s"]), said).alias("out")).cast(kind)

    return F.aggregate(quoted_spans(text, profile, single), start.cast(kind), step, lambda s: F.concat(s["out"], gap(s["pos"], F.length(text))))


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def is_valid_speaker(name: Column, cast_keys: Column, profile: Profile | None = None) -> Column:
    """A cast name, or one that is not on the blacklist and looks like a name."""
    profile = profile or ENGLISH
    key = speaker_key(name)
    looks = ~F.array_contains(strings(profile.not_names), key) & name.rlike(profile.name_pattern)
    return F.coalesce((name != "") & (F.array_contains(cast_keys, key) | looks), F.lit(False))


def said_context(text: Column, s: Column, e: Column) -> Column:
    """CONTEXT_CHARS before a span and after it."""
    before = F.substring(text, F.greatest(s - CONTEXT_CHARS, F.lit(0)) + 1, F.least(s, F.lit(CONTEXT_CHARS)))
    return F.concat(before, F.lit(" "), F.substring(text, e + 1, F.lit(CONTEXT_CHARS)))


def attribution(context: Column, cast_keys: Column, profile: Profile | None = None) -> Column:
    """struct(speaker, emotion) from a span's context: the first pattern whose first match is a valid name; nulls without one."""
    profile = profile or ENGLISH
    name = F.lit(None).cast("string")
    for pattern in reversed(said_patterns(profile)):
        found = F.regexp_extract(context, UNICODE_ANY_CASE + pattern, 1)
        name = F.when(is_valid_speaker(found, cast_keys, profile), found).otherwise(name)
    hints = mood_verbs(profile)
    emotion = F.lit(None).cast("string")
    if hints:
        verb = F.lower(F.regexp_extract(context, UNICODE_ANY_CASE + rf"\b({'|'.join(map(re.escape, hints))})\b", 1))
        emotion = F.element_at(F.create_map(*[F.lit(x) for v in hints for x in (v, hints[v])]), F.when(verb != "", verb))
    return let(name, lambda n: F.struct(n.alias("speaker"), F.when(n.isNotNull(), emotion).alias("emotion")))


def compile_utterances(chapters: DataFrame, cast_keys: DataFrame | None = None, profile: Profile | None = None, single: bool = False) -> DataFrame:
    """book_id, chapter_index, line_index, speaker, text, type, emotion of chapters (book_id, chapter_index, raw_text).

    cast_keys (book_id, speaker_key) names who is cast; one row per book joins its keys as an array.  All steps but
    that join are narrow: a chapter's paragraphs, segments and line numbers stay in its row until they are exploded.
    """
    profile = profile or ENGLISH
    if cast_keys is None:
        keyed = chapters.withColumn("_cast", F.array().cast("array<string>"))
    else:
        by_book = cast_keys.groupBy("book_id").agg(F.collect_set("speaker_key").alias("_cast"))
        keyed = chapters.join(by_book, "book_id", "left").withColumn("_cast", F.coalesce("_cast", F.array().cast("array<string>")))
    empty = F.array().cast(SEGMENTS)

    def of(paragraph: Column) -> Column:
        return let(inline_override(paragraph), lambda o: let(segments(o["text"], profile, single), lambda parts: F.struct(
            o.alias("o"), F.when(F.size(parts) > 0, parts).otherwise(empty).alias("parts"), (F.size(parts) == 0).alias("plain"))))

    exploded = keyed.select("book_id", "chapter_index", "_cast", F.posexplode_outer(F.transform(paragraphs(F.col("raw_text")), of)).alias("para", "p")).where(F.col("para").isNotNull())
    # A paragraph without a segment, as one that was only an override, is one narration of whoever was named.
    alone = F.array(F.struct(F.col("p.o.text").alias("text"), F.lit(False).alias("is_dialogue"), F.lit(-1).alias("s"), F.lit(-1).alias("e"))).cast(SEGMENTS)
    rows = exploded.select("book_id", "chapter_index", "_cast", "para", F.col("p.o").alias("o"), F.col("p.plain").alias("plain"), F.posexplode_outer(F.when(F.col("p.plain"), alone).otherwise(F.col("p.parts"))).alias("seg", "g"))
    rows = rows.where(F.col("plain") | ~is_blank(F.col("g.text")))
    said = attribution(said_context(F.col("o.text"), F.col("g.s"), F.col("g.e")), F.col("_cast"), profile)
    named = F.col("o.character") != ""
    speaker = F.when(F.col("plain"), F.when(named, F.col("o.character")).otherwise(NARRATOR)).when(~F.col("g.is_dialogue"), NARRATOR).when(named, F.col("o.character")).otherwise(F.coalesce(F.col("a.speaker"), F.lit(UNKNOWN)))
    emotion = F.when(F.col("plain"), F.col("o.emotion")).when(~F.col("g.is_dialogue"), F.lit(None)).when(named, F.col("o.emotion")).otherwise(F.col("a.emotion"))
    line = F.row_number().over(Window.partitionBy("book_id", "chapter_index").orderBy("para", "seg")) - 1
    return rows.withColumn("a", F.when(F.col("g.is_dialogue") & F.coalesce(~named, F.lit(True)), said)).select(
        "book_id", "chapter_index", line.cast("long").alias("line_index"), speaker.alias("speaker"), F.col("g.text").alias("text"),
        F.when(F.col("g.is_dialogue"), F.lit("dialogue")).otherwise(F.lit("narration")).alias("type"), emotion.alias("emotion"))


def script_line(n: Column, speaker: Column, emotion: Column, text: Column) -> Column:
    mood = F.when(F.coalesce(emotion, F.lit("")) != "", F.concat(F.lit("("), emotion, F.lit(") "))).otherwise(F.lit(""))
    return F.concat(F.lit("[S"), n.cast("string"), F.lit(":"), speaker, F.lit("] "), mood, text)


def script_lines(utterances: DataFrame) -> DataFrame:
    """Adds speaker_no, by a speaker's first line in its chapter, and line, the script line."""
    chapter = ["book_id", "chapter_index"]
    keyed = utterances.withColumn("speaker_key", speaker_key(F.col("speaker")))
    first = keyed.withColumn("_first", F.min("line_index").over(Window.partitionBy(*chapter, "speaker_key")))
    numbered = first.withColumn("speaker_no", F.dense_rank().over(Window.partitionBy(*chapter).orderBy("_first")).cast("long")).drop("_first")
    return numbered.withColumn("line", script_line(F.col("speaker_no"), F.col("speaker_key"), F.col("emotion"), F.col("text")))


def script(utterances: DataFrame) -> DataFrame:
    """book_id, chapter_index and script, its lines joined."""
    lines = F.array_sort(F.collect_list(F.struct("line_index", "line")))
    return script_lines(utterances).groupBy("book_id", "chapter_index").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("script"))
