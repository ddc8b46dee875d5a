"""Voice suggestions: scores with reasons, the best few, and a choice that avoids using a voice twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import values
from quillstream.functions.text import UNICODE_ANY_CASE, either, let, speaker_key


def voice_info(voices: DataFrame) -> DataFrame:
    """voice_id with gender, accent, style, tags and curated, from the id's prefix and the notes."""
    gender, accent = F.lit("unknown"), F.lit("unknown")
    for prefix, g, a in reversed(values.VOICE_PREFIXES):
        gender = F.when(F.col("voice_id").startswith(prefix), F.lit(g)).otherwise(gender)
        accent = F.when(F.col("voice_id").startswith(prefix), F.lit(a)).otherwise(accent)
    style, tags = F.lit("neutral"), F.array().cast("array<string>")
    for voice, s, t in values.VOICE_NOTES:
        style = F.when(F.col("voice_id") == voice, F.lit(s)).otherwise(style)
        tags = F.when(F.col("voice_id") == voice, F.array(*[F.lit(x) for x in t])).otherwise(tags)
    curated = F.col("voice_id").isin([v for v, _, _ in values.VOICE_NOTES])
    return voices.select("voice_id", gender.alias("gender"), accent.alias("accent"), style.alias("style"), tags.alias("tags"), curated.alias("curated"))


def gender_cues(text: Column) -> tuple[Column, Column]:
    """Female and male words in a text."""
    count = lambda cues: F.regexp_count(text, F.lit(UNICODE_ANY_CASE + rf"\b(?:{either(cues)})\b")).cast("long")
    return count(values.FEMALE_CUES), count(values.MALE_CUES)


def vote(female: Column, male: Column) -> Column:
    """The gender with two cues more than the other; null if neither."""
    return F.when(female > male + 1, F.lit("female")).when(male > female + 1, F.lit("male"))


def gender_votes(samples: DataFrame) -> DataFrame:
    """female, male and gender of each book_id and speaker from all its texts."""
    female, male = gender_cues(F.col("text"))
    counted = samples.groupBy("book_id", "speaker").agg(F.sum(female).alias("female"), F.sum(male).alias("male"))
    return counted.withColumn("gender", vote(F.col("female"), F.col("male")))


def first_samples(utterances: DataFrame, n: int = 5) -> DataFrame:
    """The first n utterances of each speaker as it is written, with sample_no."""
    order = Window.partitionBy("book_id", "speaker").orderBy("chapter_index", "line_index")
    return utterances.withColumn("sample_no", F.row_number().over(order).cast("long")).where(F.col("sample_no") <= n)


def _scored(gender: Column, narrator: Column, voice: Column, used: Column) -> Column:
    """struct(raw, reason) of a voice for a speaker; the parts are added in this order."""
    has = lambda tag: F.array_contains(voice["tags"], F.lit(tag))
    parts = [
        (F.coalesce(voice["gender"] == gender, F.lit(False)), values.GENDER_MATCH, F.concat(F.lit("gender match ("), gender, F.lit(")"))),
        (F.coalesce((voice["gender"] != gender) & (voice["gender"] != "unknown"), F.lit(False)), values.GENDER_MISMATCH, F.concat(F.lit("gender mismatch ("), voice["gender"], F.lit(")"))),
        (narrator & has("narrator"), values.NARRATOR_VOICE, F.lit("narrator voice")),
        (~narrator & has("dialogue"), values.DIALOGUE_VOICE, F.lit("dialogue voice")),
        (narrator & voice["style"].isin("calm", "neutral"), values.CLEAR_STYLE, F.concat(voice["style"], F.lit(" style"))),
        (used, values.REUSE, F.lit("already assigned to another speaker")),
        (voice["curated"], values.CURATED, F.lit("curated voice")),
    ]
    raw, reasons = F.lit(0.0), []
    for applies, points, reason in parts:
        raw = raw + F.when(applies, F.lit(points)).otherwise(F.lit(0.0))
        reasons.append(F.when(applies, reason))
    reason = F.concat_ws("; ", *reasons)
    return F.struct(raw.alias("raw"), F.when(reason == "", F.lit("default suggestion")).otherwise(reason).alias("reason"))


def _voice_list(voices: DataFrame) -> Column:
    """The voices as one constant: a catalogue has few, and they are read once."""
    rows = voice_info(voices).orderBy("voice_id").collect()
    kind = "array<struct<voice_id:string,gender:string,style:string,tags:array<string>,curated:boolean>>"
    text = lambda x: F.lit(x).cast("string")
    made = [F.struct(text(r["voice_id"]).alias("voice_id"), text(r["gender"]).alias("gender"), text(r["style"]).alias("style"), F.array(*[F.lit(t) for t in r["tags"]]).cast("array<string>").alias("tags"), F.lit(bool(r["curated"])).alias("curated")) for r in rows]
    return F.array(*made).cast(kind)


def is_narrator(speaker: Column) -> Column:
    return F.lower(speaker).isin(*values.NARRATOR_NAMES)


def score_voices(speakers: DataFrame, voices: DataFrame) -> DataFrame:
    """Every voice for every speaker (book_id, speaker, gender, used_voices): raw, score (0 to 1), reason, tags and rank.

    Voices meet speakers as an array in the speaker's row, so no speaker is sent anywhere.
    """
    made = F.transform(_voice_list(voices), lambda v: let(_scored(F.col("gender"), is_narrator(F.col("speaker")), v, F.array_contains("used_voices", v["voice_id"])), lambda s: F.struct((-s["raw"]).alias("order"), v["voice_id"].alias("voice_id"), s["raw"].alias("raw"), s["reason"].alias("reason"), v["tags"].alias("tags"))))
    rows = speakers.select("book_id", "speaker", F.posexplode(F.array_sort(made)).alias("rank", "v"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("v.raw") + 1.0) / 2.0))
    return rows.select("book_id", "speaker", F.col("v.voice_id").alias("voice_id"), F.col("v.raw").alias("raw"), score.alias("score"), F.col("v.reason").alias("reason"), F.col("v.tags").alias("tags"), (F.col("rank") + 1).cast("long").alias("rank"))


def top_voices(speakers: DataFrame, voices: DataFrame, k: int = 3) -> DataFrame:
    return score_voices(speakers, voices).where(F.col("rank") <= k)


def suggest_all(speakers: DataFrame, voices: DataFrame, already: DataFrame | None = None) -> DataFrame:
    """The best voice of each speaker (book_id, seq, speaker, gender), one after the other: what one takes counts as used for the next.

    already (book_id, speaker_key, voice) is in use from the start; a speaker whose written name is such a key gives that
    voice up once it has been suggested another.  A book's speakers, not its text, meet in one row.
    """
    state = "struct<used:map<string,string>,out:array<struct<speaker:string,voice_id:string,raw:double,reason:string>>>"
    row = F.array_sort(F.collect_list(F.struct("seq", "speaker", "gender")))
    books = speakers.groupBy("book_id").agg(row.alias("people"))
    if already is None:
        books = books.withColumn("used", F.create_map().cast("map<string,string>"))
    else:
        taken = already.groupBy("book_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("speaker_key", "voice")))).alias("used"))
        books = books.join(taken, "book_id", "left").withColumn("used", F.coalesce("used", F.create_map().cast("map<string,string>")))
    catalogue = _voice_list(voices)

    def step(s: Column, who: Column) -> Column:
        taken = F.map_values(s["used"])
        made = F.transform(catalogue, lambda v: let(_scored(who["gender"], is_narrator(who["speaker"]), v, F.array_contains(taken, v["voice_id"])), lambda x: F.struct((-x["raw"]).alias("order"), v["voice_id"].alias("voice_id"), x["raw"].alias("raw"), x["reason"].alias("reason"))))
        return let(F.array_min(made), lambda best: F.struct(
            F.map_concat(F.map_filter(s["used"], lambda k, _: k != who["speaker"]), F.create_map(who["speaker"], best["voice_id"])).alias("used"),
            F.concat(s["out"], F.array(F.struct(who["speaker"].alias("speaker"), best["voice_id"].alias("voice_id"), best["raw"].alias("raw"), best["reason"].alias("reason")))).alias("out")).cast(state))

    start = F.struct(F.col("used").alias("used"), F.array().cast("array<struct<speaker:string,voice_id:string,raw:double,reason:string>>").alias("out")).cast(state)
    chosen = books.select("book_id", F.posexplode(F.aggregate("people", start, step, lambda s: s["out"])).alias("seq", "c"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("c.raw") + 1.0) / 2.0))
    return chosen.select("book_id", F.col("seq").cast("long").alias("seq"), "c.speaker", "c.voice_id", score.alias("score"), "c.reason")


def cast_suggested(uncast: DataFrame, casting: DataFrame, voices: DataFrame) -> DataFrame:
    """Casts every uncast key (book_id, speaker_key) with its suggestion, in the order of keys and without samples; all of casting with them."""
    order = F.row_number().over(Window.partitionBy("book_id").orderBy("speaker_key"))
    people = uncast.select("book_id", order.cast("long").alias("seq"), F.col("speaker_key").alias("speaker"), F.lit(None).cast("string").alias("gender"))
    new = suggest_all(people, voices, casting)
    null = F.lit(None).cast("string")
    added = new.select("book_id", speaker_key(F.col("speaker")).alias("speaker_key"), F.col("speaker").alias("name"), F.col("voice_id").alias("voice"), null.alias("emotion"), null.alias("description"))
    return casting.select(added.columns).unionByName(added)
